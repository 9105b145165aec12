"""Each stage on its own input, against SQL or the reference library."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import corpus_pipeline  # noqa: E402
from oracle import duck, plain  # noqa: E402

from caseloom.llm import bpe, decontam, linededup, neardup, quality  # noqa: E402
from caseloom.llm.common import env_path  # noqa: E402


def asked(folder, docs, sql):
    con = duck(folder)
    con.execute("DROP VIEW documents")
    con.register("documents", docs.toArrow())
    return con.execute(sql).fetchall()


def test_stages(spark, small, tmp_path):
    import public_tokenizers as P
    import tiktoken

    docs = spark.read.parquet(f"{small}/documents.parquet")
    frames = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frames[-1], small).write.parquet(str(tmp_path / str(k)))
        frames.append(spark.read.parquet(str(tmp_path / str(k))))
        if k < 4:
            assert frames[-1].columns == docs.columns
    ids = [sorted(r[0] for r in f.select("doc_id").collect()) for f in frames]
    assert ids[1] == sorted(r[0] for r in asked(small, frames[0], quality.judged_sql() + " SELECT doc_id FROM judged WHERE kept"))
    lines = asked(small, frames[1], linededup.kept_sql() + " SELECT doc_id, kept, length(kept) FROM line_kept WHERE n_removed = 0 OR regexp_matches(kept, '[^\\x20\\x09-\\x0D]')")
    assert sorted(lines) == sorted((r["doc_id"], r["text"], r["n_chars"]) for r in frames[2].collect())
    assert ids[3] == sorted(r[0] for r in asked(small, frames[2], neardup.components_sql("documents", 5, 80) + " SELECT doc_id FROM grouped WHERE doc_id = component_id"))
    assert ids[4] == sorted(r[0] for r in asked(small, frames[3], decontam.matched_sql() + " SELECT doc_id FROM matched WHERE n_hit = 0"))
    tool = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(env_path(bpe.DEFAULT_RANKS)), special_tokens={})
    text = {r["doc_id"]: r["text"] for r in frames[4].collect()}
    assert {r["doc_id"]: r["ids"] for r in frames[5].collect()} == {i: tool.encode_ordinary(t) for i, t in text.items()}
    whole = corpus_pipeline.run(spark, small).collect()
    assert sorted(plain(r["doc_id"]) for r in whole) == sorted(map(plain, ids[5]))


def test_odd_and_empty_tables(spark, small, odd, none):
    for docs in (none, odd.withColumn("n_chars", odd["n_words"])):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, small)
            out.count()
            if _ != corpus_pipeline.STAGES[-1][0]:
                docs = out
