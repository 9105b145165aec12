"""Each operator against a brute-force version, over odd rows, an empty table and the small tables."""

import hashlib
import re
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from oracle import duck, rows, same  # noqa: E402

from caseloom.llm import bpe, decontam, linededup, neardup, pii, pretokens, quality, registry, repair, secrets, suffixdedup, tagger, tokens  # noqa: E402
from caseloom.llm.common import env_path  # noqa: E402


def sha(b):
    return hashlib.sha256(b).hexdigest()


def texts(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def against_duck(df, sql, docs, **more):
    con = duck("/root/testdata/sf0.001")
    for name, frame in {"documents": docs, **more}.items():
        table = frame.toArrow()
        con.execute(f"DROP VIEW {name}")
        con.register(name, table)
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert rows(df.columns, df.collect()) == rows(names, got.fetchall())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, small, name):
    same(registry.queries()[name](spark, small), registry.oracle_sql()[name], small)


def test_bpe_is_tiktoken(odd, none):
    import public_tokenizers as P
    import tiktoken

    ranks = bpe.load_ranks(env_path(bpe.DEFAULT_RANKS))
    tool = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = sorted((r["doc_id"] or 0, r["ids"], bytes(r["decoded"])) for r in bpe.encode_documents(odd, decoded=True).collect())
    assert got == sorted((i or 0, tool.encode_ordinary(t or ""), (t or "").encode()) for i, t in texts(odd))
    back = bpe.decode_documents(bpe.encode_documents(odd))
    assert sorted((r["doc_id"] or 0, bytes(r["decoded"])) for r in back.collect()) == sorted((i or 0, (t or "").encode()) for i, t in texts(odd))
    assert bpe.encode_documents(none).count() == 0
    machine, rng = bpe.Transducer(ranks, max_states=500), np.random.default_rng(0)
    keys = list(ranks)
    for k in range(1500):
        piece = b"".join(keys[i] for i in rng.integers(0, len(keys), 3)) if k % 2 else bytes(rng.integers(0, 256, 12).astype(np.uint8))
        assert list(machine.encode(piece)) == tool._encode_single_piece(piece)


def test_utf8_stream():
    rng = np.random.default_rng(8)
    made = ["aé🙂ß".encode() + b"\xff\xe2\x82", b"\xe0\x80a\xed\xa0\x80\xf4\x90\x80\x80\xc0\xaf"]
    made += [b"".join([["é".encode(), "🙂".encode(), b"a", bytes([b])][int(k)] for k, b in zip(rng.integers(0, 4, 30), rng.integers(0, 256, 30))]) for _ in range(300)]
    for data in made:
        for size in (1, 2, 7, 100):
            stream = bpe.Utf8Stream()
            parts = [stream.feed(data[i : i + size]) for i in range(0, len(data), size)]
            text = "".join(parts) + stream.close()
            assert text.encode("utf-8", "surrogateescape") == data and text == data.decode("utf-8", "surrogateescape")
    stream = bpe.Utf8Stream()
    assert [stream.feed(bytes([b])) for b in "é🙂".encode()] == ["", "é", "", "", "", "🙂"]


def test_pretokens_are_the_patterns(spark, small):
    import public_tokenizers as P
    import regex

    split = regex.compile(P.PATTERN).findall
    alphabet = [*" \n\t\r ' \u3000stremvldabcXé1²٣_-!.,\"🙂\u0301\0\x1c\x85\u00a0", "'s", "'ll", "'re", " '", "  "]
    rng = np.random.default_rng(6)
    made = [["".join(alphabet[i] for i in rng.integers(0, len(alphabet), int(rng.integers(0, 40)))) for _ in range(5)] for _ in range(800)]
    made.append([t or "" for _, t in texts(spark.read.parquet(f"{small}/documents.parquet"))])
    made.append([chr(c) + "a" + chr(c) + " " + chr(c) + "1" for c in range(0, 0x110000, 97) if not 0xD800 <= c < 0xE000])
    for group in made:
        joined, _, start, end, n = pretokens.cut(group)
        want = [split(t) for t in group]
        assert n.tolist() == list(map(len, want))
        assert [joined[a:b] for a, b in zip(start.tolist(), end.tolist())] == [w for ws in want for w in ws]
    for book in (pretokens.Book(P.PATTERN, lambda ws: [np.array([len(w)] * 2, np.int32) for w in ws], 50), pretokens.Book(r"\S+|\s+", lambda ws: [np.array([len(w)] * 2, np.int32) for w in ws], 50)):
        for group in made[::100]:
            got = [x for ids, ends, _ in book.of(group) for x in np.split(ids, ends[:-1])]
            assert [x.tolist() for x in got] == [[len(m[0]) for m in book.finditer(t) for _ in range(2)] for t in group]


def test_quality_edges(odd, none):
    labels = odd.select("doc_id", F.lit(1).alias("quality"))
    con_sql = quality.judged_sql() + " SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged"
    docs = odd.select("doc_id", "text", "lang")
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    against_duck(quality.judge(docs, labels).select(*names), con_sql, docs, labels=labels)
    assert quality.quality_rules(odd, labels).columns == odd.columns
    assert quality.judge(none, labels).count() == 0


def test_certified_cutoffs_are_exact(spark):
    from math import comb

    for n, k, p in ((50, 0, 0.1), (400, 3, 0.02), (2000, 12, 0.005)):
        got = spark.range(1).select(quality.binomial_cdf(F.lit(k).cast("long"), F.lit(n).cast("long"), p)).first()[0]
        assert got == pytest.approx(sum(comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1)), rel=1e-9)
    rows_ = [(i, ("#" if i % 2 else "") + " ".join(f"w{i}x{j}" for j in range(30)), "en", i % 2) for i in range(4000)]
    docs = spark.createDataFrame(rows_, "doc_id long, text string, lang string, bad int")
    labels = docs.select("doc_id", (1 - F.col("bad")).alias("quality"))
    kept = quality.quality_rules(docs, labels, alpha=0.05)
    assert kept.where("bad = 0").count() == 2000 and kept.where("bad = 1").count() == 0


def test_judge_against_brute_force(spark):
    """Labels enough for cutoffs in two strata, against exact tails in whole numbers and against the SQL."""
    from fractions import Fraction
    from math import comb

    rng = np.random.default_rng(12)
    rows_ = []
    for i in range(1500):
        good = int(rng.random() < 0.7)
        words = ["w" * int(rng.integers(3, 8)) + str(j) for j in range(int(rng.integers(15, 40)))]
        for k in range(int(rng.choice([0, 0, 0, 1, 2] if good else [0, 1, 4, 9, 12]))):
            words[k % len(words)] += "#" * int(rng.integers(1, 3))
        if not good and rng.random() < 0.3:
            words = ["x" * 12 + w for w in words]
        text = " ".join(words[:10]) + "\n" + " ".join(words[10:])
        rows_.append((i, text, ["en", "de", "xx", None][int(rng.choice(4, p=[0.47, 0.45, 0.05, 0.03]))], good))
    docs = spark.createDataFrame(rows_, "doc_id long, text string, lang string, good int")
    labels = docs.where("doc_id % 10 < 9").select("doc_id", F.col("good").alias("quality"))
    got = {r["doc_id"]: r["kept"] for r in quality.judge(docs, labels).collect()}

    def measured(text):
        ws, ls = re.findall(r"[^\x20\x09-\x0D]+", text), [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        wins = [tuple(ws[i : i + 8]) for i in range(len(ws) - 7)]
        cells = {p for i, w in enumerate(wins) if wins.count(w) > 1 for p in range(i, i + 8)}
        return {"n_words": len(ws), "word_chars": sum(map(len, ws)), "n_symbols": sum(c in quality.SYMBOLS for c in text), "n_dup_lines": len(ls) - len(set(ls)), "n_repeat_words": len(cells), "n_lines": len(ls)}

    every = {i: measured(t) for i, t, _, _ in rows_}
    over = lambda m, cuts: any(1000 * m[{"symbols": "n_symbols", "dup_lines": "n_dup_lines", "long_words": "word_chars", "repeats": "n_repeat_words"}[r]] / (1000 if r == "long_words" else 1) > c / (1000 if r == "long_words" else 1) * m["n_lines" if r == "dup_lines" else "n_words"] for r, c in cuts.items())
    sound = lambda m: not (m["n_words"] < 20 or 100 * m["n_repeat_words"] > 30 * m["n_words"])
    strata = {lang or "" for i, _, lang, g in rows_ if i % 10 < 9 and g}
    alpha, want, chosen = Fraction(2, 100), {}, {}
    for lang in {x[2] or "" for x in rows_}:
        held = [every[i] for i, _, x, g in rows_ if (x or "") == lang and g and i % 10 < 9 and sound(every[i])]
        best = (-1, 0, {})
        for c, chain in enumerate(quality._chains()):
            for at, cuts in enumerate(chain):
                n, k = len(held), sum(over(m, cuts) for m in held)
                if n and sum(comb(n, j) * alpha**j * (1 - alpha) ** (n - j) for j in range(k + 1)) <= Fraction(5, 100) / (len(strata) * 4) and (at, -c) > best[:2]:
                    best = (at, -c, cuts)
        chosen[lang] = best[2]
        want |= {i: sound(every[i]) and not over(every[i], best[2]) for i, _, x, _ in rows_ if (x or "") == lang}
    assert got == want and sum(map(bool, chosen.values())) == 2 and not all(chosen.values())
    assert sum(sound(every[i]) and not want[i] for i in want) > 50
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    own = docs.select("doc_id", "text", "lang")
    against_duck(quality.judge(own, labels).select(*names), quality.judged_sql() + f" SELECT {', '.join(names)} FROM judged", own, labels=labels)


def test_columns_of_the_caller_stay(odd, spark):
    """Columns with the names of the operators' own come out with their values."""
    taken = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_removed", "kept", "base_failed", "stratum", "component", "node", "window", "start", "_k", "_d"]
    docs = odd.select("doc_id", "text", "lang", *[F.lit(777).alias(c) for c in taken])
    labels = odd.select("doc_id", F.lit(1).alias("quality"))
    bench = spark.createDataFrame([(1, "lorem ipsum lorem")], "item_id long, text string")
    for out in (quality.quality_rules(docs, labels), linededup.without_repeats(docs), neardup.drop_near_duplicates(docs), decontam.decontaminate(docs, bench)):
        rows_ = out.collect()
        assert out.columns == docs.columns and rows_ and all(r[c] == 777 for r in rows_ for c in taken)


def test_small_strata_get_joint_cutoffs(spark):
    """300 good documents of 4 strata are enough; 50 are not; a rule that good documents break does not hold back the others."""
    good, long = " ".join(f"w{j}x" for j in range(30)), " ".join(f"longerword{j}" for j in range(30))
    rows_ = []
    for lang, n in (("de", 300), ("es", 300), ("sh", 300), ("tiny", 50)):
        mine, bad = (good.replace("w", "#"), "#" + long) if lang == "sh" else (good, "#" + good)
        rows_ += [(f"{lang}{i}", mine, lang, 1) for i in range(n)] + [(f"{lang}x{i}", bad, lang, 0) for i in range(20)]
    docs = spark.createDataFrame(rows_, "doc_id string, text string, lang string, quality int")
    labels = docs.select("doc_id", "quality")
    kept = quality.quality_rules(docs, labels).groupBy("lang", "quality").count().collect()
    assert {(r["lang"], r["quality"]): r["count"] for r in kept} == {("de", 1): 300, ("es", 1): 300, ("sh", 1): 300, ("tiny", 1): 50, ("tiny", 0): 20}


@pytest.mark.parametrize("block", [200, repair.BLOCK_IDS])
def test_repair_round_trip(odd, none, block):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(env_path(repair.DEFAULT_TOKENIZER))
    tool.encode_special_tokens = True
    blocks = repair.write_shards(odd, shards=3, block_ids=block)
    got = {(r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in repair.summarize(blocks).collect()}
    start, want = 0, set()
    for i, t in sorted(texts(odd), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = [*tool.encode(t or "", add_special_tokens=False).ids, 0]
        want.add((start, i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    whole = {r["doc_id"]: r["ids"] for r in repair.read_shards(blocks).collect()}
    assert whole[10][:-1] == tool.encode("word " * 3000 + "end", add_special_tokens=False).ids
    assert repair.summarize(repair.write_shards(none, shards=2)).count() == 0


def test_repair_query_encodes_as_the_library_loaded(spark, odd, tmp_path):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(env_path(repair.DEFAULT_TOKENIZER))
    more = spark.createDataFrame([(90, "hello <|endoftext|> x"), (91, "<|endoftext|><|endoftext|>  y <|endoftext"), (92, "after")], "doc_id long, text string")
    docs = odd.select("doc_id", "text").unionByName(more)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    start, want = 0, set()
    for i, t in sorted(texts(docs), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = [*tool.encode(t or "", add_special_tokens=False).ids, 0]
        assert i != 90 or ids == [31373, 220, 50256, 2124, 0]
        want.add((start, i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert {(r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in repair.op3_repair_shards(spark, str(tmp_path)).collect()} == want


def test_repair_compresses_and_slices():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 40, 60_000).astype(np.int32)
    ids[10_000:20_000] = np.tile(np.arange(10), 1000)
    sizes = np.array([10_000, 25_000, 1, 24_999])
    g = repair.compress(ids, sizes)
    assert len(g["symbols"]) < 0.6 * len(ids) and (repair.expand(g["symbols"], g["base"], g["rules"], g["lengths"]) == ids).all()
    part = g["symbols"][g["heads"][1] : g["heads"][2]]
    assert (repair.slice_ids(part, g["base"], g["rules"], g["lengths"], 777, 5000) == ids[10_777:15_000]).all()


def test_repair_goes_on_until_no_pair_is_frequent():
    rng = np.random.default_rng(5)
    long = rng.integers(0, 50_000, 3000)
    docs = [long] * 20 + [np.full(5000, 7), np.tile([1, 1, 2], 400), rng.integers(0, 30, 20_000), np.array([3])]
    ids, sizes = np.concatenate(docs).astype(np.int32), np.array([len(d) for d in docs])
    g = repair.compress(ids, sizes)
    assert (repair.expand(g["symbols"], g["base"], g["rules"], g["lengths"]) == ids).all()
    counts, end = defaultdict(int), {}
    heads = [*g["heads"].tolist(), len(g["symbols"])]
    for k in range(len(docs)):
        part = g["symbols"][heads[k] : heads[k + 1]].tolist()
        for i, pair in enumerate(zip(part, part[1:])):
            if end.get(pair) != (k, i):
                counts[pair] += 1
                end[pair] = (k, i + 1)
    assert max(counts.values()) < repair.MIN_COUNT and heads[1] == 1


def test_decontamination_edges(odd, none, spark):
    bench = spark.createDataFrame([(1, "CAT sat on the mat and then the cat sat on"), (2, "short"), (3, None), (4, ""), (4, "lorem ipsum"), (None, "word")], "item_id long, text string")
    docs = odd.select("doc_id", "text")
    sql = registry.oracle_sql()["op4_decontamination"]
    found = decontam.contamination(odd, bench).select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
    against_duck(found, sql, docs, benchmark=bench)
    assert decontam.contamination(none, bench).count() == 0
    assert decontam.contamination(odd, bench.limit(0)).where("n_hit > 0").count() == 0
    index = decontam.positional_index(odd)
    ask = spark.createDataFrame([("q", "cat", "mat", 4)], "query string, first string, second string, slop int")
    near = decontam.proximity_matches(index, ask).where("doc_id = 1").collect()
    assert {(r["first_pos"], r["second_pos"]) for r in near} == {(1, 5), (9, 5), (9, 13)}


def test_line_dedup_edges(odd, none):
    docs = odd.select("doc_id", "text")
    against_duck(linededup.dedup_lines(docs), registry.oracle_sql()["op5_line_dedup"], docs)
    out = linededup.dedup_lines(odd)
    assert [c for c in out.columns if c not in ("n_lines", "n_removed")] == odd.columns
    assert linededup.dedup_lines(none).count() == 0


def base_pii(x):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x) if 12 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 9 <= len(digits(m)) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_pii(odd, none, spark, small):
    for docs in (odd, spark.read.parquet(f"{small}/documents.parquet")):
        found = defaultdict(list)
        for r in pii.find_pii(docs).collect():
            found[r["doc_id"]].append(r["pii"])
        for i, t in texts(docs):
            want = base_pii(t or "")
            assert [[(s["kind"], s["start"], s["end"]) for s in got if s["rule"]] for got in found[i]] == [want] * len(found[i])
    assert pii.find_pii(none).count() == 0
    long = "a" * 200_000 + "@"
    assert pii.base_spans(long) == []


def test_tagger_adds_what_the_rules_miss():
    """On rows of another generator than the training rows, and on written texts."""
    model, cutoffs = pii.train()
    rows_, spans = pii.labelled_rows(500, seed=99, style=1)
    right, wrong, found, missed = (defaultdict(int) for _ in range(4))
    touch = lambda x, y: x[0] == y[0] and x[1] < y[2] and y[1] < x[2]
    for true, (base, both) in zip(spans, pii.all_spans(rows_, model, cutoffs)):
        added = [x for x in both if x not in base]
        for x in added:
            (right if any(touch(x, y) for y in true) else wrong)[x[0]] += 1
        for y in true:
            if y[2] < pii.WIDTH and not any(y[1] < b and a < y[2] for _, a, b in base):
                (found if any(touch(x, y) for x in added) else missed)[y[0]] += 1
    for kind in pii.KINDS:
        assert right[kind] >= 0.85 * (right[kind] + wrong[kind]) and found[kind] >= 0.6 * (found[kind] + missed[kind]) > 20
    for text, kind, want in (("please mail mary.jones (at) example (dot) com today", "email", "mary.jones (at) example (dot) com"), ("call 555 123 4567 before noon", "phone", "555 123 4567"), ("server 192[.]168[.]10[.]44 went down", "ip", "192[.]168[.]10[.]44")):
        ((base, both),) = pii.all_spans([text], model, cutoffs)
        assert base == [] and any(touch(x, (kind, text.index(want), text.index(want) + len(want))) for x in both)
    assert all(base == both for base, both in pii.all_spans(["version 3.2.1 of 2024-10-11 at 12:30", "no digits here at all", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" is old'], model, cutoffs))


def test_scaled_marginals():
    model = tagger.Tagger(9)
    model.w["T"] = np.random.default_rng(1).standard_normal((9, 9))
    scores, _ = model.emissions(np.random.default_rng(2).integers(32, 127, (4, 64)))
    assert np.allclose(model._likely(scores), model.marginals(scores)[1], atol=1e-6)


def test_tagger_gradients():
    model, rng = tagger.Tagger(5, 3, 4), np.random.default_rng(0)
    x, y = rng.permutation(130)[:12].reshape(2, 6), rng.integers(0, 5, (2, 6))
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    _, g = model.gradients(x, y)
    for k, w in model.w.items():
        at = (x[0, 0], 1) if k == "E" else tuple(0 for _ in w.shape)
        keep, diff = w[at], []
        for e in (1e-3, -1e-3):
            w[at] = keep + e
            diff.append(model.gradients(x, y)[0])
        w[at] = keep
        assert (diff[0] - diff[1]) / 2e-3 == pytest.approx(g[k][at], abs=2e-3)


def base_secrets(x):
    out = [("assign", *m.span()) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", x) if len(m[2]) >= 8]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", x) if len(m[0]) >= 16]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", x) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def test_secrets(odd, none, spark, small):
    for docs in (odd, spark.read.parquet(f"{small}/documents.parquet")):
        for i, t in texts(docs):
            assert secrets.scan(t) == base_secrets(t or "")
    assert secrets.find_secrets(none).count() == 0 and secrets.find_secrets(odd).count() == odd.count()
    body = "a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5"
    good = f"ghp_{body}{secrets.checksum(body)}"
    assert secrets.scan(f"key {good} end") == [("checked", 4, 4 + len(good))]
    assert secrets.scan(f"key ghp_{body}AAAAAA end") == []


def test_token_counts(odd, none):
    import public_tokenizers as P
    import regex

    scores = tokens.unigram_scores(env_path(tokens.DEFAULT_RANKS))
    trie = tokens.SharedTrie(scores, max_nodes=300)

    def best(w):
        at = [(0.0, 0)]
        for e in range(1, len(w) + 1):
            at.append(max(((at[i][0] + scores[w[i:e]], -at[i][1] - 1) for i in range(max(0, e - trie.longest), e) if w[i:e] in scores)))
            at[-1] = (at[-1][0], -at[-1][1])
        return at[-1][1]

    for r in tokens.token_counts(odd.where("doc_id is not null and length(text) < 4000")).collect():
        text = next(t for i, t in texts(odd) if i == r["doc_id"])
        words = regex.findall(P.PATTERN, text or "")
        assert r["n_pretokens"] == len(words)
        assert r["n_tokens"] == sum(best(w.encode()) for w in words) == sum(trie.count(w.encode()) for w in words)
    assert tokens.token_counts(none).count() == 0 and tokens.token_counts(odd).count() == odd.count()


def brute_components(docs, size, percent):
    sets = []
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((i, frozenset([tuple(w)]) if 0 < len(w) < size else frozenset(zip(*(w[k:] for k in range(size))))))
    label = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y) and label[a] != label[b]:
                label = [label[b] if v == label[a] else v for v in label]
    low = {v: min((sets[k][0] for k in range(len(sets)) if label[k] == v and sets[k][0] is not None), default=-1) for v in label}
    return sorted(((-1 if i is None else i), len(s), low[label[k]]) for k, (i, s) in enumerate(sets))


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, odd, none, small, size, percent):
    for docs in (odd, spark.read.parquet(f"{small}/documents.parquet")):
        got = neardup.near_duplicates(docs, size, percent).collect()
        found = sorted(((-1 if r["doc_id"] is None else r["doc_id"]), r["n_shingles"], -1 if r["component_id"] is None else r["component_id"]) for r in got)
        assert found == brute_components(texts(docs), size, percent)
    assert neardup.near_duplicates(none).count() == 0


def test_one_document_of_each_component_stays(spark):
    """Repeated rows, equal ids with different near-duplicate texts, null ids, texts without words."""
    text = lambda p, more="": " ".join(f"{p}{i}" for i in range(100)) + more
    rows_ = [(1, text("a")), (1, text("a")), (1, text("a", " end")), (2, text("a")), (3, text("b")), (3, text("b")), (3, text("c"))]
    rows_ += [(None, text("d")), (None, text("d")), (None, text("d", " end")), (None, text("e")), (9, text("e", " end")), (4, ""), (4, None), (5, " ")]
    docs = spark.createDataFrame(rows_, "doc_id long, text string")
    key = {r["text"]: r["k"] for r in docs.select("text", F.xxhash64("text").alias("k")).collect()}
    least = lambda p: min(text(p), text(p, " end"), key=key.get)
    got = sorted(((r["doc_id"], r["text"] or "") for r in neardup.drop_near_duplicates(docs).collect()), key=repr)
    assert got == sorted([(1, least("a")), (3, text("b")), (3, text("c")), (None, least("d")), (9, text("e", " end")), (4, ""), (5, " ")], key=repr)


def test_null_ids_are_linked(spark):
    text = lambda p, more="": " ".join(f"{p}{i}" for i in range(60)) + more
    rows_ = [(None, text("a")), (7, text("a")), (5, text("a", " x")), (None, text("b")), (None, text("b", " x")), (None, text("c")), (3, text("c")), (8, text("d")), (None, None)]
    docs = spark.createDataFrame(rows_, "doc_id long, text string").withColumn("component", F.lit(1)).withColumn("node", F.lit("x"))
    got = neardup.near_duplicates(docs, 3, 85).collect()
    found = sorted(((-1 if r["doc_id"] is None else r["doc_id"]), r["n_shingles"], -1 if r["component_id"] is None else r["component_id"]) for r in got)
    assert found == brute_components(rows_, 3, 85)


def test_size_classes_hold_all_links(spark):
    for percent in (80, 85, 100):
        size, steps = neardup._size_class(F.col("n"), percent)
        of = {r["n"]: r["c"] for r in spark.range(1, 1501).select(F.col("id").alias("n"), size.alias("c")).collect()}
        ends = {n: n * 100 // percent for n in of}
        assert all(of[m] - of[n] in steps for n, m in ends.items() if m in of)


@pytest.mark.parametrize("crowd", [2048, 2])
def test_chains_and_crowds(spark, monkeypatch, crowd):
    """Links that no least node sees, and a crowd of near copies of one text, in one task and dealt to many."""
    monkeypatch.setattr(neardup, "CROWD", crowd)
    base = [f"w{i}" for i in range(120)]
    rng, docs = np.random.default_rng(4), []
    for k in range(60):
        words = list(base)
        for at in rng.integers(0, 120, 2 + k % 5):
            words[at] = f"x{k}y{at}"
        docs.append((k, " ".join(words)))
    for k in range(20):
        docs.append((100 + k, " ".join([f"c{j}" for j in range(2 * k, 2 * k + 100)])))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = neardup.near_duplicates(frame, 3, 85).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(docs, 3, 85)


def test_suffix_dedup(spark, odd, none, small, monkeypatch):
    rng = np.random.default_rng(2)
    letters = np.array(list("abcdefgh é"))
    passage = "".join(rng.choice(letters, 260))
    rows_ = [(i, "".join(rng.choice(letters, int(rng.integers(0, 400)))) + passage[int(rng.integers(0, 30)) : int(rng.integers(225, 260))] + "".join(rng.choice(letters, 50))) for i in range(25)]
    rows_ += [(50, "ab" * 400), (51, passage), (52, passage), (53, None), (None, "z" * 199), (54, "z" * 200), (55, "z" * 201)]
    made = spark.createDataFrame(rows_, "doc_id long, text string")
    for docs in (made, odd, spark.read.parquet(f"{small}/documents.parquet")):
        pairs = texts(docs)
        want = sorted((i or -1, *x) for (i, _), x in zip(pairs, suffixdedup.brute_force([t for _, t in pairs])))
        got = suffixdedup.cut_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
        assert sorted((r[0] or -1, *r[1:]) for r in got) == want
    assert suffixdedup.cut_repeats(none).count() == 0
    monkeypatch.setattr(suffixdedup, "MAX_GROUP", 3)
    monkeypatch.setattr(suffixdedup, "BROADCAST_ROWS", 0)
    pairs = texts(made)
    want = sorted((i or -1, *x) for (i, _), x in zip(pairs, suffixdedup.brute_force([t for _, t in pairs])))
    got = suffixdedup.cut_repeats(made).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert sorted((r[0] or -1, *r[1:]) for r in got) == want


def test_index_family_is_logarithmic(spark):
    family, rng, seen = suffixdedup.IndexFamily(), np.random.default_rng(3), set()
    for _ in range(8):
        keys = rng.integers(0, 3000, 200).tolist()
        batch = spark.createDataFrame([(k % 7, k, 1) for k in keys], "head long, key long, n long")
        got = {r["key"] for r in family.add(batch).collect()}
        assert got == {k for k in keys if k in seen or keys.count(k) > 1}
        seen |= set(keys)
    assert len(family.levels) <= 4
    rows_ = [r for level, _ in family.levels for r in level.collect()]
    assert sum(r["n"] for r in rows_) == 1600 and {r["key"] for r in rows_} == seen


def test_family_decides_and_batches_agree(spark, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    found = suffixdedup.anchors(docs).cache()
    whole = {r["key"] for r in suffixdedup.matched(found, 1).collect()}
    counts = {r["key"] for r in found.groupBy("key").count().where("count > 1").collect()}
    assert whole == counts == {r["key"] for r in suffixdedup.matched(found, 3).collect()}
    # a batch that comes later is matched against the levels
    family = suffixdedup.IndexFamily()
    first = {r["key"] for r in suffixdedup.matched(found.where("pmod(text_key, 2) = 0"), 2, family).collect()}
    assert first | {r["key"] for r in suffixdedup.matched(found.where("pmod(text_key, 2) = 1"), 1, family).collect()} == whole
    found.unpersist()
    assert suffixdedup.cut_repeats(docs).agg(F.sum("n_removed")).first()[0] > 0
    monkeypatch.setattr(suffixdedup.IndexFamily, "add", lambda self, rows_: rows_.select("key").limit(0))
    assert suffixdedup.cut_repeats(docs).agg(F.sum("n_removed")).first()[0] == 0


def test_segments_leave_blocks_whole(monkeypatch):
    rng = np.random.default_rng(9)
    texts_ = [rng.integers(97, 101, int(n)).astype(np.uint8) for n in (5, 3000, 199, 200, 0, 201, 7000, 50)] + [np.full(2000, 97, np.uint8)]
    data, ends = np.concatenate(texts_), np.cumsum([len(t) for t in texts_])
    rows_ = lambda: list(zip(*(np.concatenate(x).tolist() for x in zip(*suffixdedup.blocks_of(data, ends)))))
    whole = rows_()
    monkeypatch.setattr(suffixdedup, "SEGMENT", 900)
    assert rows_() == whole
    assert sum(span + 1 for *_, span in whole) == sum(max(0, len(t) - 199) for t in texts_)


def test_long_pretokens_and_set_bounds():
    scores = tokens.unigram_scores(env_path(tokens.DEFAULT_RANKS))
    trie = tokens.SharedTrie(scores)
    word = b"abcdefgh" * 200
    at = [(0.0, 0)]
    for e in range(1, len(word) + 1):
        fits = [(at[i][0] + scores[word[i:e]], -at[i][1] - 1) for i in range(max(0, e - trie.longest), e) if word[i:e] in scores]
        at.append((max(fits)[0], -max(fits)[1]))
    assert trie.count(word) == trie.count(word) == at[-1][1]
    assert trie.count(word[:100]) == at[100][1] and trie.count(word[:700]) == at[700][1]

    x = neardup.shingle_set(" ".join(f"w{i}" for i in range(300)), 3)
    y = neardup.shingle_set(" ".join(f"w{i}" for i in range(0, 300) if i % 40), 3)
    apart = len(set(x.tolist()) ^ set(y.tolist()))
    cells = neardup.odd_cells(x) ^ neardup.odd_cells(y)
    assert 0 < sum(bin(int(c) & (2**64 - 1)).count("1") for c in cells) <= apart
