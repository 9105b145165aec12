"""The registered queries over the whole small table, against the libraries or brute force."""

import hashlib
import zlib

import numpy as np
import pytest
from test_operators import base_pii, base_secrets, texts

from caseloom.llm import bpe, pii, registry, repair, secrets, suffixdedup
from caseloom.llm.common import env_path


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def line(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


@pytest.fixture(scope="module")
def docs(spark, small):
    return texts(spark.read.parquet(f"{small}/documents.parquet"))


def rows(spark, small, name, *columns):
    return sorted(tuple(r) for r in registry.queries()[name](spark, small).select(*columns).collect())


def test_op1(spark, small, docs):
    import public_tokenizers as P
    import tiktoken

    tool = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(env_path(bpe.DEFAULT_RANKS)), special_tokens={})
    want = [(i, len(ids), sha(",".join(map(str, ids))), sha(t or "")) for i, t in docs for ids in [tool.encode_ordinary(t or "")]]
    assert rows(spark, small, "op1_byte_bpe", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want)


def test_op3(spark, small, docs):
    from tokenizers import Tokenizer

    tool, start, want = Tokenizer.from_file(env_path(repair.DEFAULT_TOKENIZER)), 0, []
    for i, t in sorted(docs):
        ids = [*tool.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert rows(spark, small, "op3_repair_shards", "doc_id", "start", "n_tokens", "ids_crc32") == want


def test_op6(spark, small, docs):
    got = rows(spark, small, "op6_pii", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
    want = sorted((i, base_pii(t or "")) for i, t in docs)
    assert [r[:6] for r in got] == [(i, *(sum(k == kind for k, _, _ in base) for kind in pii.KINDS), sha(line(base))) for i, base in want]
    for r, (_, base) in zip(got, want):
        spans = r[6].split(",") if r[6] else []
        assert set(line([x]) for x in base) <= set(spans) and spans == sorted(spans, key=lambda x: (int(x.split(":")[1]), pii.KINDS.index(x.split(":")[0])))


def test_op7(spark, small, docs):
    got = rows(spark, small, "op7_secrets", "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
    want = []
    for i, t in docs:
        base = base_secrets(t or "")
        want.append((i, *(sum(k == kind for k, _, _ in base) for kind in secrets.KINDS[:3]), sha(line(base)), line(secrets.scan(t))))
    assert got == sorted(want)


def test_op10(spark, small, docs):
    got = rows(spark, small, "op10_suffix_dedup", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted((i, *x) for (i, _), x in zip(docs, suffixdedup.brute_force([t for _, t in docs])))
