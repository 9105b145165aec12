"""Secret scan: keyword automaton, anchored expressions near its hits, checksums.

An Aho-Corasick automaton over the ASCII-lowered text finds every keyword.  Only
there is the rule's expression matched, anchored at the hit; hits are taken from
left to right and those inside an earlier match of the same kind are passed
over, which is what a leftmost non-overlapping search finds, since every match
begins with a keyword.  Runs of hexadecimal digits have no keyword, so one pass
of their own finds them.  Access tokens that embed a checksum (the last six
base-62 digits are the CRC-32 of the body) are added only if it holds.

Defined results: a null or empty text has no secrets; repeated rows are scanned
alike; further columns are not read.  Positions are code points, end exclusive.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: Fixed values.
KINDS = ("assign", "access", "hex", "checked")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ACCESS_WORDS = ("akia",)
CHECKED_WORDS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
DIGITS62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

_ANY_CASE = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token"))
_KEY = "[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
RULES = {
    "assign": re.compile(rf"""({_ANY_CASE}|{_KEY})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "checked": re.compile(r"(?:gh[pousr]|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])"),
}
HEX = re.compile(r"[0-9a-f]{32,}")


def checksum(body: str) -> str:
    """CRC-32 of ``body`` as six base-62 digits."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = DIGITS62[d] + out
    return out


def _valid(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return len(m[2]) >= 8
    if kind == "access":
        return len(m[0]) >= 16
    return checksum(m[1]) == m[2]


_automaton = None


def automaton():
    global _automaton
    if _automaton is None:
        import ahocorasick

        _automaton = ahocorasick.Automaton()
        for kind, words in (("assign", ASSIGN_WORDS), ("access", ACCESS_WORDS), ("checked", CHECKED_WORDS)):
            for w in words:
                _automaton.add_word(w, (kind, len(w)))
        _automaton.make_automaton()
    return _automaton


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` by start, then kind as listed in KINDS."""
    if not text:
        return []
    # bytes.lower() changes ASCII letters only, so positions stay
    hits = sorted((end - n + 1, kind) for end, (kind, n) in automaton().iter(text.encode().lower().decode()))
    found, free = [], dict.fromkeys(RULES, 0)
    for start, kind in hits:
        if start >= free[kind] and (m := RULES[kind].match(text, start)):
            free[kind] = m.end()
            if _valid(kind, m):
                found.append((kind, start, m.end()))
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def find_secrets(docs: DataFrame) -> DataFrame:
    """``doc_id, secrets array<struct<kind, start, end>>``; one pass, no shuffle."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in scan(t.as_py())] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["doc_id", "secrets"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, secrets array<struct<kind:string,start:int,end:int>>")


def op7_secrets(spark, sf_dir) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    base = lambda x: x["kind"] != "checked"
    line = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("secrets", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *map(count, KINDS[:3]),
        F.sha2(line(F.filter("secrets", base)).cast("binary"), 256).alias("base_sha256"),
        line(F.col("secrets")).alias("spans"),
    )


QUERIES = {"op7_secrets": op7_secrets}
SQL: dict[str, str] = {}
