"""Removal of long repeated byte strings by a logarithmic family of sparse suffix arrays.

A string of 200 bytes that occurs twice holds, at the same place in both, the
least 56-byte string (by hash, the leftmost of equal ones) of its 145.  So it is
enough to keep the suffixes that begin at such anchors, one in about 73 bytes.

* A suffix array holds the distinct anchors of a batch of documents, sorted by
  their first 8 bytes and, where these are equal, by the hash of all 56, with their
  numbers.  Equal anchors are neighbours and nothing else of the order is needed.
* ``IndexFamily`` is a list of such arrays, its levels, as sorted tables in the
  shared folder.  A new batch gets its array, is merge-scanned (a sort-merge join)
  against the levels, and the anchors that the scan meets, or that the batch holds
  twice, come out as its matches.  Before the next batch levels of equal size are
  merged, so that n batches leave log n levels and each anchor is written log n
  times.  A table is added in ``BATCHES`` batches by the hash of the text.
* Only matched anchors go on.  A block is the union of the 200-byte windows that
  have one anchor.  If a whole block occurs again, all its windows are repeated.
  What is left are the edges of repeated passages: blocks that occur once while
  their anchor occurs elsewhere.  Only for anchors with such a block, the windows
  of its distinct blocks are compared: in one task for MAX_GROUP blocks at most,
  else as rows that are counted by hash.
* All windows of a block hold its anchor, so their union is one interval; the
  intervals of a document are merged and cut.

Every count is a partial sum before the shuffle and every join is of one row
against many, so a passage in a third of all documents loads no single task.
Texts are hashed in segments of SEGMENT bytes, whatever their length.

Defined results: a null or empty text keeps nothing and loses nothing; texts below
200 bytes stay; a repeated row is an occurrence of its own, so both rows lose their
text; further columns are not read.  Windows are compared by 128 bits of hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hinted, keyed, small_enough, stored, table
from .hashing import mix, powers, prefix_sums, ranges
from .pretokens import slices

LENGTH, CORE = 200, 56
#: Batches in which a table is added to the family.
BATCHES = 4
#: Bytes that are hashed at a time.
SEGMENT = 1 << 18
#: Distinct blocks of a key that one task compares (some 300 bytes each); larger groups are spread.
MAX_GROUP = 4096
#: Rows up to which a set of documents or of anchors (two numbers each) is broadcast, after a count.
BROADCAST_ROWS = 500_000
LOW = np.uint64(0xFFFFFFFF)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n, size, cur = len(x) - width + 1, 1, x
    while size * 2 <= width:
        cur = np.minimum(cur[:-size], cur[size:])
        size *= 2
    return np.minimum(cur[:n], cur[width - size : width - size + n])


def _blocks(data: np.ndarray, ends: np.ndarray, length: int, core: int) -> tuple[np.ndarray, ...]:
    """``head, key, block, first, span`` of each anchor of the texts that end at ``ends``: the windows that start at first .. first + span have it."""
    sums, (_, inverse) = prefix_sums(data), powers(len(data) + 1)
    h = mix((sums[core:] - sums[:-core]) * inverse[: len(data) - core + 1] + np.uint64(core))
    order = (h & ~LOW) | np.arange(len(h), dtype=np.uint64)
    anchor = _sliding_min(order, length - core + 1)
    whole = np.ones(len(anchor), bool)
    for end in ends[ends < len(data)].tolist():  # windows across two texts are none
        whole[max(0, end - length + 1) : end] = False
    starts = np.flatnonzero(whole)
    anchor = (anchor[starts] & LOW).astype(np.int64)
    if not len(starts):
        none = np.zeros(0, np.uint64)
        return none.view(np.int64), none, none, none.view(np.int64), none.view(np.int64)
    fresh = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    first, final = starts[fresh], starts[np.r_[fresh[1:] - 1, len(starts) - 1]]
    pos = anchor[fresh]
    block = ranges(sums, first, final + length) ^ (pos - first).astype(np.uint64)
    head = data[pos[:, None] + np.arange(8)].copy().view(">u8")[:, 0].astype(np.uint64)
    return (head ^ np.uint64(1 << 63)).view(np.int64), h[pos], block, first, final - first


def blocks_of(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, core: int = CORE) -> Iterator[tuple[np.ndarray, ...]]:
    """``_blocks`` of texts end to end, by segments; the last block of a segment begins the next one, so it is never cut."""
    at = 0
    while len(data) - at >= length:
        stop = min(len(data), at + max(SEGMENT, 4 * length))
        found = _blocks(data[at:stop], ends - at, length, core) if at == 0 else _blocks(data[at:stop], ends[np.searchsorted(ends, at, "right") :] - at, length, core)
        if stop == len(data):
            more = stop
        elif len(found[0]):
            more = at + int(found[3][-1])
            if more > at:
                found = tuple(x[:-1] for x in found)
            else:
                more = stop - length + 1
        else:
            more = stop - length + 1
        yield (*found[:3], found[3] + at, found[4])
        at = more


class IndexFamily:
    """Levels of suffix arrays ``head, key, n`` with their sizes, the largest first."""

    def __init__(self):
        self.levels: list[tuple[DataFrame, int]] = []

    @staticmethod
    def _array(suffixes: DataFrame) -> tuple[DataFrame, int]:
        """Distinct suffixes in order, written and counted."""
        out = suffixes.groupBy("head", "key").agg(F.sum("n").alias("n")).sortWithinPartitions("head", "key")
        out = stored(out, "level")
        return out, out.count()

    def _merge(self) -> None:
        """Levels of about equal size become one; so the next level is at least half as large again."""
        while len(self.levels) > 1 and 2 * self.levels[-2][1] < 3 * self.levels[-1][1]:
            (a, _), (b, _) = self.levels.pop(), self.levels.pop()
            self.levels.append(self._array(a.unionByName(b)))

    def add(self, suffixes: DataFrame) -> DataFrame:
        """Add a batch (``head, key, n``); returns its matches, the ``key`` of what it holds twice or a level holds too."""
        self._merge()
        new, size = self._array(suffixes)
        found = new.where("n > 1").select("key")
        if self.levels:
            old = reduce(DataFrame.unionByName, [level.select("head", "key") for level, _ in self.levels])
            found = found.unionByName(new.select("head", "key").join(old, ["head", "key"], "left_semi").select("key"))
        self.levels.append((new, size))
        self.levels.sort(key=lambda x: -x[1])
        return stored(found.distinct(), "matches")


def anchors(docs: DataFrame, length: int = LENGTH, core: int = CORE) -> DataFrame:
    """``doc_id, text_key, head, key, block, first, span`` of every anchor of every text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "text_key", "head", "key", "block", "first", "span"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                texts = part.column(2).cast(pa.large_binary())
                edges = np.frombuffer(texts.buffers()[1], np.int64, part.num_rows + 1, texts.offset * 8)
                data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
                edges = edges - edges[0]
                for head, key, block, first, span in blocks_of(data, edges[1:], length, core):
                    which = np.searchsorted(edges, first, "right") - 1
                    rows = pa.array(which)
                    cols = [head, key.view(np.int64), block.view(np.int64), (first - edges[which]).astype(np.int32), span.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), *map(pa.array, cols)], names)

    schema = f"doc_id {kind}, text_key long, head long, key long, block long, first int, span int"
    return keyed(docs).select("doc_id", "text_key", "text").mapInArrow(run, schema)


def matched(found: DataFrame, batches: int = BATCHES, family: IndexFamily | None = None) -> DataFrame:
    """``key`` of the anchors that occur more than once, as the family's scans of the batches of ``found`` meet them."""
    family = family or IndexFamily()
    each = found.select("head", "key", F.lit(1).cast("long").alias("n"), F.pmod("text_key", F.lit(batches)).alias("batch"))
    met = [family.add(each.where(F.col("batch") == k).drop("batch")) for k in range(batches)]
    return reduce(DataFrame.unionByName, met).distinct()


def _of_docs(rows: DataFrame, keys: DataFrame, how: str = "left_semi") -> DataFrame:
    """``rows`` whose document is in ``keys`` (``left_anti``: is not)."""
    on = (rows["text_key"] == keys["text_key"]) & rows["doc_id"].eqNullSafe(keys["doc_id"])
    return rows.join(F.broadcast(keys), on, how)


def _pieces(asked: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """``key, block, n, piece``: the bytes of each block in ``asked``, read from its text."""
    kind = pa.list_(pa.struct([("key", pa.int64()), ("block", pa.int64()), ("first", pa.int32()), ("span", pa.int32()), ("n", pa.int64())]))
    lists = asked.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("key", "block", "first", "span", "n")).alias("asked"))
    rows = keyed(docs).select("doc_id", "text_key", "text")
    holders = asked.select("doc_id", "text_key").distinct()
    if small_enough(holders, BROADCAST_ROWS):
        rows = _of_docs(rows, holders)  # other texts need not be shuffled
    on = (rows["text_key"] == lists["text_key"]) & rows["doc_id"].eqNullSafe(lists["doc_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for batch in batches for part in slices(batch, 0)):
            for text, places in zip(batch.column(0), batch.column(1).cast(kind), strict=True):
                data = text.as_py().encode()
                key, block, first, span, n = places.values.flatten()
                cut = [data[i : i + k + length] for i, k in zip(first.to_pylist(), span.to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([key, block, n, pa.array(cut, pa.binary())], ["key", "block", "n", "piece"])

    return rows.join(lists, on).select("text", "asked").mapInArrow(run, "key long, block long, n long, piece binary")


def _windows(pieces: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows of some pieces: number of the piece, offset in it, hash."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.array([len(p) for p in pieces], np.int64)
    many = sizes - (length - 1)
    which = np.repeat(np.arange(len(pieces)), many)
    off = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    at = off + np.repeat(np.cumsum(sizes) - sizes, many)
    return which, off, ranges(prefix_sums(data), at, at + length)


def _group_hits(pieces: DataFrame, length: int) -> DataFrame:
    """Groups of MAX_GROUP blocks at most, each whole in one task: ``key, block, low, high``."""

    def solve(key: np.ndarray, block: np.ndarray, n: np.ndarray, pieces: list[bytes]) -> pa.RecordBatch:
        which, off, h = _windows(pieces, length)
        order = np.lexsort((h, key[which]))
        k, x = key[which][order], h[order]
        new = np.r_[True, (k[1:] != k[:-1]) | (x[1:] != x[:-1])]
        group = np.cumsum(new) - 1
        again = (np.bincount(group, np.minimum(n, 2)[which][order]) > 1)[group]
        hit = order[again & (n[which][order] == 1)]
        low, high = np.full(len(key), 1 << 30), np.full(len(key), -1)
        np.minimum.at(low, which[hit], off[hit])
        np.maximum.at(high, which[hit], off[hit])
        got = high >= 0
        cols = [pa.array(key[got]), pa.array(block[got]), pa.array(low[got].astype(np.int32)), pa.array(high[got].astype(np.int32))]
        return pa.RecordBatch.from_arrays(cols, ["key", "block", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = [np.zeros(0, np.int64)] * 3 + [[]]
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                held = [np.concatenate([x, part.column(i).to_numpy(zero_copy_only=False)]) for i, x in enumerate(held[:3])] + [held[3] + part.column(3).to_pylist()]
                done = int(np.searchsorted(held[0], held[0][-1]))  # the last key may go on
                if done:
                    yield solve(*(x[:done] for x in held))
                    held = [x[done:] for x in held]
        if len(held[0]):
            yield solve(*held)

    return pieces.repartition("key").sortWithinPartitions("key").mapInArrow(run, "key long, block long, low int, high int")


def _crowd_hits(pieces: DataFrame, length: int) -> DataFrame:
    """The same for groups of any size: each window is a row, counted by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                which, off, h = _windows(part.column(3).to_pylist(), length)
                key, block, n = (part.column(i).to_numpy(zero_copy_only=False)[which] for i in range(3))
                cols = [key, block, off.astype(np.int32), h.view(np.int64), np.minimum(n, 2)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "block", "off", "h", "n"])

    each = stored(pieces.mapInArrow(run, "key long, block long, off int, h long, n long"), "windows")
    again = each.groupBy("key", "h").agg(F.sum("n").alias("total")).where("total > 1").select("key", "h")
    hits = each.where("n = 1").join(again, ["key", "h"])
    return hits.groupBy("key", "block").agg(F.min("off").alias("low"), F.max("off").alias("high"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, core: int = CORE) -> DataFrame:
    """``doc_id, text_key, spans``: sorted ``(start, end)`` byte intervals, which may overlap."""
    found = stored(anchors(docs, length, core), "anchors")
    keys = hinted(stored(matched(found), "keys"), BROADCAST_ROWS)
    shared = stored(found.drop("head").join(keys, "key"), "shared")

    place = F.struct("doc_id", "text_key", "first", "span")
    blocks = stored(shared.groupBy("key", "block").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("at")), "blocks")
    edges = blocks.groupBy("key").agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("k")).where("least = 1 and k > 1")
    asked = stored(blocks.join(edges.select("key", "k"), "key").select("key", "block", "n", "k", "at.*"), "asked")
    hits = _group_hits(_pieces(asked.where(F.col("k") <= MAX_GROUP), docs, length), length)
    crowds = asked.where(F.col("k") > MAX_GROUP)
    if not crowds.isEmpty():
        hits = hits.unionByName(_crowd_hits(_pieces(crowds, docs, length), length))
    whole = blocks.where("n > 1").select("key", "block", F.lit(0).alias("low"), F.lit(None).cast("int").alias("high"))
    cover = stored(hits.select("key", "block", "low", "high").unionByName(whole), "cover")
    spans = shared.join(cover, ["key", "block"]).select(
        "doc_id", "text_key", (F.col("first") + F.col("low")).alias("start"), (F.col("first") + F.coalesce("high", "span") + length).alias("end")
    )
    return spans.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))


def cut_repeats(docs: DataFrame, length: int = LENGTH, core: int = CORE) -> DataFrame:
    """``doc_id, text_key, n_bytes, n_removed, n_spans, kept binary`` for every row of ``docs``."""
    marks = stored(repeated_spans(docs, length, core), "spans")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = keyed(docs)
    names = marks.select("doc_id", "text_key")
    on = (rows["text_key"] == marks["text_key"]) & rows["doc_id"].eqNullSafe(marks["doc_id"])
    pick = [rows["doc_id"], rows["text_key"], rows["text"], "spans"]
    if small_enough(names, BROADCAST_ROWS):
        # only the texts that will be cut are shuffled
        cut = _of_docs(rows, names).join(marks, on).select(*pick)
        rest = _of_docs(rows, names, "left_anti").withColumn("spans", F.lit(None).cast(marks.schema["spans"].dataType))
        joined = cut.unionByName(rest.select(*cut.columns))
    else:
        joined = rows.join(marks, on, "left").select(*pick)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for batch in batches for part in slices(batch, 2)):
            out = []
            for text, spans in zip(batch.column(2), batch.column(3), strict=True):
                data = text.as_py().encode()
                if not spans.is_valid:
                    out.append((len(data), 0, 0, data))
                    continue
                start, end = (x.to_numpy(zero_copy_only=False) for x in spans.values.flatten())
                reach = np.maximum.accumulate(end)
                new = np.r_[True, start[1:] > reach[:-1]]
                begins, ends = start[new], np.r_[reach[:-1][new[1:]], reach[-1]]
                edges = [0, *np.stack([begins, ends], 1).ravel().tolist(), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((len(data), int((ends - begins).sum()), len(begins), kept))
            cols = list(zip(*out, strict=True)) if out else [(), (), (), ()]
            arrays = [*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], ["doc_id", "text_key", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(run, f"doc_id {kind}, text_key long, n_bytes long, n_removed long, n_spans long, kept binary")


def op10_suffix_dedup(spark, sf_dir) -> DataFrame:
    out = cut_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[str | None], length: int = LENGTH) -> list[tuple[int, int, int, str]]:
    """The contract taken literally, for tests."""
    data = [(t or "").encode() for t in texts]
    counts: dict[bytes, int] = {}
    for d in data:
        for i in range(len(d) - length + 1):
            counts[d[i : i + length]] = counts.get(d[i : i + length], 0) + 1
    out = []
    for d in data:
        cut = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if counts[d[i : i + length]] > 1:
                cut[i : i + length] = b"\1" * length
        kept = bytes(b for b, c in zip(d, cut, strict=True) if not c)
        spans = sum(1 for i, c in enumerate(cut) if c and (i == 0 or not cut[i - 1]))
        out.append((len(d), sum(cut), spans, hashlib.sha256(kept).hexdigest()))
    return out


QUERIES = {"op10_suffix_dedup": op10_suffix_dedup}
SQL: dict[str, str] = {}
