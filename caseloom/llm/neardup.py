"""Near-duplicate documents: banded MinHash, Bayesian pruning, exact links.

1. A document becomes its set of word shingles (64-bit hashes), a signature of
   120 minima and its band keys, each of 8 minima: 48 at 0.85, 72 at 0.8.  So many
   rows keep texts that only share a common passage out of each other's buckets.  Documents of equal sets are one node.
2. Nodes that share a band key are candidates.  In the first round a node is
   compared with the least node of each of its buckets, so a bucket of m nodes
   gives m - 1 pairs.  Links join nodes to components.
   For buckets that still hold several components, the shingles that only one of
   their nodes has are counted; nobody shares these, which rules most links out.
   In the second round each node is compared with the bucket's node of fewest such
   shingles, the likeliest origin of its copies.  In the last round every pair that
   is left between components is compared; each such pair has a node outside the
   bucket's largest component, so only those nodes are joined against the bucket.
   After it no candidate pair between components that can be a link is unseen, and
   no link between different texts is lost.
3. A pair's signatures are compared 30 hashes at a time.  With a uniform prior the
   similarity is Beta(m + 1, n - m + 1) after m of n matches; a pair goes when
   P(similarity >= threshold) < MISS.  All others are confirmed on the full sets
   in whole numbers.

The chance that a pair at the threshold shares no band is below 3e-6 (see
``bands_for``);
two sets share a node with chance 2**-64.

Defined results: a null or empty text, or one without words, has no set and is
linked with nothing; a text of fewer words than a shingle is one shingle; rows
that repeat an id are documents of their own with that id; a null id is linked like
any other but names a component only where all its ids are null; further columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hinted, keyed, stored, table
from .hashing import mix, prefix_sums, ranges

#: Minima of a signature, and how many are compared at a time; rows of a band.
HASHES, BATCH, ROWS = 120, 30, 8
MOST_BANDS = 96
MISS = 1e-6
#: 64-bit words of the cells that bound how far two sets are apart.
WORDS = 8
BROADCAST_ROWS = 500_000
#: Nodes of a bucket and size class above which their comparisons are dealt to several tasks.
CROWD = 2048

_SEEDS = mix(np.arange(1, 2 * ROWS * MOST_BANDS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_MULTIPLY, _ADD = (_SEEDS[::2] | np.uint64(1))[:, None], _SEEDS[1::2][:, None]
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_set(text: str, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words, A-Z lower-cased."""
    data = _LOWER[np.frombuffer(text.encode(), np.uint8)]
    blank = np.r_[True, _BLANK[data], True]
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    words = ranges(prefix_sums(data), start, end)
    if len(words) < size:
        words, size = words[None, :].T, len(words)
        words = words[:, 0]
    n = len(words) - size + 1
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n])
    return np.unique(out)


def bands_for(percent: int) -> int:
    """The fewest dozens of bands that miss a pair at the threshold with a chance below 3e-6."""
    bands = 24
    while (1 - (percent / 100) ** ROWS) ** bands > 3e-6 and bands < MOST_BANDS:
        bands += 12
    return bands


def minima(shingles: np.ndarray, hashes: int) -> np.ndarray:
    best = np.full(hashes, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(shingles), 512):
        part = shingles[None, at : at + 512] * _MULTIPLY[:hashes]
        part += _ADD[:hashes]
        np.minimum(best, (part.min(1) >> np.uint64(32)).astype(np.uint32), out=best)
    return best


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(-1, ROWS).astype(np.uint64)
    key = np.arange(1, len(rows) + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return key.view(np.int64)


def odd_cells(shingles: np.ndarray) -> np.ndarray:
    """One bit a cell of hashes: whether an odd number of the shingles falls into it."""
    odd = np.bincount((shingles & np.uint64(64 * WORDS - 1)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def node_of(shingles: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).view(np.int64))


def least_matches(threshold: float, miss: float = MISS) -> dict[int, int]:
    """Matches of the first n hashes below which a pair goes: P(s >= t | m, n) = P(Bin(n + 1, t) <= m) < miss."""
    out = {}
    for n in range(BATCH, HASHES + 1, BATCH):
        total, m = 0.0, 0
        while True:
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= miss:
                break
            m += 1
        out[n] = m
    return out


def features(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """``doc_id, text_key, n_shingles, node, sig, bands, cells``; node is null without words."""
    hashes = ROWS * bands_for(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, node, sigs, bands, cells = [], [], [], [], []
            for text in batch.column(2):
                found = shingle_set(text.as_py(), size)
                n.append(len(found))
                if len(found):
                    least = minima(found, hashes)
                    node.append(node_of(found))
                    sigs.append(least[:HASHES].tobytes())
                    bands.append(band_keys(least))
                    cells.append(odd_cells(found))
                else:
                    node.append(None)
                    sigs.append(None)
                    bands.append(None)
                    cells.append(None)
            cols = [pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(sigs, pa.binary()), *(pa.array(c, pa.list_(pa.int64())) for c in (bands, cells))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], ["doc_id", "text_key", "n_shingles", "node", "sig", "bands", "cells"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text_key long, n_shingles long, node long, sig binary, bands array<long>, cells array<long>"
    return keyed(docs).select("doc_id", "text_key", "text").mapInArrow(run, schema)


def _plausible(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Pairs that sequential comparison of their signatures does not rule out."""
    least = least_matches(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, HASHES) for i in (2, 3))
            left, met = np.arange(len(x)), np.zeros(len(x), int)
            for n, m in least.items():
                met[left] += (x[left, n - BATCH : n] == y[left, n - BATCH : n]).sum(1)
                left = left[met[left] >= m]
            keep = pa.array(left)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], ["a", "b"])

    sig_a = nodes.select(F.col("node").alias("a"), F.col("sig").alias("sa"))
    sig_b = nodes.select(F.col("node").alias("b"), F.col("sig").alias("sb"))
    return pairs.join(sig_b, "b").join(sig_a, "a").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _links(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs ``a, b`` with 100 * intersection >= percent * union on the full sets."""
    pairs = stored(_plausible(pairs, nodes, percent / 100), "plausible")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    owners = hinted(stored(nodes.join(asked, "node", "left_semi").select("node", "doc_id", "text_key"), "owners"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t.as_py(), size).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["node", "items"])

    rows = keyed(docs).select("doc_id", "text_key", "text")
    on = (rows["text_key"] == owners["text_key"]) & rows["doc_id"].eqNullSafe(owners["doc_id"])
    # repeated rows of an owner give the same set; distinct pairs of the result take care of them
    full = stored(rows.join(owners, on).select("node", "text").mapInArrow(sets, "node long, items binary"), "sets")
    left = full.select(F.col("node").alias("a"), F.col("items").alias("ia"))
    right = full.select(F.col("node").alias("b"), F.col("items").alias("ib"))

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    both = right.join(hinted(pairs), "b").join(left, "a").select("a", "b", "ia", "ib")
    return stored(both.mapInArrow(confirm, "a long, b long").distinct(), "links")


def components(links: DataFrame) -> DataFrame:
    """``node, component`` of every linked node: least label of the neighbours, then of the label's own label."""
    both = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component"))
    labels = stored(labels, "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("c"))
        lower = labels.join(near, "node").select("node", F.least("component", "c").alias("c"), F.col("component").alias("was"))
        of = labels.select(F.col("node").alias("c"), F.col("component").alias("further"))
        step = stored(lower.join(of, "c").select("node", F.least("c", "further").alias("component"), "was"), "labels")
        done = step.where("component <> was").isEmpty()
        labels = step.select("node", "component")
        if done:
            return labels


def _close(n: str, m: str, percent: int) -> Column:
    """Sets of n and m shingles can be linked."""
    return (100 * F.least(n, m)) >= (percent * F.greatest(n, m))


def _lone(asked: DataFrame, nodes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """``node, lone, odd0, odd1, ...``: the shingles that a node has and no other of the ``asked`` nodes, and their odd cells."""
    owners = hinted(stored(nodes.join(asked, "node", "left_semi").select("node", "doc_id", "text_key"), "owners"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, text in zip(batch.column(0), batch.column(1), strict=True):
                found = pa.array(shingle_set(text.as_py(), size).view(np.int64))
                own = pa.array(np.full(len(found), node.as_py(), np.int64))
                yield pa.RecordBatch.from_arrays([own, found], ["node", "shingle"])

    rows = keyed(docs).select("doc_id", "text_key", "text")
    on = (rows["text_key"] == owners["text_key"]) & rows["doc_id"].eqNullSafe(owners["doc_id"])
    items = rows.join(owners, on).select("node", "text").mapInArrow(run, "node long, shingle long")
    # repeated rows of an owner are one holder: its least and greatest node are equal
    held = items.groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("last")).where("node = last")
    bit, word = F.expr("shiftleft(1L, cast(shingle & 63 AS int))"), F.expr(f"(shingle >> 6) & {WORDS - 1}")
    odd = [F.bit_xor(F.when(word == k, bit).otherwise(F.lit(0).cast("long"))).alias(f"odd{k}") for k in range(WORDS)]
    return held.groupBy("node").agg(F.count(F.lit(1)).alias("lone"), *odd)


def _mixed(rows: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """Rows of the buckets that hold more than one component, with the largest as ``main``."""
    rows = rows.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = rows.groupBy("band", "component").agg(F.count(F.lit(1)).alias("k"))
    main = sizes.groupBy("band").agg(F.max(F.struct("k", "component"))["component"].alias("main"), F.count(F.lit(1)).alias("parts"))
    return stored(rows.join(main.where("parts > 1").select("band", "main"), "band"), label)


def _open(bands: DataFrame, labels: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """``band, node, n, lone, odd`` of mixed buckets, without nodes whose lone shingles alone rule out every partner."""
    crowd = _mixed(bands, labels, "mixed")
    asked = stored(crowd.select("node").distinct(), "asked")
    own = nodes.select("node", "cells").join(asked, "node").join(_lone(asked, nodes, docs, size), "node", "left")
    odd = F.array(*(F.col("cells")[k].bitwiseXOR(F.coalesce(f"odd{k}", F.lit(0).cast("long"))) for k in range(WORDS)))
    own = own.select("node", F.coalesce("lone", F.lit(0).cast("long")).alias("lone"), odd.alias("odd"))
    rows = crowd.select("band", "node", "n").join(own, "node")
    return stored(rows.where((F.col("n") - F.col("lone")) * 100 >= percent * F.col("n")), "open")


def _size_class(n: Column, percent: int) -> tuple[Column, tuple[int, ...]]:
    """A class of set sizes, and the steps to the classes of sets that can be linked."""
    if percent >= 100:
        return n.cast("long"), (0,)
    # a little wider than the ratio at the threshold: rounding cannot set two linked sets two classes apart
    return F.floor(F.log(n) / (log(100 / percent) * (1 + 1e-9))), (-1, 0, 1)


def _partners(left: DataFrame, right: DataFrame, percent: int) -> DataFrame:
    """Pairs of a bucket between components that can be linked.

    Sets of n and m shingles are linked if and only if (100 + percent) * d <= (100 - percent) * (n + m),
    with d shingles in just one of them: all lone ones, and one at least for each cell of
    the others that holds an odd number in one set and an even number in the other.

    A node meets only nodes of its own and the two next size classes, and the nodes of a
    large class are dealt to parts, so that no bucket is the work of a single task.
    """
    size, steps = _size_class(F.col("n"), percent)
    left = left.withColumn("class", size)
    right = right.withColumn("class", F.explode(F.array(*(size + k for k in steps))))
    crowds = left.groupBy("band", "class").agg(F.ceil(F.count(F.lit(1)) / CROWD).cast("int").alias("parts")).where("parts > 1")
    crowds = hinted(stored(crowds, "crowds"), BROADCAST_ROWS)
    one = F.coalesce("parts", F.lit(1))
    left = left.join(crowds, ["band", "class"], "left").withColumn("part", F.pmod(F.xxhash64("node"), one).cast("int"))
    right = right.join(crowds, ["band", "class"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), one - 1)))
    key = ["band", "class", "part"]
    right = right.select(*(F.col(c).alias(f"{c}_x") for c in (*key, "node", "component", "n", "lone", "odd")))
    apart = sum((F.bit_count(F.col("odd")[k].bitwiseXOR(F.col("odd_x")[k])) for k in range(WORDS)), F.col("lone") + F.col("lone_x"))
    common = F.abs(F.expr("n - lone - n_x + lone_x")) + F.col("lone") + F.col("lone_x")
    can = F.greatest(apart, common) * (100 + percent) <= (100 - percent) * (F.col("n") + F.col("n_x"))
    met = (F.col("component") != F.col("component_x")) & can
    for c in key:
        met = met & (F.col(c) == F.col(f"{c}_x"))
    return left.join(right, met).select(F.least("node", "node_x").alias("a"), F.greatest("node", "node_x").alias("b")).distinct()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, text_key, n_shingles, component_id`` for every row of ``docs``."""
    return _grouped(docs, size, percent).drop("component")


def _grouped(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """``near_duplicates`` with ``component``, a node of the component; null where a text has no set."""
    feats = stored(features(docs, size, percent), "features")
    owner = feats.where("node is not null").groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("o"), F.min("doc_id").alias("least_id"))
    owner = stored(owner.select("node", "o.*", "least_id"), "nodes")
    on = (feats["node"] == owner["node"]) & (feats["text_key"] == owner["text_key"]) & feats["doc_id"].eqNullSafe(owner["doc_id"])
    # one row a node, as equal rows hold equal values
    keep = ["node", "doc_id", "text_key", "n_shingles", "sig", "bands", "cells"]
    nodes = stored(feats.join(owner, on, "left_semi").select(*keep).dropDuplicates(["node"]), "nodes")

    bands = nodes.select("node", F.col("n_shingles").alias("n"), F.explode("bands").alias("band"))
    centres = bands.groupBy("band").agg(F.min(F.struct("node", "n")).alias("c"), F.count(F.lit(1)).alias("k")).where("k > 1")
    centres = centres.select("band", F.col("c.node").alias("a"), F.col("c.n").alias("na"))
    crowded = stored(bands.join(centres, "band"), "buckets")
    stars = crowded.where((F.col("node") != F.col("a")) & _close("n", "na", percent))
    first = stored(stars.select("a", F.col("node").alias("b")).distinct(), "pairs")
    links = _links(first, nodes, docs, size, percent)
    labels = components(links)
    seen = first
    rows = _open(crowded.select("node", "n", "band"), labels, nodes, docs, size, percent)
    for hubs in (True, False):
        mixed = _mixed(rows, labels, "open")
        if hubs:
            hub = mixed.groupBy("band").agg(F.min(F.struct("lone", "node"))["node"].alias("hub"))
            others = mixed.join(hub, "band").where("node = hub")
        else:
            others = mixed.where("component <> main")
        pairs = stored(_partners(mixed, others, percent).join(seen, ["a", "b"], "left_anti"), "pairs")
        if not pairs.isEmpty():
            links = links.unionByName(_links(pairs, nodes, docs, size, percent))
            labels = components(links)
            seen = seen.unionByName(pairs)

    least = owner.select("node", "least_id").join(labels, "node").groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = labels.join(hinted(stored(least, "least"), BROADCAST_ROWS), "component").select("node", "component", "component_id")
    alone = owner.select("node", F.col("least_id").alias("own"))
    named = alone.join(named, "node", "left").select("node", F.coalesce("component", "node").alias("component"), F.coalesce("component_id", "own").alias("component_id"))
    out = feats.select("doc_id", "text_key", "n_shingles", "node").join(named, "node", "left")
    return out.select("doc_id", "text_key", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "component")


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component: the least id, the least text key of equal ids.

    Null is the least id only where all are null.  Of rows that repeat id and
    text any one stays.  A text without words is a component of its own.
    """
    rows = _grouped(docs, size, percent)
    each = stored(rows.groupBy("component", "component_id", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")), "documents")
    named = each.where("component is not null and doc_id <=> component_id")
    least = named.groupBy("component").agg(F.min("text_key").alias("least"))
    # what goes is joined, not what stays: it is the smaller part, and null texts have no component
    other = each.where("component is not null").join(least, "component", "left")
    gone = other.where("not (doc_id <=> component_id) or text_key <> least")
    gone = hinted(stored(gone.select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k")), "gone"), BROADCAST_ROWS)
    key = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    out = docs.join(gone, (key == gone["_k"]) & docs["doc_id"].eqNullSafe(gone["_d"]), "left_anti")
    again = each.where("n > 1").select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k"))
    again = hinted(stored(again, "again"), BROADCAST_ROWS)
    if again.isEmpty():
        return out
    same = (key == again["_k"]) & docs["doc_id"].eqNullSafe(again["_d"])
    once = out.join(again, same, "left_semi").withColumn("_text_key", F.xxhash64(F.coalesce("text", F.lit("")))).dropDuplicates(["doc_id", "_text_key"])
    return out.join(again, same, "left_anti").unionByName(once.drop("_text_key"))


def op9_near_duplicates(spark, sf_dir) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def components_sql(documents: str, size: int, percent: int) -> str:
    """DuckDB's form up to ``grouped(doc_id, t, n_shingles, component_id)``: all pairs that share a shingle."""
    return f"""
WITH RECURSIVE nd_docs AS (
  SELECT DISTINCT doc_id, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws
  FROM {documents}),
nd_sets AS (
  SELECT doc_id, t, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {size} THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - {size - 2}), lambda i: array_to_string(ws[i:i + {size - 1}], ' '))) END AS s FROM nd_docs),
nd_items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM nd_sets),
nd_links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM nd_items a JOIN nd_items b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
nd_edges AS (SELECT a, b FROM nd_links UNION ALL SELECT b, a FROM nd_links),
nd_reach(a, b) AS (SELECT DISTINCT a, a FROM nd_edges UNION SELECT r.a, e.b FROM nd_reach r JOIN nd_edges e ON r.b = e.a),
nd_least AS (SELECT a, min(b) AS c FROM nd_reach GROUP BY a),
grouped AS (
  SELECT doc_id, t, len(s)::BIGINT AS n_shingles, coalesce(c, doc_id) AS component_id
  FROM nd_sets LEFT JOIN nd_least ON doc_id = a)"""


QUERIES = {"op9_near_duplicates": op9_near_duplicates}
SQL = {
    "op9_near_duplicates": components_sql("documents", 3, 85)
    + "\nSELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM grouped"
}
