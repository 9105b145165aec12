"""Token ids as grammar-compressed binary shards.

Documents are sorted by id over range partitions.  A partition writes blocks;
a block is a Re-Pair grammar of its ids: frequent neighbouring pairs are replaced
by nonterminals, round after round, until no pair is frequent enough.  In a
round the most frequent pairs are all replaced at once, from left to right and
without overlap, and no pair crosses the end of a document.  A block stores

    symbols  the compressed sequence (little-endian 32 bit)
    rules    two symbols for each nonterminal
    lengths  the number of ids that each nonterminal stands for
    heads    the first symbol of each document
    sizes    the number of ids of each document

so a document, or a range of its ids, is decoded from its own symbols alone.
Blocks are rows of a Parquet table in the shared folder (``shard, block``), so
Spark commits them and a lost task writes its shard again.

Defined results: a null or empty text is the end id alone; equal ids of
documents are kept apart and ordered by text; a null id sorts first; an empty
table has no blocks; further columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import _pattern
from .common import env_path, stored, table
from .pretokens import Book, gathered, slices

DEFAULT_TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
BLOCK_IDS = 1 << 21
MIN_COUNT = 16
#: Bits of the table that finds a chosen pair by its hash.
BITS = 18
#: Pre-tokens that a worker remembers.
MAX_WORDS = 1_000_000
#: Marks the last symbol of a document.
LAST = np.int32(1 << 30)

BLOCK = "shard int, block int, n_ids long, base int, symbols binary, rules binary, lengths binary, heads binary, sizes binary, doc_ids array<{id}>"


def _frequent(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs (-1 is none) with MIN_COUNT places and their numbers, the rarest first."""
    order = np.sort(code)
    first = np.flatnonzero(np.r_[True, order[1:] != order[:-1]])
    n = np.diff(np.r_[first, len(order)])
    often = (n >= MIN_COUNT) & (order[first] >= 0)
    pair, n = order[first[often]], n[often]
    rank = np.argsort(n, kind="stable")
    return pair[rank], n[rank]


def compress(ids: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray | int]:
    """Re-Pair of documents laid end to end; ``sizes`` are their numbers of ids.

    A round counts all pairs exactly (of a run of one symbol every other place) and
    replaces each pair that is frequent wherever no more frequent pair overlaps it;
    so the most frequent pair is replaced everywhere, and the rounds end when no
    pair has MIN_COUNT places.  Only new neighbours and pairs that were frequent can
    be frequent, so later rounds look at these places alone.
    """
    seq = ids.astype(np.int32)
    base = int(seq.max()) + 1 if len(seq) else 1
    seq[np.cumsum(sizes)[np.asarray(sizes) > 0] - 1] |= LAST
    rules: list[np.ndarray] = []
    top, at, turn = base, np.arange(max(len(seq) - 1, 0)), 0
    while len(at):
        a, b = (seq[:-1], seq[1:]) if len(at) == len(seq) - 1 else (seq[at], seq[at + 1])
        b = b & ~LAST
        code = a.astype(np.int64) << 32 | b
        same = np.flatnonzero(a == b)
        if len(same):
            # of a run of equal symbols every other place, from the left
            place = at[same]
            head = np.flatnonzero(np.r_[True, np.diff(place) != 1])
            first = np.repeat(place[head], np.diff(np.r_[head, len(place)]))
            code[same[(place - first) % 2 == 1]] = -1
        code[a >= LAST] = -1  # no pair crosses the end of a document
        pair, n = _frequent(code)
        if not len(pair):
            break
        turn += 1
        mult = np.int64((0x9E3779B97F4A7C15 + 0x5851F42D4C957F2E * turn | 1) & ((1 << 63) - 1))
        bucket = lambda x: (x * mult).view(np.uint64) >> np.uint64(64 - BITS)  # noqa: E731, B023
        slot = np.full(1 << BITS, -1, np.int32)
        slot[bucket(pair)] = np.arange(len(pair), dtype=np.int32)  # the most frequent pair of a bucket; the others wait for the next round
        which = slot[bucket(code)]
        some = np.flatnonzero(which >= 0)
        wait, which = at[some], which[some]  # may still be frequent after this round
        hit = np.flatnonzero(pair[which] == code[some])
        at, which = wait[hit], which[hit]
        # a place stands if its pair is more frequent than those that overlap it
        near, more = np.diff(at) == 1, which[1:] > which[:-1]
        stand = np.ones(len(at), bool)
        stand[:-1] &= ~(near & more)
        stand[1:] &= ~(near & ~more)
        at, which = at[stand], which[stand]
        often = np.bincount(which, minlength=len(pair)) >= MIN_COUNT
        if not often.all():
            keep = np.flatnonzero(often[which])
            at, which, pair = at[keep], (np.cumsum(often) - 1)[which[keep]].astype(np.int32), pair[often]
        seq[at] = (which + np.int32(top)) | (seq[at + 1] & LAST)
        rules.append(np.stack([pair >> 32, pair & 0xFFFFFFFF], 1).astype(np.int32))
        top += len(pair)
        # what may be frequent now: what was, and the new symbols with their neighbours
        gone = at + 1
        if len(wait) * 8 > len(seq):
            stay, live = np.ones(len(seq), bool), np.zeros(len(seq), bool)
            stay[gone] = False
            live[wait] = live[at] = True
            live[at[at > 0] - 1] = True
            # a neighbour that is itself gone stands for the symbol before it
            live[at[(at > 1) & ~stay[at - 1]] - 2] = True
            at = np.flatnonzero(live[stay][:-1])
            seq = seq[stay]
        else:
            before = at - 1
            before = before - np.isin(before, gone, assume_unique=True)
            live = np.unique(np.concatenate([wait, at, before[before >= 0]]))
            skip = np.searchsorted(gone, live)
            live = live[gone[np.minimum(skip, len(gone) - 1)] != live]
            at = live - np.searchsorted(gone, live)
            seq = np.delete(seq, gone)
            at = at[at < len(seq) - 1]
    rule = np.concatenate(rules) if rules else np.zeros((0, 2), np.int32)
    last = seq >= LAST
    heads = np.r_[0, np.flatnonzero(last)[:-1] + 1].astype(np.int32) if len(seq) else np.zeros(0, np.int32)
    width = _widths(base, rule)
    return {"base": base, "symbols": seq & ~LAST, "rules": rule, "lengths": width[base:].astype(np.int32), "heads": heads}


def _rounds(base: int, rules: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rules that refer to symbols before the run only."""
    most, begin = rules.max(1) if len(rules) else np.zeros(0), 0
    while begin < len(rules):
        later = most[begin:] >= base + begin
        end = begin + int(later.argmax()) if later.any() else len(rules)
        yield begin, end
        begin = end


def _widths(base: int, rules: np.ndarray) -> np.ndarray:
    width = np.ones(base + len(rules), np.int64)
    for begin, end in _rounds(base, rules):
        width[base + begin : base + end] = width[rules[begin:end]].sum(1)
    return width


def expand(symbols: np.ndarray, base: int, rules: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ids of some symbols; rules refer to earlier ones only."""
    width = np.ones(base + len(rules), np.int64)
    width[base:] = lengths
    begin = np.cumsum(width) - width
    flat = np.arange(int(width.sum()), dtype=np.int32)
    for i, j in _rounds(base, rules):
        part = rules[i:j].ravel()
        to = begin[base + i]
        got = gathered(flat, begin[part], width[part])
        flat[to : to + len(got)] = got
    return gathered(flat, begin[symbols], width[symbols])


def slice_ids(symbols: np.ndarray, base: int, rules: np.ndarray, lengths: np.ndarray, start: int, stop: int) -> np.ndarray:
    """ids[start:stop] of a document's symbols, expanding only those that the range touches."""
    width = np.ones(base + len(rules), np.int64)
    width[base:] = lengths
    ends = np.cumsum(width[symbols])
    a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
    skip = start - (ends[a - 1] if a else 0)
    return expand(symbols[a:b], base, rules, lengths)[skip : skip + max(0, stop - start)]


_tools: dict[tuple[str, str, bool], Callable[[list[str]], list[np.ndarray]]] = {}


def _byte_characters() -> dict[int, str]:
    """The characters that stand for bytes in a byte-level vocabulary: printable Latin-1 as it is, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _encoder(path: str, pattern: str, literal: bool) -> Callable[[list[str]], list[np.ndarray]]:
    """The library's ids of texts, each with the end id.

    The library's model encodes distinct pre-tokens; a text with an added token goes to the library whole.
    """
    if (path, pattern, literal) in _tools:
        return _tools[path, pattern, literal]
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(path)
    tool.encode_special_tokens = literal
    added = [t.content for t in tool.get_added_tokens_decoder().values() if not (literal and t.special)]
    tokenize, characters = tool.model.tokenize, _byte_characters()

    def by_model(words: list[str]) -> list[np.ndarray]:
        mapped = (w.encode().decode("latin-1").translate(characters) for w in words)
        return [np.array([t.id for t in tokenize(w)], np.int32) for w in mapped]

    def by_library(words: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in tool.encode_batch_fast(words, add_special_tokens=False)]

    probe = ["a", " the", "The", "  ", "\n", " \t", "é", " ñandú", "١٢", " 123", "!?", "'ll", " straße", "🙂", "\u00ad", "\x7f", " 日本語"]
    try:
        alike = all((x == y).all() if len(x) == len(y) else False for x, y in zip(by_model(probe), by_library(probe), strict=True))
    except Exception:  # a model of another kind
        alike = False
    book = Book(pattern, by_model if alike else by_library, MAX_WORDS)
    end = np.array([END_ID], np.int32)

    def encode(texts: list[str]) -> list[np.ndarray]:
        whole = [any(a in t for a in added) for t in texts]
        out = []
        for ids, ends, _ in book.of(["" if w else t for w, t in zip(whole, texts, strict=True)]):
            out += [np.append(x, end) for x in np.split(ids, ends[:-1])]
        for k in np.flatnonzero(whole).tolist():
            out[k] = np.array([*tool.encode(texts[k], add_special_tokens=False).ids, END_ID], np.int32)
        return out

    _tools.clear()  # one book a worker
    _tools[path, pattern, literal] = encode
    return encode


def write_shards(docs: DataFrame, tokenizer: str | None = None, pattern: str | None = None, shards: int | None = None, block_ids: int = BLOCK_IDS, literal: bool = True) -> DataFrame:
    """Encode, compress and write; returns the blocks as read back.

    With ``literal`` a special token that a text spells out is encoded as text;
    without, it becomes its own id, as the library does as loaded.

    The texts are shuffled once, by ranges of the id; ids never are.
    """
    spark = docs.sparkSession
    path, pattern = tokenizer or env_path(DEFAULT_TOKENIZER), _pattern(pattern)
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    ranged = docs.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    ranged = ranged.select(F.spark_partition_id().alias("shard"), "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, names, total, block, shard = [], [], 0, 0, 0
        encode = _encoder(path, pattern, literal)

        def close() -> pa.RecordBatch:
            sizes = np.array([len(x) for x in held], np.int64)
            got = compress(np.concatenate(held), sizes)
            row = {"shard": [shard], "block": [block], "n_ids": [int(sizes.sum())], "base": [got["base"]]}
            row |= {k: [got[k].astype("<i4").tobytes()] for k in ("symbols", "rules", "lengths", "heads")}
            row |= {"sizes": [sizes.astype("<i8").tobytes()], "doc_ids": [names]}
            return pa.RecordBatch.from_pydict(row, schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            shard = batch.column(0)[0].as_py()
            schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("n_ids", pa.int64()), ("base", pa.int32()), *((c, pa.binary()) for c in ("symbols", "rules", "lengths", "heads", "sizes")), ("doc_ids", pa.list_(batch.schema.field(1).type))])
            for part in slices(batch, 2):
                for name, ids in zip(part.column(1).to_pylist(), encode([t or "" for t in part.column(2).to_pylist()]), strict=True):
                    held.append(ids)
                    names.append(name)
                    total += len(ids)
                    if total >= block_ids:
                        yield close()
                        held, names, total, block = [], [], 0, block + 1
        if held:
            yield close()

    return stored(ranged.mapInArrow(run, BLOCK.format(id=kind)), "repair")


def read_shards(blocks: DataFrame) -> DataFrame:
    """``shard, block, at, doc_id, ids`` of every document, by ``at`` within its block."""
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, block, names, sizes, ids in _decoded(batches):
            ends = np.r_[0, np.cumsum(sizes)].astype(np.int32)
            cols = [pa.array(np.full(len(sizes), shard, np.int32)), pa.array(np.full(len(sizes), block, np.int32)), pa.array(np.arange(len(sizes), dtype=np.int32)), names, pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))]
            yield pa.RecordBatch.from_arrays(cols, ["shard", "block", "at", "doc_id", "ids"])

    return blocks.mapInArrow(run, f"shard int, block int, at int, doc_id {kind}, ids array<int>")


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        for i in range(batch.num_rows):
            raw = lambda c, kind="<i4": np.frombuffer(cols[c][i].as_py(), kind)  # noqa: B023, E731
            ids = expand(raw("symbols"), cols["base"][i].as_py(), raw("rules").reshape(-1, 2), raw("lengths"))
            yield cols["shard"][i].as_py(), cols["block"][i].as_py(), cols["doc_ids"][i].values, raw("sizes", "<i8"), ids


def summarize(blocks: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` read back from the files.

    Only the number of ids of each shard and block, a row of three numbers for
    some million ids, is summed up over the corpus.
    """
    spark = blocks.sparkSession
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    starts = _starts(spark, blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, block, names, sizes, ids in _decoded(batches):
            ends = np.cumsum(sizes)
            raw = ids.astype("<u4")
            crc = [zlib.crc32(raw[e - n : e].tobytes()) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
            m = len(sizes)
            cols = [pa.array(np.full(m, shard, np.int32)), pa.array(np.full(m, block, np.int32)), names, pa.array(ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["shard", "block", "doc_id", "inner", "n_tokens", "ids_crc32"])

    found = blocks.mapInArrow(run, f"shard int, block int, doc_id {kind}, inner long, n_tokens long, ids_crc32 long")
    return found.join(starts, ["shard", "block"]).select("doc_id", (F.col("before") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def _starts(spark: SparkSession, blocks: DataFrame) -> DataFrame:
    """``shard, block, before``: ids before a block; totals by shard (one row a partition) come to the driver."""
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()
    sums, total = [], 0
    for row in totals:
        sums.append((row["shard"], total))
        total += row["n"]
    from pyspark.sql import Window

    shard_start = spark.createDataFrame(sums, "shard int, shard_before long")
    within = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inner = blocks.select("shard", "block", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("inner_before"))
    return inner.join(shard_start, "shard").select("shard", "block", (F.col("shard_before") + F.col("inner_before")).alias("before"))


def op3_repair_shards(spark, sf_dir) -> DataFrame:
    return summarize(write_shards(table(spark, sf_dir, "documents"), literal=False))


QUERIES = {"op3_repair_shards": op3_repair_shards}
SQL: dict[str, str] = {}
