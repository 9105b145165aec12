"""Benchmark decontamination by a positional inverted index (DataFrame functions only).

The index holds a posting ``(term, doc, pos)`` for every occurrence in the
training text of a term that the tests use.  A test window is looked up from its
rarest term: the postings of that term, shifted by its offset, are the candidate
starts; they are intersected with the shifted postings of the next rarest term,
and what is left with those of all other terms.  A candidate that meets every
list is an exact phrase match.  ``proximity_matches`` asks the same index for two
terms within a distance.

Tests are broadcast only after a count; above ``BROADCAST_ROWS`` the same joins
shuffle, where Spark splits a frequent term's postings.

Defined results: a null or empty text has no words and no hits; an item without
words has no windows; an item without an id can't be named and is left out;
items that repeat an id count once; repeated rows of a document get equal
results; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hinted, keyed, lower_ascii, stored, table

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
BROADCAST_ROWS = 500_000


def terms(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def test_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """``window, words, item_id``: every run of ``size`` words, or the whole of a shorter item."""
    items = benchmark.where("item_id is not null").select("item_id", terms(F.col("text")).alias("w"))
    n = F.size("w")
    starts = F.when(n >= size, F.sequence(F.lit(1), n - size + 1)).when(n > 0, F.array(F.lit(1)))
    each = items.select("item_id", "w", F.explode(starts).alias("i")).select("item_id", F.slice("w", F.col("i"), size).alias("words"))
    return each.select(F.array_join("words", " ").alias("window"), "words", "item_id").distinct()


def positional_index(docs: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """Postings ``term, doc_id, text_key, pos`` (from 0), written to the shared folder.

    ``vocabulary`` (column ``term``) keeps the postings of the terms that will be asked for.
    """
    words = keyed(docs).select("doc_id", "text_key", F.posexplode(terms(F.col("text"))).alias("pos", "term"))
    if vocabulary is not None:
        words = words.join(hinted(vocabulary), "term", "left_semi")
    return stored(words.select("term", "doc_id", "text_key", "pos"), "postings")


def _meets(left: DataFrame, postings: DataFrame) -> DataFrame:
    """Rows of ``left`` whose ``term`` stands at ``pos`` in their document."""
    on = (left["term"] == postings["term"]) & (left["pos"] == postings["pos"])
    on = on & (left["text_key"] == postings["text_key"]) & left["doc_id"].eqNullSafe(postings["doc_id"])
    return left.join(postings, on, "left_semi")


def phrase_matches(index: DataFrame, windows: DataFrame) -> DataFrame:
    """``doc_id, text_key, window, start, len`` of every occurrence of a window (columns ``window, words``)."""
    each = windows.select("window", "words").distinct()
    offsets = each.select("window", F.size("words").alias("len"), F.posexplode("words").alias("off", "term"))
    counts = stored(index.groupBy("term").agg(F.count(F.lit(1)).alias("n")), "counts")
    # at most ten rows a window; a window with an absent term cannot occur
    by_rarity = Window.partitionBy("window").orderBy("n", "off")
    ranked = offsets.join(hinted(counts), "term").withColumn("rank", F.row_number().over(by_rarity))
    ranked = ranked.withColumn("found", F.count(F.lit(1)).over(Window.partitionBy("window")))
    ranked = stored(ranked.where("found = len"), "lookups")

    first = ranked.where("rank = 1").select("term", "window", "len", F.col("off").alias("o"))
    keys = ["doc_id", "text_key", "window", "len", "start"]
    starts = index.join(hinted(first), "term").withColumn("start", F.col("pos") - F.col("o")).where("start >= 0").select(*keys)

    second = ranked.where("rank = 2").select("window", "term", F.col("off").alias("o"))
    asked = starts.join(hinted(second), "window").withColumn("pos", F.col("start") + F.col("o"))
    near = index.join(hinted(second.select("term").distinct()), "term", "left_semi")
    left = stored(_meets(asked, near).select(*keys).unionByName(starts.where("len = 1")), "candidates")

    rest = ranked.where("rank > 2").select("window", "term", F.col("off").alias("o"))
    docs = left.where("len > 2").select("doc_id", "text_key").distinct()
    few = hinted(stored(docs, "holders"))
    there = index.join(few, (index["text_key"] == few["text_key"]) & index["doc_id"].eqNullSafe(few["doc_id"]), "left_semi")
    there = there.join(hinted(rest.select("term").distinct()), "term", "left_semi")
    asked = left.join(hinted(rest), "window").withColumn("pos", F.col("start") + F.col("o"))
    full = _meets(asked, there).groupBy(*keys).agg(F.count_distinct("pos").alias("met")).where("met = len - 2")
    return full.select(*keys).unionByName(left.where("len <= 2").distinct())


def proximity_matches(index: DataFrame, queries: DataFrame) -> DataFrame:
    """``query, doc_id, text_key, first_pos, second_pos`` where two terms stand within ``slop`` positions.

    ``queries``: ``query, first, second, slop``.  Positions are binned by slop + 1, so a
    posting meets those of three bins, not all of its document.
    """
    q = hinted(queries.select("query", "first", "second", "slop"))
    bin_ = lambda c: F.floor(F.col(c) / (F.col("slop") + 1))
    a = index.join(q, index["term"] == q["first"]).select("query", "slop", "doc_id", "text_key", F.col("pos").alias("first_pos"))
    a = a.withColumn("bin", F.explode(F.array(bin_("first_pos") - 1, bin_("first_pos"), bin_("first_pos") + 1)))
    b = index.join(q, index["term"] == q["second"]).select("query", "slop", F.col("doc_id").alias("d"), F.col("text_key").alias("k"), F.col("pos").alias("second_pos"))
    b = b.withColumn("b", bin_("second_pos")).withColumnRenamed("query", "q").drop("slop")
    on = (a["query"] == b["q"]) & (a["text_key"] == b["k"]) & a["doc_id"].eqNullSafe(b["d"]) & (a["bin"] == b["b"])
    near = (F.abs(F.col("first_pos") - F.col("second_pos")) <= F.col("slop")) & (F.col("first_pos") != F.col("second_pos"))
    return a.join(b, on).where(near).select("query", "doc_id", "text_key", "first_pos", "second_pos").distinct()


def matches_of(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """``doc_id, text_key, window, start, len`` of all occurrences of the benchmark's windows, and the windows."""
    windows = stored(test_windows(benchmark, size), "windows")
    vocabulary = stored(windows.select(F.explode("words").alias("term")).distinct(), "vocabulary")
    index = positional_index(docs, vocabulary)
    return stored(phrase_matches(index, windows).select("doc_id", "text_key", "window", "start", "len"), "matches"), windows


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """``doc_id, text_key, n_words, n_hit, items`` (sorted item ids as strings) for every row of ``docs``."""
    matches, windows = matches_of(docs, benchmark, size)

    spans = matches.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set(F.struct("start", "len"))).alias("s"))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def cover(acc: Column, x: Column) -> Column:
        end = F.greatest(acc["end"], x["start"] + x["len"])
        return F.struct((acc["n"] + end - F.greatest(acc["end"], x["start"])).alias("n"), end.alias("end"))

    hits = spans.select("doc_id", "text_key", F.aggregate("s", zero, cover, lambda a: a["n"]).cast("long").alias("n_hit"))
    links = matches.select("doc_id", "text_key", "window").distinct().join(hinted(windows.select("window", "item_id")), "window")
    items = links.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))

    out = keyed(docs).select("doc_id", "text_key", F.size(terms(F.col("text"))).cast("long").alias("n_words"))
    found = hits.join(items, (hits["text_key"] == items["text_key"]) & hits["doc_id"].eqNullSafe(items["doc_id"])).select(
        hits["doc_id"].alias("d"), hits["text_key"].alias("k"), "n_hit", "items"
    )
    joined = out.join(found, (out["text_key"] == F.col("k")) & out["doc_id"].eqNullSafe(F.col("d")), "left")
    return joined.select(
        "doc_id", "text_key", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """``docs`` without the rows that hold any window of the benchmark.

    Only the ids and text keys of these rows are joined; where they are few they
    are broadcast, and no text is shuffled.
    """
    bad = matches_of(docs, benchmark, size)[0].select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k")).distinct()
    bad = hinted(stored(bad, "contaminated"), BROADCAST_ROWS)
    key = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(bad, (key == bad["_k"]) & docs["doc_id"].eqNullSafe(bad["_d"]), "left_anti")


def op4_decontamination(spark, sf_dir) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def matched_sql(documents: str = "documents") -> str:
    """DuckDB's form up to ``matched(doc_id, t, n_words, n_hit, items)``; the pipeline's SQL uses it too."""
    words = lambda c: f"list_filter(regexp_split_to_array(translate(coalesce({c}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SEPARATORS}'), lambda w: w <> '')"
    return f"""
WITH item_words AS (SELECT item_id, {words('text')} AS ws FROM benchmark WHERE item_id IS NOT NULL),
item_runs AS (
  SELECT item_id, ws, unnest(CASE WHEN len(ws) >= {WINDOW} THEN range(1, len(ws) - {WINDOW - 2}) WHEN len(ws) > 0 THEN [1] ELSE [] END) AS i FROM item_words),
wins AS (SELECT DISTINCT item_id, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS win, least(len(ws), {WINDOW}) AS n FROM item_runs),
doc_words AS (SELECT DISTINCT doc_id, coalesce(text, '') AS t, {words('text')} AS ws FROM {documents}),
doc_runs AS (
  SELECT doc_id, t, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM doc_words, (SELECT DISTINCT n FROM wins)),
doc_wins AS (SELECT doc_id, t, n, i, array_to_string(ws[i:i + n - 1], ' ') AS win FROM doc_runs),
matches AS (SELECT DISTINCT doc_id, t, item_id, n, i FROM doc_wins JOIN wins USING (win, n)),
cells AS (SELECT DISTINCT doc_id, t, p FROM (SELECT doc_id, t, unnest(range(i, i + n)) AS p FROM matches)),
hits AS (SELECT doc_id, t, count(*) AS n_hit FROM cells GROUP BY ALL),
named AS (SELECT doc_id, t, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM matches GROUP BY ALL),
matched AS (
  SELECT d.doc_id, d.t, len(d.ws) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(m.items, []) AS items
  FROM doc_words d LEFT JOIN hits h ON d.doc_id IS NOT DISTINCT FROM h.doc_id AND d.t = h.t
  LEFT JOIN named m ON d.doc_id IS NOT DISTINCT FROM m.doc_id AND d.t = m.t)"""


QUERIES = {"op4_decontamination": op4_decontamination}
SQL = {
    "op4_decontamination": matched_sql()
    + """
SELECT d.doc_id, n_words::BIGINT AS n_words, n_hit::BIGINT AS n_hit, len(items)::BIGINT AS n_items,
  sha256(array_to_string(items, ',')) AS items_sha256, n_hit > 0 AS contaminated
FROM documents d JOIN matched m ON d.doc_id IS NOT DISTINCT FROM m.doc_id AND coalesce(d.text, '') = m.t"""
}
