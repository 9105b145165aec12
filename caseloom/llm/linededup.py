"""Line dedup over windows of three consecutive lines (DataFrame functions only).

Each window of three lines is hashed (128 bits).  The first occurrence of a hash
is the least ``(doc_id, text_key, line)``; every later one marks its three lines,
and the lines covered by the merged marks are removed.  Windows are judged on the
input, so a window that overlaps itself loses what its later copy covers.

Defined results: a null or empty text stays empty; a text of fewer than three
lines, and a window without a word, are never repeated; rows that repeat id and
text are one document and keep the same lines; null ids come first; other columns
stay as they are, but for those named ``n_lines`` and ``n_removed`` in
``dedup_lines`` (``without_repeats`` keeps these too).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK_CHARS, hinted, keyed, stored, table

LINES = 3
#: Documents with repeated windows up to which their marks are broadcast, after a check of their size.
BROADCAST_ROWS = 200_000


def line_windows(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """``h1, h2, doc_id, text_key, pos`` (from 0) of every window."""
    each = keyed(docs).select("doc_id", "text_key", F.split("text", "\n").alias("ls"))
    n = F.size("ls") - (lines - 1)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def one(i: Column) -> Column:
        part = F.slice(F.col("ls"), i + 1, lines)
        blank = F.translate(F.array_join(part, ""), BLANK_CHARS, "") == ""
        return F.struct(i.alias("pos"), F.xxhash64(part).alias("h1"), F.xxhash64(F.lit(1), part).alias("h2"), blank.alias("blank"))

    found = each.select("doc_id", "text_key", F.explode(F.transform(starts, one)).alias("x"))
    return found.select("doc_id", "text_key", "x.*").where("not blank").select("h1", "h2", "doc_id", "text_key", "pos")


def repeated_windows(windows: DataFrame) -> DataFrame:
    """``doc_id, text_key, starts``: the later occurrences, gathered by document.

    The first occurrence of a hash is a partial minimum before the shuffle; the
    join back is one row against many, which Spark splits where a hash is frequent.
    """
    place = F.struct("doc_id", "text_key", "pos")
    firsts = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("final"))
    firsts = firsts.where(~F.col("first").eqNullSafe(F.col("final"))).select("h1", "h2", "first")
    later = windows.join(firsts, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "text_key").agg(F.collect_set("pos").alias("starts"))


def dedup_lines(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``, and ``n_lines, n_removed`` (which replace columns of these names)."""
    return _cut(docs, lines, ("n_lines", "n_removed"))


def _cut(docs: DataFrame, lines: int, names: tuple[str, str]) -> DataFrame:
    """``dedup_lines`` with the two numbers under other names."""
    windows = stored(line_windows(docs, lines), "lines")
    marks = repeated_windows(windows).select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k"), F.col("starts").alias("_starts"))
    marks = hinted(stored(marks, "marks"), BROADCAST_ROWS)
    key = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    joined = docs.join(marks, (key == marks["_k"]) & docs["doc_id"].eqNullSafe(marks["_d"]), "left")
    joined = joined.withColumn("_line_list", F.split(F.coalesce(docs["text"], F.lit("")), "\n"))
    covered = F.flatten(F.transform(marks["_starts"], lambda s: F.sequence(s, s + (lines - 1))))
    joined = joined.withColumn("_lines_left", F.array_except(F.sequence(F.lit(0), F.size("_line_list") - 1), covered))
    text = F.when(marks["_starts"].isNull(), docs["text"]).otherwise(
        F.array_join(F.transform("_lines_left", lambda i: F.get("_line_list", i)), "\n")
    )
    total = F.size("_line_list").cast("long")
    return joined.select(
        *[text.alias("text") if c == "text" else docs[c] for c in docs.columns if c not in names],
        total.alias(names[0]),
        F.when(marks["_starts"].isNull(), F.lit(0)).otherwise(total - F.size("_lines_left")).cast("long").alias(names[1]),
    )


def without_repeats(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """``docs`` with its own columns alone, without the repeated lines and the documents that they were all of.

    ``n_chars``, where there is one, follows the text.
    """
    out = _cut(docs, lines, ("_n_lines", "_n_removed"))
    cut = F.col("_n_removed") > 0
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(cut, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    gone = cut & (F.translate("text", BLANK_CHARS, "") == "")
    return out.where(~F.coalesce(gone, F.lit(False))).select(*docs.columns)


def op5_line_dedup(spark, sf_dir) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def kept_sql(documents: str = "documents") -> str:
    """DuckDB's form up to ``line_kept(doc_id, t, n_lines, n_removed, kept)``."""
    return f"""
WITH line_docs AS (SELECT DISTINCT doc_id, coalesce(text, '') AS t FROM {documents}),
line_lists AS (SELECT *, string_split(t, chr(10)) AS ls FROM line_docs),
line_runs AS (SELECT doc_id, t, ls, unnest(range(1, len(ls) - {LINES - 2})) AS i FROM line_lists),
line_wins AS (SELECT doc_id, t, i, array_to_string(ls[i:i + {LINES - 1}], chr(10)) AS w FROM line_runs
  WHERE regexp_matches(array_to_string(ls[i:i + {LINES - 1}], ''), '[^\\x20\\x09-\\x0D]')),
line_order AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY doc_id NULLS FIRST, i) AS k FROM line_wins),
line_cells AS (SELECT DISTINCT doc_id, t, unnest(range(i, i + {LINES})) AS p FROM line_order WHERE k > 1),
line_cut AS (SELECT doc_id, t, list(p) AS ps FROM line_cells GROUP BY ALL),
line_kept AS (
  SELECT l.doc_id, l.t, len(ls) AS n_lines, coalesce(len(ps), 0) AS n_removed,
    CASE WHEN ps IS NULL THEN l.t ELSE array_to_string(list_filter(ls, lambda x, i: NOT list_contains(ps, i)), chr(10)) END AS kept
  FROM line_lists l LEFT JOIN line_cut c ON l.doc_id IS NOT DISTINCT FROM c.doc_id AND l.t = c.t)"""


QUERIES = {"op5_line_dedup": op5_line_dedup}
SQL = {
    "op5_line_dedup": kept_sql()
    + """
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE kept END AS text, n_lines::BIGINT AS n_lines, n_removed::BIGINT AS n_removed
FROM documents d JOIN line_kept k ON d.doc_id IS NOT DISTINCT FROM k.doc_id AND coalesce(d.text, '') = k.t"""
}
