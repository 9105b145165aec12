"""Logs from and to text, CSV, XES, JSON and Parquet."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..eventlog import EventLog

RENAMED = {"concept:name": "name", "lifecycle:transition": "transition", "time:timestamp": "timestamp"}
KINDS = ("string", "date", "int", "float", "boolean", "id")


def read_log(spark: SparkSession, path: str, format: str | None = None, **options) -> EventLog | DataFrame:
    """``raw``, ``xes``, ``xes_all`` or ``csv``; ``.tr`` and ``.xes``, also with ``.gz``, are told by name."""
    if format is None:
        name = path.removesuffix(".gz")
        format = {"tr": "raw", "xes": "xes"}.get(name.rsplit(".", 1)[-1])
        if format is None:
            raise TypeError(f"cannot tell the format of {path}")
    readers = {"raw": read_raw, "xes": read_xes, "xes_all": read_xes_events, "csv": read_csv}
    if format not in readers:
        raise ValueError(f"unknown format {format!r}")
    return readers[format](spark, path, **options)


def _parsed(lines: DataFrame, marks: str, f: Callable[[Column], Column] | None) -> EventLog:
    words = lines.select("case_id", F.filter(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " "), lambda w: w != "").alias("trace"))
    words = words.where(F.size("trace") > 0)
    if marks:
        words = words.where(~F.substring(F.get("trace", F.lit(0)), 1, 1).isin(*marks))
    log = EventLog(words)
    return log.map(f) if f else log


def read_raw(spark: SparkSession, path: str, comment_marks: str = "#", reencoder: Callable[[Column], Column] | None = None) -> EventLog:
    """A case a line, activities between blanks; lines that begin with a comment mark are left out."""
    lines = spark.read.text(path).select("value", F.format_string("%s:%020d", F.col("_metadata.file_name"), F.monotonically_increasing_id()).alias("case_id"))
    return _parsed(lines, comment_marks, reencoder)


def from_lines(spark: SparkSession, lines: Iterable[str], comment_marks: str = "#", reencoder: Callable[[Column], Column] | None = None) -> EventLog:
    rows = [(f"{i:09d}", x) for i, x in enumerate(lines)]
    return _parsed(spark.createDataFrame(rows, "case_id string, value string"), comment_marks, reencoder)


def read_csv(spark: SparkSession, path: str, columns: Sequence[int] = (0, 1, 2, 3), delimiter: str = ",", timestamp_format: str | None = None, header: bool = False) -> EventLog:
    """Columns are case, activity, start and, if there are four, end.

    Rows with ``#`` in the case column are left out.  Events are ordered by the start text, or by
    its time where a format is given, and then by their place in the file.
    """
    if len(columns) not in (3, 4):
        raise ValueError("give three or four columns")
    width = max(columns) + 1
    raw = spark.read.schema(", ".join(f"c{i} string" for i in range(width))).option("sep", delimiter).option("header", header).csv(path)
    raw = raw.withColumn("line", F.monotonically_increasing_id()).where(~F.col(f"c{columns[0]}").contains("#"))
    when = lambda i: F.to_timestamp(f"c{i}", timestamp_format) if timestamp_format else F.col(f"c{i}")
    end = when(columns[3]) if len(columns) == 4 else None
    return EventLog.from_events(raw, f"c{columns[0]}", f"c{columns[1]}", [when(columns[2]), "line"], start=when(columns[2]), end=end)


def _xes(spark: SparkSession, path: str) -> DataFrame:
    attribute = "array<struct<_key:string,_value:string>>"
    kinds = ",".join(f"`{k}`:{attribute}" for k in KINDS)
    schema = f"event array<struct<{kinds}>>, {', '.join(f'`{k}` {attribute}' for k in KINDS)}"
    rows = spark.read.format("xml").option("rowTag", "trace").schema(schema).load(path)
    return rows.select(F.format_string("%020d", F.monotonically_increasing_id()).alias("case_id"), F.coalesce("event", F.array().cast(f"array<struct<{kinds}>>")).alias("event"))


def read_xes(spark: SparkSession, path: str) -> EventLog:
    """The ``concept:name`` of each event; events without one are left out, empty traces stay."""
    names = F.transform("event", lambda e: F.filter(F.coalesce(e["string"], F.array().cast("array<struct<_key:string,_value:string>>")), lambda a: a["_key"] == "concept:name"))
    return EventLog(_xes(spark, path).select("case_id", F.transform(F.flatten(names), lambda a: a["_value"]).alias("trace")))


def read_xes_events(spark: SparkSession, path: str) -> DataFrame:
    """``case_id, pos, attrs``: all first-level attributes of each event; of equal keys the last holds."""
    empty = F.array().cast("array<struct<_key:string,_value:string>>")
    each = _xes(spark, path).select("case_id", F.posexplode("event").alias("pos", "e"))
    pairs = each.select("case_id", "pos", F.posexplode(F.concat(*[F.coalesce(F.col("e")[k], empty) for k in KINDS])).alias("i", "a"))
    key = F.coalesce(F.create_map(*[F.lit(x) for kv in RENAMED.items() for x in kv])[F.col("a._key")], F.col("a._key"))
    last = pairs.groupBy("case_id", "pos", key.alias("k")).agg(F.max_by(F.col("a._value"), "i").alias("v"))
    return last.groupBy("case_id", "pos").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("attrs"))


def write_raw(log: EventLog, path: str, variants: bool = False) -> None:
    rows = log.weighted() if variants else log.cases
    rows.select(F.concat_ws(" ", "trace").alias("value")).write.mode("overwrite").text(path)


def write_xes(log: EventLog, path: str) -> None:
    """XES 1.0 with the concept and lifecycle extensions, a folder of files each of whole traces."""
    pair = lambda k, v: F.struct(F.lit(k).alias("_key"), v.alias("_value"))
    event = lambda a: F.struct(F.array(pair("concept:name", a), pair("lifecycle:transition", F.lit("complete"))).alias("string"))
    rows = log.cases.select(F.array(pair("concept:name", F.concat(F.lit("case"), "case_id"))).alias("string"), F.transform("trace", event).alias("event"))
    rows.write.mode("overwrite").format("xml").option("rootTag", 'log xes.version="1.0" xmlns="http://www.xes-standard.org/"').option("rowTag", "trace").save(path)


def write_json(log: EventLog, path: str) -> None:
    log.cases.write.mode("overwrite").json(path)


def write_dictionary(spark: SparkSession, codes: dict[str, str], path: str) -> None:
    spark.createDataFrame(list(codes.items()), "src string, dst string").coalesce(1).write.mode("overwrite").json(path)


def read_dictionary(spark: SparkSession, path: str) -> dict[str, str]:
    return {r["src"]: r["dst"] for r in spark.read.schema("src string, dst string").json(path).collect()}
