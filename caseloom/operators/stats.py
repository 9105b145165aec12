"""Counts over a log.  All weigh variants by their number of cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..eventlog import EventLog
from ..functions import trace as T


def length_histogram(log: EventLog) -> DataFrame:
    return log.weighted().groupBy(F.size("trace").alias("length")).agg(F.sum("occ").alias("cases")).orderBy("length")


def frequency_histogram(log: EventLog) -> DataFrame:
    return log.weighted().groupBy("occ").agg(F.count(F.lit(1)).alias("variants")).orderBy("occ")


def statistics(log: EventLog) -> DataFrame:
    n = F.size("trace")
    one = log.weighted().agg(
        F.sum("occ").alias("cases"), F.count(F.lit(1)).alias("variants"), F.min(n).alias("min_length"), F.max(n).alias("max_length"),
        F.round(F.sum(n * F.col("occ")) / F.sum("occ"), 1).alias("avg_length"),
    )
    return one.crossJoin(F.broadcast(log.alphabet().agg(F.count(F.lit(1)).alias("activities"))))  # one row each


def activity_frequencies(log: EventLog, by_case: bool = False) -> DataFrame:
    """``activity, n``: events, or cases that hold the activity."""
    trace = F.array_distinct("trace") if by_case else F.col("trace")
    return log.weighted().select(F.explode(trace).alias("activity"), "occ").groupBy("activity").agg(F.sum("occ").alias("n"))


def cases_per_activity(log: EventLog) -> DataFrame:
    """Posting list ``activity, case_id`` in long form, so that a frequent activity is not one row."""
    return log.cases.select(F.explode(F.array_distinct("trace")).alias("activity"), "case_id")


def activity_positions(log: EventLog) -> DataFrame:
    """``trace, activity, positions`` of every variant."""
    each = log.weighted().select("trace", F.explode(F.array_distinct("trace")).alias("activity"))
    return each.select("trace", "activity", T.positions(F.col("trace"), F.col("activity")).alias("positions"))


def durations(events: DataFrame, activity: str = "activity", start: str = "start_ts", end: str = "end_ts") -> DataFrame:
    """Mean seconds between start and end of each activity; rows without either are left out."""
    seconds = (F.unix_micros(F.col(end).cast("timestamp")) - F.unix_micros(F.col(start).cast("timestamp"))) / 1e6
    return events.select(F.col(activity).alias("activity"), seconds.alias("s")).where("s is not null").groupBy("activity").agg(F.avg("s").alias("avg_seconds"))


def shares(events: DataFrame, activity: str, name: str) -> DataFrame:
    """Who performed an activity: count, whole percent and exact share."""
    counts = events.where(F.col("activity") == activity).where(~F.col(name).contains("#")).groupBy(F.col(name).alias("who")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("who", "n", F.expr("100 * n div total").alias("pct_int"), (F.col("n") / F.col("total")).alias("share"))
