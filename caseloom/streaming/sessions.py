"""Logs from streams of events: sessions as cases, and directly-follows counts that carry state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_cases(events: DataFrame, key: str, activity: str, ts: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """``key, start, end, trace``: a case ends after ``gap`` without an event; events later than ``late`` are dropped."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    window = F.session_window(ts, gap)
    found = rows.groupBy(key, window).agg(F.array_sort(F.collect_list(F.struct(F.col(ts).alias("t"), F.col(activity).alias("a")))).alias("e"))
    return found.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), F.col("e.a").alias("trace"))


def windowed_counts(events: DataFrame, activity: str, ts: str, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events of each activity by tumbling or sliding window."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    return rows.groupBy(window, F.col(activity).alias("activity")).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "activity", "n")


def follows(events: DataFrame, key: str, activity: str, ts: str, idle: str = "1 hour") -> DataFrame:
    """``a, b`` of each step of a key, across batches; a key that is idle for so long starts anew.

    The state is the last activity of a key.  Works on streams only; sum the rows for counts.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    limit = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(_, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(frames).sort_values(["ts", "activity"], kind="stable")
        names = ([state.get[0]] if state.exists else []) + rows["activity"].tolist()
        state.update((names[-1],))
        state.setTimeoutDuration(limit)
        yield pd.DataFrame({"a": names[:-1], "b": names[1:]})

    rows = events.select(F.col(key).cast("string").alias("k"), F.col(activity).alias("activity"), F.col(ts).cast("timestamp").alias("ts"))
    return rows.groupBy("k").applyInPandasWithState(step, "a string, b string", "last string", "append", GroupStateTimeout.ProcessingTimeTimeout)
