"""Event logs.

The events are the source of truth; cases (one row a case) and variants (one row
a distinct trace with its number of cases) are derived.  Statistics, discovery and
conformance run on variants, so their cost follows the number of distinct traces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import placed


class EventLog:
    """``cases``: ``case_id, trace``; ``events``: the long form where it is known."""

    def __init__(self, cases: DataFrame, events: DataFrame | None = None, weighted: DataFrame | None = None):
        self.cases, self._events, self._weighted = cases, events, weighted

    @classmethod
    def from_events(cls, df: DataFrame, case: Column | str, activity: Column | str, order: Sequence[Column | str], start=None, end=None, attrs: Sequence[str] = ()) -> EventLog:
        """Events without an activity are dropped; ``order`` must break all ties to be deterministic."""
        col = lambda c: F.col(c) if isinstance(c, str) else c
        keys = [col(c).alias(f"o{i}") for i, c in enumerate(order)]
        more = [col(c).alias(n) for c, n in ((start, "start_ts"), (end, "end_ts")) if c is not None]
        if attrs:
            more.append(F.create_map(*[x for a in attrs for x in (F.lit(a), F.col(a).cast("string"))]).alias("attrs"))
        events = df.select(col(case).cast("string").alias("case_id"), col(activity).cast("string").alias("activity"), *keys, *more).where("activity is not null")
        place = F.struct(*[f"o{i}" for i in range(len(keys))], "activity")
        cases = events.groupBy("case_id").agg(F.array_sort(F.collect_list(place)).alias("e")).select("case_id", F.col("e.activity").alias("trace"))
        within = Window.partitionBy("case_id").orderBy(*[f"o{i}" for i in range(len(keys))], "activity")
        return cls(cases, events.withColumn("pos", F.row_number().over(within) - 1).drop(*[f"o{i}" for i in range(len(keys))]))

    @classmethod
    def from_traces(cls, spark: SparkSession, traces: Iterable[Sequence[str]]) -> EventLog:
        rows = [(str(i), list(t)) for i, t in enumerate(traces)]
        return cls(spark.createDataFrame(rows, "case_id string, trace array<string>"))

    @classmethod
    def from_variants(cls, variants: DataFrame) -> EventLog:
        """``trace, occ``: every case of a variant is made again where cases are asked for."""
        each = variants.select("trace", F.explode(F.sequence(F.lit(1).cast("long"), F.col("occ").cast("long"))).alias("k"))
        case_id = F.concat_ws("#", F.concat_ws(",", "trace"), F.col("k").cast("string"))
        return cls(each.select(case_id.alias("case_id"), "trace"), weighted=variants.select("trace", "occ"))

    @property
    def events(self) -> DataFrame:
        if self._events is not None:
            return self._events
        return self.cases.select("case_id", F.posexplode("trace").alias("pos", "activity"))

    def weighted(self) -> DataFrame:
        """``trace, occ`` without an id: one partial count before the shuffle."""
        if self._weighted is not None:
            return self._weighted
        return self.cases.groupBy("trace").agg(F.count(F.lit(1)).alias("occ"))

    def variants(self) -> DataFrame:
        """``variant_id, trace, occ, len``; ids by descending count, then by trace."""
        ranked, _ = placed(self.weighted(), [F.desc("occ"), F.col("trace")], "variant_id")
        return ranked.select(F.col("variant_id").cast("int").alias("variant_id"), "trace", "occ", F.size("trace").alias("len"))

    def map(self, f: Callable[[Column], Column], drop_empty: bool = False) -> EventLog:
        """Apply a trace expression; equal results of different variants are added up."""
        cases = self.cases.select("case_id", f(F.col("trace")).alias("trace"))
        return EventLog(cases.where(F.size("trace") > 0) if drop_empty else cases)

    def where(self, condition: Column | str) -> EventLog:
        return EventLog(self.cases.where(condition))

    def union(self, other: EventLog) -> EventLog:
        """Bag union; case ids get the side's number in front."""
        left, right = (x.cases.select(F.concat(F.lit(f"{k}/"), "case_id").alias("case_id"), "trace") for k, x in ((0, self), (1, other)))
        return EventLog(left.unionByName(right))

    def alphabet(self) -> DataFrame:
        return self.weighted().select(F.explode("trace").alias("activity")).distinct()

    def names(self) -> list[str]:
        """The alphabet on the driver, sorted: as large as the model, not as the log."""
        return [r[0] for r in self.alphabet().orderBy("activity").collect()]
