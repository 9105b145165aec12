"""Projections, case filters and re-encodings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..eventlog import EventLog
from ..functions import trace as T
from . import stats

ACTIONS = {"keep_if_any": T.contains_any, "keep_if_all": T.only_from, "keep_if_contains_all": T.contains_all}


def project(log: EventLog, activities: Sequence[str], action: str = "keep") -> EventLog:
    """``keep``/``suppress`` events, or keep/suppress cases ``..._if_any``/``..._if_all``.

    ``if_all`` asks whether all activities of the case are listed; ``keep_if_contains_all`` asks the converse.
    """
    if action in ("keep", "suppress"):
        return log.map(lambda t: (T.keep if action == "keep" else T.suppress)(t, activities), drop_empty=True)
    test = ACTIONS[action.replace("suppress", "keep")](F.col("trace"), activities)
    return log.where(~test if action.startswith("suppress") else test)


def most_frequent(frequencies: DataFrame, n: int, extend_same_freq: bool = False) -> DataFrame:
    """The ``n`` most frequent activities, ties by name; with ``extend_same_freq`` all that tie with the last."""
    if not extend_same_freq:
        return frequencies.orderBy(F.desc("n"), "activity").limit(n)
    return frequencies.withColumn("r", F.rank().over(Window.orderBy(F.desc("n")))).where(F.col("r") <= n).drop("r")


def above_threshold(frequencies: DataFrame, threshold: int) -> DataFrame:
    return frequencies.where(F.col("n") >= threshold)


def case_length(log: EventLog, above: int = 0, below: int | None = None) -> EventLog:
    n = F.size("trace")
    return log.where((n >= above) & (n <= below) if below else n >= above)


def initial_activity(log: EventLog) -> EventLog:
    """Cases that begin with the most frequent first activity (ties: the least name)."""
    starts = log.weighted().where(F.size("trace") > 0).groupBy(F.get("trace", F.lit(0)).alias("a")).agg(F.sum("occ").alias("n"))
    best = starts.agg(F.min_by("a", F.struct(-F.col("n"), F.col("a"))).alias("best"))
    return EventLog(log.cases.join(F.broadcast(best), F.get("trace", F.lit(0)) == F.col("best")).select("case_id", "trace"))


def frequency_threshold(log: EventLog, case_min_freq: float | None = None, log_min_freq: float | None = None) -> DataFrame:
    """One row ``t``: the least number of cases of a kept variant; the larger of the two thresholds given."""
    if not case_min_freq and not log_min_freq:
        raise TypeError("give case_min_freq or log_min_freq")
    classes = log.weighted().groupBy("occ").agg(F.sum("occ").alias("cases"))
    order = Window.orderBy(F.desc("occ")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # a row for each distinct count of cases, not for each case or variant
    cum = classes.withColumn("cum", F.sum("cases").over(order)).withColumn("total", F.sum("cases").over(Window.partitionBy()))
    ts = []
    if case_min_freq:
        whole = case_min_freq == int(case_min_freq)
        ts.append(F.lit(int(case_min_freq)) if whole else F.greatest(F.floor(F.max("total") * case_min_freq), F.lit(1)))
    if log_min_freq:
        target = F.lit(int(log_min_freq)) if log_min_freq == int(log_min_freq) else F.floor(F.col("total") * log_min_freq)
        ts.append(F.coalesce(F.max(F.when(F.col("cum") >= target, F.col("occ"))), F.min("occ")))
    return cum.agg((F.greatest(*ts) if len(ts) > 1 else ts[0]).alias("t"))


def frequent_variants(log: EventLog, **bounds: float) -> EventLog:
    t = frequency_threshold(log, **bounds)
    kept = log.weighted().crossJoin(F.broadcast(t)).where("occ >= t").select("trace", "occ")
    return EventLog(log.cases.join(kept.select("trace"), "trace", "left_semi").select("case_id", "trace"), weighted=kept)


def _unique_edge(log: EventLog, at: int, strict: bool) -> bool:
    rest = T.interior(F.col("trace")) if not strict else (F.slice("trace", F.lit(2), F.size("trace")) if at == 0 else F.slice("trace", F.lit(1), F.size("trace") - 1))
    edge = F.element_at("trace", 1 if at == 0 else -1)
    some = log.weighted().where(F.size("trace") > 0).select(edge.alias("e"), rest.alias("rest"))
    row = some.agg(F.min("e").alias("a"), F.max("e").alias("b"), F.max(F.array_contains("rest", F.col("e"))).alias("again")).first()
    return row["a"] is not None and row["a"] == row["b"] and not row["again"]


def has_unique_start(log: EventLog, strict: bool = False) -> bool:
    """One first activity, which does not recur inside (with ``strict``: nor at the end)."""
    return _unique_edge(log, 0, strict)


def has_unique_end(log: EventLog, strict: bool = False) -> bool:
    return _unique_edge(log, 1, strict)


def _unused(log: EventLog, candidates: Sequence[str]) -> str | None:
    used = set(log.names())
    return next((c for c in candidates if c not in used), None)


def add_start(log: EventLog, candidates: Sequence[str] = ("S", "start", "begin")) -> EventLog | None:
    name = _unused(log, candidates)
    return name and log.map(lambda t: F.concat(F.array(F.lit(name)), t))


def add_end(log: EventLog, candidates: Sequence[str] = ("E", "final", "end")) -> EventLog | None:
    name = _unused(log, candidates)
    return name and log.map(lambda t: F.concat(t, F.array(F.lit(name))))


def conditioned(log: EventLog) -> EventLog:
    """Clean names, and one start and one end activity, added where needed."""
    log = log.map(T.stripped)
    if not has_unique_start(log):
        log = add_start(log) or log
    return log if has_unique_end(log) else add_end(log) or log


class NotInvertible(ValueError):
    """Two names have the same code."""


def first_seen(log: EventLog) -> list[str]:
    """Activities by the least (case id, position) they occur at."""
    e = log.events.groupBy("activity").agg(F.min(F.struct("case_id", "pos")).alias("at"))
    return [r[0] for r in e.orderBy("at", "activity").select("activity").collect()]


def alpha_code(i: int) -> str:
    """0 -> a, 25 -> z, 26 -> aa."""
    out, i = "", i + 1
    while i:
        i, d = divmod(i - 1, 26)
        out = chr(97 + d) + out
    return out


def alpha_dictionary(log: EventLog) -> dict[str, str]:
    return {a: alpha_code(i) for i, a in enumerate(first_seen(log))}


def number_dictionary(log: EventLog, prefix: str = "e") -> dict[str, str]:
    return {a: f"{prefix}{i}" for i, a in enumerate(first_seen(log))}


def decoder(codes: Mapping[str, str]) -> dict[str, str]:
    out = {v: k for k, v in codes.items()}
    if len(out) < len(codes):
        raise NotInvertible("two names have the same code")
    return out


def reencode(log: EventLog, codes: Mapping[str, str]) -> EventLog:
    """Replace names; a name without a code fails the query.  Variants that meet are added up."""
    spark = log.cases.sparkSession
    book = F.broadcast(spark.createDataFrame(list(codes.items()), "activity string, code string"))  # the alphabet
    each = log.cases.select("case_id", F.posexplode_outer("trace").alias("pos", "activity")).join(book, "activity", "left")
    known = F.when(F.col("activity").isNull() | F.col("code").isNotNull(), F.col("code")).otherwise(F.raise_error(F.concat(F.lit("no code for "), "activity")).cast("string"))
    rows = each.withColumn("code", known).groupBy("case_id").agg(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "code")))).alias("x"))
    return EventLog(rows.select("case_id", F.col("x.code").alias("trace")))
