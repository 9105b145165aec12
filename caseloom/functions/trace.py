"""Column expressions over a trace, an array of activity names.  ``t`` should be a plain column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def keep(t: Column, activities: Sequence[str]) -> Column:
    return F.filter(t, lambda x: x.isin(*activities))


def suppress(t: Column, activities: Sequence[str]) -> Column:
    return F.filter(t, lambda x: ~x.isin(*activities))


def contains_any(t: Column, activities: Sequence[str]) -> Column:
    return F.arrays_overlap(t, _names(activities))


def only_from(t: Column, activities: Sequence[str]) -> Column:
    """Every activity of the case is listed."""
    return F.forall(t, lambda x: x.isin(*activities))


def contains_all(t: Column, activities: Sequence[str]) -> Column:
    return F.size(F.array_except(_names(activities), t)) == 0


def _names(activities: Sequence[str]) -> Column:
    return F.array(*map(F.lit, activities)).cast("array<string>")


def collapse(t: Column) -> Column:
    """Runs of an activity become one event."""
    return F.filter(t, lambda x, i: (i == 0) | (x != F.get(t, i - 1)))


def prefixed(t: Column, prefix: str) -> Column:
    return F.transform(t, lambda x: F.concat(F.lit(prefix), x))


def stripped(t: Column, chars: str = " '.\t_()-+&") -> Column:
    """Names without the characters that model files reject."""
    return F.transform(t, lambda x: F.translate(x, chars, ""))


def steps(t: Column, gap: int = 1) -> Column:
    """``struct(a, b)`` of events ``gap`` apart; empty for shorter traces."""
    n = F.greatest(F.size(t) - gap, F.lit(0))
    return F.arrays_zip(F.slice(t, F.lit(1), n).alias("a"), F.slice(t, F.lit(1 + gap), n).alias("b"))


def positions(t: Column, activity: Column | str) -> Column:
    at = F.transform(t, lambda x, i: F.when(x == activity, i))
    return F.filter(at, lambda i: i.isNotNull())


def parikh(t: Column, alphabet: Sequence[str]) -> Column:
    """Occurrences of each activity of ``alphabet``."""
    def count(a: str) -> Column:
        return F.size(F.filter(t, lambda x: x == a))

    return F.array(*map(count, alphabet))


def interior(t: Column) -> Column:
    """All but the first and the last event."""
    return F.slice(t, F.lit(2), F.greatest(F.size(t) - 2, F.lit(0)))


def state_key(t: Column, upto: Column, kind: str, tail: int = 0) -> Column:
    """Abstraction of the first ``upto`` events: their sequence, multiset or set, of the last ``tail`` if positive."""
    first = F.greatest(upto - tail, F.lit(0)) if tail else F.lit(0)
    part = F.slice(t, first + 1, upto - first)
    if kind == "mset":
        part = F.array_sort(part)
    elif kind == "set":
        part = F.array_sort(F.array_distinct(part))
    elif kind != "seq":
        raise TypeError(f"unknown conversion {kind!r}")
    return F.concat_ws(",", part)
