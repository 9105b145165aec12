"""Noise: one edit in a share of the cases, chosen by a hash of case id and seed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..eventlog import EventLog


def _draw(seed: int, salt: int, n: Column | int) -> Column:
    """A whole number below ``n`` for each case."""
    return F.pmod(F.xxhash64("case_id", F.lit(seed), F.lit(salt)), F.greatest(F.lit(n) if isinstance(n, int) else n, F.lit(1)).cast("long")).cast("int")


def _swap(t: Column, i: Column, j: Column) -> Column:
    return F.transform(t, lambda x, k: F.when(k == i, F.get(t, j)).when(k == j, F.get(t, i)).otherwise(x))


def add_noise(log: EventLog, kind: str = "single", perror: float = 0.05, seed: int = 1) -> EventLog:
    """``single``: delete, swap or insert an event; ``maruster``: delete a run of the first, middle or last third, or swap.

    Traces too short for their edit stay as they are.
    """
    names = F.array(*map(F.lit, log.names()))
    t, n = F.col("trace"), F.size("trace")
    hit = F.pmod(F.xxhash64("case_id", F.lit(seed)), F.lit(1_000_000)) < int(perror * 1_000_000)
    i, j = _draw(seed, 1, n), _draw(seed, 2, n)
    swapped = _swap(t, i, j)
    cut = lambda a, b: F.concat(F.slice(t, F.lit(1), a), F.slice(t, b + 2, n))  # noqa: E731  without events a..b
    if kind == "single":
        new = F.get(names, _draw(seed, 3, F.size(names)))
        at = _draw(seed, 4, n + 1)
        inserted = F.concat(F.slice(t, F.lit(1), at), F.array(new), F.slice(t, at + 1, n))
        which = _draw(seed, 5, 3)
        edit = F.when(which == 0, F.when(n > 1, cut(i, i)).otherwise(t)).when(which == 1, F.when(n > 1, swapped).otherwise(t)).otherwise(inserted)
    elif kind == "maruster":
        third = F.floor(n / 3).cast("int")
        a, b = _draw(seed, 6, third), _draw(seed, 7, third)
        which = _draw(seed, 8, 4)
        begin = third * which
        run = cut(begin + F.least(a, b), begin + F.greatest(a, b))
        edit = F.when(n < 3, t).when(which == 3, swapped).otherwise(run)
    else:
        raise TypeError(f"unknown noise {kind!r}")
    return EventLog(log.cases.select("case_id", F.when(hit, edit).otherwise(t).alias("trace")))
