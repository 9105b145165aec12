"""Succession counts and dependency measures of the heuristic miner."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..eventlog import EventLog
from ..functions import trace as T


def direct_succession(log: EventLog) -> DataFrame:
    """``a, b, n``: b right after a."""
    pairs = log.weighted().select("occ", F.explode(T.steps(F.col("trace"))).alias("p"))
    return pairs.groupBy("p.a", "p.b").agg(F.sum("occ").alias("n"))


def two_loops(log: EventLog) -> DataFrame:
    """``a, b, n``: a, b, a."""
    n = F.greatest(F.size("trace") - 2, F.lit(0))
    part = lambda k: F.slice("trace", F.lit(k), n)
    triples = log.weighted().select("occ", F.explode(F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("c"))).alias("p"))
    return triples.where("p.a = p.c").groupBy("p.a", "p.b").agg(F.sum("occ").alias("n"))


def eventual_succession(log: EventLog) -> DataFrame:
    """``a, b, n``: b anywhere after a, each pair of events; from the tails of each variant."""
    tails = log.weighted().select("occ", "trace", F.posexplode("trace").alias("i", "a"))
    later = tails.select("occ", "a", F.explode(F.slice("trace", F.col("i") + 2, F.size("trace"))).alias("b"))
    return later.groupBy("a", "b").agg(F.sum("occ").alias("n"))


def dependencies(log: EventLog) -> DataFrame:
    """``a, b, n, dep, l2l`` of every pair that is adjacent in some order (all others have dep 0)."""
    ds, tl = direct_succession(log), two_loops(log)
    flip = lambda d: d.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("n").alias("m"))
    both = ds.join(flip(ds), ["a", "b"], "full").fillna(0, ["n", "m"])
    loops = tl.join(flip(tl), ["a", "b"], "full").fillna(0, ["n", "m"]).select("a", "b", ((F.col("n") + F.col("m")) / (F.col("n") + F.col("m") + 1)).alias("l2l"))
    dep = F.when(F.col("a") == F.col("b"), F.col("n") / (F.col("n") + 1)).otherwise((F.col("n") - F.col("m")) / (F.col("n") + F.col("m") + 1))
    return both.select("a", "b", "n", dep.alias("dep")).join(loops, ["a", "b"], "left").fillna(0.0, ["l2l"])


def flexible_heuristic_miner(log: EventLog, l1loop: float = 0.9, general: float = 0.9) -> DataFrame:
    """``a, b``: arcs whose dependency reaches the threshold of their kind."""
    dep = dependencies(log)
    return dep.where(((F.col("a") == F.col("b")) & (F.col("dep") >= l1loop)) | ((F.col("a") != F.col("b")) & (F.col("dep") >= general))).select("a", "b")


def footprint(log: EventLog) -> DataFrame:
    """``a, b, relation`` in ``-> <- || #`` for every pair of the alphabet."""
    names = log.alphabet()
    ds = direct_succession(log).select("a", "b")
    # the alphabet squared, as large as the table that is asked for
    every = names.select(F.col("activity").alias("a")).join(names.select(F.col("activity").alias("b")), F.lit(True))
    there = ds.withColumn("f", F.lit(1))
    back = ds.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(1).alias("g"))
    rel = F.when(F.col("f").isNotNull() & F.col("g").isNotNull(), "||").when(F.col("f").isNotNull(), "->").when(F.col("g").isNotNull(), "<-").otherwise("#")
    return every.join(there, ["a", "b"], "left").join(back, ["a", "b"], "left").select("a", "b", rel.alias("relation"))
