"""Clusterings: a log with a ``cluster`` column."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..eventlog import EventLog
from ..functions import trace as T
from ..storage import placed


def balanced(log: EventLog, k: int) -> DataFrame:
    """Runs of cases by id whose sizes differ by one at most, the larger ones first."""
    ranked, total = placed(log.cases.select("case_id", "trace"), [F.col("case_id")], "at")
    size, extra = divmod(total, k)
    at, long = F.col("at"), extra * (size + 1)
    cluster = F.when(at < long, F.floor(at / (size + 1))).otherwise(extra + F.floor((at - long) / max(size, 1)))
    return ranked.select("case_id", "trace", cluster.cast("int").alias("cluster"))


def _alphabets(log: EventLog) -> list[tuple[frozenset, int]]:
    """Distinct sets of activities with their numbers of variants: the unit of the driver's loops."""
    sets = log.weighted().select(F.array_sort(F.array_distinct("trace")).alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    return [(frozenset(r["s"]), r["n"]) for r in sets.orderBy("s").collect()]


def _assigned(log: EventLog, clusters: list[list[frozenset]]) -> DataFrame:
    rows = [(sorted(s), i) for i, c in enumerate(clusters) for s in c]
    book = log.cases.sparkSession.createDataFrame(rows, "s array<string>, cluster int")
    return log.cases.withColumn("s", F.array_sort(F.array_distinct("trace"))).join(F.broadcast(book), "s").select("case_id", "trace", "cluster")


def optional(log: EventLog, threshold: int) -> DataFrame:
    """Split variants by the activity that halves them best until clusters hold ``threshold`` variants at most."""
    todo, leaves = [_alphabets(log)], []
    while todo:
        node = todo.pop()
        total = sum(n for _, n in node)
        count = {a: sum(n for s, n in node if a in s) for a in sorted(frozenset().union(*(s for s, _ in node)))}
        options = [a for a, n in count.items() if 0 < n < total]
        if total <= threshold or not options:
            leaves.append([s for s, _ in node])
            continue
        best = min(options, key=lambda a: (abs(count[a] - total // 2), a))
        todo += [[x for x in node if best in x[0]], [x for x in node if best not in x[0]]]
    return _assigned(log, leaves)


def max_alphabet(log: EventLog, threshold: int) -> DataFrame:
    """Greedy clusters whose alphabets hold ``threshold`` activities at most; the rest is the last cluster."""
    left = sorted((s for s, _ in _alphabets(log)), key=lambda s: (len(s), sorted(s)))
    clusters = []
    while left and len(left[0]) <= threshold:
        have, members = frozenset(left[0]), []
        while True:
            members += [s for s in left if s <= have]
            left = [s for s in left if not s <= have]
            fits = [s for s in left if len(s | have) <= threshold]
            if not fits:
                break
            have |= min(fits, key=lambda s: (len(s - have), sorted(s)))
        clusters.append(members)
    return _assigned(log, [*clusters, left] if left else clusters)


def exclusive(log: EventLog) -> DataFrame:
    """The two activities that exclude each other and cover most cases: has a (0), has b (1), neither (2)."""
    names = log.alphabet()
    has = log.weighted().select("occ", F.array_sort(F.array_distinct("trace")).alias("s"))
    per = has.select("occ", F.explode("s").alias("x")).groupBy("x").agg(F.sum("occ").alias("n"))
    pairs = has.select("s", F.posexplode("s").alias("i", "a")).select("a", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("b")).distinct()
    a, b = names.select(F.col("activity").alias("a")), names.select(F.col("activity").alias("b"))
    never = a.join(b, F.col("a") < F.col("b")).join(pairs, ["a", "b"], "left_anti")  # pairs of the alphabet
    na, nb = per.select(F.col("x").alias("a"), F.col("n").alias("na")), per.select(F.col("x").alias("b"), F.col("n").alias("nb"))
    best = never.join(na, "a").join(nb, "b").orderBy(F.desc(F.col("na") + F.col("nb")), "a", "b").limit(1).select("a", "b")
    holds = lambda c: F.coalesce(F.array_contains("trace", F.col(c)), F.lit(False))
    rows = log.cases.join(F.broadcast(best), F.lit(True), "left")
    return rows.select("case_id", "trace", F.when(holds("a"), 0).when(holds("b"), 1).otherwise(2).alias("cluster"))


def parikh_vectors(log: EventLog) -> DataFrame:
    """``trace, occ, vector``: occurrences by the sorted alphabet."""
    return log.weighted().select("trace", "occ", T.parikh(F.col("trace"), log.names()).alias("vector"))


def similar(log: EventLog, k: int = 2, seed: int = 1) -> DataFrame:
    """k-means of the Parikh vectors, distributed."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = parikh_vectors(log).select("trace", "occ", array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed, weightCol="occ").fit(rows)
    return model.transform(rows).select("trace", "occ", F.col("prediction").alias("cluster"))


def hierarchical(log: EventLog, limit: int = 2000) -> list[tuple[int, int, float, int]]:
    """Average linkage of the distinct Parikh vectors less their minimum: merges ``(left, right, distance, size)``.

    The distance matrix is quadratic in the vectors; above ``limit`` of them this raises, and ``similar`` with more
    clusters is the way that scales.
    """
    least = F.transform("vector", lambda x: x - F.array_min("vector"))
    rows = parikh_vectors(log).select(least.alias("v")).distinct().orderBy("v").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} distinct vectors")
    x = np.array([r["v"] for r in rows], float)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    ids, sizes, merges = list(range(len(x))), [1] * len(x), []
    for step in range(len(x) - 1):
        i, j = sorted(divmod(int(d.argmin()), len(d)))
        merges.append((ids[i], ids[j], float(d[i, j]), sizes[i] + sizes[j]))
        d[i] = (d[i] * sizes[i] + d[j] * sizes[j]) / (sizes[i] + sizes[j])
        d[:, i] = d[i]
        d[i, i] = np.inf
        ids[i], sizes[i] = len(x) + step, sizes[i] + sizes[j]
        d = np.delete(np.delete(d, j, 0), j, 1)
        del ids[j], sizes[j]
    return merges
