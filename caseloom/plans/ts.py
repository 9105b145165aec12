"""Transition systems: states and edges as DataFrames, replay by a fold over each variant."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..eventlog import EventLog
from ..functions import trace as T


class Indeterminate(ValueError):
    """A state has two edges with one label."""


class Unfit(ValueError):
    """A case cannot be replayed."""


class TransitionSystem:
    """``states(state[, freq])``, ``edges(src, label, dst[, freq])`` and the name of the first state."""

    def __init__(self, states: DataFrame, edges: DataFrame, initial: str, name: str = "ts"):
        self.states, self.edges, self.initial, self.name = states, edges, initial, name

    @classmethod
    def build(cls, spark: SparkSession, edges: list[tuple[str, str, str]], initial: str, name: str = "ts") -> TransitionSystem:
        names = sorted({initial, *(x for s, _, d in edges for x in (s, d))})
        return cls(spark.createDataFrame([(n,) for n in names], "state string"), spark.createDataFrame(edges, "src string, label string, dst string"), initial, name)

    def with_edges(self, more: DataFrame) -> TransitionSystem:
        edges = self.edges.select("src", "label", "dst").unionByName(more.select("src", "label", "dst")).distinct()
        states = self.states.select("state").unionByName(edges.select(F.explode(F.array("src", "dst")).alias("state"))).distinct()
        return TransitionSystem(states, edges, self.initial, self.name)

    def without_states(self, names: list[str]) -> TransitionSystem:
        edges = self.edges.where(~F.col("src").isin(names) & ~F.col("dst").isin(names))
        return TransitionSystem(self.states.where(~F.col("state").isin(names)), edges, self.initial, self.name)

    def without_edges(self, gone: DataFrame) -> TransitionSystem:
        return TransitionSystem(self.states, self.edges.join(gone, ["src", "label", "dst"], "left_anti"), self.initial, self.name)

    def renamed(self, old: str, new: str) -> TransitionSystem:
        swap = lambda c: F.when(F.col(c) == old, new).otherwise(F.col(c)).alias(c)
        edges = self.edges.select(swap("src"), "label", swap("dst"), *[c for c in self.edges.columns if c == "freq"])
        states = self.states.select(swap("state"), *[c for c in self.states.columns if c != "state"])
        return TransitionSystem(states, edges, new if self.initial == old else self.initial, self.name)

    def signals(self) -> list[str]:
        return [r[0] for r in self.edges.select("label").distinct().orderBy("label").collect()]

    def self_loops(self) -> DataFrame:
        return self.edges.where("src = dst").select("src", "label")

    def out_edges(self, state: str, label: str | None = None) -> DataFrame:
        found = self.edges.where(F.col("src") == state)
        return found if label is None else found.where(F.col("label") == label)

    def in_edges(self, state: str) -> DataFrame:
        return self.edges.where(F.col("dst") == state)

    def book(self) -> dict[tuple[str, str], str]:
        """Edges on the driver: as large as the model."""
        out: dict[tuple[str, str], str] = {}
        for r in self.edges.collect():
            if out.setdefault((r["src"], r["label"]), r["dst"]) != r["dst"]:
                raise Indeterminate(f"{r['src']} has two edges {r['label']}")
        return out


def from_log(log: EventLog, conversion: str = "seq", tail: int = 0) -> TransitionSystem:
    """States are prefixes by their sequence, multiset or set, of the last ``tail`` events if positive."""
    visited = _visits(log, conversion, tail)
    edges = visited.where("label is not null").groupBy("src", "label", "dst").agg(F.sum("occ").alias("freq"))
    states = visited.groupBy(F.col("src").alias("state")).agg(F.sum("occ").alias("freq"))
    return TransitionSystem(states, edges, "", conversion)


def _visits(log: EventLog, conversion: str, tail: int) -> DataFrame:
    """``occ, src, label, dst``: a row for each state a variant visits; the last has no label."""
    t = F.col("trace")
    keys = log.weighted().withColumn("keys", F.transform(F.sequence(F.lit(0), F.size("trace")), lambda i: T.state_key(t, i, conversion, tail)))
    each = keys.select("occ", "trace", "keys", F.posexplode("keys").alias("i", "src"))
    return each.select("occ", "src", F.get("trace", F.col("i")).alias("label"), F.get("keys", F.col("i") + 1).alias("dst"))


def replayed(log: EventLog, ts: TransitionSystem) -> DataFrame:
    """``trace, occ, matched, path``: events replayed from the first state, and the states on the way."""
    book, initial = ts.book(), ts.initial

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            paths = []
            for trace in df["trace"]:
                path = [initial]
                for a in trace:
                    to = book.get((path[-1], a))
                    if to is None:
                        break
                    path.append(to)
                paths.append(path)
            yield df.assign(matched=[len(p) - 1 for p in paths], path=paths)

    return log.weighted().mapInPandas(run, "trace array<string>, occ long, matched int, path array<string>")


def annotated(log: EventLog, ts: TransitionSystem) -> TransitionSystem:
    """Visits of each state and edge, weighted by cases; raises Unfit if a case does not replay."""
    runs = replayed(log, ts)
    if not runs.where(F.col("matched") < F.size("trace")).isEmpty():
        raise Unfit("a case cannot be replayed")
    each = runs.select("occ", "trace", "path", F.posexplode("path").alias("i", "src"))
    visits = each.groupBy(F.col("src").alias("state")).agg(F.sum("occ").alias("freq"))
    moves = each.select("occ", "src", F.get("trace", F.col("i")).alias("label"), F.get("path", F.col("i") + 1).alias("dst")).where("dst is not null")
    counts = moves.groupBy("src", "label", "dst").agg(F.sum("occ").alias("freq"))
    states = ts.states.select("state").join(visits, "state", "left").fillna(0, ["freq"])
    edges = ts.edges.select("src", "label", "dst").join(counts, ["src", "label", "dst"], "left").fillna(0, ["freq"])
    return TransitionSystem(states, edges, ts.initial, ts.name)


def inclusion(log: EventLog, ts: TransitionSystem) -> DataFrame:
    """One row: cases ``excluded`` (no event fits), ``partial`` and ``total``, and the mean share of partial ones."""
    size = F.size("trace")
    kind = F.when(F.col("matched") == size, "total").when(F.col("matched") == 0, "excluded").otherwise("partial")
    rows = replayed(log, ts).withColumn("kind", kind)
    count = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("occ"))), F.lit(0)).alias(k)
    part = F.when(F.col("kind") == "partial", F.col("occ"))
    return rows.agg(count("excluded"), count("partial"), count("total"), (F.sum(part * F.col("matched") / size) / F.sum(part)).alias("avg_partial"))


def included(log: EventLog, ts: TransitionSystem, partial: bool = False) -> EventLog:
    """Cases that fit, with ``partial`` also the fitting prefixes; equal prefixes are added up."""
    rows = replayed(log, ts)
    if partial:
        rows = rows.where("matched > 0").select(F.slice("trace", F.lit(1), F.col("matched")).alias("trace"), "occ")
    else:
        rows = rows.where(F.col("matched") == F.size("trace"))
    return EventLog.from_variants(rows.groupBy("trace").agg(F.sum("occ").alias("occ")))


def state_variants(log: EventLog, ts: TransitionSystem) -> DataFrame:
    """``state, trace, occ``: the variants that visit a state, each once, as far as they replay."""
    return replayed(log, ts).select("trace", "occ", F.explode(F.array_distinct("path")).alias("state")).select("state", "trace", "occ")


def _walk(names: list[str], after: dict[str, list[str]]) -> list[str]:
    """States by depth-first walks from ``names``, the last one left first: only edges back into a walk point backwards."""
    met, out = set(), []
    for root in names:
        todo = [] if root in met else [(root, iter(after[root]))]
        met.add(root)
        while todo:
            state, rest = todo[-1]
            to = next((x for x in rest if x not in met), None)
            if to is None:
                out.append(state)
                todo.pop()
            else:
                met.add(to)
                todo.append((to, iter(after[to])))
    return out[::-1]


def topological_order(ts: TransitionSystem, turn_back: bool = False) -> list[str]:
    """States, sources first.

    A cycle raises, or with ``turn_back`` the edges that close one on a walk from the
    first state count as if they led the other way.
    """
    edges = {(r["src"], r["dst"]) for r in ts.edges.select("src", "dst").distinct().collect()}
    names = [r[0] for r in ts.states.select("state").orderBy("state").collect()]
    if turn_back:
        return _walk([ts.initial, *names], {n: sorted(b for a, b in edges if a == n) for n in {ts.initial, *names}})
    into = dict.fromkeys(names, 0)
    after: dict[str, list[str]] = {n: [] for n in names}
    for a, b in sorted(edges):
        into[b] += 1
        after[a].append(b)
    ready, out = deque(n for n in names if not into[n]), []
    while ready:
        out.append(n := ready.popleft())
        for b in after[n]:
            into[b] -= 1
            if not into[b]:
                ready.append(b)
    if len(out) < len(names):
        raise ValueError("the system has a cycle")
    return out
