"""Petri nets: a small driver object; replay and simulation run on the executors."""

from __future__ import annotations

import random
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..eventlog import EventLog
from .ts import TransitionSystem, Unfit

Marking = tuple[int, ...]


@dataclass
class PetriNet:
    """``arcs``: (source, target) -> weight.  ``labels``: transition -> activity, None for a silent one."""

    name: str = "net"
    initial: dict[str, int] = field(default_factory=dict)  # place -> tokens; every place is a key
    labels: dict[str, str | None] = field(default_factory=dict)
    arcs: dict[tuple[str, str], int] = field(default_factory=dict)
    capacity: dict[str, int] = field(default_factory=dict)

    def place(self, name: str, tokens: int = 0, capacity: int = 0) -> str:
        self.initial[name] = tokens
        if capacity:
            self.capacity[name] = capacity
        return name

    def transition(self, name: str, label: str | None = "", silent: bool = False) -> str:
        self.labels[name] = None if silent else (label or name)
        return name

    def arc(self, a: str, b: str, weight: int = 1) -> None:
        if (a in self.initial) == (b in self.initial):
            raise ValueError("an arc joins a place and a transition")
        self.arcs[a, b] = weight

    @property
    def places(self) -> list[str]:
        return sorted(self.initial)

    def tables(self) -> tuple[list[str], Marking, dict[str, tuple[list[tuple[int, int]], list[tuple[int, int]]]]]:
        """Places, the first marking, and (inputs, outputs) of each transition as (place number, weight)."""
        places = self.places
        at = {p: i for i, p in enumerate(places)}
        moves: dict[str, tuple[list, list]] = {t: ([], []) for t in self.labels}
        for (a, b), w in self.arcs.items():
            if a in at:
                moves[b][0].append((at[a], w))
            else:
                moves[a][1].append((at[b], w))
        return places, tuple(self.initial[p] for p in places), moves

    def connected(self, yes: bool = True) -> list[str]:
        """Transitions with (without) places."""
        ends = {x for a in self.arcs for x in a}
        return sorted(t for t in self.labels if (t in ends) == yes)

    def nodes_df(self, spark: SparkSession) -> DataFrame:
        rows = [(p, "place", self.initial[p], self.capacity.get(p, 0), False) for p in self.places]
        rows += [(t, "transition", 0, 0, self.labels[t] is None) for t in sorted(self.labels)]
        return spark.createDataFrame(rows, "name string, type string, init int, capacity int, dummy boolean")

    def arcs_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(a, b, w) for (a, b), w in sorted(self.arcs.items())], "src string, dst string, weight int")


def enabled(moves: dict, marking: Marking) -> list[str]:
    return [t for t, (need, _) in moves.items() if all(marking[p] >= w for p, w in need)]


def fire(moves: dict, marking: Marking, t: str) -> Marking:
    out = list(marking)
    for p, w in moves[t][0]:
        out[p] -= w
        if out[p] < 0:
            raise ValueError(f"{t} is not enabled")
    for p, w in moves[t][1]:
        out[p] += w
    return tuple(out)


def _by_label(net: PetriNet) -> dict[str, str]:
    return {label: t for t, label in sorted(net.labels.items(), reverse=True) if label is not None}


def replay(net: PetriNet, trace: list[str]) -> list[Marking] | None:
    """Markings along a strict replay without silent moves; None if an event is unknown or not enabled."""
    _, marking, moves = net.tables()
    names, out = _by_label(net), [marking]
    for a in trace:
        t = names.get(a)
        if t is None or any(marking[p] < w for p, w in moves[t][0]):
            return None
        marking = fire(moves, marking, t)
        out.append(marking)
    return out


def replays(log: EventLog, net: PetriNet) -> DataFrame:
    """``trace, occ, fits, peak``: peak is the most tokens of each place (by sorted name)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            got = [replay(net, list(t)) for t in df["trace"]]
            yield df.assign(fits=[g is not None for g in got], peak=[[max(c) for c in zip(*g, strict=True)] if g else None for g in got])

    return log.weighted().mapInPandas(run, "trace array<string>, occ long, fits boolean, peak array<int>")


def fitness(log: EventLog, net: PetriNet) -> DataFrame:
    """One row: the share of cases that replay."""
    fits = F.sum(F.when(F.col("fits"), F.col("occ")).otherwise(0))
    return replays(log, net).agg((fits / F.sum("occ")).alias("fitness"))


def compute_capacity(log: EventLog, net: PetriNet) -> dict[str, int]:
    """Most tokens of each place over all replays, at least the present capacity; Unfit if a case does not replay."""
    rows = replays(log, net)
    if not rows.where("not fits").isEmpty():
        raise Unfit("a case cannot be replayed")
    peaks = rows.select(F.posexplode("peak").alias("i", "n")).groupBy("i").agg(F.max("n").alias("n")).collect()
    return {net.places[r["i"]]: max(r["n"], net.capacity.get(net.places[r["i"]], 0)) for r in peaks}


def simulate(spark: SparkSession, net: PetriNet, cases: int, length: int = 100, method: str = "rnd", seed: int = 1) -> EventLog:
    """Random runs until a deadlock or ``length`` events.

    ``rnd`` fires any enabled transition; ``bfs`` one of the batch that has been enabled longest.
    """
    if method not in ("rnd", "bfs"):
        raise TypeError(f"unknown method {method!r}")
    _, first, moves = net.tables()
    labels = net.labels

    def one(case: int) -> list[str]:
        rng, marking, out = random.Random(f"{seed}/{case}"), first, []
        batches: deque[list[str]] = deque()
        for _ in range(length):
            now = enabled(moves, marking)
            if not now:
                break
            pool = now
            if method == "bfs":
                waiting = [[t for t in b if t in now] for b in batches]
                old = {t for b in waiting for t in b}
                batches = deque(b for b in [*waiting, [t for t in now if t not in old]] if b)
                pool = batches[0]
            t = rng.choice(sorted(pool))
            if method == "bfs":
                pool.remove(t)
            marking = fire(moves, marking, t)
            if labels[t] is not None:
                out.append(labels[t])
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            yield pd.DataFrame({"case_id": df["id"].astype(str), "trace": [one(int(i)) for i in df["id"]]})

    return EventLog(spark.range(cases).mapInPandas(run, "case_id string, trace array<string>"))


def bounded(net: PetriNet) -> PetriNet:
    """A complementary place for each place with a capacity, so that the capacity is kept by tokens."""
    out = PetriNet(net.name, dict(net.initial), dict(net.labels), dict(net.arcs), {})
    for p, cap in net.capacity.items():
        into = {a for a, b in net.arcs if b == p}
        outof = {b for a, b in net.arcs if a == p}
        if not into:
            continue
        if any(net.arcs[a, p] > 1 for a in into) or any(net.arcs[p, b] > 1 for b in outof):
            raise ValueError("arcs of weight above 1 are not supported")
        name = next(n for n in (f"Q{p}", f"q{p}", f"q_{p}", f"q__{p}") if n not in out.initial)
        out.place(name, cap - net.initial[p])
        for t in into - outof:
            out.arc(name, t)
        for t in outof - into:
            out.arc(t, name)
    return out


def reachability(spark: SparkSession, net: PetriNet, limit: int = 100_000) -> TransitionSystem:
    """The graph of reachable markings; raises if there are more than ``limit``."""
    _, first, moves = net.tables()
    names, todo, edges = {first: "s0"}, deque([first]), []
    while todo:
        m = todo.popleft()
        for t in sorted(enabled(moves, m)):
            to = fire(moves, m, t)
            if to not in names:
                if len(names) >= limit:
                    raise ValueError(f"more than {limit} markings")
                names[to] = f"s{len(names)}"
                todo.append(to)
            edges.append((names[m], net.labels[t] or t, names[to]))
    return TransitionSystem.build(spark, edges, "s0", net.name)
