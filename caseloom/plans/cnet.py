"""Causal nets: bindings, discovery, conformance, metrics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..eventlog import EventLog
from ..functions import trace as T
from ..operators import relations
from .ts import TransitionSystem

Binding = frozenset[str]
SCHEMA = "side string, activity string, binding array<string>"


@dataclass
class Cnet:
    """``inputs``/``outputs``: activity -> its bindings, each a set of activities."""

    activities: set[str] = field(default_factory=set)
    inputs: dict[str, set[Binding]] = field(default_factory=dict)
    outputs: dict[str, set[Binding]] = field(default_factory=dict)
    name: str = "cnet"

    def add(self, side: str, activity: str, binding: Iterable[str]) -> None:
        b = frozenset(binding)
        self.activities |= {activity, *b}
        if b:
            (self.inputs if side == "in" else self.outputs).setdefault(activity, set()).add(b)

    def rows(self) -> list[tuple[str, str, list[str]]]:
        return sorted((s, a, sorted(b)) for s, d in (("in", self.inputs), ("out", self.outputs)) for a, bs in d.items() for b in bs)

    def bindings_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), SCHEMA)

    @classmethod
    def from_rows(cls, rows: Iterable) -> Cnet:
        net = cls()
        for side, activity, binding in rows:
            net.add(side, activity, binding)
        return net

    def __add__(self, other: Cnet) -> Cnet:
        net = Cnet.from_rows([*self.rows(), *other.rows()])
        net.activities |= self.activities | other.activities
        return net

    def arcs(self) -> set[tuple[str, str]]:
        return {(x, a) for a, bs in self.inputs.items() for b in bs for x in b}

    def starting(self) -> list[str]:
        return sorted(self.activities - self.inputs.keys())

    def final(self) -> list[str]:
        return sorted(self.activities - self.outputs.keys())

    def number_of_bindings(self) -> int:
        return sum(map(len, self.inputs.values())) + sum(map(len, self.outputs.values()))

    def global_complexity(self) -> int:
        return len(self.activities) + len(self.arcs()) + self.number_of_bindings() + sum(len(b) for _, _, b in self.rows())

    def simple_graph_complexity(self) -> float:
        """Arcs to vertices of the graph in which each binding has its own node."""
        sizes = [len(b) for _, _, b in self.rows()]
        per = sum(1 + sum(a in s for s in self.inputs.get(b, ())) + sum(b in s for s in self.outputs.get(a, ())) for a, b in self.arcs())
        return (per + sum(n - 1 for n in sizes)) / (len(self.activities) + sum(sizes))


def immediately_follows(log: EventLog) -> Cnet:
    """Singleton bindings for every directly-follows pair."""
    pairs = relations.direct_succession(log).select("a", "b").collect()
    return Cnet.from_rows([*(("in", r["b"], [r["a"]]) for r in pairs), *(("out", r["a"], [r["b"]]) for r in pairs)])


def immediately_follows_bindings(log: EventLog) -> DataFrame:
    ds = relations.direct_succession(log)
    into = ds.select(F.lit("in").alias("side"), F.col("b").alias("activity"), F.array("a").alias("binding"))
    return into.unionByName(ds.select(F.lit("out").alias("side"), F.col("a").alias("activity"), F.array("b").alias("binding")))


def minimal_arcs(log: EventLog, preferred: Iterable[tuple[str, str]] = (), window: int | None = None) -> set[tuple[str, str]]:
    """Few arcs such that each event but the first has an earlier source and each but the last a later target.

    Each event asks for one of a set of arcs; only the distinct sets reach the driver, where a
    greedy hitting set (preferred arcs first, then the arc that meets most cases) is pruned.
    """
    t = F.col("trace")
    each = log.weighted().select("occ", "trace", F.posexplode("trace").alias("i", "x"))
    low = F.greatest(F.col("i") - (window or 1 << 20), F.lit(0))
    before = F.array_distinct(F.slice(t, low + 1, F.col("i") - low))
    after = F.array_distinct(F.slice(t, F.col("i") + 2, F.lit(window or 1 << 20)))
    ins = each.where("i > 0").select("occ", F.array_sort(F.transform(before, lambda a: F.struct(a.alias("a"), F.col("x").alias("b")))).alias("need"))
    outs = each.where(F.col("i") < F.size("trace") - 1).select("occ", F.array_sort(F.transform(after, lambda b: F.struct(F.col("x").alias("a"), b.alias("b")))).alias("need"))
    needs = [({(p["a"], p["b"]) for p in r["need"]}, r["n"]) for r in ins.unionByName(outs).groupBy("need").agg(F.sum("occ").alias("n")).collect()]
    return _hitting_set(needs, {a: i for i, a in enumerate(preferred)})


def _needs(trace: list[str], occ: int, window: int | None = None) -> list[tuple[set[tuple[str, str]], int]]:
    """The sets of arcs of which each event of a trace needs one."""
    reach = window or len(trace)
    into = [({(a, x) for a in trace[max(0, i - reach) : i]}, occ) for i, x in enumerate(trace) if i]
    return into + [({(x, b) for b in trace[i + 1 : i + 1 + reach]}, occ) for i, x in enumerate(trace[:-1])]


def _hitting_set(needs: list[tuple[set[tuple[str, str]], int]], order: dict[tuple[str, str], int]) -> set[tuple[str, str]]:
    """Preferred arcs first, then the arc that meets most cases; arcs that turn out not to be needed go."""
    chosen: list[tuple[str, str]] = []
    open_ = needs
    while open_:
        gain: Counter = Counter()
        for need, n in open_:
            for arc in need:
                gain[arc] += n
        best = min(gain, key=lambda a: (-(len(order) - order[a]) if a in order else 0, -gain[a], a))
        chosen.append(best)
        open_ = [x for x in open_ if best not in x[0]]
    for arc in reversed(chosen[:]):
        rest = set(chosen) - {arc}
        if arc not in order and all(need & rest for need, _ in needs):
            chosen.remove(arc)
    return set(chosen)


def _assign(trace: list[str], arcs: set[tuple[str, str]]) -> tuple[list[set[int]], list[set[int]]] | None:
    """Obligations of a trace on the arcs, None if there are none that carry it.

    Each event but the first needs an earlier source and each but the last a later
    target, and a binding holds a name once: of the events with one name a producer
    serves one at most, and the other way round.  So pairs (event, name) have room for
    one obligation; events that no obligation serves yet are served one by one, along
    a chain of obligations given up and taken anew, as along the augmenting paths of a
    flow with these bounds; tests hold it against exhaustive search.
    """
    n = len(trace)
    ins: list[set[int]] = [set() for _ in range(n)]
    outs: list[set[int]] = [set() for _ in range(n)]
    targets = [[j for j in range(i + 1, n) if (trace[i], trace[j]) in arcs] for i in range(n)]
    sources = [[i for i in range(j - 1, -1, -1) if (trace[i], trace[j]) in arcs] for j in range(n)]

    def clash(i: int, j: int) -> list[tuple[int, int]]:
        """Obligations that leave no room for (i, j)."""
        return [(k, j) for k in ins[j] if trace[k] == trace[i]] + [(i, k) for k in outs[i] if trace[k] == trace[j]]

    def serve(event: int, inward: bool, tried: set) -> bool:
        """Give an event its source (target), moving what is in the way; what that leaves unserved is served in turn."""
        for other in sources[event] if inward else targets[event]:
            i, j = (other, event) if inward else (event, other)
            if (i, j) in tried or j in outs[i]:
                continue
            tried.add((i, j))
            gone = clash(i, j)
            for a, b in gone:
                outs[a].discard(b)
                ins[b].discard(a)
            outs[i].add(j)
            ins[j].add(i)
            open_ = [(b, True) for a, b in gone if b != j and not ins[b]] + [(a, False) for a, b in gone if a != i and not outs[a]]
            kept = [set(x) for x in ins], [set(x) for x in outs]
            if all(serve(e, way, tried) for e, way in open_) and ins[j] and outs[i]:
                return True
            for held, old in zip((ins, outs), kept, strict=True):
                for x, y in zip(held, old, strict=True):
                    x.clear()
                    x.update(y)
            outs[i].discard(j)
            ins[j].discard(i)
            for a, b in gone:
                outs[a].add(b)
                ins[b].add(a)
        return False

    for j in range(1, n):
        if not ins[j] and not serve(j, True, set()):
            return None
    for i in range(n - 1):
        if not outs[i] and not serve(i, False, set()):
            return None
    return ins, outs


def binding_frequencies(log: EventLog, arcs: set[tuple[str, str]]) -> DataFrame:
    """``trace, occ, side, activity, binding, n``: bindings that each variant uses, n times."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            out = []
            for trace, occ in zip(df["trace"], df["occ"], strict=True):
                trace = list(trace)
                if got := _assign(trace, arcs):
                    used: Counter = Counter()
                    for i, a in enumerate(trace):
                        for side, cells in (("in", got[0][i]), ("out", got[1][i])):
                            if cells:
                                used[side, a, tuple(sorted(trace[k] for k in cells))] += 1
                    out += [(trace, occ, *k, n) for k, n in used.items()]
            yield pd.DataFrame([(t, o, s, a, list(b), n) for t, o, s, a, b, n in out], columns=["trace", "occ", "side", "activity", "binding", "n"])

    return log.weighted().mapInPandas(run, f"trace array<string>, occ long, {SCHEMA}, n long")


def _missing_step(log: EventLog, arcs: set[tuple[str, str]]) -> tuple[str, str] | None:
    """The most frequent direct step without an arc, of the variants that the arcs cannot carry; None if they carry all.

    With all its direct steps as arcs a variant is carried, so adding them one by one ends.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            bad = [_assign(list(t), arcs) is None for t in df["trace"]]
            yield df[bad]

    failing = EventLog(log.cases, weighted=log.weighted().mapInPandas(run, "trace array<string>, occ long"))
    steps = relations.direct_succession(failing)
    if arcs:
        known = log.cases.sparkSession.createDataFrame(sorted(arcs), "a string, b string")
        steps = steps.join(F.broadcast(known), ["a", "b"], "left_anti")
    row = steps.orderBy(F.desc("n"), "a", "b").first()
    return (row["a"], row["b"]) if row else None


def discover(log: EventLog, preferred: Iterable[tuple[str, str]] = (), window: int | None = None) -> tuple[Cnet, DataFrame]:
    """A causal net that replays the log on few arcs, and its binding frequencies."""
    arcs = minimal_arcs(log, preferred, window)
    while missing := _missing_step(log, arcs):
        arcs.add(missing)
    freq = binding_frequencies(log, arcs)
    used = freq.groupBy("side", "activity", "binding").agg(F.sum(F.col("occ") * F.col("n")).alias("n"))
    net = Cnet.from_rows((r["side"], r["activity"], r["binding"]) for r in used.collect())
    net.activities |= set(log.names())
    return net, freq


def parallel_discovery(log: EventLog, parts: int, window: int | None = None) -> Cnet:
    """Discover on parts of the variants, all at once, and unite the nets.

    A part is one task's group: each of its variants asks for arcs, the greedy set
    is taken there, and only the parts' bindings come to the driver.
    """

    def run(df: pd.DataFrame) -> pd.DataFrame:
        traces = [list(t) for t in df["trace"]]
        needs = [x for t, n in zip(traces, df["occ"], strict=True) for x in _needs(t, int(n), window)]
        arcs = _hitting_set(needs, {})
        found = set()
        for t in traces:
            got = _assign(t, arcs)
            if got is None:
                arcs |= set(zip(t, t[1:]))
        for t in traces:
            ins, outs = _assign(t, arcs) or ([], [])
            for i, a in enumerate(t):
                found |= {(side, a, tuple(sorted(t[k] for k in cells[i]))) for side, cells in (("in", ins), ("out", outs)) if cells and cells[i]}
        return pd.DataFrame([(s, a, list(b)) for s, a, b in sorted(found)], columns=["side", "activity", "binding"])

    rows = log.weighted().withColumn("part", F.pmod(F.xxhash64("trace"), F.lit(parts)))
    net = Cnet.from_rows((r["side"], r["activity"], r["binding"]) for r in rows.groupBy("part").applyInPandas(run, SCHEMA).distinct().collect())
    net.activities |= set(log.names())
    return net


def simplify(net: Cnet, freq: DataFrame, min_fitness: float = 0.9) -> Cnet:
    """Drop the bindings of the least supported variants while at least ``min_fitness`` of the cases stay."""
    support = freq.groupBy("side", "activity", "binding").agg(F.sum("occ").alias("cases"))
    rows = [(r["cases"], r["side"], r["activity"], tuple(r["binding"])) for r in support.collect()]
    total = freq.select("trace", "occ").distinct().agg(F.sum("occ")).first()[0] or 0
    lost, gone = freq.select("trace", "occ").limit(0), []
    spark = freq.sparkSession
    for _, side, activity, binding in sorted(rows):
        trial = spark.createDataFrame([(s, a, list(b)) for s, a, b in [*gone, (side, activity, binding)]], SCHEMA)
        lost = freq.join(F.broadcast(trial), ["side", "activity", "binding"], "left_semi").select("trace", "occ").distinct().agg(F.sum("occ")).first()[0] or 0
        if total - lost < min_fitness * total:
            break
        gone.append((side, activity, binding))
    return Cnet.from_rows(r for r in net.rows() if (r[0], r[1], tuple(r[2])) not in set(gone))


def replays(net: Cnet, trace: list[str]) -> bool:
    """Whether some choice of bindings leaves no obligation; the ends carry none.

    All open obligations that the events so far can leave go along, event by event;
    an obligation whose target does not come any more drops its choice.
    """
    last = {a: i for i, a in enumerate(trace)}
    now: set[frozenset] = {frozenset()}
    for i, a in enumerate(trace):
        gives = [g for g in net.outputs.get(a, ()) if all(last.get(y, -1) > i for y in g)] if i + 1 < len(trace) else [frozenset()]
        after = set()
        for open_ in now:
            for need in net.inputs.get(a, ()) if i else [frozenset()]:
                have = dict(open_)
                if not all(have.get((x, a)) for x in need):
                    continue
                for x in need:
                    have[x, a] -= 1
                if last[a] == i and any(n and y == a for (_, y), n in have.items()):
                    continue
                for give in gives:
                    new = dict(have)
                    for y in give:
                        new[a, y] = new.get((a, y), 0) + 1
                    after.add(frozenset((k, n) for k, n in new.items() if n))
        now = after
    return frozenset() in now


def fits(log: EventLog, net: Cnet) -> DataFrame:
    """``trace, occ, fits``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            yield df.assign(fits=[replays(net, list(t)) for t in df["trace"]])

    return log.weighted().mapInPandas(run, "trace array<string>, occ long, fits boolean")


def fitness(log: EventLog, net: Cnet) -> DataFrame:
    return fits(log, net).agg((F.sum(F.when(F.col("fits"), F.col("occ")).otherwise(0)) / F.sum("occ")).alias("fitness"))


def fits_skeleton(log: EventLog, arcs: set[tuple[str, str]]) -> DataFrame:
    """``trace, occ, fits`` for the arcs alone: accepted if all steps are arcs, rejected if an event
    has no arc to a later or from an earlier one, else decided by assigning obligations."""
    spark = log.cases.sparkSession
    book = F.broadcast(spark.createDataFrame([("\t".join(a),) for a in sorted(arcs)], "arc string").agg(F.collect_list("arc").alias("arcs")))
    rows = log.weighted().crossJoin(book).withColumn("step", T.steps(F.col("trace")))
    rows = rows.withColumn("all_in", F.forall("step", lambda p: F.array_contains("arcs", F.concat_ws("\t", p["a"], p["b"]))))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            ok = [bool(a) or _assign(list(t), arcs) is not None for a, t in zip(df["all_in"], df["trace"], strict=True)]
            yield pd.DataFrame({"trace": df["trace"], "occ": df["occ"], "fits": ok})

    return rows.select("trace", "occ", "all_in").mapInPandas(run, "trace array<string>, occ long, fits boolean")


def arc_similarity(nets: list[DataFrame]) -> DataFrame:
    """Arcs in all nets / arcs in any; each net as its bindings."""
    arcs = [n.where("side = 'in'").select("activity", F.explode("binding").alias("x")).distinct() for n in nets]
    every = arcs[0]
    for a in arcs[1:]:
        every = every.unionAll(a)
    counts = every.groupBy("activity", "x").agg(F.count(F.lit(1)).alias("k"))
    return counts.agg((F.sum((F.col("k") == len(nets)).cast("int")) / F.count(F.lit(1))).alias("similarity"))


def binding_similarity(nets: list[DataFrame]) -> DataFrame:
    """Mean over side and activity of bindings in all nets / bindings in any."""
    every = nets[0].distinct()
    for n in nets[1:]:
        every = every.unionAll(n.distinct())
    counts = every.groupBy("side", "activity", "binding").agg(F.count(F.lit(1)).alias("k"))
    per = counts.groupBy("side", "activity").agg((F.sum((F.col("k") == len(nets)).cast("int")) / F.count(F.lit(1))).alias("s"))
    return per.agg(F.avg("s").alias("similarity"))


def etc_lower_bound(net: Cnet, ts: TransitionSystem) -> float:
    """1 - escaping / possible moves of the net along an acyclic annotated system, by visits of its states."""
    freq = {r["state"]: r["freq"] for r in ts.states.collect()}
    book = ts.book()
    largest = {a: [b for b in bs if not any(b < c for c in bs)] for a, bs in net.outputs.items()}
    least = {a: [b for b in bs if not any(c < b for c in bs)] for a, bs in net.inputs.items()}
    possible = escaping = 0
    seen, todo = set(), []

    def move(state: str, a: str, rests: set[frozenset]) -> None:
        nonlocal possible, escaping
        possible += freq.get(state, 0)
        to = book.get((state, a))
        if to is None:
            escaping += freq.get(state, 0)
            return
        gives = largest.get(a) or [frozenset()]
        after = frozenset(frozenset((Counter(dict(r)) + Counter((a, y) for y in g)).items()) for r in rests for g in gives)
        if (to, after) not in seen:
            seen.add((to, after))
            todo.append((to, after))

    for a in net.starting():
        move(ts.initial, a, {frozenset()})
    while todo:
        state, sets = todo.pop()
        for a in sorted(net.inputs):
            rests = set()
            for open_ in sets:
                have = Counter(dict(open_))
                for need in least[a]:
                    want = Counter((x, a) for x in need)
                    if all(have[k] >= n for k, n in want.items()):
                        rests.add(frozenset((have - want).items()))
            if rests:
                move(state, a, rests)
    return 1 - escaping / possible if possible else 1.0
