"""BPMN models: built from causal nets, annotated with counts and durations."""

from __future__ import annotations

from collections import deque
from collections.abc import Mapping
from copy import deepcopy
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..eventlog import EventLog
from ..operators import filters, relations
from . import cnet as C


@dataclass
class Element:
    id: str
    type: str  # task, event, gateway
    subtype: str = ""
    name: str = ""
    lane: str | None = None
    info: dict = field(default_factory=dict)


@dataclass
class Process:
    name: str = "process"
    elements: dict[str, Element] = field(default_factory=dict)
    edges: dict[tuple[str, str], dict] = field(default_factory=dict)
    lanes: dict[str, list[str]] = field(default_factory=dict)
    pools: dict[str, list[str]] = field(default_factory=dict)  # the lanes of each

    def add(self, type: str, name: str = "", subtype: str = "", id: str | None = None, lane: str | None = None) -> str:
        id = id or f"{type}{len(self.elements) + 1}"
        self.elements[id] = Element(id, type, subtype, name, lane)
        if lane is not None:
            self.lanes.setdefault(lane, []).append(id)
        return id

    def connect(self, a: str, b: str, **info) -> None:
        if a not in self.elements or b not in self.elements:
            raise ValueError("both ends of a connection must be elements")
        self.edges.setdefault((a, b), {}).update(info)

    def disconnect(self, a: str, b: str) -> None:
        del self.edges[a, b]

    def delete(self, id: str) -> None:
        """An element with its connections."""
        element = self.elements.pop(id)
        self.edges = {e: x for e, x in self.edges.items() if id not in e}
        if element.lane is not None:
            self.lanes[element.lane].remove(id)

    def add_lane(self, name: str, pool: str | None = None) -> None:
        self.lanes.setdefault(name, [])
        if pool is not None and name not in self.pools.setdefault(pool, []):
            self.pools[pool].append(name)

    def delete_lane(self, name: str, with_elements: bool = False) -> None:
        for lanes in self.pools.values():
            if name in lanes:
                lanes.remove(name)
        for id in self.lanes.pop(name):
            self.elements[id].lane = None
            if with_elements:
                self.delete(id)

    def delete_pool(self, name: str, with_elements: bool = False) -> None:
        """A pool with its lanes; their elements stay in the process unless asked for."""
        for lane in list(self.pools[name]):
            self.delete_lane(lane, with_elements)
        del self.pools[name]

    def change_subtype(self, id: str, subtype: str) -> None:
        self.elements[id].subtype = subtype

    def duplicate(self) -> Process:
        return deepcopy(self)

    def clear(self) -> None:
        self.elements, self.edges, self.lanes, self.pools = {}, {}, {}, {}

    def of(self, type: str, subtype: str | None = None) -> list[Element]:
        return [e for e in self.elements.values() if e.type == type and subtype in (None, e.subtype)]

    def named(self, name: str) -> Element | None:
        return next((e for e in self.elements.values() if e.name == name), None)

    def outgoing(self, id: str) -> list[str]:
        return sorted(b for a, b in self.edges if a == id)

    def incoming(self, id: str) -> list[str]:
        return sorted(a for a, b in self.edges if b == id)

    def translate(self, names: Mapping[str, str]) -> None:
        for e in self.of("task"):
            e.name = names.get(e.name, e.name)

    def add_info(self, info: Mapping[str, Mapping]) -> None:
        for name, x in info.items():
            if e := self.named(name):
                e.info.update(x)

    def path(self, a: str, b: str) -> list[str] | None:
        """A shortest path of element ids."""
        came, todo = {a: None}, deque([a])
        while todo:
            x = todo.popleft()
            if x == b:
                out = []
                while x is not None:
                    out.append(x)
                    x = came[x]
                return out[::-1]
            for y in self.outgoing(x):
                if y not in came:
                    came[y] = x
                    todo.append(y)
        return None

    def nodes_df(self, spark: SparkSession) -> DataFrame:
        rows = [(e.id, e.type, e.subtype, e.name, e.lane, e.info.get("avg_duration"), e.info.get("freq")) for e in self.elements.values()]
        return spark.createDataFrame(rows, "id string, type string, subtype string, name string, parent string, avg_duration double, freq long")

    def edges_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(a, b, x.get("freq")) for (a, b), x in self.edges.items()], "src string, dst string, freq long")


def gateway(bindings: set) -> str | None:
    """None: straight on; parallel: one binding; exclusive: several, pairwise disjoint; else inclusive."""
    if len(bindings) == 1:
        return None if len(next(iter(bindings))) == 1 else "parallel"
    return "exclusive" if all(not a & b for a, b in combinations(bindings, 2)) else "inclusive"


def from_cnet(net: C.Cnet) -> Process:
    out = Process(net.name)
    enter, leave = {}, {}
    for a in sorted(net.activities):
        enter[a] = leave[a] = out.add("task", a, id=f"task_{a}")
        for side, bindings, ends in (("in", net.inputs.get(a), enter), ("out", net.outputs.get(a), leave)):
            kind = gateway(bindings) if bindings else None
            if kind:
                ends[a] = out.add("gateway", "", kind, id=f"{side}_{a}")
                out.connect(*((ends[a], f"task_{a}") if side == "in" else (f"task_{a}", ends[a])))
    for a, b in sorted(net.arcs()):
        out.connect(leave[a], enter[b])
    for kind, ends in (("start", net.starting()), ("end", net.final())):
        if len(ends) == 1:
            event = out.add("event", kind, kind, id=kind)
            out.connect(*((event, enter[ends[0]]) if kind == "start" else (leave[ends[0]], event)))
    return out


def add_frequencies(process: Process, freq: DataFrame, by_case: bool = True) -> DataFrame:
    """Counts on tasks and edges from binding frequencies (``trace, occ, side, activity, binding, n``).

    A case counts once, or as often as it uses an obligation.  Between an activity and its gateway
    the activity's count stands, between two gateways the obligation's.  Returns the obligations.
    """
    weight = F.sum("occ") if by_case else F.sum(F.col("occ") * F.col("n"))
    each = freq.where("side = 'out'").select("trace", "occ", "n", "activity", F.explode("binding").alias("target"))
    if by_case:
        each = each.select("trace", "occ", "activity", "target").distinct()
    pairs = each.groupBy("activity", "target").agg(weight.alias("n"))
    acts = freq.select("trace", "occ", "activity", "side", "n")
    acts = acts.select("trace", "occ", "activity").distinct() if by_case else acts
    if by_case:
        per = acts.groupBy("activity").agg(F.sum("occ").alias("n"))
    else:
        side = acts.groupBy("activity", "side").agg(F.sum(F.col("occ") * F.col("n")).alias("n"))
        per = side.groupBy("activity").agg(F.max("n").alias("n"))
    count = {r["activity"]: r["n"] for r in per.collect()}  # a row an activity
    between = {(r["activity"], r["target"]): r["n"] for r in pairs.collect()}
    for e in process.of("task"):
        e.info["freq"] = count.get(e.name, 0)
    for (a, b), info in process.edges.items():
        x, y = process.elements[a], process.elements[b]
        if x.type == "task":
            info["freq"] = count.get(x.name, 0)
        elif y.type == "task":
            info["freq"] = count.get(y.name, 0)
        elif x.type == "gateway" and y.type == "gateway":
            info["freq"] = between.get((a.split("_", 1)[1], b.split("_", 1)[1]), 0)
        else:
            task = (x if x.type == "gateway" else y).id.split("_", 1)[1]
            info["freq"] = count.get(task, 0)
    return pairs


def add_durations(process: Process, mean: DataFrame) -> None:
    """``activity, avg_seconds`` onto the tasks."""
    for r in mean.collect():
        if e := process.named(r["activity"]):
            e.info["avg_duration"] = r["avg_seconds"]


def discovery(log: EventLog, log_percentage: float | None = None, min_length: int = 0, frequencies: bool = True) -> tuple[Process, C.Cnet]:
    """Filter, condition, heuristic arcs, causal net, BPMN."""
    if min_length:
        log = filters.case_length(log, min_length)
    if log_percentage:
        log = filters.frequent_variants(log, log_min_freq=log_percentage)
    log = filters.conditioned(log)
    arcs = [(r["a"], r["b"]) for r in relations.flexible_heuristic_miner(log).orderBy("a", "b").collect()]
    net, freq = C.discover(log, arcs)
    process = from_cnet(net)
    if frequencies:
        add_frequencies(process, freq)
    return process, net


def timed_cases(events: DataFrame, process: Process) -> DataFrame:
    """Events with both times whose activity is a task (also without blanks in its name), only of cases in which all are.

    ``pos`` numbers the events of a case from 0 by start, then end and element.
    """
    names = [(e.name, e.id) for e in process.of("task")]
    book = events.sparkSession.createDataFrame(names, "task string, element string")
    exact = F.broadcast(book)
    loose = F.broadcast(book.select(F.regexp_replace("task", " ", "").alias("loose"), F.col("element").alias("element2")))
    found = events.join(exact, events["activity"] == F.col("task"), "left").join(loose, F.regexp_replace("activity", " ", "") == F.col("loose"), "left")
    found = found.withColumn("element", F.coalesce("element", "element2"))
    good = F.min((F.col("element").isNotNull() & F.col("start_ts").isNotNull() & F.col("end_ts").isNotNull()).cast("int")).over(Window.partitionBy("case_id"))
    pos = F.row_number().over(Window.partitionBy("case_id").orderBy("start_ts", "end_ts", "element")) - 1
    return found.withColumn("ok", good).where("ok = 1").select("case_id", "activity", "element", "start_ts", "end_ts", pos.alias("pos"))


def paired(events: DataFrame, ts: str = "ts", state: str = "state", start: str = "start", end: str = "complete") -> DataFrame:
    """``case_id, activity, start_ts, end_ts``: the k-th start with the k-th end of an activity in a case.

    Cases with an unknown state go; a start without an end has no length.
    """
    per_case = Window.partitionBy("case_id")
    known = events.withColumn("ok", F.min(F.col(state).isin(start, end).cast("int")).over(per_case)).where("ok = 1")
    numbered = known.withColumn("k", F.row_number().over(Window.partitionBy("case_id", "activity", state).orderBy(ts)))
    a = numbered.where(F.col(state) == start).select("case_id", "activity", "k", F.col(ts).alias("start_ts"))
    b = numbered.where(F.col(state) == end).select("case_id", "activity", "k", F.col(ts).alias("e"))
    return a.join(b, ["case_id", "activity", "k"], "left").select("case_id", "activity", "start_ts", F.coalesce("e", "start_ts").alias("end_ts"))
