"""Nets from logs: alpha, regions, inductive; conformance by alignment and escaping edges."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..eventlog import EventLog
from ..operators import relations
from . import petri
from .petri import PetriNet
from .ts import TransitionSystem


def _edges(log: EventLog) -> tuple[list[str], set[tuple[str, str]], set[str], set[str]]:
    """Alphabet, directly-follows pairs, first and last activities: sizes of the model."""
    follows = {(r["a"], r["b"]) for r in relations.direct_succession(log).select("a", "b").collect()}
    some = log.weighted().where(F.size("trace") > 0)
    ends = [{r[0] for r in some.select(F.element_at("trace", i)).distinct().collect()} for i in (1, -1)]
    return log.names(), follows, *ends


def alpha(log: EventLog) -> PetriNet:
    """The alpha algorithm: a place for each maximal pair of sets A -> B without order inside A or B."""
    names, follows, first, last = _edges(log)
    causal = {(a, b) for a, b in follows if (b, a) not in follows}
    apart = {(a, b) for a in names for b in names if (a, b) not in follows and (b, a) not in follows}
    ok = lambda A, B: all((a, b) in causal for a in A for b in B)
    free = lambda S: all((x, y) in apart for x in S for y in S)
    pairs = {(frozenset([a]), frozenset([b])) for a, b in causal if (a, a) in apart and (b, b) in apart}
    grown, todo = set(pairs), list(pairs)
    while todo:
        A, B = todo.pop()
        for x in names:
            for new in ((A | {x}, B), (A, B | {x})):
                if new not in grown and new != (A, B) and free(new[0]) and free(new[1]) and ok(*new):
                    grown.add(new)
                    todo.append(new)
    maximal = [p for p in grown if not any(p != q and p[0] <= q[0] and p[1] <= q[1] for q in grown)]
    net = PetriNet("alpha")
    for t in names:
        net.transition(t)
    net.place("start", 1)
    net.place("end")
    for t in sorted(first):
        net.arc("start", t)
    for t in sorted(last):
        net.arc(t, "end")
    for i, (A, B) in enumerate(sorted((sorted(a), sorted(b)) for a, b in maximal)):
        net.place(f"p{i}")
        for a in A:
            net.arc(a, f"p{i}")
        for b in B:
            net.arc(f"p{i}", b)
    return net


def regions(ts: TransitionSystem, k: int = 1) -> list[tuple[dict[str, int], dict[str, int]]]:
    """Minimal non-trivial regions of at most ``k`` tokens: (tokens of each state, gradient of each label).

    A region is fixed by its tokens in one state and the labels' gradients; these are tried in
    the order in which a walk meets them, and a partial choice that breaks a bound or an edge goes.
    """
    edges = sorted((r["src"], r["label"], r["dst"]) for r in ts.edges.collect())
    order, seen, todo = [], {ts.initial}, [ts.initial]
    while todo:
        s = todo.pop(0)
        for a, e, b in edges:
            if a == s:
                order.append((a, e, b))
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
    found: list[tuple[dict[str, int], dict[str, int]]] = []

    def extend(i: int, m: dict[str, int], d: dict[str, int]) -> None:
        while i < len(order):
            a, e, b = order[i]
            if e in d:
                want = m[a] + d[e]
                if not 0 <= want <= k or m.setdefault(b, want) != want:
                    return
            elif b in m:
                d = d | {e: m[b] - m[a]}
            else:
                for g in range(-m[a], k - m[a] + 1):
                    extend(i + 1, m | {b: m[a] + g}, d | {e: g})
                return
            i += 1
        if any(g < 0 for g in d.values()):
            found.append((m, d))

    for m0 in range(k + 1):
        extend(0, {ts.initial: m0}, {})
    below = lambda x, y: all(x[s] <= y[s] for s in y) and x != y
    return [r for r in found if not any(below(q[0], r[0]) for q in found)]


def net_from_ts(ts: TransitionSystem, k: int = 1) -> PetriNet:
    """A place for each minimal region; arcs weigh as much as the gradient."""
    net = PetriNet(ts.name)
    for r in ts.edges.select("label").distinct().orderBy("label").collect():
        net.transition(r[0])
    for i, (m, d) in enumerate(sorted(regions(ts, k), key=lambda r: sorted(r[1].items()))):
        net.place(f"p{i}", m[ts.initial])
        for e, g in d.items():
            if g:
                net.arc(*((e, f"p{i}") if g > 0 else (f"p{i}", e)), abs(g))
    return net


def process_tree(names: list[str], follows: set[tuple[str, str]], first: set[str], last: set[str]):
    """Cuts of the directly-follows graph: ``(operator, children)``, an activity or None for a silent step."""
    if len(names) == 1:
        a = names[0]
        return ("loop", [a, None]) if (a, a) in follows else a
    inside = {(a, b) for a, b in follows if a in names and b in names}

    def groups(linked) -> list[list[str]]:
        label = {a: a for a in names}
        for a, b in combinations(names, 2):
            if linked(a, b) and label[a] != label[b]:
                old, new = label[b], label[a]
                label = {x: new if g == old else g for x, g in label.items()}
        return [[x for x in names if label[x] == g] for g in sorted(set(label.values()))]

    def sub(part: list[str], f: set[str] | None = None, e: set[str] | None = None):
        begin = {b for a, b in inside if a not in part and b in part} | (first & set(part))
        end = {a for a, b in inside if a in part and b not in part} | (last & set(part))
        return process_tree(part, inside, f or begin or set(part), e or end or set(part))

    parts = groups(lambda a, b: (a, b) in inside or (b, a) in inside)
    if len(parts) > 1:
        return ("xor", [sub(p) for p in parts])
    reach = {a: {b for x, b in inside if x == a} for a in names}
    for mid in names:
        for a in names:
            if mid in reach[a]:
                reach[a] |= reach[mid]
    parts = groups(lambda a, b: (b in reach[a]) == (a in reach[b]))
    if len(parts) > 1:
        parts.sort(key=lambda p: -sum(any(y in reach[x] for x in p) for y in names if y not in p))
        children = []
        for i, p in enumerate(parts):
            child = sub(p)
            before, after = set().union(*parts[:i]), set().union(*parts[i + 1 :])
            skipped = any(a in before | set() and b in after for a, b in inside) or (not before and first & after) or (not after and last & before)
            children.append(("xor", [child, None]) if skipped else child)
        return ("seq", children)
    parts = groups(lambda a, b: not ((a, b) in inside and (b, a) in inside))
    if len(parts) > 1 and all(first & set(p) and last & set(p) for p in parts):
        return ("and", [sub(p, first & set(p), last & set(p)) for p in parts])
    body = first | last
    rest = [x for x in names if x not in body]
    if rest:
        label = {x: x for x in rest}
        for a, b in inside:
            if a in label and b in label and label[a] != label[b]:
                old, new = label[b], label[a]
                label = {x: new if g == old else g for x, g in label.items()}
        redo = [[x for x in rest if label[x] == g] for g in sorted(set(label.values()))]
        good = [p for p in redo if all((a in last) for a, b in inside if a not in p and b in p) and all((b in first) for a, b in inside if a in p and b not in p)]
        do = [x for x in names if not any(x in p for p in good)]
        if good:
            return ("loop", [sub(do, first, last), ("xor", [sub(p) for p in good]) if len(good) > 1 else sub(good[0])])
    return ("loop", [None, ("xor", list(names))])  # any order: the flower


def inductive(log: EventLog) -> PetriNet:
    """A net from the process tree of the directly-follows graph; silent steps have no label.

    The graph does not tell whether a branch of a parallel cut may be missing, so a log in
    which one is (``ab, abc, acb``) need not replay.
    """
    net, count = PetriNet("inductive"), [0, 0]

    def place() -> str:
        count[0] += 1
        return net.place(f"p{count[0]}")

    def silent(a: str, b: str) -> None:
        count[1] += 1
        t = net.transition(f"tau{count[1]}", silent=True)
        net.arc(a, t)
        net.arc(t, b)

    def put(tree, a: str, b: str) -> None:
        if tree is None:
            return silent(a, b)
        if isinstance(tree, str):
            net.transition(tree)
            net.arc(a, tree)
            return net.arc(tree, b)
        op, children = tree
        if op == "xor":
            for c in children:
                put(c, a, b)
        elif op == "seq":
            stops = [a, *(place() for _ in children[1:]), b]
            for c, x, y in zip(children, stops, stops[1:], strict=False):
                put(c, x, y)
        elif op == "and":
            count[1] += 1
            split, join = (net.transition(f"tau{count[1]}{s}", silent=True) for s in ("s", "j"))
            net.arc(a, split)
            net.arc(join, b)
            for c in children:
                x, y = place(), place()
                net.arc(split, x)
                net.arc(y, join)
                put(c, x, y)
        else:
            x, y = place(), place()
            silent(a, x)
            put(children[0], x, y)
            put(children[1], y, x)
            silent(y, b)

    start, end = net.place("start", 1), net.place("end")
    put(process_tree(*_edges(log)), start, end)
    return net


def alignment_cost(net: PetriNet, trace: list[str], states: int | None = None) -> tuple[int, int] | None:
    """Least moves on log or model alone, and the states that were looked at; None beyond ``states`` of them, if given."""
    _, first, moves = net.tables()
    final = tuple(int(p == "end") for p in net.places) if "end" in net.initial else None
    heap, best, seen = [(0, 0, first)], {}, 0
    while heap:
        cost, back, marking = heapq.heappop(heap)
        i = -back
        if best.get((i, marking), 1 << 30) <= cost:
            continue
        best[i, marking] = cost
        seen += 1
        if states is not None and seen > states:
            return None
        if i == len(trace) and (final is None or marking == final):
            return cost, seen
        if i < len(trace):
            heapq.heappush(heap, (cost + 1, -(i + 1), marking))
        for t in petri.enabled(moves, marking):
            to, label = petri.fire(moves, marking, t), net.labels[t]
            if max(to, default=0) > len(trace) + 2:
                continue
            if label is None:
                heapq.heappush(heap, (cost, -i, to))
            else:
                heapq.heappush(heap, (cost + 1, -i, to))
                if i < len(trace) and trace[i] == label:
                    heapq.heappush(heap, (cost, -(i + 1), to))
    return None


def alignment_fitness(log: EventLog, net: PetriNet, states: int | None = None) -> DataFrame:
    """One row: ``fitness`` = mean of 1 - cost / (events + shortest run), and ``unsolved`` cases beyond ``states``, none by default."""
    shortest = alignment_cost(net, [], states)
    floor = shortest[0] if shortest else 0

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            got = [alignment_cost(net, list(t), states) for t in df["trace"]]
            yield pd.DataFrame({"occ": df["occ"], "f": [None if g is None else 1 - g[0] / max(1, len(t) + floor) for g, t in zip(got, df["trace"], strict=True)]})

    rows = log.weighted().mapInPandas(run, "occ long, f double")
    ok = F.when(F.col("f").isNotNull(), F.col("occ"))
    return rows.agg((F.sum(F.col("f") * ok) / F.sum(ok)).alias("fitness"), F.coalesce(F.sum(F.when(F.col("f").isNull(), F.col("occ"))), F.lit(0)).alias("unsolved"))


def etc_precision(log: EventLog, net: PetriNet) -> DataFrame:
    """One row: 1 - escaping / allowed, over the prefixes of replayable cases weighted by their visits."""
    _, first, moves = net.tables()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            out = []
            for trace, occ in zip(df["trace"], df["occ"], strict=True):
                got = petri.replay(net, list(trace))
                for i, m in enumerate(got or []):
                    allowed = sorted({net.labels[t] for t in petri.enabled(moves, m) if net.labels[t] is not None})
                    out.append((",".join(trace[:i]), trace[i] if i < len(trace) else None, allowed, occ))
            yield pd.DataFrame(out, columns=["prefix", "next", "allowed", "occ"])

    rows = log.weighted().mapInPandas(run, "prefix string, next string, allowed array<string>, occ long")
    per = rows.groupBy("prefix", "allowed").agg(F.sum("occ").alias("n"), F.collect_set("next").alias("used"))
    escaping = F.size(F.array_except("allowed", "used"))
    return per.agg((1 - F.sum(F.col("n") * escaping) / F.sum(F.col("n") * F.size("allowed"))).alias("precision"))
