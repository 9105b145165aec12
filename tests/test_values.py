"""Queries that SQL cannot express, and searches, against brute force."""

import random
from collections import Counter
from itertools import product

import numpy as np
import pytest
import xxhash

from caseloom import queries as Q
from caseloom.eventlog import EventLog
from caseloom.operators import cluster, filters, noise
from caseloom.plans import cnet, discovery, petri


def cases(log):
    return {r["case_id"]: list(r["trace"]) for r in log.cases.collect()}


def draw(case, *more):
    h = xxhash.xxh64(case.encode(), 42).intdigest()
    for x in more:
        h = xxhash.xxh64(x.to_bytes(4, "little"), h).intdigest()
    return h - (1 << 64) if h >> 63 else h


@pytest.mark.parametrize("kind", ["single", "maruster"])
def test_noise(spark, small, kind):
    log = Q.day_log(spark, small)
    names, seed, changed = log.names(), 5, 0
    got = cases(noise.add_noise(log, kind, 0.2, seed=seed))
    for case, t in cases(log).items():
        n, want = len(t), list(t)
        if draw(case, seed) % 1_000_000 < 200_000:
            pick = lambda salt, k: draw(case, seed, salt) % max(k, 1)  # noqa: E731, B023
            i, j = pick(1, n), pick(2, n)
            swap = list(t)
            swap[i], swap[j] = t[j], t[i]
            if kind == "single":
                at = pick(4, n + 1)
                want = [t[:i] + t[i + 1 :] if n > 1 else t, swap, t[:at] + [names[pick(3, len(names))]] + t[at:]][pick(5, 3)]
            elif n >= 3:
                third, which = n // 3, pick(8, 4)
                a, b = sorted((pick(6, third), pick(7, third)))
                want = swap if which == 3 else t[: third * which + a] + t[third * which + b + 1 :]
        assert got[case] == want
        changed += want != t
    assert changed > 10


def test_similar_is_a_fixed_point_of_its_means(spark, small):
    log = Q.conversation_log(spark, small)
    vectors = {tuple(r["trace"]): np.array(r["vector"], float) for r in cluster.parikh_vectors(log).collect()}
    rows = cluster.similar(log).collect()
    assert len(rows) == len(vectors)
    means = {c: np.average([vectors[tuple(r["trace"])] for r in rows if r["cluster"] == c], axis=0, weights=[r["occ"] for r in rows if r["cluster"] == c]) for c in {r["cluster"] for r in rows}}
    assert len(means) == 2
    for r in rows:
        far = {c: float(((vectors[tuple(r["trace"])] - m) ** 2).sum()) for c, m in means.items()}
        assert far[r["cluster"]] <= min(far.values()) + 1e-6


def test_hierarchical_is_average_linkage(spark, small):
    log = Q.conversation_log(spark, small)
    points = sorted({tuple(x - min(r["vector"]) for x in r["vector"]) for r in cluster.parikh_vectors(log).collect()})
    groups = {i: [i] for i in range(len(points))}
    gap = lambda a, b: np.mean([np.linalg.norm(np.subtract(points[i], points[j])) for i in groups[a] for j in groups[b]])
    merges = cluster.hierarchical(log)
    assert len(merges) == len(points) - 1
    for step, (a, b, distance, size) in enumerate(merges):
        assert distance == pytest.approx(gap(a, b)) == pytest.approx(min(gap(x, y) for x in groups for y in groups if x < y))
        groups[len(points) + step] = groups.pop(a) + groups.pop(b)
        assert len(groups[len(points) + step]) == size


def fires(net, marking, t):
    """A marking (places with tokens) after t, or None."""
    need = Counter({a: w for (a, b), w in net.arcs.items() if b == t})
    if any(marking[p] < w for p, w in need.items()):
        return None
    return +(Counter(marking) - need + Counter({b: w for (a, b), w in net.arcs.items() if a == t}))


def test_simulation_runs_on_the_net(spark, small):
    net = discovery.alpha(Q.conversation_log(spark, small))
    for method in ("rnd", "bfs"):
        seen = set()
        for trace in cases(petri.simulate(spark, net, 60, 6, method)).values():
            marking = +Counter(net.initial)
            for a in trace:
                marking = fires(net, marking, next(t for t, x in net.labels.items() if x == a))
                assert marking is not None
            assert len(trace) == 6 or all(fires(net, marking, t) is None for t in net.labels)
            seen.add(tuple(trace))
        assert len(seen) > 1


def test_reachability(spark, small):
    net = discovery.inductive(Q.conversation_log(spark, small))
    first = frozenset((+Counter(net.initial)).items())
    names, todo, edges = {first: "s0"}, [first], set()
    while todo:
        m = todo.pop(0)
        for t in sorted(net.labels):
            to = fires(net, Counter(dict(m)), t)
            if to is not None:
                to = frozenset(to.items())
                if to not in names:
                    names[to] = f"s{len(names)}"
                    todo.append(to)
                edges.add((names[m], net.labels[t] or t, names[to]))
    found = {(r["src"], r["label"], r["dst"]) for r in petri.reachability(spark, net).edges.collect()}
    degree = lambda es: Counter((label, sum(e[0] == s for e in es), sum(e[2] == d for e in es)) for s, label, d in es)
    assert len(found) == len(edges) and degree(found) == degree(edges)


def runs(net, limit):
    """Visible words of the net's runs from its start to its end, up to ``limit`` events."""
    final = frozenset({("end", 1)})
    seen, todo, words = set(), [(frozenset((+Counter(net.initial)).items()), ())], set()
    while todo:
        m, word = todo.pop()
        if (m, word) in seen or sum(n for _, n in m) > 8:
            continue
        seen.add((m, word))
        if m == final:
            words.add(word)
        for t, label in net.labels.items():
            to = fires(net, Counter(dict(m)), t)
            if to is not None and (label is None or len(word) < limit):
                todo.append((frozenset(to.items()), word if label is None else (*word, label)))
    return words


def test_alignments_and_inductive_nets(spark):
    rng = random.Random(4)
    for traces in (["abc", "acb"], ["abdcf", "acbdf", "acdbf", "adef"], ["ab", "abab", "c"]):
        log = EventLog.from_traces(spark, traces)
        net = discovery.inductive(log)
        words = runs(net, 8)
        def far(x, y):
            row = list(range(len(y) + 1))
            for i, a in enumerate(x, 1):
                row, old = [i], row
                for j, b in enumerate(y, 1):
                    row.append(old[j - 1] if a == b else 1 + min(old[j], row[-1]))
            return row[-1]

        for trace in [list(t) for t in traces] + [[rng.choice("abcdf") for _ in range(rng.randint(0, 3))] for _ in range(12)]:
            assert discovery.alignment_cost(net, trace)[0] == min(far(trace, w) for w in words)
        got = discovery.alignment_fitness(log, net).first()
        assert (got["fitness"] == 1.0) == ({tuple(t) for t in traces} <= words) and got["unsolved"] == 0


def exhaustive(trace, arcs):
    pairs = [(i, j) for i in range(len(trace)) for j in range(i + 1, len(trace)) if (trace[i], trace[j]) in arcs]
    for mask in product((0, 1), repeat=len(pairs)):
        some = [p for p, x in zip(pairs, mask) if x]
        if len({(j, trace[i]) for i, j in some}) == len(some) == len({(i, trace[j]) for i, j in some}):
            if {j for _, j in some} == set(range(1, len(trace))) and {i for i, _ in some} == set(range(len(trace) - 1)):
                return True
    return False


def test_skeleton_fit_is_exact():
    rng, fit = random.Random(3), 0
    for _ in range(1500):
        trace = [rng.choice("abcd") for _ in range(rng.randint(1, 7))]
        arcs = {(a, b) for a in "abcd" for b in "abcd" if rng.random() < 0.35}
        if sum((trace[i], trace[j]) in arcs for i in range(len(trace)) for j in range(i + 1, len(trace))) > 9:
            continue
        want = exhaustive(trace, arcs)
        assert (cnet._assign(trace, arcs) is not None) == want
        fit += want
    assert fit > 100
    assert cnet._assign(list("SabbcaE"), {tuple(x) for x in "Sa Sb Sc aE aa ab ac ba bc cE cb".split()}) is not None
    assert cnet._assign(list("xayacde"), {tuple(x) for x in "xa xy ya ac ad ce de".split()}) is not None


def test_cnet_replay_is_exact():
    def search(net, trace, i=0, open_=()):
        if i == len(trace):
            return not open_
        for need in net.inputs.get(trace[i], ()) if i else [frozenset()]:
            left = list(open_)
            try:
                for x in need:
                    left.remove((x, trace[i]))
            except ValueError:
                continue
            for give in net.outputs.get(trace[i], ()) if i + 1 < len(trace) else [frozenset()]:
                if search(net, trace, i + 1, (*left, *((trace[i], y) for y in give))):
                    return True
        return False

    rng, fit = random.Random(7), 0
    for _ in range(600):
        net = cnet.Cnet()
        for a in "abc":
            for side in ("in", "out"):
                for _ in range(rng.randint(1, 3)):
                    net.add(side, a, rng.sample("abc", rng.randint(1, 2)))
        trace = [rng.choice("abc") for _ in range(rng.randint(1, 6))]
        want = search(net, trace)
        assert cnet.replays(net, trace) == want
        fit += want
    assert fit > 30
    chain = cnet.Cnet.from_rows([("in", "a", ["a"]), ("out", "a", ["a"])])
    assert cnet.replays(chain, ["a"] * 5000)  # no recursion


def test_discovered_nets_carry_their_logs(spark, small):
    log = filters.conditioned(Q.conversation_log(spark, small))
    net, freq = cnet.discover(log)
    assert cnet.fitness(log, net).first()[0] == 1.0
    assert all(cnet._assign(t, net.arcs()) for t in cases(log).values())
    united = cnet.parallel_discovery(log, 3)
    assert cnet.fitness(log, united).first()[0] == 1.0 and united.activities == net.activities
    # every obligation that a case takes up it also gives: both sides of an arc count the same
    given, taken = Counter(), Counter()
    for r in freq.collect():
        for x in r["binding"]:
            side, arc = (given, (r["activity"], x)) if r["side"] == "out" else (taken, (x, r["activity"]))
            side[arc] += r["occ"] * r["n"]
    assert given == taken and set(given) == net.arcs()
    edges = {(r["src"], r["dst"]): r["freq"] for r in Q.bpmn_model(spark, small).collect()}
    starts = [n for (a, _), n in edges.items() if a == "start"]
    assert starts == [len(cases(log))]
    assert 0 <= Q.etc_lower_bound(spark, small).first()[0] <= 1


def test_variants_rank_over_partitions(spark):
    log = EventLog.from_traces(spark, [random.Random(k % 40).choices("abc", k=3) for k in range(300)])
    rows = log.variants().collect()
    assert [r["variant_id"] for r in sorted(rows, key=lambda r: (-r["occ"], r["trace"]))] == list(range(len(rows)))
