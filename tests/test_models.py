"""Models: files, replay, discovery, conformance."""

import pytest

from caseloom import EventLog
from caseloom.operators import filters
from caseloom.plans import bpmn, cnet, discovery, petri, ts
from caseloom.sources import models

SEED = ["abdcf", "acbdf", "acdbf", "adef", "abcdf", "aedf"]


def log_of(spark, *traces):
    return EventLog.from_traces(spark, [list(t) for t in traces])


def sequence_net():
    net = petri.PetriNet()
    for p, n in (("p", 1), ("q", 0), ("r", 0)):
        net.place(p, n)
    for t, a, b in (("A", "p", "q"), ("B", "q", "r")):
        net.transition(t)
        net.arc(a, t)
        net.arc(t, b)
    return net


def test_ts_of_its_own_log_replays_all(spark):
    log = log_of(spark, *SEED, *SEED[:2])
    for kind in ("seq", "mset", "set"):
        row = ts.inclusion(log, ts.from_log(log, kind)).first()
        assert (row["excluded"], row["partial"], row["total"]) == (0, 0, 8)


def test_ts_frequencies(spark):
    log = EventLog.from_variants(spark.createDataFrame([(["N"] * 2, 46), (["L"], 41), (["L"] * 2, 146), (["L"] * 4, 64)], "trace array<string>, occ long"))
    states = {r["state"]: r["freq"] for r in ts.annotated(log, ts.from_log(log, "seq")).states.collect()}
    assert states["N,N"] == 46 and states["L"] == 41 + 146 + 64 and states[""] == 297


def test_partial_inclusion_and_errors(spark):
    system = ts.TransitionSystem.build(spark, [("0", "a", "1"), ("1", "b", "2")], "0")
    log = log_of(spark, "ab", "ac", "x", "ab")
    row = ts.inclusion(log, system).first()
    assert (row["excluded"], row["partial"], row["total"], row["avg_partial"]) == (1, 1, 2, 0.5)
    assert sorted("".join(r["trace"]) for r in ts.included(log, system, True).cases.collect()) == ["a", "ab", "ab"]
    with pytest.raises(ts.Unfit):
        ts.annotated(log, system)
    with pytest.raises(ts.Indeterminate):
        ts.TransitionSystem.build(spark, [("0", "a", "1"), ("0", "a", "2")], "0").book()
    assert ts.topological_order(system) == ["0", "1", "2"]
    assert system.without_states(["2"]).edges.count() == 1
    assert system.renamed("0", "z").initial == "z"


def test_sis_files(spark):
    text = ".model m\n.outputs a b\n.state graph # edges\ns0 a s1\ns1 b s0\n.marking {s0}\n.end\n"
    system = models.ts_from_sis(spark, text)
    assert system.book() == {("s0", "a"): "s1", ("s1", "b"): "s0"}
    assert models.ts_from_sis(spark, models.ts_to_sis(system)).book() == system.book()
    assert "digraph" in models.ts_to_dot(system)


@pytest.mark.parametrize("write, read", [(models.pn_to_sis, models.pn_from_sis), (models.pn_to_pnml, models.pn_from_pnml)])
def test_net_files(write, read):
    net = sequence_net()
    net.transition("T", silent=True)
    net.arc("r", "T", 2)
    back = read(write(net))
    assert (back.arcs, back.initial, back.labels) == (net.arcs, net.initial, net.labels)


def test_tpn_and_implicit_places():
    net = models.pn_from_tpn('place "p" init 1; place "q"; trans "t"~"ev" in "p" out "q"; trans "u"~"$invisible$" in "q" out "p";')
    assert net.labels == {"t": "ev", "u": None} and net.initial == {"p": 1, "q": 0}
    assert len(net.arcs) == 4
    net = models.pn_from_sis(".model x\n.outputs a b\n.graph\na b\n.marking {}\n.end")
    assert len(net.initial) == 1


def test_replay_fitness_capacity(spark):
    net, log = sequence_net(), log_of(spark, "AB", "AB", "A", "B")
    assert petri.replay(net, ["A", "B"]) == [(1, 0, 0), (0, 1, 0), (0, 0, 1)]
    assert petri.fitness(log, net).first()["fitness"] == 0.75
    with pytest.raises(ts.Unfit):
        petri.compute_capacity(log, net)
    assert petri.compute_capacity(log_of(spark, "AB"), net) == {"p": 1, "q": 1, "r": 1}
    assert sorted({"".join(r["trace"]) for r in petri.simulate(spark, net, 5, 10, "bfs").cases.collect()}) == ["AB"]
    assert petri.reachability(spark, net).states.count() == 3


def test_bounded_net_keeps_its_capacity():
    net = petri.PetriNet()
    net.place("p", 0, capacity=2)
    net.transition("in")
    net.transition("out")
    net.arc("in", "p")
    net.arc("p", "out")
    _, m, moves = petri.bounded(net).tables()
    for _ in range(2):
        m = petri.fire(moves, m, "in")
    assert petri.enabled(moves, m) == ["out"]


def test_discovered_nets_replay_their_log(spark):
    log = log_of(spark, *SEED)
    for kind in ("set", "mset"):
        net = discovery.net_from_ts(ts.from_log(log, kind))
        assert petri.fitness(log, net).first()["fitness"] == 1
    inductive = discovery.inductive(log)
    assert discovery.alignment_fitness(log, inductive).first()["fitness"] == 1
    assert discovery.alignment_cost(sequence_net(), ["A"]) == (0, 2)
    net = discovery.alpha(log_of(spark, "abcd", "acbd", "aed"))
    assert len(net.initial) == 6 and all(petri.replay(net, list(t)) for t in ("abcd", "acbd", "aed"))
    assert 0 < discovery.etc_precision(log_of(spark, "abcd"), net).first()["precision"] < 1


def test_cnet_and_bpmn(spark):
    log = filters.conditioned(log_of(spark, "AB", "CD"))
    net, freq = cnet.discover(log)
    assert net.arcs() == {("S", "A"), ("S", "C"), ("A", "B"), ("C", "D"), ("B", "E"), ("D", "E")}
    assert cnet.fitness(log, net).first()["fitness"] == 1
    process = bpmn.from_cnet(net)
    assert sorted(g.subtype for g in process.of("gateway")) == ["exclusive", "exclusive"]
    bpmn.add_frequencies(process, freq)
    assert process.named("S").info["freq"] == 2 and process.named("A").info["freq"] == 1
    back = models.bpmn_from_xml(models.bpmn_to_xml(process))
    assert back.edges.keys() == process.edges.keys() and back.elements.keys() == process.elements.keys()
    assert process.path("start", "end")[0] == "start"
    assert "digraph" in models.bpmn_to_dot(process)


def test_cnets(spark):
    log = filters.conditioned(log_of(spark, *SEED))
    net, freq = cnet.discover(log)
    assert cnet.fitness(log, net).first()["fitness"] == 1
    assert cnet.fits_skeleton(log, net.arcs()).where("not fits").isEmpty()
    assert models.cnet_from_json(models.cnet_to_json(net)).rows() == net.rows()
    assert (net + net).rows() == net.rows()
    both = [net.bindings_df(spark)] * 2
    assert cnet.arc_similarity(both).first()[0] == 1 and cnet.binding_similarity(both).first()[0] == 1
    assert 0 <= cnet.etc_lower_bound(net, ts.from_log(log, "seq")) <= 1
    assert cnet.simplify(net, freq, 0.5).number_of_bindings() <= net.number_of_bindings()
    assert not cnet.replays(net, list("Sfa"))
    assert cnet.fitness(log, cnet.parallel_discovery(log, 2)).first()["fitness"] == 1
    rows = [("in", "b", ["a"], 2), ("out", "a", ["b"], 2)]
    assert models.frequencies_from_json(models.frequencies_to_json(rows)) == rows


def test_complexity():
    net = cnet.Cnet.from_rows([("out", "a", ["b", "c"]), ("in", "b", ["a"]), ("in", "c", ["a"])])
    assert net.global_complexity() == 3 + 2 + 3 + 4
    assert net.simple_graph_complexity() == pytest.approx((6 + 1) / (3 + 4))


def test_process_editing():
    p = bpmn.Process()
    a, b = p.add("task", "A", lane="x"), p.add("task", "B", lane="x")
    p.connect(a, b)
    p.translate({"A": "Z"})
    assert p.named("Z") and p.outgoing(a) == [b]
    p.delete(a)
    assert not p.edges and p.lanes["x"] == [b]
    p.delete_lane("x")
    assert p.elements[b].lane is None


def test_lifecycle_pairs(spark):
    rows = [("1", "A", 1, "start"), ("1", "A", 2, "start"), ("1", "A", 3, "complete"), ("2", "B", 1, "other"), ("2", "B", 2, "start")]
    got = bpmn.paired(spark.createDataFrame(rows, "case_id string, activity string, ts int, state string"))
    assert sorted(map(tuple, got.collect())) == [("1", "A", 1, 3), ("1", "A", 2, 2)]


def test_systems_as_graphs(spark):
    system = ts.from_log(log_of(spark, "ab", "ab", "ac"), "set")
    root = models.ET.fromstring(models.ts_to_graphml(system))
    local = lambda x: x.tag.rsplit("}", 1)[-1]
    names = {x.get("id"): x[0].text or "" for x in root.iter() if local(x) == "node"}
    edges = {(names[x.get("source")], names[x.get("target")]): {d.get("key"): d.text for d in x} for x in root.iter() if local(x) == "edge"}
    assert edges == {("", "a"): {"label": "a", "freq": "3"}, ("a", "a,b"): {"label": "b", "freq": "2"}, ("a", "a,c"): {"label": "c", "freq": "1"}}
    odd = ts.TransitionSystem.build(spark, [('x"&', "a", "y")], 'x"&')
    assert models.ts_to_gml(odd) == 'graph [\n  directed 1\n  node [ id 0 label "x&quot;&amp;" ]\n  node [ id 1 label "y" ]\n  edge [ source 0 target 1 label "a" ]\n]\n'
    assert system.signals() == ["a", "b", "c"]


def test_orders_of_cyclic_systems(spark):
    system = ts.TransitionSystem.build(spark, [("0", "a", "1"), ("1", "b", "2"), ("2", "c", "1"), ("2", "d", "3"), ("9", "e", "3"), ("3", "f", "3")], "0")
    with pytest.raises(ValueError):
        ts.topological_order(system)
    order = ts.topological_order(system, turn_back=True)
    assert sorted(order) == ["0", "1", "2", "3", "9"]
    at = order.index
    assert at("0") < at("1") < at("2") < at("3") and at("9") < at("3")


def test_variants_of_states(spark):
    system = ts.TransitionSystem.build(spark, [("0", "a", "1"), ("1", "b", "0")], "0")
    rows = ts.state_variants(log_of(spark, "ab", "ab", "aba", "ax"), system).collect()
    got = sorted((r["state"], "".join(r["trace"]), r["occ"]) for r in rows)
    assert got == [(s, t, n) for s in "01" for t, n in (("ab", 2), ("aba", 1), ("ax", 1))]


def test_cnet_for_prom():
    net = cnet.Cnet.from_rows([("out", "a", ["b", "c"]), ("out", "a", ["b"]), ("in", "b", ["a"]), ("in", "c", ["a"]), ("out", "b", ["d"]), ("out", "c", ["d"]), ("in", "d", ["b", "c"])])
    new, old = (models.ET.fromstring(models.cnet_to_prom(net, old=o, suffix="+complete")) for o in (False, True))
    assert [x.find("name").text for x in new.findall("node")] == [f"{a}+complete" for a in "abcd"]
    assert (new.find("startTaskNode").get("id"), new.find("endTaskNode").get("id")) == ("0", "3")
    sets = {x.get("id"): [[y.get("id") for y in s] for s in x] for x in new.findall("outputNode")}
    assert sets == {"0": [["1"], ["1", "2"]], "1": [["3"]], "2": [["3"]]}
    assert not new.findall("arc") and new.find("node").get("isInvisible") is None
    assert [(x.get("id"), x.get("source"), x.get("target")) for x in old.findall("arc")] == [("4", "0", "1"), ("5", "0", "2"), ("6", "1", "3"), ("7", "2", "3")]
    several = models.ET.fromstring(models.cnet_to_prom(cnet.Cnet({"x", "y"})))
    assert several.find("startTaskNode") is None and several.find("endTaskNode") is None


def test_pools_and_copies():
    p = bpmn.Process()
    p.add_lane("x", "buyer")
    p.add_lane("y", "buyer")
    p.add_lane("z", "seller")
    p.add_lane("w")
    a, b, c = (p.add("task", n, lane=lane) for n, lane in (("A", "x"), ("B", "y"), ("C", "z")))
    p.connect(a, b)
    again = models.bpmn_from_xml(models.bpmn_to_xml(p))
    assert (again.pools, again.lanes) == (p.pools, p.lanes) == ({"buyer": ["x", "y"], "seller": ["z"]}, {"x": [a], "y": [b], "z": [c], "w": []})
    twin = p.duplicate()
    twin.delete_pool("buyer")
    assert twin.pools == {"seller": ["z"]} and twin.elements[a].lane is None and (a, b) in twin.edges
    twin.delete_pool("seller", with_elements=True)
    assert c not in twin.elements and twin.lanes == {"w": []}
    assert p.elements[a].lane == "x" and list(p.pools) == ["buyer", "seller"]
    g = p.add("gateway", "", "parallel")
    p.change_subtype(g, "exclusive")
    assert p.of("gateway", "exclusive")[0].id == g


def test_timed_cases_are_in_order_of_start(spark):
    p = bpmn.Process()
    a, b = p.add("task", "A"), p.add("task", "B 1")
    rows = [(1, "B1", 5, 6), (1, "A", 2, 9), (2, "A", 1, 2), (2, "Z", 1, 2), (3, "A", None, 2)]
    events = spark.createDataFrame(rows, "case_id long, activity string, start_ts long, end_ts long")
    got = sorted((r["case_id"], r["pos"], r["element"]) for r in bpmn.timed_cases(events, p).collect())
    assert got == [(1, 0, a), (1, 1, b)]
