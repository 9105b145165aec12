"""Models from and to files.  Models are small, so these work on the driver with texts."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from xml.sax.saxutils import quoteattr

from pyspark.sql import SparkSession

from ..plans.bpmn import Process
from ..plans.cnet import Cnet
from ..plans.petri import PetriNet
from ..plans.ts import TransitionSystem

BPMN_NS = "http://www.omg.org/spec/BPMN/20100524/MODEL"


def read_text(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def write_text(path: str, text: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def _sections(text: str) -> dict[str, list[str]]:
    """Lines of a SIS file by the dot word above them; the rest of its own line comes first."""
    out: dict[str, list[str]] = {}
    now = ""
    for line in text.splitlines():
        line = line.split("#", 1)[0].strip()
        if line.startswith("."):
            word, _, rest = line[1:].partition(" ")
            now = word
            out.setdefault(now, []).append(rest.strip())
        elif line:
            out.setdefault(now, []).append(line)
    return out


def _braces(lines: list[str]) -> list[str]:
    return re.sub(r"[{}]", " ", " ".join(lines)).split()


def ts_from_sis(spark: SparkSession, text: str) -> TransitionSystem:
    s = _sections(text)
    edges = [tuple(line.split()) for line in s.get("state", [])[1:]]
    return TransitionSystem.build(spark, edges, _braces(s["marking"])[0], (s.get("model") or ["ts"])[0])


def ts_to_sis(ts: TransitionSystem) -> str:
    edges = sorted((r["src"] or "s0", r["label"], r["dst"] or "s0") for r in ts.edges.select("src", "label", "dst").collect())
    clean = lambda x: re.sub(r"\W", "_", x)
    labels = " ".join(sorted({e for _, e, _ in edges}))
    rows = "\n".join(f"{clean(a)} {e} {clean(b)}" for a, e, b in edges)
    return f".model {ts.name}\n.outputs {labels}\n.state graph\n{rows}\n.marking {{{clean(ts.initial or 's0')}}}\n.end\n"


def ts_to_dot(ts: TransitionSystem) -> str:
    rows = "\n".join(f'  "{r["src"]}" -> "{r["dst"]}" [label="{r["label"]}"];' for r in ts.edges.orderBy("src", "label").collect())
    return f'digraph "{ts.name}" {{\n{rows}\n}}\n'


def _graph(ts: TransitionSystem) -> tuple[dict[str, int], list]:
    """Numbers of the states, the first state's is 0, and the edges in order."""
    rest = sorted({r["state"] for r in ts.states.select("state").collect()} - {ts.initial})
    return {s: i for i, s in enumerate([ts.initial, *rest])}, ts.edges.orderBy("src", "label", "dst").collect()


def ts_to_graphml(ts: TransitionSystem) -> str:
    """Names of states, labels of edges and, where there are any, counts of edges as data."""
    number, edges = _graph(ts)
    root = ET.Element("graphml", xmlns="http://graphml.graphdrawing.org/xmlns")
    for owner, name, kind in (("node", "name", "string"), ("edge", "label", "string"), ("edge", "freq", "long")):
        ET.SubElement(root, "key", {"id": name, "for": owner, "attr.name": name, "attr.type": kind})
    graph = ET.SubElement(root, "graph", id=ts.name, edgedefault="directed")
    for s, i in number.items():
        ET.SubElement(ET.SubElement(graph, "node", id=f"n{i}"), "data", key="name").text = s
    for r in edges:
        edge = ET.SubElement(graph, "edge", source=f"n{number[r['src']]}", target=f"n{number[r['dst']]}")
        for name in ("label", "freq"):
            if name in r:
                ET.SubElement(edge, "data", key=name).text = str(r[name])
    return ET.tostring(root, encoding="unicode")


def ts_to_gml(ts: TransitionSystem) -> str:
    number, edges = _graph(ts)
    word = lambda x: '"' + x.replace("&", "&amp;").replace('"', "&quot;") + '"'
    out = [f"  node [ id {i} label {word(s)} ]" for s, i in number.items()]
    for r in edges:
        count = f" freq {r['freq']}" if "freq" in r else ""
        out.append(f"  edge [ source {number[r['src']]} target {number[r['dst']]} label {word(r['label'])}{count} ]")
    return "\n".join(["graph [", "  directed 1", *out, "]", ""])


def pn_from_sis(text: str) -> PetriNet:
    """Arcs between two transitions get a place of their own; weights stand in brackets."""
    s = _sections(text)
    net = PetriNet((s.get("model") or ["net"])[0])
    silent = set(" ".join(s.get("dummy", [])).split())
    for t in " ".join([*s.get("inputs", []), *s.get("outputs", []), *silent]).split():
        net.transition(t, silent=t in silent)
    for line in s.get("graph", [])[1:]:
        source, *targets = re.findall(r"([^\s()]+)(?:\((\d+)\))?", line)
        for target, weight in targets:
            a, b = source[0], target
            if a in net.labels and b in net.labels:
                p = net.place(f"ip{sum(x.startswith('ip') for x in net.initial)}")
                net.arc(a, p)
                net.arc(p, b)
                continue
            if a not in net.labels and b not in net.labels:
                raise ValueError(f"{a} and {b} are both places")
            place = a if b in net.labels else b
            net.initial.setdefault(place, 0)
            net.arc(a, b, int(weight or 1))
    for word in _braces(s.get("marking", [])):
        p, _, n = word.partition("=")
        net.initial[p] = int(n or 1)
    for word in _braces(s.get("capacity", [])):
        p, _, n = word.partition("=")
        net.capacity[p] = int(n or 1)
    return net


def _clean(name: str) -> str:
    name = re.sub(r"[^A-Za-z0-9_]", "", name)
    return name if name[:1].isalpha() else f"t{name}"


def pn_to_sis(net: PetriNet) -> str:
    out = [f".model {_clean(net.name)}", ".outputs " + " ".join(_clean(t) for t in sorted(net.labels) if net.labels[t] is not None)]
    silent = [_clean(t) for t in sorted(net.labels) if net.labels[t] is None]
    out += [".dummy " + " ".join(silent)] * bool(silent) + [".graph"]
    out += [f"{_clean(a)} {_clean(b)}" + (f"({w})" if w > 1 else "") for (a, b), w in sorted(net.arcs.items())]
    if net.capacity:
        out.append(".capacity " + " ".join(f"{_clean(p)}={n}" for p, n in sorted(net.capacity.items())))
    marks = " ".join(_clean(p) + (f"={n}" if n > 1 else "") for p, n in sorted(net.initial.items()) if n)
    return "\n".join([*out, f".marking {{{marks}}}", ".end", ""])


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def pn_from_pnml(text: str) -> PetriNet:
    """Pages are flattened; ``+complete`` is cut; a transition without a name is silent."""
    net = PetriNet()

    def value(x: ET.Element, part: str) -> str | None:
        for c in x:
            if _local(c.tag) == part:
                return next((y.text or "" for y in c.iter() if _local(y.tag) == "text"), None)
        return None

    items = list(ET.fromstring(text).iter())
    for x in items:
        if _local(x.tag) == "place":
            net.place(x.get("id"), int(value(x, "initialMarking") or 0))
        elif _local(x.tag) == "transition":
            name = (value(x, "name") or "").removesuffix("+complete").strip()
            net.transition(x.get("id"), name, silent=not name)
    for x in items:
        if _local(x.tag) == "arc":
            net.arc(x.get("source"), x.get("target"), int(value(x, "inscription") or 1))
    return net


def pn_to_pnml(net: PetriNet) -> str:
    text = lambda tag, v: f"<{tag}><text>{v}</text></{tag}>"
    out = ['<?xml version="1.0" encoding="UTF-8"?>', '<pnml><net id="net" type="http://www.pnml.org/version-2009/grammar/ptnet"><page id="page">']
    out += [f"<place id={quoteattr(p)}>{text('name', p)}{text('initialMarking', n) if n else ''}</place>" for p, n in sorted(net.initial.items())]
    out += [f"<transition id={quoteattr(t)}>{text('name', label or '')}</transition>" for t, label in sorted(net.labels.items())]
    out += [f'<arc id="a{i}" source={quoteattr(a)} target={quoteattr(b)}>{text("inscription", w) if w > 1 else ""}</arc>' for i, ((a, b), w) in enumerate(sorted(net.arcs.items()))]
    return "\n".join([*out, "</page></net></pnml>", ""])


def pn_from_tpn(text: str) -> PetriNet:
    net = PetriNet()
    text = re.sub(r"--[^\n]*", "", text)
    quoted = r'"([^"]*)"'
    for name, n in re.findall(rf"place\s+{quoted}(?:\s+init\s+(\d+))?\s*;", text):
        net.place(name, int(n or 0))
    for name, event, body in re.findall(rf"trans\s+{quoted}(?:\s*~\s*{quoted})?([^;]*);", text):
        net.transition(name, event or name, silent=event == "$invisible$")
        into, _, out = body.partition("out")
        for p in re.findall(quoted, into):
            net.arc(p, name)
        for p in re.findall(quoted, out):
            net.arc(name, p)
    return net


def read_net(path: str) -> PetriNet:
    readers = {"g": pn_from_sis, "tpn": pn_from_tpn, "pnml": pn_from_pnml}
    kind = path.rsplit(".", 1)[-1]
    if kind not in readers:
        raise ValueError(f"cannot tell the format of {path}")
    return readers[kind](read_text(path))


def cnet_to_json(net: Cnet) -> str:
    sets = lambda d: {a: sorted(sorted(b) for b in bs) for a, bs in sorted(d.items())}
    return json.dumps({"input_sets": sets(net.inputs), "output_sets": sets(net.outputs)})


def cnet_to_prom(net: Cnet, old: bool = False, suffix: str = "") -> str:
    """XML of causal nets; ``old`` adds visibility and arcs, ``suffix`` ends all names.

    The first and last task are named only where there is one of them.
    """
    root, ids = ET.Element("cnet"), {a: str(i) for i, a in enumerate(sorted(net.activities))}
    ET.SubElement(root, "net", type="http://www.processmining.org", id="Causal net")
    ET.SubElement(root, "name").text = net.name
    for a, i in ids.items():
        node = ET.SubElement(root, "node", {"id": i} | ({"isInvisible": "false"} if old else {}))
        ET.SubElement(node, "name").text = a + suffix
    for tag, ends in (("startTaskNode", net.starting()), ("endTaskNode", net.final())):
        if len(ends) == 1:
            ET.SubElement(root, tag, id=ids[ends[0]])
    for side, bindings in (("input", net.inputs), ("output", net.outputs)):
        for a in sorted(bindings):
            node = ET.SubElement(root, f"{side}Node", id=ids[a])
            for binding in sorted(map(sorted, bindings[a])):
                part = ET.SubElement(node, f"{side}Set")
                for b in binding:
                    ET.SubElement(part, "node", id=ids[b])
    if old:
        for i, (a, b) in enumerate(sorted(net.arcs()), len(ids)):
            ET.SubElement(root, "arc", id=str(i), source=ids[a], target=ids[b])
    return ET.tostring(root, encoding="unicode", xml_declaration=True)


def cnet_from_json(text: str) -> Cnet:
    data, net = json.loads(text), Cnet()
    for side, key in (("in", "input_sets"), ("out", "output_sets")):
        for a, bindings in data[key].items():
            net.activities.add(a)
            for b in bindings:
                net.add(side, a, b)
    return net


def frequencies_to_json(rows: list[tuple[str, str, list[str], int]]) -> str:
    """``(side, activity, binding, n)`` as two lists of ``[activity, binding, n]``, inputs first."""
    return json.dumps([[[a, sorted(b), n] for s, a, b, n in rows if s == side] for side in ("in", "out")])


def frequencies_from_json(text: str) -> list[tuple[str, str, list[str], int]]:
    return [(side, a, b, n) for side, part in zip(("in", "out"), json.loads(text), strict=True) for a, b, n in part]


def bpmn_to_xml(process: Process) -> str:
    ET.register_namespace("", BPMN_NS)
    tag = lambda x: f"{{{BPMN_NS}}}{x}"
    root = ET.Element(tag("definitions"), targetNamespace="http://caseloom")
    if process.pools:
        meeting = ET.SubElement(root, tag("collaboration"), id="collaboration")
        for name in process.pools:
            ET.SubElement(meeting, tag("participant"), id=f"pool_{name}", name=name, processRef="process")
    p = ET.SubElement(root, tag("process"), id="process", name=process.name)
    pooled = {lane for lanes in process.pools.values() for lane in lanes}
    alone = [lane for lane in process.lanes if lane not in pooled]
    for pool, lanes in [*process.pools.items(), *[(None, alone)] * bool(alone)]:
        group = ET.SubElement(p, tag("laneSet"), {"id": "lanes"} if pool is None else {"id": f"lanes_{pool}", "name": pool})
        for name in lanes:
            lane = ET.SubElement(group, tag("lane"), id=f"lane_{name}", name=name)
            for i in process.lanes[name]:
                ET.SubElement(lane, tag("flowNodeRef")).text = i
    kinds = {"task": lambda e: "task", "gateway": lambda e: f"{e.subtype}Gateway", "event": lambda e: f"{e.subtype or 'intermediateThrow'}Event"}
    for e in process.elements.values():
        ET.SubElement(p, tag(kinds[e.type](e)), id=e.id, name=e.name)
    for i, (a, b) in enumerate(process.edges):
        ET.SubElement(p, tag("sequenceFlow"), id=f"flow{i}", sourceRef=a, targetRef=b)
    return ET.tostring(root, encoding="unicode")


def bpmn_from_xml(text: str) -> Process:
    out, items = Process(), list(ET.fromstring(text).iter())
    pools = {x.get("name") for x in items if _local(x.tag) == "participant"}
    for p in items:
        if _local(p.tag) != "process":
            continue
        out.name = p.get("name") or out.name
        where = {ref.text: lane.get("name") for lane in p.iter() if _local(lane.tag) == "lane" for ref in lane if _local(ref.tag) == "flowNodeRef"}
        for x in p:
            kind, id, name = _local(x.tag), x.get("id"), x.get("name") or ""
            if kind == "laneSet":
                pool = name if name in pools else None
                if pool is not None:
                    out.pools.setdefault(pool, [])
                for lane in x:
                    out.add_lane(lane.get("name"), pool)
            elif kind.lower().endswith("task"):
                out.add("task", name, "", id, where.get(id))
            elif kind.endswith("Gateway"):
                out.add("gateway", name, kind.removesuffix("Gateway"), id, where.get(id))
            elif kind.endswith("Event"):
                out.add("event", name, kind.removesuffix("Event"), id, where.get(id))
        for x in p:
            if _local(x.tag) == "sequenceFlow":
                out.connect(x.get("sourceRef"), x.get("targetRef"))
    return out


def bpmn_to_dot(process: Process) -> str:
    """Edges as wide as their share of the largest count; slow tasks redder."""
    most = max((x.get("freq") or 0 for x in process.edges.values()), default=0) or 1
    means = [e.info["avg_duration"] for e in process.of("task") if e.info.get("avg_duration") is not None]
    mean = sum(means) / len(means) if means else 0
    out = [f'digraph "{process.name}" {{', "  rankdir=LR;"]
    for e in process.elements.values():
        shape = {"task": "box", "gateway": "diamond", "event": "circle"}[e.type]
        color = ""
        if mean and e.info.get("avg_duration") is not None:
            color = f', style=filled, fillcolor="{max(0.15 + 0.15 * (mean - e.info["avg_duration"]) / mean, 0):.3f} 0.6 1.0"'
        out.append(f'  "{e.id}" [label="{e.name or {"parallel": "+", "exclusive": "x", "inclusive": "o"}.get(e.subtype, "")}", shape={shape}{color}];')
    for (a, b), x in process.edges.items():
        n = x.get("freq")
        out.append(f'  "{a}" -> "{b}"' + (f' [label="{n}", penwidth={20 * n / most:.2f}]' if n else "") + ";")
    return "\n".join([*out, "}", ""])
