"""Models as text: PNML, BPMN 2.0 XML with its diagram."""

from __future__ import annotations

import re

from ..functions.text import half_up
from ..functions.text import xml_escaped as esc
from ..layout.grid import layout_bpmn
from ..models.petri import PetriNet
from ..models.tree import Tree

#: Name spaces and type addresses of the formats.
PNML_NS, PNML_TYPE = "http://www.pnml.org/version-2009/grammar/pnml", "http://www.pnml.org/version-2009/grammar/ptnet"
BPMN_NS = {
    "bpmn": "http://www.omg.org/spec/BPMN/20100524/MODEL",
    "bpmndi": "http://www.omg.org/spec/BPMN/20100524/DI",
    "dc": "http://www.omg.org/spec/DD/20100524/DC",
    "di": "http://www.omg.org/spec/DD/20100524/DI",
}


def to_pnml(net: PetriNet, marking: dict[str, int] | None = None, name: str = "model") -> str:
    """PNML. ``marking`` stands in for the tokens that places have; silent transitions have an empty name."""
    out = ['<?xml version="1.0" encoding="UTF-8"?>', f'<pnml xmlns="{PNML_NS}">', f'  <net id="net" type="{PNML_TYPE}">', f"    <name><text>{esc(name)}</text></name>", '    <page id="page">']

    def add(tag: str, head: str, *body: str) -> None:
        out.extend([f"      <{tag} {head}>", *(f"        {x}" for x in body if x), f"      </{tag}>"])

    spot = lambda n: f'<graphics><position x="{half_up(n.x)}" y="{half_up(n.y)}"/></graphics>'
    title = lambda x: f"<name><text>{esc(x)}</text></name>"
    for p in net.places.values():
        tokens = (marking or {}).get(p.id, p.tokens)
        add("place", f'id="{esc(p.id)}"', title(p.label if p.label is not None else p.id), f"<initialMarking><text>{tokens}</text></initialMarking>" if tokens > 0 else "", spot(p))
    for t in net.transitions.values():
        add("transition", f'id="{esc(t.id)}"', title("" if t.silent else t.label), spot(t))
    for a in net.arcs.values():
        add("arc", f'id="{esc(a.id)}" source="{esc(a.source)}" target="{esc(a.target)}"', f"<inscription><text>{a.weight}</text></inscription>")
    out.append("    </page>")
    if final := {p.id: p.final for p in net.places.values() if p.final}:
        out += ["  <finalmarkings>", "    <marking>", *(f'      <place idref="{esc(k)}"><text>{n}</text></place>' for k, n in final.items()), "    </marking>", "  </finalmarkings>"]
    return "\n".join([*out, "  </net>", "</pnml>"])


class Bpmn:
    """Nodes with a kind (start, end, task, xor, par) and a name, and flows between them."""

    def __init__(self):
        self.kinds: dict[str, str] = {}
        self.names: dict[str, str] = {}
        self.flows: list[tuple[str, str]] = []

    def add(self, kind: str, name: str = "") -> str:
        id = f"{kind}_{len(self.kinds)}"
        self.kinds[id], self.names[id] = kind, name
        return id

    @classmethod
    def of_tree(cls, tree: Tree) -> Bpmn:
        """Gateways around choices, parallel parts and loops; silent steps are just flows."""
        b = cls()

        def build(t: Tree, at: str) -> str:
            """Add a subtree after a node; the node it ends in."""
            if t.operator is None:
                if not t.label:
                    return at
                task = b.add("task", t.label)
                b.flows.append((at, task))
                return task
            if t.operator == "sequence":
                for c in t.children:
                    at = build(c, at)
                return at
            kind = "par" if t.operator == "parallel" else "xor"
            first = b.add(kind)
            b.flows.append((at, first))
            if t.operator == "loop":
                last = b.add(kind)
                b.flows.append((build(t.children[0], first), last))
                for c in t.children[1:]:
                    b.flows.append((build(c, last), first))
                return last
            ends = [build(c, first) for c in t.children]
            last = b.add(kind)
            b.flows += [(e, last) for e in ends]
            return last

        start = b.add("start", "start")
        last = build(tree, start)
        b.flows.append((last, b.add("end", "end")))
        return b

    @property
    def simplicity(self) -> dict[str, int]:
        return {"nodes": len(self.kinds), "constructs": len(self.kinds) + len(self.flows)}

    def to_xml(self) -> str:
        tags = {"start": "startEvent", "end": "endEvent", "task": "task", "xor": "exclusiveGateway", "par": "parallelGateway"}
        bounds, ways = layout_bpmn(self.kinds, self.flows)
        ids = [f"flow_{i}" for i in range(len(self.flows))]
        out = ['<?xml version="1.0" encoding="UTF-8"?>', "<bpmn:definitions " + " ".join(f'xmlns:{k}="{v}"' for k, v in BPMN_NS.items()) + ' targetNamespace="http://bpmn.io/schema/bpmn">', '  <bpmn:process id="process" isExecutable="false">']
        for n, kind in self.kinds.items():
            way = [f"      <bpmn:{d}>{i}</bpmn:{d}>" for d, end in (("incoming", 1), ("outgoing", 0)) for i, f in zip(ids, self.flows, strict=True) if f[end] == n]
            out += [f'    <bpmn:{tags[kind]} id="{n}" name="{esc(self.names[n])}">', *way, f"    </bpmn:{tags[kind]}>"]
        out += [f'    <bpmn:sequenceFlow id="{i}" sourceRef="{a}" targetRef="{b}"/>' for i, (a, b) in zip(ids, self.flows, strict=True)]
        out += ["  </bpmn:process>", '  <bpmndi:BPMNDiagram id="diagram">', '    <bpmndi:BPMNPlane id="plane" bpmnElement="process">']
        for n, (x, y, w, h) in bounds.items():
            out += [f'      <bpmndi:BPMNShape id="{n}_shape" bpmnElement="{n}">', f'        <dc:Bounds x="{x}" y="{y}" width="{w}" height="{h}"/>', "      </bpmndi:BPMNShape>"]
        for i, points in zip(ids, ways, strict=True):
            out += [f'      <bpmndi:BPMNEdge id="{i}_edge" bpmnElement="{i}">', *(f'        <di:waypoint x="{x}" y="{y}"/>' for x, y in points), "      </bpmndi:BPMNEdge>"]
        return mark_exclusive("\n".join([*out, "    </bpmndi:BPMNPlane>", "  </bpmndi:BPMNDiagram>", "</bpmn:definitions>"]))


def mark_exclusive(xml: str) -> str:
    """Have the shapes of exclusive gateways show their marker."""
    gates = re.findall(r'<bpmn:exclusiveGateway\b[^>]*\bid="([^"]+)"', xml)
    for id in dict.fromkeys(gates):
        xml = xml.replace(f'bpmnElement="{id}"', f'bpmnElement="{id}" isMarkerVisible="true"')
    return xml
