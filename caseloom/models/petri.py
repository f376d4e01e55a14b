"""Petri nets as small driver objects, and as DataFrames for queries."""

from __future__ import annotations

import json
import random
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

#: Arc types of the interchange format. Only the first two gate firing, ``reset`` empties a place.
ARC_TYPES = ("regular", "inhibitor", "read", "reset", "modifier")


@dataclass
class Place:
    id: str
    label: str = ""
    tokens: int = 0
    capacity: int | None = None
    final: int | None = None
    x: float = 0.0
    y: float = 0.0

    def add(self, n: int) -> bool:
        """Tokens above the capacity are refused as a whole."""
        fits = self.capacity is None or self.tokens + n <= self.capacity
        self.tokens += n if fits else 0
        return fits

    def take(self, n: int) -> bool:
        enough = self.tokens >= n
        self.tokens -= n if enough else 0
        return enough

    @property
    def has_final(self) -> bool:
        return self.final is not None and self.final >= 0

    @property
    def is_final(self) -> bool:
        return self.final is not None and self.tokens == self.final


@dataclass
class Transition:
    id: str
    label: str = ""
    silent: bool = False
    priority: int = 1
    delay: float = 0.0
    weight: float | None = None
    x: float = 0.0
    y: float = 0.0
    enabled: bool = False


@dataclass
class Arc:
    id: str
    source: str
    target: str
    weight: int = 1
    type: str = "regular"
    label: str = ""
    points: list = field(default_factory=list)


class PetriNet:
    """Places, transitions and arcs by id, in order of addition. New ids count up, so equal inputs give equal nets."""

    def __init__(self, id: str = "net", name: str = "net", description: str = ""):
        self.id, self.name, self.description = id, name, description
        self.places: dict[str, Place] = {}
        self.transitions: dict[str, Transition] = {}
        self.arcs: dict[str, Arc] = {}

    def place(self, label: str = "", tokens: int = 0, final: int | None = None, id: str | None = None, capacity: int | None = None) -> Place:
        p = Place(id or f"p{len(self.places)}", label, tokens, capacity, final)
        self.places[p.id] = p
        return p

    def transition(self, label: str = "", silent: bool | None = None, id: str | None = None) -> Transition:
        t = Transition(id or f"t{len(self.transitions)}", label, silent if silent is not None else not label.strip())
        self.transitions[t.id] = t
        return t

    def arc(self, source: str, target: str, weight: int = 1, type: str = "regular", id: str | None = None) -> bool:
        """Add an arc between a place and a transition; False for anything else."""
        if not ((source in self.places and target in self.transitions) or (source in self.transitions and target in self.places)):
            return False
        a = Arc(id or f"a{len(self.arcs)}", source, target, weight, type)
        self.arcs[a.id] = a
        return True

    def remove(self, id: str) -> None:
        """Remove a node or an arc; a node takes its arcs along."""
        self.arcs.pop(id, None)
        if self.places.pop(id, None) or self.transitions.pop(id, None):
            self.arcs = {k: a for k, a in self.arcs.items() if id not in (a.source, a.target)}

    def inputs(self, t: str) -> list[tuple[Arc, Place]]:
        return [(a, self.places[a.source]) for a in self.arcs.values() if a.target == t and a.source in self.places]

    def outputs(self, t: str) -> list[tuple[Arc, Place]]:
        return [(a, self.places[a.target]) for a in self.arcs.values() if a.source == t and a.target in self.places]

    def is_enabled(self, t: str) -> bool:
        """Regular arcs need their tokens, inhibitor arcs their absence; read, reset and modifier arcs never gate."""
        blocked = {"regular": lambda a, p: p.tokens < a.weight, "inhibitor": lambda a, p: p.tokens >= a.weight}
        return not any(blocked[a.type](a, p) for a, p in self.inputs(t) if a.type in blocked)

    def fire(self, t: str) -> bool:
        if not self.is_enabled(t):
            return False
        for a, p in self.inputs(t):
            if a.type == "regular":
                p.take(a.weight)
            elif a.type == "reset":
                p.tokens = 0
        for a, p in self.outputs(t):
            p.add(a.weight)
        return True

    def update_enabled(self) -> list[str]:
        for t in self.transitions.values():
            t.enabled = self.is_enabled(t.id)
        return [t.id for t in self.transitions.values() if t.enabled]

    def simulate(self, steps: int, seed: int = 0) -> list[str]:
        """Fire enabled transitions at random; stops early in a deadlock."""
        rng, fired = random.Random(seed), []
        while len(fired) < steps and (ready := self.update_enabled()):
            fired.append(rng.choice(ready))
            self.fire(fired[-1])
        return fired

    @property
    def initial_marking(self) -> dict[str, int]:
        return {p.id: p.tokens for p in self.places.values() if p.tokens}

    @property
    def final_marking(self) -> dict[str, int]:
        return {p.id: p.final for p in self.places.values() if p.final}

    # ---- interchange -----------------------------------------------------------------------------

    def to_dict(self) -> dict:
        at = lambda n: {"x": n.x, "y": n.y}
        return {
            "schemaVersion": "1.0",
            "id": self.id,
            "name": self.name,
            "description": self.description,
            "netType": "ptnet",
            "places": [{"id": p.id, "label": p.label, "tokens": p.tokens, "capacity": p.capacity, "finalMarking": p.final, "position": at(p)} for p in self.places.values()],
            "transitions": [{"id": t.id, "label": t.label, "silent": t.silent, "priority": t.priority, "delay": t.delay, "weight": t.weight, "position": at(t)} for t in self.transitions.values()],
            "arcs": [{"id": a.id, "source": a.source, "target": a.target, "weight": a.weight, "type": a.type, "label": a.label, "points": a.points} for a in self.arcs.values()],
        }

    def to_json(self) -> str:
        return json.dumps(self.to_dict())

    @classmethod
    def from_json(cls, data: str | dict) -> PetriNet:
        """Read the interchange form. A blank label makes a transition silent; arcs are taken as they are."""
        d = json.loads(data) if isinstance(data, str) else data
        net = cls(d.get("id", "net"), d.get("name", "net"), d.get("description", "") or "")
        spot = lambda x: {k: (x.get("position") or {}).get(k, 0.0) for k in ("x", "y")}
        for p in d.get("places") or []:
            net.places[p["id"]] = Place(p["id"], p.get("label") or "", p.get("tokens") or 0, p.get("capacity"), p.get("finalMarking"), **spot(p))
        for t in d.get("transitions") or []:
            label = t.get("label") or ""
            net.transitions[t["id"]] = Transition(t["id"], label, bool(t.get("silent")) or not label.strip(), t.get("priority") or 1, t.get("delay") or 0.0, t.get("weight"), **spot(t))
        for a in d.get("arcs") or []:
            net.arcs[a["id"]] = Arc(a["id"], a["source"], a["target"], a.get("weight") or 1, a.get("type") or "regular", a.get("label") or "", a.get("points") or [])
        return net

    def executable(self) -> PetriNet:
        """What replay works on: arcs with unknown ends, capacities and arc types are dropped."""
        net = PetriNet(self.id, self.name)
        for p in self.places.values():
            net.place(p.label, p.tokens or 0, p.final or None, p.id)
        for t in self.transitions.values():
            net.transition("" if t.silent else t.label, id=t.id)
        for a in self.arcs.values():
            net.arc(a.source, a.target, a.weight, id=a.id)
        return net

    def dataframes(self, spark: SparkSession) -> dict[str, DataFrame]:
        return {
            "places": spark.createDataFrame([(p.id, p.label, p.tokens, p.capacity, p.final, p.x, p.y) for p in self.places.values()], "id string, label string, tokens int, capacity int, final_marking int, x double, y double"),
            "transitions": spark.createDataFrame([(t.id, t.label, t.silent, t.x, t.y) for t in self.transitions.values()], "id string, label string, silent boolean, x double, y double"),
            "arcs": spark.createDataFrame([(a.id, a.source, a.target, a.weight, a.type) for a in self.arcs.values()], "id string, source string, target string, weight int, type string"),
        }
