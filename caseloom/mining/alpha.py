"""Alpha miner on a directly-follows graph.

Relations are computed as joins where the graph lives; the graph itself has at most activities
squared rows and is collected. Sets of activities are bit masks here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..log import EventLog
from ..models.petri import PetriNet
from ..operators import dfg as graph


def pairs_of(edges: list[tuple[str, str]]) -> list[tuple[frozenset, frozenset]]:
    """Maximal pairs (A, B): every a causes every b, and neither side is related within itself."""
    names = list(dict.fromkeys(x for e in edges for x in e))
    bit = {a: 1 << i for i, a in enumerate(names)}
    known = set(edges)
    causes, related = dict.fromkeys(names, 0), dict.fromkeys(names, 0)
    for a, b in edges:
        related[a] |= bit[b]
        related[b] |= bit[a]
        if (b, a) not in known:
            causes[a] |= bit[b]

    def members(mask: int):
        return (a for a in names if bit[a] & mask)

    def apart(x: int, y: int) -> bool:
        return not any(related[a] & y for a in members(x))

    found = [(bit[a], bit[b]) for a, b in edges if causes[a] & bit[b] and (a, a) not in known and (b, b) not in known]
    seen = set(found)
    for i, (a1, b1) in enumerate(found):  # grows on the way
        j = i
        while (j := j + 1) < len(found):
            a2, b2 = found[j]
            if (a1 & a2 == a1 or b1 & b2 == b1) and apart(a1, a2) and apart(b1, b2):
                both = (a1 | a2, b1 | b2)
                if both not in seen and all(causes[a] & both[1] == both[1] for a in members(both[0])):
                    seen.add(both)
                    found.append(both)
    largest = [(a, b) for a, b in found if not any((a, b) != (x, y) and a & x == a and b & y == b for x, y in found)]
    return [(frozenset(members(a)), frozenset(members(b))) for a, b in largest]


def net_of(edges: list[tuple[str, str]], starts: list[str], ends: list[str]) -> PetriNet:
    net = PetriNet("alpha", "alpha_classic_net")
    labels = list(dict.fromkeys([*(x for e in edges for x in e), *starts, *ends]))
    at = {a: net.transition(a, silent=False).id for a in labels}
    source, sink = net.place("start", 1), net.place("end", 0, 1)
    for a in starts:
        net.arc(source.id, at[a])
    for a in ends:
        net.arc(at[a], sink.id)
    for before, after in pairs_of(edges):
        p = net.place()
        for a in sorted(before, key=labels.index):
            net.arc(at[a], p.id)
        for b in sorted(after, key=labels.index):
            net.arc(p.id, at[b])
    net.update_enabled()
    return net


def alpha_miner_dfg(edges: DataFrame, starts: DataFrame, ends: DataFrame) -> PetriNet:
    """From tables ``source, target`` and ``activity``."""
    arcs = [(r.source, r.target) for r in edges.select("source", "target").orderBy("source", "target").collect()]
    names = lambda df: [r.activity for r in df.select("activity").orderBy(F.col("activity")).collect()]
    return net_of(arcs, names(starts), names(ends))


def alpha_miner(log: EventLog) -> PetriNet:
    return alpha_miner_dfg(graph.dfg(log), graph.start_activities(log), graph.end_activities(log))
