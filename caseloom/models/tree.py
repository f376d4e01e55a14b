"""Process trees."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .petri import PetriNet

OPERATORS = ("xor", "sequence", "parallel", "loop")
#: How operators are drawn.
SYMBOLS = {"xor": "×", "sequence": "→", "parallel": "∧", "loop": "↺"}


@dataclass
class Tree:
    """A leaf has no operator; without a label it is a silent step."""

    operator: str | None = None
    label: str | None = None
    children: list[Tree] = field(default_factory=list)

    def __str__(self) -> str:
        return f"{self.operator}({', '.join(map(str, self.children))})" if self.operator else self.label if self.label is not None else "τ"

    def to_dict(self) -> dict:
        return {"operator": self.operator and self.operator.upper(), "label": self.label, "children": [c.to_dict() for c in self.children]}

    @property
    def leaves(self) -> int:
        return sum(c.leaves for c in self.children) or 1

    @property
    def depth(self) -> int:
        return 1 + max(c.depth for c in self.children) if self.children else 0

    def walk(self, parent: int | None = None, place: int = 0, level: int = 0, ids: Iterator[int] | None = None):
        """``(id, parent, place among siblings, level, node)`` in preorder."""
        ids = ids if ids is not None else iter(range(1 << 60))
        own = next(ids)
        yield own, parent, place, level, self
        for k, c in enumerate(self.children):
            yield from c.walk(own, k, level + 1, ids)

    def dataframe(self, spark: SparkSession) -> DataFrame:
        rows = [(i, p, k, n.operator, n.label, d) for i, p, k, d, n in self.walk()]
        return spark.createDataFrame(rows, "node_id int, parent_id int, ord int, operator string, label string, depth int")


def leaf(label: str | None = None) -> Tree:
    return Tree(None, label)


def node(operator: str, *children: Tree) -> Tree:
    return Tree(operator, None, list(children))


def to_petri_net(tree: Tree, sound: bool = False) -> PetriNet:
    """A net from a place ``start`` to a place ``end``.

    Loops go back over the very places they lie between, so a loop next to siblings can leak into
    them; ``sound`` puts silent steps around each loop instead.
    """
    net = PetriNet("inductive", "inductive_miner_net")
    first, last = net.place("start", 1), net.place("end", 0, 1)

    def step(label: str, a: str, b: str) -> None:
        t = net.transition(label)
        net.arc(a, t.id)
        net.arc(t.id, b)

    def build(n: Tree, a: str, b: str) -> None:
        if n.operator is None:
            step(n.label or "", a, b)
        elif n.operator == "xor":
            for c in n.children:
                build(c, a, b)
        elif n.operator == "sequence":
            stops = [a, *(net.place().id for _ in n.children[1:]), b]
            for c, x, y in zip(n.children, stops, stops[1:], strict=False):
                build(c, x, y)
        elif n.operator == "parallel":
            split, join = net.transition(), net.transition()
            net.arc(a, split.id)
            net.arc(join.id, b)
            for c in n.children:
                x, y = net.place().id, net.place().id
                net.arc(split.id, x)
                net.arc(y, join.id)
                build(c, x, y)
        else:
            x, y = (net.place().id, net.place().id) if sound else (a, b)
            if sound:
                step("", a, x)
                step("", y, b)
            build(n.children[0], x, y)
            for c in n.children[1:]:
                build(c, y, x)

    build(tree, first.id, last.id)
    net.update_enabled()
    return net
