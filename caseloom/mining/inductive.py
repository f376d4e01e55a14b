"""Inductive miner on a compressed log.

A cut looks only at activities, who follows whom, who starts and who ends: at most activities squared
numbers, which Spark counts. A log of many variants is cut and split where it is; once a part has no more
than ``FEW`` variants it is collected, and the recursion goes on over tuples of activities, with the same
result. Group order follows the first appearance of activities.
"""

from __future__ import annotations

from collections import Counter
from functools import cmp_to_key

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..log import EventLog, settled
from ..models.petri import PetriNet
from ..models.tree import Tree, leaf, node, to_petri_net
from ..operators import variants

Log = dict[tuple, int]
#: Variants that are collected at most.
FEW = 10_000


class Follows:
    """What a cut looks at: activities in order of appearance, who follows whom, who starts and ends."""

    def __init__(self, names: list[str], count: Counter, starts: set[str], ends: set[str], noise: float = 0.0):
        self.names, self.count = names, count
        if noise:  # an edge goes if it is rare among those that leave the same activity
            top = Counter()
            for (a, _), n in self.count.items():
                top[a] = max(top[a], n)
            self.count = Counter({(a, b): n for (a, b), n in self.count.items() if n >= noise * top[a]})
        self.edges, self.starts, self.ends = set(self.count), starts, ends
        self.after = {a: [b for b in self.names if (a, b) in self.edges] for a in self.names}

    @classmethod
    def of(cls, log: Log, noise: float = 0.0) -> Follows:
        count = Counter()
        for v, n in log.items():
            for pair in zip(v, v[1:], strict=False):
                count[pair] += n
        return cls(list(dict.fromkeys(a for v in log for a in v)), count, {v[0] for v in log if v}, {v[-1] for v in log if v}, noise)

    def reach(self) -> dict[str, set]:
        """Activities that can come later; not the activity itself."""
        out = {}
        for a in self.names:
            seen, todo = set(), list(self.after[a])
            while todo:
                b = todo.pop()
                if b not in seen:
                    seen.add(b)
                    todo += self.after[b]
            out[a] = seen - {a}
        return out


def classes(names: list, together) -> list[list]:
    """Groups of the closure of a symmetric test, in order of their first members."""
    groups: list[list] = []
    for a in names:
        hit = [g for g in groups if any(together(a, b) for b in g)]
        rest = [g for g in groups if g not in hit]
        merged = [x for g in hit for x in g] + [a]
        groups = rest + [merged]
    order = {a: i for i, a in enumerate(names)}
    return sorted((sorted(g, key=order.get) for g in groups), key=lambda g: order[g[0]])


def exclusive_cut(f: Follows):
    groups = classes(f.names, lambda a, b: (a, b) in f.edges or (b, a) in f.edges)
    return groups if len(groups) > 1 else None


def sequence_cut(f: Follows):
    later = f.reach()
    groups = classes(f.names, lambda a, b: b in later[a] and a in later[b])
    leads = lambda g, h: any(later[a] & set(h) for a in g)
    groups.sort(key=cmp_to_key(lambda g, h: -1 if leads(g, h) else int(leads(h, g))))

    def torn(g, h) -> bool:
        """Some activity has no counterpart on the other side."""
        return not (all(later[a] & set(h) for a in g) and all(any(b in later[a] for a in g) for b in h))

    while (i := next((i for i in range(len(groups) - 1) if torn(groups[i], groups[i + 1])), None)) is not None:
        groups[i : i + 2] = [groups[i] + groups[i + 1]]
    back = any(leads(groups[j], groups[i]) for i in range(len(groups)) for j in range(i + 1, len(groups)))
    return None if len(groups) < 2 or back else groups


def concurrent_cut(f: Follows):
    groups = classes(f.names, lambda a, b: (a, b) not in f.edges or (b, a) not in f.edges)
    whole = all(set(g) & f.starts and set(g) & f.ends for g in groups)
    return groups if len(groups) > 1 and whole else None


def loop_cut(f: Follows):
    """The body first, then what leads from its end back to its start."""
    body = [a for a in f.names if a in f.starts | f.ends]
    rest = [a for a in f.names if a not in f.starts | f.ends]
    if not rest or len(f.names) < 2:
        return None
    redo = classes(rest, lambda a, b: (a, b) in f.edges or (b, a) in f.edges)
    tied = all(any((e, r) in f.edges for e in f.ends for r in g) and any((r, s) in f.edges for s in f.starts for r in g) for g in redo)
    return [body, *redo] if tied else None


def _only(log: Log, keep) -> Log:
    out: Log = {}
    for v, n in log.items():
        w = tuple(a for a in v if a in keep)
        out[w] = out.get(w, 0) + n
    return out


def split_exclusive(log: Log, groups) -> list[Log]:
    """A trace belongs to the first group that has any of its activities."""
    home = {v: next(i for i, g in enumerate(groups) if set(g) & set(v)) for v in log}
    return [_only({v: n for v, n in log.items() if home[v] == i}, set(g)) for i, g in enumerate(groups)]


def loop_parts(trace: list, home: dict[str, int]) -> list[tuple[int, list]]:
    """A trace cut where it goes from one group to another; both its ends belong to the body."""
    at, part, parts = 0, [], []
    for a in trace:
        if home[a] != at:
            parts.append((at, part))
            at, part = home[a], []
        part.append(a)
    return [*parts, (at, part)]


def split_loop(log: Log, groups) -> list[Log]:
    home = {a: i for i, g in enumerate(groups) for a in g}
    out: list[Log] = [{} for _ in groups]
    for v, n in log.items():
        for i, part in loop_parts(list(v), home):
            out[i][tuple(part)] = out[i].get(tuple(part), 0) + n
    return out


def flower(names: set[str]) -> Tree:
    names = sorted(names, key=lambda s: s.encode("utf-16-be"))
    return node("loop", leaf(), node("xor", *map(leaf, names), leaf()))


CUTS = (
    ("xor", exclusive_cut, split_exclusive),
    ("sequence", sequence_cut, lambda log, groups: [_only(log, set(g)) for g in groups]),
    ("parallel", concurrent_cut, lambda log, groups: [_only(log, set(g)) for g in groups]),
    ("loop", loop_cut, split_loop),
)


def mine(log: Log, noise: float = 0.0) -> Tree:
    """Process tree of a compressed log. ``noise`` above 0 looks for cuts again without rare edges before giving up."""
    log = {tuple(v): n for v, n in log.items() if n > 0}
    full = {v: n for v, n in log.items() if v}
    names = {a for v in full for a in v}
    if not full:
        return leaf()
    if len(names) == 1:
        one = leaf(next(iter(names)))
        tree = node("loop", one, leaf()) if any(len(v) > 1 for v in full) else one
        return tree if len(full) == len(log) else node("xor", leaf(), tree)
    if len(full) < len(log):
        return node("xor", leaf(), mine(full, noise))
    for level in dict.fromkeys((0.0, noise)):
        f = Follows.of(log, level)
        for operator, cut, split in CUTS:
            if groups := cut(f):
                return node(operator, *(mine(part, noise) for part in split(log, groups)))
    return flower(names)


def _gathered(rows: DataFrame) -> DataFrame:
    return rows.groupBy("variant").agg(F.sum("cnt").alias("cnt"), F.min("ord").alias("ord"))


def _split(counts: DataFrame, operator: str, groups: list[list[str]]) -> list[DataFrame]:
    """What the splits of a collected log do, as operations on its variants."""
    only = lambda df, g: _gathered(df.withColumn("variant", F.filter("variant", lambda a: a.isin(g))))
    home = F.create_map(*[F.lit(x) for i, g in enumerate(groups) for a in g for x in (a, i)])
    if operator == "xor":
        first = counts.withColumn("__home", F.array_min(F.transform("variant", lambda a: home[a])))
        return [only(first.where(F.col("__home") == i), g) for i, g in enumerate(groups)]
    if operator != "loop":
        return [only(counts, g) for g in groups]
    of = {a: i for i, g in enumerate(groups) for a in g}

    def cut(batches):
        for pdf in batches:
            rows = []
            for v, n, ord in zip(pdf["variant"], pdf["cnt"], pdf["ord"], strict=True):
                for k, (i, part) in enumerate(loop_parts(list(v), of)):
                    rows.append((i, part, n, [*ord, k]))
            yield pd.DataFrame(rows, columns=["part", "variant", "cnt", "ord"])

    parts = settled(counts.mapInPandas(cut, "part int, variant array<string>, cnt long, ord array<long>"))
    return [_gathered(parts.where(F.col("part") == i)) for i in range(len(groups))]


def mine_frame(counts: DataFrame, noise: float = 0.0, few: int | None = None) -> Tree:
    """Process tree of ``variant, cnt, ord``; ``ord`` (an array of longs) puts variants in order of appearance."""
    few = FEW if few is None else few
    counts = settled(counts)
    if len(rows := counts.orderBy("ord").limit(few + 1).collect()) <= few:
        return mine({tuple(r.variant): r.cnt for r in rows}, noise)
    full = counts.where(F.size("variant") > 0)
    bare = full.count() < counts.count()
    names = [r.activity for r in variants.alphabet(full.withColumnRenamed("ord", "first_seen")).orderBy("first_seen", "first_position").collect()]
    if not names:
        return leaf()
    if len(names) == 1:
        tree = node("loop", leaf(names[0]), leaf()) if full.where(F.size("variant") > 1).head(1) else leaf(names[0])
        return node("xor", leaf(), tree) if bare else tree
    if bare:
        return node("xor", leaf(), mine_frame(full, noise, few))
    count = Counter({(r.source, r.target): r.cnt for r in variants.pairs_of(full).collect()})
    ends = [{r[0] for r in full.select(F.element_at("variant", at)).distinct().collect()} for at in (1, -1)]
    for level in dict.fromkeys((0.0, noise)):
        f = Follows(names, count, *ends, level)
        for operator, cut, _ in CUTS:
            if groups := cut(f):
                return node(operator, *(mine_frame(part, noise, few) for part in _split(full, operator, groups)))
    return flower(set(names))


def inductive_miner_uvcl(counts: DataFrame, noise: float = 0.0, sound: bool = False, few: int | None = None) -> tuple[Tree, PetriNet]:
    """From ``variant, cnt`` (and ``first_seen`` for the order of appearance). ``few``: how many variants may be collected."""
    order = [F.col("first_seen")] if "first_seen" in counts.columns else []
    placed = variants.global_rank(counts.where("cnt > 0"), [*order, F.to_json("variant")], "place").select("variant", "cnt", F.array("place").alias("ord"))
    tree = mine_frame(placed, noise, few)
    return tree, to_petri_net(tree, sound)


def inductive_miner(log: EventLog, noise: float = 0.0, sound: bool = False, few: int | None = None) -> tuple[Tree, PetriNet]:
    counts = variants.case_variants(log).groupBy("variant").agg(F.count(F.lit(1)).alias("cnt"), F.min("case_key").alias("first_seen"))
    return inductive_miner_uvcl(counts, noise, sound, few)
