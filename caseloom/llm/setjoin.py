"""Exact n-gram Jaccard self-join with set-relation skipping.

Documents with equal shingle sets are one node. Nodes fall into groups by a pair of minimal
shingles, so highly similar sets mostly share a group. An index of prefix shingles lists nodes by
(size, position). A short list is cut into blocks of one size and position; blocks are compared as
wholes, and where size or position rules two of them out, all their members are skipped at once.
Prefixes are longer than one common shingle needs, so that a pair must meet in ``MEET`` lists, which
chance passages don't. In a long list no pair is looked at: its members visit its largest group.
Either way a node only learns which groups to visit, and pairs inside one group are never listed.
Where a group meets its visitors, sets are held as differences from a pivot set, and one set's
answers follow from the pivot's: overlap(x, z) = |p| - |p minus x| - |p minus z| + shared
differences, and sets whose distances to the pivot differ by more than the threshold are skipped.

For components a meeting that is too large for a task is dealt into parts that all get the same few
of its sets besides their own: copies of one text come out as one component, and each text was sent
once. Only sets outside a meeting's largest component are then compared with the rest of it. The
number of links, where it is asked for, needs each pair of parts to meet: every link is verified and
counted, in the smallest of the groups where its two sets meet. What comes back is a spanning forest
and each set's number of links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parallelism, staged
from .components import connected_components
from .hashing import A, B, WordHasher, mix64, shingle_set, values

#: Shingles kept as frequent ones: a fixed bound on what is sent to every task.
HOT = 1 << 19
#: Share of a block's documents from which a shingle counts as frequent there.
OFTEN = 0.0005
#: Members from which a list is long.
LONG = 64
#: Index rows that a task sweeps, about.
LIST_ROWS = 2_000_000
#: Most sets of a part that a meeting is dealt into, of one whose parts meet others, and most shingles of either.
PART, PART_IN_PAIRS, PART_SHINGLES = 256, 1024, 2_000_000
#: Sets of a meeting that all its parts get, about.
SHARED = 16
#: Into how many a join deals the rows of one frequent key.
SALTS = 64
#: Lists in which a linked pair has to meet: sets of overlap o share l shingles in prefixes of |x| - o + l.
MEET = 12


def least_overlap(a, b, percent: int):
    """Smallest intersection with which sets of these sizes reach the threshold."""
    return -(-(percent * (a + b)) // (100 + percent))


def linked(overlap, a, b, percent: int):
    return 100 * overlap >= percent * (a + b - overlap)


def _node(s: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes()))))


def _group(s: np.ndarray) -> int:
    return int(mix64(s[:1] * np.uint64(3) + mix64(s).min()).view(np.int64)[0])


def _profile(n: int):
    """Rows for documents (kind 0) and for shingles that a partition holds often (kind 1)."""
    schema = pa.schema([("kind", pa.int8()), ("doc_id", pa.int64()), ("h", pa.int64()), ("node", pa.int64()), ("grp", pa.int64()), ("size", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, often, pending, held = WordHasher(), {}, [], 0

        def count():
            u, c = np.unique(np.concatenate(pending), return_counts=True)
            least = max(2, int(OFTEN * len(pending)))
            for t, k in zip(u[c >= least].tolist(), c[c >= least].tolist(), strict=True):
                often[t] = often.get(t, 0) + k
            pending.clear()

        for batch in batches:
            ids, out = batch.column("doc_id"), ([], [], [])
            for text in values(batch.column("text")):
                s = shingle_set(hasher(text), n)
                out[0].append(_node(s) if len(s) else None)
                out[1].append(_group(s) if len(s) else None)
                out[2].append(len(s))
                if len(s):
                    pending.append(s)
                    held += len(s)
                if held > 2_000_000:
                    count()
                    held = 0
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(ids), np.int8)), ids, batch.column("h"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], schema=schema)
        if pending:
            count()
        if often:
            t = np.fromiter(often, np.uint64, len(often)).view(np.int64)
            none = pa.nulls(len(t), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(t), np.int8)), none, none, pa.array(t), none, pa.array(list(often.values()), pa.int64())], schema=schema)

    return run


def _postings(n: int, percent: int, frequent):
    """Prefix shingles of each node: shingle, node, group, size, position. ``frequent``: a broadcast, in rising frequency."""
    schema = pa.schema([("tok", pa.int64()), ("node", pa.int64()), ("grp", pa.int64()), ("size", pa.int32()), ("pos", pa.int32())])

    def run(batches):
        hasher, seen, hot = WordHasher(), set(), frequent.value
        order = np.argsort(hot)
        ranked = hot[order]
        for batch in batches:
            parts = []
            for text in values(batch.column(0)):
                s = shingle_set(hasher(text), n)
                if not len(s) or (node := _node(s)) in seen:
                    continue
                seen.add(node)
                grp = _group(s)
                if len(ranked):
                    at = np.minimum(np.searchsorted(ranked, s), len(ranked) - 1)
                    is_hot = ranked[at] == s
                    if is_hot.any():
                        s = np.concatenate([s[~is_hot], hot[np.sort(order[at[is_hot]])]])
                least = -(-percent * len(s) // 100)
                k = len(s) - least + min(MEET, least)
                parts.append((s[:k], node, grp, len(s), np.arange(k, dtype=np.int32)))
            if parts:
                ks = [len(p[0]) for p in parts]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([p[0] for p in parts]).view(np.int64)),
                        *(pa.array(np.repeat(np.array([p[i] for p in parts], np.int64), ks)) for i in (1, 2)),
                        pa.array(np.repeat(np.array([p[3] for p in parts], np.int32), ks)),
                        pa.array(np.concatenate([p[4] for p in parts])),
                    ],
                    schema=schema,
                )

    return run


def _visits(percent: int):
    """Sweep the lists of one partition; yield which group each node has to visit."""
    schema = pa.schema([("node", pa.int64()), ("host", pa.int64()), ("size", pa.int64()), ("met", pa.int64())])

    def run(batches):
        cols = [[], [], [], [], []]
        for b in batches:
            for i in range(5):
                cols[i].append(b.column(i).to_numpy())
        if not cols[0]:
            return
        tok, node, grp, size, pos = (np.concatenate(c) for c in cols)
        size, pos = size.astype(np.int64), pos.astype(np.int64)
        o = np.lexsort((node, pos, size, tok))
        tok, node, grp, size, pos = (x[o] for x in (tok, node, grp, size, pos))
        fresh = np.r_[True, (tok[1:] != tok[:-1]) | (node[1:] != node[:-1])]  # a node has one size and one place for a shingle
        tok, node, grp, size, pos = (x[fresh] for x in (tok, node, grp, size, pos))
        # members that a group has in a list: the larger one plays host
        g = np.lexsort((grp, tok))
        new = np.r_[True, (tok[g][1:] != tok[g][:-1]) | (grp[g][1:] != grp[g][:-1])]
        n_of = np.diff(np.r_[np.flatnonzero(new), len(g)])
        weight = np.empty(len(g), np.int64)
        weight[g] = np.repeat(n_of, n_of)
        first = np.flatnonzero(np.r_[True, tok[1:] != tok[:-1]])
        n_in = np.diff(np.r_[first, len(tok)])
        list_of = np.repeat(np.arange(len(first)), n_in)
        long = (n_in >= LONG)[list_of]

        # long lists: whoever has a neighbour of a similar size visits the largest group
        near = (list_of[1:] == list_of[:-1]) & (size[:-1] * 100 >= percent * size[1:]) & long[1:]
        go = np.r_[near, False] | np.r_[False, near]
        rank = np.lexsort((grp, -weight, list_of))
        largest = grp[rank[first]][list_of]
        who = np.flatnonzero(go & (grp != largest))
        found = [(list_of[who], who, largest[who], np.full(len(who), MEET))]

        # short lists: blocks of one size and position, and the pairs of blocks that these allow
        new = np.r_[True, (list_of[1:] != list_of[:-1]) | (size[1:] != size[:-1]) | (pos[1:] != pos[:-1])]
        block = np.flatnonzero(new)
        many = np.diff(np.r_[block, len(tok)])
        b_list, b_size, b_pos = list_of[block], size[block], pos[block]
        i, step = np.flatnonzero(~long[block]), 0
        while len(i):
            j = i + step
            live = (j < len(block)) & (b_list[np.minimum(j, len(block) - 1)] == b_list[i])
            i, j = i[live], j[live]
            live = b_size[i] * 100 >= percent * b_size[j]  # sizes rise along a list
            i, j = i[live], j[live]
            most = np.minimum(b_pos[i], b_pos[j]) + np.minimum(b_size[i] - b_pos[i], b_size[j] - b_pos[j])  # before, here and after
            hit = (most >= least_overlap(b_size[i], b_size[j], percent)) & ((i != j) | (many[i] > 1))
            n = many[i[hit]] * many[j[hit]]
            if n.sum():
                pair, at = np.repeat(np.flatnonzero(hit), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                a, b = block[i[pair]] + at // many[j[pair]], block[j[pair]] + at % many[j[pair]]
                apart = (a < b) & (grp[a] != grp[b])
                a, b = a[apart], b[apart]
                to_b = (weight[b] > weight[a]) | ((weight[b] == weight[a]) & (grp[b] < grp[a]))
                found.append((list_of[a], np.where(to_b, a, b), np.where(to_b, grp[b], grp[a]), np.ones(len(a), np.int64)))
            step += 1

        at, who, host, count = (np.concatenate(x) for x in zip(*found, strict=True))
        if not len(at):
            return
        both = mix64(node[who].view(np.uint64) * A + host.view(np.uint64) * B)
        o = np.lexsort((at, both))
        at, who, host, both, count = at[o], who[o], host[o], both[o], count[o]
        begins = np.r_[True, both[1:] != both[:-1]]
        once = begins | np.r_[True, at[1:] != at[:-1]]  # a list counts once for a node and a host
        met = np.add.reduceat(np.where(once, count, 0), np.flatnonzero(begins))
        yield pa.RecordBatch.from_arrays([pa.array(node[who[begins]]), pa.array(host[begins]), pa.array(size[who[begins]]), pa.array(met)], schema=schema)

    return run


class _Forest:
    def __init__(self):
        self.up: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        if a != b:
            self.up[a] = b
            self.edges.append((x, y))


class _Index:
    """Which of some sets have an element; counts shared elements with all of them at once."""

    def __init__(self, sets: list[np.ndarray]):
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
        o = np.argsort(flat, kind="stable")
        self.keys, self.owner, self.n = flat[o], owner[o], len(sets)

    def shared(self, s: np.ndarray, at_once: int = 2048) -> np.ndarray:
        out = np.zeros(self.n, np.int64)
        for k in range(0, len(s), at_once):
            part = s[k : k + at_once]
            a, b = np.searchsorted(self.keys, part), np.searchsorted(self.keys, part, side="right")
            n = b - a
            if total := int(n.sum()):
                ends = np.cumsum(n)
                out += np.bincount(self.owner[np.repeat(a - ends + n, n) + np.arange(total)], minlength=self.n)
        return out


class _Cluster:
    """Sets held as differences from a pivot, with an index over the differences."""

    def __init__(self, pivot: np.ndarray, members: np.ndarray, sets: list[np.ndarray], dist: np.ndarray):
        self.pivot, self.members, self.dist = pivot, members, dist
        self.size = np.array([len(sets[m]) for m in members])
        self.deltas, lost = zip(*(self.delta(sets[m]) for m in members), strict=True)
        self.lost = np.array(lost)
        self.index = _Index(list(self.deltas))

    def delta(self, s: np.ndarray) -> tuple[np.ndarray, int]:
        minus = np.setdiff1d(self.pivot, s, assume_unique=True)
        return np.concatenate([np.setdiff1d(s, self.pivot, assume_unique=True), minus]), len(minus)

    def overlaps(self, delta: np.ndarray, lost: int) -> np.ndarray:
        """Overlap of a set with every member, from its difference alone."""
        return len(self.pivot) - lost - self.lost + self.index.shared(delta)


def _distance(overlap, a, b):
    return 1.0 - overlap / np.maximum(a + b - overlap, 1)


class _Links:
    """Links among the sets of a meeting: a spanning forest, and how many rows each set links to.

    ``copies``: rows of each set. ``earlier``: smaller groups where a set takes part; a link between
    sets that share one of them is counted there.
    """

    def __init__(self, copies: np.ndarray, earlier: list[np.ndarray]):
        self.forest, self.copies, self.n = _Forest(), copies, np.zeros(len(copies), np.int64)
        self.earlier, self.at = earlier, np.flatnonzero([len(e) for e in earlier])
        self.index = _Index([earlier[k] for k in self.at])

    def add(self, x: int, others: np.ndarray) -> None:
        """``x`` links to each of ``others``; a pair is added once."""
        for z in others.tolist():
            self.forest.join(x, z)
        if len(self.earlier[x]) and len(others):
            elsewhere = self.at[self.index.shared(self.earlier[x]) > 0]
            others = others[~np.isin(others, elsewhere)]
        self.n[x] += self.copies[others].sum()
        self.n[others] += self.copies[x]


def link_sets(sets: list[np.ndarray], n_own: int, percent: int, links: _Links) -> None:
    """Add all links among all sets, or between the first ``n_own`` and the rest if there is a rest."""
    reach = 1 - percent / 100 + 1e-9
    among = n_own == len(sets)
    if n_own * (len(sets) - 1) <= 48:
        for x in range(n_own):
            for z in range(x + 1 if among else n_own, len(sets)):
                a, b = len(sets[x]), len(sets[z])
                if min(a, b) * 100 >= percent * max(a, b) and linked(len(np.intersect1d(sets[x], sets[z], assume_unique=True)), a, b, percent):
                    links.add(x, np.array([z]))
        return

    own, sizes = _Index(sets[:n_own]), np.array([len(s) for s in sets[:n_own]])
    left, clusters = np.arange(n_own), []
    while len(left):
        p = left[len(left) // 2]
        dist = _distance(own.shared(sets[p])[left], sizes[left], len(sets[p]))
        near = dist <= 0.5
        c = _Cluster(sets[p], left[near], sets, dist[near])
        clusters.append(c)
        if among:
            for k, x in enumerate(c.members.tolist() if len(c.members) > 1 else ()):
                ok = linked(c.overlaps(c.deltas[k], int(c.lost[k])), c.size[k], c.size, percent)
                links.add(x, c.members[:k][ok[:k]])
            # a set outside may still link to a member if both are about as far from the pivot
            for k in np.flatnonzero(~near & (dist <= 0.5 + reach)):
                ring = (c.dist >= dist[k] - reach) & (np.minimum(c.size, sizes[left[k]]) * 100 >= percent * np.maximum(c.size, sizes[left[k]]))
                if ring.any():
                    ov = c.overlaps(*c.delta(sets[left[k]]))
                    links.add(int(left[k]), c.members[ring & linked(ov, sizes[left[k]], c.size, percent)])
        left = left[~near]
    pivots, pivot_size = _Index([c.pivot for c in clusters]), np.array([len(c.pivot) for c in clusters])
    for v in range(n_own, len(sets)):
        a = len(sets[v])
        dist = _distance(pivots.shared(sets[v]), a, pivot_size)
        for k in np.flatnonzero(dist <= 0.5 + reach):
            c = clusters[k]
            ring = np.abs(c.dist - dist[k]) <= reach
            if ring.any():
                ov = c.overlaps(*c.delta(sets[v]))
                links.add(v, c.members[ring & linked(ov, a, c.size, percent)])


def join_sets(nodes: list[int], sets: list[np.ndarray], n_own: int, percent: int) -> list[tuple[int, int]]:
    """Spanning forest of the links that ``link_sets`` finds."""
    links = _Links(np.ones(len(sets), np.int64), [np.zeros(0, np.int64)] * len(sets))
    link_sets(sets, n_own, percent, links)
    return [(nodes[a], nodes[b]) for a, b in links.forest.edges]


def _meet(n: int, percent: int, both: bool):
    """Rows (host, i, j, role, node, copies, earlier, text) sorted by the first four.

    Sets of role 0 meet those of role 1 (in the meetings of ``j`` 0 also each other), or each other if there are none.
    Yields the links of each meeting (a, b) as a forest, and for each node the rows it links to (a, null, n).
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def run(batches):
        hasher, meeting, n_own, known, out = WordHasher(), None, 0, set(), []
        nodes, sets, copies, earlier = [], [], [], []

        def close():
            if n_own and len(sets) > 1:
                links = _Links(np.array(copies, np.int64), earlier)
                link_sets(sets, n_own, percent, links)
                if both and n_own < len(sets) and meeting[2] == 0:
                    link_sets(sets[:n_own], n_own, percent, links)
                out.extend((nodes[a], nodes[b], None) for a, b in links.forest.edges)
                out.extend((nodes[k], None, int(links.n[k])) for k in np.flatnonzero(links.n))

        def batch_of_links():
            batch = pa.RecordBatch.from_arrays([pa.array([e[k] for e in out], pa.int64()) for k in (0, 1, 2)], schema=schema)
            out.clear()
            return batch

        for batch in batches:
            for h, i, j, role, node, rows, before, text in zip(*(values(batch.column(k)) for k in range(8)), strict=True):
                if (h, i, j) != meeting:
                    close()
                    meeting, n_own, known = (h, i, j), 0, set()
                    nodes, sets, copies, earlier = [], [], [], []
                s = shingle_set(hasher(text), n)
                if node in known or not len(s) or _node(s) != node:  # ids may repeat with other texts
                    continue
                known.add(node)
                nodes.append(node)
                sets.append(s)
                copies.append(rows)
                earlier.append(np.array(before or [], np.int64))
                n_own += role == 0
            if len(out) > 10_000:
                yield batch_of_links()
        close()
        if out:
            yield batch_of_links()

    return run


def _salted(many: DataFrame, one: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """Join rows of which many may share a key with the one row that a key has in ``one``."""
    one = one.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return many.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(one, [key, "__salt"], how).drop("__salt")


def _parts_of(there: DataFrame, part: int) -> DataFrame:
    """``host, n, k``: meetings that have to be dealt into ``k`` parts."""
    size = there.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles"))
    return size.select("host", "n", F.ceil(F.greatest(F.col("n") / part, F.col("shingles") / PART_SHINGLES)).cast("int").alias("k")).where("k > 1")


def _part(k: str = "k"):
    return F.pmod(F.xxhash64("node"), k).cast("int")


ROLES = ("host", "i", "j", "role", "node", "doc_id", "h", "copies", "earlier")


def _dealt_once(there: DataFrame, parts: DataFrame) -> DataFrame:
    """Every set goes to one part of its meeting; about ``SHARED`` of them go to all."""
    d = _salted(there, parts, "host", "node", "left").withColumn("k", F.coalesce("k", F.lit(1)))
    shared = (F.col("k") > 1) & (F.pmod(F.xxhash64("host", "node"), F.lit(1 << 30)) * F.col("n") < F.lit(SHARED << 30))
    every = F.when(shared, F.sequence(F.lit(0), F.col("k") - 1)).otherwise(F.array(_part()))
    return d.withColumn("i", F.explode(every)).withColumns({"j": F.lit(0), "role": F.lit(0), "earlier": F.lit(None).cast("array<long>")}).select(*ROLES, "k")


def _dealt_apart(there: DataFrame, parts: DataFrame, roots: DataFrame) -> DataFrame:
    """Of the meetings in parts, sets outside the largest component against all the others."""
    d = _salted(there, parts, "host", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = d.groupBy("host", "root").agg(F.count(F.lit(1)).alias("c"), F.sum("size").alias("s"))
    largest = sizes.groupBy("host").agg(F.max(F.struct("c", "s", "root")).alias("m"), F.sum("c").alias("c"), F.sum("s").alias("s")).where("m.c < c")
    few = F.greatest((F.col("c") - F.col("m.c")) / PART_IN_PAIRS, (F.col("s") - F.col("m.s")) / PART_SHINGLES)
    largest = largest.select("host", F.col("m.root").alias("main"), F.ceil(few).cast("int").alias("few"))
    d = _salted(d, largest, "host", "node").withColumn("k", F.ceil(F.col("k") * F.lit(PART) / F.lit(PART_IN_PAIRS)).cast("int"))
    everyone = d.select("*", F.explode(F.sequence(F.lit(0), F.col("few") - 1)).alias("i"), _part().alias("j"), F.lit(1).alias("role"))
    outside = d.where("root <> main").select("*", _part("few").alias("i"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("j"), F.lit(0).alias("role"))
    return outside.unionByName(everyone).withColumn("earlier", F.lit(None).cast("array<long>")).select(*ROLES)


def _dealt_in_pairs(there: DataFrame, parts: DataFrame) -> DataFrame:
    """Every part of a meeting meets every other. ``earlier``: smaller groups of a set that meets in several."""
    several = there.groupBy("node").agg(F.collect_set("host").alias("hosts")).where(F.size("hosts") > 1)
    there = there.join(several, "node", "left").withColumn("earlier", F.filter("hosts", lambda h: h < F.col("host"))).drop("hosts")
    d = _salted(there, parts, "host", "node", "left").withColumn("k", F.coalesce("k", F.lit(1))).withColumn("p", _part())
    d = d.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    return d.withColumns({"i": F.least("p", "q"), "j": F.greatest("p", "q"), "role": (F.col("p") > F.col("q")).cast("int")}).select(*ROLES, "k")


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, count_links: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_hash, n_shingles, node, root, component_id`` for every row of ``docs``, and ``n_links`` if asked for.

    A-Z is lower-cased; a set is the distinct ``n``-word shingles, the whole sequence for shorter texts.
    Two rows link when ``100 * intersection >= percent * union``; ``component_id`` is the smallest id
    reachable and ``n_links`` the number of other rows that the row links to directly, rows of the same set
    included. To count links takes time with the square of a group of near copies; components don't. Null texts
    and texts without words have an empty set, no ``node``, their own id and no links. ``root`` tells components apart
    where ids don't, as when they are null; ``text_hash`` is Spark's xxhash64 of the text. Equal texts are one node
    however many rows have them. Rows with a null id take part, but never name a component; rows that share an
    id and differ in text are nodes of their own. An empty table gives none. Other columns of ``docs`` are not
    kept, whatever their names. A text is held whole by a task. Sets are compared by 64-bit shingle hashes.
    """
    spark = docs.sparkSession
    tasks = parallelism(spark)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    seen = staged(src.mapInArrow(_profile(n), "kind byte, doc_id long, h long, node long, grp long, size long"))
    rows = seen.where("kind = 0").select("doc_id", "h", "node", "grp", "size")
    top = seen.where("kind = 1").groupBy("node").agg(F.sum("size").alias("c")).orderBy(F.desc("c"), "node").limit(HOT)
    hot = top.select("node").toArrow().column(0).to_numpy()[::-1].view(np.uint64)
    hot = spark.sparkContext.broadcast(np.ascontiguousarray(hot))

    nodes = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min_by("h", F.coalesce("doc_id", F.lit((1 << 63) - 1))).alias("h"), F.min("grp").alias("grp"), F.count(F.lit(1)).alias("copies"), F.min("size").alias("size"))
    nodes = staged(nodes)  # one row that has the set speaks for it: id and text
    shingles, docs_in = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    tasks = max(tasks, -(-(shingles * (100 - percent) // 100 + docs_in * MEET) // LIST_ROWS))

    lists = src.select("text").mapInArrow(_postings(n, percent, hot), "tok long, node long, grp long, size int, pos int")
    met = lists.repartition(tasks, "tok").mapInArrow(_visits(percent), "node long, host long, size long, met long")
    met = met.groupBy("node", "host").agg(F.max("size").alias("size"), F.sum("met").alias("met"))
    # a partner may be smaller, and either of the two may have been host: half of the lists at least
    enough = F.least(F.lit(MEET), F.ceil(F.col("size") * (percent * percent) / F.lit(10_000)))
    visits = staged(met.where(F.col("met") * 2 >= enough).select("node", "host"))
    hosts = visits.select(F.col("host").alias("grp")).unionByName(nodes.groupBy("grp").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("grp")).distinct()
    own = nodes.join(hosts, "grp").select("doc_id", "h", "node", "copies", "size", F.col("grp").alias("host"))
    guests = visits.join(nodes.select("node", "doc_id", "h", "copies", "size"), "node").select("doc_id", "h", "node", "copies", "size", "host")
    there = staged(own.unionByName(guests))
    parts = staged(_parts_of(there, PART_IN_PAIRS if count_links else PART))

    def links_of(texts: DataFrame, both: bool = False) -> DataFrame:
        met = texts.select("host", "i", "j", "role", "node", "copies", "earlier", "text").repartition(tasks, "host", "i", "j").sortWithinPartitions("host", "i", "j", "role")
        return staged(met.mapInArrow(_meet(n, percent, both), "a long, b long, n long"))

    dealt = _dealt_in_pairs(there, parts) if count_links else _dealt_once(there, parts)
    # what is wanted grows with the corpus, so these joins are never broadcasts
    texts = dealt.alias("w").hint("merge").join(src.alias("s"), F.col("w.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("w.h") == F.col("s.h"))).select("w.*", "s.text").drop("doc_id", "h")
    in_parts = not count_links and bool(parts.head(1))
    if in_parts:
        texts = staged(texts)  # those of the meetings in parts are read once more, without the rest of the corpus
    links = links_of(texts)
    edges = links.where("b is not null").select("a", "b")
    roots = connected_components(edges)
    if in_parts:
        again = texts.where((F.col("k") > 1) & (F.col("i") == _part())).select("host", "node", "text")
        apart = links_of(_dealt_apart(there, parts, roots).hint("merge").join(again, ["host", "node"]), True)
        if apart.head(1):
            more = apart.where("b is not null").select("a", "b")
            roots = connected_components(more.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))

    # sets without a link are their own component; only the others are joined by root
    tied = nodes.select("node", "doc_id").join(roots, "node")
    tied = staged(tied.unionByName(nodes.select("node", "doc_id").join(roots.select(F.col("root").alias("node")).distinct(), "node").withColumn("root", F.col("node"))))
    # written first, so that Spark can split the rows of a large component
    smallest = staged(tied.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    tied = tied.join(smallest.hint("merge"), "root").select("node", "root", "component_id")
    named = nodes.select("node", "doc_id", "copies").join(tied, "node", "left")
    named = named.withColumns({"component_id": F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")), "root": F.coalesce("root", "node")})
    if count_links:
        counts = links.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n_links"))
        named = named.join(counts, "node", "left").withColumn("n_links", F.col("copies") - 1 + F.coalesce("n_links", F.lit(0)))
    extra = ["n_links"] if count_links else []
    named = staged(named.select("node", "root", "component_id", *extra))
    out = rows.where("node is not null").join(named, "node").select("doc_id", F.col("h").alias("text_hash"), F.col("size").alias("n_shingles"), "node", "root", "component_id", *extra)
    alone = rows.where("node is null").select("doc_id", F.col("h").alias("text_hash"), F.col("size").alias("n_shingles"), "node", F.col("node").alias("root"), F.col("doc_id").alias("component_id"), *[F.lit(0).cast("long").alias(c) for c in extra])
    return out.unionByName(alone)
