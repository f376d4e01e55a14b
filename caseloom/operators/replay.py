"""Token replay: fitness and precision of a log against a Petri net.

Variants, not cases, are replayed, in parallel; the net is small and goes along with the task. For each activity the
transition of that label fires; if it is not enabled, a shortest run of silent transitions that enables
it is looked for; failing that, the missing tokens are added. A net whose silent steps reach more than
``bound`` markings from one is refused: a search cut short would pass for a trace that does not fit. An activity that the net does not know is
counted as one missing and one remaining token, so the trace does not fit.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..log import EventLog
from ..models.petri import PetriNet
from . import variants


class Replay:
    def __init__(self, net: PetriNet, bound: int = 1_000_000):
        self.bound = bound
        arcs = [(a.source, a.target, a.weight) for a in net.arcs.values()]
        self.take = {t: {s: w for s, x, w in arcs if x == t} for t in net.transitions}
        self.give = {t: {x: w for s, x, w in arcs if s == t} for t in net.transitions}
        self.silent = [t.id for t in net.transitions.values() if t.silent]
        self.named: dict[str, list[str]] = {}
        for t in net.transitions.values():
            if not t.silent:
                self.named.setdefault(t.label, []).append(t.id)
        self.start, self.goal = dict(net.initial_marking), dict(net.final_marking)

    def can(self, m: dict, t: str) -> bool:
        return all(m.get(p, 0) >= w for p, w in self.take[t].items())

    def step(self, m: dict, t: str) -> dict:
        m = dict(m)
        for p, w in self.take[t].items():
            m[p] = m.get(p, 0) - w
        for p, w in self.give[t].items():
            m[p] = m.get(p, 0) + w
        return {p: n for p, n in m.items() if n}

    def silently(self, m: dict) -> Iterator[tuple[dict, list[str]]]:
        """Markings reachable by silent steps, nearest first."""
        seen, todo = {frozenset(m.items())}, deque([(m, [])])
        while todo:
            if len(seen) > self.bound:
                raise RuntimeError(f"silent steps reach more than {self.bound} markings; raise the bound, or check that the net is bounded")
            now, path = todo.popleft()
            yield now, path
            for t in self.silent:
                if self.can(now, t):
                    nxt = self.step(now, t)
                    key = frozenset(nxt.items())
                    if key not in seen:
                        seen.add(key)
                        todo.append((nxt, [*path, t]))

    def run(self, trace: list[str]) -> tuple[int, int, int, int]:
        """Missing, consumed, remaining and produced tokens."""
        m, missing, consumed, produced, extra = dict(self.start), 0, 0, sum(self.start.values()), 0

        def account(ts: list[str]) -> None:
            nonlocal consumed, produced
            consumed += sum(sum(self.take[t].values()) for t in ts)
            produced += sum(sum(self.give[t].values()) for t in ts)

        for a in trace:
            choices = self.named.get(a)
            if not choices:
                missing, extra, consumed, produced = missing + 1, extra + 1, consumed + 1, produced + 1
                continue
            way = next(((now, path, t) for now, path in self.silently(m) for t in choices if self.can(now, t)), None)
            if way:
                m, path, t = way
                account(path)
            else:
                t = choices[0]
                short = {p: w - m.get(p, 0) for p, w in self.take[t].items() if m.get(p, 0) < w}
                missing += sum(short.values())
                m = {**m, **{p: m.get(p, 0) + n for p, n in short.items()}}
            account([t])
            m = self.step(m, t)
        end = next(((now, path) for now, path in self.silently(m) if all(now.get(p, 0) >= w for p, w in self.goal.items())), None)
        if end:
            m, path = end
            account(path)
        lack = sum(max(0, w - m.get(p, 0)) for p, w in self.goal.items())
        remaining = sum(max(0, n - self.goal.get(p, 0)) for p, n in m.items()) + extra
        return missing + lack, consumed + sum(self.goal.values()), remaining, produced

    def along(self, trace: list[str]) -> Iterator[set[str] | None]:
        """Labels that may come after each proper prefix of a trace, the empty one first; None where the net cannot replay it."""
        states = {frozenset(self.start.items())}
        for a in trace:
            wide = {frozenset(now.items()) for s in states for now, _ in self.silently(dict(s))}
            yield {label for label, ts in self.named.items() for s in wide if any(self.can(dict(s), t) for t in ts)} if wide else None
            states = {frozenset(self.step(dict(s), t).items()) for s in wide for t in self.named.get(a, ()) if self.can(dict(s), t)}


def replay_variants(counts: DataFrame, net: PetriNet) -> DataFrame:
    """``variant, cnt, missing, consumed, remaining, produced, fits``, one row a variant."""
    run = Replay(net.executable())

    def each(batches):
        for pdf in batches:
            rows = [run.run(list(v)) for v in pdf["variant"]]
            out = pdf[["variant", "cnt"]].copy()
            for k, name in enumerate(("missing", "consumed", "remaining", "produced")):
                out[name] = [r[k] for r in rows]
            out["fits"] = [r[0] == 0 and r[2] == 0 for r in rows]
            yield out

    return counts.select("variant", "cnt").mapInPandas(each, "variant array<string>, cnt long, missing long, consumed long, remaining long, produced long, fits boolean")


def _share(a, b):
    return F.when(b == 0, F.lit(1.0)).otherwise(a / b)


def fitness(log: EventLog, net: PetriNet) -> DataFrame:
    """One row: ``log_fitness, pct_fitting_traces`` (0 to 1)."""
    rows = replay_variants(variants.uvcl(log), net)
    total = lambda c: F.coalesce(F.sum(F.col(c) * F.col("cnt")), F.lit(0))
    one = rows.agg(total("missing").alias("m"), total("consumed").alias("c"), total("remaining").alias("r"), total("produced").alias("p"), F.coalesce(F.sum(F.when(F.col("fits"), F.col("cnt"))), F.lit(0)).alias("f"), F.coalesce(F.sum("cnt"), F.lit(0)).alias("n"))
    part = lambda a, b: F.when(F.col(b) == 0, F.lit(0.0)).otherwise(F.col(a) / F.col(b))
    return one.select((0.5 * (1 - part("m", "c")) + 0.5 * (1 - part("r", "p"))).alias("log_fitness"), _share(F.col("f"), F.col("n")).alias("pct_fitting_traces"))


def prefix_steps(counts: DataFrame) -> DataFrame:
    """``h1, h2, last, next, cnt`` for every proper prefix of every variant, the empty one included.

    A prefix is told by two 64-bit hashes, which grow by one activity at a time: the exclusive or of the hashes of
    its activities at their places. So no prefix is ever written out, and long cases cost as many rows as events.
    """
    rows = counts.where(F.size("variant") > 0).select(F.xxhash64("variant").alias("v1"), F.hash("variant").alias("v2"), "cnt", F.posexplode("variant").alias("pos", "next"))
    before = Window.partitionBy("v1", "v2").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda salt: F.coalesce(F.bit_xor(F.xxhash64(F.lit(salt), "pos", "next")).over(before), F.lit(0).cast("long"))
    return rows.select(so_far(1).alias("h1"), so_far(2).alias("h2"), F.lag("next").over(Window.partitionBy("v1", "v2").orderBy("pos")).alias("last"), "next", "cnt")


def precision(log: EventLog, net: PetriNet) -> DataFrame:
    """One row: ``precision`` by escaping edges, weighted by cases. Prefixes that do not replay are left out.

    Each variant is replayed once, all its prefixes on the way; equal prefixes of different variants meet by hash.
    """
    run = Replay(net.executable())
    schema = "prefix binary, cnt long, next string, allowed array<string>"

    def each(batches):
        for pdf in batches:
            rows = []
            for variant, cnt in zip(pdf["variant"], pdf["cnt"], strict=True):
                prefix = hashlib.blake2b(digest_size=16)
                for a, may in zip(variant, run.along(list(variant)), strict=True):
                    rows.append((prefix.digest(), cnt, a, sorted(may) if may is not None else None))
                    prefix.update(f"{len(a)}:{a}".encode("utf-8", "surrogatepass"))
            yield pd.DataFrame(rows, columns=["prefix", "cnt", "next", "allowed"])

    steps = variants.uvcl(log).select("variant", "cnt").mapInPandas(each, schema).where("allowed is not null")
    per = steps.groupBy("prefix").agg(F.sum("cnt").alias("cnt"), F.collect_set("next").alias("next"), F.first("allowed").alias("allowed"))
    escaping = F.size(F.array_except("allowed", "next"))
    sums = per.agg(F.coalesce(F.sum(F.col("cnt") * F.size("allowed")), F.lit(0)).alias("a"), F.coalesce(F.sum(F.col("cnt") * escaping), F.lit(0)).alias("e"))
    return sums.select((1 - F.when(F.col("a") == 0, F.lit(0.0)).otherwise(F.col("e") / F.col("a"))).alias("precision"))


def dfg_net(edges: list[tuple[str, str]], starts: list[str], ends: list[str]) -> PetriNet:
    """A place an activity, a transition an edge (labelled by where it leads), silent steps to the end."""
    net = PetriNet("dfg", "dfg_net")
    source, sink = net.place("start", 1), net.place("end", 0, 1)
    at = {a: net.place(a).id for a in dict.fromkeys([*(x for e in edges for x in e), *starts, *ends])}
    for a, b, label in [(source.id, at[s], s) for s in starts] + [(at[x], at[y], y) for x, y in edges] + [(at[e], sink.id, "") for e in ends]:
        t = net.transition(label)
        net.arc(a, t.id)
        net.arc(t.id, b)
    return net


def dfg_conformance(log: EventLog) -> DataFrame:
    """Conformance with the net of the log's own graph: ``log_fitness, pct_fitting_traces, precision``.

    In that net the state is the last activity and every trace replays, so nothing has to be replayed:
    what a prefix allows is the number of edges that leave its last activity.
    """
    counts = variants.uvcl(log)
    edges = variants.pairs_of(counts)
    leave = edges.groupBy(F.col("source").alias("last")).agg(F.count(F.lit(1)).alias("allowed"))
    first = counts.where(F.size("variant") > 0).select(F.col("variant")[0].alias("a")).distinct().agg(F.count(F.lit(1)).alias("starts"))
    per = prefix_steps(counts).groupBy("h1", "h2").agg(F.max("last").alias("last"), F.sum("cnt").alias("cnt"), F.count_distinct("next").alias("seen"))
    rows = per.withColumn("at_start", F.col("last").isNull())
    rows = rows.join(leave, "last", "left").crossJoin(F.broadcast(first))
    allowed = F.when(F.col("at_start"), F.col("starts")).otherwise(F.col("allowed"))
    sums = rows.agg(F.coalesce(F.sum(F.col("cnt") * allowed), F.lit(0)).alias("a"), F.coalesce(F.sum(F.col("cnt") * (allowed - F.col("seen"))), F.lit(0)).alias("e"))
    return sums.select(F.lit(1.0).alias("log_fitness"), F.lit(1.0).alias("pct_fitting_traces"), (1 - F.when(F.col("a") == 0, F.lit(0.0)).otherwise(F.col("e") / F.col("a"))).alias("precision"))


