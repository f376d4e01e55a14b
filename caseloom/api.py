"""Whole answers as plain values: what a service would return as JSON.

Each function takes a log or the path of an XES file. Missing or unusable input is a ``ValueError``.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import __version__
from .log import EventLog
from .mining.inductive import inductive_miner
from .models.petri import PetriNet
from .operators import dfg, replay
from .operators import variants as v
from .sinks.models import Bpmn
from .sources import xes


def status() -> dict:
    return {"status": "ok", "version": __version__}


def load(spark: SparkSession, log: EventLog | str | None) -> EventLog:
    if log is None or log == "":
        raise ValueError("a log is required")
    return xes.read(spark, log) if isinstance(log, str) else log


def load_net(net: PetriNet | str | dict | None) -> PetriNet:
    if not net:
        raise ValueError("a net is required")
    try:
        return net if isinstance(net, PetriNet) else PetriNet.from_json(net)
    except (KeyError, TypeError, json.JSONDecodeError) as e:
        raise ValueError(f"not a net: {e}") from e


def noise(threshold) -> float:
    """A threshold as given in a form; what is no number is 0."""
    try:
        return float(threshold)
    except (TypeError, ValueError):
        return 0.0


def variants(spark: SparkSession, log, at_most: int = 100_000) -> list[dict]:
    """Variants by falling frequency; equal ones by first appearance. A log with more than ``at_most`` is a ``ValueError``: rank them as a table."""
    ranks = v.ranked(v.uvcl(load(spark, log))).where(F.col("rank") <= at_most + 1).orderBy("rank").collect()
    if len(ranks) > at_most:
        raise ValueError(f"more than {at_most} variants")
    return [{"rank": r["rank"], "activities": list(r.variant), "frequency": r.cnt} for r in ranks]


def directly_follows(spark: SparkSession, log) -> dict:
    log = load(spark, log)
    counts = lambda df: {r.activity: r.cnt for r in df.orderBy(F.desc("cnt"), "activity").collect()}
    edges = dfg.dfg(log).orderBy("source", "target").collect()
    return {
        "activities": [{"id": a, "label": a, "frequency": n} for a, n in counts(dfg.activity_counts(log)).items()],
        "edges": [{"source": e.source, "target": e.target, "frequency": e.cnt} for e in edges],
        "startActivities": counts(dfg.start_activities(log)),
        "endActivities": counts(dfg.end_activities(log)),
    }


def inductive_net(spark: SparkSession, log, threshold=0.0) -> dict:
    net = inductive_miner(load(spark, log), noise(threshold))[1]
    net.name = "Discovered Net"
    return net.to_dict()


def inductive_tree(spark: SparkSession, log, threshold=0.0) -> dict:
    return inductive_miner(load(spark, log), noise(threshold))[0].to_dict()


def inductive_bpmn(spark: SparkSession, log, threshold=0.0) -> dict:
    model = Bpmn.of_tree(inductive_miner(load(spark, log), noise(threshold))[0])
    return {"bpmn": model.to_xml(), "simplicity": model.simplicity}


def fitness(spark: SparkSession, log, net) -> dict:
    r = replay.fitness(load(spark, log), load_net(net)).first()
    return {"logFitness": r.log_fitness, "percentageFittingTraces": r.pct_fitting_traces}


def precision(spark: SparkSession, log, net) -> dict:
    return {"precision": replay.precision(load(spark, log), load_net(net)).first()[0]}


def graph_conformance(spark: SparkSession, log) -> dict:
    r = replay.dfg_conformance(load(spark, log)).first()
    return {"logFitness": r.log_fitness, "percentageFittingTraces": r.pct_fitting_traces, "precision": r.precision}
