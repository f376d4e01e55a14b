"""Footprint conformance: directly-follows pairs of a log against those of a model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..log import EventLog
from .dfg import in_case


def footprint(log: EventLog, model: DataFrame) -> DataFrame:
    """One row: ``fitness, precision, pct_fitting, log_pairs, model_pairs, traces, fitting_traces``.

    Events are shuffled once, by case; the model's edges (at most activities squared rows) meet them
    there, so that cases are judged without a further shuffle. Ratios over nothing are 1. A case
    without pairs fits.
    """
    edges = model.select("source", "target").distinct()
    steps = log.events.select("case_key", F.col("activity").alias("source"), F.lead("activity").over(in_case()).alias("target"))
    judged = steps.join(edges.withColumn("known", F.lit(True)), ["source", "target"], "left")
    whole = F.col("source").isNotNull() & F.col("target").isNotNull()
    per_case = judged.groupBy("case_key").agg(F.bool_or(whole & F.col("known").isNull()).alias("unfit"))
    per_case = per_case.agg(F.count(F.lit(1)).alias("traces"), F.count_if("unfit").alias("unfit"))
    if log.own_cases is not None:
        per_case = per_case.select("unfit").crossJoin(log.own_cases.agg(F.count(F.lit(1)).alias("traces")))
    seen = judged.where(whole).groupBy("source", "target").agg(F.first("known").alias("known"))
    of_log = seen.agg(F.count(F.lit(1)).alias("log_pairs"), F.count_if(F.col("known")).alias("shared"))
    one = of_log.crossJoin(edges.agg(F.count(F.lit(1)).alias("model_pairs"))).crossJoin(per_case)
    ratio = lambda a, b: F.when(b == 0, F.lit(1.0)).otherwise(a / b)
    fit = F.col("traces") - F.col("unfit")
    return one.select(
        ratio(F.col("shared"), F.col("log_pairs")).alias("fitness"),
        ratio(F.col("shared"), F.col("model_pairs")).alias("precision"),
        ratio(fit, F.col("traces")).alias("pct_fitting"),
        "log_pairs", "model_pairs", "traces", fit.alias("fitting_traces"),
    )
