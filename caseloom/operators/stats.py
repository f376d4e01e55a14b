"""Summary numbers of a log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..log import EventLog
from . import variants


def upper_median(hist: DataFrame) -> DataFrame:
    """One row with ``median_length``: the element at n // 2 of the sorted lengths.

    ``hist`` is ``length, n``, one row a distinct length, so the window is small however many cases there are.
    """
    whole = Window.orderBy("length").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    hist = hist.withColumn("upto", F.sum("n").over(Window.orderBy("length"))).withColumn("all", F.sum("n").over(whole))
    return hist.where(F.col("upto") > F.floor(F.col("all") / 2)).agg(F.coalesce(F.min("length"), F.lit(0)).alias("median_length"))


def summary(log: EventLog) -> DataFrame:
    """One row: ``traces, events, activities, variants, avg_length, median_length``; zeros for an empty log.

    The log is read once and compressed to variants; all numbers come from those. A case's length counts
    events without an activity too.
    """
    kinds = variants.case_variants(log).groupBy("variant", "length").agg(F.count(F.lit(1)).alias("n"))
    sizes = kinds.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("traces"), F.coalesce(F.sum(F.col("n") * F.col("length")), F.lit(0)).alias("events"), F.count_distinct("variant").alias("variants"))
    names = kinds.select(F.explode("variant").alias("activity")).agg(F.count_distinct("activity").alias("activities"))
    median = upper_median(kinds.groupBy("length").agg(F.sum("n").alias("n")))
    one = sizes.crossJoin(names).crossJoin(median)
    avg = F.when(F.col("traces") > 0, F.col("events") / F.col("traces")).otherwise(F.lit(0.0))
    return one.select("traces", "events", "activities", "variants", avg.alias("avg_length"), F.col("median_length").cast("long").alias("median_length"))
