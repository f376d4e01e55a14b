"""Directly-follows graphs, start and end activities, activity counts.

All of them shuffle events once by case; counts then combine map-side, so frequent activities are
no burden. The graph uses ``lead`` rather than arrays: a case of any length stays a stream of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..log import EventLog, settled


def in_case() -> Window:
    return Window.partitionBy("case_key").orderBy("event_order")


def case_pairs(log: EventLog, window: int = 1) -> DataFrame:
    """``case_key, source, target`` for events ``window`` apart; a pair with a missing side is skipped, not bridged."""
    pairs = log.events.select("case_key", F.col("activity").alias("source"), F.lead("activity", window).over(in_case()).alias("target"))
    return pairs.where("source is not null and target is not null")


def split_pairs(log: EventLog, slices: int | None = None) -> DataFrame:
    """The same pairs of neighbours where single cases are too long for a task each.

    Events are range-partitioned by case and order, so a long case lies in several slices. Neighbours are
    found within a slice; the last event of a slice meets the first of the case's next one, of which
    there are as many as cases and slices together.
    """
    keys = ["case_key", "event_order"]
    events = log.events.select(*keys, "activity")
    spread = events.repartitionByRange(slices, *keys) if slices else events.repartitionByRange(*keys)
    spread = settled(spread.withColumn("slice", F.spark_partition_id()))  # both uses must see the same slices
    inside = Window.partitionBy("case_key", "slice").orderBy("event_order")
    step = spread.select("case_key", "slice", F.col("activity").alias("source"), F.lead("activity").over(inside).alias("target"), F.lead("event_order").over(inside).isNull().alias("last"))
    heads = spread.groupBy("case_key", "slice").agg(F.min(F.struct("event_order", "activity"))["activity"].alias("head"))
    heads = heads.select("case_key", F.lag("slice").over(Window.partitionBy("case_key").orderBy("slice")).alias("slice"), F.lit(True).alias("last"), "head")
    pairs = step.join(heads.where("slice is not null"), ["case_key", "slice", "last"], "left").select("case_key", "source", F.coalesce("target", "head").alias("target"))
    return pairs.where("source is not null and target is not null").select("case_key", "source", "target")


def dfg(log: EventLog, window: int = 1, once_per_case: bool = False, split_cases: bool = False) -> DataFrame:
    """``source, target, cnt``. ``split_cases`` takes another two shuffles, and no longer needs a task to order a whole case."""
    if split_cases and window != 1:
        raise ValueError("cases can be split for neighbours only")
    pairs = split_pairs(log) if split_cases else case_pairs(log, window)
    if once_per_case:
        pairs = pairs.distinct()
    return pairs.groupBy("source", "target").agg(F.count(F.lit(1)).alias("cnt"))


def _ends(log: EventLog, pick) -> DataFrame:
    ends = log.events.groupBy("case_key").agg(pick(F.struct("event_order", "activity"))["activity"].alias("activity"))
    return ends.where("activity is not null").groupBy("activity").agg(F.count(F.lit(1)).alias("cnt"))


def start_activities(log: EventLog) -> DataFrame:
    """First event of each case; a case whose first event has no activity does not count."""
    return _ends(log, F.min)


def end_activities(log: EventLog) -> DataFrame:
    return _ends(log, F.max)


def activities(log: EventLog) -> DataFrame:
    return log.events.select("activity").where("activity is not null").distinct()


def activity_counts(log: EventLog) -> DataFrame:
    return log.events.where("activity is not null").groupBy("activity").agg(F.count(F.lit(1)).alias("cnt"))


def vertices(edges: DataFrame) -> DataFrame:
    """Endpoints of a graph's edges."""
    return edges.select(F.col("source").alias("activity")).union(edges.select("target")).distinct()


def share_of_largest(df: DataFrame, count: str = "cnt") -> Column:
    """``count`` over the largest count, from an aggregate and not a window over all rows."""
    return F.col(count) / F.col("__largest")


def with_largest(df: DataFrame, count: str = "cnt") -> DataFrame:
    """Attach the largest count: one row, so the join is a broadcast of one number."""
    return df.crossJoin(F.broadcast(df.agg(F.max(count).alias("__largest"))))


def edge_thickness(edges: DataFrame) -> DataFrame:
    """Line width 1 to 7 by count."""
    return with_largest(edges).select("source", "target", "cnt", (1 + 6 * share_of_largest(edges)).alias("thickness"))
