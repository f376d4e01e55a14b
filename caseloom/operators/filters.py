"""Filters and projections over logs. Each returns a new log with the same metadata."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..log import EventLog


def filter_cases(log: EventLog, keep: DataFrame) -> EventLog:
    """Keep the cases that ``keep`` (a DataFrame with ``case_key``) has."""
    key = keep.select("case_key").distinct()
    cases = None if log.own_cases is None else log.cases.join(key, "case_key", "left_semi")
    return log.with_events(log.events.join(key, "case_key", "left_semi"), cases)


def filter_traces(log: EventLog, predicate: Column, **measures: Column) -> EventLog:
    """Keep cases for which ``predicate`` holds over aggregates of their events.

    ``measures`` names the aggregates, such as ``length=count(lit(1))``; ``length`` is always there. Cases without
    events have length 0 and null elsewhere.
    """
    per = log.events.groupBy("case_key").agg(F.count(F.lit(1)).alias("length"), *[m.alias(n) for n, m in measures.items()])
    if log.own_cases is not None:
        per = log.cases.select("case_key").join(per, "case_key", "left").withColumn("length", F.coalesce("length", F.lit(0)))
    return filter_cases(log, per.where(predicate))


def filter_events(log: EventLog, allowed: list[str]) -> EventLog:
    """Keep events of the allowed activities, then only cases that still have events.

    The filter reaches the scan: it comes before any shuffle.
    """
    events = log.events.where(F.col("activity").isin(allowed))
    cases = None if log.own_cases is None else log.cases.join(events.select("case_key").distinct(), "case_key", "left_semi")
    return log.with_events(events, cases)


def project(log: EventLog, column: str) -> DataFrame:
    """``case_key, values``: one attribute of a case's events in order, missing ones as nulls."""
    gathered = log.events.groupBy("case_key").agg(F.sort_array(F.collect_list(F.struct("event_order", F.col(column).alias("v")))).alias("__e"))
    return gathered.select("case_key", F.transform("__e", lambda e: e["v"]).alias("values"))


def sort_in_case(log: EventLog, ts: str) -> EventLog:
    """Order a case's events by time, equal times by where they stood.

    A case with a missing time keeps the order it has: comparing only some of its events would not be an order.
    """
    whole = Window.partitionBy("case_key")
    bare = F.max(F.col(ts).isNull()).over(whole)
    place = F.struct(F.when(~bare, F.col(ts)).alias("ts"), F.col("event_order").alias("was"))
    return log.with_events(log.events.withColumn("event_order", place), log.own_cases)


def with_event_index(log: EventLog) -> DataFrame:
    """Events numbered from 0 in their case."""
    return log.events.withColumn("event_idx", F.row_number().over(Window.partitionBy("case_key").orderBy("event_order")) - 1)


def first_cases(log: EventLog, n: int, by: Column | None = None) -> EventLog:
    """The first ``n`` cases by ``by`` (the case key unless given); 0 keeps none. Each task keeps n cases at most."""
    cases = log.cases
    return filter_cases(log, cases.orderBy(by if by is not None else F.col("case_key")).limit(n))


def attribute(attrs: str, key: str, fallback: Column) -> Column:
    """A value of an attribute map; the fallback only where the key is absent, not where its value is null."""
    return F.when(F.map_contains_key(attrs, key), F.col(attrs)[key]).otherwise(fallback)


def map_cases(log: EventLog, fn: Callable, schema: str) -> DataFrame:
    """Any function of a case's events (a pandas frame in event order). Prefer column expressions.

    The order is Spark's own, number by number: a case's events are numbered where they are sorted.
    """
    numbered = with_event_index(log)
    return numbered.groupBy("case_key").applyInPandas(lambda pdf: fn(pdf.sort_values("event_idx").drop(columns="event_idx").reset_index(drop=True)), schema)


# positions count from 0, negative ones from the end


def event_at(trace: str, i: int) -> Column:
    return F.try_element_at(F.col(trace), F.lit(i + 1 if i >= 0 else i))


def insert_event(trace: str, i: int, event: Column) -> Column:
    return F.array_insert(F.col(trace), F.lit(i + 1 if i >= 0 else i - 1), event)


def append_event(trace: str, event: Column) -> Column:
    return F.array_append(F.col(trace), event)
