"""Variants: the distinct activity sequences of a log and their counts.

A log is compressed once: events are gathered by case, then cases by sequence. Everything that mines
or replays works on the result. Missing activities are skipped; a case without any is the empty variant.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..log import EventLog, settled


def case_variants(log: EventLog) -> DataFrame:
    """``case_key, variant`` (array), ``first_order`` of the case's first event for stable ties, and ``length`` in events."""
    per = log.events.groupBy("case_key").agg(
        F.sort_array(F.collect_list(F.when(F.col("activity").isNotNull(), F.struct("event_order", "activity")))).alias("__e"),
        F.min("event_order").alias("first_order"),
        F.count(F.lit(1)).alias("length"),
    )
    per = per.select("case_key", F.transform("__e", lambda e: e["activity"]).alias("variant"), "first_order", "length")
    if log.own_cases is None:
        return per
    joined = log.cases.select("case_key").join(per, "case_key", "left")
    return joined.withColumns({"variant": F.coalesce("variant", F.array().cast("array<string>")), "length": F.coalesce("length", F.lit(0))})


def uvcl(log: EventLog) -> DataFrame:
    """``variant, cnt, first_seen``: the compressed log."""
    return case_variants(log).groupBy("variant").agg(F.count(F.lit(1)).alias("cnt"), F.min("first_order").alias("first_seen"))


def variant_cases(log: EventLog) -> DataFrame:
    """``variant, case_key``: a row a case, so that a variant may have any number of them."""
    return case_variants(log).select("variant", "case_key")


def language(counts: DataFrame) -> DataFrame:
    """Share of each variant in the log."""
    total = counts.agg(F.sum("cnt").alias("__total"))
    return counts.crossJoin(F.broadcast(total)).select("variant", (F.col("cnt") / F.col("__total")).alias("probability"))


def global_rank(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """Number rows from 1 in a total order without a single-task sort.

    Rows are range-partitioned and sorted; each partition's numbers start after the rows of those
    before it. The sorted rows are settled, since both passes must see the same partitions.
    """
    spot = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    spot = settled(spot.withColumn("__p", F.shiftrightunsigned("__id", 33)))
    sizes = spot.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    starts = sizes.select("__p", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    rank = (F.col("__start") + F.col("__id").bitwiseAND((1 << 33) - 1) + 1).cast("long")
    return spot.join(F.broadcast(starts), "__p").select(*df.columns, rank.alias(name))


def by_count(counts: DataFrame) -> list:
    """Order by falling count; ties by the sequence's JSON, in code point order."""
    return [F.col("cnt").desc(), F.to_json("variant").asc()]


def sorted_by_count(counts: DataFrame) -> DataFrame:
    return counts.orderBy(*by_count(counts))


def ranked(counts: DataFrame) -> DataFrame:
    """Rank 1..n by falling count, ties by first appearance."""
    return global_rank(counts, [F.col("cnt").desc(), F.col("first_seen").asc(), F.to_json("variant").asc()])


def top(counts: DataFrame, n: int = 20) -> DataFrame:
    """The n most frequent, with their rank; each task keeps n rows at most."""
    best = counts.orderBy(*by_count(counts)).limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*by_count(counts))))


def at_least(counts: DataFrame, min_percent: float, n: int | None = None) -> DataFrame:
    """Variants with ``cnt >= round(min_percent / 100 * largest)`` (half up), then the first n."""
    largest = counts.agg(F.max("cnt").alias("__largest"))
    floor = F.floor(F.lit(min_percent) / 100 * F.col("__largest") + 0.5)
    kept = counts.crossJoin(F.broadcast(largest)).where(F.col("cnt") >= floor).drop("__largest")
    return kept if n is None else top(kept, n)


def bar_percent(counts: DataFrame) -> DataFrame:
    largest = counts.agg(F.max("cnt").alias("__largest"))
    return counts.crossJoin(F.broadcast(largest)).select("variant", "cnt", F.floor(F.col("cnt") / F.col("__largest") * 100 + 0.5).cast("long").alias("percent"))


def cap_runs(counts: DataFrame, at_most: int = 1) -> DataFrame:
    """Cut runs of equal activities to ``at_most`` and add up what becomes equal."""
    cut = F.filter("variant", lambda x, i: (i < at_most) | F.exists(F.sequence(F.lit(1), F.lit(at_most)), lambda k: F.element_at(F.col("variant"), (i - k + 1).cast("int")) != x))
    aggs = [F.sum("cnt").alias("cnt")] + ([F.min("first_seen").alias("first_seen")] if "first_seen" in counts.columns else [])
    return counts.select(F.when(F.size("variant") <= at_most, F.col("variant")).otherwise(cut).alias("variant"), *[c for c in counts.columns if c != "variant"]).groupBy("variant").agg(*aggs)


def pairs_of(counts: DataFrame) -> DataFrame:
    """Directly-follows graph of a compressed log, weighted by count; missing activities are bridged."""
    pair = F.expr("transform(sequence(0, size(variant) - 2), i -> struct(variant[i] as source, variant[i + 1] as target))")
    exploded = counts.where(F.size("variant") >= 2).select(F.explode(pair).alias("p"), "cnt")
    return exploded.groupBy("p.source", "p.target").agg(F.sum("cnt").alias("cnt"))


def alphabet(counts: DataFrame) -> DataFrame:
    """Activities by first appearance: ``activity, first_seen, first_position``."""
    at = counts.select("first_seen", F.posexplode("variant").alias("pos", "activity"))
    return at.groupBy("activity").agg(F.min(F.struct("first_seen", "pos")).alias("m")).select("activity", F.col("m.first_seen").alias("first_seen"), F.col("m.pos").alias("first_position"))


def to_events(counts: DataFrame) -> DataFrame:
    """One minimal trace a variant: ``variant_id, event_idx, activity``."""
    return counts.select(F.to_json("variant").alias("variant_id"), F.posexplode("variant").alias("event_idx", "activity"))
