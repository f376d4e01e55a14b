"""Mixing sources to target weights by a low-discrepancy schedule (DataFrame expressions only).

A schedule of slots is laid out by golden-ratio points mapped through the cumulative target weights.
The r-th slot of a source takes the r-th block of equal word count of that source's shuffled stream,
which is read again from its start when it ends. Ranks and stream offsets are prefix sums in two
levels (within a part, then over parts), so a source with a third of all rows is spread over
many tasks. Only ids and sizes are moved, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, staged

GOLDEN = 0.6180339887498949
#: Weights by code point of the source name, repeating.
WEIGHTS = (5, 2, 1)
PARTS = 1024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, times: int = 3) -> DataFrame:
    """Per source: ``sid`` (place by code point, null last), ``source_size`` and ``target``.

    Shares of the total follow the weights; a target stops at ``times`` its source's size and the
    excess is shared by weight again until none is above. With sources in order of cap over weight the
    level follows from prefix sums in exact integers. The windows see one row a source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = per.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod("sid", F.lit(len(weights))) + 1).cast("int"))
    one = named.withColumn("w", pick.cast("long")).withColumn("cap", F.col("source_size") * times)
    by = Window.orderBy(F.col("cap") / F.col("w"), "sid")
    before, everything = by.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    one = (
        one.withColumn("__left", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("__w", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("__place", F.row_number().over(by))
        .withColumn("__capped", F.col("cap").cast("decimal(38,0)") * F.col("__w") <= F.col("w").cast("decimal(38,0)") * F.col("__left"))
    )
    level = F.min_by(F.when(~F.col("__capped"), F.struct(F.col("__left").alias("a"), F.col("__w").alias("b"))), F.when(~F.col("__capped"), F.col("__place"))).over(everything)
    one = one.withColumn("__level", level)
    target = F.when(F.col("__capped"), F.col("cap").cast("double")).otherwise(F.col("w") * F.col("__level.a") / F.col("__level.b"))
    return one.select("source", "sid", "source_size", target.cast("double").alias("target"))


def schedule(spark, goals: DataFrame, total: int, block_words: int) -> DataFrame:
    """Slots ``(slot, sid, rank)``: ranks of a source run from 0 to its need, none missing.

    Points beyond a source's need are passed over; a source that the points leave short by a few
    blocks (the discrepancy) has the rest appended after the last slot.
    """
    bins = 16384
    n_slots = -(-total // block_words) if total else 0
    span = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    need = goals.withColumn("need", F.ceil(F.floor("target") / F.lit(block_words)).cast("long"))
    cum = need.withColumn("hi", F.sum("target").over(span)).withColumn("all", F.sum("target").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    ranges = cum.select("sid", "need", ((F.col("hi") - F.col("target")) / F.col("all")).alias("lo"), (F.col("hi") / F.col("all")).alias("hi")).where("hi > lo")
    cells = ranges.withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") * bins).cast("int"), F.least(F.lit(bins - 1), F.floor(F.col("hi") * bins).cast("int")))))
    # frac(j * golden) without losing digits for large j
    j, step = F.col("id"), 1 << 20
    point = F.pmod(F.floor(j / step) * F.lit(step * GOLDEN % 1.0) + F.pmod(j, F.lit(step)) * F.lit(GOLDEN) + F.lit(0.5), F.lit(1.0))
    points = spark.range(n_slots).select(F.col("id").alias("slot"), point.alias("x")).withColumn("bin", F.floor(F.col("x") * bins).cast("int"))
    hit = points.join(cells, "bin").where("x >= lo and x < hi").select("slot", "sid", "need", F.floor(F.col("slot") / 65536).alias("part"))
    counts = hit.groupBy("sid", "part").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(Window.partitionBy("sid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = (
        hit.join(starts.select("sid", "part", "start"), ["sid", "part"])
        .select("slot", "sid", "need", (F.col("start") + F.row_number().over(Window.partitionBy("sid", "part").orderBy("slot")) - 1).alias("rank"))
        .where("rank < need").select("slot", "sid", "rank")
    )
    had = counts.groupBy("sid").agg(F.sum("n").alias("had"))
    short = need.join(had, "sid", "left").withColumn("had", F.coalesce("had", F.lit(0))).where("had < need")
    more = short.select("sid", F.explode(F.sequence(F.col("had"), F.col("need") - 1)).alias("rank"))
    more = more.select((F.lit(n_slots) + F.row_number().over(Window.orderBy("rank", "sid")) - 1).cast("long").alias("slot"), "sid", "rank")
    return ranked.unionByName(more)


def _place(key: Column, text: Column, seed: int) -> Column:
    """Where a row stands in its source's shuffled stream."""
    return F.xxhash64(F.lit(seed), key, text).bitwiseAND(F.lit((1 << 63) - 1))


def mix(
    docs: DataFrame,
    block_words: int = 2048,
    weights: tuple[int, ...] = WEIGHTS,
    times: int = 3,
    seed: int = 29,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> tuple[DataFrame, DataFrame]:
    """Return ``(rows, pieces)``.

    ``rows``: one for each row of ``docs`` with ``uid`` (unique), ``doc_id, source, size, source_size,
    target``. ``pieces``: what the mix takes, in the order of ``slot``: ``uid, pass, start, words``
    (words ``start`` to ``start + words`` of that row's text, in the ``pass``-th reading of the source).
    A source's pieces sum to its target rounded down; no row is read more than ``times`` times.
    Order depends on content and seed only. Null sources form a source of their own; null or
    empty texts have size 0 and no pieces; equal rows are rows of their own; an empty table gives none.
    Very long texts are cut into pieces of many blocks. Other columns of ``docs`` are not looked at.
    """
    spark = docs.sparkSession
    text, key = F.col(text_col), F.col(id_col)
    h = _place(key, text, seed)
    sized = staged(docs.select(key.alias("doc_id"), F.col(source_col).alias("source"), word_count(text).alias("size"), h.alias("h")))
    sized = sized.withColumn("part", F.shiftright("h", 53).cast("int"))
    goals = staged(targets(sized, weights, times))
    total = int(goals.agg(F.sum("source_size")).first()[0] or 0)

    parts = sized.groupBy("source", "part").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    parts = parts.alias("p").join(goals.alias("g"), F.col("p.source").eqNullSafe(F.col("g.source"))).select("p.source", "p.part", "p.start", "g.sid", "g.source_size", "g.target")
    joined = sized.alias("d").join(parts.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.part") == F.col("p.part")))
    inside = Window.partitionBy("p.sid", "d.part").orderBy("d.h", "d.doc_id", "d.size")
    rows = joined.select(
        "d.doc_id", "d.h", "d.source", "d.size", "p.source_size", "p.target", "p.sid",
        F.concat_ws("-", "p.sid", "d.part", F.row_number().over(inside)).alias("uid"),
        (F.col("p.start") + F.coalesce(F.sum("d.size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("at"),
    )
    rows = staged(rows)
    taken = rows.where("size > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    taken = taken.withColumn("u", F.col("pass") * F.col("source_size") + F.col("at")).withColumn("v", F.least(F.col("u") + F.col("size"), F.floor("target"))).where("u < v")
    taken = taken.withColumn("rank", F.explode(F.sequence(F.floor(F.col("u") / block_words), F.floor((F.col("v") - 1) / block_words))))
    a, b = F.greatest("u", F.col("rank") * block_words), F.least("v", (F.col("rank") + 1) * block_words)
    taken = taken.select("sid", "rank", "uid", "doc_id", "pass", (a - F.col("u")).alias("start"), (b - a).alias("words"))
    pieces = taken.join(schedule(spark, goals, total, block_words), ["sid", "rank"]).select("slot", "uid", "doc_id", "pass", "start", "words")
    return rows, pieces


def mixed_counts(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    """``rows`` with ``taken``: the words the pieces take from each row, repeats counted."""
    both = rows.select("uid", "doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken")).unionByName(
        pieces.select("uid", F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("bigint").alias("size"), F.lit(None).cast("bigint").alias("source_size"), F.lit(None).cast("double").alias("target"), F.col("words").cast("long").alias("taken"))
    )
    return both.groupBy("uid").agg(*[F.max(c).alias(c) for c in ("doc_id", "size", "source_size", "target")], F.sum("taken").alias("taken"))


def mixed_documents(docs: DataFrame, rows: DataFrame, pieces: DataFrame, seed: int = 29, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The mix as rows of ``docs``: one for each reading of a row, with the text that is taken from it.

    A reading that the target cuts short (one a source at most) has the words taken, single-spaced.
    Rows equal in id and text are told apart by number, so each meets its own readings once. The columns
    are those of ``docs``; names that begin with two underscores are the operator's own.
    """
    cols, same = docs.columns, ["__id", "__h"]
    reads = pieces.groupBy("uid", "pass").agg(F.min("start").alias("__start"), F.sum("words").alias("__words"))
    number = Window.partitionBy(*same)
    own = rows.select("uid", F.col("doc_id").alias("__id"), F.col("h").alias("__h"), F.col("size").alias("__size"))
    own = own.withColumn("__no", F.row_number().over(number.orderBy("uid"))).join(reads, "uid")
    full = docs.withColumn("__id", F.col(id_col)).withColumn("__h", _place(F.col(id_col), F.col(text_col), seed))
    full = full.withColumn("__no", F.row_number().over(number.orderBy("__h"))).alias("d")
    own = own.alias("o")
    both = full.join(own, F.col("d.__h").eqNullSafe(F.col("o.__h")) & F.col("d.__id").eqNullSafe(F.col("o.__id")) & (F.col("d.__no") == F.col("o.__no")))
    some = F.array_join(F.slice(F.regexp_extract_all(F.col(f"d.{text_col}"), F.lit(WORD), F.lit(0)), (F.col("__start") + 1).cast("int"), F.col("__words").cast("int")), " ")
    text = F.when(F.col("__words") == F.col("__size"), F.col(f"d.{text_col}")).otherwise(some)
    return both.select(*[text.alias(c) if c == text_col else F.col(f"d.`{c}`") for c in cols])
