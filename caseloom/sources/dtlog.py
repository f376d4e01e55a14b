"""Delimited traces: one case a line, activities between commas or white space."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import WHITE, trimmed
from ..log import COMPLETE, EventLog
from ..operators.filters import with_event_index

#: First case's time, step between events, step between cases (seconds).
BASE, STEP, GAP = "2024-01-01 00:00:00", 60, 3600


def texts_of(df: DataFrame, text_col: str = "text", doc_col: str | None = None) -> DataFrame:
    """``doc, text``: whole texts, each numbered on its own."""
    return df.select((F.col(doc_col) if doc_col else F.lit(0)).alias("doc"), F.col(text_col).alias("text"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Text files, a value each, as line numbers need the lines before."""
    return texts_of(spark.read.text(path, wholetext=True), "value")


def _activities(line: Column) -> Column:
    """What a trimmed line names: parts between commas if there are any, else between white space."""
    parts = F.filter(F.transform(F.split(line, ","), trimmed), lambda a: a != "")
    return F.when(F.contains(line, F.lit(",")), parts).otherwise(F.split(line, f"[{WHITE}]+"))


def parse(texts: DataFrame) -> tuple[EventLog, DataFrame]:
    """A log and its errors (``doc, line_no, message``) from ``doc, text``.

    Blank lines and ``#`` comments are skipped. A line with a comma is cut at commas, any other at white
    space. A line without activities is an error and takes no case number. Case N of a text starts
    N - 1 hours after the base, its events a minute apart, all of them complete. Lines are numbered inside
    their text, so nothing is shuffled.
    """
    lines = F.transform(F.split("text", r"\r?\n"), lambda x, i: F.struct((i + 1).alias("line_no"), trimmed(x).alias("line")))
    named = F.filter(lines, lambda r: (r["line"] != "") & ~F.startswith(r["line"], F.lit("#")))
    cut = texts.select("doc", F.transform(named, lambda r: F.struct(r["line_no"].alias("line_no"), _activities(r["line"]).alias("acts"))).alias("cut"))
    errors = cut.select("doc", F.explode(F.filter("cut", lambda r: F.size(r["acts"]) == 0)).alias("r"))
    errors = errors.select("doc", "r.line_no", F.concat(F.lit("Line "), F.col("r.line_no"), F.lit(": no activities found")).alias("message"))
    # outer: else Spark first filters on the size of what is exploded, and so parses every text twice
    good = cut.select("doc", F.posexplode_outer(F.filter("cut", lambda r: F.size(r["acts"]) > 0)).alias("i", "r")).where("r is not null")
    good = good.select("doc", (F.col("i") + 1).alias("n"), "r.acts")
    key = F.struct("doc", "n").alias("case_key")
    name = F.concat(F.lit("case-"), F.col("n")).alias("case_id")
    cases = good.select(key, name)
    start = F.to_timestamp(F.lit(BASE))
    events = good.select(key, name, "n", F.posexplode("acts").alias("event_order", "activity")).select(
        "case_key", "case_id", "event_order", "activity",
        F.timestamp_add("SECOND", ((F.col("n") - 1) * GAP + F.col("event_order") * STEP).cast("int"), start).alias("ts"),
        F.lit(COMPLETE).alias("lifecycle"),
    )
    return EventLog(events, cases), errors


def render(log: EventLog) -> DataFrame:
    """``case_key, line``: a line for every case with an activity; commas where a name has white space.

    A lone name of several words gets no comma, so it comes back as several activities.
    """
    named = with_event_index(log).where("activity is not null")
    gathered = named.groupBy("case_key").agg(F.sort_array(F.collect_list(F.struct("event_idx", "activity"))).alias("__e"))
    acts = gathered.select("case_key", F.transform("__e", lambda e: e["activity"]).alias("acts"))
    spaced = F.exists("acts", lambda a: a.rlike(f"[{WHITE}]"))
    return acts.select("case_key", F.when(spaced, F.array_join("acts", ", ")).otherwise(F.array_join("acts", " ")).alias("line"))
