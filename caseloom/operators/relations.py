"""Order relations between activities, as joins of the edge table with itself turned round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _turned(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("target").alias("source"), F.col("source").alias("target")).distinct()


def causal(edges: DataFrame) -> DataFrame:
    """Followed one way only."""
    return edges.select("source", "target").join(_turned(edges), ["source", "target"], "left_anti")


def parallel(edges: DataFrame) -> DataFrame:
    """Followed both ways; an activity that follows itself is parallel to itself."""
    return edges.select("source", "target").join(_turned(edges), ["source", "target"], "left_semi")


def initial_pairs(edges: DataFrame) -> DataFrame:
    """Causal pairs of which neither side follows itself."""
    own = edges.where("source = target").select(F.col("source").alias("a"))
    pairs = causal(edges)
    return pairs.join(own, pairs.source == own.a, "left_anti").join(own, F.col("target") == own.a, "left_anti")
