"""Pieces shared by the corpus operators: the word pattern, scratch storage and table access."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark's own reader so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared scratch folder that the cluster names. Only Spark on one machine may go without."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="caseloom-"))
    return named or sc.getCheckpointDir()


_written: dict[str, list[str]] = {}


def staged(df: DataFrame) -> DataFrame:
    """Write a table to the shared scratch folder and read it again.

    Later reads do not depend on the executors that made it, and columns can still be pruned. What is
    written stays until ``clear_staged``, since results that are read lazily need it.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/caseloom-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_staged(spark: SparkSession) -> int:
    """Delete what this application has staged, once its results are written; returns how many tables."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    return len(paths)


def parallelism(spark: SparkSession) -> int:
    """Shuffle partitions asked for, the unit in which operators scale their own splits."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
