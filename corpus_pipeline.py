"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next one's docs. All but the last return the columns of the documents; an empty table gives an
empty one in every stage, and further columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm import langid, mixing, packing, quality, setjoin
from caseloom.llm.common import staged, table
from caseloom.llm.queries import tokenizer_files

#: Below this score a language is not taken as recognised: texts unlike all learned languages stay below it.
LEAST_SCORE = 0.4
#: Where an unset id stands among others: last.
LAST = (1 << 63) - 1


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, texts that are null, empty or too short among them; the others keep the lines that passed."""
    out = quality.quality_rules(docs).where("kept")
    clean = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}
    return out.select(*[clean.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go, null and empty texts among them; ``lang`` becomes the recognised one.

    Repeated rows stay or go together.
    """
    out = langid.identify(docs, langid.fit(docs)).where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return out.select(*[(F.col("lang_pred") if c == "lang" else F.col(f"`{c}`")).alias(c) for c in docs.columns])


def duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 5-word shingles at a similarity of 0.8 one document stays: the one with the smallest id.

    Unset ids come last, and among equal ids the hash of the text decides, so exactly one row of a group stays
    whatever its ids are. Texts without words are in no group and stay.
    """
    found = staged(setjoin.jaccard_components(docs, n=5, percent=80).select("doc_id", "text_hash", "node", "root"))
    first = F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("i"), F.col("doc_id").alias("doc_id"), F.col("text_hash").alias("h"))
    of_group = found.where("node is not null").groupBy("root").agg(F.min(first).alias("m"))
    rows = found.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("node").isNull()).alias("wordless"))
    k, r = of_group.select(F.col("m.doc_id").alias("k"), F.col("m.h").alias("h")).alias("k"), rows.alias("r")
    keep = r.join(k, F.col("r.doc_id").eqNullSafe(F.col("k.k")) & (F.col("r.text_hash") == F.col("k.h")), "left").where("h is not null or wordless")
    keep = keep.select(F.col("r.doc_id").alias("__id"), F.col("r.text_hash").alias("__h"), (F.col("wordless") | (F.col("n") == 1)).alias("__all"))
    d = docs.withColumn("__own", F.xxhash64("text"))
    kept = d.join(keep, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__h")))
    several = kept.where("not __all").dropDuplicates(["__id", "__h"])
    return kept.where("__all").unionByName(several).select(*[F.col(f"`{c}`") for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target shares: documents repeat or go as the schedule says. Texts without words go."""
    rows, pieces = mixing.mix(docs)
    return mixing.mixed_documents(docs, rows, pieces)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of power-of-two lengths, with their ids; a null text is one closing id."""
    return packing.pack(docs, *tokenizer_files())


STAGES = [
    ("quality rules", quality_stage),
    ("language ID", language_stage),
    ("n-gram Jaccard join", duplicates_stage),
    ("mixing to target weights", mixing_stage),
    ("packing", packing_stage),
]

#: A trained classifier, a seeded shuffle and a tokenizer have no SQL form; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
