"""Two-pass external shuffle into shards (DataFrame expressions only).

Pass one scatters rows by a seeded hash into buckets that fit in a task's memory. Pass two runs
Fisher-Yates on each bucket (the built-in seeded ``shuffle`` of an array) and writes it. A bucket is
chosen by the row's whole content, so a hot key, source or group of copies spreads over all buckets;
only rows equal in every column share one. Bucket sizes are bounded because their number follows
the measured bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LAWS = ("rows", "key")


def record_size(text: Column) -> Column:
    """UTF-8 bytes of a text (null: none) plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def rendezvous(key: Column, n_shards: int, seed: int) -> Column:
    """Shard of a key by highest random weight: one more shard only takes rows into itself."""
    weights = [F.struct(F.xxhash64(F.lit(seed), key, F.lit(i)).alias("w"), F.lit(i).alias("i")) for i in range(n_shards)]
    return (F.greatest(*weights) if n_shards > 1 else weights[0])["i"]


def shuffle_into_shards(
    docs: DataFrame,
    n_shards: int = 8,
    law: str = "rows",
    seed: int = 17,
    bucket_bytes: int = 32 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """All rows with ``shard``, ``slot`` (place in the shard, gapless from 0), ``law`` and ``grown_shard``.

    ``rows``: shards are consecutive ranges of one uniform order, so their counts differ by one at
    most. ``key``: the shard follows from the id and the number of shards alone; ``grown_shard`` is
    the one it would have with one shard more (null under ``rows``). The order depends on seed,
    bucket size and content, not on the cluster. Input columns called ``shard, slot, law,
    grown_shard`` are replaced. Null ids and texts are ordinary values; an empty table gives none. Equal
    rows each have a slot of their own. A bucket, and so a text, is held whole by a task.
    Columns of map type can't be ordered and are not supported.
    """
    if law not in LAWS:
        raise ValueError(f"law must be one of {LAWS}")
    cols = [c for c in docs.columns if c not in ("shard", "slot", "law", "grown_shard")]
    total, rows = docs.agg(F.sum(record_size(F.col(text_col)).cast("decimal(38,0)")), F.count(F.lit(1))).first()
    n_buckets = max(1, -(-int(total or 0) // bucket_bytes))
    key = F.col(id_col)
    h = F.xxhash64(F.lit(seed), key, F.col(text_col))
    if law == "key":
        per = max(1, -(-n_buckets // n_shards))
        n_buckets = per * n_shards
        shard = rendezvous(key, n_shards, seed)
        bucket = (shard * per + F.pmod(h, F.lit(per))).cast("int")
    else:
        bucket = F.pmod(h, F.lit(n_buckets)).cast("int")

    counts = docs.select(bucket.alias("__bucket")).groupBy("__bucket").agg(F.count(F.lit(1)).alias("__rows"))
    group = F.floor(F.col("__bucket") / per).cast("int") if law == "key" else F.lit(0)
    before = Window.partitionBy("__group").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("__group", group).select("__bucket", "__group", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__start"))

    # One bucket to a partition, and one row to a bucket: the seeded generator starts afresh in each.
    buckets = (
        docs.select(bucket.alias("__bucket"), F.struct(h.alias("__h"), *cols).alias("__r"))
        .repartitionById(n_buckets, F.col("__bucket"))
        .groupBy("__bucket")
        .agg(F.sort_array(F.collect_list("__r")).alias("__rs"))
        .select("__bucket", F.shuffle("__rs", F.lit(seed)).alias("__rs"))
    )
    out = buckets.join(starts, "__bucket").select("__group", "__start", F.posexplode("__rs").alias("__pos", "__r"))
    place = F.col("__start") + F.col("__pos")
    if law == "key":
        shard_out, slot = F.col("__group"), place
        grown = rendezvous(F.col(f"__r.{id_col}"), n_shards + 1, seed)
    else:
        q, r = divmod(int(rows), n_shards)
        edge = r * (q + 1)
        long_one = place < F.lit(edge)
        shard_out = F.when(long_one, F.floor(place / F.lit(q + 1))).otherwise(F.floor((place - edge) / F.lit(max(q, 1))) + r)
        slot = F.when(long_one, F.pmod(place, F.lit(q + 1))).otherwise(F.pmod(place - edge, F.lit(max(q, 1))))
        grown = F.lit(None)
    return out.select(
        *[F.col(f"__r.`{c}`").alias(c) for c in cols],
        F.lit(law).alias("law"),
        shard_out.cast("int").alias("shard"),
        slot.cast("long").alias("slot"),
        grown.cast("int").alias("grown_shard"),
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write shards as ``shard=N`` folders; rows carry their slot, and buckets arrive in order."""
    sharded.write.partitionBy("shard").parquet(path)
