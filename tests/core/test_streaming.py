from pyspark.sql import functions as F

from caseloom.operators import dfg
from caseloom.plans.logs import from_table
from caseloom.streaming import live

SCHEMA = "case_key string, activity string, ts timestamp, event_id long"


def run(spark, stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
        return spark.table(name).collect()
    finally:
        q.stop()


def test_stream_gives_the_pairs_of_the_log(spark, tmp_path):
    rows = [(f"c{k % 5}", "ABCD"[(k * 7) % 4] if k % 9 else None, k) for k in range(60)]
    df = spark.createDataFrame(rows, "case_key string, activity string, k long")
    df = df.select("case_key", "activity", (F.to_timestamp(F.lit("2024-01-01")) + F.make_dt_interval(F.lit(0), F.lit(0), F.col("k").cast("int"))).alias("ts"), F.col("k").alias("event_id"))
    for part, (a, b) in enumerate(((0, 25), (25, 60))):  # cases go on in the second file
        df.where(f"event_id >= {a} and event_id < {b}").coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(f"{tmp_path}/in")
    got = sorted((r.source, r.target) for r in run(spark, live.stream_pairs(stream), "pairs"))
    want = sorted((r.source, r.target) for r in dfg.case_pairs(from_table(df, ["case_key"], "activity", ["ts", "event_id"])).collect())
    assert got == want


def test_windows_count_activities(spark, tmp_path):
    spark.sql("select 'a' as case_key, 'A' as activity, timestamp'2024-01-01 01:00:00' as ts, 1L as event_id union all select 'a', 'A', timestamp'2024-01-01 05:00:00', 2L union all select 'b', 'B', timestamp'2024-01-04 01:00:00', 3L").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    got = run(spark, live.windowed_counts(stream), "counts", "complete")
    assert sorted((r.activity, r.cnt) for r in got) == [("A", 2), ("B", 1)]


def test_a_long_pause_loses_no_pair_unless_asked(spark, tmp_path):
    for day, (case, a) in enumerate([("x", "A"), ("y", "A"), ("y", "B"), ("x", "B")]):
        spark.sql(f"select '{case}' as case_key, '{a}' as activity, timestamp'2024-01-0{day + 1} 01:00:00' as ts, {day}L as event_id").write.parquet(f"{tmp_path}/in/{day}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    got = sorted((r.case_key, r.source, r.target) for r in run(spark, live.stream_pairs(stream), "pauses"))
    assert got == [("x", "A", "B"), ("y", "A", "B")]
    got = sorted((r.case_key, r.source, r.target) for r in run(spark, live.stream_pairs(stream, forget_after_ms=36 * 3600 * 1000), "forgotten"))
    assert got == [("y", "A", "B")]
