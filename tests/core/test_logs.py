"""Variants, graphs, filters, summaries and footprints on small logs."""

import pytest
from pyspark.sql import functions as F

from caseloom.log import EventLog
from caseloom.operators import dfg, filters, footprint, relations, stats, variants
from caseloom.plans.logs import of_sequences, requests


def log_of(spark, *seqs):
    return of_sequences(spark, {f"case-{k + 1}": list(s) for k, s in enumerate(seqs)})


@pytest.fixture(scope="module")
def small(spark):
    return log_of(spark, "ABC", "AC", "ABC")


def counts(df):
    return {("".join(r.variant)): r.cnt for r in df.collect()}


def edges(df):
    return {r.source + r.target: r.cnt for r in df.collect()}


def acts(df):
    return {r.activity: r.cnt for r in df.collect()}


def test_variants_and_language(small):
    u = variants.uvcl(small)
    assert counts(u) == {"ABC": 2, "AC": 1}
    assert {"".join(r.variant): round(r.probability, 4) for r in variants.language(u).collect()} == {"ABC": 0.6667, "AC": 0.3333}
    assert sorted(("".join(r.variant), r.case_key) for r in variants.variant_cases(small).collect()) == [("ABC", 0), ("ABC", 2), ("AC", 1)]
    assert ["".join(r.variant) for r in variants.sorted_by_count(u).collect()] == ["ABC", "AC"]


def test_graph_windows_and_once_per_case(spark, small):
    assert edges(dfg.dfg(small)) == {"AB": 2, "BC": 2, "AC": 1}
    assert edges(dfg.dfg(small, window=2)) == {"AC": 2}
    abab = log_of(spark, "ABAB")
    assert edges(dfg.dfg(abab)) == {"AB": 2, "BA": 1} and edges(dfg.dfg(abab, once_per_case=True)) == {"AB": 1, "BA": 1}
    assert acts(dfg.start_activities(small)) == {"A": 3} and acts(dfg.end_activities(small)) == {"C": 3}
    assert {r.activity for r in dfg.vertices(dfg.dfg(small)).collect()} == set("ABC")
    assert {r.source + r.target: r.thickness for r in dfg.edge_thickness(dfg.dfg(small)).collect()} == {"AB": 7, "BC": 7, "AC": 4}


def test_split_cases_give_the_same_pairs(spark):
    rows = [("hot" if k % 3 else f"c{k % 7}", k, None if k % 11 == 0 else "ABCDE"[(k * k) % 5]) for k in range(900)] + [("one", 1, "A")]
    log = EventLog(spark.createDataFrame(rows, "case_key string, event_order int, activity string").repartition(5))
    want = edges(dfg.dfg(log))
    assert edges(dfg.dfg(log, split_cases=True)) == want
    got = dfg.split_pairs(log, 9).groupBy("source", "target").agg(F.count(F.lit(1)).alias("cnt"))
    assert edges(got) == want
    with pytest.raises(ValueError):
        dfg.dfg(log, window=2, split_cases=True)


def test_missing_activities_and_empty_cases(spark):
    log = of_sequences(spark, {"1": ["A", None, "B"], "2": [], "3": [None, "A"]})
    assert counts(variants.uvcl(log)) == {"AB": 1, "": 1, "A": 1}
    assert edges(dfg.dfg(log)) == {}  # not bridged
    assert edges(variants.pairs_of(variants.uvcl(log))) == {"AB": 1}  # bridged
    assert acts(dfg.start_activities(log)) == {"A": 1} and acts(dfg.end_activities(log)) == {"B": 1, "A": 1}
    assert acts(dfg.activity_counts(log)) == {"A": 2, "B": 1}
    s = stats.summary(log).first()
    assert (s.traces, s.events, s.activities, s.variants, s.median_length) == (3, 5, 2, 3, 2)


def test_runs_are_capped_and_added_up(spark):
    u = variants.uvcl(log_of(spark, "ABBBC", "ABBBC", "ABC", "ABC", "ABC"))
    assert counts(variants.cap_runs(u, 1)) == {"ABC": 5}
    assert counts(variants.cap_runs(u, 2)) == {"ABBC": 2, "ABC": 3}


def test_ranks_tops_and_percentages(spark):
    u = variants.uvcl(log_of(spark, *["A"] * 5, *["B"] * 3, *["C"] * 3, "D"))
    assert [("".join(r.variant), r["rank"]) for r in variants.ranked(u).orderBy("rank").collect()] == [("A", 1), ("B", 2), ("C", 3), ("D", 4)]
    assert [("".join(r.variant)) for r in variants.top(u, 2).orderBy("rank").collect()] == ["A", "B"]
    assert counts(variants.at_least(u, 50)) == {"A": 5, "B": 3, "C": 3}
    assert counts(variants.at_least(u, 50, 1)) == {"A": 5}
    assert {"".join(r.variant): r.percent for r in variants.bar_percent(u).collect()} == {"A": 100, "B": 60, "C": 60, "D": 20}


def test_ranks_are_gapless_over_many_partitions(spark):
    df = spark.range(5000).select(F.array(F.col("id").cast("string")).alias("variant"), (F.col("id") % 17).alias("cnt"), F.col("id").alias("first_seen"))
    out = variants.ranked(df).orderBy("rank").collect()
    assert [r["rank"] for r in out] == list(range(1, 5001))
    assert [(-r.cnt, r.first_seen) for r in out] == sorted((-r.cnt, r.first_seen) for r in out)


def test_filters(spark, small):
    kept = filters.filter_events(small, ["B"])
    assert kept.cases.count() == 2 and counts(variants.uvcl(kept)) == {"B": 2}
    long = filters.filter_traces(small, F.col("length") > 2)
    assert sorted(r.case_key for r in long.cases.collect()) == [0, 2] and small.cases.count() == 3
    has_b = filters.filter_traces(small, F.col("b"), b=F.bool_or(F.col("activity") == "B"))
    assert counts(variants.uvcl(has_b)) == {"ABC": 2}
    assert filters.first_cases(small, 0).cases.count() == 0 and filters.first_cases(small, 2).cases.count() == 2
    assert {r.case_key: r["values"] for r in filters.project(small, "activity").collect()}[1] == ["A", "C"]
    again = filters.map_cases(small, lambda pdf: pdf[["case_key", "activity"]].iloc[::-1], "case_key long, activity string")
    assert again.count() == 8


def test_sort_in_case_is_stable_and_leaves_gaps_alone(spark):
    rows = [(0, 0, "B", "2024-01-01 12:00:00"), (0, 1, "A", "2024-01-01 08:00:00"), (0, 2, "C", "2024-01-01 08:00:00"), (1, 0, "X", "2024-01-01 12:00:00"), (1, 1, "Y", None), (1, 2, "Z", "2024-01-01 08:00:00")]
    df = spark.createDataFrame(rows, "case_key long, event_order long, activity string, t string").withColumn("ts", F.to_timestamp("t"))
    got = filters.with_event_index(filters.sort_in_case(EventLog(df), "ts")).orderBy("case_key", "event_idx").collect()
    assert "".join(r.activity for r in got) == "ACBXYZ"


def test_event_access(spark):
    df = spark.createDataFrame([(["a", "b", "c"],)], "t array<string>")
    r = df.select(filters.event_at("t", 0).alias("x"), filters.event_at("t", -1).alias("y"), filters.event_at("t", 9).alias("z"), filters.insert_event("t", 1, F.lit("n")).alias("i"), filters.append_event("t", F.lit("n")).alias("e")).first()
    assert tuple(r) == ("a", "c", None, ["a", "n", "b", "c"], ["a", "b", "c", "n"])
    m = spark.sql("select map('k', cast(null as string)) as attrs")
    assert tuple(m.select(filters.attribute("attrs", "k", F.lit("f")), filters.attribute("attrs", "q", F.lit("f"))).first()) == (None, "f")


def test_relations(spark):
    e = dfg.dfg(log_of(spark, "ABC", "BAC", "DD", "AD"))
    pairs = lambda df: {r.source + r.target for r in df.collect()}
    assert pairs(relations.causal(e)) == {"BC", "AC", "AD"}
    assert pairs(relations.parallel(e)) == {"AB", "BA", "DD"}
    assert pairs(relations.initial_pairs(e)) == {"BC", "AC"}


@pytest.mark.parametrize(
    ("model", "want"),
    [
        (["AB", "BC", "AC"], (1, 1, 1)),
        (["AB", "BC"], (2 / 3, 1, 2 / 3)),
        (["AB", "BC", "AC", "CD", "DE"], (1, 3 / 5, 1)),
        (["XY"], (0, 0, 0)),
        ([], (0, 1, 0)),
    ],
)
def test_footprint(spark, small, model, want):
    m = spark.createDataFrame([(x[0], x[1]) for x in model], "source string, target string")
    r = footprint.footprint(small, m).first()
    assert tuple(map(lambda x: round(x, 6), (r.fitness, r.precision, r.pct_fitting))) == tuple(round(x, 6) for x in want)


def test_footprint_of_little(spark):
    m = spark.createDataFrame([("A", "B")], "source string, target string")
    r = footprint.footprint(of_sequences(spark, {}), m).first()
    assert (r.fitness, r.precision, r.pct_fitting, r.traces) == (1, 0, 1, 0)
    r = footprint.footprint(log_of(spark, "A"), m).first()
    assert (r.fitness, r.precision, r.pct_fitting) == (1, 0, 1)
    r = footprint.footprint(log_of(spark, "ABAB"), m).first()
    assert (r.fitness, r.precision, r.pct_fitting) == (0.5, 1, 0)


def test_summary_of_requests_and_of_nothing(spark):
    s = stats.summary(requests(spark)).first()
    assert tuple(s) == (6, 42, 8, 6, 7.0, 5)
    assert tuple(stats.summary(of_sequences(spark, {})).first()) == (0, 0, 0, 0, 0.0, 0)
    log = requests(spark)
    assert acts(dfg.start_activities(log)) == {"register request": 6} and acts(dfg.end_activities(log)) == {"pay compensation": 3, "reject request": 3}
    assert dfg.dfg(log).count() == 16


def test_alphabet_and_minimal_traces(spark, small):
    u = variants.case_variants(small).groupBy("variant").agg(F.count(F.lit(1)).alias("cnt"), F.min("case_key").alias("first_seen"))
    assert [r.activity for r in variants.alphabet(u).orderBy("first_seen", "first_position").collect()] == ["A", "B", "C"]
    assert variants.to_events(u).count() == 5


def test_functions_of_long_cases_see_events_in_order(spark):
    from caseloom.plans.logs import of_sequences

    log = of_sequences(spark, {"1": [f"a{k}" for k in range(12)], "2": [f"b{k}" for k in range(120)]})
    out = filters.map_cases(log, lambda pdf: pdf[["case_key", "activity"]].assign(place=range(len(pdf))), "case_key long, activity string, place int").collect()
    assert all(r.activity == f"{'ab'[r.case_key]}{r.place}" for r in out) and len(out) == 132
