"""The pipeline, stage by stage, against plain versions."""

import collections
import random
import zlib

import pytest

import corpus_pipeline
from caseloom.llm import langid
from caseloom.llm.common import table


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("tables")
    rng = random.Random(3)
    vocab = {"en": "the of and in house tree with stone water field", "de": "der die und nicht straße baum mit stein wasser feld"}
    line = lambda g, n: " ".join(rng.choices(vocab[g].split(), k=3) + [f"n{rng.randrange(10**6)}" for _ in range(n)]) + "."
    rows = []
    for k in range(120):
        g = ("en", "de")[k % 2]
        rows.append((k, "\n".join(line(g, 9) for _ in range(8)), g, f"s{k % 3}", 0))
    rows += [(200 + k, rows[0][1], "en", "s0", 0) for k in range(5)] + [(300, "short text.", "en", "s1", 0), (301, None, None, None, None), rows[7]]
    rows += [(310, "\n".join(["12 34 56 78 90 11 22 33 44 55 66 77."] * 1 + [f"{k} {k + 1} {k + 2} {k + 3} {k + 4} {k + 5} {k + 6} {k + 7} {k + 8}." for k in range(0, 90, 9)]), "en", "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    return str(where)


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    names, cols = [n for n, _ in corpus_pipeline.STAGES], docs.columns
    assert names == ["quality rules", "language ID", "n-gram Jaccard join", "mixing to target weights", "packing"] and corpus_pipeline.ORACLE_SQL is None
    kept = corpus_pipeline.quality_stage(spark, docs, sf_dir).cache()
    assert kept.columns == cols and {300, 301}.isdisjoint({r.doc_id for r in kept.collect()}) and kept.count() == 127
    told = corpus_pipeline.language_stage(spark, kept, sf_dir).cache()
    assert told.columns == cols and 310 not in {r.doc_id for r in told.collect()} and told.count() == 126
    model = langid.fit(kept)
    assert {r.doc_id: r.lang for r in told.collect()} == {r.doc_id: r.lang_pred for r in langid.identify(kept, model).collect() if r.doc_id != 310}
    single = corpus_pipeline.duplicates_stage(spark, told, sf_dir).cache()
    assert single.columns == cols and sorted(r.doc_id for r in single.collect()) == list(range(120))
    mixed = corpus_pipeline.mixing_stage(spark, single, sf_dir).cache()
    assert mixed.columns == cols
    size, got = collections.Counter(), collections.Counter()
    for r in single.collect():
        size[r.source] += len(r.text.split())
    for r in mixed.collect():
        got[r.source] += len(r.text.split())
    total = sum(size.values())
    assert all(abs(got[s] - min(3 * size[s], total * w / 8)) < 2 for s, w in zip(sorted(size), (5, 2, 1)))
    packed = corpus_pipeline.packing_stage(spark, mixed, sf_dir)
    want = sum(1 for _ in mixed.collect())
    assert packed.where("start = 0").count() == want


def test_one_row_of_each_group_stays(spark):
    """Null and repeated ids, copies and near copies, against plain Python."""
    rng = random.Random(6)
    t = [[f"{x}{k}" for k in range(80)] for x in "abcdef"]
    near = lambda w, k: " ".join([*w[:-k], *(f"x{rng.randrange(10**6)}" for _ in range(k))])
    rows = [(1, " ".join(t[0])), (None, " ".join(t[0])), (None, near(t[0], 2)), (2, " ".join(t[1])), (2, " ".join(t[0])), (None, " ".join(t[2])), (None, " ".join(t[2])), (None, near(t[2], 1))]
    rows += [(5, " ".join(t[3])), (5, " ".join(t[4])), (5, near(t[4], 2)), (6, " ".join(t[5])), (6, " ".join(t[5])), (7, None), (7, None), (8, "")]
    df = spark.createDataFrame([(i, x, "en", f"s{k}", 0) for k, (i, x) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    out = [(r.doc_id, r.text) for r in corpus_pipeline.duplicates_stage(spark, df, "").collect()]
    grams = lambda x: {tuple(w[k : k + 5]) for w in [(x or "").split()] for k in range(len(w) - 4)}
    alike = lambda a, b: bool(grams(a)) and 100 * len(grams(a) & grams(b)) >= 80 * len(grams(a) | grams(b))
    assert collections.Counter(r for r in out if not grams(r[1])) == collections.Counter(r for r in rows if not grams(r[1]))
    kept = [x for _, x in out if grams(x)]
    assert not any(alike(a, b) for k, a in enumerate(kept) for b in kept[:k]) and all(any(alike(x, y) for y in kept) for _, x in rows if grams(x))
    ids = {i for i, x in out if grams(x)}
    assert ids == {1, 2, None, 5, 6} and (1, rows[0][1]) in out and len(kept) == 6


def test_unlearned_languages_go(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("doc_id < 120")
    odd = [(900, "mieleni minun tekevi aivoni ajattelevi lahteani laulamahan saaani sanelemahan " * 8, "fi", "s0", 0), (901, "qwx zkj vvb pql xxk jjq wvz " * 20, "en", "s0", 0)]
    both = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    model = langid.fit(docs)
    told = {r.doc_id: r.score for r in langid.identify(both, model).collect()}
    assert max(told[900], told[901]) < corpus_pipeline.LEAST_SCORE < min(told[k] for k in range(120))


def test_run_ends_in_pieces(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert out and all(zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in r.ids)) == r.ids_crc32 for r in out[:50])
    by = collections.Counter()
    for r in out:
        by[r.doc_id] += r.length
    assert set(by) <= set(range(120))


def test_stages_on_an_empty_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.count() == 0
        docs = out if out.columns == docs.columns else docs
