"""Numbers of links of the set join, against all pairs."""

import collections
import random

import numpy as np
import pytest

from caseloom.llm import queries, setjoin
from caseloom.llm.hashing import WordHasher, shingle_set


def plain_links(texts, n, percent):
    h = WordHasher()
    sets = [set(shingle_set(h(t), n).tolist()) for t in texts]
    return [sum(bool(a) and k != j and 100 * len(a & b) >= percent * len(a | b) for j, b in enumerate(sets)) for k, a in enumerate(sets)]


@pytest.mark.parametrize(("least", "long"), [(1024, 64), (6, 4)])
def test_every_link_counts_once(spark, docs, rows, monkeypatch, least, long):
    monkeypatch.setattr(setjoin, "PART_IN_PAIRS", least)
    monkeypatch.setattr(setjoin, "LONG", long)
    want = collections.Counter(zip([r[0] for r in rows], plain_links([r[1] for r in rows], 3, 80)))
    assert collections.Counter((r.doc_id, r.n_links) for r in setjoin.jaccard_components(docs, 3, 80, count_links=True).collect()) == want
    assert max(k[1] for k in want) > 10


def test_query_tells_chains_from_cliques(spark, tmp_path):
    rng = random.Random(8)
    base = [f"a{k}" for k in range(100)]
    chain = [" ".join([*[f"x{i}" for i in range(3 * k)], *base[3 * k :]]) for k in range(5)]
    word = [f"b{k}" for k in range(100)]
    clique = [" ".join([*word, f"end{k}"]) for k in range(5)]
    other = [" ".join(f"c{rng.randrange(9999)}" for _ in range(60))]
    texts = chain + clique + other + other
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op2_ngram_jaccard_links(spark, str(tmp_path)).collect()
    got = {r.doc_id: r.n_links for r in out}
    assert [got[k] for k in range(len(texts))] == plain_links(texts, 3, 90) and [got[k] for k in range(5)] != [4] * 5 == [got[k] for k in range(5, 10)]
    assert {r.component_id for r in out if r.doc_id < 5} == {0}


def test_shared_meetings_count_in_the_first():
    rng = np.random.default_rng(3)
    for trial in range(40):
        base = rng.integers(0, 1 << 60, 80, dtype=np.uint64)
        sets = [np.unique(np.r_[base[rng.permutation(80)[: 80 - k]], rng.integers(0, 1 << 60, k, dtype=np.uint64)]) for k in rng.integers(0, 30, 30)]
        own, copies = len(sets) if trial % 2 else 11, rng.integers(1, 4, len(sets))
        earlier = [rng.choice(6, int(rng.integers(0, 3)), replace=False) for _ in sets]
        links = setjoin._Links(copies, earlier)
        setjoin.link_sets(sets, own, 80, links)
        want = np.zeros(len(sets), int)
        for a in range(len(sets)):
            for b in range(a + 1, len(sets)):
                if (own == len(sets) or a < own <= b) and not set(earlier[a]) & set(earlier[b]) and setjoin.linked(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b]), 80):
                    want[a] += copies[b]
                    want[b] += copies[a]
        assert links.n.tolist() == want.tolist()
