"""Each operator against a plain version, on texts that include the awkward ones."""

import collections
import functools
import hashlib
import json
import math
import os
import random
import re
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from caseloom.llm import chat, common, fingerprint, langid, licenses, lm, mixing, packing, quality, queries, setjoin, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def words(t):
    return WORD.findall(t or "")


# ---- sharding ------------------------------------------------------------------------------------


@pytest.mark.parametrize("law", ["rows", "key"])
def test_shards_hold_every_row_once(docs, rows, law):
    out = sharding.shuffle_into_shards(docs, 5, law, bucket_bytes=20_000).collect()
    assert collections.Counter((r.doc_id, r.text) for r in out) == collections.Counter((r[0], r[1]) for r in rows)
    by = collections.defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    sizes = [len(by[k]) for k in range(5)]
    if law == "rows":
        assert max(sizes) - min(sizes) <= 1 and {r.grown_shard for r in out} == {None}
    else:
        assert all(r.grown_shard in (r.shard, 5) for r in out)
        assert all(len({r.shard for r in out if r.doc_id == i}) == 1 for i in range(len(rows) - 4))


def test_shards_agree_between_runs_and_partitionings(docs):
    run = lambda df: sorted((str(r.doc_id), str(r.text), r.shard, r.slot) for r in sharding.shuffle_into_shards(df, 3, bucket_bytes=20_000).collect())
    assert run(docs) == run(docs.repartition(7))


def test_shards_are_in_shuffled_order(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"))
    out = sharding.shuffle_into_shards(df, 4, bucket_bytes=4000).orderBy("shard", "slot").collect()
    ids = [r.doc_id for r in out]
    assert sum(b == a + 1 for a, b in zip(ids, ids[1:])) < 20
    quarter = collections.Counter(i // 500 for i in ids[:500])
    assert all(90 < quarter[q] < 160 for q in range(4))


def test_shards_of_nothing(none):
    assert sharding.shuffle_into_shards(none).count() == 0


# ---- scratch tables ------------------------------------------------------------------------------


def test_staged_tables_can_be_cleared(spark):
    kept = common.staged(spark.range(5))
    path = kept.inputFiles()[0].removeprefix("file://")
    assert kept.count() == 5 and os.path.exists(path)
    assert common.clear_staged(spark) > 0 and not os.path.exists(path) and common.clear_staged(spark) == 0


# ---- n-gram Jaccard join -------------------------------------------------------------------------


def plain_components(rows, n, percent):
    sets = {}
    for i, t, *_ in rows:
        w = words(lower(t or ""))
        s = frozenset([tuple(w)] if 0 < len(w) < n else [tuple(w[k : k + n]) for k in range(len(w) - n + 1)])
        sets.setdefault(s, []).append(i)
    kinds = [s for s in sets if s]
    up = list(range(len(kinds)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(kinds)):
        for b in range(a):
            both = len(kinds[a] & kinds[b])
            if 100 * both >= percent * len(kinds[a] | kinds[b]):
                up[root(a)] = root(b)
    low = collections.defaultdict(lambda: None)
    for a, s in enumerate(kinds):
        for i in sets[s]:
            if i is not None:
                low[root(a)] = i if low[root(a)] is None else min(low[root(a)], i)
    out = collections.Counter((i, len(s), low[root(a)]) for a, s in enumerate(kinds) for i in sets[s])
    return out + collections.Counter((i, 0, i) for i in sets.get(frozenset(), []))


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_join_finds_the_same_components(docs, rows, n, percent):
    out = setjoin.jaccard_components(docs, n, percent).collect()
    want = plain_components(rows, n, percent)
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == want
    assert len({k[2] for k in want}) < len({k[0] for k in want})


@pytest.mark.parametrize(("shared", "shingles"), [(24, 2_000_000), (0, 2_000_000), (3, 900)])
def test_join_with_small_parts_and_lists(docs, rows, monkeypatch, shared, shingles):
    monkeypatch.setattr(setjoin, "PART", 6)
    monkeypatch.setattr(setjoin, "PART_IN_PAIRS", 6)
    monkeypatch.setattr(setjoin, "PART_SHINGLES", shingles)
    monkeypatch.setattr(setjoin, "SHARED", shared)
    monkeypatch.setattr(setjoin, "LONG", 4)
    out = setjoin.jaccard_components(docs, 3, 80).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == plain_components(rows, 3, 80)


def test_large_clusters_send_each_text_once(spark):
    """Near copies of one text are linked through few shared ones; a second text in between is told apart."""
    rng = random.Random(4)
    base, other = ([f"{x}{k}" for k in range(120)] for x in "ab")
    edit = lambda w, e: " ".join(f"x{rng.randrange(10**9)}" if k in e else x for k, x in enumerate(w))
    texts = [edit(base, {rng.randrange(120)}) for _ in range(3000)] + [edit(base[:60] + other[60:], {rng.randrange(120)}) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    out = setjoin.jaccard_components(df, 3, 90).collect()
    assert {(r.doc_id < 3000, r.component_id) for r in out} == {(True, 0), (False, 3000)}
    there = spark.range(100_000).select(F.col("id").alias("node"), F.lit(7).alias("host"), F.lit(100).alias("size"), F.col("id").alias("doc_id"), F.col("id").alias("h"), F.lit(1).alias("copies"))
    parts = setjoin._parts_of(there, setjoin.PART)
    assert setjoin._dealt_once(there, parts).count() < 112_000
    joined = spark.range(100_000).select(F.col("id").alias("node"), F.when(F.col("id") % 1000 == 3, F.col("id")).otherwise(0).alias("root"))
    assert setjoin._dealt_apart(there, parts, joined).count() < 112_000


def test_null_and_repeated_ids_keep_their_texts_apart(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(None, a), (None, b), (None, b + " end"), (7, a + " end"), (7, c), (7, c), (8, c + " end")]
    out = setjoin.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == plain_components(rows, 3, 90)


def test_meeting_links_what_brute_force_links():
    np = pytest.importorskip("numpy")
    rng = np.random.default_rng(2)
    for trial in range(150):
        percent = int(rng.choice([80, 90]))
        bases = [rng.integers(0, 1 << 60, int(rng.integers(5, 90)), dtype=np.uint64) for _ in range(int(rng.integers(1, 4)))]
        sets = []
        for _ in range(int(rng.integers(3, 50))):
            b = bases[rng.integers(len(bases))]
            k = int(rng.integers(0, max(1, len(b) // 3)))
            sets.append(np.unique(np.concatenate([b[rng.permutation(len(b))[k:]], rng.integers(0, 1 << 60, int(rng.integers(0, k + 1)), dtype=np.uint64)])))
        own = len(sets) if trial % 2 else int(rng.integers(1, len(sets)))

        def parts(edges, n=len(sets)):
            f = setjoin._Forest()
            for a, b in edges:
                f.join(a, b)
            return {frozenset(x for x in range(n) if f.root(x) == r) for r in {f.root(x) for x in range(n)}}

        linked = lambda a, b: setjoin.linked(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b]), percent)
        want = [(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if (own == len(sets) or a < own <= b) and linked(a, b)]
        assert parts(setjoin.join_sets(list(range(len(sets))), sets, own, percent)) == parts(want)


def test_join_of_nothing(none):
    assert setjoin.jaccard_components(none).count() == 0


# ---- LM scoring ----------------------------------------------------------------------------------


class PlainAutomaton:
    """States, arcs and failure arcs as dictionaries, walked a word at a time."""

    def __init__(self, texts: list[list]):
        one, two, three, pairs = (collections.Counter() for _ in range(4))
        for t in texts:
            full = ["<s>", "<s>", *t]
            one.update(t)
            two.update(zip(full[1:], t))
            pairs.update(zip(full, full[1:]))
            three.update(zip(full, full[1:], t))
        self.one, self.n, self.v = one, sum(one.values()), len(one)
        some = lambda c, k: sum(x == k for x in c.values())
        d, big = (lm.discount(some(c, 1), some(c, 2)) for c in (one, three))
        follows = collections.Counter(u for u, _ in two.elements())
        kept, left = {}, collections.defaultdict(float)
        for (u, v, w), c in three.items():
            if c >= lm.LEAST:
                kept[u, v, w] = (c - big) / pairs[u, v]
                left[u, v] += kept[u, v, w]
        self.unknown = d * self.v / self.n if self.n else 1.0
        root = {w: (c - d) / self.n for w, c in one.items()}
        low = {(v, w): (1 - lm.LEAVE) * c / follows[v] + lm.LEAVE * root[w] for (v, w), c in two.items()}
        p2 = lambda v, w: low.get((v, w)) or (lm.LEAVE if follows[v] else 1.0) * root.get(w, self.unknown)
        self.arcs = {(): root}
        self.fail = {}
        for v in follows:
            self.arcs[(v,)] = {}
            self.fail[(v,)] = (lm.LEAVE, ())
        for (v, w), p in low.items():
            self.arcs[(v,)][w] = p
        for u, v in left:
            self.arcs[u, v] = {}
            self.fail[u, v] = (1 - left[u, v], (v,))
        for (u, v, w), x in kept.items():
            self.arcs[u, v][w] = x + (1 - left[u, v]) * p2(v, w)

    def reach(self, state, w):
        """Probability of the next word, following failure arcs."""
        p = 1.0
        while w not in self.arcs[state] and state:
            share, state = self.fail[state]
            p *= share
        return p * self.arcs[state].get(w, self.unknown)

    def walk(self, t: list) -> float:
        total, state, past = 0.0, self.longest(["<s>", "<s>"]), ["<s>", "<s>"]
        for w in t:
            total += math.log10(self.reach(state, w))
            past = [past[1], w]
            state = self.longest(past)
        return total

    def longest(self, past: list):
        return next(s for s in (tuple(past), tuple(past[1:]), ()) if s in self.arcs)


@pytest.mark.parametrize("fan", [512, 2])
def test_scores_match_a_plain_automaton(docs, rows, fan):
    out = lm.score_texts(docs, fan=fan, block_bytes=10_000).collect()
    toks = [(i, [*words(lower(t or "")), None]) for i, t, *_ in rows]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    a = PlainAutomaton([t for i, t in toks if not held(i)])
    assert len([s for s in a.arcs if len(s) == 2]) > 20
    for state in sorted(a.arcs, key=lambda s: -len(a.arcs[s]))[:3] + [s for s in a.arcs if len(s) == 2][:20]:
        assert abs(sum(a.reach(state, w) for w in a.one) + a.reach(state, "never seen") - 1) < 1e-9
    want = collections.Counter()
    for i, t in toks:
        base = sum(math.log10((a.one[w] + 1) / (a.n + a.v + 1)) for w in t)
        want[(i, held(i), len(t), sum(a.one[w] > 0 for w in t), a.n, round(base, 5), round(a.walk(t), 5))] += 1
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in out) == want


def test_trees_have_enough_owners():
    for n in (1, 2, 5, 512, 513, 100_000, 1_600_000):
        levels, width = lm.tree(n, 512)
        assert n <= width**levels and width <= 512
    assert lm.tree(512, 512) == (1, 512) and lm.tree(10, 2) == (4, 2)


def test_scores_of_nothing_and_of_untaught_texts(spark, none):
    assert lm.score_texts(none).count() == 0
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = lm.score_texts(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0) and math.isfinite(r.score)


# ---- mixing --------------------------------------------------------------------------------------


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest, ws = total - sum(3 * sizes[s] for s in full), sum(w[s] for s in names if s not in full)
        goal = {s: 3.0 * sizes[s] if s in full else rest * w[s] / ws for s in names}
        over = {s for s in names if s not in full and goal[s] > 3 * sizes[s]}
        if not over:
            return goal
        full |= over


def test_mix_reaches_its_targets(docs, rows):
    got = mixing.mixed_counts(*mixing.mix(docs, block_words=64))
    out = got.collect()
    size = collections.Counter()
    for _, t, _, s, _ in rows:
        size[s] += len(words(t))
    goal = plain_targets(size)
    source = {(i, len(words(t))): s for i, t, _, s, _ in rows}
    taken = collections.Counter()
    assert len(out) == len(rows)
    for r in out:
        s = source[r.doc_id, r.size]
        assert r.source_size == size[s] and abs(r.target - goal[s]) < 1e-6 and r.taken <= 3 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - goal[s]) <= 1 for s in size)
    again = mixing.mixed_counts(*mixing.mix(docs.repartition(6), block_words=64)).collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert sorted(map(key, out)) == sorted(map(key, again))


def test_caps_spill_over_to_other_sources(spark):
    rows = [(i, "w " * n, s) for i, (s, n) in enumerate([("a", 2), ("b", 300), ("c", 500), (None, 40)])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mixed_counts(*mixing.mix(df, block_words=16)).collect()
    goal = plain_targets({s: len(words(t)) for _, t, s in rows})
    assert {r.doc_id: round(r.target, 6) for r in out} == {i: round(goal[s], 6) for i, _, s in rows}
    assert goal["a"] == 6 and all(abs(r.taken - r.target) <= 1 for r in out)


def test_mix_slots_follow_the_weights_everywhere(docs):
    rows, pieces = mixing.mix(docs, block_words=16)
    seq = pieces.join(rows.select("uid", "source"), "uid").orderBy("slot", "pass", "uid").collect()
    total, half = collections.Counter(), collections.Counter()
    for k, r in enumerate(seq):
        total[r.source] += r.words
        half[r.source] += r.words if k < len(seq) // 2 else 0
    assert all(abs(half[s] - total[s] / 2) < 0.2 * total[s] + 100 for s in total)


def test_mixed_documents_have_what_is_taken(docs, rows):
    r, p = mixing.mix(docs, block_words=64)
    counts = mixing.mixed_counts(r, p)
    mixed = mixing.mixed_documents(docs, r, p)
    assert mixed.columns == docs.columns
    got, want = collections.Counter(), collections.Counter()
    for x in mixed.collect():
        got[x.doc_id] += len(words(x.text))
    for x in counts.collect():
        want[x.doc_id] += x.taken
    assert got == +want


def test_mix_of_nothing_and_of_empty_texts(spark, none):
    assert mixing.mixed_counts(*mixing.mix(none)).count() == 0
    r = mixing.mixed_counts(*mixing.mix(spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string"))).collect()
    assert sorted((x.doc_id, x.size, x.target, x.taken) for x in r) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


# ---- license scans -------------------------------------------------------------------------------


def test_licenses_are_found_where_they_stand(spark):
    fill = " ".join(f"w{k}" for k in range(40))
    texts = [f"{fill} {t} {fill}" for _, t in licenses.TEMPLATES] + [fill, "", None, "Released under the MIT License. " * 2]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = licenses.scan_licenses(df).collect()
    for k, (name, t) in enumerate(licenses.TEMPLATES):
        hits = [r for r in out if r.doc_id == k and r.template == name]
        assert len(hits) == 1 and hits[0].containment == 1.0
        assert hits[0].start_word <= 40 and hits[0].start_word + hits[0].n_words >= 40 + len(t.split())
    n = len(licenses.TEMPLATES)
    assert not [r for r in out if r.doc_id in (n, n + 1, n + 2)]
    assert len([r for r in out if r.doc_id == n + 3 and r.template == "mit"]) == 2


def test_long_templates_survive_edits_up_to_the_share(spark):
    template = [f"t{k}" for k in range(120)]
    few, many = list(template), list(template)
    few[50] = "changed"
    many[10:110:7] = ["changed"] * len(many[10:110:7])
    df = spark.createDataFrame([(0, " ".join(few)), (1, " ".join(many)), (2, " ".join(template[:60]))], "doc_id long, text string")
    out = licenses.scan_licenses(df, [("long", " ".join(template))]).collect()
    assert [(r.doc_id, round(r.containment, 3)) for r in out] == [(0, round(111 / 116, 3))]


def test_bands_keep_the_promised_chance():
    for n in (3, 5, 8, 12, 40, 200):
        g = licenses.Group(n, 0.8, 1e-6)
        assert g.floor_similarity == 1 or (1 - g.floor_similarity) ** g.bands <= 1e-6
    with pytest.raises(ValueError):
        licenses.scan_licenses(None, [("x", "y")] * 10_001)


# ---- language ID ---------------------------------------------------------------------------------


def test_languages_are_told_apart(spark):
    import random

    rng = random.Random(1)
    vocab = {"en": "the of and in house tree with", "de": "der die und nicht straße baum mit", "fr": "le les et maison avec forêt", "es": "el los y casa con árbol niño", "xx": "zq qz zzq qqz zqz"}
    rows = [(k, " ".join(rng.choices(vocab[g].split(), k=30)), g) for k, g in enumerate(list(vocab) * 60)]
    df = spark.createDataFrame([*rows, (900, None, "en"), (901, "123 .. \n", "en"), (902, "", None)], "doc_id long, text string, lang string")
    model = langid.fit(df)
    assert model.families == ["germanic", "romance", "xx"] and [m[0] for m in model.pairs.values()] == [["de", "en"], ["es", "fr"], ["xx"]]
    out = langid.identify(df.withColumn("score", F.lit("clash")), model).collect()
    test = [r for r in out if r.doc_id < 900 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(test) > 30 and all(r.lang == r.lang_pred for r in test)
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in out if r.doc_id >= 900)
    assert all(0 <= r.score <= 1 for r in out)


def test_no_language_is_left_out(spark):
    """Many more labels than the sample has rows for: each is learned; repeated rows don't flood the sample."""
    rng = random.Random(2)
    vocab = {f"l{k:03}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8))) for _ in range(8)] for k in range(220)}
    rows = [(k, " ".join(rng.choices(vocab[g], k=25)), g) for k, g in enumerate(list(vocab) * 3)]
    rows += [(None, "the same row again and again", "l000")] * 3000
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6)
    model = langid.fit(df, sample=200, least=4)
    taught = {g for k, _, g in rows if k is None or zlib.crc32(str(k).encode()) % 4 != 2}
    assert set(model.families) == taught and len(taught) > 180
    out = langid.identify(df.where("doc_id is not null"), model).collect()
    out = [r for r in out if r.lang in taught]
    assert sum(r.lang == r.lang_pred for r in out) > 0.97 * len(out) > 500


def test_unlike_texts_score_low(spark):
    rng = random.Random(1)
    vocab = {"en": "the of and in house tree with a stone by", "de": "der die und nicht haus baum mit ein stein bei"}
    rows = [(k, " ".join(rng.choices(vocab[g].split(), k=60)), g) for k, g in enumerate(list(vocab) * 60)]
    odd = [(900, "mieleni minun tekevi aivoni ajattelevi laulamahan saaani sanelemahan " * 4, None), (901, "qwx zkj vvb pql xxk jjq wvz " * 9, "en")]
    df = spark.createDataFrame(rows + odd + odd, "doc_id long, text string, lang string")
    out = langid.identify(df, langid.fit(df.where("doc_id < 900"))).collect()
    assert len(out) == 124 and min(r.score for r in out if r.doc_id < 900) > 0.5 and max(r.score for r in out if r.doc_id >= 900) < 0.4


def test_language_without_labels(docs, none):
    assert langid.identify(none, langid.fit(none)).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, None).collect()} == {"und"}


# ---- packing -------------------------------------------------------------------------------------


def test_pieces_are_the_tokens_cut_to_powers_of_two(docs, rows):
    import numpy as np
    from public_tokenizers import PATTERN, path
    from tokenizers import Tokenizer

    file = path("byte_bpe_50k.json")
    out = packing.pack(docs, file, PATTERN, cap=64).collect()
    plain = Tokenizer.from_file(file)
    want = collections.Counter()
    for i, t, *_ in rows:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        at = 0
        while at < len(ids):
            n = 1 << min(6, (len(ids) - at).bit_length() - 1)
            want[(i, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes()), len(ids), tuple(ids[at : at + n]))] += 1
            at += n
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, tuple(r.ids)) for r in out) == want
    assert len({r.sequence_id for r in out}) == len(out) and {r.offset for r in out} == {0}
    with pytest.raises(ValueError):
        packing.pack(docs, file, PATTERN, cap=100)


def test_ranks_are_taken_for_ids_only_where_they_are(tmp_path):
    model = {"vocab": {"a": 0, "b": 1, "c": 2, "ab": 3, "abc": 4}, "merges": [["a", "b"], ["ab", "c"]]}
    for merges, ok in ((model["merges"], True), (["a b", "ab c"], True), (model["merges"][::-1], False), ([["a", "c"]], False)):
        (tmp_path / "t.json").write_text(json.dumps({"model": model | {"merges": merges}}))
        assert packing.merges_by_id(str(tmp_path / "t.json")) == ok


def test_buckets_hold_equal_lengths(spark, tmp_path):
    pieces = packing.pack(spark.createDataFrame([(k, "some words here " * k) for k in range(20)], "doc_id long, text string"), *queries.tokenizer_files(), cap=16)
    packing.write_buckets(pieces, f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == pieces.count() and {p.name for p in (tmp_path / "out").glob("length=*")} == {f"length={1 << k}" for k in range(5)}
    assert back.where("size(ids) <> length").count() == 0


def test_shards_are_written_by_number(docs, tmp_path):
    sharding.write_shards(sharding.shuffle_into_shards(docs, 3).select("doc_id", "text", "shard", "slot"), f"{tmp_path}/out")
    assert {p.name for p in (tmp_path / "out").glob("shard=*")} == {"shard=0", "shard=1", "shard=2"}


def test_packing_nothing(none):
    from public_tokenizers import PATTERN, path

    assert packing.pack(none, path("byte_bpe_50k.json"), PATTERN).count() == 0


# ---- quality rules -------------------------------------------------------------------------------


def test_counts_match_plain_counting(docs, rows):
    out = quality.quality_rules(docs).collect()
    want = collections.Counter()
    for i, t, *_ in rows:
        w = words(t)
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        seen = collections.Counter(zip(w, w[1:], w[2:]))
        hit = {k + j for k, g in enumerate(zip(w, w[1:], w[2:])) if seen[g] > 1 for j in range(3)}
        failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
        want[(i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit), failed)] += 1
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out) == want
    assert all(r.kept is not None and not (r.kept and r.base_failed) for r in out)


def test_lines_go_before_documents(spark):
    good = [" ".join(f"word{k * 13 + j}" for j in range(13)) + "." for k in range(12)]
    menu = ["Home | News | Sport | Contact | About", "Accept all cookies", "Read more", "### $$$ %%% &&& junk"]
    df = spark.createDataFrame([(0, "\n".join(good + menu)), (1, "\n".join(good[:4] + menu * 12)), (2, "\n".join(good))], "doc_id long, text string")
    out = {r.doc_id: r for r in quality.quality_rules(df).collect()}
    assert out[0].kept and out[0].clean_text == "\n".join(good)
    assert not out[1].kept and out[2].kept and out[2].clean_text == "\n".join(good)


def test_filters_on_verdicts_stay_cheap(docs, none):
    plan = quality.quality_rules(docs).where("kept")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(coalesce(text") == 2  # words, and symbols
    assert quality.quality_rules(none).count() == 0


# ---- chat formatting -----------------------------------------------------------------------------

ODD = ["", "plain", "<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<|", "<\\\\|x", "a\nb", "<|im_end|>\n", "|>", "<<|||", "\\n", "ünï"]


def test_turns_read_back():
    for role in [*ODD, "assistant"]:
        for text in ODD:
            out, a, z = chat.render(role, text)
            assert [t[:2] for t in chat.parse(out)] == [(role, text)] and chat.unescape(out[a:z]) == text
            assert [t[:2] for t in chat.parse(out + out)] == [(role, text)] * 2


def test_conversations_read_back(spark):
    turns = [(c, k, "assistant" if k % 2 else "user", ODD[(c + k) % len(ODD)]) for c in range(6) for k in range(c + 2)]
    turns += [(9, 0, "user", None), (9, 1, None, "x"), (9, 1, None, "x"), (None, 0, "assistant", "y")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(5)
    out = {r.conv_id: r for r in chat.read_back(chat.format_turns(df)).collect()}
    for c in {t[0] for t in turns}:
        own = [t for t in turns if t[0] == c]
        said = "".join(f"{r or ''}\n{x or ''}\n" for _, _, r, x in own)
        loss = "".join(x or "" for _, _, r, x in own if r == "assistant")
        r = out[c]
        assert (r.n_turns, r.loss_chars) == (len(own), len(loss))
        assert r.turns_sha256 == hashlib.sha256(said.encode()).hexdigest() and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


# ---- fingerprints --------------------------------------------------------------------------------


def spark_hash(*parts):
    """xxhash64 of strings and of longs, one seeding the next, as an unsigned number."""
    h = 42
    for x in parts:
        h = xxhash.xxh64_intdigest(x.encode() if isinstance(x, str) else (x % (1 << 64)).to_bytes(8, "little"), h)
    return h


def plain_signature(text, k=5, l=2, m=64):
    """Order MinHash by sorting everything anew for every slot."""
    w = words(text)
    h = [spark_hash(x) for x in w]
    chain = lambda i: functools.reduce(spark_hash, h[i + 1 : i + k], h[i])
    grams = [spark_hash(*h)] if 0 < len(w) < k else [chain(i) for i in range(len(w) - k + 1)]
    if not grams:
        return [0] * m
    seen, own = collections.Counter(), []
    for g in grams:
        own.append(xxhash.xxh64_intdigest(seen[g].to_bytes(4, "little"), spark_hash(g)))
        seen[g] += 1
    low, top = len(bin(len(grams) + 1)) - 2, (1 << 63) - 1
    sig = []
    for base in range(fingerprint.BASES):
        rank = [((x if base == 0 else spark_hash(x, base)) & top) >> low for x in own]
        for j in range(m // fingerprint.BASES):
            mark = ((1 << 63) // (m // fingerprint.BASES) * j) >> low
            nearest = sorted(range(len(grams)), key=lambda i: (rank[i] < mark, rank[i], i))[:l]
            sig.append(spark_hash(*[grams[i] for i in sorted(nearest)]) & 0x7FFFFFFF)
    return sig


def test_signatures_match_plain_order_minhash(docs, rows):
    for r in fingerprint.fingerprints(docs).collect():
        if len(r.text) < 3000 and "\x1c" not in r.text:
            assert r.sig == plain_signature(r.text), r.text[:80]


def test_short_texts_have_many_different_slots(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(30))) for i in range(60)], "doc_id long, text string")
    kinds = [len(set(r.sig)) for r in fingerprint.fingerprints(df).collect()]
    assert sum(kinds) / len(kinds) > 45


@pytest.mark.parametrize("size", [64 << 20, 3000])
def test_edited_texts_and_equal_fingerprints(docs, rows, size):
    out = fingerprint.compare_with_next(docs, range_bytes=size).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, spark_hash(r[1] or "") % (1 << 30), r[1] or ""), reverse=True)
    want = collections.Counter()
    for k, (i, t, *_) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 3
        want[(i, t, t[: len(t) - cut] + after[:cut])] += 1
    assert collections.Counter((r.doc_id, r.text, r.edited_text) for r in out) == want
    prints = collections.defaultdict(set)
    for r in out:
        prints[r.text].add(tuple(r.sig))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and len(r.sig) == 64
    assert all(len(p) == 1 for p in prints.values())
    assert fingerprint.compare_with_next(docs.limit(0)).count() == 0


def test_rows_of_one_id_are_spread_over_ranges(spark):
    rows = [(None if k < 400 else 7 if k < 800 else k, f"text {k}") for k in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = fingerprint.compare_with_next(df, range_bytes=300).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, spark_hash(r[1]) % (1 << 30)), reverse=True)
    follow = {a[1]: b[1] for a, b in zip(order, order[1:] + order[:1])}
    assert all(r.edited_text == r.text[: len(r.text) - len(r.text) // 3] + follow[r.text][: len(r.text) // 3] for r in out)
    cuts = [-(1 << 63)] * 5 + [7] * 5 + [900, 1000]
    counts = {r["__r"]: r["count"] for r in fingerprint.in_ranges(df, cuts, "doc_id", "text").groupBy("__r").count().collect()}
    assert max(counts.values()) < 250 and sum(counts.values()) == 1200


def test_likeness_follows_order_and_edits(spark):
    base = [f"w{k}" for k in range(300)]
    swapped = base[150:] + base[:150]
    texts = {"same": base, "one": base[:100] + ["x"] + base[101:], "half": base[:150] + [f"y{k}" for k in range(150)], "moved": swapped, "other": [f"z{k}" for k in range(300)]}
    df = spark.createDataFrame([(0, " ".join(base))] + [(k + 1, " ".join(v)) for k, v in enumerate(texts.values())], "doc_id long, text string")
    sig = {r.doc_id: r.sig for r in fingerprint.fingerprints(df).collect()}
    like = {n: sum(a == b for a, b in zip(sig[0], sig[k + 1])) / 64 for k, n in enumerate(texts)}
    assert like["same"] == 1 and like["other"] == 0 and like["one"] > 0.8 and 0.05 < like["half"] < 0.6
    assert like["moved"] < like["one"]  # the same k-mers, but not in the same order


def test_occurrences_count(spark):
    df = spark.createDataFrame([(0, "a b c d e " * 10), (1, "a b c d e " * 40), (2, "a b c d e " * 10)], "doc_id long, text string")
    sig = {r.doc_id: r.sig for r in fingerprint.fingerprints(df).collect()}
    assert sig[0] == sig[2] and sig[0] != sig[1]
