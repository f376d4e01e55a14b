"""License texts, headers and wordings that the registered query has to find."""

import random
import re

import numpy as np

from caseloom.llm import licenses, queries
from caseloom.llm.hashing import windows


def test_query_finds_whole_texts_with_edits_and_other_wordings(spark, tmp_path):
    fill = [f"w{k}" for k in range(60)]
    rows, want = [], {}
    for k, (name, text) in enumerate(licenses.LONG):
        w = text.split()
        w[len(w) // 2] = "changed"
        rows.append((k, "\n".join([" ".join(fill), " ".join(w), " ".join(fill)])))
        want[k] = name
    for name, text in (("mit:licensed", "This project is licensed under the MIT license."), ("mit:spdx", "# SPDX-License-Identifier: MIT"), ("apache-2.0:license-2.0", "Code licensed under the Apache License 2.0, docs not.")):
        want[len(rows)] = name
        rows.append((len(rows), f"w1 w2 {text} w3"))
    rows.append((len(rows), " ".join(fill * 9)))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op5_license_scan(spark, str(tmp_path)).collect()
    found = {(r.doc_id, r.template) for r in out}
    assert set(want.items()) <= found and len(rows) - 1 not in {i for i, _ in found}
    assert all(r.containment >= 0.8 for r in out)


def test_scan_retrieves_what_every_window_holds():
    rng = random.Random(4)
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for trial in range(40):
        w = []
        for _ in range(rng.randint(1, 4)):
            part = rng.choice(licenses.TEMPLATES)[1].split()
            for _ in range(rng.randint(0, len(part) // 40)):
                part[rng.randrange(len(part))] = "changed"
            w += [f"f{rng.randrange(99)}" for _ in range(rng.randint(0, 50))] + part[rng.choice([0, 0, 2]) :]
        text, want = " ".join(w), set()
        h = scanner.words(text)
        for g in scanner.groups:
            s = windows(h, g.n) if len(h) >= g.n else h[:0]
            for x in range(0, max(1, len(s) - g.width + g.hop), g.hop):
                want |= {name for name, t in zip(g.names, g.sets) if len(np.intersect1d(s[x : x + g.width], t)) >= 0.8 * len(t) - 1e-9}
        assert {m[0] for m in scanner.scan(text)} == want


def test_recall_against_every_place(spark):
    """Plain sets of words at every place of a text, whatever the windows, bands and hashes say."""
    rng = random.Random(9)
    bare = lambda text: [w for w in (re.sub(r"^\W+|\W+$", "", x.lower()) for x in text.split()) if w]
    grams = lambda w, n: [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
    templates = {name: bare(text) for name, text in licenses.TEMPLATES}
    rows, want = [], set()
    for k in range(60):
        w = [f"f{rng.randrange(99)}" for _ in range(rng.randint(0, 30))]
        for name in rng.sample(sorted(templates), 2):
            part = list(templates[name])
            for _ in range(rng.randint(0, max(1, len(part) // 25))):
                part[rng.randrange(len(part))] = "changed"
            w += part + [f"f{rng.randrange(99)}" for _ in range(rng.randint(0, 30))]
        rows.append((k, " ".join(w)))
        for name, t in templates.items():
            n = min(5, len(t))
            ts, s = set(grams(t, n)), grams(w, n)
            if any(len(ts & set(s[i : i + len(t) - n + 1])) >= 0.8 * len(ts) for i in range(len(s))):
                want.add((k, name))
    out = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {(r.doc_id, r.template) for r in out}
    assert len(found & want) >= 0.99 * len(want) > 90
    for r in out:  # every column from the words alone
        t, w = templates[r.template], rows[r.doc_id][1].split()
        n = min(5, len(t))
        part = grams(w[r.start_word : r.start_word + r.n_words], n)
        assert abs(len(set(part) & set(grams(t, n))) / len(set(grams(t, n))) - r.containment) < 1e-9 and r.containment >= 0.8 - 1e-9


def test_scan_of_awkward_tables(spark, docs, none):
    assert licenses.scan_licenses(none).count() == 0
    long = "All rights reserved. " + "word " * 50_000 + "Released under the MIT License."
    df = spark.createDataFrame([(1, long, "x"), (1, long, "x"), (None, "Released under the MIT License.", "x"), (2, "", "x"), (3, None, "x")], "doc_id long, text string, template string")
    out = licenses.scan_licenses(df).collect()
    assert sorted((r.doc_id or 0, r.template, r.start_word) for r in out) == [(0, "mit", 0)] + [(1, "all-rights-reserved", 0)] * 2 + [(1, "mit", 50_003)] * 2
    assert licenses.scan_licenses(docs).columns == ["doc_id", "template", "start_word", "n_words", "containment"]
