"""License scans: MinHash over overlapping windows retrieves templates, exact containment verifies.

Texts and templates are compared by 5-word shingles (all the words of a shorter template). For the
templates of one length, windows slightly longer than the template start every ``hop`` words, so any
occurrence lies inside one. A band is one MinHash value; a window that holds the required share of
a template's shingles has at least the Jaccard similarity ``floor_similarity`` with it, and the
number of bands is set so that the chance of no equal band is below one in a million. A band can only
be equal where the template's smallest shingle in it stands, so bands are computed for the windows
around such shingles alone. Each retrieved window is then checked by exact containment of the
template's shingles. Templates that resemble each other may match in one place; containment tells
them apart.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import A, WordHasher, mix64, values, windows
from .license_texts import LONG, SHORT

TEMPLATES = SHORT + LONG
N = 5
#: Most templates, since every task gets them all.
LIMIT = 10_000

_AROUND = regex.compile(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$")


def _bare(word: bytes) -> bytes:
    """A word without the punctuation around it."""
    return _AROUND.sub("", word.decode("utf-8", "surrogatepass")).encode("utf-8", "surrogatepass")


class Group:
    """Templates with the same number of words."""

    def __init__(self, n_words: int, share: float, miss: float):
        self.n_words = n_words
        self.n = min(N, n_words)
        self.shingles = n_words - self.n + 1
        self.hop = max(1, self.shingles // 4)
        self.width = self.shingles + self.hop - 1
        need = math.ceil(share * self.shingles)
        self.floor_similarity = need / (self.width + self.shingles - need)
        self.bands = 1 if self.floor_similarity >= 1 else math.ceil(math.log(miss) / math.log(1 - self.floor_similarity))
        self.names: list[str] = []
        self.sets: list[np.ndarray] = []


class Scanner:
    def __init__(self, templates, share: float = 0.8, miss: float = 1e-6):
        self.share, self.hasher, groups = share, WordHasher(clean=_bare), {}
        for name, text in templates:
            h = self.words(text)
            if len(h):
                g = groups.setdefault(len(h), Group(len(h), share, miss))
                g.names.append(name)
                g.sets.append(np.unique(windows(h, g.n)))
        self.groups = list(groups.values())
        self.seeds = mix64(np.arange(1, 1 + max([g.bands for g in self.groups], default=0), dtype=np.uint64) * A)
        #: By shingle length, the templates' smallest shingles: (group, template, seed, minimum) of the bands they stand for.
        self.smallest: dict[int, dict[int, list]] = {}
        for g in self.groups:
            for t, ts in enumerate(g.sets):
                for seed in self.seeds[: g.bands]:
                    mixed = mix64(ts ^ seed)
                    key = int(ts[mixed.argmin()])
                    self.smallest.setdefault(g.n, {}).setdefault(key, []).append((g, t, seed, mixed.min()))
        self.keys = {n: np.sort(np.fromiter(of, np.uint64, len(of))) for n, of in self.smallest.items()}

    def words(self, text: str | None) -> np.ndarray:
        h = self.hasher(text)
        return h[h != 0]

    def scan(self, text: str | None) -> list[tuple[str, int, int, float]]:
        """Matches as (template, first word, words, containment): the best window of each run of overlapping ones."""
        h, found = self.words(text), []
        for n, keys in self.keys.items():
            if len(h) >= n:
                s = windows(h, n)
                at = np.flatnonzero(keys[np.minimum(np.searchsorted(keys, s), len(keys) - 1)] == s)
                if len(at):
                    found += self._matches(s, n, at, len(h))
        return sorted(found, key=lambda f: (f[1], f[0]))

    def _matches(self, s: np.ndarray, n: int, at: np.ndarray, n_words: int) -> list[tuple[str, int, int, float]]:
        """Matches among shingles ``s``, where ``at`` are the places of smallest shingles."""
        hits: dict[Group, set[tuple[int, int]]] = {}
        for key in np.unique(s[at]):
            places = at[s[at] == key]
            for g, t, seed, want in self.smallest[n][int(key)]:
                last = max(0, len(s) - g.width + g.hop - 1) // g.hop
                low, high = np.maximum(places - g.width + g.hop, 0) // g.hop, np.minimum(places // g.hop, last)
                around = {k * g.hop for a, b in zip(low.tolist(), high.tolist(), strict=True) for k in range(a, b + 1)}
                known = hits.setdefault(g, set())
                known.update((t, x) for x in around if (t, x) not in known and mix64(s[x : x + g.width] ^ seed).min() == want)
        found = []
        for g, retrieved in hits.items():
            best: dict[tuple[int, int], tuple[float, int]] = {}
            for t, x in sorted(retrieved):
                have = len(np.intersect1d(s[x : x + g.width], g.sets[t])) / len(g.sets[t])
                if have >= self.share - 1e-12:
                    run = next((r for r in ((t, y) for y in range(x - g.width, x)) if r in best), None)
                    if run is None or have > best[run][0]:
                        best.pop(run, None)
                        best[(t, x)] = (have, x)
            found += [(g.names[t], x, min(g.width + g.n - 1, n_words - x), have) for (t, _), (have, x) in best.items()]
        return found


def _scan(templates, share: float):
    schema = pa.schema([("doc_id", pa.int64()), ("template", pa.string()), ("start_word", pa.int64()), ("n_words", pa.int64()), ("containment", pa.float64())])

    def run(batches):
        scanner = Scanner(templates, share)
        for b in batches:
            rows = [(i, *m) for i, text in zip(values(b.column(0)), values(b.column(1)), strict=True) for m in scanner.scan(text)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    return run


def scan_licenses(docs: DataFrame, templates=TEMPLATES, share: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Matches ``doc_id, template, start_word, n_words, containment``; documents without any give no row.

    ``templates``: (name, text) pairs, a stated list of at most ``LIMIT`` that every task gets whole; more are refused. A-Z is lower-cased and
    punctuation around words does not count. Null and empty texts match nothing, an empty table gives
    none; equal rows match each on its own; a repeated passage matches at each place. Of equally good windows
    the first counts. Texts are read whole, one at a time; other columns of ``docs`` are not kept,
    whatever their names. There is no shuffle.
    """
    templates = tuple(templates)
    if len(templates) > LIMIT:
        raise ValueError(f"at most {LIMIT} templates")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_scan(templates, share), "doc_id long, template string, start_word long, n_words long, containment double")
