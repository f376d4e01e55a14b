"""Language identification by hierarchical discrimination.

A first set of linear support vector machines picks the language family; within a family, one
machine for each pair of languages votes. Features are byte trigrams of the letters, hashed into a
fixed number of dimensions. The machines are fitted on a bounded sample of labelled rows; every text
is then classified whole.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import values

#: Families of common languages by ISO 639-1 code. Others are families of their own.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "indic": "bn gu hi mr ne pa ur",
    "semitic": "am ar he mt",
}
DIMS = 4096
UNKNOWN = "und"

_LETTERS = np.full(256, 32, np.uint32)
for _c in range(97, 123):
    _LETTERS[_c] = _LETTERS[_c - 32] = _c
_LETTERS[128:] = np.arange(128, 256)


def family_of(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang in codes.split()), lang)


def features(text: str) -> np.ndarray:
    """Unit vector of square-rooted trigram frequencies; zero for texts without letters."""
    b = _LETTERS[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    if len(b):
        b = b[np.r_[True, (b[1:] != 32) | (b[:-1] != 32)]]
    b = np.r_[np.uint32(32), b, np.uint32(32)].astype(np.uint32)
    key = (b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(2654435761)
    x = np.sqrt(np.bincount(key >> np.uint32(20), minlength=DIMS).astype(np.float32))
    norm = np.linalg.norm(x)
    return x / norm if norm else x


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def fit_svms(x: np.ndarray, y: np.ndarray, c: float = 10.0, steps: int = 100_000, seed: int = 7) -> np.ndarray:
    """Linear support vector machines over the same rows, by dual coordinate descent; the last weight is the bias.

    ``y`` has a column of -1 and 1 for each machine. All machines take a row's step together, on the features that the row has.
    """
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float64)
    has = [np.flatnonzero(row) for row in x]
    w, alpha, diag = np.zeros((y.shape[1], x.shape[1])), np.zeros(y.shape), (x * x).sum(1)
    of = np.maximum(1, np.stack([(y < 0).sum(0), (y > 0).sum(0)]))
    most = np.where(y > 0, len(y) / (2 * of[1]), len(y) / (2 * of[0])) * c
    rng = np.random.default_rng(seed)
    for _ in range(max(5, min(25, steps // len(x)))):
        for i in rng.permutation(len(x)):
            f = has[i]
            v = x[i, f]
            new = np.clip(alpha[i] - (y[i] * (w[:, f] @ v) - 1) / diag[i], 0, most[i])
            step = (new - alpha[i]) * y[i]
            alpha[i] = new
            if len(hit := np.flatnonzero(step)):
                w[np.ix_(hit, f)] += np.outer(step[hit], v)
    return w


class Model:
    """``families``: names; ``top``: a machine a family; ``pairs``: per family its languages and their machines.

    ``centres``: the mean vector of each language, and how alike it is to all but the least typical ``odd`` of its rows.
    """

    def __init__(self, x: np.ndarray, langs: list[str], odd: float = 0.02):
        fam = np.array([family_of(lang) for lang in langs])
        langs = np.array(langs)
        self.families = sorted(set(fam))
        self.top = fit_svms(x, np.stack([np.where(fam == f, 1, -1) for f in self.families], axis=1)) if len(self.families) > 1 else None
        self.pairs, self.centres = {}, {}
        for f in self.families:
            names = sorted(set(langs[fam == f]))
            rows = []
            for (i, a), (j, b) in combinations(enumerate(names), 2):
                both = (langs == a) | (langs == b)
                rows.append((i, j, fit_svms(x[both], np.where(langs[both] == a, 1, -1)[:, None])[0]))
            self.pairs[f] = (names, rows)
            for a in names:
                mean = x[langs == a].mean(0)
                mean /= max(float(np.linalg.norm(mean)), 1e-9)
                self.centres[a] = (mean, max(float(np.quantile(x[langs == a] @ mean, odd)), 1e-9))

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        """Language and score: how sure the machines are, less where the text is unlike the language's rows."""
        lang, sure = self._discriminate(np.append(x, np.float32(1)))
        mean, usual = self.centres[lang]
        return lang, sure * min(1.0, float(x @ mean) / usual)

    def _discriminate(self, x: np.ndarray) -> tuple[str, float]:
        sure, f = 1.0, self.families[0]
        if self.top is not None:
            m = self.top @ x
            k = int(m.argmax())
            f, sure = self.families[k], 1 / (1 + np.exp(-3 * (m[k] - np.delete(m, k).max())))
        names, rows = self.pairs[f]
        if not rows:
            return names[0], float(sure)
        votes, margins = np.zeros(len(names)), np.zeros(len(names))
        for i, j, w in rows:
            m = float(w @ x)
            votes[i if m >= 0 else j] += 1
            margins[i] += m
            margins[j] -= m
        best = int(np.lexsort((-np.arange(len(names)), margins, votes))[-1])
        return names[best], float(sure / (1 + np.exp(-3 * margins[best] / max(1, len(names) - 1))))


def held_out(doc_id, every: int = 4, remainder: int = 2):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(every)) == remainder, F.lit(False))


def _vectors(batches):
    """Feature vectors of texts with a letter; a text that a task meets again under one label counts once."""
    seen = set()
    for b in batches:
        out = ([], [], [])
        for lang, key, text in zip(values(b.column(0)), values(b.column(1)), values(b.column(2)), strict=True):
            if (lang, key) not in seen and has_letter(text):
                seen.add((lang, key))
                for k, v in enumerate((lang, key, features(text).astype("<f4").tobytes())):
                    out[k].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names=["lang", "key", "x"])


def fit(docs: DataFrame, per_language: int = 300, sample: int = 4000, least: int = 16, seed: int = 5) -> Model | None:
    """Fit on a bounded sample: about ``per_language`` labelled texts of each language, fewer where ``sample`` would be exceeded.

    However many languages there are, each has about ``least`` texts, or all it has. A vector is 16 KB, so about
    64 MB reach the driver, or 256 KB a language. Rows are drawn by a hash of id and text; equal rows count once.
    None if no labelled row has a letter.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    labelled = labelled.select("lang", F.xxhash64(F.lit(seed), "doc_id", "text").alias("key"), "text")
    counts = labelled.groupBy("lang").agg(F.approx_count_distinct("key").alias("n"))
    langs = max(1, counts.count())
    per_language = max(least, min(per_language, sample // langs))
    share = counts.select("lang", F.least(F.lit(1.0), F.lit(1.1 * per_language) / F.col("n")).alias("share"))  # counts are right to a few per cent
    draw = F.pmod("key", F.lit(1 << 30)) < F.col("share") * F.lit(float(1 << 30))
    # labels are few beside rows; Spark broadcasts them if they are small enough
    drawn = labelled.join(share, "lang").where(draw).select("lang", "key", "text").mapInArrow(_vectors, "lang string, key long, x binary")
    rows = sorted((r.lang, r.key, bytes(r.x)) for r in drawn.dropDuplicates(["lang", "key"]).collect())
    if not rows:
        return None
    return Model(np.stack([np.frombuffer(x, "<f4") for *_, x in rows]), [lang for lang, *_ in rows])


def _classify(model: Model | None, at: int):
    def run(batches):
        for b in batches:
            got = [model.predict(features(t)) if model and has_letter(t) else (UNKNOWN, 0.0) for t in values(b.column(at))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """Every row's columns with ``lang_pred`` and ``score`` (0 to 1); columns of these names are replaced.

    Only the text is looked at, whole, one at a time. Null texts and texts without a letter are ``und`` with
    score 0; so is everything when there was no labelled row to learn from. A score is low where the machines
    are unsure and where the text is unlike all that was learned. Equal texts get equal results, and repeated
    rows stay; an empty table gives none. There is no shuffle.
    """
    cols = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    rest = docs.select(*[F.col(f"`{c}`") for c in cols])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields), "lang_pred string, score double"])
    return rest.mapInArrow(_classify(model, cols.index(text_col)), schema)
