import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def near_copies(rng, base: list[str], n: int, edits: int) -> list[str]:
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="session")
def rows():
    """Copies, near copies, shared passages, repeated rows, nulls, empty, blank, short and long texts."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5)))
    prose = lambda n: [word() for _ in range(n)]
    passage = prose(30)
    texts = [" ".join(prose(rng.randint(60, 200))) + "." for _ in range(30)]
    texts += [" ".join(prose(60) + passage + prose(60)) for _ in range(20)]
    base = prose(150)
    texts += near_copies(rng, base, 30, 4) + near_copies(rng, prose(120), 20, 12)
    texts += [texts[0]] * 7 + [texts[3].upper()] * 3
    texts += ["", " ", "\n\t", "one", "one", "two words", "Two WORDS", None, None, "<|endoftext|> x", "日本 語\x1c ok\u0085", " ".join(prose(6000)), "a b c " * 400]
    out = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s0", "s1", "s2", None]), None if t is None else len(t)) for i, t in enumerate(texts)]
    return out + [out[5], out[5], (None, "a row without an id " * 20, "en", "s1", 3), (None, None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With a further column, of the name of a result, and in several partitions."""
    from pyspark.sql import functions as F

    names = ("kept", "shard", "slot", "score", "lang_pred", "clean_text", "taken", "sig", "node", "size")
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.withColumns({n: F.lit("clash") for n in names})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
