"""Scoring texts with a weighted backoff automaton of order 3, learned from the corpus.

A state is a history: two words, one word, or nothing. Each history of two words has a failure arc to
its last word, and each word one to the empty history, where every word has an arc:

    root(w)     = log10 P(w), P(w) = (c(w) - d) / N for known words, d V / N for the unknown one
    fail(v)     = log10 leave; 0 for a word that is no history
    arc(v, w)   = log10 P(w|v), P(w|v) = (1 - leave) c(vw) / c(v) + leave P(w), if c(vw) > 0
    fail(uv)    = log10 b, b = 1 - sum over its arcs of (c(uvw) - D) / c(uv); 0 without arcs
    arc(uv, w)  = log10 ((c(uvw) - D) / c(uv) + b P(w|v)), if c(uvw) >= least

so the probabilities of each state sum to one. The lower order is Jelinek-Mercer smoothing, the upper
one absolute discounting with the usual cutoff of word triples seen once; the discounts d and D are
n1 / (n1 + 2 n2) of the counts of words and of triples. A text is read from left to right: the state
is carried along, a word takes its arc, or else failure arcs until there is one, and the weights add
up. As a state is at most two words long, the states that all places of a block are reached in are
known at once, so the steps of the traversal are taken as arrays.

The automaton grows with the corpus and is nowhere whole. Documents are dealt into blocks. A block
counts its histories with the words after them and sends each distinct one to the owner of its hash
range; owners add up and answer with the corpus counts, in the order asked, which are the states and
arcs that the block needs. A frequent history arrives once a block. Blocks talk to owners through a
tree of at most ``fan`` branches: an owner inside the tree adds up for its group of blocks and asks
on, so that messages grow in proportion to the blocks, and what is frequent shrinks on the way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parallelism
from .hashing import A, B, WordHasher, mix64, values

START, END, AFTER = np.uint64(0x5354415254), np.uint64(0x454E44), np.uint64(0x4146544552)
#: Share that a word as a history leaves to its failure arc, and the least count of an arc of three words.
LEAVE, LEAST = 0.8, 2
#: Branches of the tree of owners.
FAN = 512


def held_out(doc_id, every: int = 7, remainder: int = 2):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(every)) == remainder


# ---- arrays in messages ----------------------------------------------------------------------------


def _packed(x: np.ndarray) -> bytes:
    """Unsigned numbers as compressed bytes, those of one place together."""
    flat = np.ascontiguousarray(x.astype(x.dtype.newbyteorder("<"), copy=False)).view(np.uint8).reshape(len(x), x.dtype.itemsize)
    return pa.compress(np.ascontiguousarray(flat.T).tobytes(), codec="zstd", asbytes=True) if len(x) else b""


def _unpacked(data: bytes, n: int, kind=np.uint64) -> np.ndarray:
    if not n:
        return np.zeros(0, kind)
    width = np.dtype(kind).itemsize
    flat = np.frombuffer(pa.decompress(data, n * width, codec="zstd"), np.uint8).reshape(width, n)
    return np.ascontiguousarray(flat.T).view(np.dtype(kind).newbyteorder("<")).reshape(n).astype(kind, copy=False)


def _steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=np.uint64(0))


def _starts(rising: np.ndarray) -> np.ndarray:
    """Where a new value begins."""
    return np.flatnonzero(np.r_[True, rising[1:] != rising[:-1]]) if len(rising) else np.zeros(0, np.int64)


def _summed(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, starts, dtype=np.uint64) if len(starts) else np.zeros(0, np.uint64)


def _grouped(keys: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Distinct keys in order, for each key which of them it is, and the weight of each. A task holds fewer than 2**32 keys."""
    o = np.argsort(keys)
    k = keys[o]
    starts = _starts(k)
    distinct = k[starts]
    del k
    total = None if weight is None else _summed(weight[o], starts)
    rank = np.zeros(len(o), np.uint32)
    rank[starts[1:]] = 1
    which = np.empty(len(o), np.uint32)
    which[o] = np.cumsum(rank, out=rank)
    return distinct, which, total


class Counts:
    """Distinct histories with the words after them, distinct words, and their counts.

    ``hist`` rises; ``kids`` (32-bit hashes of words) rise within their history, ``of`` says which that is.
    Filled in three steps, so that a step's arrays can go before the next: these are what takes a task's memory.
    """

    def histories(self, keys) -> None:
        self.hist, self.hist_at, _ = _grouped(keys)

    def after(self, kids, counts, of=None) -> None:
        """``of``: which of the keys each word follows; the one at its own place if not given."""
        joint = (self.hist_at if of is None else self.hist_at[of]).astype(np.uint64)
        joint <<= np.uint64(32)
        joint |= kids
        joint, self.kid_at, self.kid_counts = _grouped(joint, counts)
        self.of, self.kids = (joint >> np.uint64(32)).astype(np.uint32), joint.astype(np.uint32)
        self.begins = _starts(self.of)  # every history has a word after it

    def all_words(self, words, counts) -> None:
        self.words, self.word_at, self.word_counts = _grouped(words, counts)

    def messages(self, src: int, first: int, parts: int, ranges: int):
        """One message for each of ``parts`` hash ranges from ``first`` on, of ``ranges`` that there are in all."""
        begins = np.array([((first + p) << 64) // ranges for p in range(parts)], np.uint64)
        cut = lambda k: np.r_[0, np.searchsorted(k, begins[1:]), len(k)]
        h, w = cut(self.hist), cut(self.words)
        k = np.searchsorted(self.of, h)
        width = np.diff(np.r_[self.begins, len(self.of)]).astype(np.uint32)
        for p in range(parts):
            hs, ks, ws = (slice(c[p], c[p + 1]) for c in (h, k, w))
            sizes = [int(c[p + 1] - c[p]) for c in (h, k, w)]
            arrays = [_steps(self.hist[hs]), width[hs], self.kids[ks], self.kid_counts[ks], _steps(self.words[ws]), self.word_counts[ws]]
            yield (first + p, src, *sizes, *map(_packed, arrays))

    @classmethod
    def merged(cls, asked: pa.Table) -> tuple[Counts, list[tuple[int, int, int, int]]]:
        """All messages together, and ``(src, histories, kids, words)`` of each of them in turn."""
        cols, sizes, at = [[] for _ in range(6)], [], 0
        for batch in asked.to_batches(max_chunksize=64):
            for r in batch.to_pylist():
                n, m, w = r["n_hist"], r["n_kids"], r["n_words"]
                cols[0].append(np.cumsum(_unpacked(r["hist"], n), dtype=np.uint64))
                cols[1].append(np.repeat(np.arange(at, at + n, dtype=np.uint32), _unpacked(r["width"], n, np.uint32)))
                cols[2].append(_unpacked(r["kids"], m, np.uint32))
                cols[3].append(_unpacked(r["kid_counts"], m))
                cols[4].append(np.cumsum(_unpacked(r["words"], w), dtype=np.uint64))
                cols[5].append(_unpacked(r["word_counts"], w))
                sizes.append((r["src"], n, m, w))
                at += n
        c, next_of = cls(), lambda: np.concatenate(cols.pop(0))
        c.histories(next_of())
        of, kids = next_of(), next_of()
        c.after(kids, next_of(), of)
        del of, kids
        c.all_words(next_of(), next_of())
        return c, sizes


ASKED = pa.schema([("owner", pa.int64()), ("src", pa.int64()), *((c, pa.int64()) for c in ("n_hist", "n_kids", "n_words")), *((c, pa.binary()) for c in ("hist", "width", "kids", "kid_counts", "words", "word_counts"))])
ASKED_SQL = "owner long, src long, n_hist long, n_kids long, n_words long, hist binary, width binary, kids binary, kid_counts binary, words binary, word_counts binary"
#: Tokens, known words, words and triples seen once and twice: each owner's share.
STATS = ("tokens", "types", "once", "twice", "once3", "twice3")
ANSWER = pa.schema([("src", pa.int64()), ("part", pa.int64()), *((c, pa.int64()) for c in ("n_hist", "n_kids", "n_words")), *((c, pa.binary()) for c in ("kept", "arcs", "kids", "words")), *((c, pa.int64()) for c in STATS), ("seen", pa.binary())])
ANSWER_SQL = "src long, part long, n_hist long, n_kids long, n_words long, kept binary, arcs binary, kids binary, words binary, " + ", ".join(f"{c} long" for c in STATS) + ", seen binary"
_AFTER_KID = np.uint32(mix64(np.array([AFTER]))[0] >> np.uint64(32))


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


class Totals:
    """Corpus counts of what a ``Counts`` holds, in its order: histories ``seen``, the sum of their ``kept`` arcs and how many ``arcs``, ``kids``, ``words``."""

    def __init__(self, seen, kept, arcs, kids, words, stats: dict[str, int]):
        self.seen, self.kept, self.arcs, self.kids, self.words, self.stats = seen, kept, arcs, kids, words, stats

    @classmethod
    def of(cls, c: Counts, least: int) -> Totals:
        """Where the counts are those of the whole corpus."""
        word = c.kids != _AFTER_KID
        arc, real = (c.kid_counts >= least) & word, c.kid_counts[word]
        count = lambda x, k: int((x == k).sum())
        stats = dict(zip(STATS, (int(c.word_counts.sum()), int((c.word_counts > 0).sum()), count(c.word_counts, 1), count(c.word_counts, 2), count(real, 1), count(real, 2)), strict=True))
        return cls(*(_summed(x, c.begins) for x in (c.kid_counts, c.kid_counts * arc, arc)), c.kid_counts, c.word_counts, stats)

    @classmethod
    def joined(cls, answers: pa.Table) -> Totals:
        """From the answers of all owners that were asked, in the order of their ranges."""
        rows = answers.sort_by("part").to_pylist()
        get = lambda name, n: np.concatenate([_unpacked(r[name], r[n]) for r in rows] or [np.zeros(0, np.uint64)])
        arrays = [get("seen", "n_hist"), get("kept", "n_hist"), get("arcs", "n_hist"), get("kids", "n_kids"), get("words", "n_words")]
        return cls(*arrays, {s: sum(r[s] for r in rows) for s in STATS})

    def answers(self, owner: int, c: Counts, sizes: list[tuple[int, int, int, int]]):
        """To each message its part."""
        h = k = w = 0
        for src, n, m, x in sizes:
            hs, ks, ws = c.hist_at[h : h + n], c.kid_at[k : k + m], c.word_at[w : w + x]
            h, k, w = h + n, k + m, w + x
            yield (src, owner, n, m, x, _packed(self.kept[hs]), _packed(self.arcs[hs]), _packed(self.kids[ks]), _packed(self.words[ws]), *(self.stats[s] for s in STATS), _packed(self.seen[hs]))


def _answer(least: int):
    def run(asked: pa.Table) -> pa.Table:
        c, sizes = Counts.merged(asked)
        return _table(list(Totals.of(c, least).answers(asked.column("owner")[0].as_py(), c, sizes)), ANSWER)

    return run


def _ask_on(ranges: int, fan: int):
    """An owner of one of ``ranges`` ranges in its group asks the owners above it, one for each ``fan``-th of its range."""

    def run(asked: pa.Table) -> pa.Table:
        owner = asked.column("owner")[0].as_py()
        group, r = divmod(owner, ranges)
        c, _ = Counts.merged(asked)
        above = (group // fan) * ranges * fan
        return _table([(above + part, *rest) for part, *rest in c.messages(owner, r * fan, fan, ranges * fan)], ASKED)

    return run


def _pass_on(asked: pa.Table, answers: pa.Table) -> pa.Table:
    c, sizes = Counts.merged(asked)
    return _table(list(Totals.joined(answers).answers(asked.column("owner")[0].as_py(), c, sizes)), ANSWER)


def exchanged(asked: DataFrame, n: int, levels: int, fan: int, least: int, level: int = 1) -> DataFrame:
    """Answers to messages that went to ``fan ** level`` hash ranges in each group of ``fan ** level`` blocks."""
    asked = asked.repartition(n, "owner")
    if level == levels:
        return asked.groupBy("owner").applyInArrow(_answer(least), ANSWER_SQL)
    above = asked.groupBy("owner").applyInArrow(_ask_on(fan**level, fan), ASKED_SQL)
    answers = exchanged(above, n, levels, fan, least, level + 1)
    return asked.groupBy("owner").cogroup(answers.groupBy("src")).applyInArrow(_pass_on, ANSWER_SQL)


# ---- blocks ------------------------------------------------------------------------------------------


class Tape:
    """The texts of a block, one after another, each closed by END and a place after it.

    The history at a place is the two words before it; so the history at the next place is the pair
    of this word and the one before.
    """

    def __init__(self, texts, train):
        hasher = WordHasher()
        parts = [np.r_[hasher(t), END, AFTER] for t in values(texts)]
        self.lengths = np.array([len(p) for p in parts], np.int64)
        tok = np.concatenate(parts)
        del parts, hasher
        self.begins = np.cumsum(self.lengths) - self.lengths
        weight = np.repeat(np.fromiter(train, np.uint8, len(self.lengths)), self.lengths)
        self.counts, self.real = Counts(), tok != AFTER
        self.counts.histories(self._keys(tok))
        tok = mix64(tok)
        self.counts.after((tok >> np.uint64(32)).astype(np.uint32), weight)
        tok, weight = tok[self.real], weight[self.real]
        self.counts.all_words(tok, weight)

    def _keys(self, tok: np.ndarray) -> np.ndarray:
        before = np.empty_like(tok)
        before[1:] = tok[:-1]
        before[self.begins] = START
        keys = mix64(before) * B
        before[2:] = tok[:-2]
        before[self.begins], before[self.begins + 1] = START, START
        keys += before * A
        del before
        return mix64(keys)


def _ask(fan: int):
    def run(docs: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()  # what the block before has left
        block = docs.column("block")[0].as_py()
        c = Tape(docs.column("text"), docs.column("train").to_pylist()).counts
        first = block // fan * fan  # owners of a group are numbered after those of the groups before it
        return _table([(first + part, *rest) for part, *rest in c.messages(block, 0, fan, fan)], ASKED)

    return run


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def discount(once: int, twice: int) -> float:
    return once / (once + 2 * twice) if once and twice else 0.5


def traverse(tape: Tape, t: Totals, leave: float, least: int, places: int = 1 << 18):
    """Weight of each step, words and ends, and the count of its word, for some texts at a time (about ``places`` places).

    Yields the lengths of the texts, without the place after each, the weights and the counts.
    """
    s, c = t.stats, tape.counts
    d, tokens = discount(s["once"], s["twice"]), s["tokens"]
    big_d = discount(s["once3"], s["twice3"])
    cuts = [*_starts(tape.begins // places).tolist(), len(tape.lengths)]
    begins = np.r_[tape.begins, len(tape.real)]
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        a, b = begins[i], begins[j]
        # the state that each place is reached in, and the states one word further on
        here = a + np.flatnonzero(tape.real[a:b])
        state = c.hist_at[here]
        pair = t.seen[c.hist_at[here + 1]].astype(float)
        lengths = tape.lengths[i:j] - 1
        c1 = t.words[c.word_at[a - i : b - j]].astype(float)  # each text before has one place that is no word
        last = np.empty_like(c1)  # how often the last word was a history
        last[1:] = c1[:-1]
        last[np.cumsum(lengths) - lengths] = c1[lengths[0] - 1]  # as many texts begin as end
        root = np.where(c1 > 0, c1 - d, d * s["types"]) / tokens if tokens else np.ones(len(c1))
        fail1 = np.where(last > 0, leave, 1.0)
        p = (1 - fail1) * pair / np.maximum(last, 1) + fail1 * root
        seen = np.maximum(t.seen[state], 1).astype(float)
        fail2 = 1 - (t.kept[state] - big_d * t.arcs[state]) / seen
        c3 = t.kids[c.kid_at[here]].astype(float)
        arc = np.where(c3 >= least, (c3 - big_d) / seen, 0.0)
        yield lengths, np.log10(arc + fail2 * p), c1


def _score(leave: float, least: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()
        train = docs.column("train").to_pylist()
        tape, t = Tape(docs.column("text"), train), Totals.joined(answers)
        whole = t.stats["tokens"] + t.stats["types"] + 1.0
        parts = []
        for lengths, step, c1 in traverse(tape, t, leave, least):
            begins = np.cumsum(lengths) - lengths
            add = np.add.reduceat
            parts.append((lengths, add((c1 > 0).astype(np.int64), begins), add(np.log10((c1 + 1.0) / whole), begins), add(step, begins)))
        n_tokens, known, base, score = map(np.concatenate, zip(*parts, strict=True))
        held = pa.array([not x for x in train])
        total = pa.array(np.full(len(train), t.stats["tokens"], np.int64))
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        return pa.table([docs.column("doc_id"), held, pa.array(n_tokens), pa.array(known), total, pa.array(base), pa.array(score)], names=names)

    return run


def tree(n: int, fan: int) -> tuple[int, int]:
    """Levels and branches of a tree with at least ``n`` owners and at most ``fan`` branches."""
    levels = 1
    while fan**levels < n:
        levels += 1
    width = 1
    while width**levels < n:
        width += 1
    return levels, width


def score_texts(docs: DataFrame, leave: float = LEAVE, least: int = LEAST, block_bytes: int = 16 << 20, fan: int = FAN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every text; learn from those that are not held out.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``, one row for
    each row of ``docs``; its other columns are not kept, whatever their names. Null texts count as
    empty: one token, the end. A null id counts as held in. Equal rows are scored, and learned from,
    each time. With nothing to learn from every word is unknown. An empty table gives none. A text is
    held whole by a task, with its block. There are as many blocks as shuffle partitions, or more
    where those would exceed ``block_bytes`` of text. Histories are told apart by 64-bit hashes, the
    words after one history by 32 bits.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    n = max(parallelism(spark), -(-total // block_bytes))
    levels, fan = tree(n, max(2, fan))
    block = F.pmod(F.xxhash64(id_col, text_col), F.lit(n))
    held = F.coalesce(held_out(F.col(id_col)), F.lit(False))
    blocks = docs.select(block.alias("block"), F.col(id_col).cast("long").alias("doc_id"), (~held).alias("train"), F.col(text_col).alias("text")).repartition(n, "block")
    asked = blocks.groupBy("block").applyInArrow(_ask(fan), ASKED_SQL)
    answers = exchanged(asked, n, levels, fan, least)
    return blocks.groupBy("block").cogroup(answers.groupBy("src")).applyInArrow(_score(leave, least), SCORED)
