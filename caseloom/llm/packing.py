"""Packing by power-of-two decomposition: each document is cut into pieces of binary lengths.

A document of T ids gives T // cap pieces of ``cap`` ids and then one piece for each binary digit of
the rest, longest first. Pieces of one length form a bucket; a training sequence is one piece, so
sequences have no padding and never cross documents.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import values

END_OF_TEXT = 1
#: Texts with other characters go through the tokenizer whole: libraries may class those differently.
PLAIN = r"[^\t\n\r\x20-\x7e -ɏ‐-‧‰-⁞]"


def _bytes_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def merges_by_id(path: str) -> bool:
    """Whether the ids of merged tokens rise with their merges, so that an id can stand for a merge's rank."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
    ids = [model["vocab"].get(a + b, -1) for a, b in pairs]
    return not model.get("ignore_merges") and all(x < y for x, y in zip([-1, *ids], ids, strict=False))


class FastTokenizer:
    """Ids of a byte-level BPE file of the tokenizers library.

    Where a token's id rises with its merge, which is checked, the faster library gives the same ids for the same
    pattern. Texts with special tokens, or with characters that the two may class differently, go to the
    library that the file belongs to.
    """

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        byte = _bytes_of()
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.fast = None
        if merges_by_id(path):
            ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items() if token not in special}
            self.fast = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.special, self.odd = special, regex.compile(PLAIN).search

    def __call__(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if self.fast is None or self.odd(text) or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, disallowed_special=())


def decompose(n: int, cap: int) -> list[int]:
    """Lengths of the pieces of ``n`` ids."""
    rest = n % cap
    return [cap] * (n // cap) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


SCHEMA = "doc_id long, start long, length long, ids array<int>, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack(path: str, pattern: str, cap: int):
    schema = pa.schema([(c, pa.list_(pa.int32()) if c == "ids" else pa.int64()) for c in ("doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset")])

    def run(batches):
        encode = FastTokenizer(path, pattern)
        next_id = TaskContext.get().partitionId() << 36
        rows, held = [], []

        def flush():
            nonlocal next_id
            flat = np.concatenate(held)
            lengths = np.array([r[2] for r in rows], np.int64)
            ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), pa.array(flat.view(np.int32)))
            out = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(lengths), ids, pa.array([r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.int64())]
            out += [pa.array(np.arange(next_id, next_id + len(rows))), pa.array(np.zeros(len(rows), np.int64))]
            next_id += len(rows)
            rows.clear()
            held.clear()
            return pa.RecordBatch.from_arrays(out, schema=schema)

        size = 0
        for b in batches:
            for doc_id, text in zip(values(b.column(0)), values(b.column(1)), strict=True):
                ids = np.append(encode(text or ""), np.uint32(END_OF_TEXT)).astype("<u4")
                at = 0
                for length in decompose(len(ids), cap):
                    piece = ids[at : at + length]
                    rows.append((doc_id, at, length, zlib.crc32(piece), len(ids)))
                    held.append(piece)
                    at += length
                size += len(ids)
                if size > 1_000_000:
                    yield flush()
                    size = 0
        if rows:
            yield flush()

    return run


def pack(docs: DataFrame, tokenizer: str, pattern: str, cap: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents: ``doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset``.

    ``tokenizer`` is the path of a byte-level BPE in the tokenizers library's JSON, the same on every
    executor, and ``pattern`` its pre-token pattern. ``cap`` must be a power of two. A null text counts
    as empty: one piece with the closing id. Equal rows are packed each time; an empty table gives none. Other
    columns of ``docs`` are not kept, whatever their names. ``sequence_id`` is unique, ``offset`` is 0 because a
    sequence is one piece. There is no shuffle; a document is held whole. ``write_buckets`` puts equal lengths together.
    """
    if cap < 1 or cap & (cap - 1):
        raise ValueError("cap must be a power of two")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_pack(tokenizer, pattern, cap), SCHEMA)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write sequences in one folder a length."""
    pieces.write.partitionBy("length").parquet(path)
