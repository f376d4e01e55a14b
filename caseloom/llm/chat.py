"""Chat formatting by grammar round trip.

A turn is rendered as ``<|im_start|>role`` newline ``text<|im_end|>`` newline. It is then read back by
a deterministic parser; if that does not give the same role and text, what conflicts is escaped, and
again, until it does. An escape puts one more backslash into ``<\\...|``, which the parser takes out.
Turns that read back alone read back in a row, so conversations need not be held whole.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parallelism
from .hashing import values

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n((?:(?!<\|im_end\|>|<\|im_start\|>).)*)<\|im_end\|>\n", re.S)
_DEEPEN, _UNDO = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _DEEPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNDO.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """Roles stand on one line: backslashes and line ends are spelled out as well."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def parse(rendered: str) -> list[tuple[str, str, int, int]] | None:
    """Turns as (role, text, begin and end of the text as rendered); None if it does not follow the grammar."""
    at, turns = 0, []
    while at < len(rendered):
        m = _TURN.match(rendered, at)
        if not m:
            return None
        turns.append((unescape_role(m[1]), unescape(m[2]), m.start(2), m.end(2)))
        at = m.end()
    return turns


def render(role: str, text: str) -> tuple[str, int, int]:
    """One turn, and where its text stands; escaped as little as reads back identical."""
    for r, t in ((role, text), (role, escape(text)), (escape_role(role), text), (escape_role(role), escape(text))):
        out = f"{OPEN}{r}\n{t}{CLOSE}\n"
        if (got := parse(out)) and len(got) == 1 and got[0][:2] == (role, text):
            return out, got[0][2], got[0][3]
    raise AssertionError("escaped text must read back")


def _format(batches):
    for b in batches:
        rows = [render(r or "", t or "") for r, t in zip(values(b.column(2)), values(b.column(3)), strict=True)]
        loss = [(role == "assistant") for role in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] if x else 0 for r, x in zip(rows, loss, strict=True)], pa.int32()), pa.array([r[2] if x else 0 for r, x in zip(rows, loss, strict=True)], pa.int32())],
            names=["conv_id", "turn", "rendered", "loss_from", "loss_to"],
        )


def format_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, rendered, loss_from, loss_to`` for every turn; a conversation is its turns in order.

    The loss mask covers code points ``loss_from`` to ``loss_to`` of ``rendered``: an assistant's text as
    rendered, nothing for other roles. Null roles and texts count as empty; texts are rendered whole. Repeated
    rows are rendered each time, an empty table gives none, and other columns are not kept, whatever
    their names. Nothing is shuffled.
    """
    return turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").mapInArrow(_format, "conv_id long, turn long, rendered string, loss_from int, loss_to int")


def _read_back(batches):
    cols = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    key, state, done = object(), None, []

    def close():
        if state:
            done.append((key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

    def out():
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        batch = pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)], names=cols)
        done.clear()
        return batch

    for b in batches:
        for conv, rendered, a, z in zip(*(values(b.column(i)) for i in (0, 2, 3, 4)), strict=True):
            if conv != key:
                close()
                key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text, _, _ in parse(rendered):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            loss = unescape(rendered[a:z])
            state[2] += len(loss)
            state[3].update(loss.encode("utf-8", "surrogatepass"))
            state[4] += len(rendered)
        if len(done) > 5000:
            yield out()
    close()
    if done:
        yield out()


def read_back(formatted: DataFrame, part_bytes: int = 64 << 20) -> DataFrame:
    """Per conversation, from rendered text alone: turns, digests of turns and of what the loss mask covers, sizes.

    Turns come by ``turn`` (nulls first), then by what they render to; repeated rows are turns of their
    own. A conversation is read as a stream, so its length does not matter for memory; a turn is held
    whole. Conversations with a null id are one. An empty table gives none. There are as many parts as
    shuffle partitions, or more where those would exceed ``part_bytes`` of text.
    """
    total = formatted.agg(F.sum(F.octet_length("rendered").cast("long"))).first()[0] or 0
    n = max(parallelism(formatted.sparkSession), -(-total // part_bytes))
    ordered = formatted.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "rendered")
    return ordered.mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
