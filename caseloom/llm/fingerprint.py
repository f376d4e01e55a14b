"""Order MinHash document fingerprints (DataFrame expressions only).

K-mers are runs of ``k`` words, numbered by occurrence. For each of ``m`` orders the ``l`` smallest
occurrence-numbered k-mers are taken, put back in text order, and hashed as a tuple; a slot agrees
between two texts only if the same k-mers stand in the same order, which makes the share of equal
slots sensitive to edit distance. The orders come from ``BASES`` independent hash orders, each begun
at ``m / BASES`` places of its circle, so that one sort serves several of them and places are so far
apart that short texts, too, have other k-mers next to each. All of it happens inside the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import parallelism, words

TOP = "9223372036854775807L"
#: Independent hash orders; more cost a sort each.
BASES = 4
#: Text that a range of ids holds, and the most ranges that there are.
RANGE_BYTES, RANGES = 64 << 20, 4096


def with_signature(df: DataFrame, text_col: str, out: str, k: int = 5, l: int = 2, m: int = 64) -> DataFrame:
    """Add ``out``: an array of ``m`` ints, ``m`` a multiple of ``BASES``. Texts of fewer than ``k`` words are one k-mer; texts without words get all zeros."""
    # words are hashed once; a k-mer's hash chains those of its words, all places at a time
    df = df.withColumn("__w", F.transform(words(F.col(text_col)), lambda w: F.xxhash64(w))).withColumn("__n", F.size("__w"))
    grams = f"slice(__w, 1, __n - {k - 1})"
    for j in range(1, k):
        grams = f"zip_with({grams}, slice(__w, {j + 1}, __n - {k - 1}), (a, b) -> xxhash64(a, b))"
    df = df.withColumn("__g", F.expr(f"case when __n = 0 then cast(array() as array<bigint>) when __n < {k} then array(xxhash64(__w)) else {grams} end"))
    df = df.withColumn("__k", F.size("__g")).withColumn("__b", F.expr("length(bin(__k + 1))"))
    df = df.withColumns({"__m": F.expr("shiftleft(1L, __b) - 1"), "__top": F.expr(f"shiftleft(shiftright({TOP}, __b), __b)")})
    # where k-mers repeat, equal ones meet, in text order; positions count from 1 in the low bits
    df = df.withColumn("__d", F.expr("size(array_distinct(__g)) < __k"))
    df = df.withColumn("__s", F.expr("if(__d, sort_array(transform(__g, (x, i) -> (x & -1 - __m) | cast(i + 1 as bigint))), cast(array() as array<bigint>))"))
    # the occurrence number of a repeated k-mer is found by halving steps back through its run
    occurrence = """if(i = 0 or shiftright(__s[i - 1], __b) <> shiftright(x, __b), 0,
        aggregate(sequence(__b, 0, -1), 0, (r, p) -> if(i - r - shiftleft(1, p) >= 0 and shiftright(__s[greatest(0, i - r - shiftleft(1, p))], __b) = shiftright(x, __b), r + shiftleft(1, p), r)))"""
    df = df.withColumns(
        {
            "__f": F.expr(f"if(__d, transform(__s, (x, i) -> xxhash64(__g[cast(x & __m as int) - 1], {occurrence})), transform(__g, x -> xxhash64(x, 0)))"),
            "__p": F.expr("case when __d then transform(__s, x -> x & __m) when __k = 0 then cast(array() as array<bigint>) else sequence(1L, cast(__k as bigint)) end"),
        }
    )
    per = m // BASES
    marks = [((1 << 63) // per) * j for j in range(per)]
    df = df.withColumn("__c", F.expr("transform(array(" + ", ".join(f"{x}L" for x in marks) + "), x -> shiftleft(shiftright(x, __b), __b))"))
    sigs = []
    for base in range(BASES):
        of = "y" if base == 0 else f"xxhash64(y, {base}L)"
        e, t = f"__e{base}", f"__t{base}"
        df = df.withColumn(e, F.expr(f"sort_array(zip_with(__f, __p, (y, p) -> ({of} & __top) | p))"))
        # how many hashes lie before a mark, by halving steps
        df = df.withColumn(
            t,
            F.expr(f"""transform(__c, c -> aggregate(sequence(__b, 0, -1), 0,
                (r, p) -> if(r + shiftleft(1, p) <= __k and {e}[least(r + shiftleft(1, p), __k) - 1] < c, r + shiftleft(1, p), r)))"""),
        )
        slot = f"""xxhash64(transform(sort_array(transform(sequence(0, least({l}, __k) - 1), t -> {e}[(s + t) % __k] & __m)), p -> __g[cast(p as int) - 1]))"""
        sigs.append(f"transform({t}, s -> cast({slot} & 2147483647L as int))")
    df = df.withColumn(out, F.expr(f"if(__k = 0, array_repeat(0, {per * BASES}), concat({', '.join(sigs)}))"))
    return df.drop("__w", "__n", "__g", "__k", "__b", "__m", "__s", "__d", "__f", "__c", "__p", "__top", *[f"__{x}{base}" for x in "et" for base in range(BASES)])


def likeness(a: Column, b: Column, m: int = 64) -> Column:
    """Share of slots that agree, 0 to 1."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.lit(float(m))


def as_text(sig: Column) -> Column:
    """A signature as lowercase hex, eight digits a slot."""
    return F.array_join(F.transform(sig, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def edited(text: Column, other: Column) -> Column:
    """The last third of a text (by code points) replaced by as much of another's beginning."""
    cut = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - cut), F.substring(other, F.lit(1), cut))


def fingerprints(docs: DataFrame, k: int = 5, l: int = 2, m: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text`` and ``sig`` (array of ints) of every row; null texts count as empty."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return with_signature(base, "text", "sig", k, l, m)


def _at_most(cuts: list[int], key: str, strict: bool) -> Column:
    """How many of the rising ``cuts`` are below a key, or at most the key, by halving steps."""
    test = "<" if strict else "<="
    steps = range(len(cuts).bit_length() - 1, -1, -1)
    listed = "array(" + ", ".join(f"{c}L" for c in cuts) + ")"
    return F.expr(f"aggregate(array({', '.join(map(str, steps))}), 0, (r, p) -> if(r + shiftleft(1, p) <= {len(cuts)} and {listed}[least(r + shiftleft(1, p), {len(cuts)}) - 1] {test} {key}, r + shiftleft(1, p), r))")


def in_ranges(docs: DataFrame, cuts: list[int], id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text``, with ``__r``, ``__key`` and ``__u``: ranges rise as ``(__key, __u)`` falls.

    An id that fills several ranges, as null may, is spread over them by a hash of the text.
    """
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = out.withColumn("__key", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("__u", F.pmod(F.xxhash64("text"), F.lit(1 << 30)).cast("long"))
    if not cuts:
        return out.withColumn("__r", F.lit(0))
    out = out.withColumns({"__lo": _at_most(cuts, "__key", True), "__hi": _at_most(cuts, "__key", False)})
    inside = F.when(F.col("__lo") == F.col("__hi"), F.col("__lo")).otherwise(F.col("__lo") + 1 + F.shiftright(F.col("__u") * (F.col("__hi") - F.col("__lo")), 30).cast("int"))
    return out.withColumn("__r", F.lit(len(cuts)) - inside).drop("__lo", "__hi")


def compare_with_next(docs: DataFrame, k: int = 5, l: int = 2, m: int = 64, range_bytes: int = RANGE_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint every text, its edited text, and say how alike it is to that and to the next document.

    Returns ``doc_id, text, edited_text, sig, edited_sig, near_edited, near_next``; other columns of ``docs``
    are not kept, whatever their names. Next is by descending id (null ids last, equal ids by a hash of the
    text, then the text), and the first follows the last. Rows are split at quantiles of the id into ranges
    of about ``range_bytes``; each range is ordered on its own, spilling if need be, and only the first row
    of a range is handed to the range before it, so nothing is ordered in a single task. One shuffle moves
    texts with their signatures. Null texts count as empty; a text is held whole. Repeated rows follow each
    other. A table of one row is followed by itself; an empty one gives none.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    total = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    n = min(RANGES, max(parallelism(docs.sparkSession), -(-total // range_bytes)))
    cuts = sorted(docs.select(F.percentile_approx(key, [i / n for i in range(1, n)] or [0.5], F.lit(100 * n))).first()[0] or [])
    rows = in_ranges(docs, cuts, id_col, text_col)
    order = Window.partitionBy("__r").orderBy(F.col("__key").desc(), F.col("__u").desc(), F.col("text").desc())
    ranged = with_signature(rows, "text", "sig", k, l, m)
    run = ranged.select("doc_id", "text", "sig", "__r", F.lead(F.struct("text", "sig"), 1).over(order).alias("__next"))
    tops = rows.groupBy("__r").agg(F.max(F.struct("__key", "__u")).alias("__top"))
    around = Window.orderBy("__r")  # one row a range
    # each range takes the first row of the next one that has rows; the last takes the very first
    follow = tops.select("__top", F.col("__r").alias("__own"), F.coalesce(F.lag("__r").over(around), F.last("__r").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("__before"))
    heads = rows.join(F.broadcast(follow), (F.col("__r") == F.col("__own")) & (F.struct("__key", "__u") == F.col("__top"))).groupBy("__before").agg(F.max("text").alias("text"))
    heads = with_signature(heads, "text", "sig", k, l, m).select(F.col("__before").alias("__r"), F.struct("text", "sig").alias("__head"))
    # as many rows as ranges, but with texts: left to Spark's check of its size
    out = run.join(heads, "__r", "left").withColumn("__next", F.coalesce("__next", "__head"))
    out = out.withColumn("edited_text", edited(F.col("text"), F.col("__next.text")))
    out = with_signature(out, "edited_text", "edited_sig", k, l, m)
    return out.select(
        "doc_id", "text", "edited_text", "sig", "edited_sig",
        likeness(F.col("sig"), F.col("edited_sig"), m).alias("near_edited"),
        likeness(F.col("sig"), F.col("__next.sig"), m).alias("near_next"),
    )
