"""Line-first document cleaning (DataFrame expressions only).

Rules look at one line at a time and remove it; a document goes only when too much of it was
removed, or when its whole-text statistics fail. All counting stays inside the row: there is no
shuffle, so cost is linear in the text and a hot source or a group of copies has no effect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, words

#: Fixed phrases of page furniture in English, German, French and Spanish, matched in any case as whole words.
BOILERPLATE = (
    "accept all cookies",
    "all rights reserved",
    "click here",
    "cookie policy",
    "enable javascript",
    "follow us on",
    "log in to",
    "lorem ipsum",
    "privacy policy",
    "read more",
    "share this",
    "sign in",
    "sign up",
    "skip to content",
    "subscribe to",
    "terms of service",
    "terms of use",
    "alle cookies akzeptieren",
    "alle rechte vorbehalten",
    "datenschutzerklärung",
    "folgen sie uns",
    "hier klicken",
    "jetzt anmelden",
    "newsletter abonnieren",
    "nutzungsbedingungen",
    "weiterlesen",
    "zum inhalt springen",
    "accepter tous les cookies",
    "aller au contenu",
    "cliquez ici",
    "conditions d'utilisation",
    "lire la suite",
    "politique de confidentialité",
    "se connecter",
    "suivez-nous",
    "tous droits réservés",
    "aceptar todas las cookies",
    "condiciones de uso",
    "haga clic aquí",
    "iniciar sesión",
    "leer más",
    "política de privacidad",
    "saltar al contenido",
    "síguenos",
    "todos los derechos reservados",
)
#: Up to this many words a line with such a phrase is page furniture; longer ones are prose, unless phrases make up half.
BOILERPLATE_WORDS = 12
#: A phrase with what stands around it; without flags, since engines spell those differently.
PHRASE = r"(?:^|[^\p{L}])(?:" + "|".join(BOILERPLATE) + r")(?:[^\p{L}]|$)"
#: What a sentence may end with, closing quotes and brackets included.
TERMINAL = r"[.!?:;…。！？\"'”’»)\]]\s*$"
#: Marks that separate the entries of a menu or a breadcrumb trail.
NAVIGATION = r"[|›»•>]"


def measured(line):
    """A line with what the rules count in it, each counted once."""
    count = lambda pattern: F.regexp_count(line, F.lit(pattern))
    return F.struct(line.alias("line"), count(WORD).alias("n"), count(NAVIGATION).alias("marks"), count(r"[#*$%&|<>]").alias("symbols"), count(r"!!+").alias("shouts"))


def boilerplate(m, most_words: int):
    """Whether a phrase stands in a measured line that is short or half made up of phrases."""
    phrase = "(?iu)" + PHRASE
    rest = F.length(F.regexp_replace(m["line"], phrase, ""))
    return m["line"].rlike(phrase) & ((m["n"] <= most_words) | (rest * 2 <= F.length(m["line"])))


def line_fails(m, short_words: int, max_symbol_share: float, boilerplate_words: int = BOILERPLATE_WORDS):
    """Whether a measured line is furniture rather than prose: navigation, boilerplate, or neither a sentence nor long."""
    return (
        ((m["marks"] >= 3) & (m["marks"] * 5 >= m["n"]))
        | (m["symbols"] > F.lit(max_symbol_share) * F.length(m["line"]))
        | (m["shouts"] * 2 > m["n"])
        | ((m["n"] < short_words) & ~m["line"].rlike(TERMINAL))
        | boilerplate(m, boilerplate_words)
    )


def quality_rules(
    docs: DataFrame,
    min_words: int = 50,
    max_repeat_percent: int = 50,
    short_words: int = 8,
    max_symbol_share: float = 0.1,
    min_kept_share: float = 0.5,
    boilerplate_words: int = BOILERPLATE_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Count, clean by line and judge every document.

    Adds ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (long), ``base_failed``,
    ``kept`` and ``clean_text`` (the lines that pass, in order) to the columns of ``docs``; columns of
    these names that come with ``docs`` are replaced. A null text counts as having no words: it
    fails and its ``clean_text`` is empty. A boilerplate phrase removes lines of up to ``boilerplate_words``
    words and lines that such phrases make up half of. Equal rows get equal results and stay separate
    rows; an empty table gives none. A text is held whole.

    Repeated 3-word windows are found by sorting 64-bit window hashes with their position packed in
    the low bits; windows that meet there are compared once more by their words, so counts are exact.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    drop = [c for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_text") if c in docs.columns]
    df = docs.drop(*drop).withColumn("__w", words(F.col(text_col))).withColumn("__lines", F.split(text, "\n"))
    df = df.withColumn("__n", F.size("__w"))
    df = df.withColumn("__b", F.expr("length(bin(__n))"))
    df = df.withColumn(
        "__s",
        F.expr("""if(__n < 3, cast(array() as array<bigint>), sort_array(transform(sequence(0, __n - 3),
            i -> shiftleft(shiftright(xxhash64(__w[i], __w[i + 1], __w[i + 2]), __b), __b) | cast(i as bigint))))"""),
    )
    df = df.withColumn(
        "__f",
        F.expr("""filter(__s, (x, k) -> (k > 0 and shiftright(__s[k - 1], __b) = shiftright(x, __b))
            or (k + 1 < size(__s) and shiftright(__s[k + 1], __b) = shiftright(x, __b)))"""),
    )
    df = df.withColumn(
        "__g",
        F.expr("""sort_array(transform(__f, x -> cast(x & (shiftleft(1L, __b) - 1) as int))) """),
    )
    df = df.withColumn("__g", F.expr("sort_array(transform(__g, i -> struct(concat_ws(' ', __w[i], __w[i + 1], __w[i + 2]) as g, i as i)))"))
    df = df.withColumn(
        "__p",
        F.expr("""sort_array(transform(filter(__g, (x, k) -> (k > 0 and __g[k - 1].g = x.g) or (k + 1 < size(__g) and __g[k + 1].g = x.g)), x -> x.i))"""),
    )
    spoken = F.filter("__lines", lambda x: x.rlike(WORD))
    df = (
        df.withColumn("n_words", F.col("__n").cast("long"))
        .withColumn("word_chars", F.expr("aggregate(__w, 0L, (a, x) -> a + length(x))"))
        .withColumn("n_symbols", F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"))
        .withColumn("__spoken", spoken)
        .withColumn("n_dup_lines", F.expr("cast(size(__spoken) - size(array_distinct(__spoken)) as bigint)"))
        .withColumn("n_repeat_words", F.expr("aggregate(transform(__p, (x, k) -> if(k + 1 < size(__p), least(3, __p[k + 1] - x), 3)), 0L, (a, x) -> a + x)"))
        .withColumn("base_failed", (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent))
        .withColumn("__keep", F.transform(F.filter(F.transform("__lines", measured), lambda m: ~line_fails(m, short_words, max_symbol_share, boilerplate_words)), lambda m: m["line"]))
        .withColumn("clean_text", F.array_join("__keep", "\n"))
        .withColumn("__left", F.expr("aggregate(__keep, 0L, (a, x) -> a + length(x))"))
        .withColumn("__all", F.expr("aggregate(__lines, 0L, (a, x) -> a + length(x))"))
        .withColumn("kept", ~F.col("base_failed") & (F.col("__left") >= F.lit(min_kept_share) * F.col("__all")))
    )
    # a generator keeps later filters on the results from being pushed down into these expressions
    results = F.struct("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_text")
    return df.select(*[F.col(f"`{c}`") for c in docs.columns if c not in drop], F.inline(F.array(results)))
