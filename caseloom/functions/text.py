"""Text functions that the formats need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters and their XML entities, in the order of replacement.
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"))

#: White space of the delimited format (no-break and ideographic spaces and the byte order mark too, but not U+0085).
WHITE = "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def xml_escape(x: Column) -> Column:
    """XML-safe text; null gives the empty string."""
    out = F.coalesce(x.cast("string"), F.lit(""))
    for char, entity in ENTITIES:
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def xml_escaped(x) -> str:
    """The same on the driver."""
    out = "" if x is None else str(x)
    for char, entity in ENTITIES:
        out = out.replace(char, entity)
    return out


def trimmed(x: Column) -> Column:
    """Without any white space at both ends, not only spaces."""
    return F.btrim(x, F.lit(WHITE))


def half_up(x: float) -> int:
    """Nearest integer, halves upwards."""
    import math

    return math.floor(x + 0.5)
