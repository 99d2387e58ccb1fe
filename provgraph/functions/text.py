"""Text normalisation as Column expressions (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Any whitespace, Unicode included (Java regex class content).
WS = r"\p{IsWhite_Space}\x1c-\x1f"
#: A decimal number in ASCII: sign, point and exponent allowed.
NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
#: The same, at least 0: no minus sign unless every digit of the mantissa is 0.
NUMBER_NOT_NEGATIVE = (
    r"(?:\+?(?:[0-9]+\.?[0-9]*|\.[0-9]+)|-(?:0+\.?0*|\.0+))(?:[eE][+-]?[0-9]+)?"
)


def squeeze(c: Column) -> Column:
    """Trimmed, with inner runs of whitespace turned into one blank. Null stays null."""
    return F.trim(F.regexp_replace(c, f"[{WS}]+", " "))


def is_blank(c: Column) -> Column:
    """True for null and for text of whitespace only."""
    return F.coalesce(squeeze(c) == "", F.lit(True))


def key(c: Column) -> Column:
    """A key for comparing: squeezed, lower case; null if blank."""
    k = F.lower(squeeze(c))
    return F.when(k != "", k)


def number_key(c: Column) -> Column:
    """A key for comparing padded numbers: as `key`, without leading zeros (one digit stays)."""
    return F.regexp_replace(key(c), r"^0+(?=.)", "")


def name_key(c: Column) -> Column:
    """Letters and digits only, lower case: for names written in camel, snake or spaced style."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{Nd}]", "")


def to_number(c: Column) -> Column:
    """The double in a text by the NUMBER grammar, blanks around it allowed; null otherwise.

    Spark's own cast would also take 'NaN', 'Infinity' and '1d'.
    """
    t = squeeze(c)
    return F.when(t.rlike(rf"\A{NUMBER}\z"), t.try_cast("double"))
