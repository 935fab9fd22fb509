"""Missing values, text and conversions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .patterns import DATE_FORMATS, ISO_TIME, MORE_FORMATS, SHORT_FORMATS

# What counts as a boolean in text.
TRUE_TOKENS = ("true", "yes", "y", "1", "t", "on")
FALSE_TOKENS = ("false", "no", "n", "0", "f", "off")
BOOLEAN_TOKENS = TRUE_TOKENS + FALSE_TOKENS

NUMBER = r"^\s*[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|(?i:inf(?:inity)?))\s*$"


def is_missing(c: Column, kind: T.DataType) -> Column:
    """Null, or not a number in a floating-point column."""
    return c.isNull() | F.isnan(c) if isinstance(kind, (T.FloatType, T.DoubleType)) else c.isNull()


def any_missing(schema: T.StructType, columns: list[str]) -> Column:
    """Whether any of the columns is missing in a row."""
    return reduce(lambda a, b: a | b, [is_missing(F.col(f"`{c}`"), schema[c].dataType) for c in columns], F.lit(False))


def changed(before: Column, after: Column) -> Column:
    return ~before.eqNullSafe(after)


def strip(c: Column) -> Column:
    """Without the white space (Unicode) at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def lstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+$", "")


def title(c: Column) -> Column:
    """A capital at the start of every run of letters, small letters behind it."""
    return F.when(c.isNotNull(), F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), 0), F.initcap), ""))


def is_upper(c: Column) -> Column:
    return (c == F.upper(c)) & (c != F.lower(c))


def is_lower(c: Column) -> Column:
    return (c == F.lower(c)) & (c != F.upper(c))


def is_title(c: Column) -> Column:
    return (c == title(c)) & (F.lower(c) != F.upper(c))


def parse_number(c: Column) -> Column:
    """A double; null for what isn't plainly a number (no digit groups, suffixes or hexadecimal)."""
    word = F.lower(F.trim(c))
    endless = F.when(word.rlike(r"^\+?inf"), F.lit(float("inf"))).when(word.rlike("^-inf"), F.lit(float("-inf")))
    return F.when(c.rlike(NUMBER), F.coalesce(endless, strip(c).try_cast("double")))


def to_boolean(c: Column) -> Column:
    """true or false for the known words, whatever their case and padding; null for others."""
    word = F.lower(strip(c))
    return F.when(word.isin(*TRUE_TOKENS), F.lit(True)).when(word.isin(*FALSE_TOKENS), F.lit(False))


def parse_date(c: Column) -> Column:
    """The timestamp by the first of the known formats that fits; null if none does."""
    tries = [F.try_to_timestamp(c, F.lit(java)) for java in (*DATE_FORMATS.values(), *MORE_FORMATS)]
    tries.append(F.when(c.rlike(ISO_TIME), c.try_cast("timestamp")))
    for java in SHORT_FORMATS:
        t = F.try_to_timestamp(c, F.lit(java))
        tries.append(F.when(F.year(t) >= 2069, t - F.make_interval(F.lit(100))).otherwise(t))
    return F.coalesce(*tries)


def clip(c: Column, low: Column, high: Column) -> Column:
    """Within [low, high]; missing stays missing."""
    return F.when(c < low, low).when((c > high) & ~F.isnan(c), high).otherwise(c)
