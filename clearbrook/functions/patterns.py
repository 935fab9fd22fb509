"""Patterns of values and of dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of whole values, in the order in which they are reported; the last that fits names a column.
VALUE_PATTERNS = {
    "email": r"^[\w.+-]+@[\w-]+\.[\w.-]+$",
    "url": r"^https?://[\w\-._~:/?#\[\]@!$&'()*+,;=]+$",
    "phone": r"^[\+]?[(]?[0-9]{1,4}[)]?[-\s./0-9]{6,15}$",
    "ipv4": r"^(?:\d{1,3}\.){3}\d{1,3}$",
    "uuid": r"^(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    "currency": r"^[$€£¥][\s]?[\d,]+\.?\d*$",
    "zip_us": r"^\d{5}(-\d{4})?$",
}

# Date formats in the order of trial, as strftime and as the engine writes them.
DATE_FORMATS = {
    "%Y-%m-%d": "yyyy-M-d",
    "%m/%d/%Y": "M/d/yyyy",
    "%d/%m/%Y": "d/M/yyyy",
    "%Y/%m/%d": "yyyy/M/d",
    "%m-%d-%Y": "M-d-yyyy",
    "%d-%m-%Y": "d-M-yyyy",
    "%Y%m%d": "yyyyMMdd",
    "%b %d, %Y": "MMM d, yyyy",
    "%B %d, %Y": "MMMM d, yyyy",
    "%d %b %Y": "d MMM yyyy",
    "%d %B %Y": "d MMMM yyyy",
    "%Y-%m-%d %H:%M:%S": "yyyy-M-d H:m:s",
    "%m/%d/%Y %H:%M:%S": "M/d/yyyy H:m:s",
}

# Further formats that dates are read by, after those above: the families below in all their spellings.
MORE_FORMATS = ("d-MMM-yyyy", "d-MMMM-yyyy", "MMM d yyyy", "MMMM d yyyy", "M/d/yyyy H:m", "yyyy-M-d H:m")
# Formats of two-digit years, of which 69 and more are of the last century.
SHORT_FORMATS = ("M/d/yy", "d/M/yy", "d-MMM-yy")
#: Points in time with a T or a fraction of a second.
ISO_TIME = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"

# Families of date spellings that a column may mix.
DATE_FAMILIES = {
    "iso": r"^\d{4}-\d{2}-\d{2}",
    "slash_mdy": r"^\d{1,2}/\d{1,2}/\d{2,4}$",
    "dash_dmy": r"^\d{1,2}-[A-Za-z]{3}-\d{2,4}$",
    "named_mdy": r"^[A-Za-z]{3,9}\s+\d{1,2},?\s+\d{4}$",
    "named_dmy": r"^\d{1,2}\s+[A-Za-z]{3,9}\s+\d{4}$",
}

#: strftime directives and what the engine calls them.
_DIRECTIVES = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "b": "MMM", "B": "MMMM", "I": "hh", "p": "a", "j": "DDD", "f": "SSSSSS", "A": "EEEE", "a": "EEE", "%": "%"}


def matches(c: Column, pattern: str) -> Column:
    """Whether a value fits a pattern that is anchored at its start; digits, letters and spaces as in Unicode."""
    return c.rlike(f"(?U){pattern}")


def java_format(strftime: str) -> str:
    """The engine's pattern for a strftime format; other letters are quoted."""
    out, i = [], 0
    while i < len(strftime):
        ch = strftime[i]
        if ch == "%" and i + 1 < len(strftime):
            out.append(_DIRECTIVES.get(strftime[i + 1], strftime[i + 1]))
            i += 2
            continue
        out.append(f"'{ch}'" if ch.isalpha() else "''" if ch == "'" else ch)
        i += 1
    return "".join(out)


def fits_format(c: Column, java: str) -> Column:
    return F.try_to_timestamp(c, F.lit(java)).isNotNull()
