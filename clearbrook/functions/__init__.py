"""Column expressions; none of them runs Python on the executors."""

from .expressions import (
    BOOLEAN_TOKENS,
    FALSE_TOKENS,
    TRUE_TOKENS,
    any_missing,
    changed,
    clip,
    is_lower,
    is_missing,
    is_title,
    is_upper,
    lstrip,
    parse_date,
    parse_number,
    rstrip,
    strip,
    title,
    to_boolean,
)
from .patterns import DATE_FAMILIES, DATE_FORMATS, VALUE_PATTERNS, java_format, matches

__all__ = [
    "BOOLEAN_TOKENS", "DATE_FAMILIES", "DATE_FORMATS", "FALSE_TOKENS", "TRUE_TOKENS", "VALUE_PATTERNS", "any_missing", "changed", "clip", "is_lower",
    "is_missing", "is_title", "is_upper", "java_format", "lstrip", "matches", "parse_date", "parse_number", "rstrip", "strip", "title", "to_boolean",
]
