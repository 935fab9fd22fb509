"""Detectors: measurements in, findings out."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import DATE_FAMILIES
from ..models import DatasetProfile, DetectorConfig, Finding, Severity
from . import metrics as M
from .similarity import similar_columns

log = logging.getLogger(__name__)
#: Offending rows that a finding names.
MOST_ROWS = 100
LEAST_VALUES = {"case": 5, "outliers": 10}


@dataclass
class Context:
    """What a detector may look at."""

    df: DataFrame
    profile: DatasetProfile
    measured: dict[str, dict[str, Any]]
    config: DetectorConfig = field(default_factory=DetectorConfig)

    def of_kind(self, kind: str) -> list[str]:
        return [c for c, p in self.profile.columns.items() if p.kind == kind]


Detector = Callable[[Context], list[Finding]]
_detectors: dict[str, Detector] = {}


def register_detector(name: str, detector: Detector) -> None:
    _detectors[name] = detector


def get_detector(name: str) -> Detector:
    if name not in _detectors:
        raise KeyError(f"Unknown detector: {name}")
    return _detectors[name]


def run_detectors(context: Context) -> list[Finding]:
    """All enabled detectors in the order of their registration; one that fails is logged and left out."""
    out = []
    for name, detector in _detectors.items():
        if name not in context.config.enabled:
            continue
        try:
            out += detector(context)
        except Exception:
            log.exception("detector %s failed", name)
    return out


def by_share(share: float, high: float, medium: float) -> Severity:
    return Severity.HIGH if share > high else Severity.MEDIUM if share > medium else Severity.LOW


def duplicates(x: Context) -> list[Finding]:
    n, rows = x.profile.duplicate_row_count, x.profile.row_count
    if not n:
        return []
    share = n / rows
    where = _duplicate_ids(x.df) if x.config.locate_rows else None
    return [Finding("duplicates", "duplicate_rows", by_share(share, 0.1, 0.01), list(x.df.columns), {"duplicate_count": n, "duplicate_ratio": round(share, 4)}, f"Found {n} exact duplicate rows ({share:.1%} of data)", 1.0, where)]


def _duplicate_ids(df: DataFrame) -> list[int]:
    keys = [M.comparable(F.col(f"`{c}`"), df.schema[c].dataType) for c in df.columns]
    marked = df.withColumn("_row_id", F.monotonically_increasing_id())
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy("_row_id"))
    return [r[0] for r in marked.withColumn("_turn", turn).filter("_turn > 1").select("_row_id").orderBy("_row_id").limit(MOST_ROWS).collect()]


def formats(x: Context) -> list[Finding]:
    out = []
    for c in x.of_kind("string"):
        m = x.measured[c]
        if not m["filled"]:
            continue
        cases = {f"has_{k}": bool(m[k]) for k in ("upper", "lower", "title")}
        if m["filled"] >= LEAST_VALUES["case"] and sum(cases.values()) >= 2:
            out.append(Finding("formats", "inconsistent_case", Severity.LOW, [c], cases, f"Column '{c}' has inconsistent casing (mixed upper/lower/title case)", 0.8))
        counts = {k: m[f"date_{k}"] for k in DATE_FAMILIES if m[f"date_{k}"]}
        total = sum(counts.values())
        if len(counts) >= 2 and total / m["filled"] >= 0.5:
            out.append(Finding("formats", "inconsistent_date_format", Severity.MEDIUM, [c], {"format_counts": counts, "total_matched": total}, f"Column '{c}' has mixed date formats ({', '.join(f'{n} {k}' for k, n in counts.items())})", 0.85))
        left, right = m["padded_left"], m["padded_right"]
        if left + right:
            out.append(Finding("formats", "whitespace_padding", Severity.LOW, [c], {"leading_spaces": left, "trailing_spaces": right}, f"Column '{c}' has {left + right} values with leading/trailing whitespace", 1.0))
    return out


def missing(x: Context) -> list[Finding]:
    out, rows = [], x.profile.row_count
    for c, p in x.profile.columns.items():
        if p.null_count:
            share = p.null_count / rows
            out.append(Finding("missing", "missing_values", by_share(share, 0.5, 0.1), [c], {"null_count": p.null_count, "null_ratio": p.null_ratio, "dtype": p.dtype, "kind": p.kind}, f"Column '{c}' has {p.null_count} missing values ({p.null_ratio:.1%})", 1.0))
    for c in x.of_kind("string"):
        n = x.measured[c]["blank"]
        if n:
            out.append(Finding("missing", "empty_strings", Severity.MEDIUM, [c], {"empty_string_count": n}, f"Column '{c}' has {n} empty strings that may represent missing values", 0.9))
    return out


def outliers(x: Context) -> list[Finding]:
    method, threshold = x.config.outlier_method, x.config.outlier_threshold
    fences = {c: f for c in x.of_kind("numeric") if x.measured[c]["filled"] >= LEAST_VALUES["outliers"] and (f := M.outlier_fences(x.measured[c], method, threshold))}
    counts = M.outlier_counts(x.df, fences) if fences else {}
    where = _outlier_ids(x.df, {c: fences[c] for c, n in counts.items() if n}) if x.config.locate_rows and any(counts.values()) else {}
    out = []
    for c, n in counts.items():
        if n:
            share = n / x.measured[c]["filled"]
            out.append(Finding("outliers", "outliers", by_share(share, 0.05, 0.01), [c], {"outlier_count": n, "outlier_ratio": round(share, 4), "method": method, "threshold": threshold}, f"Column '{c}' has {n} outliers ({share:.1%}) detected by {method.upper()}", 0.85, where.get(c)))
    return out


def _outlier_ids(df: DataFrame, fences: dict[str, tuple[float, float]]) -> dict[str, list[int]]:
    marked = df.withColumn("_row_id", F.monotonically_increasing_id())
    parts = [marked.filter(M.outside(F.col(f"`{c}`"), df.schema[c].dataType, f)).select(F.lit(c).alias("c"), "_row_id").orderBy("_row_id").limit(MOST_ROWS) for c, f in fences.items()]
    out: dict[str, list[int]] = {}
    for r in reduce(DataFrame.unionAll, parts).collect():
        out.setdefault(r["c"], []).append(r["_row_id"])
    return {c: sorted(ids) for c, ids in out.items()}


def similarity(x: Context) -> list[Finding]:
    found = similar_columns(x.df, {c: m["distinct"] for c, m in x.measured.items()})
    return [Finding("similarity", "similar_columns", Severity.MEDIUM if score > 0.8 else Severity.LOW, [a, b], {"name_similarity": round(s, 3), "value_similarity": round(v, 3), "combined_score": round(score, 3)}, f"Columns '{a}' and '{b}' appear similar (name: {s:.0%}, values: {v:.0%})", score) for a, b, s, v, score in found]


def types(x: Context) -> list[Finding]:
    out = []
    for c in x.of_kind("string"):
        m = x.measured[c]
        if not m["filled"]:
            continue
        share = m["numbers"] / m["filled"]
        if share > 0.8:
            out.append(Finding("types", "numeric_as_string", Severity.MEDIUM, [c], {"numeric_ratio": round(share, 3)}, f"Column '{c}' appears numeric but stored as string ({share:.0%} parseable)", share))
        if m["all_boolean"] and len(m["tokens"]) >= 2:
            out.append(Finding("types", "boolean_as_string", Severity.LOW, [c], {"values": list(m["tokens"])}, f"Column '{c}' contains boolean-like values stored as strings", 0.95))
        for name in x.profile.columns[c].patterns:
            x.profile.columns[c].semantic_type = name
    return out


for _name, _detector in (("duplicates", duplicates), ("formats", formats), ("missing", missing), ("outliers", outliers), ("similarity", similarity), ("types", types)):
    register_detector(_name, _detector)
