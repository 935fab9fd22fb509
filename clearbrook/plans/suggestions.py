"""Findings to a ranked list of fixes that don't contradict each other, and the order in which to apply them."""

from __future__ import annotations

from typing import Any

from ..models import Finding, Severity, Suggestion

# For each issue its action, transformer, impact, rationale and parameters besides the columns.
FIXES: dict[str, tuple[str, str, str, str, dict[str, Any]]] = {
    "missing_values": ("Handle missing values", "missing", "Removes or fills null values to prevent errors", "Missing values cause errors in ML and analysis", {}),
    "empty_strings": ("Clean empty strings", "missing", "Converts empty strings to proper values", "Empty strings are often unintentional missing values", {"strategy": "clean_empty_strings"}),
    "duplicate_rows": ("Remove duplicate rows", "duplicates", "Removes redundant data that skews analysis", "Exact duplicates inflate counts and bias statistics", {"keep": "first"}),
    "inconsistent_case": ("Standardize text casing", "formats", "Ensures consistent text representation", "Mixed casing causes mismatches in grouping and joins", {"operation": "lowercase"}),
    "inconsistent_date_format": ("Standardize date format", "formats", "Ensures consistent date parsing", "Mixed date formats cause parsing errors", {"operation": "standardize_dates", "target_format": "%Y-%m-%d"}),
    "whitespace_padding": ("Strip whitespace from values", "formats", "Removes accidental padding that causes mismatches", "Leading/trailing whitespace causes silent matching failures", {"operation": "strip_whitespace"}),
    "outliers": ("Review and handle outliers", "missing", "Reduces influence of extreme values on analysis", "Outliers can heavily skew means and model training", {"strategy": "clip_outliers"}),
    "numeric_as_string": ("Convert to numeric type", "types", "Enables numeric operations and reduces memory", "Numeric data stored as strings prevents mathematical operations", {"target_type": "numeric"}),
    "boolean_as_string": ("Convert to boolean type", "types", "Correct type enables boolean operations", "Boolean data as strings wastes memory and prevents logic ops", {"target_type": "boolean"}),
    "similar_columns": ("Review potentially duplicate columns", "columns", "May reduce redundant data", "Similar columns may be duplicated data or candidates for merging", {"operation": "review_merge"}),
}

# How much an issue matters for a use, where it matters more than usual.
BOOSTS: dict[str, dict[str, float]] = {
    "ml": {"duplicate_rows": 1.5, "similar_columns": 1.4, "missing_values": 1.3, "numeric_as_string": 1.3, "boolean_as_string": 1.2, "outliers": 1.2},
    "analytics": {"missing_values": 1.5, "inconsistent_date_format": 1.4, "outliers": 1.3, "inconsistent_case": 1.2},
    "export": {"inconsistent_date_format": 1.5, "whitespace_padding": 1.4, "inconsistent_case": 1.3, "numeric_as_string": 1.3},
    "general": {},
}

# Steps in the order in which they are applied; others come last.
ORDER = (
    "duplicates", "missing.drop_rows",
    "formats.strip_whitespace", "formats.lowercase", "formats.uppercase", "formats.titlecase", "missing.clean_empty_strings",
    "missing.fill_mode", "missing.fill_median", "missing.fill_value", "missing.empty_to_nan",
    "types.boolean", "types.numeric", "formats.standardize_dates",
    "missing.clip_outliers",
    "columns.drop", "columns.rename", "columns.review_merge",
)
LAST = 999
WEIGHTS = {Severity.HIGH: 3, Severity.MEDIUM: 2, Severity.LOW: 1}
#: A column that is converted so needs no change of case.
CONVERSIONS = {"types.boolean", "types.numeric", "formats.standardize_dates"}
CASE_CHANGES = {"formats.lowercase", "formats.uppercase", "formats.titlecase"}


#: What a transformer does when it isn't told.
DEFAULTS = {"missing": "drop_rows", "formats": "strip_whitespace", "types": "numeric", "columns": "drop"}


def step_name(transformer: str, params: dict[str, Any]) -> str:
    """The transformer with what it does, like "missing.fill_mode"."""
    detail = next((params[k] for k in ("strategy", "operation", "target_type") if params.get(k)), DEFAULTS.get(transformer))
    return f"{transformer}.{detail}" if detail else transformer


def execution_order(suggestions: list[Suggestion]) -> list[Suggestion]:
    at = {name: i for i, name in enumerate(ORDER)}
    return sorted(suggestions, key=lambda s: at.get(step_name(s.transformer, s.params), LAST))


def missing_strategy(finding: Finding) -> str:
    if finding.details.get("null_ratio", 0) > 0.5:
        return "drop_rows"
    kind, dtype = finding.details.get("kind"), finding.details.get("dtype", "")
    numeric = kind == "numeric" if kind else any(k in dtype.lower() for k in ("int", "float", "number", "decimal"))
    return "fill_median" if numeric else "fill_mode"


def parameters(finding: Finding) -> dict[str, Any]:
    fixed = FIXES[finding.issue_type][4]
    if finding.issue_type == "duplicate_rows":
        return dict(fixed)
    out = {"columns": list(finding.columns), **fixed}
    if finding.issue_type == "missing_values":
        out["strategy"] = missing_strategy(finding)
    if finding.issue_type == "outliers":
        out |= {"method": finding.details.get("method", "iqr"), "threshold": finding.details.get("threshold", 1.5)}
    return out


def boosted(severity: Severity, boost: float) -> Severity:
    if boost >= 1.4 and severity is Severity.LOW:
        return Severity.MEDIUM
    return Severity.HIGH if boost >= 1.3 and severity is Severity.MEDIUM else severity


def priority_score(s: Suggestion) -> float:
    return 0.5 * WEIGHTS[s.priority] + 0.5 * s.finding.confidence


def without_conflicts(suggestions: list[Suggestion]) -> list[Suggestion]:
    """Leaves out changes of case in columns that another suggestion converts."""
    converted = {c for s in suggestions if step_name(s.transformer, s.params) in CONVERSIONS for c in s.params.get("columns", [])}
    return [s for s in suggestions if step_name(s.transformer, s.params) not in CASE_CHANGES or not converted & set(s.params.get("columns", []))]


def suggest(findings: list[Finding], max_suggestions: int = 50, use_case: str = "general", min_confidence: float = 0.0) -> list[Suggestion]:
    """Ranked fixes, numbered from 1."""
    boosts, out = BOOSTS.get(use_case, {}), []
    for f in findings:
        if f.issue_type not in FIXES or f.confidence < min_confidence:
            continue
        action, transformer, impact, rationale, _ = FIXES[f.issue_type]
        if 1 <= len(f.columns) <= 3:
            action += " in " + ", ".join(f"'{c}'" for c in f.columns)
        out.append(Suggestion(0, f, action, transformer, parameters(f), boosted(f.severity, boosts.get(f.issue_type, 1.0)), impact, rationale))
    out = sorted(without_conflicts(out), key=priority_score, reverse=True)
    for i, s in enumerate(out, 1):
        s.id = i
    return out[:max_suggestions]
