"""Command line: analyze, suggest, clean, codegen."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from . import __version__
from .models import DatasetProfile, Finding, Suggestion, ToolkitError
from .plans.report import Report
from .sources import get_adapter, save


def table(title: str, heads: list[str], rows: list[list[str]]) -> str:
    """A plain-text table."""
    widths = [max(len(str(r[i])) for r in [heads, *rows]) for i in range(len(heads))]
    line = lambda r: "  ".join(str(x).ljust(w) for x, w in zip(r, widths)).rstrip()
    return "\n".join([title, line(heads), line(["-" * w for w in widths]), *map(line, rows)])


def format_profile(p: DatasetProfile) -> str:
    head = f"{p.row_count} rows x {p.column_count} columns | Memory: {p.memory_bytes / 1024 / 1024:.1f} MB | Dupes: {p.duplicate_row_count}"
    rows = [[c.name, c.dtype + (f" [{c.semantic_type}]" if c.semantic_type else ""), f"{c.null_count} ({c.null_ratio:.0%})" if c.null_count else "0", str(c.unique_count), ", ".join(map(str, c.sample_values[:3]))] for c in p.columns.values()]
    return f"{head}\n{table('Column Profiles', ['Column', 'Type', 'Nulls', 'Unique', 'Sample Values'], rows)}"


def format_issues(findings: list[Finding]) -> str:
    rows = [[f.severity.value.upper(), f.detector, f.message, ", ".join(f.columns)] for f in findings]
    return table(f"Issues Found ({len(rows)})", ["Severity", "Detector", "Message", "Columns"], rows) if rows else "No issues detected!"


def format_suggestions(suggestions: list[Suggestion]) -> str:
    rows = [[str(s.id), s.priority.value.upper(), s.action, s.impact, s.rationale] for s in suggestions]
    return table(f"Suggestions ({len(rows)})", ["#", "Priority", "Action", "Impact", "Rationale"], rows) if rows else "No suggestions."


def format_transformation_summary(before: int, after: int, applied: int) -> str:
    return f"Applied {applied} transformation(s)\nRows: {before} -> {after} ({before - after} removed)"


def _ids(text: str) -> list[int]:
    return [int(x) for x in text.replace(" ", "").split(",") if x]


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="clearbrook", description="Profile and clean tables.")
    out.add_argument("--version", action="version", version=__version__)
    sub = out.add_subparsers(dest="command", required=True)
    cases = {"choices": ["general", "ml", "analytics", "export"], "default": "general"}
    a = sub.add_parser("analyze", help="profile and issues")
    s = sub.add_parser("suggest", help="ranked fixes")
    c = sub.add_parser("clean", help="apply fixes and write the table")
    g = sub.add_parser("codegen", help="code that repeats the cleaning")
    for p in (a, s, c, g):
        p.add_argument("file")
        p.add_argument("-u", "--use-case", **cases)
    a.add_argument("--sample", type=int, help="rows to look at in a large table")
    a.add_argument("--verbose", "-v", action="store_true", help="statistics too")
    s.add_argument("-p", "--priority", choices=["high", "medium", "low"])
    s.add_argument("-l", "--limit", type=int, default=20)
    c.add_argument("-o", "--output", required=True)
    c.add_argument("--codegen", help="also write the code here")
    for p in (c, g):
        p.add_argument("--apply", "--ids", "-a", type=_ids, help="ids, separated by commas")
        p.add_argument("--apply-all", action="store_true")
    g.add_argument("-s", "--style", choices=["function", "script"], default="function")
    g.add_argument("-o", "--output")
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return _run(args, spark or SparkSession.builder.getOrCreate())
    except (ToolkitError, KeyError) as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1


def _run(args: argparse.Namespace, spark: SparkSession) -> int:
    if args.command == "clean":
        if not args.apply and not args.apply_all:
            print("Error: give --apply IDS or --apply-all", file=sys.stderr)
            return 1
        get_adapter(Path(args.output).suffix.lstrip("."))  # before the work
    config = {"sample_size": args.sample} if getattr(args, "sample", None) else None
    report = Report(args.file, config, args.use_case, spark=spark)
    if args.command == "analyze":
        print(format_profile(report.profile), format_issues(report.issues), f"Data Quality Score: {report.quality_score}/100", sep="\n\n")
        if args.verbose:
            for c in report.profile.columns.values():
                print(f"{c.name}: {c.statistics} {c.patterns}")
        return 0
    if args.command == "suggest":
        found = [s for s in report.suggestions if not args.priority or s.priority.value == args.priority]
        print(format_suggestions(found[: args.limit]))
        return 0
    chosen = args.apply if args.apply and not args.apply_all else [s.id for s in report.suggestions]
    out = report.apply(chosen)
    if args.command == "codegen":
        code = report.generate_code(args.style) if report.applied else "# No transformations to apply"
        Path(args.output).write_text(code) if args.output else print(code)
        return 0
    save(out, args.output)
    print(format_transformation_summary(report.profile.row_count, out.count(), len(report.applied)))
    print(f"Quality: {report.last_score_before} -> {report.last_score_after}")
    if args.codegen:
        Path(args.codegen).write_text(report.generate_code())
    return 0


if __name__ == "__main__":
    sys.exit(main())
