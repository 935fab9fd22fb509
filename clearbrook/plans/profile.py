"""Measurements as profiles of columns and of the whole table."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import DATE_FORMATS, VALUE_PATTERNS, is_missing, matches
from ..functions.patterns import fits_format
from ..models import ColumnProfile, DatasetProfile
from . import metrics as M

#: Values that patterns are looked for in, and share of them above which one counts.
PATTERN_ROWS = 1_000
PATTERN_SHARE, DATE_SHARE = 0.5, 0.7
SAMPLES = 5


def first_values(df: DataFrame, rows: int = PATTERN_ROWS, whole: set[str] | None = None) -> DataFrame:
    """(column, value, place): up to ``rows`` non-missing values of every column, as text, in the order of the input.
    Columns in ``whole`` have no missing value: the table's first rows serve them all at once."""
    schema = df.schema

    def text(c: str) -> Column:
        return F.to_json(F.array(F.col(f"`{c}`"))) if M.kind_of(schema[c].dataType) == "nested" else F.col(f"`{c}`").cast("string")

    parts = []
    full = [c for c in df.columns if whole and c in whole]
    if full:
        pairs = F.array(*[F.struct(F.lit(c).alias("column"), text(c).alias("value")) for c in full])
        head = df.select(*[f"`{c}`" for c in full]).limit(rows).withColumn("_place", F.monotonically_increasing_id())
        parts.append(head.select(F.explode(pairs).alias("p"), "_place").select("p.column", "p.value", F.col("_place").alias("place")))
    for c in df.columns:
        if c not in full:
            some = df.filter(~is_missing(F.col(f"`{c}`"), schema[c].dataType)).select(F.lit(c).alias("column"), text(c).alias("value")).limit(rows)
            parts.append(some.withColumn("place", F.monotonically_increasing_id()))
    return reduce(DataFrame.unionAll, parts)


def detect_patterns(values: DataFrame, samples: bool = False) -> DataFrame:
    """One row per column of (column, value): n, a share for each value pattern, and date0, date1, ..., one for each date
    format in its order of trial; with samples the first values too."""
    hits = [F.avg(matches(F.col("value"), p).cast("int")).alias(k) for k, p in VALUE_PATTERNS.items()]
    dates = [F.avg(fits_format(F.col("value"), java).cast("int")).alias(f"date{i}") for i, java in enumerate(DATE_FORMATS.values())]
    # the values are few: at most PATTERN_ROWS of a column
    first = [F.slice(F.sort_array(F.collect_list(F.struct("place", "value"))), 1, SAMPLES).alias("samples")] if samples else []
    return values.groupBy("column").agg(F.count("*").alias("n"), *hits, *dates, *first)


def _patterns(row: Any) -> dict[str, dict[str, Any]]:
    found = {k: {"match_ratio": round(row[k], 3), "pattern": p} for k, p in VALUE_PATTERNS.items() if row[k] > PATTERN_SHARE}
    if not found:
        for i, py in enumerate(DATE_FORMATS):
            if row[f"date{i}"] > DATE_SHARE:
                return {"date": {"match_ratio": round(row[f"date{i}"], 3), "format": py}}
    return found


def profile(df: DataFrame, approximate: bool = False, measured: tuple[int, dict] | None = None) -> DatasetProfile:
    """The table's profile.  approximate: sketches instead of exact quartiles and distinct counts."""
    rows, by = measured or M.measure(df, approximate)
    out = DatasetProfile(row_count=rows, column_count=len(df.columns), memory_bytes=int(sum(m["bytes"] or 0 for m in by.values())))
    if not df.columns or not rows:
        out.columns = {c: ColumnProfile(c, M.dtype_label(df.schema[c].dataType), M.kind_of(df.schema[c].dataType)) for c in df.columns}
        return out
    out.duplicate_row_count = M.duplicate_rows(df)
    kinds = {c: M.kind_of(df.schema[c].dataType) for c in df.columns}
    other = [c for c in df.columns if kinds[c] != "numeric"]
    top: dict[str, dict[str, int]] = {}
    for names in M.batches(other):
        for r in sorted(M.value_counts(df, names).collect(), key=lambda r: r["rank"]):
            top.setdefault(r["column"], {})[r["value"]] = r["n"]
    patterns, samples = {}, {}
    whole = {c for c in df.columns if not by[c]["nulls"]}
    for names in M.batches(df.columns):
        values = first_values(df.select(*[f"`{c}`" for c in names]), whole=whole)
        for r in detect_patterns(values, samples=True).collect():
            patterns[r["column"]], samples[r["column"]] = _patterns(r), [x["value"] for x in r["samples"]]
    for c in df.columns:
        m = by[c]
        p = ColumnProfile(c, M.dtype_label(df.schema[c].dataType), kinds[c])
        p.null_count, p.null_ratio = m["nulls"], round(m["nulls"] / rows, 4)
        p.unique_count, p.unique_ratio = m["distinct"], round(m["distinct"] / rows, 4)
        p.sample_values, p.patterns = samples.get(c, []), patterns.get(c, {})
        if m["filled"] and kinds[c] == "numeric":
            q = m["quartiles"]
            p.statistics = {"mean": m["mean"], "median": q[1], "std": m["std"], "min": m["min"], "max": m["max"], "q25": q[0], "q75": q[2], "skewness": m["skewness"], "kurtosis": m["kurtosis"]}
        elif m["filled"]:
            best = top.get(c, {})
            p.statistics = {"top_values": best, "mode": next(iter(best), None), "avg_length": m["avg_length"], "min_length": m["min_length"], "max_length": m["max_length"]}
        out.columns[c] = p
    return out


class Measurements:
    """A table's measurements, taken once when first asked for."""

    def __init__(self, df: DataFrame, approximate: bool = False):
        self.df, self.approximate = df, approximate
        self._held: dict[Any, Any] = {}

    def _once(self, key: Any, make: Any) -> Any:
        if key not in self._held:
            self._held[key] = make()
        return self._held[key]

    @property
    def all(self) -> tuple[int, dict[str, dict[str, Any]]]:
        return self._once("all", lambda: M.measure(self.df, self.approximate))

    def null_mask(self, column: str) -> Any:
        return is_missing(F.col(f"`{column}`"), self.df.schema[column].dataType)

    def unique_count(self, column: str) -> int:
        return self.all[1][column]["distinct"]

    def statistics(self, column: str) -> dict[str, float]:
        m = self.all[1][column]
        if M.kind_of(self.df.schema[column].dataType) != "numeric" or not m["filled"]:
            return {}
        return {"mean": m["mean"], "std": m["std"], "min": m["min"], "max": m["max"], "q1": m["quartiles"][0], "q3": m["quartiles"][2]}

    def value_set(self, column: str, max_values: int = 10_000) -> set[str]:
        """Distinct values as text, at most ``max_values`` of them, in a fixed hashed order."""
        c = F.col(f"`{column}`")
        rows = self.df.filter(~self.null_mask(column)).select(c.cast("string").alias("v")).distinct()
        return self._once((column, max_values), lambda: {r["v"] for r in rows.orderBy(F.xxhash64("v"), "v").limit(max_values).collect()})
