"""Column measurements in a few passes: one aggregate over all columns, one over frequent values, one over rows.

Only rows of one aggregate per column come to the driver.  Wide tables are measured in batches of columns, which keeps
plans and generated code small.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import BOOLEAN_TOKENS, DATE_FAMILIES, is_lower, is_missing, is_title, is_upper, lstrip, matches, parse_number, rstrip, strip

#: Columns that one aggregate measures.
BATCH = 40
#: Relative error of the quartiles when they are approximated is 1 / ACCURACY.
ACCURACY = 10_000


def kind_of(t: T.DataType) -> str:
    """numeric, boolean, string, temporal or nested."""
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, T.NumericType):
        return "numeric"
    if isinstance(t, (T.StringType, T.NullType)):
        return "string"
    if isinstance(t, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)):
        return "nested"
    return "temporal"


def dtype_label(t: T.DataType) -> str:
    """The name that data-frame users know a type by."""
    names = {"tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64", "float": "float32", "double": "float64", "boolean": "bool", "string": "object", "void": "object", "timestamp": "datetime64[ns]", "timestamp_ntz": "datetime64[ns]", "date": "datetime64[ns]"}
    return names.get(t.simpleString(), t.simpleString())


def comparable(c: Column, t: T.DataType) -> Column:
    """A value that can be grouped: maps as text, negative zero as zero."""
    if isinstance(t, T.MapType):
        return F.to_json(c)
    return c + F.lit(0.0).cast(t) if isinstance(t, (T.FloatType, T.DoubleType)) else c


def sample_skewness(c: Column) -> Column:
    """Bias-corrected skewness; 0 for two values or fewer, or for equal values."""
    n = F.count(c)
    return F.when(n > 2, F.coalesce(F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2), F.lit(0.0))).otherwise(0.0)


def sample_kurtosis(c: Column) -> Column:
    """Bias-corrected excess kurtosis; 0 for three values or fewer, or for equal values."""
    n = F.count(c)
    return F.when(n > 3, F.coalesce((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6), F.lit(0.0))).otherwise(0.0)


def quartiles(c: Column, approximate: bool) -> Column:
    at = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    return F.percentile_approx(c, at, F.lit(ACCURACY)) if approximate else F.percentile(c, at)


def column_aggregates(name: str, t: T.DataType, approximate: bool = False) -> dict[str, Column]:
    """Every measurement of a column that needs no other one first."""
    c = F.col(f"`{name}`")
    kind = kind_of(t)
    value = F.when(~is_missing(c, t), c)
    out = {"nulls": F.count_if(is_missing(c, t)), "filled": F.count(value)}
    if approximate:
        out["distinct"] = F.approx_count_distinct(comparable(value, t), 0.01)
    if kind == "numeric":
        d = value.cast("double")
        out |= {"mean": F.avg(d), "std": F.when(F.count(d) > 1, F.stddev_samp(d)).when(F.count(d) == 1, 0.0), "min": F.min(d), "max": F.max(d), "quartiles": quartiles(d, approximate), "skewness": sample_skewness(d), "kurtosis": sample_kurtosis(d)}
        out["bytes"] = F.count("*") * _width(t)
        return out
    text = value.cast("string") if kind != "nested" else F.to_json(F.array(value))
    out |= {"avg_length": F.avg(F.char_length(text)), "min_length": F.min(F.char_length(text)), "max_length": F.max(F.char_length(text))}
    out["bytes"] = F.coalesce(F.sum(F.octet_length(text)), F.lit(0)) if kind in ("string", "nested") else F.count("*") * _width(t)
    if kind == "string":
        word = F.lower(strip(c))
        out |= {
            "blank": F.count_if(strip(c) == ""),
            "padded_left": F.count_if(c != lstrip(c)),
            "padded_right": F.count_if(c != rstrip(c)),
            "upper": F.bool_or(is_upper(c)),
            "lower": F.bool_or(is_lower(c)),
            "title": F.bool_or(is_title(c)),
            "numbers": F.count_if(parse_number(c).isNotNull()),
            "all_boolean": F.bool_and(word.isin(*BOOLEAN_TOKENS)),
            "tokens": F.sort_array(F.collect_set(F.when(word.isin(*BOOLEAN_TOKENS), word))),
        }
        out |= {f"date_{k}": F.count_if(matches(c, p)) for k, p in DATE_FAMILIES.items()}
    return out


def _width(t: T.DataType) -> int:
    return {"tinyint": 1, "smallint": 2, "int": 4, "float": 4, "boolean": 1, "date": 4}.get(t.simpleString(), 8)


def batches(names: list[str]) -> Iterator[list[str]]:
    for i in range(0, len(names), BATCH):
        yield names[i : i + BATCH]


def measure(df: DataFrame, approximate: bool = False) -> tuple[int, dict[str, dict[str, Any]]]:
    """Row count, and all aggregates of every column."""
    rows, out = 0, {}
    if not df.columns:
        return 0, {}
    for names in batches(df.columns):
        aggs = {(n, k): a for n in names for k, a in column_aggregates(n, df.schema[n].dataType, approximate).items()}
        row = df.agg(F.count("*").alias("_n"), *[a.alias(f"a{i}") for i, a in enumerate(aggs.values())]).first()
        rows = row["_n"]
        for i, (n, k) in enumerate(aggs):
            out.setdefault(n, {})[k] = row[f"a{i}"]
        if not approximate:
            found = {r["column"]: r["n"] for r in distinct_counts(df, names).collect()}
            for i, n in enumerate(names):
                out[n]["distinct"] = found.get(i, 0)
    return rows, out


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n): by the column's place, its number of distinct values that aren't missing.  Values are text, whose equality is
    theirs, or for points in time their microseconds."""

    def text(c: str) -> Column:
        t, v = df.schema[c].dataType, F.col(f"`{c}`")
        if kind_of(t) == "nested":
            return F.when(v.isNotNull(), F.to_json(F.array(v)))
        if isinstance(t, T.TimestampType):
            return F.unix_micros(v).cast("string")
        return F.when(~is_missing(v, t), comparable(v, t).cast("string"))

    pairs = F.array(*[F.struct(F.lit(i).alias("column"), text(c).alias("value")) for i, c in enumerate(columns)])
    values = df.select(F.explode(pairs).alias("p")).select("p.*").filter("value is not null").groupBy("column", "value").agg(F.lit(1))
    return values.groupBy("column").agg(F.count("*").alias("n"))


def value_counts(df: DataFrame, columns: list[str], top: int = 10) -> DataFrame:
    """(column, value, n, rank): the most frequent values of each column, ties by value."""
    schema = df.schema
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), (F.to_json(F.array(F.col(f"`{c}`"))) if kind_of(schema[c].dataType) == "nested" else F.when(~is_missing(F.col(f"`{c}`"), schema[c].dataType), F.col(f"`{c}`").cast("string"))).alias("value")) for c in columns])
    counts = df.select(F.explode(pairs).alias("p")).select("p.*").filter("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= top)


def duplicate_rows(df: DataFrame, columns: list[str] | None = None) -> int:
    """Rows that equal an earlier one in all columns; nulls equal each other."""
    keys = columns or df.columns
    if not keys:
        return 0
    same = df.select(*[comparable(F.col(f"`{c}`"), df.schema[c].dataType).alias(f"k{i}") for i, c in enumerate(keys)]).groupBy(*[f"k{i}" for i in range(len(keys))]).agg(F.count("*").alias("_n"))
    return same.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0))).first()[0]


def outlier_fences(m: dict[str, Any], method: str, threshold: float) -> tuple[float, float] | None:
    """Lower and upper fence from a column's measurements; None where there is no spread."""
    if method == "iqr":
        if not m.get("quartiles"):
            return None
        q1, _, q3 = m["quartiles"]
        return None if q3 == q1 else (q1 - threshold * (q3 - q1), q3 + threshold * (q3 - q1))
    if not m.get("std"):
        return None
    return m["mean"] - threshold * m["std"], m["mean"] + threshold * m["std"]


def outlier_counts(df: DataFrame, fences: dict[str, tuple[float, float]]) -> dict[str, int]:
    """How many values of each column lie outside its fences, in one pass for all columns."""
    out = {}
    for names in batches(list(fences)):
        row = df.agg(*[F.count_if(outside(F.col(f"`{n}`"), df.schema[n].dataType, fences[n])).alias(f"a{i}") for i, n in enumerate(names)]).first()
        out |= {n: row[f"a{i}"] for i, n in enumerate(names)}
    return out


def outside(c: Column, t: T.DataType, fences: tuple[float, float]) -> Column:
    d = c.cast("double")
    return F.coalesce(~is_missing(c, t) & ((d < fences[0]) | (d > fences[1])), F.lit(False))
