"""Transformations of a table, and the PySpark code that repeats each.

A transformation gives a lazy DataFrame, a column expression that counts the rows it affects (where one pass can), and
code.  Medians, modes and fences are taken by one small aggregate over all the columns of a step.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import DATE_FORMATS, any_missing, changed, clip, is_missing, java_format, parse_date, parse_number, strip, title, to_boolean
from ..functions.expressions import NUMBER
from ..functions.patterns import ISO_TIME, MORE_FORMATS, SHORT_FORMATS
from ..models import TransformationResult
from ..plans.metrics import comparable, kind_of, outlier_fences


@dataclass
class Step:
    """What a transformation made: the table, rows it affected (a number, a count over the table it was given, or a
    function that counts), the columns, and its code."""

    df: DataFrame
    affected: int | Column | Callable[[], int]
    columns: list[str]
    code: str


#: Code that strips white space, and that reads a date, of the column {q}.
STRIPPED = "F.regexp_replace(F.col({q!r}).cast('string'), r'(?U)^\\s+|\\s+$', '')"
_TIMES = [*DATE_FORMATS.values(), *MORE_FORMATS]
DATE_CODE = (
    f"F.coalesce(*[F.try_to_timestamp({{q!r}}, F.lit(p)) for p in {_TIMES!r}], F.when(F.col({{q!r}}).rlike({ISO_TIME.replace('{', '{{').replace('}', '}}')!r}), F.col({{q!r}}).try_cast('timestamp')), "
    f"*[F.when(F.year(t) >= 2069, t - F.make_interval(F.lit(100))).otherwise(t) for t in [F.try_to_timestamp({{q!r}}, F.lit(p)) for p in {list(SHORT_FORMATS)!r}]])"
)

Transformer = Callable[..., Step]
_transformers: dict[str, Transformer] = {}


def register_transformer(name: str, transformer: Transformer) -> None:
    _transformers[name] = transformer


def get_transformer(name: str) -> Transformer:
    if name not in _transformers:
        raise KeyError(f"Unknown transformer: {name}. Available: {', '.join(sorted(_transformers))}")
    return _transformers[name]


def transform(name: str, df: DataFrame, **params: Any) -> DataFrame:
    """The transformed table, with nothing counted."""
    return get_transformer(name)(df, **params).df


def run_transformer(name: str, df: DataFrame, **params: Any) -> tuple[DataFrame, TransformationResult]:
    """The transformed table, and what was done; the affected rows are counted in one pass."""
    step = get_transformer(name)(df, **params)
    n = step.affected
    if callable(n) and not isinstance(n, Column):
        n = n()
    if isinstance(n, Column):
        n = df.agg(F.coalesce(n, F.lit(0)).alias("n")).first()["n"]
    return step.df, TransformationResult(name, params, int(n), step.columns, step.code)


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def _total(flags: list[Column]) -> Column:
    """Count of true flags over all columns and rows."""
    return reduce(lambda a, b: a + b, [F.count_if(f) for f in flags], F.lit(0).cast("long"))


def _present(df: DataFrame, columns: list[str] | None) -> list[str]:
    return [c for c in columns or [] if c in df.columns]


def _known(df: DataFrame, columns: list[str] | None) -> list[str]:
    for c in columns or []:
        if c not in df.columns:
            raise KeyError(c)
    return list(columns or [])


# --- missing values and outliers ----------------------------------------------------------------------------------


def medians(df: DataFrame, columns: list[str], approximate: bool = False) -> dict[str, float]:
    if not columns:
        return {}
    at = (lambda c: F.percentile_approx(c, F.lit(0.5), F.lit(10_000))) if approximate else F.median
    row = df.agg(*[at(F.when(~is_missing(_col(c), df.schema[c].dataType), _col(c).cast("double"))).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    return {c: row[i] for i, c in enumerate(columns)}


def modes(df: DataFrame, columns: list[str]) -> dict[str, Any]:
    """The most frequent value of each column, the smallest of equally frequent ones: values are counted where they are
    before any is shuffled, and no task holds them all."""
    out = {}
    for c in columns:
        held = df.filter(~is_missing(_col(c), df.schema[c].dataType)).groupBy(_col(c).alias("v")).agg(F.count("*").alias("n"))
        top = held.orderBy(F.desc("n"), "v").limit(1).collect()
        out[c] = top[0]["v"] if top else None
    return out


def fences(df: DataFrame, columns: list[str], method: str, threshold: float, approximate: bool = False) -> dict[str, tuple[float, float]]:
    """Lower and upper fence of each column; an even column is clipped to its quartiles or mean."""
    aggs = []
    for i, c in enumerate(columns):
        d = F.when(~is_missing(_col(c), df.schema[c].dataType), _col(c).cast("double"))
        at = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
        q = F.percentile_approx(d, at, F.lit(10_000)) if approximate else F.percentile(d, at)
        aggs += [q.alias(f"q{i}"), F.avg(d).alias(f"m{i}"), F.stddev_samp(d).alias(f"s{i}")]
    row = df.agg(*aggs).first() if aggs else {}
    out = {}
    for i, c in enumerate(columns):
        m = {"quartiles": row[f"q{i}"], "mean": row[f"m{i}"], "std": row[f"s{i}"]}
        if m["mean"] is None or method != "iqr" and m["std"] is None:
            continue
        flat = (m["quartiles"][0], m["quartiles"][2]) if method == "iqr" else (m["mean"], m["mean"])
        out[c] = outlier_fences(m, method, threshold) or flat
    return out


def _fill(df: DataFrame, values: dict[str, Any]) -> DataFrame:
    made = {}
    for c, v in values.items():
        if v is None:
            continue
        t = df.schema[c].dataType
        missing = is_missing(_col(c), t)
        if isinstance(v, float) and kind_of(t) == "numeric" and not isinstance(t, (T.FloatType, T.DoubleType)):
            made[c] = F.when(missing, F.lit(v)).otherwise(_col(c).cast("double"))
        else:
            made[c] = F.when(missing, F.lit(v)).otherwise(_col(c))
    return df.withColumns(made) if made else df


def _masks(df: DataFrame, columns: list[str]) -> list[Column]:
    return [is_missing(_col(c), df.schema[c].dataType) for c in columns]


def missing(df: DataFrame, columns: list[str] | None = None, strategy: str = "drop_rows", fill_value: Any = "", fill_strategy: str = "mode", method: str = "iqr", threshold: float = 1.5, approximate: bool = False) -> Step:
    """drop_rows, fill_median, fill_mode, fill_value, empty_to_nan, clean_empty_strings or clip_outliers."""
    if strategy == "drop_rows":
        columns = _known(df, columns) or df.columns
        gone = any_missing(df.schema, columns)
        return Step(df.filter(~gone), F.count_if(gone), columns, f"df = df.na.drop('any', subset={columns!r})")
    columns = _known(df, columns)
    numeric = [c for c in columns if kind_of(df.schema[c].dataType) == "numeric"]
    if strategy == "fill_median":
        got = medians(df, numeric, approximate)
        code = [f"df = df.withColumn({c!r}, F.coalesce({_number(c)}, F.lit(df.agg(F.median({_number(c)})).first()[0])))" for c in numeric]
        return Step(_fill(df, got), _total(_masks(df, [c for c in numeric if got[c] is not None])), columns, "\n".join(code))
    if strategy == "fill_mode":
        got = modes(df, columns)
        return Step(_fill(df, got), _total(_masks(df, [c for c in columns if got[c] is not None])), columns, "\n".join(_mode_code(c) for c in columns))
    if strategy == "fill_value":
        made = _fill(df, {c: fill_value for c in columns})
        return Step(made, _total(_masks(df, columns)), columns, "\n".join(f"df = df.withColumn({c!r}, F.coalesce(F.col({'`' + c + '`'!r}), F.lit({fill_value!r})))" for c in columns))
    if strategy == "empty_to_nan":
        text = [c for c in columns if kind_of(df.schema[c].dataType) == "string"]
        made = df.withColumns({c: F.nullif(_col(c), F.lit("")) for c in text}) if text else df
        return Step(made, _total([_col(c) == "" for c in text]), columns, "\n".join(f"df = df.withColumn({c!r}, F.nullif(F.col({'`' + c + '`'!r}), F.lit('')))" for c in text))
    if strategy == "clean_empty_strings":
        text = [c for c in columns if kind_of(df.schema[c].dataType) == "string"]
        blanked = df.withColumns({c: F.when(strip(_col(c)) != "", _col(c)) for c in text}) if text else df
        got = medians(blanked, numeric, approximate) if fill_strategy == "median" else {c: fill_value for c in columns} if fill_strategy == "value" else modes(blanked, columns)
        code = [f"df = df.withColumn({c!r}, F.when(F.regexp_replace({'`' + c + '`'!r}, r'(?U)^\\s+|\\s+$', '') != '', F.col({'`' + c + '`'!r})))" for c in text]
        code += [_mode_code(c) if fill_strategy == "mode" else f"df = df.withColumn({c!r}, F.coalesce(F.col({'`' + c + '`'!r}), F.lit({got.get(c)!r})))" for c in columns if fill_strategy == "mode" or got.get(c) is not None]
        gone = [is_missing(_col(c), df.schema[c].dataType) | F.coalesce(strip(_col(c)) == "", F.lit(False)) if c in text else is_missing(_col(c), df.schema[c].dataType) for c in columns]
        return Step(_fill(blanked, got), _total(gone), columns, "\n".join(code))
    if strategy == "clip_outliers":
        got = fences(df, numeric, method, threshold, approximate)
        made = df.withColumns({c: clip(_col(c).cast("double"), F.lit(lo), F.lit(hi)) for c, (lo, hi) in got.items()}) if got else df
        out = [F.coalesce(~is_missing(_col(c), df.schema[c].dataType) & ((_col(c).cast("double") < lo) | (_col(c).cast("double") > hi)), F.lit(False)) for c, (lo, hi) in got.items()]
        return Step(made, _total(out), columns, "\n".join(_clip_code(c, method, threshold) for c in got))
    return Step(df, 0, columns, "# No code generated")


def _mode_code(c: str) -> str:
    q = f"`{c}`"
    return f"df = df.withColumn({c!r}, F.coalesce(F.col({q!r}), F.lit(df.agg(F.mode({q!r}, True)).first()[0])))"


def _number(c: str) -> str:
    """Code of a column as a double, not-a-number taken as missing."""
    return f"F.nanvl(F.col({f'`{c}`'!r}).cast('double'), F.lit(None).cast('double'))"


def _clip_code(c: str, method: str, threshold: float) -> str:
    q = f"`{c}`"
    if method == "iqr":
        take = f"q1, q3 = df.agg(F.percentile({_number(c)}, F.array(F.lit(0.25), F.lit(0.75)))).first()[0]\nlow, high = q1 - {threshold} * (q3 - q1), q3 + {threshold} * (q3 - q1)"
    else:
        take = f"mean, std = df.agg(F.avg({_number(c)}), F.stddev_samp({_number(c)})).first()\nlow, high = mean - {threshold} * std, mean + {threshold} * std"
    return f"{take}\ndf = df.withColumn({c!r}, F.when(F.col({q!r}) < low, low).when((F.col({q!r}) > high) & ~F.isnan(F.col({q!r}).cast('double')), high).otherwise(F.col({q!r}).cast('double')))"


# --- rows and columns ---------------------------------------------------------------------------------------------


def duplicates(df: DataFrame, keep: str | bool = "first", subset: list[str] | None = None, order_by: list[str | Column] | None = None) -> Step:
    """Keeps the first or the last of equal rows, or none of them (keep=False).  order_by says which is first; without
    it the input's order does."""
    keys = _known(df, subset) or list(df.columns)
    turn_ = f"F.row_number().over(Window.partitionBy(*{[f'`{c}`' for c in keys]!r}).orderBy(F.{'desc' if keep == 'last' else 'asc'}('_row_id')))"
    code = f"df = df.withColumn('_row_id', F.monotonically_increasing_id())\ndf = df.withColumn('_turn', {turn_}).filter('_turn = 1').drop('_turn', '_row_id')" if subset else "df = df.dropDuplicates()"
    if not keys:
        return Step(df, 0, [], code)
    same = [comparable(_col(c), df.schema[c].dataType) for c in keys]
    if keep is not False and len(keys) == len(df.columns) and order_by is None and not any(isinstance(f.dataType, T.MapType) for f in df.schema):
        made = df.dropDuplicates()  # equal rows can't be told apart
    elif keep is False:
        made = df.withColumn("_copies", F.count("*").over(Window.partitionBy(*same))).filter("_copies = 1").drop("_copies")
        code = f"df = df.withColumn('_copies', F.count('*').over(Window.partitionBy({keys!r}))).filter('_copies = 1').drop('_copies')"
    else:
        order = order_by or ["_row_id"]
        marked = df if order_by else df.withColumn("_row_id", F.monotonically_increasing_id())
        by = [F.col(o) if isinstance(o, str) else o for o in order]
        turn = F.row_number().over(Window.partitionBy(*same).orderBy(*[o.asc() if keep == "first" else o.desc() for o in by]))
        made = marked.withColumn("_turn", turn).filter("_turn = 1").drop("_turn", *([] if order_by else ["_row_id"]))
    return Step(made, lambda: df.count() - made.count(), list(df.columns), code)


def columns(df: DataFrame, operation: str = "drop", columns: list[str] | None = None, mapping: dict[str, str] | None = None, new_name: str | None = None, separator: str = " ", null_text: str | None = None) -> Step:
    """drop, rename, merge, or review_merge, which only advises and changes nothing.

    merge puts the values as text, joined, into a new last column; missing ones are left out, or have null_text."""
    if operation == "drop":
        gone = _present(df, columns)
        return Step(df.drop(*gone), F.count("*") * len(gone), gone, f"df = df.drop(*{gone!r})")
    if operation == "rename":
        mapping = mapping or {}
        held = {k: v for k, v in mapping.items() if k in df.columns}
        return Step(df.withColumnsRenamed(held), F.count("*") * len(mapping), list(mapping), f"df = df.withColumnsRenamed({mapping!r})")
    if operation == "merge" and len(columns or []) >= 2:
        parts = _known(df, columns)
        name = new_name or "_".join(parts)
        text = [_col(c).cast("string") if null_text is None else F.coalesce(_col(c).cast("string"), F.lit(null_text)) for c in parts]
        rest = [_col(c) for c in df.columns if c not in parts and c != name]
        made = df.select(*rest) if name in parts else df.select(*rest, F.concat_ws(separator, *text).alias(name))
        return Step(made, F.count("*"), parts, f"df = df.withColumn({name!r}, F.concat_ws({separator!r}, *{[f'`{c}`' for c in parts]!r})).drop(*{[c for c in parts if c != name]!r})")
    return Step(df, 0, list(columns or []), "")


# --- types, formats, categories -----------------------------------------------------------------------------------


def types(df: DataFrame, columns: list[str] | None = None, target_type: str = "numeric") -> Step:
    """numeric, boolean, datetime or string; what can't be converted becomes null."""
    found = _present(df, columns)
    text = {c: _col(c).cast("string") for c in found}
    if target_type == "numeric":
        text = {c: _col(c).cast("int").cast("string") if kind_of(df.schema[c].dataType) == "boolean" else text[c] for c in found}
    how: dict[str, tuple[Callable[[str], Column], str]] = {
        "numeric": (lambda c: _col(c).cast("double") if kind_of(df.schema[c].dataType) == "numeric" else parse_number(text[c]), f"F.when(F.col({{q!r}}).cast('string').rlike({NUMBER.replace('{', '{{').replace('}', '}}')!r}), F.regexp_replace({STRIPPED}, r'(?i)^[+]?inf(inity)?$', 'Infinity').try_cast('double'))"),
        "boolean": (lambda c: _col(c) if kind_of(df.schema[c].dataType) == "boolean" else to_boolean(text[c]), f"F.when(F.lower({STRIPPED}).isin('true', 'yes', 'y', '1', 't', 'on'), F.lit(True)).when(F.lower({STRIPPED}).isin('false', 'no', 'n', '0', 'f', 'off'), F.lit(False))"),
        "datetime": (lambda c: _col(c) if kind_of(df.schema[c].dataType) == "temporal" else parse_date(text[c]), DATE_CODE),
        "string": (lambda c: text[c], "F.col({q!r}).cast('string')"),
    }
    if target_type not in how or not found:
        return Step(df, 0, list(columns or []), "")
    make, code = how[target_type]
    made = df.withColumns({c: make(c) for c in found})
    flags = [F.lit(True) if target_type == "string" else make(c).isNotNull() if target_type in ("boolean", "datetime") else changed(text[c], make(c).cast("string")) for c in found]
    lines = [f"df = df.withColumn({c!r}, {code.format(q=f'`{c}`')})" for c in found]
    return Step(made, _total(flags), list(columns or []), "\n".join(lines))


def formats(df: DataFrame, columns: list[str] | None = None, operation: str = "strip_whitespace", target_format: str = "%Y-%m-%d") -> Step:
    """strip_whitespace, lowercase, uppercase, titlecase or standardize_dates; unknown dates stay as they are."""
    found = _present(df, columns)
    day = lambda c: parse_date(c)
    java = java_format(target_format)
    how = {
        "strip_whitespace": (strip, "F.regexp_replace({q!r}, r'(?U)^\\s+|\\s+$', '')"),
        "lowercase": (F.lower, "F.lower({q!r})"),
        "uppercase": (F.upper, "F.upper({q!r})"),
        "titlecase": (title, "F.expr(\"array_join(transform(regexp_extract_all({q}, r'(\\\\p{{L}}+|\\\\P{{L}}+)', 0), x -> initcap(x)), '')\")"),
        "standardize_dates": (lambda c: F.coalesce(F.date_format(day(c), java), c), f"F.coalesce(F.date_format({DATE_CODE}, {java!r}), F.col({{q!r}}))"),
    }
    if operation not in how or not found:
        return Step(df, 0, list(columns or []), "")
    make, code = how[operation]
    before = {c: _col(c).cast("string") for c in found}
    made = df.withColumns({c: make(before[c]) for c in found})
    flags = [day(before[c]).isNotNull() if operation == "standardize_dates" else changed(before[c], make(before[c])) for c in found]
    return Step(made, _total(flags), list(columns or []), "\n".join(f"df = df.withColumn({c!r}, {code.format(q=f'`{c}`')})" for c in found))


def categories(df: DataFrame, columns: list[str] | None = None, mapping: dict[str, str] | None = None) -> Step:
    """Replaces values by the mapping, or strips and lower-cases them without one."""
    found = _present(df, columns)
    if not found:
        return Step(df, 0, list(columns or []), "")
    if mapping:
        table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
        make = lambda c: F.coalesce(F.try_element_at(table, _col(c).cast("string")), _col(c).cast("string"))
        flags = [_col(c).cast("string").isin(*mapping) for c in found]
        code = [f"df = df.replace({mapping!r}, subset={found!r})"]
    else:
        make = lambda c: F.lower(strip(_col(c).cast("string")))
        flags = [changed(_col(c).cast("string"), make(c)) for c in found]
        code = [f"df = df.withColumn({c!r}, F.lower(F.regexp_replace({f'`{c}`'!r}, r'(?U)^\\s+|\\s+$', '')))" for c in found]
    return Step(df.withColumns({c: make(c) for c in found}), _total(flags), list(columns or []), "\n".join(code))


def narrow(df: DataFrame) -> DataFrame:
    """Integers in the smallest type that holds the column, doubles as floats.  For storing a table: a float keeps some
    seven digits, so nothing is analysed in this form."""
    whole = [f.name for f in df.schema if isinstance(f.dataType, (T.ShortType, T.IntegerType, T.LongType))]
    row = df.agg(*[x(_col(c)).alias(f"{k}{i}") for i, c in enumerate(whole) for k, x in (("a", F.min), ("b", F.max))]).first() if whole else {}
    kinds = [("tinyint", 7), ("smallint", 15), ("int", 31)]
    made = {f.name: _col(f.name).cast("float") for f in df.schema if isinstance(f.dataType, T.DoubleType)}
    for i, c in enumerate(whole):
        lo, hi = row[f"a{i}"], row[f"b{i}"]
        fits = [k for k, bits in kinds if lo is not None and -(2**bits) <= lo and hi < 2**bits]
        if fits:
            made[c] = _col(c).cast(fits[0])
    return df.withColumns(made) if made else df


for _name, _transformer in (("missing", missing), ("duplicates", duplicates), ("columns", columns), ("types", types), ("formats", formats), ("categories", categories)):
    register_transformer(_name, _transformer)
