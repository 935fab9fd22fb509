"""Reading and writing tables by file extension."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..models import SourceError

# Texts that mean a missing value in a delimited file.
MISSING_TEXTS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


@dataclass
class Adapter:
    """How files of one extension are read and written."""

    read: Callable[..., DataFrame]
    write: Callable[..., None]


_adapters: dict[str, Adapter] = {}


def register_adapter(extension: str, adapter: Adapter) -> None:
    """Makes an extension (without its dot) readable and writable."""
    _adapters[extension] = adapter


def get_adapter(extension: str) -> Adapter:
    if extension not in _adapters:
        raise SourceError(f"Unsupported format: '{extension}'. Supported formats: {', '.join(sorted(_adapters))}")
    return _adapters[extension]


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def load(spark: SparkSession, source: str, format: str | None = None, **options: Any) -> DataFrame:
    """The table at a path that Spark can open; format defaults to the path's extension."""
    source = str(source)
    if not _exists(spark, source):
        raise SourceError(f"File not found: {source}")
    name = source.rstrip("/").rpartition("/")[2]
    adapter = get_adapter(format or name.rpartition(".")[2] * ("." in name))
    try:
        return adapter.read(spark, source, **options)
    except SourceError:
        raise
    except Exception as e:
        raise SourceError(f"Failed to read {source}: {e}") from e


def save(df: DataFrame, path: str, format: str | None = None, single_file: bool = False, **options: Any) -> None:
    """Writes a table, over whatever is there; one part if single_file."""
    name = str(path).rstrip("/").rpartition("/")[2]
    adapter = get_adapter(format or name.rpartition(".")[2] * ("." in name))
    adapter.write(df.coalesce(1) if single_file else df, str(path), **options)


def _read_delimited(sep: str) -> Callable[..., DataFrame]:
    def read(spark: SparkSession, path: str, **options: Any) -> DataFrame:
        """A header line, inferred types, known texts as missing.  A row with fewer fields than the header is filled up
        with nulls; one with more is an error."""
        sep_ = options.pop("sep", sep)
        base = {"header": True, "multiLine": True, "escape": '"', "sep": sep_, **options}
        text = spark.read.options(**base).csv(path)
        names = text.columns
        if not names:
            return text
        # one column more than the header has: it is filled only where a row has too many fields
        wide = T.StructType([T.StructField(n, T.StringType()) for n in [*names, "_more"]])
        raw = spark.read.options(**{**base, "mode": "PERMISSIVE", "enforceSchema": True}).schema(wide).csv(path)
        if raw.filter(F.col("_more").isNotNull()).limit(1).count():
            raise SourceError(f"Failed to read {path}: expected {len(names)} fields, a row has more")
        kept = raw.select(*[F.when(~F.col(f"`{n}`").isin(MISSING_TEXTS), F.col(f"`{n}`")).alias(n) for n in names])
        return _inferred(kept)

    return read


def _inferred(df: DataFrame) -> DataFrame:
    """String columns whose every value is integral, a number or a boolean, as such."""
    tests = {}
    for i, c in enumerate(df.columns):
        v = F.trim(F.col(f"`{c}`"))
        tests[f"i{i}"] = F.min(v.rlike(r"^[+-]?\d{1,18}$").cast("int"))
        tests[f"d{i}"] = F.min(v.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$").cast("int"))
        tests[f"b{i}"] = F.min(v.isin("True", "False", "TRUE", "FALSE", "true", "false").cast("int"))
    row = df.agg(*[t.alias(k) for k, t in tests.items()]).first()
    kind = lambda i: "bigint" if row[f"i{i}"] else "double" if row[f"d{i}"] else "boolean" if row[f"b{i}"] else None
    return df.select(*[F.trim(F.col(f"`{c}`")).try_cast(kind(i)).alias(c) if kind(i) else F.col(f"`{c}`") for i, c in enumerate(df.columns)])


def _write_delimited(sep: str) -> Callable[..., None]:
    return lambda df, path, **o: df.write.mode("overwrite").options(**{"header": True, "sep": sep, "escape": '"', **o}).csv(path)


def _read_json(spark: SparkSession, path: str, **options: Any) -> DataFrame:
    """An array of records, or one record a line: the first sign tells."""
    first = spark.read.text(path).filter("trim(value) <> ''").limit(1).collect()
    array = bool(first) and first[0]["value"].lstrip().startswith("[")
    return spark.read.options(**{"multiLine": array, **options}).json(path)


def _excel(spark: SparkSession, path: str, **options: Any) -> DataFrame:
    try:
        import openpyxl  # noqa: F401
        import pandas as pd
    except ImportError as e:
        raise SourceError("Excel files need openpyxl: pip install openpyxl") from e
    return spark.createDataFrame(pd.read_excel(path, **options))


def _to_excel(df: DataFrame, path: str, **options: Any) -> None:
    try:
        import openpyxl  # noqa: F401
    except ImportError as e:
        raise SourceError("Excel files need openpyxl: pip install openpyxl") from e
    df.toPandas().to_excel(path, index=False, **options)


register_adapter("csv", Adapter(_read_delimited(","), _write_delimited(",")))
register_adapter("tsv", Adapter(_read_delimited("\t"), _write_delimited("\t")))
register_adapter("json", Adapter(_read_json, lambda df, p, **o: df.write.mode("overwrite").options(**o).json(p)))
register_adapter("parquet", Adapter(lambda s, p, **o: s.read.options(**o).parquet(p), lambda df, p, **o: df.write.mode("overwrite").options(**o).parquet(p)))
register_adapter("xlsx", Adapter(_excel, _to_excel))
register_adapter("xls", Adapter(_excel, _to_excel))
