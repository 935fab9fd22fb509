"""The log of applied transformations as a PySpark program."""

from __future__ import annotations

from ..models import TransformationResult


def generate_code(results: list[TransformationResult], style: str = "function", include_comments: bool = True) -> str:
    """A function clean_data(df), or a script that reads and writes files."""
    if not results:
        return "# No transformations to apply"
    function = style == "function"
    out = ["from pyspark.sql import SparkSession, Window", "from pyspark.sql import functions as F", ""]
    if function:
        out += ["", "def clean_data(df):", '    """Apply data cleaning transformations."""']
    else:
        out += ["spark = SparkSession.builder.getOrCreate()"]
        out += ["# Load data"] * include_comments
        out += ['df = spark.read.csv("input.csv", header=True, inferSchema=True)  # Update path as needed', ""]
    body: list[str] = []
    for r in results:
        lines = [x for x in r.code.split("\n") if x.strip() and not x.startswith("import ")]
        body += [f"# {r.transformer}: {r.rows_affected} rows affected"] * include_comments + lines + [""]
    out += [f"    {x}" if x and function else x for x in body]
    if function:
        out += ["    return df"]
    else:
        out += ["# Save cleaned data"] * include_comments
        out += ['df.write.mode("overwrite").csv("output.csv", header=True)']
    return "\n".join(out) + "\n"
