"""Cleaning of streams: transformations that need nothing but the row, on streaming DataFrames.

Steps that take a median, a mode or fences, or that compare rows, need the whole table: their parameters are frozen
from a batch first (freeze), or they run in foreachBatch.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clip
from ..models import TransformError
from ..operators import transform
from ..operators.transforms import fences, medians, modes
from ..plans.metrics import kind_of
from ..plans.suggestions import step_name

STATELESS = {"missing.drop_rows", "missing.fill_value", "missing.empty_to_nan", "types.numeric", "types.boolean", "types.datetime", "types.string", "formats.strip_whitespace", "formats.lowercase", "formats.uppercase", "formats.titlecase", "formats.standardize_dates", "categories", "columns.drop", "columns.rename", "columns.merge"}
Steps = list[tuple[str, dict[str, Any]]]


def freeze(batch: DataFrame, steps: Steps) -> Steps:
    """Steps with the medians, modes and fences of a batch put in as fixed values."""
    out: Steps = []
    for name, params in steps:
        step, columns = step_name(name, params), params.get("columns", [])
        if step in ("missing.fill_median", "missing.fill_mode"):
            numeric = [c for c in columns if kind_of(batch.schema[c].dataType) == "numeric"]
            values = medians(batch, numeric) if step.endswith("median") else modes(batch, columns)
            out += [("missing", {"columns": [c], "strategy": "fill_value", "fill_value": v}) for c, v in values.items() if v is not None]
        elif step == "missing.clip_outliers":
            numeric = [c for c in columns if kind_of(batch.schema[c].dataType) == "numeric"]
            out.append(("_clip", {"fences": fences(batch, numeric, params.get("method", "iqr"), params.get("threshold", 1.5))}))
        else:
            out.append((name, params))
    return out


def clean_stream(stream: DataFrame, steps: Steps) -> DataFrame:
    """The stream with the steps applied in turn."""
    for name, params in steps:
        if name == "_clip":
            stream = stream.withColumns({c: clip(F.col(f"`{c}`").cast("double"), F.lit(lo), F.lit(hi)) for c, (lo, hi) in params["fences"].items()})
            continue
        step = step_name(name, params)
        if step not in STATELESS:
            raise TransformError(f"{step} needs the whole table: freeze() it, or use foreachBatch")
        stream = transform(name, stream, **params)
    return stream
