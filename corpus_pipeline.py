"""A training corpus in five stages: quality, near duplicates, benchmark leaks, secrets, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet in the shared folder and
reads it again as the next stage's docs.  All stages but the last return the columns of documents, whatever else the
table has and however its columns are called.

Nulls and odd rows: a null or empty text is judged by the classifier's bias, has no near duplicate, leak or secret, and is not
taken by the mix; a null doc_id is the largest of its group; of repeated rows one stays; ties of equal doc_id go to the
row that comes first in the table; an empty table passes through every stage as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clearbrook.llm.common import forget, unused, written
from clearbrook.llm.decontaminate import find_leaks
from clearbrook.llm.mixing import mix_sources
from clearbrook.llm.near_dup import duplicates_among, numbered
from clearbrook.llm.quality import THRESHOLD, learned_on, score_quality
from clearbrook.llm.secrets import scan, trained_on


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is at least the threshold stay; the labels teach, they decide nothing."""
    model = learned_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    (score,) = unused(docs, "_score")
    return score_quality(docs, model, out=score).filter(F.col(score) >= THRESHOLD).drop(score)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, 80 %) stays, that of the smallest doc_id."""
    rows = numbered(docs)
    stay = duplicates_among(rows, width=5, percent=80).filter("first").select("rid")
    return rows.join(stay, "rid", "left_semi").select("doc.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    (leaks,) = unused(docs, "_leaks")
    found = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), out=leaks)
    return found.filter(F.size(leaks) == 0).drop(leaks)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are masked; every document stays.  n_chars follows the text where it did before."""
    found, clean = unused(docs, "_findings", "_clean")
    out = scan(docs, trained_on(docs), out=found, clean=clean)
    made = {c: F.col(f"`{c}`") for c in docs.columns}
    for c in docs.columns:
        if c.lower() == "n_chars":
            follows = F.col(f"`{c}`") == F.length("text")
            made[c] = F.when(follows, F.length(clean).cast(docs.schema[c].dataType)).otherwise(made[c])
        elif c.lower() == "text":
            made[c] = F.col(clean)
    return out.select(*[made[c].alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document: its words once, in part, or up to three times; the documents that it takes
    nothing of go.  Returns doc_id, source, size, source_size, target, taken and first_slot."""
    out = mix_sources(docs)
    return out.filter("taken > 0").select("doc_id", "source", "size", "source_size", "target", "taken", "first_slot")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("secrets", secrets), ("mix", mix)]

#: A learned classifier, a forest and a similarity search: SQL can't express these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each one's result written and read again."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if last is not None:
            forget(last)
        last = docs
    return docs
