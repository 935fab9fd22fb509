"""The stages one after the other, each judged on its own input."""

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    import corpus_pipeline
    from clearbrook.llm.common import written

    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("extra", F.lit("x"))
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), name)
        out[name] = docs
    return out


def test_columns_and_order(stages):
    assert list(stages) == ["documents", "quality", "near_dedup", "decontaminate", "secrets", "mix"]
    assert all(stages[n].columns == stages["documents"].columns for n in list(stages)[1:-1])


def test_each_stage_decides(spark, stages):
    from clearbrook.llm.decontaminate import find_leaks
    from clearbrook.llm.near_dup import near_duplicates

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    left = stages["quality"].join(labels, "doc_id")
    assert left.filter("quality = 0").count() <= 0.1 * labels.filter("quality = 0").count() and left.filter("quality = 1").count() >= 0.97 * labels.filter("quality = 1").count()
    first = {r["doc_id"] for r in near_duplicates(stages["quality"], width=5).filter("first").collect()}
    assert {r["doc_id"] for r in stages["near_dedup"].select("doc_id").collect()} == first
    leaks = {r["doc_id"] for r in find_leaks(stages["near_dedup"], spark.read.parquet(f"{SF}/benchmark.parquet")).filter("size(leaks) > 0").collect()}
    assert {r["doc_id"] for r in stages["decontaminate"].collect()} == first - leaks
    assert stages["secrets"].count() == stages["decontaminate"].count()
    assert stages["secrets"].filter("text rlike '(?i)token = \"[0-9a-f]{40}\"'").count() == 0
    assert stages["secrets"].filter("n_chars <> length(text)").count() == 0
    mixed = stages["mix"].groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("w")).collect()
    # within a few of the schedule's blocks, which have one word here
    assert all(abs(r["t"] - r["w"]) <= 4 for r in mixed)


def test_odd_rows(spark):
    import corpus_pipeline

    text = "one two three four five six seven eight"
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, text, "en", "a", 39), (3, text, "en", "a", 39), (None, text, "en", "b", 39), (4, text + " nine", None, None, 44)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    kept = corpus_pipeline.near_dedup(spark, docs, SF).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=str) == sorted([(1, None), (2, ""), (3, text)], key=str)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
        assert stage(spark, docs, SF).count() <= 6


def test_columns_of_any_name_are_kept(spark):
    import corpus_pipeline

    names = ["_id", "_key", "_rows", "_turn", "_key0", "_score", "_x", "_leaks", "_leaks0", "_clean", "_findings", "_at", "rid", "doc", "label", "component", "n", "x"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40).select("*", *[F.lit(c).alias(c) for c in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns, name
        assert got.filter(" or ".join(f"`{c}` <> '{c}'" for c in names)).count() == 0 and got.count() > 0, name
    assert corpus_pipeline.mix(spark, docs, SF).columns == ["doc_id", "source", "size", "source_size", "target", "taken", "first_slot"]
