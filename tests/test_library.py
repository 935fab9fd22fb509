"""Profiles, detectors, suggestions, transformations, reports, sources, samples, command line."""

import duckdb
import pytest

import clearbrook as cb
from clearbrook import cli, queries
from clearbrook.models import Config, ConfigError, DetectorConfig, SourceError, TransformError
from clearbrook.operators import run_transformer
from clearbrook.plans.detectors import Context, run_detectors
from clearbrook.plans.metrics import measure
from clearbrook.plans.profile import Measurements, profile
from clearbrook.plans.sampling import Sampler
from clearbrook.plans.similarity import bigrams, name_candidates
from clearbrook.streaming import clean_stream, freeze

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def report(spark):
    from conftest import MESSY

    df = spark.createDataFrame(MESSY, "name string, age string, email string, score bigint, active string")
    return cb.analyze(df)


def found(df, *detectors, **config):
    p = profile(df)
    return run_detectors(Context(df, p, measure(df)[1], DetectorConfig(enabled=list(detectors), **config)))


def test_golden_findings(report):
    got = [(f.issue_type, ",".join(f.columns), f.severity.value, round(f.confidence, 2)) for f in report.issues]
    assert got == [("duplicate_rows", "name,age,email,score,active", "high", 1.0), ("inconsistent_case", "name", "low", 0.8), ("whitespace_padding", "name", "low", 1.0), ("inconsistent_case", "active", "low", 0.8), ("missing_values", "email", "medium", 1.0), ("outliers", "score", "high", 0.85), ("numeric_as_string", "age", "medium", 1.0), ("boolean_as_string", "active", "low", 0.95)]
    assert report.quality_score == 64


def test_golden_profile(report):
    p = report.profile
    assert (p.row_count, p.column_count, p.duplicate_row_count) == (10, 5, 2)
    assert (p.columns["email"].null_count, p.columns["email"].null_ratio) == (4, 0.4)
    assert p.columns["email"].semantic_type == "email"
    assert p.columns["score"].statistics["q25"] == 152.5


def test_golden_cleaning(spark, report, messy):
    out = report.apply_all()
    assert out.count() == 8 and (report.last_score_before, report.last_score_after) == (64, 90)
    assert [r.transformer for r in report.applied] == ["duplicates", "formats", "formats", "missing", "types", "types", "missing"]
    assert out.agg({"score": "max"}).first()[0] == 256.25
    scope = {}
    exec(report.generate_code(), scope)
    assert sorted(map(str, scope["clean_data"](messy).collect())) == sorted(map(str, out.collect()))
    script = report.generate_code(style="script", include_comments=False)
    assert "spark.read.csv" in script and "df.write" in script and "# " not in script.replace("# Update path", "")


def test_interactive_and_text(report):
    answers = iter(["s", "q"])
    assert report.apply_interactive(lambda _: next(answers), lambda _: None).count() == 10
    answers = iter(["A"])
    assert report.apply_interactive(lambda _: next(answers), lambda _: None).count() == 8
    assert "Data Quality Score: 64/100" in report.summary() and "rows=10" in repr(report) and "<table" in report._repr_html_()


@pytest.mark.filterwarnings("ignore::UserWarning")
def test_unknown_suggestion_is_skipped(report):
    assert report.apply([999]).count() == 10


def test_empty_and_single_row(spark):
    assert cb.analyze(spark.createDataFrame([], "a int")).quality_score == 100
    p = profile(spark.createDataFrame([(1, "x")], "a bigint, b string"))
    assert p.columns["a"].statistics["std"] == 0.0 and p.columns["a"].statistics["skewness"] == 0.0
    nulls = spark.createDataFrame([(None,), (None,), (None,)], "a string")
    out, result = run_transformer("missing", nulls, columns=["a"], strategy="fill_mode")
    assert result.rows_affected == 0 and out.filter("a is null").count() == 3


def test_detector_negatives(spark):
    flat = spark.createDataFrame([(5.0, "2023-01-01", "maybe")] * 20, "a double, d string, f string")
    assert found(flat, "outliers", "formats", "types") == []
    assert found(flat, "outliers", outlier_method="zscore") == []
    mixed = spark.createDataFrame([(x,) for x in ["2023-01-15", "01/15/2023", "15-Jan-2023", "March 25, 2023", "2023-02-01"]], "d string")
    assert [f.details["total_matched"] for f in found(mixed, "formats") if f.issue_type == "inconsistent_date_format"] == [5]


def test_missing_counts_nan_and_blanks(spark):
    df = spark.createDataFrame([(float("nan"), "  "), (None, ""), (1.0, "x")], "a double, b string")
    got = {(f.issue_type, f.columns[0]): f for f in found(df, "missing")}
    assert got["missing_values", "a"].details["null_count"] == 2 and got["empty_strings", "b"].details["empty_string_count"] == 2


def test_similar_columns(spark):
    df = spark.createDataFrame([("Al", "Al", 1), ("Bo", "Bo", 2), ("Cy", "Cy", 3)], "first_name string, firstname string, age bigint")
    got = found(df, "similarity")
    assert [f.columns for f in got] == [["first_name", "firstname"]] and got[0].details["value_similarity"] == 1.0
    assert bigrams("a") == {"a"} and name_candidates(["name", "names", "x"]) == {("name", "names")}


def test_rows_are_located(spark, messy):
    got = {f.issue_type: f.rows for f in found(messy.coalesce(1), "duplicates", "outliers", locate_rows=True)}
    assert got == {"duplicate_rows": [4, 5], "outliers": [3]}


def test_transformers(spark):
    df = spark.createDataFrame([(1.0, " Cat ", "US"), (None, "DOG", "USA"), (3.0, None, "x"), (5.0, "cat", None)], "n double, c string, k string")
    run = lambda name, **p: run_transformer(name, df, **p)
    col = lambda out, c: [r[0] for r in out.select(c).collect()]
    out, r = run("missing", columns=["n"], strategy="fill_median")
    assert col(out, "n") == [1.0, 3.0, 3.0, 5.0] and r.rows_affected == 1
    assert run("missing")[1].rows_affected == 3
    out, r = run("categories", columns=["c", "gone"])
    assert col(out, "c") == ["cat", "dog", None, "cat"] and r.rows_affected == 2
    out, r = run("categories", columns=["k"], mapping={"US": "us", "USA": "us"})
    assert col(out, "k") == ["us", "us", "x", None] and r.rows_affected == 2
    out, r = run("columns", operation="merge", columns=["c", "k"], new_name="m", separator="-")
    assert out.columns == ["n", "m"] and col(out, "m") == [" Cat -US", "DOG-USA", "x", "cat"]
    assert run("columns", operation="review_merge", columns=["c", "k"])[1].rows_affected == 0
    assert run("columns", columns=["c"])[1].rows_affected == 4
    out, r = run("formats", columns=["c"], operation="titlecase")
    assert col(out, "c") == [" Cat ", "Dog", None, "Cat"] and r.rows_affected == 2
    words = spark.createDataFrame([("O'neil x2y mc-d",), (" 1e3 ",), ("1_000",), ("1d",), (" YES",)], "s string")
    assert col(run_transformer("formats", words, columns=["s"], operation="titlecase")[0], "s")[0] == "O'Neil X2Y Mc-D"
    assert col(run_transformer("types", words, columns=["s"])[0], "s") == [None, 1000.0, None, None, None]
    assert col(run_transformer("types", words, columns=["s"], target_type="boolean")[0], "s") == [None, None, None, None, True]
    blanks = spark.createDataFrame([("x",), (" ",), (None,), ("x",), ("y",)], "s string")
    out, r = run_transformer("missing", blanks, columns=["s"], strategy="clean_empty_strings")
    assert sorted(col(out, "s")) == ["x", "x", "x", "x", "y"] and r.rows_affected == 2
    with pytest.raises(KeyError, match="Unknown transformer"):
        run("nothing")
    with pytest.raises(KeyError):
        run("missing", columns=["gone"], strategy="fill_mode")


def test_dedup_keeps(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "i bigint, k string").coalesce(1)
    ids = lambda keep: sorted(r[0] for r in run_transformer("duplicates", df, keep=keep, subset=["k"])[0].select("i").collect())
    assert (ids("first"), ids("last"), ids(False)) == ([1, 2], [2, 3], [2])
    assert run_transformer("duplicates", df, subset=["k"])[1].rows_affected == 1


def test_suggestions_respect_use_and_conflicts(report):
    from clearbrook.plans.suggestions import suggest

    assert [s.id for s in report.suggestions] == list(range(1, 8))
    assert not any(s.params.get("operation") == "lowercase" and s.params["columns"] == ["active"] for s in report.suggestions)
    assert len(suggest(report.issues, max_suggestions=2)) == 2
    by = {s.finding.issue_type: s.priority.value for s in suggest(report.issues, use_case="export")}
    assert by["whitespace_padding"] == "medium" and by["numeric_as_string"] == "high"


@pytest.mark.filterwarnings("ignore::UserWarning")
def test_config():
    made = Config.from_dict({"detectors": {"enabled": ["format"], "outlier_threshold": 3}, "what": 1})
    assert made.detectors.enabled == ["formats"] and made.detectors.outlier_threshold == 3
    with pytest.raises(ConfigError):
        Config.from_dict({"use_case": "fun"})


def test_sources(spark, messy, tmp_path):
    for kind in ("csv", "tsv", "json", "parquet"):
        cb.save(messy, f"{tmp_path}/m.{kind}")
        assert cb.load(spark, f"{tmp_path}/m.{kind}").count() == 10
    back = cb.load(spark, f"{tmp_path}/m.csv")
    assert dict(back.dtypes)["score"] == "bigint" and back.filter("email is null").count() == 4
    with pytest.raises(SourceError, match="File not found"):
        cb.load(spark, f"{tmp_path}/gone.csv")
    (tmp_path / "x.abc").write_text("1")
    with pytest.raises(SourceError, match="Unsupported format: 'abc'"):
        cb.load(spark, f"{tmp_path}/x.abc")
    (tmp_path / "ragged.csv").write_text("a,b\n1,2\n3\n")
    assert cb.load(spark, f"{tmp_path}/ragged.csv").count() == 2
    (tmp_path / "wide.csv").write_text("a,b\n1,2\n3,4,5\n")
    with pytest.raises(SourceError):
        cb.load(spark, f"{tmp_path}/wide.csv")
    (tmp_path / "array.json").write_text('[{"a": 1},\n {"a": 2}]')
    assert cb.load(spark, f"{tmp_path}/array.json").count() == 2


def test_sampler(spark):
    df = spark.range(3000).selectExpr("id", "id % 3 as g", "case when id % 50 = 0 then null else id end as v")
    s = Sampler(df, size=300, threshold=3000)
    rows = s.sample.collect()
    assert s.sampled and 290 <= len(rows) <= 302 and {r["g"] for r in rows} == {0, 1, 2}
    assert sum(r["v"] is None for r in rows) == 30
    assert not Sampler(df, threshold=5000).sampled and s.extrapolate_count(3) == int(3 * 3000 / len(rows))


def test_sampler_keeps_the_share_of_gaps(spark):
    mostly = spark.range(3000).selectExpr("id", "id % 3 as g", "case when id % 10 < 6 then null else id end as v")
    rows = Sampler(mostly, size=300, threshold=3000).sample.collect()
    assert 290 <= len(rows) <= 302 and len({r["id"] for r in rows}) == len(rows)
    assert 0.5 <= sum(r["v"] is None for r in rows) / len(rows) <= 0.75
    every = spark.range(3000).selectExpr("id % 7 as g", "cast(null as string) as v")
    assert 290 <= Sampler(every, size=300, threshold=3000).sample.count() <= 302


def test_cached_measurements(spark):
    m = Measurements(spark.createDataFrame([(1, "a"), (2, "b"), (None, "a")], "n int, s string"))
    assert m.unique_count("n") == 2 and m.statistics("n")["mean"] == 1.5 and m.value_set("s") == {"a", "b"} and m.all is m.all


def test_streaming(spark, tmp_path):
    batch = spark.createDataFrame([(" A ", 1.0), ("b", None), ("c", 3.0), ("d", 500.0)], "s string, v double")
    batch.write.parquet(f"{tmp_path}/in")
    steps = [("formats", {"columns": ["s"]}), ("missing", {"columns": ["v"], "strategy": "fill_median"})]
    stream = spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/in")
    with pytest.raises(TransformError):
        clean_stream(stream, steps)
    q = clean_stream(stream, freeze(batch, steps)).writeStream.format("memory").queryName("cleaned").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.s, r.v) for r in spark.table("cleaned").collect()) == [("A", 1.0), ("b", 3.0), ("c", 3.0), ("d", 500.0)]


def test_command_line(spark, messy, tmp_path, capsys):
    cb.save(messy, f"{tmp_path}/m.csv")
    src = f"{tmp_path}/m.csv"
    assert cli.main(["analyze", src], spark) == 0 and "Issues Found" in capsys.readouterr().out
    assert cli.main(["suggest", src, "-p", "high", "-l", "1"], spark) == 0 and "Suggestions (1)" in capsys.readouterr().out
    assert cli.main(["clean", src, "-o", f"{tmp_path}/o.csv"], spark) == 1
    assert cli.main(["clean", src, "-o", f"{tmp_path}/o.abc", "--apply-all"], spark) == 1
    assert cli.main(["clean", src, "-o", f"{tmp_path}/o.parquet", "--apply", "1", "--codegen", f"{tmp_path}/c.py"], spark) == 0
    assert spark.read.parquet(f"{tmp_path}/o.parquet").count() == 8 and "def clean_data" in (tmp_path / "c.py").read_text()
    assert cli.main(["codegen", src, "--apply", "1", "-s", "script"], spark) == 0


@pytest.mark.parametrize("name", ["profile_categorical", "profile_patterns", "fill_mode", "clip_iqr", "dedup_last", "types_numeric", "fmt_title", "stratified_sample", "suggestion_plan", "end_to_end_clean"])
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("customer", "events", "lineitem", "orders", "pages", "part"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), c.sql(queries.ORACLES[name]).df()
    rows = lambda x: sorted(tuple(None if v != v or v is None else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in x[sorted(x.columns)].astype(object).values.tolist())
    assert list(map(str, rows(got))) == list(map(str, rows(want)))


def test_every_query_with_sql_is_registered():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(queries.ORACLES) >= 50


def test_dates_of_every_family(spark):
    rows = ["15-Jan-2023", "15-jan-23", "01/15/23", "01/15/2023", "2023-01-15T10:00:00", "2023-01-15", "January 15, 2023", "15 Jan 2023", "15-Jan-1999", "15-Jan-99", "x", None]
    df = spark.createDataFrame([(v,) for v in rows], "v string")
    got = [r["v"] for r in run_transformer("formats", df, columns=["v"], operation="standardize_dates", target_format="%Y-%m-%d")[0].collect()]
    assert got[:1] + got[2:] == ["2023-01-15"] * 7 + ["1999-01-15"] * 2 + ["x", None] and got[1] in ("2023-01-15", "15-jan-23")


@pytest.mark.parametrize(
    "name,params",
    [
        ("missing", {"columns": ["n"], "strategy": "fill_median"}), ("missing", {"columns": ["n"], "strategy": "clip_outliers"}), ("missing", {"columns": ["n"], "strategy": "clip_outliers", "method": "zscore", "threshold": 1.0}),
        ("missing", {"columns": ["t"], "strategy": "fill_mode"}), ("missing", {"columns": ["t"], "strategy": "fill_value", "fill_value": "z"}), ("missing", {"columns": ["t"], "strategy": "empty_to_nan"}), ("missing", {"columns": ["t"], "strategy": "clean_empty_strings"}),
        ("types", {"columns": ["t"], "target_type": "boolean"}), ("types", {"columns": ["t"], "target_type": "numeric"}), ("types", {"columns": ["t"], "target_type": "datetime"}), ("types", {"columns": ["n"], "target_type": "string"}),
        ("formats", {"columns": ["t"], "operation": "strip_whitespace"}), ("formats", {"columns": ["t"], "operation": "titlecase"}), ("formats", {"columns": ["t"], "operation": "standardize_dates"}),
        ("categories", {"columns": ["t"]}), ("columns", {"operation": "drop", "columns": ["t"]}), ("duplicates", {"keep": "last", "subset": ["k"]}), ("duplicates", {"keep": "first", "subset": ["k"]}), ("duplicates", {"keep": False, "subset": ["k"]}),
    ],
)
def test_code_does_what_the_operator_does(spark, name, params):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    rows = [(1, 1.0, "\tyes "), (1, 2.0, " 12\t"), (2, float("nan"), ""), (2, None, None), (3, 900.0, "15-Jan-23"), (4, 3.0, "2023-01-15T10:00:00"), (5, 2.5, "infinity"), (6, 1.5, "-inf"), (7, 2.0, "  "), (8, -700.0, "no"), (9, 2.0, "no"), (10, 2.0, "1e3")]
    df = spark.createDataFrame(rows, "k long, n double, t string").coalesce(1)
    want, result = run_transformer(name, df, **params)
    scope = {"F": F, "Window": Window, "df": df}
    exec(result.code, scope)
    assert [str(r) for r in scope["df"].select(*want.columns).orderBy(*want.columns).collect()] == [str(r) for r in want.orderBy(*want.columns).collect()]
