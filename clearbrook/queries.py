"""The library's operators as queries over the test tables, each with the SQL that gives the same rows.

The tables are clean, so each query first puts the trouble in that its operator looks for, by an expression of the row's
key that both engines read alike.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import DATE_FORMATS, VALUE_PATTERNS, is_lower, is_title, is_upper
from .models import Config, DetectorConfig, Finding, Severity
from .operators import narrow, transform
from .plans import metrics as M
from .plans.detectors import Context, run_detectors
from .plans.profile import detect_patterns, profile
from .plans.report import examine, quality_score
from .plans.sampling import stratified
from .plans.similarity import band_pairs, distinct_values, minhash, name_similarity, value_similarity
from .plans.suggestions import priority_score, suggest
from .sources import load, save

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a query under its name, with its SQL."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def _table(spark: SparkSession, d: str, name: str, *exprs: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/{name}.parquet")
    return df.selectExpr(*exprs) if exprs else df


# Expressions that both engines read alike.
PRIORITY = "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END"
BLANKS = "CASE WHEN c_custkey % 9 = 0 THEN '   ' WHEN c_custkey % 11 = 0 THEN '' WHEN c_custkey % 13 = 0 THEN NULL ELSE c_mktsegment END"
PADDED = "CASE WHEN c_custkey % 5 = 0 THEN concat('  ', c_name, ' ') WHEN c_custkey % 7 = 0 THEN concat(c_name, ' ') ELSE c_name END"
CASED = "CASE WHEN c_custkey % 3 = 0 THEN upper(c_mktsegment) WHEN c_custkey % 3 = 1 THEN lower(c_mktsegment) ELSE c_mktsegment END"
JUNK = "CASE WHEN l_orderkey % 10 = 0 THEN 'n/k' WHEN l_orderkey % 17 = 0 THEN '1_000' WHEN l_orderkey % 19 = 0 THEN ' 12.5 ' WHEN l_orderkey % 23 = 0 THEN '1d' ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR(20)) END"
FLAG = "CASE WHEN l_returnflag = 'A' THEN 'yes' WHEN l_returnflag = 'N' THEN 'No' ELSE 'TRUE' END"
WORDY = "CASE WHEN l_returnflag = 'A' THEN ' Yes' WHEN l_returnflag = 'N' THEN 'OFF' WHEN l_linenumber = 1 THEN 'maybe' ELSE 't' END"
BALANCE = "CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_acctbal END"
LINE = "l_orderkey, l_partkey, l_suppkey, l_linenumber"


def _dates(spark: bool) -> str:
    f = (lambda java, py: f"date_format(o_orderdate, '{java}')") if spark else (lambda java, py: f"strftime(o_orderdate, '{py}')")
    return f"CASE WHEN o_orderkey % 4 = 0 THEN {f('yyyy-MM-dd', '%Y-%m-%d')} WHEN o_orderkey % 4 = 1 THEN {f('MM/dd/yyyy', '%m/%d/%Y')} WHEN o_orderkey % 4 = 2 THEN {f('dd-MMM-yyyy', '%d-%b-%Y')} ELSE {f('MMM dd, yyyy', '%b %d, %Y')} END"


# --- profiles -----------------------------------------------------------------------------------------------------

_NUMERIC = [("events", "value"), ("lineitem", "l_extendedprice"), ("customer", "c_acctbal")]


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS name, count({c}) AS n, round(avg({c}), 4) AS mean, round(quantile_cont({c}, 0.5), 4) AS median, round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, round(max({c}), 4) AS max, round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.75), 4) AS q75, round(skewness({c}), 6) AS skewness, round(kurtosis({c}), 6) AS kurtosis FROM {t}"
        for t, c in _NUMERIC
    )
)
def profile_numeric(spark: SparkSession, d: str) -> DataFrame:
    out = []
    for t, c in _NUMERIC:
        df = _table(spark, d, t, c)
        a = M.column_aggregates(c, df.schema[c].dataType)
        q = a["quartiles"]
        r = lambda x, n=4: F.round(x, n)
        out.append(df.agg(F.lit(c).alias("name"), a["filled"].alias("n"), r(a["mean"]).alias("mean"), r(q[1]).alias("median"), r(a["std"]).alias("std"), r(a["min"]).alias("min"), r(a["max"]).alias("max"), r(q[0]).alias("q25"), r(q[2]).alias("q75"), r(a["skewness"], 6).alias("skewness"), r(a["kurtosis"], 6).alias("kurtosis")))
    return reduce(DataFrame.unionAll, out)


@query(
    "SELECT * FROM (SELECT name, value, n, row_number() OVER (PARTITION BY name ORDER BY n DESC, value) AS rank FROM ("
    "SELECT 'p_brand' AS name, p_brand AS value, count(*) AS n FROM part GROUP BY p_brand UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY p_type)) WHERE rank <= 10"
)
def profile_categorical(spark: SparkSession, d: str) -> DataFrame:
    return M.value_counts(_table(spark, d, "part"), ["p_brand", "p_type"]).withColumnRenamed("column", "name")


@query(
    f"WITH t AS (SELECT {PRIORITY} AS p, o_orderstatus AS s, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS v FROM orders) "
    + " UNION ALL ".join(f"SELECT '{c}' AS name, count(*) - count({c}) AS null_count, round((count(*) - count({c})) / count(*), 4) AS null_ratio, count(DISTINCT {c}) AS unique_count, round(count(DISTINCT {c}) / count(*), 4) AS unique_ratio FROM t" for c in "psv")
)
def profile_nulls_unique(spark: SparkSession, d: str) -> DataFrame:
    df = _table(spark, d, "orders", f"{PRIORITY} AS p", "o_orderstatus AS s", "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS v")
    rows, by = M.measure(df)
    return spark.createDataFrame([(c, m["nulls"], round(m["nulls"] / rows, 4), m["distinct"], round(m["distinct"] / rows, 4)) for c, m in by.items()], "name string, null_count long, null_ratio double, unique_count long, unique_ratio double")


@query("SELECT round(avg(length(text)), 4) AS avg_length, min(length(text)) AS min_length, max(length(text)) AS max_length FROM documents")
def profile_lengths(spark: SparkSession, d: str) -> DataFrame:
    df = _table(spark, d, "documents", "text")
    a = M.column_aggregates("text", df.schema["text"].dataType)
    return df.agg(F.round(a["avg_length"], 4).alias("avg_length"), a["min_length"].cast("long").alias("min_length"), a["max_length"].cast("long").alias("max_length"))


@query("SELECT count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS duplicate_rows FROM lineitem")
def profile_duplicates(spark: SparkSession, d: str) -> DataFrame:
    n = M.duplicate_rows(_table(spark, d, "lineitem", "l_orderkey", "l_linenumber"))
    return spark.createDataFrame([(n,)], "duplicate_rows long")


_CONTACT = "CASE WHEN c_custkey % 4 = 0 THEN concat('user', CAST(c_custkey AS VARCHAR(20)), '@mail.example') WHEN c_custkey % 4 = 1 THEN concat('+1 (555) 010-', CAST(1000 + c_custkey % 9000 AS VARCHAR(20))) WHEN c_custkey % 4 = 2 THEN concat('10.0.0.', CAST(c_custkey % 250 AS VARCHAR(20))) ELSE CAST(10000 + c_custkey % 80000 AS VARCHAR(20)) END"
_PATTERN_SQL = ", ".join("round(avg(CAST(regexp_matches(v, '{}') AS INT)), 6) AS {}".format(p.replace("'", "''"), k) for k, p in VALUE_PATTERNS.items())


@query(f"WITH t AS (SELECT 'url' AS name, url AS v FROM pages UNION ALL SELECT 'contact', {_CONTACT} FROM customer) SELECT name, count(*) AS n, {_PATTERN_SQL} FROM t GROUP BY name")
def profile_patterns(spark: SparkSession, d: str) -> DataFrame:
    values = _table(spark, d, "pages", "'url' AS column", "url AS value").unionAll(_table(spark, d, "customer", "'contact' AS column", f"{_CONTACT} AS value"))
    found = detect_patterns(values)
    return found.select(F.col("column").alias("name"), "n", *[F.round(k, 6).alias(k) for k in VALUE_PATTERNS])


@query(f"WITH t AS (SELECT {_dates(False)} AS v FROM orders) SELECT count(*) AS n, round(avg(CAST(try_strptime(v, '%Y-%m-%d') IS NOT NULL AS INT)), 6) AS iso, round(avg(CAST(try_strptime(v, '%m/%d/%Y') IS NOT NULL AS INT)), 6) AS us, round(avg(CAST(try_strptime(v, '%b %d, %Y') IS NOT NULL AS INT)), 6) AS named FROM t")
def profile_dates(spark: SparkSession, d: str) -> DataFrame:
    values = _table(spark, d, "orders", "'o' AS column", f"{_dates(True)} AS value")
    r = detect_patterns(values)
    share = lambda f: F.round(f"date{list(DATE_FORMATS).index(f)}", 6)
    return r.select("n", share("%Y-%m-%d").alias("iso"), share("%m/%d/%Y").alias("us"), share("%b %d, %Y").alias("named"))


# --- detectors ----------------------------------------------------------------------------------------------------

_COUNTS = {"missing_values": "null_count", "empty_strings": "empty_string_count", "duplicate_rows": "duplicate_count", "outliers": "outlier_count", "inconsistent_date_format": "total_matched"}
_FOUND = "issue_type string, columns string, severity string, confidence double, n long"


def _found(df: DataFrame, detector: str, **config: object) -> DataFrame:
    """The findings of one detector as rows."""
    rows, by = M.measure(df)
    p = profile(df, measured=(rows, by))
    found = run_detectors(Context(df, p, by, DetectorConfig(enabled=[detector], **config)))
    count = lambda f: f.details["leading_spaces"] + f.details["trailing_spaces"] if f.issue_type == "whitespace_padding" else len(f.details["values"]) if f.issue_type == "boolean_as_string" else sum(map(bool, f.details.values())) if f.issue_type == "inconsistent_case" else f.details.get(_COUNTS.get(f.issue_type, ""), 0)
    return df.sparkSession.createDataFrame([(f.issue_type, ",".join(f.columns), f.severity.value, round(f.confidence, 6), int(count(f))) for f in found], _FOUND)


def _severity(share: str, high: float, medium: float) -> str:
    return f"CASE WHEN {share} > {high} THEN 'high' WHEN {share} > {medium} THEN 'medium' ELSE 'low' END"


@query(f"WITH t AS (SELECT {PRIORITY} AS p FROM orders), c AS (SELECT count(*) - count(p) AS n, (count(*) - count(p)) / count(*) AS r FROM t) SELECT 'missing_values' AS issue_type, 'p' AS columns, {_severity('r', 0.5, 0.1)} AS severity, CAST(1 AS DOUBLE) AS confidence, n FROM c WHERE n > 0")
def detect_missing(spark: SparkSession, d: str) -> DataFrame:
    return _found(_table(spark, d, "orders", "o_orderkey", f"{PRIORITY} AS p"), "missing")


@query(
    f"WITH t AS (SELECT {BLANKS} AS b FROM customer), c AS (SELECT count(*) FILTER (trim(b) = '') AS n, count(*) - count(b) AS m, (count(*) - count(b)) / count(*) AS r FROM t) "
    f"SELECT 'empty_strings' AS issue_type, 'b' AS columns, 'medium' AS severity, CAST(0.9 AS DOUBLE) AS confidence, n FROM c WHERE n > 0 UNION ALL SELECT 'missing_values', 'b', {_severity('r', 0.5, 0.1)}, 1, m FROM c WHERE m > 0"
)
def detect_empty(spark: SparkSession, d: str) -> DataFrame:
    return _found(_table(spark, d, "customer", "c_custkey", f"{BLANKS} AS b"), "missing")


@query(
    "WITH t AS (SELECT p_brand, p_size FROM part), g AS (SELECT count(*) AS k FROM t GROUP BY p_brand, p_size), c AS (SELECT sum(k - 1) AS n, sum(k - 1) / sum(k) AS r FROM g) "
    f"SELECT 'duplicate_rows' AS issue_type, 'p_brand,p_size' AS columns, {_severity('r', 0.1, 0.01)} AS severity, CAST(1 AS DOUBLE) AS confidence, CAST(n AS BIGINT) AS n FROM c WHERE n > 0"
)
def detect_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return _found(_table(spark, d, "part", "p_brand", "p_size"), "duplicates")


@query(
    f"WITH t AS (SELECT {CASED} AS c FROM customer), f AS (SELECT CAST(bool_or(c = upper(c) AND c <> lower(c)) AS INT) + CAST(bool_or(c = lower(c) AND c <> upper(c)) AS INT) AS n FROM t) "
    "SELECT 'inconsistent_case' AS issue_type, 'c' AS columns, 'low' AS severity, CAST(0.8 AS DOUBLE) AS confidence, CAST(n AS BIGINT) AS n FROM f WHERE n >= 2"
)
def detect_case(spark: SparkSession, d: str) -> DataFrame:
    return _found(_table(spark, d, "customer", f"{CASED} AS c"), "formats")


@query(f"WITH t AS (SELECT {_dates(False)} AS v FROM orders) SELECT 'inconsistent_date_format' AS issue_type, 'v' AS columns, 'medium' AS severity, CAST(0.85 AS DOUBLE) AS confidence, count(*) AS n FROM t")
def detect_dates(spark: SparkSession, d: str) -> DataFrame:
    return _found(_table(spark, d, "orders", f"{_dates(True)} AS v"), "formats").filter("issue_type = 'inconsistent_date_format'")


@query(f"WITH t AS (SELECT {PADDED} AS v FROM customer) SELECT 'whitespace_padding' AS issue_type, 'v' AS columns, 'low' AS severity, CAST(1 AS DOUBLE) AS confidence, count(*) FILTER (v <> ltrim(v)) + count(*) FILTER (v <> rtrim(v)) AS n FROM t")
def detect_whitespace(spark: SparkSession, d: str) -> DataFrame:
    return _found(_table(spark, d, "customer", f"{PADDED} AS v"), "formats").filter("issue_type = 'whitespace_padding'")


def _outlier_sql(fence: str) -> str:
    return f"WITH q AS ({fence}), c AS (SELECT count(*) FILTER (value < lo OR value > hi) AS n, count(*) FILTER (value < lo OR value > hi) / count(value) AS r FROM events, q) SELECT 'outliers' AS issue_type, 'value' AS columns, {_severity('r', 0.05, 0.01)} AS severity, CAST(0.85 AS DOUBLE) AS confidence, n FROM c WHERE n > 0"


@query(_outlier_sql("SELECT quantile_cont(value, 0.25) - 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS lo, quantile_cont(value, 0.75) + 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS hi FROM events"))
def detect_outliers_iqr(spark: SparkSession, d: str) -> DataFrame:
    return _found(_table(spark, d, "events", "value"), "outliers")


@query(_outlier_sql("SELECT avg(value) - 3 * stddev_samp(value) AS lo, avg(value) + 3 * stddev_samp(value) AS hi FROM events"))
def detect_outliers_zscore(spark: SparkSession, d: str) -> DataFrame:
    return _found(_table(spark, d, "events", "value"), "outliers", outlier_method="zscore", outlier_threshold=3.0)


_IS_NUMBER = r"regexp_matches(v, '^\s*[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\s*$')"


@query(f"WITH t AS (SELECT {JUNK} AS v FROM lineitem), c AS (SELECT avg(CAST({_IS_NUMBER} AS INT)) AS r FROM t) SELECT 'numeric_as_string' AS issue_type, 'v' AS columns, 'medium' AS severity, round(r, 6) AS confidence, CAST(0 AS BIGINT) AS n FROM c WHERE r > 0.8")
def detect_numeric_string(spark: SparkSession, d: str) -> DataFrame:
    return _found(_table(spark, d, "lineitem", f"{JUNK} AS v"), "types")


@query(f"WITH t AS (SELECT DISTINCT lower(trim({FLAG})) AS v FROM lineitem), c AS (SELECT count(*) AS n, bool_and(v IN ('true','yes','y','1','t','on','false','no','n','0','f','off')) AS ok FROM t) SELECT 'boolean_as_string' AS issue_type, 'v' AS columns, 'low' AS severity, CAST(0.95 AS DOUBLE) AS confidence, n FROM c WHERE ok AND n >= 2")
def detect_boolean_string(spark: SparkSession, d: str) -> DataFrame:
    return _found(_table(spark, d, "lineitem", f"{FLAG} AS v"), "types")


@query(
    "WITH v AS (SELECT DISTINCT 'c_nationkey' AS c, CAST(c_nationkey AS VARCHAR) AS x FROM customer UNION ALL SELECT DISTINCT 'c_nation_key', CAST(CASE WHEN c_nationkey < 20 THEN c_nationkey ELSE c_nationkey + 100 END AS VARCHAR) FROM customer UNION ALL SELECT DISTINCT 'c_mktsegment', c_mktsegment FROM customer), "
    "n AS (SELECT c, count(*) AS k FROM v GROUP BY c), b AS (SELECT l.c AS a, r.c AS b, count(*) AS m FROM v l JOIN v r ON l.x = r.x AND l.c < r.c GROUP BY 1, 2), "
    "s AS (SELECT a, b, m / (x.k + y.k - m) AS j, 1 - levenshtein(a, b) / greatest(length(a), length(b)) AS s FROM b JOIN n x ON x.c = a JOIN n y ON y.c = b) "
    "SELECT 'similar_columns' AS issue_type, 'c_nationkey,c_nation_key' AS columns, CASE WHEN 0.4 * s + 0.6 * j > 0.8 THEN 'medium' ELSE 'low' END AS severity, round(0.4 * s + 0.6 * j, 6) AS confidence, CAST(0 AS BIGINT) AS n FROM s WHERE 0.4 * s + 0.6 * j >= 0.6"
)
def detect_similar(spark: SparkSession, d: str) -> DataFrame:
    return _found(_table(spark, d, "customer", "c_nationkey", "CASE WHEN c_nationkey < 20 THEN c_nationkey ELSE c_nationkey + 100 END AS c_nation_key", "c_mktsegment"), "similarity")


@query(
    "WITH v AS (SELECT DISTINCT 'p_brand' AS c, p_brand AS x FROM part UNION ALL SELECT DISTINCT 'p_type', p_type FROM part UNION ALL SELECT DISTINCT 'brand2', CASE WHEN p_size < 40 THEN p_brand ELSE p_type END FROM part), n AS (SELECT c, count(*) AS k FROM v GROUP BY c) "
    "SELECT l.c AS a, r.c AS b, round(count(*) / (max(x.k) + max(y.k) - count(*)), 6) AS jaccard FROM v l JOIN v r ON l.x = r.x AND l.c < r.c JOIN n x ON x.c = l.c JOIN n y ON y.c = r.c GROUP BY 1, 2"
)
def column_jaccard(spark: SparkSession, d: str) -> DataFrame:
    values = distinct_values(_table(spark, d, "part", "p_brand", "p_type", "CASE WHEN p_size < 40 THEN p_brand ELSE p_type END AS brand2"), ["p_brand", "p_type", "brand2"])
    return value_similarity(values).withColumn("jaccard", F.round("jaccard", 6))


_SETS = ("p_brand", "p_type", "CASE WHEN p_size < 48 THEN p_brand ELSE p_type END AS brand2")
_SETS_SQL = "WITH v AS (SELECT DISTINCT 'p_brand' AS c, p_brand AS x FROM part UNION ALL SELECT DISTINCT 'p_type', p_type FROM part UNION ALL SELECT DISTINCT 'brand2', CASE WHEN p_size < 48 THEN p_brand ELSE p_type END FROM part), s AS (SELECT c, i, min(md5(i || ':' || x)) AS h FROM v, range(20) AS r(i) GROUP BY c, i)"


def _signatures(spark: SparkSession, d: str) -> DataFrame:
    values = distinct_values(_table(spark, d, "part", *_SETS), ["p_brand", "p_type", "brand2"])
    return minhash(values, 20, lambda v, seed: F.md5(F.concat(F.lit(f"{seed}:"), v)))


@query(f"{_SETS_SQL} SELECT c AS name, i, h FROM s")
def minhash_signature(spark: SparkSession, d: str) -> DataFrame:
    """The operator with a hash that both engines have."""
    return _signatures(spark, d).select(F.col("column").alias("name"), F.posexplode("signature").alias("i", "h")).withColumn("i", F.col("i").cast("long"))


@query(f"{_SETS_SQL}, k AS (SELECT c, i // 2 AS band, string_agg(h, '' ORDER BY i) AS h FROM s GROUP BY c, i // 2) SELECT DISTINCT l.c AS a, r.c AS b FROM k l JOIN k r ON l.band = r.band AND l.h = r.h AND l.c < r.c")
def lsh_candidates(spark: SparkSession, d: str) -> DataFrame:
    return band_pairs(_signatures(spark, d), bands=10)


@query("SELECT typeof(1::TINYINT) = 'TINYINT' AS narrowed, count(*) AS n, sum(p_size) AS sizes FROM part")
def narrow_types(spark: SparkSession, d: str) -> DataFrame:
    """Whether sizes fit one byte, and that nothing is lost."""
    out = narrow(_table(spark, d, "part", "p_size"))
    return out.agg(F.lit(out.schema["p_size"].dataType.simpleString() == "tinyint").alias("narrowed"), F.count("*").alias("n"), F.sum("p_size").alias("sizes"))


@query("SELECT l.n_name AS a, r.n_name AS b, round(CASE WHEN abs(length(l.n_name) - length(r.n_name)) / greatest(length(l.n_name), length(r.n_name)) > 0.3 THEN 0 ELSE 1 - levenshtein(l.n_name, r.n_name) / greatest(length(l.n_name), length(r.n_name)) END, 6) AS similarity FROM nation l JOIN nation r ON l.n_regionkey = r.n_regionkey AND l.n_name < r.n_name")
def name_similarities(spark: SparkSession, d: str) -> DataFrame:
    n = _table(spark, d, "nation", "n_name", "n_regionkey")
    pairs = n.withColumnRenamed("n_name", "a").join(n.withColumnRenamed("n_name", "b"), "n_regionkey").filter("a < b")
    return pairs.select("a", "b", F.round(name_similarity(F.col("a"), F.col("b")).cast("double"), 6).alias("similarity"))


@query("SELECT p_partkey, p_name = upper(p_name) AND p_name <> lower(p_name) AS is_upper, p_name = lower(p_name) AND p_name <> upper(p_name) AS is_lower, p_name = array_to_string(list_transform(regexp_extract_all(p_name, '([A-Za-z]+|[^A-Za-z]+)'), lambda x: upper(x[1]) || lower(x[2:])), '') AND lower(p_name) <> upper(p_name) AS is_title FROM part")
def case_predicates(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("p_name")
    return _table(spark, d, "part").select("p_partkey", is_upper(c).alias("is_upper"), is_lower(c).alias("is_lower"), is_title(c).alias("is_title"))


# --- transformations ----------------------------------------------------------------------------------------------


@query(f"WITH t AS (SELECT o_orderkey, {PRIORITY} AS p FROM orders) SELECT * FROM t WHERE p IS NOT NULL")
def missing_drop_rows(spark: SparkSession, d: str) -> DataFrame:
    return transform("missing", _table(spark, d, "orders", "o_orderkey", f"{PRIORITY} AS p"), strategy="drop_rows")


@query(f"WITH t AS (SELECT c_custkey, {BALANCE} AS b FROM customer) SELECT c_custkey, round(coalesce(b, (SELECT quantile_cont(b, 0.5) FROM t)), 4) AS b FROM t")
def fill_median(spark: SparkSession, d: str) -> DataFrame:
    return transform("missing", _table(spark, d, "customer", "c_custkey", f"{BALANCE} AS b"), columns=["b"], strategy="fill_median").withColumn("b", F.round("b", 4))


@query(f"WITH t AS (SELECT o_orderkey, {PRIORITY} AS p FROM orders) SELECT o_orderkey, coalesce(p, (SELECT p FROM t WHERE p IS NOT NULL GROUP BY p ORDER BY count(*) DESC, p LIMIT 1)) AS p FROM t")
def fill_mode(spark: SparkSession, d: str) -> DataFrame:
    return transform("missing", _table(spark, d, "orders", "o_orderkey", f"{PRIORITY} AS p"), columns=["p"], strategy="fill_mode")


@query(f"SELECT o_orderkey, coalesce({PRIORITY}, 'UNKNOWN') AS p FROM orders")
def fill_value(spark: SparkSession, d: str) -> DataFrame:
    return transform("missing", _table(spark, d, "orders", "o_orderkey", f"{PRIORITY} AS p"), columns=["p"], strategy="fill_value", fill_value="UNKNOWN")


@query(f"SELECT c_custkey, nullif({BLANKS}, '') AS b FROM customer")
def empty_to_nan(spark: SparkSession, d: str) -> DataFrame:
    return transform("missing", _table(spark, d, "customer", "c_custkey", f"{BLANKS} AS b"), columns=["b"], strategy="empty_to_nan")


@query(f"WITH t AS (SELECT c_custkey, nullif(trim({BLANKS}), '') AS b FROM customer) SELECT c_custkey, coalesce(b, (SELECT b FROM t WHERE b IS NOT NULL GROUP BY b ORDER BY count(*) DESC, b LIMIT 1)) AS b FROM t")
def clean_empty(spark: SparkSession, d: str) -> DataFrame:
    return transform("missing", _table(spark, d, "customer", "c_custkey", f"{BLANKS} AS b"), columns=["b"], strategy="clean_empty_strings")


@query("WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events) SELECT event_id, round(least(greatest(value, a - 1.5 * (b - a)), b + 1.5 * (b - a)), 4) AS value FROM events, q")
def clip_iqr(spark: SparkSession, d: str) -> DataFrame:
    return transform("missing", _table(spark, d, "events", "event_id", "value"), columns=["value"], strategy="clip_outliers").withColumn("value", F.round("value", 4))


@query("WITH q AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events) SELECT event_id, round(least(greatest(value, m - 2 * s), m + 2 * s), 4) AS value FROM events, q")
def clip_zscore(spark: SparkSession, d: str) -> DataFrame:
    return transform("missing", _table(spark, d, "events", "event_id", "value"), columns=["value"], strategy="clip_outliers", method="zscore", threshold=2.0).withColumn("value", F.round("value", 4))


def _dedup(keep: object) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: transform("duplicates", _table(spark, d, "events", "event_id", "user_id", "event_type"), keep=keep, subset=["user_id", "event_type"], order_by=["event_id"])


@query("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r FROM events) WHERE r = 1")
def dedup_first(spark: SparkSession, d: str) -> DataFrame:
    return _dedup("first")(spark, d)


@query("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def dedup_last(spark: SparkSession, d: str) -> DataFrame:
    return _dedup("last")(spark, d)


@query("SELECT event_id, user_id, event_type FROM (SELECT *, count(*) OVER (PARTITION BY user_id, event_type) AS c FROM events) WHERE c = 1")
def dedup_none(spark: SparkSession, d: str) -> DataFrame:
    return _dedup(False)(spark, d)


@query("SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def dedup_rows(spark: SparkSession, d: str) -> DataFrame:
    return transform("duplicates", _table(spark, d, "lineitem", "l_orderkey", "l_linenumber"))


@query(f"WITH t AS (SELECT {LINE}, {JUNK} AS v FROM lineitem) SELECT {LINE}, CASE WHEN {_IS_NUMBER} THEN try_cast(trim(v) AS DOUBLE) END AS v FROM t")
def types_numeric(spark: SparkSession, d: str) -> DataFrame:
    return transform("types", _table(spark, d, "lineitem", *LINE.split(", "), f"{JUNK} AS v"), columns=["v"], target_type="numeric")


@query(f"WITH t AS (SELECT {LINE}, lower(trim({WORDY})) AS v FROM lineitem) SELECT {LINE}, CASE WHEN v IN ('true','yes','y','1','t','on') THEN true WHEN v IN ('false','no','n','0','f','off') THEN false END AS v FROM t")
def types_boolean(spark: SparkSession, d: str) -> DataFrame:
    return transform("types", _table(spark, d, "lineitem", *LINE.split(", "), f"{WORDY} AS v"), columns=["v"], target_type="boolean")


#: A date in each of the families that a column may mix, two-digit years and a time of day included.
_SPELT = "CASE o_orderkey % 9 WHEN 0 THEN 'soon' WHEN 1 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 2 THEN date_format(o_orderdate, 'MM/dd/yyyy') WHEN 3 THEN date_format(o_orderdate, 'MM/dd/yy') WHEN 4 THEN date_format(o_orderdate, 'd-MMM-yyyy') WHEN 5 THEN date_format(o_orderdate, 'dd-MMM-yy') WHEN 6 THEN date_format(o_orderdate, 'MMMM d, yyyy') WHEN 7 THEN date_format(o_orderdate, 'd MMM yyyy') ELSE date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss\") END AS v"


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS v FROM orders")
def types_datetime(spark: SparkSession, d: str) -> DataFrame:
    df = _table(spark, d, "orders", "o_orderkey", _SPELT)
    return transform("types", df, columns=["v"], target_type="datetime").withColumn("v", F.date_format("v", "yyyy-MM-dd"))


@query("SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS v FROM customer")
def types_string(spark: SparkSession, d: str) -> DataFrame:
    return transform("types", _table(spark, d, "customer", "c_custkey", "c_nationkey AS v"), columns=["v"], target_type="string")


@query(f"SELECT c_custkey, trim({PADDED}) AS v FROM customer")
def fmt_strip(spark: SparkSession, d: str) -> DataFrame:
    return transform("formats", _table(spark, d, "customer", "c_custkey", f"{PADDED} AS v"), columns=["v"], operation="strip_whitespace")


@query("SELECT p_partkey, lower(p_name) AS v FROM part")
def fmt_lower(spark: SparkSession, d: str) -> DataFrame:
    return transform("formats", _table(spark, d, "part", "p_partkey", "p_name AS v"), columns=["v"], operation="lowercase")


@query("SELECT p_partkey, upper(p_name) AS v FROM part")
def fmt_upper(spark: SparkSession, d: str) -> DataFrame:
    return transform("formats", _table(spark, d, "part", "p_partkey", "p_name AS v"), columns=["v"], operation="uppercase")


@query("SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(p_name, '([A-Za-z]+|[^A-Za-z]+)'), lambda x: upper(x[1]) || lower(x[2:])), '') AS v FROM part")
def fmt_title(spark: SparkSession, d: str) -> DataFrame:
    return transform("formats", _table(spark, d, "part", "p_partkey", "p_name AS v"), columns=["v"], operation="titlecase")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'soon' ELSE strftime(o_orderdate, '%d.%m.%Y') END AS v FROM orders")
def fmt_dates(spark: SparkSession, d: str) -> DataFrame:
    df = _table(spark, d, "orders", "o_orderkey", _SPELT)
    return transform("formats", df, columns=["v"], operation="standardize_dates", target_format="%d.%m.%Y")


@query("SELECT n_nationkey, n_name FROM nation")
def col_drop(spark: SparkSession, d: str) -> DataFrame:
    return transform("columns", _table(spark, d, "nation"), columns=["n_regionkey", "not_there"])


@query("SELECT n_nationkey AS id, n_name AS name, n_regionkey FROM nation")
def col_rename(spark: SparkSession, d: str) -> DataFrame:
    return transform("columns", _table(spark, d, "nation"), operation="rename", mapping={"n_nationkey": "id", "n_name": "name", "gone": "x"})


@query("SELECT c_custkey, c_name || '/' || c_mktsegment AS who FROM customer")
def col_merge(spark: SparkSession, d: str) -> DataFrame:
    return transform("columns", _table(spark, d, "customer", "c_custkey", "c_name", "c_mktsegment"), operation="merge", columns=["c_name", "c_mktsegment"], new_name="who", separator="/")


@query(f"SELECT c_custkey, lower(trim({PADDED})) AS v FROM customer")
def cat_normalize(spark: SparkSession, d: str) -> DataFrame:
    return transform("categories", _table(spark, d, "customer", "c_custkey", f"{PADDED} AS v"), columns=["v"])


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' ELSE o_orderstatus END AS v FROM orders")
def cat_mapping(spark: SparkSession, d: str) -> DataFrame:
    return transform("categories", _table(spark, d, "orders", "o_orderkey", "o_orderstatus AS v"), columns=["v"], mapping={"O": "open", "F": "filled"})


# --- samples, plans, scores, whole runs ---------------------------------------------------------------------------


@query(
    "WITH n AS (SELECT count(*) AS n FROM events), g AS (SELECT event_type, greatest(1, CAST(floor(1000 * count(*) / (SELECT n FROM n)) AS BIGINT)) AS take FROM events GROUP BY event_type), "
    "r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY md5(CAST(event_id AS VARCHAR))) AS i FROM events) SELECT event_id, r.event_type FROM r JOIN g ON r.event_type = g.event_type WHERE i <= take"
)
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    df = _table(spark, d, "events", "event_id", "event_type")
    return stratified(df, "event_type", 1000, [F.md5(F.col("event_id").cast("string")), F.col("event_id").cast("string")])


_MESSY = ("c_custkey", f"{PADDED} AS name", f"{BALANCE} AS balance", f"{FLAG.replace('l_returnflag', 'c_mktsegment').replace(chr(39) + 'A' + chr(39), chr(39) + 'BUILDING' + chr(39)).replace(chr(39) + 'N' + chr(39), chr(39) + 'MACHINERY' + chr(39))} AS active")


@query(
    f"WITH t AS (SELECT {', '.join(_MESSY)} FROM customer), m AS (SELECT (count(*) - count(balance)) / count(*) AS r, quantile_cont(balance, 0.25) AS a, quantile_cont(balance, 0.75) AS b FROM t), "
    "o AS (SELECT count(*) FILTER (balance < a - 1.5 * (b - a) OR balance > b + 1.5 * (b - a)) / count(balance) AS r FROM t, m) "
    "SELECT CAST(floor(100 - 2 * 0.8 - 2 * 1.0 - CASE WHEN m.r > 0.5 THEN 10 WHEN m.r > 0.1 THEN 5 ELSE 2 END - CASE WHEN o.r = 0 THEN 0 WHEN o.r > 0.05 THEN 8.5 WHEN o.r > 0.01 THEN 4.25 ELSE 1.7 END - 2 * 0.95) AS BIGINT) AS score FROM m, o"
)
def quality_scores(spark: SparkSession, d: str) -> DataFrame:
    """Findings: padding and case of names or of flags, missing balances, outliers, booleans as text."""
    p, found = examine(_table(spark, d, "customer", *_MESSY), Config(detectors=DetectorConfig(enabled=["duplicates", "formats", "missing", "outliers", "types"])))
    return spark.createDataFrame([(quality_score(found, p.row_count),)], "score long")


_ISSUES = [("missing_values", "a", "medium", 1.0), ("inconsistent_case", "b", "low", 0.8), ("boolean_as_string", "b", "low", 0.95), ("outliers", "c", "high", 0.85), ("whitespace_padding", "d", "low", 1.0), ("inconsistent_case", "d", "low", 0.8), ("duplicate_rows", "a,b,c,d", "low", 1.0)]


@query(
    f"WITH f AS (SELECT * FROM (VALUES {', '.join(f'({i}, {x[0]!r}, {x[1]!r}, {x[2]!r}, {x[3]})' for i, x in enumerate(_ISSUES))}) AS v(i, issue, cols, severity, confidence)), "
    "k AS (SELECT * FROM f WHERE NOT (issue = 'inconsistent_case' AND EXISTS (SELECT 1 FROM f g WHERE g.issue IN ('boolean_as_string', 'numeric_as_string', 'inconsistent_date_format') AND g.cols = f.cols))), "
    "p AS (SELECT *, CASE WHEN issue = 'duplicate_rows' AND severity = 'low' THEN 'medium' WHEN issue = 'missing_values' AND severity = 'medium' THEN 'high' ELSE severity END AS priority FROM k), "
    "s AS (SELECT *, 0.5 * CASE priority WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END + 0.5 * confidence AS score FROM p) "
    "SELECT row_number() OVER (ORDER BY score DESC, i) AS id, issue, cols, priority, round(score, 6) AS score FROM s"
)
def suggestion_plan(spark: SparkSession, d: str) -> DataFrame:
    """Ranked suggestions for machine learning from fixed findings."""
    found = [Finding("x", issue, Severity(severity), cols.split(","), {"null_ratio": 0.2}, confidence=c) for issue, cols, severity, c in _ISSUES]
    made = suggest(found, use_case="ml")
    return spark.createDataFrame([(s.id, s.finding.issue_type, ",".join(s.finding.columns), s.priority.value, round(priority_score(s), 6)) for s in made], "id long, issue string, cols string, priority string, score double")


@query(
    f"WITH t AS (SELECT DISTINCT {', '.join(_MESSY)} FROM customer), n AS (SELECT c_custkey, lower(trim(name)) AS name, balance, lower(trim(active)) AS active FROM t), "
    "f AS (SELECT c_custkey, name, coalesce(balance, (SELECT quantile_cont(balance, 0.5) FROM n)) AS balance, active IN ('true','yes') AS active FROM n), q AS (SELECT quantile_cont(balance, 0.25) AS a, quantile_cont(balance, 0.75) AS b FROM f) "
    "SELECT c_custkey, name, round(least(greatest(balance, a - 1.5 * (b - a)), b + 1.5 * (b - a)), 4) AS balance, active FROM f, q"
)
def end_to_end_clean(spark: SparkSession, d: str) -> DataFrame:
    """Duplicates, padding, case, missing balances, booleans, outliers, one after the other."""
    df = _table(spark, d, "customer", *_MESSY)
    steps = [("duplicates", {}), ("formats", {"columns": ["name"], "operation": "strip_whitespace"}), ("formats", {"columns": ["name"], "operation": "lowercase"}), ("missing", {"columns": ["balance"], "strategy": "fill_median"}), ("types", {"columns": ["active"], "target_type": "boolean"}), ("missing", {"columns": ["balance"], "strategy": "clip_outliers"})]
    for name, params in steps:
        df = transform(name, df, **params)
    return df.withColumn("balance", F.round("balance", 4))


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey, format FROM nation, (VALUES ('csv'), ('tsv'), ('json'), ('parquet')) AS f(format)")
def sources_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A table written and read again in every format."""
    df = _table(spark, d, "nation")
    base = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp()
    out = []
    for f in ("csv", "tsv", "json", "parquet"):
        path = f"{base}/nation-round-trip.{f}"
        save(df, path)
        out.append(load(spark, path).select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("long").alias("n_regionkey"), F.lit(f).alias("format")))
    return reduce(DataFrame.unionAll, out)
