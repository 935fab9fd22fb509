"""Columns that are alike by name and by values.

Pairs that share two bigrams of their names, or a band of MinHash values of their distinct values, are candidates; a
candidate's score is 0.4 * similarity of names + 0.6 * Jaccard similarity of values.  The values are joined on
equality; what comes to the driver has a row for each candidate pair.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import metrics as M

HASHES, BANDS = 100, 20
#: Columns of more distinct values are compared by name alone.
MOST_VALUES = 10_000
#: Names whose lengths differ by a larger share are not alike.
LENGTH_SHARE = 0.3
NAME_WEIGHT, VALUE_WEIGHT, LEAST_SCORE = 0.4, 0.6, 0.6


def bigrams(name: str) -> set[str]:
    s = name.lower()
    return {s[i : i + 2] for i in range(len(s) - 1)} if len(s) > 1 else {s}


def name_candidates(names: list[str]) -> set[tuple[str, str]]:
    """Pairs (in the columns' order) that share two bigrams or more."""
    by_gram: dict[str, list[int]] = {}
    shared: dict[tuple[int, int], int] = {}
    for i, n in enumerate(names):
        for g in sorted(bigrams(n)):
            for j in by_gram.get(g, []):
                shared[j, i] = shared.get((j, i), 0) + 1
            by_gram.setdefault(g, []).append(i)
    return {(names[a], names[b]) for (a, b), n in shared.items() if n >= 2}


def name_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 0 at once where the lengths differ too much."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    apart = F.abs(F.char_length(a) - F.char_length(b)) / longest > LENGTH_SHARE
    return F.when(a == b, 1.0).when(apart, 0.0).otherwise(1 - F.levenshtein(a, b) / longest)


def distinct_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value): distinct values as text."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("p")).select("p.*").filter("value is not null").distinct()


def minhash(values: DataFrame, hashes: int = HASHES, hashed: Callable[[Column, int], Column] | None = None) -> DataFrame:
    """(column, signature): the least hash of a column's values under each of ``hashes`` seeds.  hashed: another hash of
    a value and a seed."""
    hashed = hashed or (lambda v, seed: F.xxhash64(v, F.lit(seed)))
    return values.groupBy("column").agg(F.array(*[F.min(hashed(F.col("value"), i)) for i in range(hashes)]).alias("signature"))


def band_pairs(signatures: DataFrame, bands: int = BANDS) -> DataFrame:
    """(a, b): columns whose signatures agree in a whole band."""
    rows = F.size("signature") / bands
    keys = signatures.select("column", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(F.slice("signature", (i * rows + 1).cast("int"), rows.cast("int"))))).alias("band", "key"))
    left, right = keys.withColumnRenamed("column", "a"), keys.withColumnRenamed("column", "b")
    return left.join(right, ["band", "key"]).filter("a < b").select("a", "b").distinct()


def value_similarity(values: DataFrame) -> DataFrame:
    """(a, b, jaccard) of every two columns (a < b) that share a value."""
    left, right = values.withColumnRenamed("column", "a"), values.withColumnRenamed("column", "b")
    both = left.join(right, "value").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("both"))
    sizes = values.groupBy("column").agg(F.count("*").alias("n"))
    out = both.join(sizes.select(F.col("column").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("column").alias("b"), F.col("n").alias("nb")), "b")
    return out.select("a", "b", (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("jaccard"))


def similar_columns(df: DataFrame, distinct: dict[str, int], least: float = LEAST_SCORE) -> list[tuple[str, str, float, float, float]]:
    """(a, b, name similarity, value similarity, score) of the pairs that reach ``least``, in the columns' order."""
    names = [c for c in df.columns if M.kind_of(df.schema[c].dataType) != "nested"]
    place = {c: i for i, c in enumerate(names)}
    small = [c for c in names if distinct[c] <= MOST_VALUES]
    jaccard: dict[tuple[str, str], float] = {}
    blocked: set[tuple[str, str]] = set()
    order = lambda a, b: (a, b) if place[a] < place[b] else (b, a)
    if len(small) > 1:
        values = distinct_values(df, small).cache()  # at most MOST_VALUES of a column
        blocked = {order(r["a"], r["b"]) for r in band_pairs(minhash(values)).collect()}
        jaccard = {order(r["a"], r["b"]): r["jaccard"] for r in value_similarity(values).collect()}
        values.unpersist()
        empty = [c for c in small if not distinct[c]]
        jaccard |= {order(a, b): 1.0 for i, a in enumerate(empty) for b in empty[i + 1 :]}
    # two columns whose sizes differ by half again can't be alike enough for the bands to be trusted
    fits = lambda a, b: max(distinct[a], distinct[b]) <= 1.5 * min(distinct[a], distinct[b])
    pairs = sorted(name_candidates(names) | {p for p in blocked if fits(*p)}, key=lambda p: (place[p[0]], place[p[1]]))
    if not pairs:
        return []
    spark = df.sparkSession
    rows = spark.createDataFrame([(a, b, float(jaccard.get((a, b), 0.0))) for a, b in pairs], "a string, b string, v double")
    rows = rows.withColumn("s", name_similarity(F.lower("a"), F.lower("b")))
    out = rows.withColumn("score", NAME_WEIGHT * F.col("s") + VALUE_WEIGHT * F.col("v")).filter(F.col("score") >= least - 1e-12).collect()
    return sorted(((r["a"], r["b"], r["s"], r["v"], r["score"]) for r in out), key=lambda r: (place[r[0]], place[r[1]]))
