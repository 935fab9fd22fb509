"""A sample of fixed size that keeps rows with missing values and every stratum, the same on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import any_missing
from .metrics import comparable, kind_of

THRESHOLD, SIZE, SEED = 50_000, 10_000, 42
MISSING_SHARE = 0.1
STRATA = (2, 20)


def row_order(df: DataFrame) -> list[Column]:
    """A hashed order of rows (two times 64 bits) that depends on their values alone."""
    values = [comparable(F.col(f"`{c}`"), df.schema[c].dataType) if kind_of(df.schema[c].dataType) != "nested" else F.to_json(F.array(F.col(f"`{c}`"))) for c in df.columns]
    return [F.xxhash64(*values, F.lit(i)) for i in (1, 2)]


def stratum_column(df: DataFrame) -> str | None:
    """The first column with between 2 and 20 distinct values."""
    names = [c for c in df.columns if kind_of(df.schema[c].dataType) != "nested"]
    return stratum_among(df, names, rough_counts(df, names)) if names else None


def rough_counts(df: DataFrame, names: list[str], *more: Column) -> list[int]:
    """Sketched numbers of distinct values, and what else one pass can count."""
    return list(df.agg(*[F.approx_count_distinct(comparable(F.col(f"`{c}`"), df.schema[c].dataType)).alias(f"a{i}") for i, c in enumerate(names)], *[m.alias(f"m{i}") for i, m in enumerate(more)]).first())


def stratum_among(df: DataFrame, names: list[str], rough: list[int]) -> str | None:
    """The sketch tells the many-valued columns apart; the sets of the few left, of some 2 * STRATA[1] values, are exact."""
    few = [c for c, n in zip(names, rough) if n <= 2 * STRATA[1]]
    if not few:
        return None
    exact = df.agg(*[F.size(F.collect_set(comparable(F.col(f"`{c}`"), df.schema[c].dataType))).alias(f"a{i}") for i, c in enumerate(few)]).first()
    return next((c for i, c in enumerate(few) if STRATA[0] <= exact[i] <= STRATA[1]), None)


def stratified(df: DataFrame, column: str, n: int, order: list[Column] | None = None) -> DataFrame:
    """max(1, floor(n * group / total)) rows of each group; rows without a group are left out."""
    rows = df.filter(F.col(f"`{column}`").isNotNull())
    sizes = rows.groupBy(F.col(f"`{column}`").alias("_stratum")).agg(F.count("*").alias("_size"))
    total = df.count()
    sizes = sizes.withColumn("_take", F.greatest(F.lit(1).cast("long"), F.floor(F.lit(n) * F.col("_size") / F.lit(total))))
    turn = F.row_number().over(Window.partitionBy("_stratum").orderBy("_o1", "_o2"))
    one, two = order or row_order(df)
    marked = rows.withColumns({"_stratum": F.col(f"`{column}`"), "_o1": one, "_o2": two}).join(sizes, "_stratum")
    # the fixed limit lets every task leave out what can't be among the first n before it shuffles
    return marked.withColumn("_turn", turn).filter(F.col("_turn") <= max(1, n)).filter(F.col("_turn") <= F.col("_take")).select(*[f"`{c}`" for c in df.columns])


class Sampler:
    """sample is the table itself below the threshold, or about ``size`` of its rows."""

    def __init__(self, df: DataFrame, size: int = SIZE, threshold: int = THRESHOLD):
        self.df, self.size = df, size
        self.rows = df.count()
        self.sampled = self.rows >= threshold
        # some ``size`` rows, which everything else reads
        self.sample = self._draw().coalesce(1).cache() if self.sampled else df
        self.sample_rows = self.sample.count() if self.sampled else self.rows

    def _draw(self) -> DataFrame:
        df, order = self.df, row_order(self.df)
        gaps = any_missing(df.schema, df.columns)
        some = df.filter(gaps).orderBy(*order).limit(int(self.size * MISSING_SHARE))
        names = [c for c in df.columns if kind_of(df.schema[c].dataType) != "nested"]
        *rough, found = rough_counts(df, names, F.count_if(gaps))
        held, rest = min(found, int(self.size * MISSING_SHARE)), df
        if held:
            # all rows but those taken, which come before the last one's key; of rows alike at that key as many are left as weren't taken
            one, two = order
            last = some.select(one.alias("a"), two.alias("b")).orderBy(F.desc("a"), F.desc("b")).first()
            at_last = (one == last["a"]) & (two == last["b"])
            taken = some.filter(at_last).count()
            alike = df.filter(gaps & at_last)
            left = alike.count() - taken
            rest = df.filter(~gaps | (one > last["a"]) | ((one == last["a"]) & (two > last["b"])))
            rest = rest.unionByName(alike.limit(left)) if left else rest
        column = stratum_among(rest, names, rough) if names else None
        n = self.size - held
        drawn = stratified(rest, column, n) if column else rest.orderBy(*order).limit(n)
        return some.unionByName(drawn) if held else drawn

    def extrapolate_count(self, n: int) -> int:
        return int(n * self.rows / self.sample_rows) if self.sample_rows else n
