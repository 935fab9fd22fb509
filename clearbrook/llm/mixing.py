"""Mixing sources to target weights by a low-discrepancy schedule.

Each slot of the schedule takes one block of a source.  Slot i has the point frac((i + 1) / golden ratio); the sources'
numbers of blocks, laid end to end, map a point to a source, and a slot's rank among its source's slots says which
block of that source it takes.  A source's documents stand in hashed order on one token line, which goes round EPOCHS
times at most, and the line is cut into blocks of equally many tokens.  Slots join blocks on (source, rank): what the mix
takes of a document, and when, follows from the slots that its blocks get.  The points are spread so evenly that a source
gets its number of slots within a few.

Nulls, ties, odd rows: a null text has no tokens; a null source is a source of its own, the last; rows with the same or a
null doc_id count each for themselves, ordered by doc_id, text and size (of equal rows it can't be told which is first); an
empty table, or one without any token, gives targets of 0 and takes nothing; a very long text is one row, cut by blocks as
any.  Columns besides doc_id, source and text are ignored by the operator.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, columns_of, written

GOLDEN = (math.sqrt(5) - 1) / 2
#: Slots that the schedule has, about; a source's block has its target / (its share of SLOTS) tokens, within the bounds below.
SLOTS = 65_536
MOST_BLOCK = 4_096
#: Blocks that a source's target is cut into at least, if it has that many tokens.
LEAST_BLOCKS = 1_024
#: A source gives each of its tokens so many times at most.
EPOCHS = 3
#: Rows of one shard of a source's line, about, so that no task has to order a whole source; least number of shards.
SHARD_ROWS = 65_536
LEAST_SHARDS = 256
#: Slots of one chunk when they are ranked.
CHUNK = 4_096
#: Bits of the hash that orders a source's documents.
ORDER_BITS = 60


def token_count(text: Column) -> Column:
    """Number of words (see WORD) of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def default_weights(names: list[str | None]) -> list[float]:
    """1, 2, 3, 1, 2, 3, ... over the names in code-point order, null last."""
    order = sorted(range(len(names)), key=lambda i: (names[i] is None, names[i] or ""))
    weights = [0.0] * len(names)
    for k, i in enumerate(order):
        weights[i] = float(k % 3 + 1)
    return weights


def capped_targets(sizes: list[int], weights: list[float], most: float = EPOCHS) -> list[float]:
    """Shares of sum(sizes) by weight, none above most * size: what a full source can't take goes to the others
    by their weights, again and again until nobody is above."""
    target = [0.0] * len(sizes)
    open_ = [i for i, s in enumerate(sizes) if s > 0 and weights[i] > 0]
    left = float(sum(sizes))
    while open_:
        total = math.fsum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / total > most * sizes[i]]
        if not full:
            for i in open_:
                target[i] = left * weights[i] / total
            break
        for i in full:
            target[i] = float(most * sizes[i])
        left -= math.fsum(target[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return target


def order_key(doc_id: Column, text: Column) -> Column:
    """ORDER_BITS bits of a hash of a row's doc_id and text."""
    joined = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, ORDER_BITS // 4), 16, 10).cast("long")


def block_sizes(targets: list[float], slots: int = SLOTS) -> list[tuple[int, int]]:
    """(tokens of a block, blocks) of each source."""
    whole = max(1, min(MOST_BLOCK, int(math.fsum(targets)) // slots))
    sizes = [max(1, min(whole, int(t) // LEAST_BLOCKS)) for t in targets]
    return [(b, int(math.floor(t / b + 0.5))) for t, b in zip(targets, sizes)]


def schedule(spark: SparkSession, blocks: list[int]) -> DataFrame:
    """(slot, sid, rank): the source, by its place in ``blocks``, that each slot's golden-ratio point falls to, and the
    slot's rank among that source's slots, from 0.  Ranks are added up over chunks of slots: no source is ordered whole."""
    bounds = [sum(blocks[: i + 1]) for i in range(len(blocks) - 1)]
    n_slots = sum(blocks)
    point = (F.col("slot") + 1) * F.lit(GOLDEN)
    place = (point - F.floor(point)) * F.lit(float(n_slots))
    sid = F.size(F.filter(F.array(*[F.lit(float(b)) for b in bounds]), lambda b: b <= place)) if bounds else F.lit(0)
    slots = spark.range(n_slots).withColumnRenamed("id", "slot").select("slot", F.floor(F.col("slot") / CHUNK).alias("chunk"), sid.alias("sid"))
    inner = slots.withColumn("rank", F.row_number().over(Window.partitionBy("chunk", "sid").orderBy("slot")) - 1)
    counts = slots.groupBy("sid", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("sid", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return inner.join(offsets, ["sid", "chunk"]).select("slot", "sid", (F.col("rank") + F.col("before")).alias("rank"))


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None, slots: int = SLOTS) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, first_slot (the first slot that takes of
    it; null if none does) and rid, a row number.

    weights: by source; without it 1, 2, 3, repeating.  The sources' totals, a row for each source, are the
    only thing that comes to the driver."""
    spark = docs.sparkSession
    rows = columns_of(docs, "doc_id", "source", "text").select("doc_id", "source", token_count(F.col("text")).alias("size"), order_key(F.col("doc_id"), F.col("text")).alias("at"))
    rows = written(rows.withColumn("rid", F.monotonically_increasing_id()), "mix-sizes")

    found = rows.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).collect()
    names, sizes = [r["source"] for r in found], [r["n"] for r in found]
    given = default_weights(names) if weights is None else [float(weights.get(s, 0)) for s in names]
    order = sorted(range(len(names)), key=lambda i: (names[i] is None, names[i] or ""))
    names, sizes, given = ([x[i] for i in order] for x in (names, sizes, given))
    target = capped_targets(sizes, given)
    blocks = block_sizes(target, slots)
    kinds = "sid int, s string, source_size long, target double, block long"
    sources = spark.createDataFrame([(i, names[i], int(sizes[i]), float(target[i]), blocks[i][0]) for i in range(len(names))], kinds)
    if not any(n for _, n in blocks):
        none = F.lit(None).cast("long")
        return rows.join(sources, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), none.alias("first_slot"), "rid")

    # the token line of each source: shards, by the hash's upper bits, end to end
    shards = max(LEAST_SHARDS, -(-sum(r["rows"] for r in found) // SHARD_ROWS))
    rows = rows.withColumn("shard", F.shiftright("at", ORDER_BITS - (shards - 1).bit_length()))
    starts = rows.groupBy("source", "shard").agg(F.sum("size").alias("n")).join(sources, F.col("source").eqNullSafe(F.col("s")))
    before = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("sid", "s", F.col("shard").alias("h"), "source_size", "target", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    line = rows.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("shard") == F.col("h")))
    within = Window.partitionBy("sid", "shard").orderBy("at", "doc_id", "size", "rid").rowsBetween(Window.unboundedPreceding, -1)
    line = written(line.withColumn("lo", F.col("start") + F.coalesce(F.sum("size").over(within), F.lit(0))).select("rid", "doc_id", "source", "size", "source_size", "target", "block", "sid", "lo"), "mix-line")
    plan = written(schedule(spark, [n for _, n in blocks]), "mix-schedule")

    # blocks: where a document stands in each round of its source's line, cut at the blocks' borders, as far as slots go
    had = plan.groupBy("sid").agg(F.count("*").alias("slots"))
    parts = line.filter("size > 0").join(F.broadcast(had), "sid").withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(EPOCHS - 1))))  # a row for each source
    parts = parts.withColumn("lo", F.col("lo") + F.col("round") * F.col("source_size")).filter(F.col("lo") < F.col("slots") * F.col("block"))
    last = F.least(F.floor((F.col("lo") + F.col("size") - 1) / F.col("block")), F.col("slots") - 1)
    parts = parts.select("rid", "sid", "block", "lo", (F.col("lo") + F.col("size")).alias("hi"), F.explode(F.sequence(F.floor(F.col("lo") / F.col("block")), last)).alias("rank"))
    parts = parts.select("rid", "sid", "rank", (F.least(F.col("hi"), (F.col("rank") + 1) * F.col("block")) - F.greatest(F.col("lo"), F.col("rank") * F.col("block"))).alias("n"))
    taken = parts.join(plan, ["sid", "rank"]).groupBy("rid").agg(F.sum("n").alias("taken"), F.min("slot").alias("first_slot"))
    return line.join(taken, "rid", "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot", "rid")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes, and from which slot on (see mix_sources)."""
    out = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "first_slot")


#: The same schedule over whole lines.  A source is full if the others' weights leave it more than EPOCHS times its size,
#: which happens in the order of size by weight.
OP5_SQL = rf"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS ord
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS n, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w,
    row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid
  FROM docs GROUP BY source
), ranked AS (
  SELECT *, CAST(sum(n) OVER () AS BIGINT) AS total,
    coalesce(sum(n) OVER before, 0) AS n_before, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS w_left
  FROM sources WHERE n > 0
  WINDOW before AS (ORDER BY n / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), full_ AS (
  SELECT *, w * (total - {EPOCHS} * n_before) > {EPOCHS} * n * w_left AS is_full FROM ranked
), targets AS (
  SELECT s.sid, s.source, s.n, CASE WHEN f.sid IS NULL THEN 0.0::DOUBLE WHEN f.is_full THEN CAST({EPOCHS} * s.n AS DOUBLE)
    ELSE CAST((SELECT any_value(total) FROM full_) - {EPOCHS} * coalesce((SELECT sum(n) FROM full_ WHERE is_full), 0) AS DOUBLE) * s.w
      / CAST((SELECT sum(w) FROM full_ WHERE NOT is_full) AS DOUBLE) END AS target
  FROM sources s LEFT JOIN full_ f USING (sid)
), blocks AS (
  SELECT *, CAST(greatest(1, least(greatest(1, least({MOST_BLOCK}, CAST(floor((SELECT sum(target) FROM targets)) AS BIGINT) // {SLOTS})),
    CAST(floor(target) AS BIGINT) // {LEAST_BLOCKS})) AS BIGINT) AS block FROM targets
), cut AS (
  SELECT *, CAST(floor(target / block + 0.5) AS BIGINT) AS blocks FROM blocks
), laid AS (
  SELECT *, CAST(sum(blocks) OVER (ORDER BY sid) AS DOUBLE) AS hi, CAST(sum(blocks) OVER (ORDER BY sid) - blocks AS DOUBLE) AS lo FROM cut
), slots AS (
  SELECT slot, ((slot + 1) * {GOLDEN!r}::DOUBLE - floor((slot + 1) * {GOLDEN!r}::DOUBLE)) * (SELECT max(hi) FROM laid) AS place
  FROM (SELECT unnest(range((SELECT CAST(sum(blocks) AS BIGINT) FROM cut))) AS slot)
), plan AS (
  SELECT slot, sid, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS rank
  FROM slots JOIN laid ON place >= lo AND (place < hi OR hi = (SELECT max(hi) FROM laid)) AND blocks > 0
), line AS (
  SELECT d.*, c.sid, c.n, c.target, c.block,
    coalesce(sum(size) OVER (PARTITION BY c.sid ORDER BY ord, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo
  FROM docs d JOIN cut c ON d.source IS NOT DISTINCT FROM c.source
), parts AS (
  SELECT doc_id, ord, size, sid, block, lo + r * n AS lo, unnest(range(CAST((lo + r * n) // block AS BIGINT), CAST((lo + r * n + size - 1) // block + 1 AS BIGINT))) AS rank
  FROM line, (SELECT unnest(range({EPOCHS})) AS r) WHERE size > 0
), taken AS (
  SELECT doc_id, ord, p.sid, sum(least(lo + size, (rank + 1) * block) - greatest(lo, rank * block)) AS taken, min(slot) AS first_slot
  FROM parts p JOIN plan USING (sid, rank) GROUP BY ALL
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(n AS BIGINT) AS source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken, CAST(first_slot AS BIGINT) AS first_slot
FROM line LEFT JOIN taken USING (doc_id, ord, sid)
"""
