"""Near-duplicate detection by HyperMinHash registers, banded, with every link confirmed on full shingle sets.

A document's shingles are hashed into REGISTERS buckets; a bucket keeps its smallest hash as six bits of leading zeros
and ten of mantissa.  An empty bucket borrows from the first filled one in an order that all documents share, so short
documents have full registers too.  BANDS groups of ROWS registers are keys; documents that share a key are candidates.
The share of equal registers, less chance collisions, estimates their similarity, and what may reach the threshold is
confirmed on the exact sets.

Documents of equal sets are first taken together as one class.  A key's classes are compared each with each if they are
few (SMALL); where there are more, each is compared with the key's first one.  Of the large keys those whose classes
aren't connected by then are gone through again: one task takes such a key's registers and sets and compares every two
that aren't connected yet.  Where they are too many for a task, the comparison goes by rounds of joins: each component
of a key has some of its classes compared with the key's others, until every two have been compared or are in one
component.  Keys have no cap.  A link of the threshold's similarity is lost with a chance of (1 - 0.8^5)^32, some 3 in a
million, because its documents share no key, and of less than one in a billion because the estimate lies MARGIN, six
standard deviations, below the truth; sets are compared by 64-bit hashes of their shingles.

Nulls and odd rows: a null, empty or wordless text has no shingle and is linked with nothing; texts with fewer words than
a shingle have one of all their words; repeated rows are copies of each other; rows with a null doc_id take part, and
count as the largest; an empty table gives an empty result; a very long text has one set of all its shingles; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import code_points, columns_of, forget, mix, numbered, span_hashes, word_spans, written
from .components import components

REGISTERS = 160
ROWS = 5
BANDS = REGISTERS // ROWS
MANTISSA = 10
#: Chance that two different minima get the same register: sum of 4^-z over the leading zeros, over 2^MANTISSA.
COLLISION = 1 / (3 * 2**MANTISSA)
#: Estimates below the threshold by this much, six standard deviations, are not confirmed.
MARGIN = 0.2
#: Classes of one key that are compared each with each.
SMALL = 32
#: Classes, and shingles of theirs, that one task compares; keys of more are gone through in rounds.
MOST, MOST_SHINGLES = 4_096, 2_000_000
#: Code points that one numpy pass holds, unless a single text is longer.
PASS = 1_000_000

SIGNATURE = "rid long, doc_id long, n long, fp1 long, fp2 long, registers array<short>, bands array<long>"
SETS = "cid long, n long, shingles array<long>"


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    codes, offsets = code_points(texts)
    codes = np.where((codes >= 65) & (codes <= 90), codes + np.uint32(32), codes)
    starts, ends, owner = word_spans(codes, offsets)
    words = span_hashes(codes, starts, ends)
    first = np.searchsorted(owner, np.arange(len(texts) + 1))
    h = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for i in range(width):
        h = (h + words[i : len(h) + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    h = mix(h)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= width:
            out.append(np.unique(h[a : b - width + 1]))
        elif b > a:
            one = np.uint64(b - a)
            for w in words[a:b]:
                one = mix(np.array([(int(one) * 0x9E3779B97F4A7C15 + int(w)) & (2**64 - 1)], np.uint64))[0]
            out.append(np.array([one], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _borrow_order() -> np.ndarray:
    order = np.random.default_rng(6)
    return np.stack([order.permutation(REGISTERS) for _ in range(REGISTERS)])


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """The 16-bit registers of each set; those of an empty set mean nothing."""
    sizes = [len(s) for s in sets]
    flat = np.concatenate([np.zeros(0, np.uint64), *sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    bucket = (flat % np.uint64(REGISTERS)).astype(np.int64)
    low = np.full(len(sets) * REGISTERS, np.uint64(2**64 - 1))
    np.minimum.at(low, owner * REGISTERS + bucket, mix(flat ^ np.uint64(0xD6E8FEB86659FD93)))
    low = low.reshape(-1, REGISTERS)
    filled = low != np.uint64(2**64 - 1)
    own, empty = low.copy(), ~filled
    order = _borrow_order()
    for t in range(REGISTERS):
        if not empty[np.array(sizes, int) > 0].any():
            break
        take = empty & filled[:, order[:, t]]
        low[take] = own[:, order[:, t]][take]
        empty &= ~take
    bits = np.maximum(low, 1).astype(np.float64).view(np.uint64)
    zeros = np.uint64(63 + 1023) - np.minimum(bits >> np.uint64(52), np.uint64(63 + 1023))
    return (zeros << np.uint64(MANTISSA) | bits >> np.uint64(52 - MANTISSA) & np.uint64(2**MANTISSA - 1)).astype(np.uint16)


def band_keys(regs: np.ndarray) -> np.ndarray:
    grouped = regs.astype(np.uint64).reshape(len(regs), BANDS, ROWS)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), grouped.shape[:2]).copy()
    for i in range(ROWS):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + grouped[:, :, i])
    return h.view(np.int64)


def _passes(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Begin and end of groups of texts of about PASS code points."""
    at = 0
    while at < len(texts):
        end, held = at, 0
        while end < len(texts) and (end == at or held + len(texts[end]) <= PASS):
            held += len(texts[end])
            end += 1
        yield at, end
        at = end


def _signer(width: int):  # noqa: ANN202
    wrap = lambda x: np.array(x, np.uint64).view(np.int64)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            for a, b in _passes(texts):
                sets = shingle_sets(texts[a:b], width)
                regs = registers(sets)
                some = batch.iloc[a:b]
                yield pd.DataFrame(
                    {
                        "rid": some["rid"], "doc_id": some["doc_id"], "n": [len(s) for s in sets],
                        "fp1": wrap([s.sum(dtype=np.uint64) for s in sets]), "fp2": wrap([np.bitwise_xor.reduce(mix(s)) if len(s) else 0 for s in sets]),
                        "registers": list(regs.view(np.int16)), "bands": list(band_keys(regs)),
                    }
                )

    return sign


def _set_maker(width: int):  # noqa: ANN202
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            for a, b in _passes(texts):
                sets = [s.view(np.int64) for s in shingle_sets(texts[a:b], width)]
                yield pd.DataFrame({"cid": batch["rid"].iloc[a:b], "n": [len(s) for s in sets], "shingles": sets})

    return make


def estimate(a: Column, b: Column) -> Column:
    """Similarity of two arrays of registers, corrected for chance collisions."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))
    return (equal / REGISTERS - COLLISION) / (1 - COLLISION)


def _likely(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sizes and registers (reps: cid, n, registers) don't rule them out."""
    side = lambda s: reps.select(F.col("cid").alias(s), F.col("n").alias(f"{s}_n"), F.col("registers").alias(f"{s}_registers"))
    rough = pairs.join(side("a"), "a").join(side("b"), "b").filter(F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * percent)
    return rough.filter(estimate(F.col("a_registers"), F.col("b_registers")) >= percent / 100 - MARGIN).select("a", "b")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets (cid, n, shingles) are similar enough."""
    side = lambda s: sets.select(F.col("cid").alias(s), F.col("n").alias(f"{s}_n"), F.col("shingles").alias(f"{s}_shingles"))
    exact = pairs.join(side("a"), "a").join(side("b"), "b")
    both = F.size(F.array_intersect("a_shingles", "b_shingles"))
    return exact.withColumn("both", both).filter((F.col("both") * 100) >= (F.col("a_n") + F.col("b_n") - F.col("both")) * percent).select("a", "b")


def _linker(percent: int):  # noqa: ANN202
    def link(rows: pd.DataFrame) -> pd.DataFrame:
        """Confirmed links that connect what is connected among one key's classes: a pair is compared unless it is
        connected already, the likeliest first."""
        rows = rows.sort_values("cid")
        cid, n = rows["cid"].to_numpy(), rows["n"].to_numpy()
        regs, sets = np.stack(rows["registers"].to_list()), rows["shingles"].to_list()
        root = rows["label"].to_numpy().copy()
        out = []
        for i in range(len(cid) - 1):
            equal = (regs[i + 1 :] == regs[i]).sum(axis=1)
            sure = (equal / REGISTERS - COLLISION) / (1 - COLLISION) >= percent / 100 - MARGIN
            sure &= (np.minimum(n[i + 1 :], n[i]) * 100 >= np.maximum(n[i + 1 :], n[i]) * percent) & (root[i + 1 :] != root[i])
            near = np.flatnonzero(sure) + i + 1
            for j in near[np.argsort(-equal[near - i - 1], kind="stable")]:
                if root[i] == root[j]:
                    continue
                # both sets are distinct hashes
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if both * 100 >= (n[i] + n[j] - both) * percent:
                    out.append((cid[i], cid[j]))
                    root[root == root[j]] = root[i]
        return pd.DataFrame(out, columns=["a", "b"])

    return link


def _unconnected(keys: DataFrame, labels: DataFrame) -> DataFrame:
    """Classes of keys (key, cid, ...) with their labels, of those keys that have several."""
    now = keys.join(labels.select(F.col("node").alias("cid"), "label"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    several = now.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("key")
    return now.join(several, "key", "left_semi")


def near_duplicates(docs: DataFrame, width: int = 4, percent: int = 80) -> DataFrame:
    """One row per document: rid (a row number), doc_id, n, component_id (the component's smallest doc_id), component
    (its smallest row number of a class) and first (true for one row of each component).

    Linked are documents whose sets of ``width``-word shingles have 100 * intersection >= percent * union."""
    return duplicates_among(numbered(columns_of(docs, "doc_id", "text")), width, percent)


def duplicates_among(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """near_duplicates() of rows that numbered() wrote; they stay."""
    texts = rows.select("rid", F.col("doc.doc_id").cast("long").alias("doc_id"), F.col("doc.text").alias("text"))
    signed = written(texts.mapInPandas(_signer(width), SIGNATURE), "signatures")

    # classes of equal sets; head: the row that stands for a class's or component's rows
    alike = ["fp1", "fp2", "n"]
    head = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid"))
    classes = written(signed.filter("n > 0").groupBy(*alike).agg(F.min("rid").alias("cid"), head.alias("head")), "classes")
    reps = written(signed.join(classes.select(F.col("cid").alias("rid")), "rid", "left_semi").select(F.col("rid").alias("cid"), "n", "registers", "bands"), "reps")

    # candidates: the keys that classes share; k, total: how many classes, and shingles of theirs
    keys = reps.select("cid", "n", F.explode("bands").alias("key"))
    shared = written(keys.groupBy("key").agg(F.count("*").alias("k"), F.sum("n").alias("total"), F.min("cid").alias("lead")).filter("k > 1"), "shared")
    keys = written(keys.join(shared, "key"), "keys")
    forget(shared)
    some = keys.filter(F.col("k") <= SMALL).groupBy("key").agg(F.sort_array(F.collect_list("cid")).alias("c"))
    each = F.flatten(F.transform("c", lambda x, i: F.transform(F.slice("c", i + 2, F.size("c")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    pairs = some.select(F.explode(each).alias("p")).select("p.a", "p.b")
    star = keys.filter((F.col("k") > SMALL) & (F.col("cid") > F.col("lead"))).select(F.col("lead").alias("a"), F.col("cid").alias("b"))
    likely = written(_likely(pairs.union(star).distinct(), reps, percent), "likely")

    # the full sets of what may be linked, made again from the texts
    large = keys.filter(F.col("k") > SMALL).select("cid")
    wanted = likely.select(F.col("a").alias("cid")).union(likely.select("b")).union(large).distinct()
    sets = texts.select("rid", "text").join(wanted.select(F.col("cid").alias("rid")), "rid", "left_semi").mapInPandas(_set_maker(width), SETS)
    sets = written(sets, "sets")
    links = written(_confirm(likely, sets, percent), "links")
    forget(likely)
    labels = components(links)

    # large keys whose classes aren't connected yet
    fits = (F.col("k") <= MOST) & (F.col("total") <= MOST_SHINGLES)
    left = written(_unconnected(keys.filter(F.col("k") > SMALL).select("key", "cid", fits.alias("fits")), labels), "left")
    forget(keys)
    middle = left.filter("fits").select("key", "cid", "label").join(sets, "cid").join(reps.select("cid", "registers"), "cid")
    more = written(middle.groupBy("key").applyInPandas(_linker(percent), "a long, b long").distinct(), "links")
    if more.limit(1).count():
        links = written(links.union(more), "links")
        labels = components(links)

    # keys of yet more classes: on until every two of one key have been compared or are connected
    many = written(left.filter("not fits").select("key", "cid", F.lit(False).alias("done")), "many")
    turn = 1
    while many.limit(1).count():
        now = _unconnected(many, labels)
        turns = F.row_number().over(Window.partitionBy("key", "label", "done").orderBy("cid"))
        now = written(now.withColumn("lead", ~F.col("done") & (turns <= turn)), "many")
        leads = now.filter("lead").select("key", F.col("cid").alias("l"), F.col("label").alias("ll"))
        pairs = now.select("key", "cid", "label").join(leads, "key").filter("label <> ll").select(F.least("cid", "l").alias("a"), F.greatest("cid", "l").alias("b")).distinct()
        pairs = written(pairs, "pairs")
        if not pairs.limit(1).count():  # of every two components of a key, one has been compared whole
            break
        more = written(links.union(_confirm(_likely(pairs, reps, percent), sets, percent)), "links")
        forget(many)
        forget(pairs)
        links, many = more, written(now.select("key", "cid", (F.col("done") | F.col("lead")).alias("done")), "many")
        labels = components(links)
        turn *= 2
    for table in (reps, sets, left):
        forget(table)

    # both sides of these joins are tables, so that a component or a class of many rows can be split as a skewed one
    placed = written(classes.join(labels.select(F.col("node").alias("cid"), "label"), "cid", "left").select(*alike, "head", F.coalesce("label", "cid").alias("component")), "placed")
    heads = written(placed.groupBy("component").agg(F.min("head").alias("head")), "heads")
    placed = written(placed.drop("head").join(heads, "component"), "placed")
    member = signed.filter("n > 0").select("rid", "doc_id", *alike).join(placed, alike)
    member = member.select("rid", "doc_id", "n", F.col("head.doc_id").alias("component_id"), "component", (F.col("rid") == F.col("head.rid")).alias("first"))
    alone = signed.filter("n = 0").select("rid", "doc_id", "n", F.col("doc_id").alias("component_id"), F.col("rid").alias("component"), F.lit(True).alias("first"))
    return member.unionByName(alone)


def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component among near duplicates by four-word shingles at 80 %."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4, percent=80)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


#: Every two documents that share a shingle are compared; hash() stands for a shingle.
OP6_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::UBIGINT[] WHEN len(w) < 4 THEN [hash(array_to_string(w, ' '))]
    ELSE list_transform(range(1, len(w) - 2), lambda i: hash(w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END) AS s FROM words
), classes AS (
  SELECT min(doc_id) AS cid, len(s) AS n, list_sort(s) AS s FROM sets WHERE len(s) > 0 GROUP BY ALL
), shingles AS (
  SELECT cid, n, unnest(s) AS h FROM classes
), links AS (
  SELECT a.cid AS a, b.cid AS b FROM shingles a JOIN shingles b ON a.h = b.h AND a.cid < b.cid
  GROUP BY a.cid, b.cid HAVING count(*) * 100 >= 80 * (any_value(a.n) + any_value(b.n) - count(*))
), ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (
  SELECT cid AS node, cid AS label FROM classes
  UNION
  SELECT b, label FROM reached JOIN ways ON node = a
), labels AS (
  SELECT node, min(label) AS label FROM reached GROUP BY node
)
SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, coalesce(label, d.doc_id) AS component_id, d.doc_id = coalesce(label, d.doc_id) AS kept
FROM sets d LEFT JOIN classes c ON list_sort(d.s) = c.s LEFT JOIN labels ON node = cid
"""
