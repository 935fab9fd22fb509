"""Exact removal of repeated byte strings: a Burrows-Wheeler transform whose intervals grow to a minimum length.

Every LENGTH-byte string (window) that starts anywhere else too is covered for removal.  So that no machine has to index the
corpus, windows are dealt out first: a window belongs to the leftmost of its GRAM-byte substrings with the least hash (its
anchor), which depends on its bytes alone, so equal windows meet under equal anchors.  The windows of one anchor
occurrence are consecutive; the bytes they span are a segment.  Anchors that occur once have no repeated window, and
where all segments of an anchor are equal, all their windows repeat.  The distinct segments of the remaining anchors are put
into blocks, each small enough for one task.

In a block the segments' suffixes are sorted, and intervals of suffixes that share a prefix are extended backwards
through the transform, breadth first: prefixes of 1, 2, 3, ... bytes.  An interval whose upper border is new has the
length of its prefix as common-prefix value there, and goes into the next level; levels end at LENGTH.  Borders
that were never met separate nothing: the suffixes between two known borders share LENGTH bytes or more.

An anchor of more than HOT distinct segments would not fit a block: its windows are hashed one by one (128 bits) and
counted, which aggregates before it shuffles.

Nulls and odd rows: a null text is empty; shorter texts have no window; repeated rows are copies, each of which loses
what the others have; an empty table gives an empty result; a window never runs over a text's end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, mix, span_sums, written

LENGTH = 200
GRAM = 32
#: Bytes of texts that one numpy pass holds; a longer text is taken in overlapping pieces.
PASS = 2_000_000
#: Bytes of segments that a block holds, about, and distinct segments of an anchor that go into blocks.
BLOCK = 2_000_000
HOT = 16_384
#: Segments of hot anchors whose windows are one batch.
SOME = 1_000

SEGMENTS = "fid long, rix long, anchor long, seg long, lo int, n int"


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def segments(data: np.ndarray, owner_ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(lo, n, anchor hash, segment hash) of all segments of texts in a row; owner_ends: where each text ends."""
    width = length - gram + 1
    last = len(data) - length + 1
    if last <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
    sums, down = span_sums(data)
    h = mix((sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1])
    # the hash's upper bits with the place below them: the least is the leftmost of the least
    low = (h & ~np.uint64((1 << 24) - 1)) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    at = (np.minimum(low[: last], low[width - span : width - span + last]) & np.uint64((1 << 24) - 1)).astype(np.int64)
    text = np.searchsorted(owner_ends, np.arange(last), side="right")
    valid = np.arange(last) + length <= owner_ends[np.minimum(text, len(owner_ends) - 1)]
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (at[1:] != at[:-1])
    stop = valid.copy()
    stop[:-1] &= ~valid[1:] | (at[1:] != at[:-1])
    lo, hi = np.flatnonzero(new), np.flatnonzero(stop) + 1
    end = hi - 1 + length
    seg = mix((sums[end] - sums[lo]) * down[lo] + (end - lo).astype(np.uint64))
    return lo, hi - lo, h[at[lo]], seg


def _text_pieces(texts: list[bytes], length: int) -> Iterator[tuple[list[int], list[int], np.ndarray, np.ndarray]]:
    """(text index, offset in the text, bytes, ends) of groups of at most about PASS bytes."""
    index: list[int] = []
    offset: list[int] = []
    held: list[bytes] = []
    size = 0
    for i, t in enumerate(texts):
        for s in range(0, max(1, len(t) - length + 1), PASS):
            part = t[s : s + PASS + length - 1]
            if held and size + len(part) > PASS:
                yield index, offset, np.frombuffer(b"".join(held), np.uint8), np.cumsum([len(x) for x in held])
                index, offset, held, size = [], [], [], 0
            index.append(i)
            offset.append(s)
            held.append(part)
            size += len(part)
    if held:
        yield index, offset, np.frombuffer(b"".join(held), np.uint8), np.cumsum([len(x) for x in held])


def _find_segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        fid, rix = batch["fid"].to_numpy(), batch["rix"].to_numpy()
        for index, offset, data, ends in _text_pieces(list(batch["data"]), LENGTH):
            lo, n, anchor, seg = segments(data, ends)
            which = np.searchsorted(ends, lo, side="right")
            row = np.array(index)[which]
            start = lo - np.concatenate([[0], ends[:-1]])[which] + np.array(offset)[which]
            yield pd.DataFrame({"fid": fid[row], "rix": rix[row], "anchor": _signed(anchor), "seg": _signed(seg), "lo": start.astype(np.int32), "n": n.astype(np.int32)})


def suffix_order(text: np.ndarray, length: int) -> np.ndarray:
    """All suffixes of text (values from 0 to 256) in the order of their first ``length`` values or more, by doubling."""
    n = len(text)
    padded = np.concatenate([text.astype(np.uint64), np.zeros(8, np.uint64)])
    key = np.zeros(n, np.uint64)
    for i in range(7):  # seven values of nine bits
        key = key << np.uint64(9) | padded[i : n + i]
    span = 7
    while True:
        order = np.argsort(key)  # equal keys may stand in any order
        ranked = key[order]
        rank = np.zeros(n, np.uint64)
        rank[order] = np.cumsum(np.concatenate([[1], ranked[1:] != ranked[:-1]])).astype(np.uint64)
        if span >= length or rank.max() == n:
            return order
        after = np.zeros(n, np.uint64)
        after[: n - span] = rank[span:] if span < n else 0
        key = rank << np.uint64(32) | after
        span *= 2


def long_prefix_groups(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): the suffix order, and for each of its places a number that those sharing ``length`` values have
    in common, found by backward extension, breadth first, of intervals in the transform of text."""
    n = len(text)
    order = suffix_order(text, length)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    before = text[order - 1].astype(np.int64)  # the transform; the first suffix has the last value before it
    step = place[order - 1]
    known = np.zeros(n + 1, bool)
    known[0] = known[n] = True
    low, high = np.array([0]), np.array([n])  # intervals [low, high) of the empty prefix
    for _ in range(length):
        if not len(low):
            break
        sizes = high - low
        owner = np.repeat(np.arange(len(low)), sizes)
        at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(low, sizes)
        # the extension of an interval by a value: where the suffixes one value longer stand
        kind = (owner * 257 + before[at]).astype(np.int32 if len(low) < 1 << 22 else np.int64)
        by = np.argsort(kind)
        first = np.flatnonzero(np.concatenate([[True], kind[by][1:] != kind[by][:-1]]))
        to = step[at][by]
        new_low, new_high = np.minimum.reduceat(to, first), np.maximum.reduceat(to, first) + 1
        fresh = ~known[new_high]
        known[new_high[fresh]] = True
        lows = ~known[new_low] & ~fresh
        known[new_low[~known[new_low]]] = True
        low, high = new_low[fresh | lows], new_high[fresh | lows]
    return order, np.cumsum(known[:n])


def repeated_windows(parts: list[bytes], copies: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each distinct segment, for each of its windows, whether it occurs twice or more, copies counted."""
    sizes = np.array([len(p) for p in parts])
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    text = np.zeros(int((sizes + 1).sum()), np.uint16)  # 0 stands behind each segment
    text[np.repeat(starts, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint16) + 1
    order, group = long_prefix_groups(text, length)
    of = np.searchsorted(starts, order, side="right") - 1
    whole = order + length <= starts[of] + sizes[of]
    times = np.bincount(group[whole], weights=copies[of[whole]], minlength=int(group[-1]) + 1)
    repeated = np.zeros(len(text), bool)
    repeated[order] = whole & (times[group] >= 2)
    return [repeated[s : s + max(0, n - length + 1)] for s, n in zip(starts, sizes)]


def _block_runs(rows: pd.DataFrame) -> pd.DataFrame:
    """The repeated windows of a block's segments as runs: start within the segment, and how many."""
    out: list[tuple] = []
    found = repeated_windows(list(rows["data"]), rows["copies"].to_numpy())
    for anchor, seg, flags in zip(rows["anchor"], rows["seg"], found):
        edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
        out += [(anchor, seg, a, b - a) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]
    return pd.DataFrame(out, columns=["anchor", "seg", "skip", "m"])


def _window_hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for a in range(0, len(batch), SOME):
            some = batch.iloc[a : a + SOME]
            ones, twos = [], []
            for data in some["data"]:
                raw = np.frombuffer(data, np.uint8)
                sums, down = span_sums(raw)
                other, _ = span_sums(mix(raw.astype(np.uint64) + np.uint64(77)))
                for s, out in ((sums, ones), (other, twos)):
                    out.append(mix((s[LENGTH:] - s[:-LENGTH]) * down[: len(raw) - LENGTH + 1]))
            n = [len(x) for x in ones]
            skip = np.concatenate([np.arange(k, dtype=np.int32) for k in n])
            yield pd.DataFrame({c: np.repeat(some[c].to_numpy(), n) for c in ("anchor", "seg", "copies")} | {"skip": skip, "h1": _signed(np.concatenate(ones)), "h2": _signed(np.concatenate(twos))})


def _kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for doc_id, data, spans in zip(batch["doc_id"], batch["data"], batch["spans"]):
            at, kept, removed, n = 0, hashlib.sha256(), 0, 0
            ranges = [] if spans is None else sorted((int(s["s"]), int(s["e"])) for s in spans)
            end = -1
            for s, e in ranges:
                if s > end:  # a new run; runs that touch are one
                    n += 1
                    kept.update(data[at:s])
                    removed += e - s
                    at = end = e
                elif e > end:
                    removed += e - end
                    at = end = e
            kept.update(data[at:])
            out.append((doc_id, len(data), removed, n, kept.hexdigest()))
        yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(texts: DataFrame) -> DataFrame:
    """(fid, rix, s, e): byte ranges of the texts (fid, rix, data) that repeated windows cover; they may overlap."""
    spark = texts.sparkSession
    found = written(texts.mapInPandas(_find_segments, SEGMENTS), "segments")
    # here and below both sides of a join are tables: a skewed join's tasks can then be split, whatever anchor is common
    anchors = found.groupBy("anchor").agg(F.count("*").alias("c"), F.min("seg").alias("x"), F.max("seg").alias("y")).filter("c > 1")
    anchors = written(anchors.select("anchor", (F.col("x") != F.col("y")).alias("mixed")), "anchors")
    met = written(found.join(anchors, "anchor"), "met")
    forget(found)
    forget(anchors)
    plain = met.filter("not mixed").select("fid", "rix", F.col("lo").alias("s"), (F.col("lo") + F.col("n") - 1 + LENGTH).alias("e"))

    mixed = met.filter("mixed").drop("mixed")
    distinct = mixed.groupBy("anchor", "seg").agg(F.count("*").alias("copies"), F.min(F.struct("fid", "rix", "lo", "n")).alias("r")).select("anchor", "seg", "copies", "r.*")
    distinct = written(distinct, "distinct")
    size = written(distinct.groupBy("anchor").agg(F.count("*").alias("k")), "sizes")
    distinct = distinct.join(size, "anchor")
    cut = distinct.join(texts, ["fid", "rix"]).select("anchor", "seg", "copies", "k", F.substring("data", F.col("lo") + 1, F.col("n") - 1 + LENGTH).alias("data"))
    cut = written(cut, "cut")
    total = cut.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // BLOCK))
    in_block = cut.filter(F.col("k") <= HOT).withColumn("block", F.pmod(F.xxhash64("anchor"), F.lit(blocks)).cast("int"))
    runs = in_block.select("block", "anchor", "seg", "copies", "data").groupBy("block").applyInPandas(_block_runs, "anchor long, seg long, skip int, m int")
    hot = cut.filter(F.col("k") > HOT).select("anchor", "seg", "copies", "data")
    windows = hot.mapInPandas(_window_hashes, "anchor long, seg long, copies long, skip int, h1 long, h2 long")
    often = windows.groupBy("h1", "h2").agg(F.sum("copies").alias("c")).filter("c > 1").select("h1", "h2")
    # a segment has LENGTH - GRAM + 1 windows at most; those that follow each other are one run
    again = windows.join(often, ["h1", "h2"], "left_semi").groupBy("anchor", "seg").agg(F.sort_array(F.collect_list("skip")).alias("a"))
    edge = lambda step: F.filter("a", lambda i: ~F.array_contains("a", i + step))
    again = again.select("anchor", "seg", F.explode(F.arrays_zip(edge(-1).alias("lo"), edge(1).alias("hi"))).alias("r"))
    runs = runs.unionByName(again.select("anchor", "seg", F.col("r.lo").alias("skip"), (F.col("r.hi") - F.col("r.lo") + 1).cast("int").alias("m")))
    runs = written(runs, "runs")
    forget(cut)
    ranges = mixed.join(runs, ["anchor", "seg"]).select("fid", "rix", (F.col("lo") + F.col("skip")).alias("s"), (F.col("lo") + F.col("skip") + F.col("m") - 1 + LENGTH).alias("e"))
    return plain.unionByName(ranges)


def remove_repeats(rows: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of rows (fid, rix, doc_id, data), fid and rix naming a row."""
    spans = repeated_spans(rows.select("fid", "rix", "data")).groupBy("fid", "rix").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    # a span has 200 bytes or more of its document and comes from one segment
    spans = written(spans, "spans")
    joined = rows.join(spans, ["fid", "rix"], "left").select("doc_id", "data", "spans")
    return joined.mapInPandas(_kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document loses when every 200-byte string that starts more than once is removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select(F.xxhash64("_metadata.file_path").alias("fid"), F.col("_metadata.row_index").alias("rix"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("data"))
    return remove_repeats(rows)


#: Every window of every text by its hash; texts as hexadecimal digits, two for a byte.
OP7_SQL = rf"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), chunks AS (
  SELECT r, o, substr(h, 2 * o + 1, 2 * (1000 + {LENGTH - 1})) AS h FROM (SELECT r, h, unnest(range(0, len(h) // 2 - {LENGTH - 1}, 1000)) AS o FROM texts)
), windows AS (
  SELECT r, o + i AS p, hash(substr(h, 2 * i + 1, {2 * LENGTH})) AS w FROM (SELECT r, o, h, unnest(range(len(h) // 2 - {LENGTH - 1})) AS i FROM chunks)
), often AS (
  SELECT w FROM windows GROUP BY w HAVING count(*) > 1
), hits AS (
  SELECT r, p, p - lag(p) OVER (PARTITION BY r ORDER BY p) AS gap FROM windows SEMI JOIN often USING (w)
), runs AS (
  SELECT r, min(p) AS s, max(p) + {LENGTH} AS e FROM (SELECT r, p, count(*) FILTER (gap IS NULL OR gap > {LENGTH}) OVER (PARTITION BY r ORDER BY p) AS k FROM hits) GROUP BY r, k
), gaps AS (
  SELECT r, e AS s, lead(s) OVER (PARTITION BY r ORDER BY s) AS e FROM (SELECT r, s, e FROM runs UNION ALL SELECT r, -1, 0 FROM texts)
), kept AS (
  SELECT r, coalesce(string_agg(substr(h, 2 * s + 1, 2 * (coalesce(e, len(h) // 2) - s)), '' ORDER BY s), '') AS h FROM gaps JOIN texts USING (r) GROUP BY r
), sums AS (
  SELECT r, CAST(sum(e - s) AS BIGINT) AS n_removed, count(*) AS n_spans FROM runs GROUP BY r
)
SELECT doc_id, CAST(len(t.h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(kept.h)) AS kept_sha256
FROM texts t JOIN kept USING (r) LEFT JOIN sums USING (r)
"""
