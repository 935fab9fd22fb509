"""Benchmark decontamination by spaced seeds.

A mask such as 1101101 hashes the words under its ones and ignores those under its zeros, so a substituted word does
not hide a match.  All masks are slid over the benchmark's items and over every document; equal hashes give a diagonal
(document position minus item position), and along it the words are compared.  A document leaks an item if the longest
stretch from an equal word to an equal word with a share of SIMILARITY or more of equal ones has MIN_WORDS words or
more, or if the whole item lies there with a similarity of SIMILARITY or more.

Words are lower-cased runs without white space, reduced to their letters and digits; what has none is no word.

The benchmark goes to the executors in blocks of at most BLOCK_WORDS words (an item of more is a block of its own).  The
driver reads one block at a time; with several, the documents are gone through once for each block, whose hits are
written down before the next block is sent, so memory doesn't grow with the benchmark.  Places of a text with equal words
around them, as far as the longest item reaches, meet the same items in the same way: only the first is followed up, so a
common seed in a repetitive text costs no product of places.

Nulls and odd rows: a null or empty text leaks nothing, a null or wordless item is leaked by nothing; an item with a null
item_id is looked for as any; items of fewer than five words must be there word for word; each of repeated rows is
reported; empty tables give empty results; other columns are left as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import code_points, columns_of, mix, numbered, span_hashes, span_sums, word_spans, written

# The masks, each of weight five.
MASKS = ("11111", "1101101", "10110011", "1110010001")
MIN_WORDS = 13
SIMILARITY = 0.8
#: What an equal word and another add to a sum that is 0 or more where the share is SIMILARITY or more.
EQUAL, OTHER = 1, -4
#: Benchmark words that go to the executors at once.
BLOCK_WORDS = 250_000
#: Code points of whole texts that one numpy pass holds, unless a single text is longer.
PASS = 2_000_000

HITS = "array<struct<item_id:long,start_word:int,n_words:int,n_equal:int>>"
_plain = np.zeros(0, bool)


def alphanumeric() -> np.ndarray:
    """For each code point, whether it is a letter or a digit."""
    global _plain
    if not len(_plain):
        _plain = np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)
    return _plain


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in a row, and each text's offset in them (one more at the end)."""
    codes, offsets = code_points([t.lower() for t in texts])
    keep = alphanumeric()[codes] | (codes == 32) | ((codes >= 9) & (codes <= 13))
    before = np.concatenate([[0], np.cumsum(keep)])
    codes, offsets = codes[keep], before[offsets]
    starts, ends, owner = word_spans(codes, offsets)
    return span_hashes(codes, starts, ends), np.searchsorted(owner, np.arange(len(texts) + 1))


def seed_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """The mask's hash at every place where it fits."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, np.uint64(len(mask)))
    for i, c in enumerate(mask):
        if c == "1":
            h = (h + words[i : n + i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return mix(h)


def longest_stretch(same: np.ndarray) -> tuple[int, int]:
    """(begin, end) of the longest stretch, the first of equals, that begins and ends with True and holds a share of SIMILARITY or more."""
    at = np.flatnonzero(same)
    if not len(at):
        return 0, 0
    sums = np.concatenate([[0], np.cumsum(np.where(same, EQUAL, OTHER))])
    # the greatest sum at an end from each one on never rises: the last end that reaches a begin's sum is found by bisection
    most = np.maximum.accumulate(sums[at + 1][::-1])[::-1]
    last = at[np.searchsorted(-most, -sums[at], "right") - 1] + 1
    k = int(np.argmax(last - at))
    return int(at[k]), int(last[k])


class Benchmark:
    """A block of items: their words, and the sorted seeds of every mask with where each stands."""

    def __init__(self, ids: list[int | None], texts: list[str]):
        self.ids = ids
        self.words, self.offsets = word_hashes(texts)
        sizes = np.diff(self.offsets)
        self.longest = int(sizes.max(initial=0))
        self.masks = [*MASKS, *("1" * n for n in sorted({int(s) for s in sizes if 0 < s < 5}))]
        self.seeds = []
        for k, mask in enumerate(self.masks):
            keys, items, places = [], [], []
            for i, (a, b) in enumerate(zip(self.offsets[:-1], self.offsets[1:])):
                if k < len(MASKS) or b - a == len(mask):
                    h = seed_hashes(self.words[a:b], mask)
                    keys.append(h)
                    items.append(np.full(len(h), i))
                    places.append(np.arange(len(h)))
            key = np.concatenate([np.zeros(0, np.uint64), *keys])
            order = np.argsort(key, kind="stable")
            seen = np.zeros(1 << 20, bool)
            seen[(key >> np.uint64(44)).astype(np.int64)] = True
            self.seeds.append((key[order], np.concatenate([np.zeros(0, int), *items])[order], np.concatenate([np.zeros(0, int), *places])[order], seen))

    def hits(self, texts: list[str]) -> list[list[dict]]:
        """For each text, its leaked items with the stretch of most equal words of each."""
        words, offsets = word_hashes(texts)
        owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
        sums, down = span_sums(words)
        found = []
        for mask, (keys, items, places, seen) in zip(self.masks, self.seeds):
            h = seed_hashes(words, mask)
            if not len(h) or not len(keys):
                continue
            at = np.flatnonzero(seen[(h >> np.uint64(44)).astype(np.int64)])
            at = at[owner[at] == owner[at + len(mask) - 1]]
            # of places with the same words around them, the first; near a text's ends less stands around
            low, high = np.maximum(at - self.longest, offsets[owner[at]]), np.minimum(at + self.longest, offsets[owner[at] + 1])
            around = mix((sums[high] - sums[low]) * down[low] + (high - low).astype(np.uint64))
            key = mix(around ^ mix((at - low).astype(np.uint64))) ^ mix(owner[at].astype(np.uint64))
            at = at[np.sort(np.unique(key, return_index=True)[1])]
            low, high = np.searchsorted(keys, h[at], "left"), np.searchsorted(keys, h[at], "right")
            n = high - low
            pick = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            found.append(np.stack([owner[np.repeat(at, n)], items[pick], np.repeat(at, n) - places[pick]], axis=1))
        out: list[list[dict]] = [[] for _ in texts]
        if not found:
            return out
        best: dict[tuple[int, int], tuple] = {}
        for text, item, start in np.unique(np.concatenate(found), axis=0):
            a, b = self.offsets[item], self.offsets[item + 1]
            lo, hi = max(start, offsets[text]), min(start + b - a, offsets[text + 1])
            same = words[lo:hi] == self.words[a + lo - start : a + hi - start]
            n, low = len(same), int(lo - offsets[text])
            begin, end = longest_stretch(same)
            if b - a < 5:
                ok, begin, end = n == b - a and bool(same.all()), 0, n
            else:
                ok = end - begin >= MIN_WORDS
                if not ok and n == b - a and same.sum() >= SIMILARITY * n:
                    ok, begin, end = True, 0, n
            if ok:
                got = (int(same[begin:end].sum()), -(low + begin), end - begin)
                best[text, item] = max(best.get((text, item), got), got)
        for (text, item), (equal, start, n) in sorted(best.items()):
            out[text].append({"item_id": self.ids[item], "start_word": -start, "n_words": n, "n_equal": equal})
        return out


def _passes(texts: list[str]) -> Iterator[list[str]]:
    held: list[str] = []
    size = 0
    for t in texts:
        if held and size + len(t) > PASS:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def _leak_finder(held: Broadcast) -> Callable[..., Column]:
    @F.pandas_udf(HITS)
    def leaks(texts: pd.Series) -> pd.Series:
        block = Benchmark.__new__(Benchmark)
        vars(block).update(held.value)
        return pd.Series([x for some in _passes([t or "" for t in texts]) for x in block.hits(some)], index=texts.index, dtype=object)

    return leaks


def _blocks(items: DataFrame, most: int) -> Iterator[list[tuple[int | None, str]]]:
    """The items in blocks of at most ``most`` words, or of one item; the driver holds a block and a partition."""
    held: list[tuple[int | None, str]] = []
    size = 0
    for item_id, text, n in items.withColumn("n", F.regexp_count("text", F.lit(r"\S+"))).toLocalIterator():
        if held and size + n > most:
            yield held
            held, size = [], 0
        held.append((item_id, text))
        size += n
    yield held


def _sent(docs: DataFrame, block: list[tuple[int | None, str]]) -> Broadcast:
    block = sorted(block, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    return docs.sparkSession.sparkContext.broadcast(vars(Benchmark([i for i, _ in block], [t for _, t in block])))


def find_leaks(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS, out: str = "leaks") -> DataFrame:
    """docs with column ``out``, which replaces one of that name: an array of struct<item_id, start_word, n_words, n_equal>, empty where the text
    leaks nothing.  Nothing is shuffled if the benchmark is one block."""
    items = columns_of(benchmark, "item_id", "text").filter("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    blocks = _blocks(items, block_words)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return docs.withColumn(out, _leak_finder(_sent(docs, first))(F.col("text")))
    rows = numbered(docs)
    hits = []
    for block in chain([first, second], blocks):
        held = _sent(docs, block)
        found = rows.select("rid", _leak_finder(held)(F.col("doc.text")).alias("x")).filter(F.size("x") > 0)
        hits.append(written(found, "leaks"))
        held.destroy()
    # a document's items in all blocks: as many as it leaks
    every = reduce(DataFrame.unionAll, hits).groupBy("rid").agg(F.flatten(F.sort_array(F.collect_list("x"))).alias("x"))
    names = [f"doc.`{c}`" for c in docs.columns if c.lower() != out.lower()]
    return rows.join(every, "rid", "left").select(*names, F.coalesce("x", F.array().cast(HITS)).alias(out))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and each benchmark item that it leaks; clean documents have none."""
    docs = columns_of(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    found = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id", F.explode("leaks").alias("x"))
    return found.select("doc_id", "x.item_id", "x.start_word", "x.n_words", "x.n_equal", (F.col("x.n_equal") / F.col("x.n_words")).alias("similarity"))
