"""Quality classifier: supervised subword embeddings.

A document's features are of three families: words, word pairs, and the character n-grams (3 and 4 characters) of words
with their borders marked.  Each family's learned, hashed vectors are averaged, and the document is the average of its
families, so that the many n-grams don't drown the few words.  A softmax layer stands on top; vectors and layer are
trained together by stochastic gradient descent in numpy on a bounded sample of labelled documents.  A word that
repeats the one before it has one feature of each family, which all such words share: repetition is learned as such.

When scoring, each bucket's vector is first multiplied by the output layer: a document's logit is then the mean of
its families' means, which equals the layer applied to the mean vector.

Nulls and odd rows: a null text, or one without words, has only the bias for a score; labels other than 0 and 1 are
ignored; a document with two labels is learned with both; without labelled rows every score is 0.5; each of repeated
rows is scored alike; other columns are left as they are.  A very long text is gone through in parts cut at white space,
with the same result as in one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import code_points, columns_of, crc_mod, mix, pieces, span_hashes, word_spans

BUCKETS = 1 << 16
DIM = 8
FAMILIES = 3
CHAR_ORDERS = (3, 4)
#: Labelled documents that training takes, about.
SAMPLE = 4_000
THRESHOLD = 0.3
#: The bucket of a word that repeats the one before it, in each family.
REPEAT = np.uint64(0x5EED)


def features(parts: list[str], more: list[bool], last: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each family the buckets of all features and the part of each; and the last word's hash, if any.
    more, last: see pieces(); the hash of the word before the first part, if the part goes on there."""
    codes, offsets = code_points(parts)
    starts, ends, part = word_spans(codes, offsets)
    shift = np.uint64(64 - 16)
    words = span_hashes(codes, starts, ends)
    text = np.cumsum(~np.array(more, bool))
    lead = last if more[0] else last[:0]
    chain = np.concatenate([lead, words])
    owner = np.concatenate([np.full(len(lead), text[0]), text[part]])
    pairs = mix(chain[1:] * np.uint64(3) + chain[:-1])
    joined = owner[1:] == owner[:-1]
    again = joined & (chain[1:] == chain[:-1])
    behind = part[len(part) - len(pairs) :] if len(pairs) else part[:0]
    repeated = np.zeros(len(words), bool)  # words that are the one before again
    repeated[len(words) - len(again) :] = again
    found = [(np.where(repeated, REPEAT, words >> shift), part), (np.where(again, REPEAT, pairs >> shift)[joined], behind[joined])]
    # words with a mark before and behind each, for the character n-grams
    grams = [(np.full(int(repeated.sum()), REPEAT), part[repeated])]
    starts, ends, part = starts[~repeated], ends[~repeated], part[~repeated]
    lengths = ends - starts
    at = np.cumsum(lengths + 2) - (lengths + 2)
    marked = np.zeros(int((lengths + 2).sum()), np.uint64)
    if len(marked):
        word = np.repeat(np.arange(len(starts)), lengths + 2)
        inner = np.ones(len(marked), bool)
        inner[at] = inner[at + lengths + 1] = False
        marked[inner] = codes[np.arange(len(marked))[inner] - (at - starts)[word[inner]] - 1] + np.uint64(1)
        for n in CHAR_ORDERS:
            m = len(marked) - n + 1
            if m <= 0:
                continue
            h = np.full(m, np.uint64(n))
            for i in range(n):
                h = h * np.uint64(0x100000001B3) ^ marked[i : m + i]
            whole = word[:m] == word[n - 1 :]
            grams.append((mix(h[whole]) >> shift, part[word[:m][whole]]))
    found.append((np.concatenate([g[0] for g in grams]), np.concatenate([g[1] for g in grams])))
    return [(b.astype(np.int64), p) for b, p in found], chain[-1:] if len(words) else lead


def all_features(texts: list[str | None], limit: int | None = None) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
    """For each family the buckets of features and the text of each, some texts or parts of one at a time."""
    last = np.zeros(0, np.uint64)
    for index, parts, more in pieces(texts, *([limit] if limit else [])):
        found, last = features(parts, more, last)
        yield [(b, index[p]) for b, p in found]


def shares(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its buckets, in order, and the share of each in the document's average."""
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    totals = np.zeros((FAMILIES, len(texts)))
    for found in all_features(texts):
        new = np.concatenate([(i * FAMILIES + f) * BUCKETS + b for f, (b, i) in enumerate(found)])
        for f, (_, i) in enumerate(found):
            totals[f] += np.bincount(i, minlength=len(texts))
        got, n = np.unique(new, return_counts=True)
        keys, back = np.unique(np.concatenate([keys, got]), return_inverse=True)
        counts = np.bincount(back, weights=np.concatenate([counts, n]), minlength=len(keys)).astype(np.int64)
    text, family = keys // BUCKETS // FAMILIES, keys // BUCKETS % FAMILIES
    share = counts / totals[family, text] / (totals > 0).sum(axis=0)[text]
    place, back = np.unique(text * BUCKETS + keys % BUCKETS, return_inverse=True)
    share = np.bincount(back, weights=share, minlength=len(place)).astype(np.float32)
    at = np.searchsorted(place, np.arange(len(texts) + 1) * BUCKETS)
    return [((place[a:b] % BUCKETS).astype(np.int32), share[a:b]) for a, b in zip(at[:-1], at[1:])]


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 8, least: int = 16_000, rate: float = 0.5, seed: int = 10) -> tuple[np.ndarray, float]:
    """(table, bias): each bucket's logit for label 1 against label 0, after training vectors and softmax layer.
    rows: what shares() gives.  Few rows are gone through more often, for ``least`` steps."""
    epochs = max(epochs, -(-least // len(rows)))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    layer, bias = np.zeros((DIM, 2)), np.zeros(2)
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, share = rows[i]
            lr = rate * (1 - done / steps)
            done += 1
            hidden = share @ vectors[at]
            s = hidden @ layer + bias
            p = np.exp(s - s.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = layer @ p
            layer -= lr * np.outer(hidden, p)
            bias -= 0.1 * lr * p
            # the share's square root instead of the share: frequent features don't drown the others
            vectors[at] -= lr * np.sqrt(share)[:, None] * back
    return vectors @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0])


class QualityModel:
    def __init__(self, table: np.ndarray, bias: float):
        self.table, self.bias = table, bias

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Probability of label 1."""
        n = len(texts)
        sums, counts = np.zeros((FAMILIES, n)), np.zeros((FAMILIES, n))
        for found in all_features(texts):
            for f, (buckets, text) in enumerate(found):
                sums[f] += np.bincount(text, weights=self.table[buckets], minlength=n)
                counts[f] += np.bincount(text, minlength=n)
        logits = (sums / np.maximum(counts, 1)).sum(axis=0) / np.maximum((counts > 0).sum(axis=0), 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(logits, -500, 500)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> QualityModel:
    """docs: doc_id, text; labels: doc_id, quality.  Takes a hashed sample of about ``sample`` labelled documents."""
    marks = labels.filter("quality in (0, 1) and doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    n = marks.count()
    if not n:
        return QualityModel(np.zeros(BUCKETS), 0.0)
    drawn = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("quality")), F.lit(1 << 30)) / float(1 << 30)
    picked = marks.filter(drawn < min(1.0, sample / n))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            packed = [zlib.compress(np.diff(at, prepend=np.int32(0)).tobytes() + share.tobytes(), 6) for at, share in shares(batch["text"].tolist())]
            yield pd.DataFrame({"doc": batch["doc"], "quality": batch["quality"], "packed": packed})

    # at most about ``sample`` rows of two numbers: small enough to send to every executor
    rows = docs.join(F.broadcast(picked), "doc_id").select(F.col("doc_id").cast("string").alias("doc"), "quality", "text")
    got = [tuple(r) for r in rows.mapInPandas(counted, "doc string, quality int, packed binary").toLocalIterator()]
    if not got:
        return QualityModel(np.zeros(BUCKETS), 0.0)
    got.sort()
    got.reverse()
    vectors, marked = [], []
    while got:
        _, quality, packed = got.pop()  # freed one by one
        both = np.frombuffer(zlib.decompress(packed), np.int32).reshape(2, -1)
        vectors.append((np.cumsum(both[0]).astype(np.uint16), both[1].view(np.float32)))
        marked.append(quality)
    return QualityModel(*train(vectors, np.array(marked)))


def score_quality(docs: DataFrame, model: QualityModel, out: str = "score") -> DataFrame:
    """docs with the probability of quality 1 in column ``out``, which replaces one of that name; see unused()."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(texts.tolist()))

    return docs.withColumn(out, score(F.col("text")))


def learned_on(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """The model that the query and the pipeline share: documents whose crc32(doc_id) mod 5 is 0 teach nothing."""
    taught = F.coalesce(crc_mod(F.col("doc_id"), 5) != 0, F.lit(False))
    return fit(columns_of(docs, "doc_id", "text").filter(taught), columns_of(labels, "doc_id", "quality").filter(taught))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = columns_of(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    model = learned_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    out = score_quality(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
