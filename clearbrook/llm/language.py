"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features: n-grams of 1 to 3 characters of the lower-cased text with every run of non-letters taken as one space, hashed
into BUCKETS.  A feature's value is its share of the text's n-grams times its inverse document frequency, which is
counted over all eligible documents.  Weights are trained by follow-the-regularised-leader with elastic-net
penalties (per-coordinate rates; L1 leaves most weights at zero) on a bounded sample of labelled documents, and a
temperature fitted on a part of the sample that training doesn't see calibrates the probabilities.

Nulls and odd rows: a null text, or one without a letter, gets "und" and a score of 0; rows with a null language
teach nothing but are predicted; without any labelled row everything is "und"; each of repeated rows is predicted alike;
ties go to the language that is first in code-point order; other columns are left as they are, but lang_pred and score
replace columns of their names.  A very long text is gone through in parts cut at white space, with the same result as in one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import code_points, columns_of, crc_mod, mix, pieces, unused

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Labelled documents that training takes for each language, about, and in all.
PER_LANGUAGE = 800
SAMPLE = 8_000
#: Features are shares; this brings them to the size that the learning rate is meant for.
SCALE = 10.0

_letters = np.zeros(0x110000, bool)


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    global _letters
    if not _letters[97]:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def ngrams(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of every text in a row, and each text's offset in them (one more at the end); n-grams that
    run over a word's border or a text's are at bucket BUCKETS, which counts for nothing."""
    codes, offsets = code_points([" " + p.lower() + " " for p in parts])
    letter = letters()[codes]
    codes = np.where(letter, codes, np.uint32(32)).astype(np.uint64)
    text = np.repeat(np.arange(len(parts)), np.diff(offsets))
    keep = np.ones(len(codes), bool)
    keep[1:] = letter[1:] | letter[:-1] | (text[1:] != text[:-1])
    codes, letter, text = codes[keep], letter[keep], text[keep]
    counts = np.bincount(text, minlength=len(parts))
    out = np.full((len(codes), len(ORDERS)), BUCKETS, np.int32)
    for k, n in enumerate(ORDERS):
        m = len(codes) - n + 1
        if m <= 0:
            continue
        h = np.full(m, np.uint64(n))
        for i in range(n):
            h = h * np.uint64(0x100000001B3) ^ codes[i : m + i]
        fine = text[n - 1 :] == text[:m]
        fine &= letter[:m] if n == 1 else letter[:m] | letter[1 : m + 1] if n == 2 else letter[1 : m + 1]
        out[:m, k] = np.where(fine, (mix(h) >> np.uint64(49)).astype(np.int32), BUCKETS)
    return out.ravel(), np.concatenate([[0], np.cumsum(counts) * len(ORDERS)])


def sparse_counts(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the buckets that it has n-grams in, in order, and how many in each."""
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for index, parts, _ in pieces(texts):
        grams, offsets = ngrams(parts)
        new = np.repeat(index, np.diff(offsets)) * (BUCKETS + 1) + grams
        got, n = np.unique(new[grams != BUCKETS], return_counts=True)
        keys, back = np.unique(np.concatenate([keys, got]), return_inverse=True)
        counts = np.bincount(back, weights=np.concatenate([counts, n]), minlength=len(keys)).astype(np.int64)
    at = np.searchsorted(keys, np.arange(len(texts) + 1) * (BUCKETS + 1))
    return [((keys[a:b] % (BUCKETS + 1)).astype(np.int32), counts[a:b].astype(np.int32)) for a, b in zip(at[:-1], at[1:])]


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, k: int, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(weights, bias) of k classes by FTRL-proximal; rows: indices and values of each document's features."""
    z, n = np.zeros((BUCKETS, k)), np.zeros((BUCKETS, k))
    zb, nb = np.zeros(k), np.zeros(k)

    def weights(z: np.ndarray, n: np.ndarray, l1: float) -> np.ndarray:
        shrunk = np.sign(z) * l1 - z
        return np.where(np.abs(z) <= l1, 0.0, shrunk / ((beta + np.sqrt(n)) / alpha + l2))

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            w, b = weights(z[at], n[at], l1), weights(zb, nb, 0.0)
            s = x @ w + b
            p = np.exp(s - s.max())
            p /= p.sum()
            p[labels[i]] -= 1
            g = x[:, None] * p
            old = n[at]
            n[at] = old + g * g
            z[at] += g - (np.sqrt(n[at]) - np.sqrt(old)) / alpha * w
            sb = (np.sqrt(nb + p * p) - np.sqrt(nb)) / alpha
            zb += p - sb * b
            nb += p * p
    return weights(z, n, l1), weights(zb, nb, 0.0)


def fit_temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least negative log likelihood on these rows, by golden-section search on its
    logarithm; 1 without rows."""
    if not len(scores):
        return 1.0

    def loss(t: float) -> float:
        s = scores / math.exp(t)
        s = s - s.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), labels]))

    a, b, r = math.log(0.05), math.log(20.0), (math.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return math.exp((a + b) / 2)


class LanguageModel:
    """Languages, a table of each bucket's idf times weight, bias and temperature."""

    def __init__(self, languages: list[str], table: np.ndarray, bias: np.ndarray, temperature: float):
        self.languages, self.bias, self.temperature = languages, bias, temperature
        self.table = np.ascontiguousarray(np.vstack([table, np.zeros((1, table.shape[1]))]).T)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        k = len(self.languages)
        sums, counts = np.zeros((len(texts), k)), np.zeros(len(texts))
        for index, parts, _ in pieces(texts):
            grams, offsets = ngrams(parts)
            counted = np.concatenate([[0], np.cumsum(grams != BUCKETS)])[offsets]
            some = offsets[1:] > offsets[:-1]
            np.add.at(counts, index, np.diff(counted))
            for j in range(k):
                np.add.at(sums[:, j], index[some], np.add.reduceat(self.table[j][grams], offsets[:-1][some]))
        lettered = np.array([any(map(str.isalpha, t or "")) for t in texts], bool) & (k > 0)
        if not k:
            return ["und"] * len(texts), np.zeros(len(texts))
        s = (SCALE * sums / np.maximum(counts, 1)[:, None] + self.bias) / self.temperature
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return [self.languages[b] if ok else "und" for b, ok in zip(best, lettered)], np.where(lettered, p[np.arange(len(p)), best], 0.0)


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, sample: int = SAMPLE) -> LanguageModel:
    """Fits on columns doc_id, text and lang; all rows count for the document frequencies, a hashed sample of about
    min(per_language, sample / languages) documents of each language for the weights."""
    rows = docs.filter("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0)
    names = sorted(sizes)

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            for at, _ in sparse_counts(batch["text"].tolist()):
                total[at] += 1
            total[BUCKETS] += len(batch)
        some = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": some, "n": total[some]})

    # at most BUCKETS + 1 rows
    found = rows.select("text").mapInPandas(frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(BUCKETS + 1)
    df[found["bucket"]] = found["n"]
    idf = np.log((1 + df[BUCKETS]) / (1 + df[:BUCKETS])) + 1

    want = max(1, min(per_language, sample // len(names)))
    share = F.create_map(*[F.lit(x) for name in names for x in (name, min(1.0, want / sizes[name]))])
    drawn = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("language")), F.lit(1 << 30)) / float(1 << 30)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = sparse_counts(batch["text"].tolist())
            yield pd.DataFrame({"doc": batch["doc"], "lang": batch["lang"], "at": [at.astype(np.uint16).tobytes() for at, _ in found], "n": [n.tobytes() for _, n in found]})

    picked = rows.filter(drawn < F.element_at(share, F.col("lang"))).select(F.col("doc_id").cast("string").alias("doc"), "lang", "text")
    got = [r for r in picked.mapInPandas(features, "doc string, lang string, at binary, n binary").collect() if r["at"]]
    got.sort(key=lambda r: (r["doc"] is None, r["doc"] or "", r["lang"], r["at"], r["n"]))
    labels = np.array([names.index(r["lang"]) for r in got], dtype=np.int64)
    vectors = []
    for r in got:
        at, n = np.frombuffer(r["at"], np.uint16), np.frombuffer(r["n"], np.int32)
        vectors.append((at, (SCALE * n / n.sum() * idf[at]).astype(np.float32)))
    spare = np.arange(len(vectors)) % 5 == 4
    weights, bias = train_ftrl([v for v, s in zip(vectors, spare) if not s], labels[~spare], len(names))
    scores = np.array([x @ weights[a] + bias for (a, x), s in zip(vectors, spare) if s]).reshape(-1, len(names))
    return LanguageModel(names, idf[:, None] * weights, bias, fit_temperature(scores, labels[spare]))


def predict_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Adds lang_pred and score to docs."""

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def predict(texts: pd.Series) -> pd.DataFrame:
        langs, scores = model.predict(texts.tolist())
        return pd.DataFrame({"lang_pred": langs, "score": scores})

    (held,) = unused(docs, "_lang")
    out = docs.withColumn(held, predict(F.col("text")))
    return out.withColumns({"lang_pred": F.col(f"{held}.lang_pred"), "score": F.col(f"{held}.score")}).drop(held)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; documents whose crc32(doc_id) mod 4 is 2 are held out of training."""
    docs = columns_of(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", "lang")
    docs = docs.withColumn("held_out", F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False)))
    model = fit(docs.filter(~F.col("held_out")).select("doc_id", "text", "lang"))
    return predict_language(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")
