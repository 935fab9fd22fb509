"""URL filter: explicit rules first, then multinomial naive Bayes on words that a unigram Viterbi splits hosts into.

Host names run words together ("bestcasinobonus").  The unigram model has a log probability for each word: half of it
goes to the words of the labelled urls, half to the separated letter runs of every url of the table, by the root of
their counts; anything else costs by its letters.  Viterbi finds the most probable split.  Naive Bayes then scores the
host's and the path's words, which are features apart ("h:casino", "p:casino").

No list of words is cut: up to MAX_WORDS different ones go to the executors at once; where there are more, the letter runs'
parts look their costs up by a join, with the same result.  The Bayes model is fitted on labelled urls; those given here
(labelled()) are made up, since the tables have none: hosts and paths of the SEEDS' words, each with its label.

Nulls and odd rows: a null url, or one without "://", has an empty host and an empty path, no rule, and the
verdict of the prior alone (allow); repeated rows are judged each; an empty table gives an empty result; other
columns are ignored.  Long urls are judged whole.  Words that two labels share score 0; a score of just the threshold
blocks.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns_of, lower_ascii, written

# The rules as (verdict, host and path); a rule fits its host and all subdomains.
RULES = [
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
]

# Labelled host and path examples that the Bayes model is fitted on.
SEEDS_BLOCK = """
cheap-pills/buy-now discount-pharmacy/order casino-win/bonus online-casino/slots freespins/jackpot best-poker/deal
spam-farm/links link-farm/seo replica-watches/sale cheap-meds/no-prescription pills-online/cheap adult-dating/hot
hot-singles/chat xxx-tube/video porn-videos/free sex-cam/live escort-service/city payday-loans/fast quick-cash/loan
free-iphone/winner lottery-win/claim click-bait/offer buy-followers/cheap get-rich/crypto bitcoin-double/profit
miracle-diet/weight-loss fake-degree/buy cracked-software/download warez-keygen/serial torrent-movies/free
ad-tracker/pixel ads-banner/click popup-ads/track betting-tips/win sports-bet/bonus slot-machine/free-money viagra-cheap/online cialis-store/buy spam-offers/deal
""".split()
SEEDS_ALLOW = """
city-library/catalogue open-science/article university/research school-district/news museum/collection
weather-service/forecast public-health/report daily-news/world technology-blog/post garden-club/plants
recipe-book/kitchen travel-guide/city history-archive/document music-review/album film-journal/essay
code-docs/manual data-portal/dataset language-learning/lesson math-forum/question physics-notes/lecture
county-government/service law-review/article book-club/reading bicycle-repair/guide astronomy-club/events
child-care/advice farm-market/season win-server/manual online-course/lesson bank-branch/hours
photo-blog/gallery local-history/map hiking-trails/park water-quality/report poetry-magazine/issue
""".split()

#: Different words that go to the executors as one list; more are looked up by a join.
MAX_WORDS = 200_000
#: What a letter costs that no word of the labelled urls accounts for.
LETTER = 1.2
#: How often a part that no url has counts as seen.
UNSEEN = 0.5
#: Words that say nothing about a site.
PLAIN = {"www", "blog", "com", "net", "org", "html", "htm", "php", "index", "http", "https"}


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    rest = F.regexp_extract(rest, r"(?s)^([^?#]*)", 1)
    return lower_ascii(F.regexp_extract(rest, r"(?s)^([^/]*)", 1)), F.regexp_extract(rest, r"(?s)^[^/]*(.*)$", 1)


def match_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest fitting rule as struct<rule, verdict>; null where none fits."""
    cases = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1], r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        hit = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        cases = F.when(fits, hit) if cases is None else cases.when(fits, hit)
    return cases if cases is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def word_counts(urls: DataFrame) -> DataFrame:
    """(w, n): the separated letter runs of all urls' hosts and paths, and how often each occurs."""
    host, path = split_url(F.col("url"))
    words = urls.select(F.explode(F.regexp_extract_all(F.concat_ws("/", host, lower_ascii(path)), F.lit("[a-z]{2,}"), 0)).alias("w"))
    return words.groupBy("w").agg(F.count("*").alias("n"))


class Segmenter:
    """Unigram Viterbi.  roots: the root of each corpus word's count; total: their sum over all words."""

    def __init__(self, roots: dict[str, float], known: set[str], total: float):
        self.known, self.total = known, max(total, 1.0)
        self.given = math.log(2 * max(len(known), 1))
        # a run that is only known as a whole costs its letters besides, so that it is split where its words are known
        self.cost = {w: math.log(2 * self.total / r) + LETTER * len(w) for w, r in roots.items()}
        self.cost |= {w: min(self.given, math.log(2 * self.total / roots[w]) if w in roots else math.inf) for w in known}
        self.unknown = math.log(2 * self.total / math.sqrt(UNSEEN))
        self.longest = max(map(len, self.cost), default=1)
        self.split = lru_cache(200_000)(self._split)

    def _split(self, run: str) -> tuple[str, ...]:
        """The cheapest parts; a part that is no word costs by its letters, whatever its length."""
        n = len(run)
        best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
        strange, begun = math.inf, 0  # the cheapest way to have an unknown part running up to here, and where it began
        for end in range(1, n + 1):
            if best[end - 1] + self.unknown <= strange:
                strange, begun = best[end - 1] + self.unknown, end - 1
            strange += LETTER
            best[end], back[end] = strange, begun
            for start in range(max(0, end - self.longest), end):
                c = self.cost.get(run[start:end])
                if c is not None and best[start] + c < best[end]:
                    best[end], back[end] = best[start] + c, start
        out, end = [], n
        while end:
            out.append(run[back[end] : end])
            end = back[end]
        return tuple(reversed(out))

    def features(self, host: str, path: str) -> list[str]:
        """Words of more than one letter, marked by where they stand."""
        return marked(host, path, self.split)


def marked(host: str, path: str, split: Callable[[str], Sequence[str]]) -> list[str]:
    return [f"{k}:{w}" for k, text in (("h", host), ("p", path)) for run in re.findall("[a-z]+", lower(text)) for w in split(run) if len(w) > 1 and w not in PLAIN]


def lower(text: str) -> str:
    """A-Z lower-cased, as lower_ascii() does."""
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def joined_splits(urls: DataFrame, counts: DataFrame, known: set[str], total: float) -> DataFrame:
    """(run, parts): the split of every letter run of the urls, the words' counts being joined to the runs' parts."""
    host, path = split_url(F.col("url"))
    runs = urls.select(F.explode(F.regexp_extract_all(F.concat_ws("/", host, lower_ascii(path)), F.lit("[a-z]+"), 0)).alias("run")).distinct()
    longest = counts.agg(F.coalesce(F.max(F.length("w")), F.lit(0))).first()[0]
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.length("run")), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.length("run") - i + 1, F.lit(longest))), lambda m: F.substr("run", i, m))))
    parts = runs.filter(F.lit(longest) > 0).select("run", F.explode(F.array_distinct(spans)).alias("w")).filter("length(w) > 1")
    found = parts.join(counts, "w").groupBy("run").agg(F.map_from_entries(F.collect_list(F.struct("w", F.sqrt("n").alias("r")))).alias("roots"))

    @F.pandas_udf("array<string>")
    def split(run: pd.Series, roots: pd.Series) -> pd.Series:
        return pd.Series([list(Segmenter(dict(r or {}), known, total).split(x)) for x, r in zip(run, roots)], index=run.index, dtype=object)

    return runs.join(found, "run", "left").select("run", split("run", "roots").alias("parts"))


class NaiveBayes:
    """Multinomial, with additive smoothing; words that no labelled url has are left out of a score."""

    def __init__(self, rows: list[tuple[list[str], int]], smooth: float = 0.5, prior: float = 0.1):
        counts = [Counter(), Counter()]
        for words, label in rows:
            counts[label].update(words)
        known = set(counts[0]) | set(counts[1])
        totals = [sum(c.values()) + smooth * (len(known) + 1) for c in counts]
        self.weight = {w: math.log((counts[1][w] + smooth) / totals[1]) - math.log((counts[0][w] + smooth) / totals[0]) for w in known}
        self.bias = math.log(prior / (1 - prior))

    def score(self, words: list[str]) -> float:
        z = self.bias + sum(self.weight.get(w, 0.0) for w in words)
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def single_words(runs: Iterable[str]) -> set[str]:
    """The runs that don't consist of two or more others: the words of examples whose hosts run words together."""
    found: set[str] = set()
    for run in sorted(set(runs), key=lambda w: (len(w), w)):
        ends = [True] + [False] * len(run)  # whether words found so far reach up to here
        for end in range(2, len(run) + 1):
            ends[end] = any(ends[start] and run[start:end] in found for start in range(end - 1))
        if not ends[-1]:
            found.add(run)
    return found


def labelled(n: int = 3_000) -> list[tuple[str, str, int]]:
    """(host, path, 1 to block), made up: two of one label's words run together or joined by a sign, some with a word
    that says nothing, and a path of that label or none."""
    neutral = ["home", "site", "page", "my", "top", "new", "web", "info", "the", "pro", "zone", "world"]
    out = []
    for label, rows in ((1, SEEDS_BLOCK), (0, SEEDS_ALLOW)):
        words = sorted({w for x in rows for w in re.findall("[a-z]+", x)})
        for i in range(n // 2):
            draw = lambda k, some: some[zlib.crc32(f"{label}/{i}/{k}".encode()) % len(some)]  # noqa: B023, E731
            parts = [draw("a", words), draw("b", words)]
            if draw("c", [0, 0, 1]):
                parts.insert(draw("d", [0, 1, 2]), draw("e", neutral))
            path = draw("f", ["", draw("g", words), draw("g", words) + "/" + draw("h", neutral), draw("h", neutral)])
            out.append((draw("s", ["", "", "-"]).join(parts), path, label))
    return out + [(*x.partition("/")[::2], label) for label, rows in ((1, SEEDS_BLOCK), (0, SEEDS_ALLOW)) for x in rows]


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]] | None = None, examples: list[tuple[str, str, int]] | None = None, threshold: float = 0.5) -> DataFrame:
    """page_id, url, host, path, rule, verdict, spam (the method's probability of block), words (the segmented
    features).  No shuffle but for the word counts, unless there are more than MAX_WORDS of them."""
    urls = columns_of(pages, "page_id", "url")
    counts = written(word_counts(urls), "words")
    size = counts.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.sqrt("n")), F.lit(0.0)).alias("total")).first()
    fits, total = size["n"] <= MAX_WORDS, size["total"]
    examples = labelled() if examples is None else examples
    known = single_words(w for x in [*SEEDS_BLOCK, *SEEDS_ALLOW, *(lower(f"{h}/{p}") for h, p, _ in examples)] for w in re.findall("[a-z]{2,}", x))
    # the examples are split by the words known from them alone, so that a table's words don't change them
    plain = Segmenter({}, known, 1e9)
    bayes = NaiveBayes([(plain.features(h, p), y) for h, p, y in examples])
    weight, bias = bayes.weight, bayes.bias
    host, path = split_url(F.col("url"))
    host_, path_ = F.col("host"), F.col("path")
    out = urls.select("page_id", "url", host.alias("host"), path.alias("path"))
    if fits:
        roots = {r["w"]: math.sqrt(r["n"]) for r in counts.collect()}  # at most MAX_WORDS
        held = urls.sparkSession.sparkContext.broadcast((roots, known, total))

        @F.pandas_udf("array<string>")
        def split(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            s = Segmenter(*held.value)  # once in a task
            for hosts, paths in batches:
                yield pd.Series([s.features(h, p) for h, p in zip(hosts, paths)], index=hosts.index, dtype=object)

        out = out.withColumn("words", split(host_, path_))
    else:
        rows = written(out.withColumn("rid", F.monotonically_increasing_id()), "urls")
        splits = written(joined_splits(urls, counts, known, total), "splits")
        runs = F.regexp_extract_all(lower_ascii(F.col("t")), F.lit("[a-z]+"), 0)
        each = rows.select("rid", F.explode(F.array(F.struct(F.lit("h").alias("k"), host_.alias("t")), F.struct(F.lit("p").alias("k"), path_.alias("t")))).alias("x")).select("rid", "x.k", "x.t")
        each = each.select("rid", "k", F.posexplode(runs).alias("i", "run")).join(splits, "run")
        # a url's words: as many as its letters
        words = each.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("k", "i", "parts"))).alias("x"))
        marks = F.flatten(F.transform("x", lambda x: F.transform(F.filter(x["parts"], lambda w: (F.length(w) > 1) & ~w.isin(*PLAIN)), lambda w: F.concat(x["k"], F.lit(":"), w))))
        out = rows.join(words.select("rid", marks.alias("words")), "rid", "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>"))).drop("rid")

    @F.pandas_udf("double")
    def judge(words: pd.Series) -> pd.Series:
        b = NaiveBayes([])
        b.weight, b.bias = weight, bias
        return words.map(lambda w: b.score(list(w))).astype(float)

    out = out.withColumn("_rule", match_rule(host_, path_, RULES if rules is None else rules)).withColumn("spam", judge("words"))
    verdict = F.coalesce("_rule.verdict", F.when(F.col("spam") >= threshold, "block").otherwise("allow"))
    return out.select("page_id", "url", "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "spam", "words")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    out = filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
    return out.select("page_id", "host", "path", "rule", "verdict", "spam")
