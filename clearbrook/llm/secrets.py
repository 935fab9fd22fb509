"""Secret scan with false-positive removal by a random forest, with DataFrame functions only.

A pattern finds candidates: private-key headers, values assigned to names that end in a password word, passwords of
urls, and runs of 16 or more characters of key alphabets that hold both letters and digits, have a provider's prefix or
are assigned to a secret's name.  Each gets numeric features - length, character transitions,
alphabets, dictionary coverage, path signs, neighbouring words - and a random forest trained on labelled findings
gives the probability that it is a secret.

Positions are code points of the whole text.  Nulls and odd rows: a null or empty text has no finding; one text may have
many, none is left out; each of repeated rows has its own; an empty table gives an empty result; other columns are
left as they are, whatever their names (only the two that are asked for replace columns of theirs).

The training findings are made up: no labelled findings exist in the tables.  The dictionary is a fixed word list and the
DICTIONARY words that most documents hold, counted over all of them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from py4j.java_gateway import JavaObject
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns_of, unused

# The parts of the candidate pattern.
HEADER = "-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----(?:(?:[A-Za-z0-9+/=\\s:,.]++|-(?!----))*+-----END [A-Z ]{0,30}PRIVATE KEY-----)?+"
NAME = "[A-Za-z0-9_.-]{0,40}(?:password|passwd|passphrase|pwd)\\b[\"']?\\s{0,2}[:=]\\s{0,2}[\"']?"
ASSIGNED = f"(?i:(?<![A-Za-z0-9_.-]){NAME}[^\\s\"',;<>]{{8,}})"
LOGIN = "(?<=:)(?<=://[^\\s/:@]{0,64}:)[^\\s/@\"'<>]{3,}+(?=@)"
EDGE = "(?<![A-Za-z0-9+/_-])"
BOTH = "(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])"
ISSUED = "(?=gh[pousr]_[A-Za-z0-9]{30}|[sr]k_live_[A-Za-z0-9]{16}|npm_[A-Za-z0-9]{30}|A[KS]IA[0-9A-Z]{16}(?![A-Za-z0-9]))"
SECRET_NAME = "(?<=(?i:secret|token|credential|(?:api|access|private|auth|encryption|signing)[_ -]?key)[A-Za-z0-9_-]{0,12}[\"']?\\s{0,2}[:=]\\s{0,2}[\"'`]?)"
RUN = f"{EDGE}(?=[A-Za-z0-9+/_-]{{16}})(?:{BOTH}|{ISSUED}|{SECRET_NAME})[A-Za-z0-9+/_-]{{16,}}+={{0,2}}"
CANDIDATE = f"{HEADER}|{ASSIGNED}|{LOGIN}|{RUN}"
PROVIDER = "^(?:A[KS]IA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|glpat-|xox[abprs]-|AIza[0-9A-Za-z_-]{30,}|[sr]k_live_|npm_|eyJ[A-Za-z0-9_-]{10,}|-----BEGIN)"
SECRET_WORDS = "token|secret|api[_ -]?key|access[_ -]?key|private[_ -]?key|passw(?:or)?d|passphrase|pwd|credential|\\bauth\\b|authoriz|bearer|client[_ -]?secret"
BENIGN_WORDS = "commit|sha-?\\d*|md5|checksum|digest|hash|uuid|guid|revision|build|version|integrity|etag|fingerprint|isbn|order|invoice|trace|span|request"
SAMPLE_WORDS = "example|sample|dummy|placeholder|changeme|your[_-]|xxxx|test|fake|redacted|abcdef|123456|0000"
WORDS = """
about account action address after agent article author background before block board branch build button call case
change class client code color column command commit common config content control count create data date default
delete design detail device document draft element entry error event example export extra feature field file filter
first format forward from function general group guide handle header height hello history home html http image import
index info input install item just label language large last layer layout length level library light line link list
local location login long main manager master media menu message method mobile model module name network node note
number object only open option order other output package page parent part path people photo place plan player point
post price print private process product profile project public query quick random range read record release remove
report request resource response result return right river root sample schema screen script search section select
server service session setting short simple single site size small source space start state static station status
stop store story stream string style submit summer support system table target task team template test text theme
thread time title today total track type unit update upload user value version video view water web week window work
world write year
""".split()
#: The corpus's words that the dictionary has besides WORDS.
DICTIONARY = 200
#: What the findings' values become in a scrubbed text.
MASK = "[REDACTED]"

#: Characters of text that count as neighbours of a candidate.
NEAR = 48

FINDINGS = "findings"
FEATURES = [
    "length", "letter_digit", "case_change", "digits", "distinct", "hex", "uuid", "coverage", "separators", "in_path",
    "has_slash", "secret_word", "benign_word", "sample_word", "assigned", "quoted", "provider", "vowels", "upper", "login",
]


def located(docs: DataFrame) -> DataFrame:
    """Adds a struct to docs, under a name that unused(docs, "_at") gives: gaps and values, arrays whose parts in turn make
    up the text up to the last candidate, rest, the text behind it, and found: array<struct<start, value, before, after>>."""
    # \\G: once the rest has no candidate, the search ends instead of starting over at each of its characters
    pattern = F.lit(f"(?s)\\G(.*?)({CANDIDATE})")
    has = F.coalesce(F.col("text").rlike(CANDIDATE), F.lit(False))
    none = F.array().cast("array<string>")
    at, cut, ends_ = unused(docs, "_at", "_cut", "_ends")
    gaps, values = F.col(f"{cut}.gaps"), F.col(f"{cut}.values")
    part = lambda i: F.when(has, F.regexp_extract_all("text", pattern, i)).otherwise(none)
    out = docs.withColumn(cut, F.struct(part(1).alias("gaps"), part(2).alias("values")))
    ends = F.aggregate(
        F.arrays_zip(gaps.alias("g"), values.alias("v")),
        F.array(F.lit(0)),
        lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + F.length(x["g"]) + F.length(x["v"]))),
    )
    out = out.withColumn(ends_, ends)
    rest = F.when(F.size(values) > 0, F.substring(F.col("text"), F.element_at(ends_, -1) + 1, F.length("text"))).otherwise(F.col("text"))
    after = lambda i: F.substring(F.coalesce(F.get(gaps, i + 1), rest), 1, NEAR)
    found = F.transform(values, lambda v, i: F.struct((F.get(ends_, i + 1) - F.length(v)).alias("start"), v.alias("value"), F.right(F.get(gaps, i), F.lit(NEAR)).alias("before"), after(i).alias("after")))
    return out.withColumn(at, F.struct(gaps.alias("gaps"), values.alias("values"), rest.alias("rest"), found.alias("found"))).drop(cut, ends_)


def dictionary(docs: DataFrame, most: int = DICTIONARY) -> list[str]:
    """WORDS and the words of 4 to 12 letters that most documents hold, ties in alphabetical order."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("(?<![a-z])[a-z]{4,12}(?![a-z])"), 0))
    top = docs.select(F.explode(words).alias("w")).groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(most)
    return sorted({*WORDS, *(r["w"] for r in top.collect())})


def features(found: Column, words: list[str]) -> Column:
    """For each candidate an array of its numeric features in FEATURES' order; words: the dictionary."""
    known = "|".join(sorted(words, key=lambda w: (-len(w), w)))
    name = f"(?is)^{NAME}"

    def prepared(x: Column) -> Column:
        near = F.lower(F.concat(x["before"], F.lit(" "), x["after"]))
        return F.struct(F.regexp_replace(x["value"], name, "").alias("k"), x["value"].rlike(name).alias("named"), near.alias("near"), x["before"].alias("before"), x["after"].alias("after"))

    def numbers(x: Column) -> Column:
        k, before, near, named = x["k"], x["before"], x["near"], x["named"]
        n = F.greatest(F.length(k), F.lit(1))
        share = lambda pattern: F.regexp_count(k, F.lit(pattern)) / n
        made = {
            "length": F.length(k),
            "letter_digit": share("(?<=[A-Za-z])[0-9]|(?<=[0-9])[A-Za-z]"),
            "case_change": share("(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]"),
            "digits": share("[0-9]"),
            "distinct": F.size(F.array_distinct(F.split(k, ""))) / F.least(n, F.lit(64)),
            "hex": k.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"),
            "uuid": k.rlike("^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$"),
            "coverage": 1 - F.length(F.regexp_replace(F.lower(k), known, "")) / n,
            "separators": share("[-_/]"),
            "in_path": before.rlike("(?:/|\\\\|www\\.|://\\S{0,40})$"),
            "has_slash": k.rlike("/\\S*[./-]"),
            "secret_word": near.rlike(SECRET_WORDS) | named,
            "benign_word": near.rlike(f"\\b(?:{BENIGN_WORDS})\\b"),
            "sample_word": F.lower(k).rlike(SAMPLE_WORDS),
            "assigned": before.rlike("[:=]\\s{0,2}[\"'`]?$") | named,
            "quoted": before.rlike("[\"'`]$"),
            "provider": k.rlike(PROVIDER),
            "vowels": share("(?i)[aeiou]"),
            "upper": share("[A-Z]"),
            "login": before.rlike("(?:://|^)[^\\s/:@]*:$") & x["after"].startswith("@"),
        }
        return F.array(*[F.coalesce(made[f].cast("double"), F.lit(0.0)) for f in FEATURES])

    return F.transform(F.transform(found, prepared), numbers)


def labelled_findings(spark: SparkSession, n: int = 2_400) -> DataFrame:
    """(text, label): a bounded set of findings whose label is known, made from a running number: keys in the forms
    and places that leak, and identifiers, digests, paths and placeholders that look like them."""
    i = F.col("id")
    seed = F.concat(F.lit("finding-"), i.cast("string"))
    md5, sha1, sha2 = F.md5(seed), F.sha1(seed), F.sha2(seed, 256)
    base = F.regexp_replace(F.base64(F.unhex(sha2)), "[+/=]", "x")
    pick = lambda names, salt: F.element_at(F.array(*[F.lit(x) for x in names]), (F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(len(names))) + 1).cast("int"))
    w = lambda salt: pick(WORDS, salt)
    form = F.pmod(i, F.lit(28))
    uuid = F.concat_ws("-", F.substring(md5, 1, 8), F.substring(md5, 9, 4), F.substring(md5, 13, 4), F.substring(md5, 17, 4), F.substring(md5, 21, 12))
    slug = F.concat(w("s1"), F.lit("-"), w("s2"), F.lit("-"), w("s3"), F.lit("-"), F.substring(md5, 1, 1), (F.pmod(i, F.lit(900)) + 100).cast("string"))
    path = F.concat(w("p1"), F.lit("/"), w("p2"), F.lit("/"), w("p3"), F.lit("/v"), F.pmod(i, F.lit(90)).cast("string"))
    camel = F.concat(w("c1"), F.initcap(w("c2")), F.initcap(w("c3")), F.initcap(w("c4")), F.pmod(i, F.lit(90)).cast("string"))
    akia = F.concat(F.lit("AKIA"), F.upper(F.substring(F.translate(md5, "0189", "GHJK"), 1, 15)), F.lit("7"))
    ghp = F.concat(F.lit("ghp_"), F.substring(base, 1, 36))
    word = F.concat(F.initcap(w("w1")), F.substring(md5, 1, 3), F.lit("!"), w("w2"), F.pmod(i, F.lit(97)).cast("string"))
    fake = F.concat(pick(["your_api_key_here_", "example-token-", "dummy_secret_value_", "xxxxxxxxxxxxxxxx", "abcdef0123456789", "placeholder_key_"], "ph"), F.pmod(i, F.lit(90)).cast("string"))
    letters = F.translate(base, "0123456789", "QwErTyUiOp")
    stand_in = pick(["password", "pass", "changeme", "secret", "xxxxxx", "your_password", "example", "PASSWORD"], "st")
    plain_name = F.when(F.pmod(i, F.lit(3)) == 0, F.concat_ws("_", w("n1"), w("n2"), w("n3"), w("n4"))).otherwise(F.concat(w("n1"), F.initcap(w("n2")), F.initcap(w("n3")), F.initcap(w("n4"))))
    # forms 0 to 11, 24 and 25 are secrets
    values = [sha1, md5, F.substring(base, 1, 32), akia, ghp, base, F.concat(F.lit("sk_live_"), F.substring(base, 1, 24)), F.upper(sha1), sha2, word, pick(["-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----", "-----BEGIN OPENSSH PRIVATE KEY-----"], "h"), F.when(F.pmod(F.floor(i / 28), F.lit(2)) == 0, akia).otherwise(ghp), sha1, md5, uuid, slug, path, camel, fake, sha2, F.concat(w("v1"), F.lit("_"), camel), F.concat(path, F.lit("-"), md5), F.upper(md5), F.substring(sha2, 1, 24), F.substring(letters, 1, F.pmod(i, F.lit(20)) + 20), F.when(F.pmod(F.floor(i / 28), F.lit(2)) == 0, word).otherwise(F.substring(base, 1, 14)), plain_name, stand_in]
    value = F.element_at(F.array(*values), (form + 1).cast("int"))
    open_ = ["token = \"{}\"", "api_key: {}", "export SECRET_KEY={}", "Authorization: Bearer {}", "client_secret = '{}'", "access_key = {}", "TOKEN = \"{}\"", "auth token {}", "set credential {}", "x-api-key: \"{}\"", "secret {}", "AWS_ACCESS_KEY_ID={}", "aws_secret_access_key={}", "https://host.invalid/x?token={}"]
    given = ["token = \"{}\"", "api_key: {}", "export SECRET_KEY={}", "client_secret = '{}'", "access_key = {}", "TOKEN={}", "https://host.invalid/x?token={}"]
    login = ["postgres://{w}:{}@db.invalid/{w}", "https://{w}:{}@host.invalid/", "redis://:{}@host.invalid:6379", "amqp://{w}:{}@queue.invalid"]
    named = ["commit {}", "sha256: {}", "md5sum {}", "request {}", "uuid={}", "checksum = {}", "revision \"{}\"", "etag: \"{}\"", "build {}", "digest {}", "trace {}"]
    plain = ["see https://host.invalid/{}", "in {} we", "file /srv/{}", "the {} of", "class {}", "id \"{}\"", "name = {}", "href=\"/{}\"", "https://host.invalid/x?id={}", "page={}"]
    place = (
        F.when(form <= 8, pick(open_, "a")).when(form == 9, pick(["password: {}", "password = \"{}\"", "pwd={}", "PASSWORD: '{}'", "DB_PASSWORD={}", "db_password: '{}'", "mysqlPassword = \"{}\""], "pw")).when(form <= 11, pick([*plain, "", "{}"], "b"))
        .when(form.isin(12, 13, 19, 22, 23), pick(named, "c")).when(form == 14, pick(named + plain, "d")).when(form == 18, pick(open_, "e")).when(form.isin(24, 26), pick(given, "g")).when(form.isin(25, 27), F.replace(pick(login, "l"), F.lit("{w}"), w("l2"))).otherwise(pick(plain, "f"))
    )
    place = F.when(place == "", "{}").otherwise(place)
    text = F.concat_ws(" ", w("t1"), w("t2"), w("t3"), F.replace(place, F.lit("{}"), value), w("t4"), w("t5"))
    # signs run into some words, and some findings stand alone
    text = F.when(F.pmod(F.xxhash64(i, F.lit("sign")), F.lit(4)) == 0, F.concat(text, F.lit("!!"))).when(F.pmod(F.xxhash64(i, F.lit("sign")), F.lit(4)) == 1, F.replace(place, F.lit("{}"), value)).otherwise(text)
    return spark.range(n).select(text.alias("text"), ((form <= 11) | form.isin(24, 25)).cast("double").alias("label"))


#: A tree: (feature, threshold, left, right), or the probability at a leaf.
Tree = tuple[int, float, "Tree", "Tree"] | float


def _tree(node: JavaObject) -> Tree:
    if node.subtreeDepth() == 0:
        stats = list(node.impurityStats().stats())
        return stats[1] / sum(stats)
    split = node.split()
    left, right = _tree(node.leftChild()), _tree(node.rightChild())
    return left if left == right else (split.featureIndex(), split.threshold(), left, right)


@dataclass
class Forest:
    """Trees, and the dictionary that the feature of coverage looks words up in."""

    trees: list[Tree]
    words: list[str]


def train_forest(labelled: DataFrame, words: list[str] | None = None, trees: int = 24, depth: int = 7) -> Forest:
    """Fits on columns text and label (1.0: secret), every candidate of a text having its label."""
    words = WORDS if words is None else words
    rows = located(labelled.select("text", "label").coalesce(1)).select("label", F.explode(features(F.col("_at.found"), words)).alias("x"))
    vectors = rows.select("label", array_to_vector("x").alias("features"))
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=8, featureSubsetStrategy="sqrt").fit(vectors)
    return Forest([_tree(t._java_obj.rootNode()) for t in model.trees], words)


def trained_on(docs: DataFrame) -> Forest:
    """The forest that the query and the pipeline share: made-up findings, and the dictionary of these documents."""
    return train_forest(labelled_findings(docs.sparkSession), dictionary(columns_of(docs, "text")))


def forest_score(x: Column, forest: list[Tree]) -> Column:
    """The mean of the trees' leaves for an array of features, as one expression."""

    def walk(t: Tree) -> Column:
        if isinstance(t, float):
            return F.lit(t)
        return F.when(F.get(x, F.lit(t[0])) <= t[1], walk(t[2])).otherwise(walk(t[3]))

    return reduce(lambda a, b: a + b, map(walk, forest)) / len(forest)


def scan(docs: DataFrame, forest: Forest, threshold: float = 0.5, out: str = FINDINGS, clean: str = "scrubbed") -> DataFrame:
    """docs with two columns, which replace any of their names: ``out``, an array of struct<start, value, score, secret>
    with all candidates, and ``clean``, the text with MASK in place of every secret.  Rows stay where they are: nothing is shuffled or exploded."""
    rows = located(docs)
    at = rows.columns[-1]
    (scores, judged) = unused(rows, "_scores", "_judged")
    rows = rows.withColumn(scores, F.transform(features(F.col(f"{at}.found"), forest.words), lambda x: forest_score(x, forest.trees)))
    found = F.transform(F.col(f"{at}.found"), lambda f, i: F.struct(f["start"].alias("start"), f["value"].alias("value"), F.get(scores, i).alias("score"), (F.get(scores, i) >= threshold).alias("secret")))
    rows = rows.withColumn(judged, found)
    parts = F.transform(F.col(f"{at}.gaps"), lambda g, i: F.concat(g, F.when(F.get(judged, i)["secret"], F.lit(MASK)).otherwise(F.get(F.col(f"{at}.values"), i))))
    text = F.when(F.exists(judged, lambda f: f["secret"]), F.concat(F.array_join(parts, ""), F.col(f"{at}.rest"))).otherwise(F.col("text"))
    return rows.withColumns({out: F.col(judged), clean: text}).drop(at, scores, judged)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every document: where it stands, its digest, the forest's score and verdict."""
    docs = columns_of(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    found = scan(docs, trained_on(docs)).select("doc_id", F.explode(FINDINGS).alias("f"))
    return found.select("doc_id", "f.start", F.length("f.value").alias("chars"), F.sha2(F.col("f.value").cast("binary"), 256).alias("value_sha256"), "f.score", "f.secret")
