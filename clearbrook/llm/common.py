"""What several corpus operators share: shared-folder tables, text batches as numpy arrays, word spans."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Code points that one numpy pass holds, unless a run without white space is longer.
PIECE = 1_000_000

#: The engine's setting by which a finished query's shuffle files are deleted.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: By session, the folder in the shared one that holds its tables.
_folders: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; on a single machine one of our own where it
    is unset."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="clearbrook-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from a table in the session's folder: lineage ends there, and a lost executor
    costs no recomputation of what came before.  The shuffle files that led there are deleted.  forget() deletes one table,
    release() all of them."""
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    if app not in _folders:
        _folders[app] = f"{shared_dir(spark)}/clearbrook-{uuid.uuid4().hex}"
        atexit.register(release, spark)
    path = f"{_folders[app]}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def forget(df: DataFrame) -> None:
    """Deletes a table of written() that no later plan reads."""
    for folder in {x.rpartition("/")[0] for x in df.inputFiles()}:
        _delete(df.sparkSession, folder)


def release(spark: SparkSession) -> None:
    """Deletes all tables of the session, which the results of operators may read until then; runs by itself when the
    program ends with its session still open."""
    if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        return
    folder = _folders.pop(spark.sparkContext.applicationId, None)
    if folder:
        _delete(spark, folder)


def unused(df: DataFrame, *names: str) -> list[str]:
    """For each name one like it that no column of df has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def numbered(docs: DataFrame) -> DataFrame:
    """(rid, doc): every row, as a struct, under a number that lasts; a table of written()."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return written(docs.select(F.monotonically_increasing_id().alias("rid"), row.alias("doc")), "rows")


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(c, upper, upper.lower())


def crc_mod(c: Column, n: int) -> Column:
    """crc32 of a value's text, modulo n; null for null."""
    return F.crc32(c.cast("string").cast("binary")) % n


def columns_of(df: DataFrame, *names: str) -> DataFrame:
    """Only these columns, under these names whatever the case they are stored in; a missing one is null."""
    by = {c.lower(): c for c in reversed(df.columns)}
    return df.select(*[(F.col(f"`{by[n.lower()]}`") if n.lower() in by else F.lit(None).cast("string")).alias(n) for n in names])


# --- texts as arrays ---------------------------------------------------------------------------------------------


def pieces(texts: list[str | None], limit: int = PIECE) -> Iterator[tuple[np.ndarray, list[str], list[bool]]]:
    """Groups of about ``limit`` code points: the index of each part's text, the parts, and whether each goes on where
    the part before it ended.  A longer text is cut behind white space only, so no word is ever cut."""
    index: list[int] = []
    parts: list[str] = []
    more: list[bool] = []
    held = 0
    for i, t in enumerate(texts):
        t = t or ""
        at = 0
        while at == 0 or at < len(t):
            end = min(len(t), at + limit)
            if end < len(t):
                cut = max(t.rfind(x, at, end) for x in " \n\t\r")
                end = cut + 1 if cut >= at else min((k + 1 for x in " \n\t\r" if (k := t.find(x, end)) >= 0), default=len(t))
            if held and held + end - at > limit:
                yield np.array(index), parts, more
                index, parts, more, held = [], [], [], 0
            index.append(i)
            parts.append(t[at:end])
            more.append(at > 0)
            held += end - at
            at = end
            if not t:
                break
    if parts:
        yield np.array(index), parts, more


def code_points(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points in a row, and the offset of each part (one more at the end)."""
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return codes, np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def word_spans(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and part of every word (see WORD); a part's border ends a word."""
    inside = (codes != 32) & ~((codes >= 9) & (codes <= 13))
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    border = offsets[1:-1]
    border = border[(border > 0) & (border < len(codes))]
    first[border] |= inside[border]
    last[border - 1] |= inside[border - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(10, (n + 1).bit_length())
    if not _powers or next(iter(_powers)) < size:
        up, down = np.full(size, _BASE), np.full(size, _INVERSE)
        up[0] = down[0] = 1
        _powers.clear()
        _powers[size] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return next(iter(_powers.values()))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (finaliser of the splitmix generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_sums(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of the values by the base's powers, and the inverse powers: (sums[e] - sums[s]) * inverse[s] depends
    on the values from s to e alone."""
    up, down = _power_tables(len(values))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=sums[1:])
    return sums, down


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's values; equal spans hash alike wherever they stand."""
    sums, down = span_sums(codes)
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
