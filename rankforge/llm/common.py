"""What the operators share: word rule, shared folder, written intermediate tables, numpy hashing.

A *word* is a maximal run of characters other than ``[\\x20\\x09-\\x0D]``; ``bytes.split()`` cuts at
exactly these. A null text counts as an empty one everywhere in this package.
"""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java and DuckDB pattern of a word, and of what parts words.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


# --------------------------------------------------------------------------- tables
def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local master, as in tests, may do without one being set."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="shared-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that is run in here go once it has ended, as what it wrote is all that is read later."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


_written: list[tuple[SparkSession, str]] = []


def materialize(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    keep_aside(spark, path)
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keep_aside(spark: SparkSession, path: str) -> None:
    """Notes a folder to be removed at exit."""
    _written.append((spark, path))


def kept_aside() -> list[str]:
    return [path for _, path in _written]


def drop_kept_aside(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        delete(spark, path)
    _written[:] = [(s, p) for s, p in _written if p not in paths]


@atexit.register
def _remove_written() -> None:
    for spark, path in _written:
        try:
            delete(spark, path)
        except Exception:  # the JVM may have gone first
            return


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def skew_join(rows: DataFrame, few: DataFrame, on: tuple[str, ...], how: str = "inner") -> DataFrame:
    """rows joined to few, at most a row for each key, where a key may hold a third of all rows.

    few is written first, so that it comes to the join by a shuffle (or a broadcast, if its written size is small) and not
    out of an aggregation: adaptive execution can then split the hot keys of ``rows`` over tasks.
    """
    return rows.join(materialize(few), list(on), how)


def text_md5(text) -> Column:
    """Of the text as it stands; null counts as empty."""
    return F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


def one_row_each(docs: DataFrame, chosen: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with its columns, whose id and text are those of a row of chosen: doc_id, md5, n.

    n: rows of docs that are alike in both; one of them is returned. Each pair of doc_id and md5 is in chosen once at most.
    """
    columns, names = docs.columns, [f"_c{i}" for i in range(len(docs.columns))]  # free of clashes
    key = lambda i, md5: F.concat(F.coalesce(i.cast("long").cast("string"), F.lit("")), F.lit(":"), md5)
    own = docs.toDF(*names)
    own = own.withColumns({"_key": key(F.col(names[columns.index(id_col)]), text_md5(F.col(names[columns.index(text_col)])))})
    chosen = materialize(chosen.select(key(F.col("doc_id"), F.col("md5")).alias("_key"), F.col("n").alias("_n")))
    hit = own.join(chosen, "_key")  # hot keys are split by adaptive execution
    if not chosen.filter("_n > 1").isEmpty():  # rows alike meet after a first aggregation in place
        hit = hit.filter("_n = 1").unionByName(hit.filter("_n > 1").dropDuplicates(["_key"]))
    return hit.select(*names).toDF(*columns)


#: Python workers give freed memory back to the system early, instead of keeping it beside the JVM.
_WORKER = {"MALLOC_MMAP_THRESHOLD_": "8388608", "MALLOC_TRIM_THRESHOLD_": "16777216", "MALLOC_ARENA_MAX": "1", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def small_workers(spark: SparkSession) -> None:
    for k, v in _WORKER.items():
        spark.sparkContext.environment.setdefault(k, v)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    return int(docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0)


def source_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """Bytes of the files that docs come from, as the planner knows them without reading any; where it doesn't, of the texts."""
    leaves = docs._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(sizes) if max(sizes, default=0) < 1 << 60 else text_bytes(docs, text_col)


# --------------------------------------------------------------------------- arrow
def strings(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and the offset of each text; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


# --------------------------------------------------------------------------- hashing
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
#: For a second fingerprint that shares nothing with the first.
_R = np.uint64(0xA24BAED4963EE407)
_OTHER = np.random.default_rng(20240301).integers(0, 2**64, 256, dtype=np.uint64)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finalizer)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i up to n; base is odd."""
    have = _powers.get(int(base))
    if have is None or len(have[0]) <= n:
        size = max(1024, 1 << max(0, n).bit_length())
        inverse = np.uint64(pow(int(base), -1, 2**64))
        have = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, b, np.uint64))]) for b in (base, inverse))
        if n <= 1 << 22:
            _powers[int(base)] = have
    return have


def prefix_hash(values: np.ndarray, base: np.uint64 = _P) -> np.ndarray:
    """Running polynomial hash: entry i covers values[:i]."""
    out = np.empty(len(values) + 1, np.uint64)
    out[0] = 0
    np.cumsum(values * powers(base, len(values))[0][: len(values)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: np.uint64 = _P) -> np.ndarray:
    """Hash of values[start:end], the same wherever these stand."""
    return mix((prefix[end] - prefix[start]) * powers(base, len(prefix))[1][start])


#: Bytes hashed at once; keeps arrays small however long a text is.
STEP = 1 << 20


class Words:
    """Words of a batch of texts: 64-bit hashes in order, and where each text's words begin."""

    def __init__(self, column, lower: bool = False, space: np.ndarray = _IS_SPACE, heads: tuple[int, ...] = (), twice: bool = False):
        """space: which bytes stand between words. heads: also hash the first so many bytes of longer words (0: not longer).

        twice: hash words (as they are, not lower-cased) a second time, by other numbers for bytes and their places.
        """
        buf, off = strings(column)
        table = _LOWER if lower else _BYTE
        hashes, others, starts, at = [], [], [], 0
        tops: list[list[np.ndarray]] = [[] for _ in heads]
        first = np.zeros(len(buf) + 1, bool)
        first[off] = True
        while at < len(buf):
            end = min(len(buf), at + STEP)
            while end < len(buf) and not (space[buf[end]] or first[end]):
                end = min(len(buf), end + max(1, self._to_break(buf, first, end, space)))
            part = buf[at:end]
            inside = ~space[part]
            begin = inside.copy()
            begin[1:] &= ~inside[:-1] | first[at + 1 : end]
            last = inside.copy()
            last[:-1] &= ~inside[1:] | first[at + 1 : end]
            s, e = np.flatnonzero(begin), np.flatnonzero(last) + 1
            prefix = prefix_hash(table[part])
            hashes.append(span_hash(prefix, s, e))
            for k, own in zip(heads, tops, strict=True):
                own.append(np.where(e - s > k, span_hash(prefix, s, np.minimum(s + k, e)) + np.uint64(k), np.uint64(0)))
            if twice and len(s):
                first_byte = np.cumsum(e - s) - (e - s)
                place = (np.arange(int((e - s).sum())) - np.repeat(first_byte, e - s)).astype(np.uint64)
                others.append(mix(np.add.reduceat(mix(_OTHER[part[inside]] + place * _R), first_byte)))
            starts.append(s + at)
            at = end
        self.hash = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        self.other = np.concatenate(others) if others else np.empty(0, np.uint64)
        self.heads = [np.concatenate(x) if x else np.empty(0, np.uint64) for x in tops]
        start = np.concatenate(starts) if starts else np.empty(0, np.int64)
        #: word i belongs to text d for off[d] <= i < off[d + 1]
        self.off = np.searchsorted(start, off)
        self.n = np.diff(self.off)

    @staticmethod
    def _to_break(buf, first, at: int, space: np.ndarray) -> int:
        part = slice(at, at + 4096)
        stop = np.flatnonzero(space[buf[part]] | first[part][: len(buf[part])])
        return int(stop[0]) if len(stop) else len(buf[part])

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First word of each k-word window that lies in one text, and the windows' hashes."""
        starts = window_starts(self.off, k)
        prefix = prefix_hash(self.hash, _Q)
        return starts, span_hash(prefix, starts, starts + k, _Q)

    def second_windows(self, starts: np.ndarray, k: int) -> np.ndarray:
        """Second hashes of the k-word windows at starts; only of words hashed twice."""
        return span_hash(prefix_hash(self.other, _R), starts, starts + k, _R)


def window_starts(off: np.ndarray, k: int) -> np.ndarray:
    n = int(off[-1])
    good = np.ones(max(0, n), bool)
    # the last k - 1 positions of every text begin no window
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, np.maximum(off[1:] - (k - 1), off[:-1]), 1)
    np.add.at(mark, off[1:], -1)
    good &= np.cumsum(mark)[:n] == 0
    return np.flatnonzero(good)


def covered(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n positions lie in [s, s + k) for any s."""
    mark = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(starts + k, minlength=n + 1)[: n + 1]
    return np.cumsum(mark)[:n] > 0


def ceil_div(a: int, b: int) -> int:
    return math.ceil(a / b)
