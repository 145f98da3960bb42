"""Substring dedup with a log-structured fingerprint index (op 9).

The index is a list of immutable runs: per key bucket, the sorted distinct fingerprints of all ``window``-word
windows of the texts taken in so far. A new batch is one exchange: pages ask for their distinct windows, and
each bucket merges the sorted asks with the sorted runs. A window repeats an earlier one if a run holds it, or
if an earlier page of the batch does: pages are ranges of ids, so that their numbers say which text is first. The
batch's own fingerprints become the next run; once there are more than ``fanout`` runs they are compacted into one.

Runs are partitions of one table of files that is bucketed as the asks are shuffled, so that history is merged where it
lies: a batch shuffles its own windows only, and a compaction nothing. ``manifest`` in the index's folder names the runs
that count; ``FingerprintIndex.open`` continues an index in another process, and a batch that failed leaves nothing behind.

A hit is verified by a second hash, of 32 bits: it comes from the words' bytes by other numbers and another rule than the
64-bit key, goes with it in asks and runs, and windows are equal only if both agree. Words themselves are not compared;
of n different windows n * n / 2**97 pairs are expected to agree, 2e-10 of 5e9 (30 GB), 6e-4 of 1e13 (100 TB).

Cases. Null and empty texts, and texts shorter than a window, lose nothing. Rows of equal id count in the order
of their texts. Rows without id come first, in the order of a hash of their texts. Batches must come in the order of
ids: ``dedup`` cuts them so. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pages as P
from .common import SPACE, Words, covered, delete, documents, exists, keep_aside, partitions, shared_dir, shuffles_dropped, strings

WINDOW, BATCHES, FANOUT = 20, 4, 2
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def _grouped(key: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stable order by key and other, and where in it a new pair of them begins."""
    order = np.argsort(key, kind="stable")
    new_key = key[order[1:]] != key[order[:-1]]
    new = new_key | (other[order[1:]] != other[order[:-1]])
    if not (new == new_key).all():  # keys clash, which is rare
        order = np.lexsort((other, key))
        new = (key[order[1:]] != key[order[:-1]]) | (other[order[1:]] != other[order[:-1]])
    return order, np.concatenate([np.ones(min(1, len(key)), bool), new])


def _windows(text: pa.Array, window: int):
    """Words, window starts; first start, key and second hash of each distinct window, in the order of keys; each window's number."""
    words = Words(text, twice=True)
    starts, key = words.windows(window)
    other = (words.second_windows(starts, window) >> np.uint64(32)).astype(np.uint32)
    order, head = _grouped(key, other)
    first, which = order[head], np.empty(len(key), np.int64)
    which[order] = np.cumsum(head) - 1
    return words, starts, first, key[first], other[first], which


def pack_pairs(keys: np.ndarray, others: np.ndarray) -> bytes:
    """Sorted keys with their second hashes; a key may stand in it with several."""
    return P.squeeze(P.steps(keys) + P.planes(others.astype("<u4")))


def unpack_pairs(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    return _pairs(P.unsqueeze(blob))


def _pairs(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(raw) // 12
    return P.unsteps(raw[: 8 * n]), P.unplanes(raw[8 * n :], "<u4")


def _ask(window: int, buckets: int):
    def f(table: pa.Table) -> pa.Table:
        _, _, _, key, other, _ = _windows(P.load(table)[1], window)
        page = table.column("page")[0].as_py()
        return P.pack([(page, b, pack_pairs(key[x:y], other[x:y])) for b, x, y in P.slices(P.bucket_of(key, buckets))])

    return f


def _held(run: tuple[np.ndarray, np.ndarray], key: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which pairs the run holds."""
    keys, others = run
    at, hit, live = np.searchsorted(keys, key), np.zeros(len(key), bool), np.arange(len(key))
    while len(live):  # on to the next entry of the same key
        live = live[at[live] < len(keys)]
        live = live[keys[at[live]] == key[live]]
        hit[live] |= others[at[live]] == other[live]
        at[live] += 1
    return hit


def _resolve(asks: pa.Table, runs: pa.Table | None) -> pa.Table:
    """Replies of one bucket, then its new run (no page)."""
    if not asks.num_rows:
        return P.nothing()
    bucket, got = asks.column("bucket")[0].as_py(), [(p, *_pairs(raw)) for p, raw in P.asked(asks)]
    key, other = (np.concatenate([x[i] for x in got]) for i in (1, 2))
    order, head = _grouped(key, other)  # of equal windows, that of the first page comes first
    repeated = ~head
    key, other, group = key[order][head], other[order][head], np.cumsum(head) - 1
    for blob in runs.column("blob").to_pylist() if runs is not None else ():
        repeated |= _held(unpack_pairs(blob), key, other)[group]
    flags = np.empty(len(order), bool)
    flags[order] = repeated
    out, a = [], 0
    for p, own, _ in got:
        out.append((p, bucket, P.squeeze(np.packbits(flags[a : a + len(own)]).tobytes())))
        a += len(own)
    return P.pack([*out, (None, bucket, pack_pairs(key, other))])


def _compact(table: pa.Table) -> pa.Table:
    key, other = (np.concatenate(x) for x in zip(*(unpack_pairs(b) for b in table.column("blob").to_pylist()), strict=True))
    order, head = _grouped(key, other)
    at = order[head]
    return P.pack([(None, table.column("bucket")[0].as_py(), pack_pairs(key[at], other[at]))])


class FingerprintIndex:
    """Sorted immutable runs of the windows taken in so far, in ``folder``.

    ``folder/runs`` is a bucketed table with a partition for each run, and one (-number of the run) for the replies of
    its batch. ``folder/manifest`` has a version of the list of live runs for each change; the last one counts.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int, window: int = WINDOW, fanout: int = FANOUT, parts: int | None = None, runs: tuple[int, ...] = (), last: int = 0, version: int = 0):
        self.spark, self.folder, self.buckets, self.window, self.fanout = spark, folder, buckets, window, fanout
        self.parts, self.runs, self.last, self.version = parts or partitions(spark), list(runs), last, version
        self.table = f"fingerprints_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {self.table} (page INT, bucket INT, blob BINARY, run INT) USING parquet PARTITIONED BY (run) CLUSTERED BY (bucket) INTO {self.parts} BUCKETS LOCATION '{folder}/runs'")
        for run in self.runs:
            spark.sql(f"ALTER TABLE {self.table} ADD IF NOT EXISTS PARTITION (run = {run})")

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> FingerprintIndex:
        """The index as its last change left it."""
        last = spark.read.schema("version long, state string").json(f"{folder}/manifest").orderBy(F.desc("version")).first()
        state = json.loads(last["state"])
        return cls(spark, folder, state["buckets"], state["window"], state["fanout"], state["parts"], tuple(state["runs"]), state["last"], last["version"])

    def _note(self) -> None:
        self.version += 1
        state = {"buckets": self.buckets, "window": self.window, "fanout": self.fanout, "parts": self.parts, "runs": self.runs, "last": self.last}
        self.spark.createDataFrame([(self.version, json.dumps(state))], "version long, state string").coalesce(1).write.mode("append").json(f"{self.folder}/manifest")

    def _append(self, rows: DataFrame, run: int) -> None:
        for part in (run, -run):  # what a failed attempt may have left
            delete(self.spark, f"{self.folder}/runs/run={part}")
        with shuffles_dropped(self.spark):
            rows.withColumn("run", F.when(F.col("page").isNull(), run).otherwise(-run)).write.mode("append").partitionBy("run").bucketBy(self.parts, "bucket").option("path", f"{self.folder}/runs").format("parquet").saveAsTable(self.table)

    def _live(self) -> DataFrame:
        return self.spark.table(self.table).filter(F.col("run").isin(self.runs))

    def add(self, pages: DataFrame) -> DataFrame:
        """Takes a batch in; returns its replies (which windows repeat an earlier one)."""
        asks, run = P.ask(pages, _ask(self.window, self.buckets)), self.last + 1
        if self.runs:
            found = asks.groupBy("bucket").cogroup(self._live().groupBy("bucket")).applyInArrow(_resolve, P.BLOBS)
        else:
            found = P.answer(asks, lambda table: _resolve(table, None))
        self._append(found, run)
        self.runs, self.last = [*self.runs, run], run
        self._note()
        if len(self.runs) > self.fanout:
            self.compact()
        return self.spark.table(self.table).filter(F.col("run") == -run).select("page", "bucket", "blob")

    def compact(self) -> None:
        """One run in place of all: buckets are merged where they lie."""
        run, old = self.last + 1, self.runs
        self._append(P.answer(self._live(), _compact), run)
        self.runs, self.last = [run], run
        self._note()
        for k in old:
            self.spark.sql(f"ALTER TABLE {self.table} DROP IF EXISTS PARTITION (run = {k})")
            delete(self.spark, f"{self.folder}/runs/run={k}")


def _finish(window: int, buckets: int, with_text: bool):
    def f(table: pa.Table, replies: pa.Table) -> pa.Table:
        ids, text = P.load(table)
        words, starts, first, key, _, which = _windows(text, window)
        flag = np.ones(len(starts), bool)  # in a page, all but the first of equal windows
        flag[first] = P.in_order(P.bucket_of(key, buckets), replies, bool, bits=True)
        gone = covered(starts[flag], window, int(words.off[-1]))
        data, off = strings(text)
        data = data.tobytes()
        sums = np.concatenate([[0], np.cumsum(gone)])
        removed = sums[words.off[1:]] - sums[words.off[:-1]]
        sha, kept = [], []
        for d, n in enumerate(removed.tolist()):
            parts = data[off[d] : off[d + 1]].split()
            if n:
                parts = compress(parts, (~gone[words.off[d] : words.off[d + 1]]).tolist())
            joined = b" ".join(parts)
            sha.append(hashlib.sha256(joined).hexdigest())
            if with_text:
                kept.append(joined)
        return pa.table({"doc_id": ids, "n_words": words.n.astype(np.int64), "n_removed": removed.astype(np.int64), "kept_sha256": pa.array(sha, pa.string()), "kept_text": pa.array(kept if with_text else [None] * len(ids), pa.binary()).cast(pa.string())})

    return f


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, batches: int = BATCHES, fanout: int = FANOUT, with_text: bool = True, folder: str | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text (kept words joined by one space; null unless asked for).

    A word goes if a window of it also starts earlier: in a document of smaller id, or earlier in its own. folder: where
    the index is to stay, or, if one is there, goes on: its windows are then earlier than all of docs. Without, it goes with the session.
    """
    spark = docs.sparkSession
    plan = P.Plan(docs, text_col)
    cuts = P.Cuts(docs, plan, id_col)
    if folder is None:
        folder = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
        keep_aside(spark, folder)
    index = FingerprintIndex.open(spark, folder) if exists(spark, f"{folder}/manifest") else FingerprintIndex(spark, folder, plan.buckets, window, fanout)
    replies, key = None, F.col(id_col).cast("long")
    for low, high in cuts.batches(batches):
        rule = F.lit(True) if low is None else key > low
        if high is not None:
            rule = rule & ((key <= high) | (key.isNull() if low is None else F.lit(False)))
        found = index.add(P.paged(docs.filter(rule), plan, id_col, text_col, cuts))
        replies = found if replies is None else replies.unionByName(found)
    return P.with_replies(P.paged(docs, plan, id_col, text_col, cuts), replies, _finish(index.window, index.buckets, with_text), RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir), with_text=False).drop("kept_text")


#: The same by one self-grouping of all windows; a word that no document holds parts texts from windows.
SQL = rf"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE}+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, p, md5(array_to_string(w[p:p + {WINDOW - 1}], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS p FROM d WHERE len(w) >= {WINDOW})),
rep AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + {WINDOW})) AS i FROM rep),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT word.doc_id, count(*) FILTER (gone.i IS NOT NULL) AS n_removed, string_agg(x, ' ' ORDER BY word.i) FILTER (gone.i IS NULL) AS t FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.i = gone.i GROUP BY word.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
