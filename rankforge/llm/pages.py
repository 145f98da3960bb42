"""Page exchange: ask hash-partitioned tables about every n-gram of every text, in packed form.

Texts are dealt into *pages*, as compressed bundles. A page function reduces its texts to distinct keys, sorts them
and sends one packed array per key *bucket*, a range of the 64-bit keys (asks); a bucket function sees all keys of its
range, from every page, and sends back one packed array per page (replies), in the order asked. The page function
makes the same order again from the same texts, so that replies carry no positions.

* Pages and buckets grow with the square root of the input, from ``LEAST`` to ``MOST`` bytes, so that a packed array
  is about as long at 1 GB as at 10 TB and there are as many of them as the input has pages of ``BLOB`` bytes; beyond
  that they shorten slowly (at 100 TB some 70 keys). No key is a row.
* A key held by a third of all documents costs one entry for each page, since pages ask distinct keys only.
* Sorted keys go as differences with the planes of their bytes apart, and compressed: all 64 bits in less than 6 bytes.
* Pages and buckets are fixed by content (id, key), never by where a row happened to lie, so a lost executor's part
  can be made again with the same result. All steps of one query read the same exchange of texts, which Spark reuses.
* The number of pages comes from the planner's figure for the files; nothing is read for it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_workers, source_bytes

#: Bytes of input of a page or bucket, and that a page and a bucket share.
LEAST, MOST, BLOB = 1 << 19, 1 << 27, 1 << 12
#: Ranges of ids whose bounds are quantiles; finer pages cut these evenly.
RANGES = 2048
BLOBS = "page int, bucket int, blob binary"
_BLOB_SCHEMA = pa.schema([("page", pa.int32()), ("bucket", pa.int32()), ("blob", pa.binary())])
_PAGE_SCHEMA = pa.schema([("page", pa.int32()), ("texts", pa.binary())])


class Plan:
    """How many pages and buckets a table gets."""

    def __init__(self, docs: DataFrame, text_col: str = "text", blob: int = BLOB):
        """blob: larger ones make for larger pages, which have fewer distinct keys to a byte of text."""
        spark = docs.sparkSession
        small_workers(spark)
        size = source_bytes(docs, text_col)
        unit = min(MOST, max(LEAST, int((size * blob) ** 0.5)))
        self.pages = self.buckets = max(2 * spark.sparkContext.defaultParallelism, -(-size // unit))


# --------------------------------------------------------------------------- packing
def squeeze(raw: bytes, level: int = 1) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=level).compress(raw, asbytes=True)


def unsqueeze(blob: bytes) -> bytes:
    n = int.from_bytes(blob[:8], "little")
    return pa.Codec("zstd").decompress(memoryview(blob)[8:], n, asbytes=True) if n else b""


def planes(a: np.ndarray) -> bytes:
    """Bytes of numbers, all first bytes before all second ones."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes()


def unplanes(raw: bytes, dtype) -> np.ndarray:
    dtype = np.dtype(dtype)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(dtype.itemsize, -1).T).view(dtype).ravel()


def steps(keys: np.ndarray) -> bytes:
    """Sorted keys as differences: the high planes are zeros, mostly."""
    return planes(np.diff(keys, prepend=keys.dtype.type(0)))


def unsteps(raw: bytes, dtype="<u8") -> np.ndarray:
    return np.cumsum(unplanes(raw, dtype), dtype=dtype)


# --------------------------------------------------------------------------- pages
def _bundle(ids: np.ndarray, known: np.ndarray, length: np.ndarray, data: bytes) -> bytes:
    return len(ids).to_bytes(8, "little") + squeeze(ids.tobytes() + known.tobytes() + length.tobytes() + data, 3)


def _packed(deal) -> Callable:
    from .common import strings

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("doc_id")
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            own = ids.fill_null(0).to_numpy(zero_copy_only=False)
            page = deal(own, known, batch.column("spread").to_numpy(zero_copy_only=False))
            order = np.argsort(page, kind="stable")
            data, off = strings(batch.column("text").take(pa.array(order)))
            own, known, page, length = own[order], known[order].view(np.uint8), page[order], np.diff(off)
            numbers, first = np.unique(page, return_index=True)
            out = [_bundle(own[a:b], known[a:b], length[a:b], data[off[a] : off[b]].tobytes()) for a, b in zip(first, [*first[1:], len(page)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(out, pa.binary())], schema=_PAGE_SCHEMA)

    return f


def paged(docs: DataFrame, plan: Plan, id_col: str = "doc_id", text_col: str = "text", cuts: Cuts | None = None) -> DataFrame:
    """page, texts: bundles. Rows of one id share a page, rows without id are dealt by their text; cuts: by ranges of ids instead of by a hash."""
    key = F.col(text_col) if cuts else F.struct(F.col(id_col), F.when(F.col(id_col).isNull(), F.col(text_col)))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.pmod(F.xxhash64(key), F.lit(plan.pages)).alias("spread"))
    return rows.mapInArrow(_packed(cuts or _by_hash), "page int, texts binary")


def _by_hash(ids: np.ndarray, known: np.ndarray, spread: np.ndarray) -> np.ndarray:
    return spread


class Cuts:
    """Pages that rise with the id: quantiles of the ids bound at most ``RANGES`` ranges, each cut evenly. Rows without id come first, dealt by a hash of their text."""

    def __init__(self, docs: DataFrame, plan: Plan, id_col: str = "doc_id", ranges: int = RANGES):
        n = min(plan.pages, ranges)
        own = docs.select(F.col(id_col).cast("long").alias("i")).filter("i is not null")
        found = own.approxQuantile("i", [k / n for k in range(n + 1)], 1 / (8 * n))
        self.low = np.unique(np.array(found[:-1], np.float64).astype(np.int64))  # of each range; doubles: where ids pass 2**53 only balance suffers
        self.parts = -(-plan.pages // n)
        self.width = np.maximum(1.0, np.diff(np.append(self.low, int(found[-1]) + 1 if found else 0).astype(np.float64)) / self.parts)
        self.nulls = plan.pages
        self.pages = self.nulls + max(1, len(self.low)) * self.parts

    def __call__(self, ids: np.ndarray, known: np.ndarray, spread: np.ndarray) -> np.ndarray:
        if not len(self.low):
            return np.where(known, self.nulls, spread)
        at = np.maximum(np.searchsorted(self.low, ids, "right") - 1, 0)
        part = np.clip((ids - self.low[at]) / self.width[at], 0, self.parts - 1).astype(np.int64)
        return np.where(known, self.nulls + at * self.parts + part, spread)

    def batches(self, n: int) -> list[tuple[int | None, int | None]]:
        """Bounds (low, high] of ids, n about equal runs of whole pages; None: open. The first holds the rows without id."""
        if not len(self.low):
            return [(None, None)]
        edges = np.unique(self.low[(np.arange(1, n) * len(self.low)) // n]).tolist()
        edges = [e - 1 for e in edges if e > self.low[0]]
        return list(zip([None, *edges], [*edges, None], strict=True))


def load(table: pa.Table) -> tuple[pa.Array, pa.Array]:
    """Ids and texts (null: empty) of a page in a fixed order: by id (null first), then by text."""
    ids, known, length, data = [], [], [], []
    for blob in table.column("texts").to_pylist():
        n, raw = int.from_bytes(blob[:8], "little"), unsqueeze(blob[8:])
        ids.append(np.frombuffer(raw, np.int64, n))
        known.append(np.frombuffer(raw, np.uint8, n, 8 * n))
        length.append(np.frombuffer(raw, np.int64, n, 9 * n))
        data.append(raw[17 * n :])
    if not ids:
        return pa.array([], pa.int64()), pa.array([], pa.large_binary())
    own, is_known = np.concatenate(ids), np.concatenate(known).astype(bool)
    off = np.concatenate([[0], np.cumsum(np.concatenate(length))])
    text = pa.Array.from_buffers(pa.large_binary(), len(own), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(b"".join(data))])
    order = np.lexsort((own, is_known))
    same = (own[order[1:]] == own[order[:-1]]) & (is_known[order[1:]] == is_known[order[:-1]])
    if same.any():
        order = pc.sort_indices(pa.table({"k": is_known.astype(np.int8), "i": own, "t": text}), sort_keys=[("k", "ascending"), ("i", "ascending"), ("t", "ascending")]).to_numpy()
    return pa.array(own[order], mask=~is_known[order]), text.take(pa.array(order))


# --------------------------------------------------------------------------- asks and replies
def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of keys: as many of equal width. Sorted keys give sorted buckets."""
    return (((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int32)


def slices(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, first, end) of each bucket that occurs in sorted ones."""
    own, first = np.unique(bucket, return_index=True)
    return list(zip(own.tolist(), first.tolist(), [*first[1:].tolist(), len(bucket)][: len(own)], strict=True))


def nothing() -> pa.Table:
    return _BLOB_SCHEMA.empty_table()


def pack(rows: list[tuple[int | None, int, bytes]]) -> pa.Table:
    page, bucket, blob = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table([pa.array(page, pa.int32()), pa.array(bucket, pa.int32()), pa.array(blob, pa.binary())], schema=_BLOB_SCHEMA)


def asked(table: pa.Table) -> Iterator[tuple[int, bytes]]:
    """Page and array of each ask of a bucket, in the order of pages."""
    rows = zip(table.column("page").to_pylist(), table.column("blob").to_pylist(), strict=True)
    return ((p, unsqueeze(b)) for p, b in sorted(rows, key=lambda x: x[0]))


def in_order(bucket: np.ndarray, replies: pa.Table, dtype, bits: bool = False) -> np.ndarray:
    """Replies laid out as the keys (of sorted buckets) were asked. Without replies: zeros."""
    out = np.zeros(len(bucket), bool if bits else dtype)
    where = {b: (a, e) for b, a, e in slices(bucket)}
    for b, blob in zip(replies.column("bucket").to_pylist(), replies.column("blob").to_pylist(), strict=True):
        a, e = where[b]
        raw = np.frombuffer(unsqueeze(blob), np.uint8 if bits else dtype)
        out[a:e] = np.unpackbits(raw, count=e - a).astype(bool) if bits else raw
    return out


def ask(pages: DataFrame, f: Callable[[pa.Table], pa.Table]) -> DataFrame:
    return pages.groupBy("page").applyInArrow(f, BLOBS)


def answer(asks: DataFrame, f: Callable[[pa.Table], pa.Table]) -> DataFrame:
    return asks.groupBy("bucket").applyInArrow(f, BLOBS)


def with_replies(pages: DataFrame, replies: DataFrame, f: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    return pages.groupBy("page").cogroup(replies.groupBy("page")).applyInArrow(f, schema)
