"""Byte-level BPE encoding and decoding (op 4).

A text is cut by the tokenizer's pattern; each match is encoded by itself. Matches not met before are sorted into
length buckets and laid out as padded numpy matrices, a row for each match, a byte's token in each cell. In each
round every unfinished row merges its leftmost pair of least rank: ranks of pairs come from an open-addressing
hash table over all pairs of tokens whose bytes together are a token; the row is shifted over the freed cell, and
finished rows leave the matrix. Matches beyond ``LONG`` bytes, whose rounds would cost a matrix row their square,
are merged by a heap with the same rule.

Cases. Null is the empty text: no tokens, digests of nothing. Special tokens are ordinary text. Rows of equal id
are encoded apart; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, small_workers

VOCABULARY = "byte_bpe_50k.tiktoken"
LONG, CACHE = 512, 600_000
#: Cells of each row in the matrices, by bucket; cells of a matrix.
WIDTHS, CELLS = (2, 4, 6, 8, 10, 12, 16, 20, 24, 32, 64, 128, 256, LONG), 1 << 18
#: Characters of text encoded together.
STEP = 1 << 20
NO_RANK = np.int32(2**31 - 1)
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>, decoded string"


class PairTable:
    """Rank of two tokens' merge by open addressing; rank and new token are the same number."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        size = 1 << max(4, int(4 * len(rank)).bit_length())
        self.mask = np.uint64(size - 1)
        self.key, self.rank = np.full(size, -1, np.int64), np.full(size, NO_RANK, np.int32)
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slot, todo, self.reach = self._slot(key), np.arange(len(key)), 0
        while len(todo):
            self.reach += 1
            free = self.key[slot[todo]] == -1
            at, first = np.unique(slot[todo[free]], return_index=True)
            put = todo[free][first]
            self.key[at], self.rank[at] = key[put], rank[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & int(self.mask)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        x = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((x ^ (x >> np.uint64(29))) & self.mask).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks, NO_RANK where the two don't merge or either is padding (-1)."""
        key = ((left.astype(np.int64) << 32) | right.astype(np.int64)).ravel()
        slot = self._slot(key)
        have = self.key[slot]
        out = np.where(have == key, self.rank[slot], NO_RANK)
        on = np.flatnonzero((have != key) & (have != -1))
        slot = slot[on]
        while len(on):
            slot = (slot + 1) & int(self.mask)
            have = self.key[slot]
            hit = have == key[on]
            out[on[hit]] = self.rank[slot[hit]]
            more = ~hit & (have != -1)
            on, slot = on[more], slot[more]
        return out.reshape(left.shape)


class Encoder:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.find = regex.compile(pattern).findall
        self.token = dict(zip(ranks.values(), ranks.keys(), strict=True))
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.pairs = PairTable(*(np.array(x, np.int32) for x in zip(*pairs, strict=True)))
        self.rank = {(a, b): r for a, b, r in pairs}
        self.ids: dict[str, str] = {}  # of a match: its tokens, as text
        self.bytes: dict[str, bytes] = {}  # of a match: what its tokens decode to

    def merge(self, parts: list[bytes]) -> list[list[int]]:
        """Tokens of each part."""
        out: list = [None] * len(parts)
        length = np.array([len(p) for p in parts])
        for i in np.flatnonzero(length > LONG):
            out[i] = self._heap(parts[i])
        low = 0
        for high in WIDTHS:
            own = np.flatnonzero((length > low) & (length <= high))
            step = max(1, CELLS // high)
            for at in range(0, len(own), step):
                some = own[at : at + step].tolist()
                for i, row in zip(some, self._matrix([parts[i] for i in some], high), strict=True):
                    out[i] = row
            low = high
        return [x if x is not None else [] for x in out]

    def _matrix(self, parts: list[bytes], width: int) -> list[list[int]]:
        n = np.array([len(p) for p in parts])
        cells = np.full((len(parts), width), -1, np.int32)
        cells[np.arange(width) < n[:, None]] = self.byte[np.frombuffer(b"".join(parts), np.uint8)]
        rank, rows, done = self.pairs(cells[:, :-1], cells[:, 1:]), np.arange(len(parts)), np.full_like(cells, -1)
        while len(rows):
            j = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(rows), np.int64)  # the leftmost of the least
            at = np.arange(len(rows))
            least = rank[at, j] if rank.shape[1] else np.full(len(rows), NO_RANK)
            on = least != NO_RANK
            if not on.all():
                done[rows[~on], : cells.shape[1]] = cells[~on]
                rows, cells, rank, j, least = rows[on], cells[on], rank[on], j[on], least[on]
                at = at[: len(rows)]
            # the cell after the pair's first goes; every row gets a cell shorter, and so does the matrix
            beyond = np.arange(cells.shape[1] - 1) > j[:, None]
            cells = np.where(beyond, cells[:, 1:], cells[:, :-1])
            rank = np.where(beyond[:, :-1], rank[:, 1:], rank[:, :-1])
            cells[at, j] = least
            left, right = np.flatnonzero(j > 0), np.flatnonzero(j < rank.shape[1])
            jl, jr = j[left], j[right]
            new = self.pairs(np.concatenate([cells[left, jl - 1], cells[right, jr]]), np.concatenate([cells[left, jl], cells[right, jr + 1]]))
            rank[left, jl - 1], rank[right, jr] = new[: len(left)], new[len(left) :]
        return [r[:k].tolist() for r, k in zip(done, (done >= 0).sum(axis=1), strict=True)]

    def _heap(self, part: bytes) -> list[int]:
        token = self.byte[np.frombuffer(part, np.uint8)].tolist()
        n = len(token)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(token, token[1:], strict=False)) if (r := self.rank.get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if token[i] != a or j >= n or token[j] != b:
                continue
            token[i], token[j] = r, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (q := self.rank.get((token[x], token[y]))) is not None:
                    heapq.heappush(heap, (q, x, token[x], token[y]))
        return [t for t in token if t >= 0]

    def learn(self, matches: set[str]) -> None:
        new = [m for m in matches if m not in self.ids]
        if len(self.ids) + len(new) > CACHE:
            self.ids.clear()
            self.bytes.clear()
            new = list(matches)
        for m, ids in zip(new, self.merge([m.encode("utf-8", "replace") for m in new]), strict=True):
            self.ids[m] = " ".join(map(str, ids))
            self.bytes[m] = b"".join([self.token[i] for i in ids])

    def texts(self, texts: list[str]) -> Iterator[tuple[str, bytes]]:
        """Of each text: its tokens as decimal numbers joined by one space, and the bytes they decode to."""
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= STEP):
                size += len(texts[end])
                end += 1
            found = [self.find(t) for t in texts[at:end]]
            self.learn(set().union(*found))
            for x in found:
                yield " ".join(map(self.ids.__getitem__, x)), b"".join(map(self.bytes.__getitem__, x))
            at = end


@lru_cache(2)
def encoder(path: str, pattern: str) -> Encoder:
    """One for each Python worker."""
    return Encoder(path, pattern)


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str = public_tokenizers.PATTERN, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids, decoded (the last two null unless asked for)."""
    small_workers(docs.sparkSession)
    path = path or public_tokenizers.path(VOCABULARY)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            rows = []
            for ids, raw in own.texts(texts):
                rows.append((ids.count(" ") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(raw).hexdigest(), np.fromstring(ids, np.int32, sep=" ") if with_ids else None, raw.decode("utf-8", "replace") if with_ids else None))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()), strict=True))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(f, RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(documents(spark, sf_dir), with_ids=False).drop("ids", "decoded")
