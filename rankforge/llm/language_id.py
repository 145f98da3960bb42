"""Language identification (op 1): sparse multinomial logistic regression on TF-IDF of character n-grams.

Texts are lower-cased; n-grams of 1 to 3 code points are hashed to ``DIMS`` features, whose value is the n-gram's
share of the text times its inverse document frequency. Document frequencies are counted over all documents that may be
learned from. The regression is trained by follow-the-regularised-leader with elastic-net penalties, which leaves unused
weights at exactly zero, on a sample of labelled documents: of each language as many as its share of ``TRAIN_ROWS``
allows, but ``LEAST_ROWS`` at least (in the order of a hash of id and text), so that a rare language is learned however
large the others are. A fifth of the sample calibrates the softmax temperature.

Prediction reads whole texts and nothing else: the score of a language is linear in the n-grams, so a text's
scores are sums of a small table (``DIMS`` x languages, 256 KB for each language, a broadcast variable) over its
n-grams. All languages are learned; training takes about 1 MB of the driver for each.

Cases. ``und`` with score 0.0 for null texts and texts without a letter, and if nothing could be learned; a
language is any non-null label. Rows of equal id are predicted apart; of rows alike any may be in the sample. An empty
table gives an empty result; other columns are not read. Very long texts are worked on in parts of ``STEP`` characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, small_workers

DIMS, TRAIN_ROWS, LEAST_ROWS = 1 << 16, 4000, 20
ORDERS = (1, 2, 3)
#: Characters of text worked on at once.
STEP = 1 << 18
UNKNOWN = "und"
RESULT = "doc_id long, held_out boolean, lang_pred string, score double"
_LETTER = regex.compile(r"\p{L}")
_MUL = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)]


def _pieces(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, last + 1, code points with two zeros after each text, texts' starts and ends); a long text comes in parts."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= STEP):
            size += len(texts[end])
            end += 1
        parts = [t.lower() for t in texts[at:end]]
        if end - at == 1 and len(parts[0]) > 2 * STEP:
            whole = parts[0]
            for k in range(0, len(whole), STEP):  # parts overlap, so that each n-gram is met once
                own = whole[k : k + STEP + (2 if k + STEP < len(whole) else 0)]
                code = np.frombuffer((own + ("\0\0" if k + STEP >= len(whole) else "")).encode("utf-32-le", "replace"), np.uint32)
                yield at, end, code, np.array([0]), np.array([len(code) - 2])
        else:
            code = np.frombuffer("\0\0".join([*parts, ""]).encode("utf-32-le", "replace"), np.uint32)
            length = np.array([len(p) for p in parts])
            start = np.cumsum(length + 2) - length - 2
            yield at, end, code, start, start + length
        at = end


def _features(code: np.ndarray) -> Iterator[np.ndarray]:
    """For each order, the feature of the n-gram that starts at each code point but the last two."""
    n = len(code) - 2
    h = np.zeros(max(n, 0), np.uint32)
    for k in ORDERS:
        h = (h + code[k - 1 : k - 1 + n]) * _MUL[k - 1]
        h ^= h >> np.uint32(15)
        yield ((h * np.uint32(0x2C1B3C6D)) >> np.uint32(16)) % np.uint32(DIMS)


def counts(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Features and their counts of each text."""
    out: list = [None] * len(texts)
    for a, b, code, start, stop in _pieces(texts):
        found = list(_features(code))
        for i, x, y in zip(range(a, b), start, stop, strict=True):
            got = np.bincount(np.concatenate([f[x:y] for f in found]), minlength=1)
            got = got if out[i] is None else _add(out[i], got)
            ids = np.flatnonzero(got)
            out[i] = (ids.astype(np.int32), got[ids].astype(np.int32))
    return out


def _add(had: tuple[np.ndarray, np.ndarray], more: np.ndarray) -> np.ndarray:
    full = np.bincount(had[0], weights=had[1], minlength=len(more)).astype(np.int64)
    full[: len(more)] += more
    return full


def frequencies(texts: list[str]) -> np.ndarray:
    """Of each feature, how many of the texts hold it."""
    out, own, at = np.zeros(DIMS, np.int64), np.zeros(DIMS, bool), -1
    for a, b, code, start, stop in _pieces(texts):
        found = list(_features(code))
        for i, x, y in zip(range(a, b), start, stop, strict=True):
            if i != at:  # a long text comes in parts
                out += own
                own[:] = False
                at = i
            for f in found:
                own[f[x:y]] = True
    return out + own


class Model:
    """Table of weight times inverse document frequency, intercepts, temperature."""

    def __init__(self, languages: list[str], table: np.ndarray, bias: np.ndarray, temperature: float):
        self.languages, self.table, self.bias, self.temperature = languages, table, bias, temperature

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        k = len(self.languages)
        total, size = np.zeros((len(texts), max(k, 1))), np.zeros(len(texts))
        if k:
            for a, b, code, start, stop in _pieces(texts):
                edges = np.column_stack([start, stop]).ravel()  # every other sum is of what stands between texts
                for f in _features(code):
                    rows = np.concatenate([self.table[f], np.zeros((1, k), np.float32)])
                    total[a:b] += np.add.reduceat(rows, edges, axis=0)[::2] * (stop > start)[:, None]
                size[a:b] += stop - start
        letters = np.array([bool(_LETTER.search(t)) for t in texts], bool)
        if not k:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        logit = (total / np.maximum(size, 1)[:, None] + self.bias) / self.temperature
        p = np.exp(logit - logit.max(axis=1, keepdims=True)) if len(texts) else logit
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1) if len(texts) else np.empty(0, int)
        return [self.languages[i] if ok else UNKNOWN for i, ok in zip(best, letters, strict=True)], np.where(letters, p.max(axis=1, initial=0.0), 0.0)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, k: int, dims: int, epochs: int = 2, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, seed: int = 7) -> np.ndarray:
    """Weights (dims x k) by per-coordinate follow-the-regularised-leader; rows are (features, values)."""
    z, n = np.zeros((dims, k)), np.zeros((dims, k))
    rng = np.random.default_rng(seed)

    def weights(zi, ni):
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            i, x = rows[r]
            zi, ni = z[i], n[i]
            w = weights(zi, ni)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[label[r]] -= 1.0
            g = x[:, None] * p
            g2 = g * g
            z[i] = zi + g - (np.sqrt(ni + g2) - np.sqrt(ni)) / alpha * w
            n[i] = ni + g2
    return weights(z, n)


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[str], df: np.ndarray | None = None, documents: int = 0, scale: float = 40.0) -> Model:
    """rows: (features, counts) of each text. df: how many of so many documents hold each feature; None: of the rows. A fifth of the texts calibrates the temperature."""
    if not labels:
        return Model([], np.zeros((DIMS, 1), np.float32), np.zeros(1), 1.0)
    names, label = np.unique(np.array(labels, dtype=object), return_inverse=True)
    if df is None:
        df, documents = np.bincount(np.concatenate([i for i, _ in rows]), minlength=DIMS), len(rows)
    idf = np.log((1 + documents) / (1 + df)) + 0.1
    values = [(np.append(i, DIMS), np.append(c / max(1, c.sum()) * idf[i] * scale, 1.0)) for i, c in rows]
    test = np.arange(len(rows)) % 5 == 4 if len(rows) >= 50 else np.zeros(len(rows), bool)
    fit = np.flatnonzero(~test)
    w = ftrl([values[i] for i in fit], label[fit], len(names), DIMS + 1)
    own = np.flatnonzero(test) if test.any() else fit
    logit = np.array([x @ w[i] for i, x in (values[j] for j in own)])
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    loss = [np.mean(np.logaddexp.reduce(logit / t, axis=1) - logit[np.arange(len(own)), label[own]] / t) for t in grid]
    # at most a fifth's worth of evidence: a temperature is not driven to the edge by texts all told apart
    temperature = float(grid[int(np.argmin(loss))])
    # a text has len(ORDERS) n-grams at each place; size in predict counts places
    table = (w[:DIMS] * idf[:, None] * scale / len(ORDERS)).astype(np.float32)
    return Model([str(x) for x in names], table, w[DIMS], max(temperature, 0.2))


def learn(docs: DataFrame, id_col: str, text_col: str, lang_col: str, learned, limit: int = TRAIN_ROWS, least: int = LEAST_ROWS) -> Model:
    """learned: condition on the rows that may be learned from."""
    spark = docs.sparkSession
    small_workers(spark)
    own = docs.filter(learned & F.col(lang_col).isNotNull()).select(F.xxhash64(id_col, text_col).alias("h"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    sizes = own.groupBy("lang").count().collect()  # a row for each language
    if not sizes:
        return train([], [])
    quota = max(least, limit // len(sizes))
    # some four times the quota by a hash, exactly the quota by a window over those few
    share = spark.createDataFrame([(r["lang"], min(1.0, (4 * quota + 50) / r["count"])) for r in sizes], "lang string, share double")
    near = own.join(F.broadcast(share), "lang").filter(F.pmod("h", F.lit(1 << 30)) < F.col("share") * float(1 << 30))
    first = Window.partitionBy("lang").orderBy("h", "text")
    sample = near.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= quota)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = counts([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("lang"), pa.array([i.tobytes() for i, _ in got], pa.binary()), pa.array([c.tobytes() for _, c in got], pa.binary())], names=["h", "lang", "i", "c"])

    rows = sorted((r["h"], r["lang"], bytes(r["i"]), bytes(r["c"])) for r in sample.select("h", "lang", "text").mapInArrow(f, "h long, lang string, i binary, c binary").collect())  # quota rows of each language
    rows = [r for r in rows if len(r[2])]

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            total += frequencies([t or "" for t in batch.column("text").to_pylist()])
            n += batch.num_rows
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(own, -1), pa.int64()), pa.array(np.append(total[own], n), pa.int64())], names=["f", "n"])

    found = own.select("text").mapInArrow(held, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).collect()  # at most DIMS + 1
    df = np.zeros(DIMS, np.int64)
    for r in found:
        if r["f"] >= 0:
            df[r["f"]] = r["n"]
    documents_ = sum(r["n"] for r in found if r["f"] < 0)
    order = np.random.default_rng(3).permutation(len(rows))
    return train([(np.frombuffer(rows[k][2], np.int32), np.frombuffer(rows[k][3], np.int32)) for k in order], [rows[k][1] for k in order], df, documents_)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", held_out=None) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    small_workers(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.lit(False) if held_out is None else held_out).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.table, model.bias, model.temperature))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for batch in batches:
            lang, score = model.predict([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return own.mapInArrow(f, RESULT)


def split(id_col: str, parts: int, held: int):
    """Whether crc32 of the id's decimal text leaves ``held``; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == held, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = split("doc_id", 4, 2)
    return identify(docs, learn(docs, "doc_id", "text", "lang", ~held), held_out=held)
