"""Toxicity by non-negative positive-unlabelled learning (op 10).

A linear classifier over the words of a text (letters and digits, ASCII lower-cased) and the first ``HEADS`` bytes of
longer words, hashed, with the logarithm of their counts as values, is trained in numpy from confirmed toxic documents and
unlabelled text only. Its risk corrects for the class prior: unlabelled text counts as clean, less the prior's share of
the positives' risk as clean, and that difference is kept from falling below zero (a step that would take it there is
reversed). The prior is the share of toxic labels in the labels that may be learned from.

Unlabelled text is all text that may be learned from: it is dealt to blocks of about ``BLOCK`` documents, each block
trains with all the confirmed documents, and the model is the mean of the blocks'. In each block, however many there are,
scores of all four quarters of the documents by trainings on the others set the level of the threshold; these four and the
one on all documents run side by side, over lists of texts and features that are walked once for all. Confirmed documents
are a bounded sample, of at most ``POSITIVES`` in the order of a hash of their ids. Only features that ``LEAST`` of these
(and three documents; with fewer than 20 confirmed, one) hold have a weight; a word that stands in fewer of them speaks
neither way.

Cases. A text without words scores as the intercept alone; with no positives, or nothing unlabelled, every score is
0.0. A quarter is left out of the level only if nothing confirmed, or nothing unlabelled, is outside it. Null labels are
no labels; of several labels of a document any 1 counts. Rows of equal id are scored apart, and are positives together. An
empty table gives an empty result; other columns are not read. Very long texts are worked on whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, documents, small_workers
from .language_id import split

DIMS = 1 << 20
POSITIVES, BLOCK = 4000, 12000
HEADS = (5, 6, 7, 8, 9, 10)
THRESHOLD, FALLBACK_PRIOR = 0.7, 0.1
STEPS = 200
#: Trainings that set the level of the threshold, in every block, however many blocks there are.
FOLDS = 4
#: Columns worked on at once (32 bytes, which are looked up fastest), longest piece of a list, pieces at a time.
LANES, PIECE, PIECES = 8, 64, 2048
#: Shares of the unlabelled between which the threshold is sought, in priors; how fast scores rise around it.
AROUND, SLOPE = (1.15, 0.75), 2.0
#: Share of the positives that must hold a feature.
LEAST = 0.02
RESULT = "doc_id long, held_out boolean, score double, predicted int"
_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def features(column) -> tuple[np.ndarray, np.ndarray, int]:
    """Text number and feature of each word, and of each head of a word, of each text."""
    words = Words(column, lower=True, space=_BETWEEN, heads=HEADS)
    row, found = np.repeat(np.arange(len(words.n)), words.n), [words.hash, *words.heads]
    keep = [h != 0 for h in found]
    return np.concatenate([row[k] for k in keep]), np.concatenate([h[k] % np.uint64(DIMS) for h, k in zip(found, keep, strict=True)]).astype(np.int64), len(words.n)


def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows, few at a time: the words of a batch take many times its room."""
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            yield batch.slice(at, 500)


def counted(row: np.ndarray, feature: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's distinct features in order, and their values."""
    pair, count = np.unique(row * dims + feature, return_counts=True)
    return pair // dims, pair % dims, np.log1p(count) / np.log(2)


class Sums:
    """Sums of rows of a table over lists of row numbers, for ``LANES`` columns at once.

    Lists are cut into pieces of at most ``PIECE``; pieces are sorted by length, and of ``PIECES`` at a time the first
    numbers are looked up and added together, then the second ones, and so on: each step works on whole arrays."""

    def __init__(self, owner: np.ndarray, number: np.ndarray, n: int):
        """owner: list of each number, ascending; there are n lists."""
        start = np.searchsorted(owner, np.arange(n + 1, dtype=owner.dtype))
        length = np.diff(start)
        cuts = -(-length // PIECE)
        of = np.repeat(np.arange(n), cuts)
        place = (np.arange(len(of)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * PIECE
        size = np.minimum(length[of] - place, PIECE)
        self.n, self.listed, self.first = n, np.flatnonzero(cuts), (np.cumsum(cuts) - cuts)[cuts > 0]
        self.order = np.argsort(-size, kind="stable")
        begin, size, self.steps = (start[of] + place)[self.order], size[self.order], []
        self.number, done = np.empty(len(number), np.int32), 0
        for at in range(0, len(of), PIECES):
            own, most = begin[at : at + PIECES], size[at : at + PIECES]
            ends = np.searchsorted(-most, -np.arange(most[0]))  # pieces longer than j come first
            for j, m in enumerate(ends):
                self.number[done : done + m] = number[own[:m] + j]
                done += m
            self.steps.append(ends.tolist())

    def __call__(self, table: np.ndarray) -> np.ndarray:
        pieces, out = np.empty((len(self.order), LANES), np.float32), np.zeros((self.n, LANES), np.float32)
        room, wide, done = np.empty((PIECES, LANES), np.float32), np.empty(PIECES, np.intp), 0
        for i, ends in enumerate(self.steps):
            total = np.zeros((ends[0], LANES), np.float32)
            for m in ends:
                wide[:m] = self.number[done : done + m]
                total[:m] += table.take(wide[:m], axis=0, out=room[:m], mode="clip")
                done += m
            pieces[self.order[i * PIECES : (i + 1) * PIECES]] = total
        if len(self.listed):
            out[self.listed] = np.add.reduceat(pieces, self.first, axis=0)
        return out


def nnpu(r: np.ndarray, f: np.ndarray, x: np.ndarray, positive: np.ndarray, uses: np.ndarray, prior: float, k: int, steps: int = STEPS, rate: float = 0.05, decay: float = 1e-2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trainings side by side: weights of k features, intercept, and every text's score without it, each with a column for a training.

    r, f, x: text, feature and value (above zero) of each entry, texts ascending. positive: whether a text is confirmed; the rest are
    unlabelled. uses: texts by trainings, at most ``LANES``, whether it trains on the text; of both kinds each needs one."""
    n, lanes = uses.shape
    pos, unl = uses & positive[:, None], uses & ~positive[:, None]
    n_pos, n_unl = pos.sum(0), unl.sum(0)
    # a column for each feature and value: its entries need no product
    key = f.astype(np.int64) << 32
    key |= x.astype(np.float32, copy=False).view(np.uint32)
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.append(key[:1] >= 0, key[1:] != key[:-1])
    del key
    of, value, columns = f[order[new]], x[order[new]].astype(np.float32)[:, None], int(new.sum())
    owner = np.cumsum(new, dtype=np.int32) - np.int32(1)
    by_column = Sums(owner, r[order], columns)
    number = np.empty(len(f), np.int32)
    number[order] = owner
    del order, owner
    by_text = Sums(r, number, n)
    del number
    having, first = np.unique(of, return_index=True)

    w, b = np.zeros((k, lanes)), np.full(lanes, np.log(prior / (1 - prior)))
    m, v = np.zeros((k + 1, lanes)), np.zeros((k + 1, lanes))
    wide, gains, grad = np.zeros((columns, LANES), np.float32), np.zeros((n, LANES), np.float32), np.zeros((k + 1, lanes))

    def raw():
        wide[:, :lanes] = w[of] * value
        return by_text(wide)[:, :lanes]

    for t in range(1, steps + 1):
        s = raw() + b  # in double precision: the first steps start from slopes that cancel out
        e = np.exp(-np.abs(s))
        as_clean, toward_clean = np.maximum(s, 0) + np.log1p(e), np.where(s > 0, 1, e) / (1 + e)  # the logistic loss and its slope
        risk = (as_clean * unl).sum(0) / n_unl - prior * (as_clean * pos).sum(0) / n_pos
        # the slope toward toxic is that toward clean, less one; the corrected risk may not go negative: undo
        g = np.where(risk < 0, pos * toward_clean * (prior / n_pos) - unl * toward_clean / n_unl, unl * toward_clean / n_unl - pos * (prior / n_pos))
        gains[:, :lanes] = g
        if columns:
            grad[having] = np.add.reduceat(by_column(gains)[:, :lanes] * value, first, axis=0)
        grad[:k] += decay * prior * w
        grad[k] = g.sum(0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
        grad[:] = 0
    return w, b, raw()


def calibrate(u: np.ndarray, prior: float) -> float:
    """The raw score that stands at ``THRESHOLD``, from unlabelled texts not trained on: about the prior's share of them reaches it, and it lies where the fewest of their scores do."""
    u = np.sort(u)
    low, high = (int(len(u) * (1 - t * prior)) for t in AROUND)
    wide = max(2, (high - low) // 8)
    if high - low > wide:
        gap = u[low + wide : high] - u[low : high - wide]
        i = low + int(gap.argmax())
        if gap.max() > 1e-9:
            return float((u[i] + u[i + wide]) / 2)
    # all alike around there, or too few: between the usual score and the next one above
    usual = float(np.quantile(u, 1 - prior))
    above = u[u > usual + 1e-9]
    return (usual + float(above[0])) / 2 if len(above) else usual + 1.0


def fit(row: np.ndarray, feature: np.ndarray, value: np.ndarray, positive: np.ndarray, prior: float, own: np.ndarray, seed: int = 11) -> Model:
    """Trained on all texts; each of ``FOLDS`` parts of them is scored by a training on the others, and these scores, over each training's intercept, set the level. feature: number in ``own``, the chosen features."""
    part = np.random.default_rng(seed).integers(0, FOLDS, len(positive))
    folds = [k for k in range(FOLDS) if all((part[kind] != k).any() for kind in (positive, ~positive))]
    w, b, s = nnpu(row, feature, value, positive, np.stack([np.full(len(positive), True), *(part != k for k in folds)], axis=1), prior, len(own))
    model, scores = Model(own, w[:, 0], float(b[0])), [s[(part == k) & ~positive, 1 + i] for i, k in enumerate(folds)]
    if any(len(u) for u in scores):
        model.level = model.bias + calibrate(np.concatenate(scores).astype(float), prior)
    return model


class Model:
    level = 0.0

    def __init__(self, own: np.ndarray, weight: np.ndarray, bias: float | None):
        self.own, self.weight, self.bias = own, weight, bias

    def score(self, column) -> np.ndarray:
        row, feature, n = features(column)
        if self.bias is None:
            return np.zeros(n)
        number = np.full(DIMS, -1)
        number[self.own] = np.arange(len(self.own))
        has = number[feature] >= 0
        r, f, x = counted(row[has], number[feature[has]], max(1, len(self.own)))
        s = np.bincount(r, weights=self.weight[f] * x, minlength=n) + self.bias
        return 1 / (1 + np.exp(-np.clip(SLOPE * (s - self.level) + np.log(THRESHOLD / (1 - THRESHOLD)), -500, 500)))


def learn(docs: DataFrame, labels: DataFrame, learned, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", positives: int = POSITIVES, block: int = BLOCK) -> Model:
    """learned: condition on id_col of the rows that may be learned from."""
    spark = docs.sparkSession
    nothing = Model(np.empty(0, np.int64), np.empty(0), None)
    own = labels.filter(learned & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    prior = own.agg(F.avg("y")).first()[0]
    yes = [r[0] for r in own.filter("y = 1").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(positives).collect()]
    if not yes:
        return nothing
    prior = min(max(prior if 0 < prior < 1 else FALLBACK_PRIOR, 0.01), 0.5)
    text = docs.filter(learned).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # rows that repeat an id are positives up to the bound, as the ids are
    confirmed = text.join(F.broadcast(spark.createDataFrame([(i,) for i in yes], "doc_id long")), "doc_id").orderBy(F.xxhash64("doc_id", "text"), "text").limit(positives)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            row, feature, _ = features(batch.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(row * DIMS + feature) % DIMS)], names=["f"])

    small_workers(spark)
    least = max(3, int(np.ceil(LEAST * len(yes)))) if len(yes) >= 20 else 1
    own = np.array(sorted(r[0] for r in confirmed.mapInArrow(held, "f long").groupBy("f").count().filter(F.col("count") >= least).select("f").collect()), np.int64)  # at most DIMS

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.full(DIMS, -1)
        number[own] = np.arange(len(own))
        for batch in small(batches):
            row, feature, n = features(batch.column("text"))
            has = number[feature] >= 0
            r, i, x = counted(row[has], number[feature[has]], max(1, len(own)))
            at = np.searchsorted(r, np.arange(n + 1))
            parts = [[v[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)] for v in (i.astype(np.int32), x.astype(np.float32))]
            yield pa.RecordBatch.from_arrays([batch.column("h"), *(pa.array(v, pa.binary()) for v in parts)], names=["h", "i", "x"])

    keyed = lambda df: df.select(F.xxhash64("doc_id", "text").alias("h"), "text").mapInArrow(f, "h long, i binary, x binary")
    some = sorted((r[0], bytes(r[1]), bytes(r[2])) for r in keyed(confirmed).collect())  # at most positives
    count = text.count()
    if not some or not count:
        return nothing
    shared = spark.sparkContext.broadcast(([r[1] for r in some], [r[2] for r in some]))
    blocks = max(1, -(-count // block))

    def trained(table: pa.Table) -> pa.Table:
        table = table.sort_by([("h", "ascending"), ("i", "ascending")])  # the same however rows arrive
        i, x = (first + table.column(c).to_pylist() for first, c in zip(shared.value, ("i", "x"), strict=True))
        del table
        positive = np.arange(len(i)) < len(shared.value[0])
        # so that a split by place does not part the two
        order = np.random.default_rng(5).permutation(len(i))
        positive, row = positive[order], np.repeat(np.arange(len(i), dtype=np.int32), [len(i[k]) // 4 for k in order])
        i, x = (np.frombuffer(b"".join([v[k] for k in order]), kind) for v, kind in ((i, np.int32), (x, np.float32)))
        model = fit(row, i, x, positive, prior, own)
        return pa.table({"f": pa.array([*range(len(own)), -1, -2], pa.int64()), "w": pa.array([*model.weight, model.bias, model.level], pa.float64())})

    # a partition for each block, so that no task has several
    found = keyed(text).withColumn("block", F.pmod("h", F.lit(blocks)).cast("int")).repartitionById(blocks, F.col("block")).groupBy("block").applyInArrow(trained, "f long, w double").groupBy("f").agg(F.avg("w").alias("w")).collect()  # a row for each feature, and two
    mean = {r["f"]: r["w"] for r in found}
    model = Model(own, np.array([mean[k] for k in range(len(own))]), mean[-1])
    model.level = mean[-2]
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", held_out=None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    small_workers(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.lit(False) if held_out is None else held_out).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    shared, level = docs.sparkSession.sparkContext.broadcast((model.own, model.weight, model.bias)), model.level

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        model.level = level
        for part in small(batches):
            s = model.score(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return own.mapInArrow(f, RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = documents(spark, sf_dir), split("doc_id", 3, 1)
    return score(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held), held_out=held)
