"""Stupid-backoff language-model scores, relationally (op 5).

Words (A-Z lower-cased) give n-grams of all orders up to ``order``, within a text. The count table is partitioned by
ranges of the n-grams' hash: pages send their distinct n-grams with their counts; a bucket, which is a part of the
table, adds the counts up over all documents, joins the table to the n-grams asked for, and sends their counts back, and
the page sums per document. A word scores log of ``count(n-gram) / count(context)`` for its longest n-gram seen
``min_count`` times or more, times ``alpha`` for each order given up; single words score ``count / words in all``.

Count table and join run over packed arrays (see ``pages``): as rows of an n-gram each they would be over three times
as many as there are words, and move some eight times the input. N-grams are told apart by all 64 bits of their hash:
of n different ones n * n / 2**65 pairs are expected to share a count, one in 6e9.

Cases. A text without words (null ones too) scores 0.0 with n_words 0. Rows of equal id are scored apart. An empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pages as P
from .common import Words, documents, mix

ORDER, ALPHA, MIN_COUNT = 3, 0.4, 2
#: Bytes of input that a page and a bucket share: pages of some 4 MB at 0.5 GB, as larger ones hold fewer distinct n-grams to a byte.
BLOB = 1 << 15
RESULT = "doc_id long, n_words long, total double, score double"


def _grams(text: pa.Array, order: int):
    """Words; distinct n-grams of orders 1 to order (sorted keys, counts); for each order its starts and their numbers."""
    words = Words(text, lower=True)
    found = [words.windows(n) for n in range(1, order + 1)]
    keys = [mix(h + np.uint64(n)) for n, (_, h) in enumerate(found)]
    own, which, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    split = np.split(which, np.cumsum([len(k) for k in keys])[:-1])
    return words, own, count, [(s, w) for (s, _), w in zip(found, split, strict=True)]


def pack_counts(count: np.ndarray) -> bytes:
    """A byte for each, and eight more for counts from 255 on."""
    big = count >= 255
    return np.minimum(count, 255).astype(np.uint8).tobytes() + count[big].astype("<u8").tobytes()


def unpack_counts(raw: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, "<u8", offset=n)
    return out


def _ask(order: int, buckets: int):
    def f(table: pa.Table) -> pa.Table:
        words, own, count, _ = _grams(P.load(table)[1], order)
        page = table.column("page")[0].as_py()
        rows = [(page, b, P.squeeze((y - x).to_bytes(8, "little") + P.steps(own[x:y]) + pack_counts(count[x:y]))) for b, x, y in P.slices(P.bucket_of(own, buckets))]
        # the number of words in all is the sum of a last bucket
        return P.pack([*rows, (page, buckets, P.squeeze(int(words.off[-1]).to_bytes(8, "little")))])

    return f


def _answer(buckets: int):
    def f(table: pa.Table) -> pa.Table:
        bucket, got = table.column("bucket")[0].as_py(), list(P.asked(table))
        if bucket == buckets:
            total = P.squeeze(sum(int.from_bytes(raw, "little") for _, raw in got).to_bytes(8, "little"))
            return P.pack([(p, bucket, total) for p, _ in got])
        size = [int.from_bytes(raw[:8], "little") for _, raw in got]
        key = np.concatenate([P.unsteps(raw[8 : 8 + 8 * n]) for (_, raw), n in zip(got, size, strict=True)])
        count = np.concatenate([unpack_counts(raw[8 + 8 * n :], n) for (_, raw), n in zip(got, size, strict=True)])
        # the part of the count table, and its join to what was asked
        order = np.argsort(key, kind="stable")
        head = np.concatenate([[True], key[order[1:]] != key[order[:-1]]])
        table_count = np.add.reduceat(count[order], np.flatnonzero(head))
        total = np.empty(len(key), np.int64)
        total[order] = table_count[np.cumsum(head) - 1]
        at = np.cumsum([0, *size])
        return P.pack([(p, bucket, P.squeeze(pack_counts(total[a:b]))) for (p, _), a, b in zip(got, at[:-1], at[1:], strict=True)])

    return f


def _totals(bucket: np.ndarray, buckets: int, replies: pa.Table) -> tuple[np.ndarray, int]:
    """Counts over all documents of the keys asked for, and the number of words in all."""
    out, total = np.zeros(len(bucket)), 0
    where = {b: (a, e) for b, a, e in P.slices(bucket)}
    for b, blob in zip(replies.column("bucket").to_pylist(), replies.column("blob").to_pylist(), strict=True):
        raw = P.unsqueeze(blob)
        if b == buckets:
            total = int.from_bytes(raw, "little")
        else:
            a, e = where[b]
            out[a:e] = unpack_counts(raw, e - a)
    return out, total


def _finish(order: int, alpha: float, min_count: int, buckets: int):
    def f(table: pa.Table, replies: pa.Table) -> pa.Table:
        ids, text = P.load(table)
        words, own, _, grams = _grams(text, order)
        count, total = _totals(P.bucket_of(own, buckets), buckets, replies)
        n = int(words.off[-1])
        by_word = np.zeros((order, n))  # count of the n-gram that begins at a word
        for k, (starts, number) in enumerate(grams):
            by_word[k, starts] = count[number]
        place = np.arange(n) - np.repeat(words.off[:-1], words.n)
        score, open_ = np.zeros(n), np.ones(n, bool)
        for k in range(order - 1, -1, -1):  # by k + 1 words ending here
            given_up = np.minimum(order - 1, place) - k
            ends = np.flatnonzero(open_ & (place >= k))
            seen = by_word[k, ends - k]
            ok = (seen >= min_count) if k else np.ones(len(ends), bool)
            at = ends[ok]
            below = by_word[k - 1, at - k] if k else float(max(total, 1))
            score[at] = np.log(seen[ok] / below) + given_up[at] * np.log(alpha)
            open_[at] = False
        sums = np.add.reduceat(np.append(score, 0.0), words.off[:-1]) if len(words.n) else np.empty(0)
        sums = np.where(words.n > 0, sums, 0.0)
        return pa.table({"doc_id": ids, "n_words": words.n.astype(np.int64), "total": sums, "score": sums / np.maximum(words.n, 1)})

    return f


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, alpha: float = ALPHA, min_count: int = MIN_COUNT) -> DataFrame:
    """doc_id, n_words, total (sum of the log scores of a text's words, n-grams counted over all documents), score (their mean)."""
    plan = P.Plan(docs, text_col, BLOB)
    pages = P.paged(docs, plan, id_col, text_col)
    replies = P.answer(P.ask(pages, _ask(order, plan.buckets)), _answer(plan.buckets))
    return P.with_replies(pages, replies, _finish(order, alpha, min_count, plan.buckets), RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir)).withColumns({"score": F.round("score", 6), "total": F.round("total", 4)})


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS p, unnest(list_prepend(NULL, w)[:len(w)]) AS before, unnest(list_prepend(NULL, list_prepend(NULL, w))[:len(w)]) AS before2 FROM d WHERE len(w) > 0),
one AS (SELECT x, count(*) AS c FROM word GROUP BY x), two AS (SELECT before, x, count(*) AS c FROM word WHERE p > 0 GROUP BY ALL), three AS (SELECT before2, before, x, count(*) AS c FROM word WHERE p > 1 GROUP BY ALL), n AS (SELECT sum(c) AS n FROM one),
s AS (SELECT doc_id, CASE WHEN p = 0 THEN ln(one.c / n) WHEN three.c >= 2 THEN ln(three.c / ctx2.c) WHEN two.c >= 2 THEN ln(two.c / ctx.c) + (least(p, 2) - 1) * ln(0.4) ELSE ln(one.c / n) + least(p, 2) * ln(0.4) END AS v
  FROM word JOIN one ON word.x = one.x LEFT JOIN one ctx ON word.before = ctx.x LEFT JOIN two ON word.before = two.before AND word.x = two.x
  LEFT JOIN two ctx2 ON word.before2 = ctx2.before AND word.before = ctx2.x LEFT JOIN three ON word.before2 = three.before2 AND word.before = three.before AND word.x = three.x, n)
SELECT d.doc_id, len(w)::BIGINT AS n_words, round(coalesce(total, 0.0), 4) AS total, round(coalesce(v, 0.0), 6) AS score FROM d LEFT JOIN (SELECT doc_id, sum(v) AS total, avg(v) AS v FROM s GROUP BY doc_id) s ON d.doc_id = s.doc_id
"""
