"""Suffix dedup by a depth-limited radix sort (op 3): bytes covered by a 200-byte string found elsewhere.

Suffixes are ordered only through ``threshold`` bytes, by most-significant-digit passes; a pass carries on only the
groups that the one before left with more than one member, and the groups left after the last digit are exactly the
repeated windows. Every byte begins a suffix, and sending each with its digits would move hundreds of times the input,
so the first digit is chosen by content, such that few suffixes get beyond it:

* First digit, over all pages: the *anchor*, of the ``ANCHOR``-byte strings of a window the one with the least hash.
  Equal windows have the same anchor at the same distance. Neighbouring windows that share one form a *span*;
  spans whose anchor occurs once end here, and equal spans (all their windows repeat) are settled here too.
* Further digits: spans whose anchor also has other spans (edges of passages, edits) are sent with their bytes to the
  anchor's bucket, where their suffixes are sorted: by distance from the anchor, then eight bytes at a time through
  the threshold (``radix_groups``). Bytes decide, not hashes.
* An anchor with more than ``SPLIT`` different spans, in a page (which then sends no more than that there are so many) or
  in all, is no bucket's work: its windows are sent one by one (of equal ones
  of a page, one), dealt by a hash of all their bytes, and sorted there in the same way.

Equal spans are found by 64-bit hashes, compared within an anchor only.

Cases. Null and short texts lose nothing. Rows of equal id are documents of their own. Texts are whole UTF-8
bytes, cut anywhere by a removal; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from . import pages as P
from .common import _BYTE, covered, documents, prefix_hash, span_hash, strings

THRESHOLD, ANCHOR, SPLIT = 200, 64, 32
#: Bytes of a text worked on at once; suffixes sorted at once.
PIECE, SUFFIXES = 1 << 19, 1 << 19
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
_LOW = np.uint64((1 << 22) - 1)
#: Answers on a span, as bits: all its windows repeat; its windows are to be told apart; one by one.
WHOLE, TELL, APART = 1, 2, 4


def _pieces(off: np.ndarray, threshold: int):
    """(first byte, end, text starts and ends within): texts end to end up to PIECE bytes, long ones in overlapping parts."""
    d, n = 0, len(off) - 1
    while d < n:
        e = d + 1
        while e < n and off[e + 1] - off[d] <= PIECE:
            e += 1
        if off[e] - off[d] <= PIECE + threshold or e > d + 1:
            yield int(off[d]), int(off[e]), off[d : e + 1] - off[d]
        else:
            for a in range(int(off[d]), int(off[e]), PIECE):
                b = min(a + PIECE + threshold - 1, int(off[e]))
                yield a, b, np.array([0, b - a])
                if b == off[e]:
                    break
        d = e


class Spans:
    """Spans of a page: first and last window (byte places in the page), anchor's place, hashes of anchor and span."""

    def __init__(self, text: pa.Array, threshold: int, anchor: int):
        self.buf, self.off = strings(text)
        self.threshold = threshold
        out = [self._piece(a, b, own, threshold, anchor) for a, b, own in _pieces(self.off, threshold)]
        kinds = (np.int64, np.int64, np.int64, np.uint64, np.uint64)
        self.first, self.last, self.place, self.anchor, self.span = (np.concatenate([x[i] for x in out]) if out else np.empty(0, t) for i, t in enumerate(kinds))

    def _piece(self, a: int, b: int, own: np.ndarray, threshold: int, anchor: int):
        none = *(np.empty(0, np.int64),) * 3, *(np.empty(0, np.uint64),) * 2
        n = b - a
        if n < threshold:
            return none
        prefix = prefix_hash(_BYTE[self.buf[a:b]])
        at = np.arange(n - anchor + 1)
        small = (span_hash(prefix, at, at + anchor) & ~_LOW) | at.astype(np.uint64)
        wide, reach = small, 1
        want = threshold - anchor + 1
        while reach * 2 <= want:
            wide = np.minimum(wide[:-reach], wide[reach:])
            reach *= 2
        if reach < want:
            wide = np.minimum(wide[: len(wide) - (want - reach)], wide[want - reach :])
        place = (wide & _LOW).astype(np.int64)  # of the anchor of window i
        mark = np.zeros(n + 1, np.int32)
        np.add.at(mark, np.maximum(own[1:] - (threshold - 1), own[:-1]), 1)
        np.add.at(mark, own[1:], -1)
        ok = np.cumsum(mark)[: len(place)] == 0
        head = ok.copy()
        head[1:] &= ~(ok[:-1] & (place[1:] == place[:-1]))
        tail = ok.copy()
        tail[:-1] &= ~(ok[1:] & (place[1:] == place[:-1]))
        first, last = np.flatnonzero(head), np.flatnonzero(tail)
        if not len(first):
            return none
        p = place[first]
        # the span's hash also holds where in it the anchor lies
        whole = span_hash(prefix, first, last + threshold) + (p - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return first + a, last + a, p + a, span_hash(prefix, p, p + anchor), whole


def radix_groups(data: np.ndarray, at: np.ndarray, group: np.ndarray, depth: int) -> list[np.ndarray]:
    """Groups of two and more numbers of suffixes, of equal ``group``, that agree in their first ``depth`` bytes.

    Most-significant-digit passes of up to eight bytes: each orders what is left by group and digit, and drops the suffixes
    that stand alone. at: where in data each suffix begins.
    """
    number = np.argsort(group, kind="stable")
    group, d = group[number], 0
    while True:
        head = np.concatenate([np.ones(min(1, len(group)), bool), group[1:] != group[:-1]])
        own = np.cumsum(head) - 1
        size = np.bincount(own)
        many = size[own] > 1
        number, group, size = number[many], own[many], size[size > 1]
        if d >= depth or not len(number):
            return np.split(number, np.cumsum(size)[:-1]) if len(number) else []
        step = min(8, depth - d)
        digit, place = np.zeros(len(number), np.uint64), at[number] + d
        for k in range(step):
            digit = (digit << np.uint64(8)) | data[place + k]
        # groups that agree in the digit stay as they are; the others are ordered by it
        group = np.repeat(np.arange(len(size)), size)
        first = np.cumsum(size) - size
        differs = np.bincount(group, weights=digit != digit[first][group]) > 0
        sort = np.flatnonzero(differs[group])
        by = sort[np.lexsort((digit[sort], group[sort]))]
        number[sort], digit[sort] = number[by], digit[by]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])])
        group, d = np.cumsum(new), d + step


def _span_keys(s: Spans, split: int):
    """Distinct pairs of anchor and span in the order of anchors: first span with each, whether it occurs twice or more here, the number of each span's pair.

    Then of each pair whether its anchor has more than ``split`` here, and whether it is sent: of such anchors the first is, for all.
    """
    order = np.lexsort((s.span, s.anchor))
    a, b = s.anchor[order], s.span[order]
    head = np.concatenate([np.ones(min(1, len(a)), bool), (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    which = np.empty(len(a), np.int64)
    which[order] = np.cumsum(head) - 1
    at = order[head]
    key = s.anchor[at]
    new = np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]])
    group = np.cumsum(new) - 1
    hot = np.bincount(group, minlength=int(new.sum()))[group] > split
    return at, np.bincount(which, minlength=len(at)) > 1, which, hot, new | ~hot


def _ask_spans(threshold: int, anchor: int, buckets: int, split: int):
    def f(table: pa.Table) -> pa.Table:
        s = Spans(P.load(table)[1], threshold, anchor)
        at, twice, _, hot, sent = _span_keys(s, split)
        at, twice, hot = at[sent], twice[sent], hot[sent]
        page, key, span = table.column("page")[0].as_py(), s.anchor[at], s.span[at]
        return P.pack([(page, b, P.squeeze((y - x).to_bytes(8, "little") + P.steps(key[x:y]) + P.planes(span[x:y]) + np.packbits(np.concatenate([twice[x:y], hot[x:y]])).tobytes())) for b, x, y in P.slices(P.bucket_of(key, buckets))])

    return f


def _answer_spans(split: int):
    def f(table: pa.Table) -> pa.Table:
        """For each span asked: WHOLE, TELL, APART."""
        pages, bucket, parts = [], table.column("bucket")[0].as_py(), []
        for page, raw in P.asked(table):
            n = int.from_bytes(raw[:8], "little")
            pages.append((page, n))
            bits = np.unpackbits(np.frombuffer(raw, np.uint8, offset=8 + 16 * n), count=2 * n)
            parts.append((P.unsteps(raw[8 : 8 + 8 * n]), P.unplanes(raw[8 + 8 * n : 8 + 16 * n], "<u8"), bits[:n], bits[n:]))
        anchor, span, twice, hot = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((span, anchor))
        a, s = anchor[order], span[order]
        new_anchor = np.concatenate([[True], a[1:] != a[:-1]])
        new_span = new_anchor.copy()
        new_span[1:] |= s[1:] != s[:-1]
        group, kind = np.cumsum(new_anchor) - 1, np.cumsum(new_span) - 1
        many = (np.bincount(kind) > 1) | (np.bincount(kind, weights=twice[order]) > 0)
        kinds = np.bincount(group, weights=new_span)[group]
        # of equal spans of an anchor that has others too, the first is told apart, for all of them
        code = np.where(many[kind], WHOLE, 0) | np.where((kinds > 1) & new_span, TELL, 0) | np.where(kinds > split, APART, 0)
        # where a page has not said which spans it has, all pages tell theirs
        code = np.where(np.bincount(group, weights=hot[order])[group] > 0, np.where(twice[order] > 0, WHOLE, 0) | TELL | APART, code)
        out = np.empty(len(code), np.uint8)
        out[order] = code
        at = np.cumsum([0, *(n for _, n in pages)])
        return P.pack([(p, bucket, P.squeeze(out[x:y].tobytes())) for (p, _), x, y in zip(pages, at[:-1], at[1:], strict=True)])

    return f


def _alike(buf: np.ndarray, at: np.ndarray, key: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The first of each set of equal strings, and the number in it of every string. Strings of one key are compared byte by byte."""
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    for x in range(0, len(same), 1 << 16):
        part = np.flatnonzero(same[x : x + (1 << 16)]) + x
        a, b = at[order[part + 1]], at[order[part]]
        equal = np.ones(len(part), bool)
        for k in range(length):
            equal &= buf[a + k] == buf[b + k]
        same[part] = equal
    head = np.concatenate([np.ones(min(1, len(at)), bool), ~same])
    which = np.empty(len(at), np.int64)
    which[order] = np.cumsum(head) - 1
    return order[head], which


class Told:
    """What a page has told apart, in the order of keys: key, first window, number of windows, distance of the anchor, whether its windows are known to repeat.

    place, flat: each window that is asked about, and its number among the windows of what is sent. code: of each span.
    """

    def __init__(self, s: Spans, replies: pa.Table, buckets: int, split: int):
        at, twice, which, hot, sent = _span_keys(s, split)
        code = np.where(twice, WHOLE, 0).astype(np.uint8) | np.uint8(TELL | APART)  # of hot anchors
        code[~hot] = P.in_order(P.bucket_of(s.anchor[at[sent]], buckets), replies, np.uint8)[~hot[sent]]
        self.code = code[which] if len(code) else np.empty(0, np.uint8)
        whole = np.zeros(len(s.first), bool)
        whole[at] = code & WHOLE > 0
        own, single = at[(code & TELL > 0) & (code & APART == 0)], at[(code & TELL > 0) & (code & APART > 0)]
        n = s.last[single] - s.first[single] + 1
        place = np.repeat(s.first[single], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        by = [span_hash(prefix_hash(_BYTE[s.buf[a : b + s.threshold]]), np.arange(b - a + 1), np.arange(b - a + 1) + s.threshold) for a, b in zip(s.first[single], s.last[single], strict=True)]
        window = np.concatenate([*by, np.empty(0, np.uint64)])
        first, number = _alike(s.buf, place, window, s.threshold)
        known = np.repeat(whole[single], n)
        repeats = (np.bincount(number, minlength=len(first)) > 1) | (np.bincount(number, weights=known, minlength=len(first)) > 0)
        key, start = np.concatenate([s.anchor[own], window[first]]), np.concatenate([s.first[own], place[first]])
        count = np.concatenate([s.last[own] - s.first[own] + 1, np.ones(len(first), np.int64)])
        far = np.concatenate([s.place[own] - s.first[own], np.repeat(s.place[single], n)[first] - place[first]])
        order = np.argsort(key, kind="stable")
        begin = np.empty(len(order), np.int64)
        begin[order] = np.cumsum(count[order]) - count[order]
        self.key, self.first, self.count, self.far, self.whole = key[order], start[order], count[order], far[order], np.concatenate([whole[own], repeats])[order]
        inside = np.arange(int(count[: len(own)].sum())) - np.repeat(np.cumsum(count[: len(own)]) - count[: len(own)], count[: len(own)])
        self.place = np.concatenate([np.repeat(s.first[own], count[: len(own)]) + inside, place])
        self.flat = np.concatenate([np.repeat(begin[: len(own)], count[: len(own)]) + inside, begin[len(own) :][number]])


def _ask_windows(threshold: int, anchor: int, buckets: int, split: int):
    def f(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return P.nothing()
        s = Spans(P.load(table)[1], threshold, anchor)
        t = Told(s, replies, buckets, split)
        key, first, count, far, whole = t.key, t.first, t.count, t.far, t.whole
        page, rows = table.column("page")[0].as_py(), []
        for b, x, y in P.slices(P.bucket_of(key, buckets)):
            bytes_ = b"".join(s.buf[i : i + n + threshold - 1].tobytes() for i, n in zip(first[x:y].tolist(), count[x:y].tolist(), strict=True))
            rows.append((page, b, P.squeeze((y - x).to_bytes(8, "little") + P.steps(key[x:y]) + P.planes(count[x:y].astype("<u4")) + P.planes(far[x:y].astype("<u4")) + np.packbits(whole[x:y]).tobytes() + bytes_, 3)))
        return P.pack(rows)

    return f


def _answer_windows(threshold: int):
    def f(table: pa.Table) -> pa.Table:
        """For each window told apart, in the order asked: whether it repeats."""
        pages, bucket, parts = [], table.column("bucket")[0].as_py(), []
        for page, raw in P.asked(table):
            n = int.from_bytes(raw[:8], "little")
            key, count, far = P.unsteps(raw[8 : 8 + 8 * n]), P.unplanes(raw[8 + 8 * n : 8 + 12 * n], "<u4").astype(np.int64), P.unplanes(raw[8 + 12 * n : 8 + 16 * n], "<u4").astype(np.int64)
            bits = -(-n // 8)
            parts.append((key, count, far, np.unpackbits(np.frombuffer(raw, np.uint8, bits, 8 + 16 * n), count=n).astype(bool), np.frombuffer(raw, np.uint8, offset=8 + 16 * n + bits)))
            pages.append((page, int(count.sum())))
        key, count, far, whole, data = (np.concatenate(x) for x in zip(*parts, strict=True))
        start = np.cumsum(count + threshold - 1) - (count + threshold - 1)
        begin = np.cumsum(count) - count  # of each entry's windows among all
        flags = np.repeat(whole, count)
        order = np.argsort(key, kind="stable")
        edges = np.flatnonzero(np.concatenate([[True], key[order[1:]] != key[order[:-1]], [True]]))
        x = 0
        while x < len(edges) - 1:  # keys together, up to so many suffixes
            y = x + 1
            size = int(count[order[edges[x] : edges[y]]].sum())
            while y < len(edges) - 1 and size + (more := int(count[order[edges[y] : edges[y + 1]]].sum())) <= SUFFIXES:
                size, y = size + more, y + 1
            own = order[edges[x] : edges[y]]
            n = count[own]
            inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            window, at = np.repeat(begin[own], n) + inside, np.repeat(start[own], n) + inside
            # the digit that all share so far: the key, and the distance from the anchor
            _, group = np.unique(np.repeat(key[own], n), return_inverse=True)
            distance = np.repeat(far[own], n) - inside
            for equal in radix_groups(data, at, group * (threshold + 1) + distance, threshold):
                flags[window[equal]] = True
            x = y
        ends = np.cumsum([0, *(n for _, n in pages)])
        return P.pack([(p, bucket, P.squeeze(np.packbits(flags[a:b]).tobytes())) for (p, _), a, b in zip(pages, ends[:-1], ends[1:], strict=True)])

    return f


def _finish(threshold: int, anchor: int, buckets: int, split: int, with_bytes: bool):
    def f(table: pa.Table, replies: pa.Table) -> pa.Table:
        ids, text = P.load(table)
        s = Spans(text, threshold, anchor)
        bucket = replies.column("bucket").to_numpy()
        one, two = replies.filter(pa.array(bucket >= 0)), replies.filter(pa.array(bucket < 0))
        two = two.set_column(1, "bucket", pc.subtract(pa.scalar(-1, pa.int32()), two.column("bucket")))
        t, n = Told(s, one, buckets, split), len(s.buf)
        flag = P.in_order(np.repeat(P.bucket_of(t.key, buckets), t.count), two, bool, bits=True)
        gone = covered(t.place[flag[t.flat]], threshold, n)
        for a, b in zip(s.first[t.code & WHOLE > 0], s.last[t.code & WHOLE > 0], strict=True):
            gone[a : b + threshold] = True
        rows = []
        for a, b in zip(s.off[:-1], s.off[1:], strict=True):
            g = gone[a:b]
            k = int(g.sum())
            runs = int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if k else 0
            left = (s.buf[a:b][~g] if k else s.buf[a:b]).tobytes()
            rows.append((int(b - a), k, runs, hashlib.sha256(left).hexdigest(), left if with_bytes else None))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        return pa.table([ids, *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return f


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, anchor: int | None = None, with_bytes: bool = True, split: int = SPLIT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes left; null unless asked for)."""
    anchor = anchor or max(1, min(ANCHOR, threshold // 2))
    plan = P.Plan(docs, text_col)
    pages = P.paged(docs, plan, id_col, text_col)
    spans = P.answer(P.ask(pages, _ask_spans(threshold, anchor, plan.buckets, split)), _answer_spans(split))
    asks = P.with_replies(pages, spans, _ask_windows(threshold, anchor, plan.buckets, split), P.BLOBS)
    windows = P.answer(asks, _answer_windows(threshold)).selectExpr("page", "-1 - bucket AS bucket", "blob")
    return P.with_replies(pages, spans.unionByName(windows), _finish(threshold, anchor, plan.buckets, split, with_bytes), RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir), with_bytes=False).drop("kept")
