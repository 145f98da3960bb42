"""Operators against brute force on small tables that hold the awkward cases."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("rankforge.llm")

from pyspark.sql import functions as F  # noqa: E402
from rankforge.llm import bpe, common, exact_dedup, jaccard_join, language_id, lm_scoring, mixing, pages, quality_rules, substring_dedup, suffix_dedup, toxicity  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, page int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts():
    rng = random.Random(4)
    vocabulary = ["alpha", "Beta", "gamma", "δέλτα", "épsilon", "z eta", "eta!", "漢字", "x", "The", "of", "###", "a|b"]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, base = make(60), make(150)
    near = base.split()
    near[70] = "changed"
    out = [None, "", " \t\n\x0b\x0c\r ", "one", "two words", "a b c d", base, base, base.replace(" ", "\n"), " ".join(near), make(30) + " " + passage, passage + "\n" + make(40), make(10) + "  " + passage + " " + make(5), "a" * 500, "ab" * 400, "same line here\n" * 30, make(2000), " ".join(["spam"] * 100)]
    out += [make(rng.randint(1, 80)) for _ in range(30)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    """With extra columns whose names clash with results'."""
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, None, 1, 2) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, repeated rows, repeated ids with other texts."""
    t = " ".join(f"w{i}" for i in range(60))
    return spark.createDataFrame([(None, t, None, None, None, 1, 2), (None, None, None, None, None, 1, 2), (1, t, "en", "a", 1, 1, 2), (1, t, "en", "a", 1, 1, 2), (1, "other text", "de", "b", 1, 1, 2), (2, t, None, "a", 1, 1, 2)], SCHEMA)


def words(t):
    return WORD.findall(t or "")


def sha(b):
    return hashlib.sha256(b).hexdigest()


def every():
    return {
        "language": lambda d: language_id.identify(d, language_id.Model([], np.zeros((1, 1)), np.zeros(1), 1.0)),
        "quality": lambda d: quality_rules.judge(d),
        "suffix": lambda d: suffix_dedup.dedup(d),
        "bpe": lambda d: bpe.encode_decode(d),
        "lm": lambda d: lm_scoring.score(d),
        "mixing": lambda d: mixing.mix(d),
        "jaccard": lambda d: jaccard_join.components(d),
        "exact": lambda d: exact_dedup.dedup(d),
        "substring": lambda d: substring_dedup.dedup(d),
        "toxicity": lambda d: toxicity.score(d, toxicity.Model(np.empty(0, np.int64), np.empty(0), None)),
    }


@pytest.mark.parametrize("name", list(every()))
def test_empty_tables(name, empty):
    assert every()[name](empty).collect() == []


def _by(rows, *names):
    return sorted((tuple(r[n] for n in names) for r in rows), key=str)


def test_odd_tables(odd):
    """Null ids, null texts, repeated rows and ids, clashing names: what each operator says of every row."""
    t, o = " ".join(f"w{i}" for i in range(60)), "other text"
    n, got = len(t), {k: f(odd).collect() for k, f in every().items()}
    assert _by(got["suffix"], "doc_id", "n_bytes", "n_removed", "n_spans") == sorted([(None, n, n, 1), (None, 0, 0, 0), (1, n, n, 1), (1, n, n, 1), (1, len(o), 0, 0), (2, n, n, 1)], key=str)
    assert _by(got["substring"], "doc_id", "n_words", "n_removed") == sorted([(None, 60, 0), (None, 0, 0), (1, 60, 60), (1, 60, 60), (1, 2, 0), (2, 60, 60)], key=str)
    assert _by(got["jaccard"], "doc_id", "n_shingles", "component_id") == sorted([(None, 57, 1), (None, 0, None), (1, 57, 1), (1, 57, 1), (1, 1, 1), (2, 57, 1)], key=str)
    assert _by(got["exact"], "doc_id", "keep_id", "group_size", "kept") == sorted([(None, 1, 4, False), (None, None, 1, True), (1, 1, 4, True), (1, 1, 4, True), (1, 1, 1, True), (2, 1, 4, False)], key=str)
    assert _by(got["bpe"], "doc_id", "decoded") == sorted([(None, t), (None, ""), (1, t), (1, t), (1, o), (2, t)], key=str)
    assert _by(got["quality"], "doc_id", "n_words", "base_failed", "n_repeat_words") == sorted([(None, 60, False, 0), (None, 0, True, 0), (1, 60, False, 0), (1, 60, False, 0), (1, 2, True, 0), (2, 60, False, 0)], key=str)
    total = 4 * 60 + 2
    lm = {(r.doc_id, r.n_words): r for r in got["lm"]}
    first = np.log(4 / total)  # every word of t is seen four times, and always after the same one
    assert lm[2, 60].total == pytest.approx(first) and lm[1, 2].total == pytest.approx(2 * np.log(1 / total) + np.log(0.4)) and lm[None, 0].score == 0.0
    # two sources and a null one; the empty text takes nothing
    sizes = {None: 60, "a": 180, "b": 2}
    for r in got["mixing"]:
        assert 0 <= r.taken <= 2 * r.size and r.source_size in sizes.values() and (r.size > 0 or r.taken == 0)
    assert sum(r.taken for r in got["mixing"]) == pytest.approx(1.5 * total, abs=3)
    assert {(r.lang_pred, r.score) for r in got["language"]} == {("und", 0.0)} and {(r.score, r.predicted) for r in got["toxicity"]} == {(0.0, 0)}


def test_learning_from_odd_tables(spark, empty, odd):
    everything = F.lit(True)
    assert language_id.learn(empty, "doc_id", "text", "lang", everything).languages == []
    model = language_id.learn(odd, "doc_id", "text", "lang", everything)
    assert sorted(model.languages) == ["de", "en"]
    got = language_id.identify(odd, model).collect()
    assert _by(got, "doc_id", "lang_pred") == sorted([(None, "en"), (None, "und"), (1, "en"), (1, "en"), (1, "de"), (2, "en")], key=str)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    for docs, labels in ((empty, none), (odd, none), (empty, spark.createDataFrame([(1, 1)], none.schema)), (odd, spark.createDataFrame([(1, 0), (None, 1), (2, None)], none.schema))):
        assert toxicity.learn(docs, labels, everything).bias is None
    # of several labels of an id any 1 counts, and its rows are positives together
    model = toxicity.learn(odd, spark.createDataFrame([(1, 0), (1, 1), (1, 1)], none.schema), everything)
    assert model.bias is not None and all(0 <= r.score <= 1 for r in toxicity.score(odd, model).collect())


def test_rare_languages_are_learned(spark):
    """Three documents of one language beside thousands of another, with a sample far smaller than the table; and many languages."""
    rows = [(i, "der und keit ung sch " * 5, "de") for i in range(3000)] + [(9000 + i, "que eau ment le la " * 5, "fr") for i in range(3)]
    model = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang", F.lit(True), limit=60, least=10)
    assert model.languages == ["de", "fr"] and model.predict(["que ment la eau", "und der keit"])[0] == ["fr", "de"]
    many = [(i, f"{chr(0x4E00 + 7 * i)}{chr(0x4E03 + 7 * i)} " * 9, f"l{i:03}") for i in range(300)]
    assert len(language_id.learn(spark.createDataFrame(many, "doc_id long, text string, lang string"), "doc_id", "text", "lang", F.lit(True), limit=60, least=1).languages) == 300


def test_document_frequencies_cover_all(monkeypatch):
    texts_ = ["abc", "ab", "x" * 500, ""]
    want = np.zeros(language_id.DIMS, int)
    for i, _ in language_id.counts(texts_):
        want[i] += 1
    assert (language_id.frequencies(texts_) == want).all()
    monkeypatch.setattr(language_id, "STEP", 100)
    assert (language_id.frequencies(texts_) == want).all()


def test_one_row_of_each(spark):
    """Exactly one row of each class, with null and repeated ids; columns of any name stay."""
    a, b, c, d, e, g = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcdeg")
    schema = "doc_id long, text string, _kept int, _copies int, _key int, _salt int, _c0 int, vertex int, digest int, n int"
    make = lambda rows: spark.createDataFrame([(*r, *range(8)) for r in rows], schema)
    rows = [(None, a), (None, a), (1, b), (None, b), (5, c), (5, d), (3, d), (7, e), (7, e), (8, e), (None, g), (None, g)]
    want = [(None, a), (1, b), (5, c), (3, d), (7, e), (None, g)]
    for f in (exact_dedup.one_of_each, jaccard_join.one_of_each):
        got = f(make(rows))
        assert got.columns == make(rows).columns
        got = got.collect()
        assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(want, key=str), f
        assert all(tuple(r)[2:] == tuple(range(8)) for r in got)
        assert f(make([])).collect() == []
    assert {(r.doc_id, r.text) for r in jaccard_join.one_of_each(make([(1, None), (2, ""), (2, "")])).collect()} == {(1, None), (2, "")}
    assert mixing.mixed(make([(1, a), (2, b)]).withColumn("source", F.lit("s"))).columns == [*make([]).columns, "source"]
    assert quality_rules.filter_docs(make([(1, a * 3)])).columns == make([]).columns


def test_quality_statistics(docs):
    got = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    for i, t in enumerate(texts()):
        w, lines = words(t), [x for x in (t or "").split("\n") if words(x)]
        at = Counter()
        for k in range(len(w) - 2):
            at[tuple(w[k : k + 3])] += 1
        repeated = {k + j for k in range(len(w) - 2) if at[tuple(w[k : k + 3])] > 1 for j in range(3)}
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(repeated)), i
        assert r.base_failed == (len(w) < 50 or 100 * len(repeated) > 50 * len(w))
        assert not (r.kept and r.base_failed)
    assert sum(1 for _ in got) == len(texts())


def test_quality_is_native(docs):
    plan = quality_rules.judge(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def votes_of(t):
    """The rules again, in Python."""
    w, lines = words(t), [x for x in (t or "").split("\n") if words(x)]
    n, chars = max(1, len(w)), max(1, sum(map(len, w)))
    at = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    repeated = len({k + j for k in range(len(w) - 2) if at[tuple(w[k : k + 3])] > 1 for j in range(3)})
    letters = sum(1 for x in "".join(w) if not (ord(x) < 128 and not x.isalpha()))
    long = abs(sum(map(len, w)) / n - 5.2)
    shares = [
        (len(w) >= 80, len(w) < 20),
        *((x <= good, x >= bad) for x, good, bad in (
            (100 * len(re.findall(r"[#*$%&|<>]", t or "")) / n, 5, 25), (100 * len(re.findall(r"[#*$%&|<>]+", t or "")) / n, 5, 20))),
        (100 * letters / chars >= 92, 100 * letters / chars <= 80),
        *((x <= good, x >= bad) for x, good, bad in (
            (100 * repeated / n, 12, 40), (100 * (len(lines) - len(set(lines))) / max(1, len(lines)), 10, 30),
            (100 * (t or "").count("!") / n, 3, 25), (100 * len(re.findall("[A-Z]", t or "")) / chars, 6, 30), (long, 1.2, 2.2))),
        (100 * len(set(w)) / n >= 55, 100 * len(set(w)) / n <= 25),
    ]
    return "".join("0" if bad else "1" if good else "-" for good, bad in shares), len(w) < 50 or 100 * repeated > 50 * len(w)


def posteriors_of(votes):
    """Expectation-maximisation over documents one by one."""
    m = len(votes[0])
    x = np.array([["10-".index(c) for c in v] for v in votes])
    first = np.array(quality_rules.FIRST)
    rates, prior = np.tile(first + 1e-6, (m, 1, 1)), quality_rules.PRIOR
    for turn in range(quality_rules.ROUNDS + 1):
        odds = np.log(prior / (1 - prior)) + sum(np.log(rates[j, 0, x[:, j]] / rates[j, 1, x[:, j]]) for j in range(m))
        q = 1 / (1 + np.exp(-odds))
        if turn == quality_rules.ROUNDS:
            return q
        n = (q.sum(), (1 - q).sum())
        prior = (n[0] + quality_rules.WEIGHT * quality_rules.PRIOR) / (len(q) + quality_rules.WEIGHT)
        for j in range(m):
            for side, share in enumerate((q, 1 - q)):
                for k in range(3):
                    rates[j, side, k] = (share[x[:, j] == k].sum() + quality_rules.WEIGHT * first[side, k] + 1e-6) / (n[side] + quality_rules.WEIGHT + 3e-6)


def corpus(seed=5, n=300):
    """Clean prose, some with a single flaw, and junk of several kinds."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(3, 8)))
    prose = lambda k: [" ".join(word() for _ in range(10)) + "." for _ in range(k)]
    clean = ["\n".join(prose(rng.randint(6, 14))) for _ in range(n)]
    flawed = ["\n".join([*own, *own[:1], *own[:1], *own[:1]]) for own in (prose(5) for _ in range(4))]  # lines met again, no more
    hashes = ["\n".join(" ".join(word() + rng.choice(["###", "$$$"]) for _ in range(10)) for _ in range(10)) for _ in range(20)]
    bars = [" | ".join(word() for _ in range(90)) for _ in range(15)]
    shouts = [" ".join(word().upper() + "!!" for _ in range(20)) + "\n" + " ".join(["BUY", word().upper() + "!!"] * 40) for _ in range(15)]
    return clean, flawed, [*hashes, *bars, *shouts]


def test_quality_posterior(spark):
    clean, flawed, junk = corpus()
    data = [*clean, *flawed, *junk, None, "", "one", "short text of six words here"]
    df = spark.createDataFrame(list(enumerate(data)), "doc_id long, text string")
    got = {r.doc_id: r for r in quality_rules.judge(df).collect()}
    want = [votes_of(t) for t in data]
    assert [got[i].votes for i in range(len(data))] == [v for v, _ in want]
    q = posteriors_of([v for v, _ in want])
    for i in range(len(data)):
        assert got[i].quality == pytest.approx(q[i], abs=1e-9) and got[i].base_failed == want[i][1]
        assert got[i].kept == (q[i] >= 0.5 and not want[i][1])
    kept = {i for i in range(len(data)) if got[i].kept}
    # a vote for bad is overruled, which a filter that all rules must pass would not do
    assert any("0" in got[i].votes for i in kept) and set(range(len(clean) + len(flawed))) <= kept
    assert not kept & set(range(len(clean) + len(flawed), len(data)))
    # nor does one rule decide: junk passes all rules but a few
    assert all(got[i].quality < 0.01 for i in range(len(clean) + len(flawed), len(clean) + len(flawed) + len(junk)))


def test_quality_long_texts_and_clashing_names(spark):
    rng = random.Random(2)
    long = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(5)) for _ in range(60_000))
    df = spark.createDataFrame([(1, long, 7, "x"), (2, long + " " + long[:600], 8, "y")], "doc_id long, text string, n_words long, _w string")
    got = {r.doc_id: r for r in quality_rules.judge(df).collect()}
    assert got[1].n_words == 60_000 and got[2].n_repeat_words >= 200
    assert sorted(tuple(r) for r in quality_rules.filter_docs(df).select("doc_id", "n_words", "_w").collect()) == [(1, 7, "x"), (2, 8, "y")]
    assert sorted(r._w for r in quality_rules.judge(df, carry=("doc_id", "_w")).collect()) == ["x", "y"]


def test_quality_keeps_clean_and_drops_junk(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9)))
    clean = [" ".join(word() for _ in range(120)) + "." for _ in range(80)]
    junk = [" ".join(word() + rng.choice(["###", "$$$", "&&&"]) for _ in range(120)) for _ in range(10)] + [("BUY " + word().upper() + "!! ") * 60 for _ in range(8)]
    df = spark.createDataFrame(list(enumerate(clean + junk)), "doc_id long, text string")
    kept = {r.doc_id for r in quality_rules.filter_docs(df).collect()}
    assert kept == set(range(80))
    assert quality_rules.filter_docs(df).columns == ["doc_id", "text"]


@pytest.mark.parametrize(("threshold", "anchor", "split"), [(40, 16, 1024), (40, 16, 1), (200, 64, 1024), (37, 8, 2)])
def test_suffix_dedup(docs, monkeypatch, threshold, anchor, split):
    monkeypatch.setattr(suffix_dedup, "SUFFIXES", 300)
    data = [(t or "").encode() for t in texts()]
    count = Counter(b[i : i + threshold] for b in data for i in range(len(b) - threshold + 1))
    got = {r.doc_id: r for r in suffix_dedup.dedup(docs, threshold=threshold, anchor=anchor, split=split).collect()}
    for d, b in enumerate(data):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - threshold + 1):
            if count[b[i : i + threshold]] > 1:
                gone[i : i + threshold] = True
        left = bytes(np.frombuffer(b, np.uint8)[~gone])
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        assert (got[d].n_bytes, got[d].n_removed, got[d].n_spans, got[d].kept_sha256, bytes(got[d].kept)) == (len(b), int(gone.sum()), runs, sha(left), left), d


def test_suffix_dedup_in_pieces(docs, monkeypatch):
    whole = sorted((r.doc_id, r.kept_sha256) for r in suffix_dedup.dedup(docs, threshold=40).collect())
    column = pa.array(texts())
    big, small = suffix_dedup.Spans(column, 40, 16), None
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    small = suffix_dedup.Spans(column, 40, 16)
    cover = lambda s: {w for a, b in zip(s.first, s.last) for w in range(a, b + 1)}
    assert cover(big) == cover(small) and len(whole) == len(texts())


def test_substring_dedup(docs, spark):
    window = 8
    seen, want = {}, {}
    for d, t in enumerate(texts()):
        w = words(t)
        gone = set()
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in seen:
                gone |= set(range(i, i + window))
            else:
                seen[key] = d
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want[d] = (len(w), len(gone), sha(kept.encode()), kept)
    for batches, fanout in ((1, 4), (2, 4), (5, 2)):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in substring_dedup.dedup(docs, window=window, batches=batches, fanout=fanout).collect()}
        assert got == want, batches


def test_substring_dedup_verifies_hits(spark):
    """Two words that agree in the first hash, whatever its base (Thue-Morse strings), and in nothing else."""
    one = "a"
    while len(one) < 2048:
        one += one.translate({97: "b", 98: "a"})
    two = one.translate({97: "b", 98: "a"})
    both = common.Words(pa.array([one, two]), twice=True)
    assert both.hash[0] == both.hash[1] and both.other[0] != both.other[1]
    head = " ".join(f"w{i}" for i in range(19))
    rows = [(0, f"{head} {one}"), (1, f"{head} {two}"), (2, f"{head} {one} x{' y' * 5} {head} {two}"), (3, f"{head} z {two}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for batches, fanout in ((1, 4), (2, 4), (4, 1)):
        got = {r.doc_id: r.n_removed for r in substring_dedup.dedup(docs, batches=batches, fanout=fanout).collect()}
        assert got == {0: 0, 1: 0, 2: 40, 3: 0}, batches


def test_index_goes_on_in_another_session(spark, tmp_path):
    """Later documents meet the windows of earlier ones by what the folder holds; compaction and a failed attempt leave the same."""
    words_ = [f"w{i}" for i in range(400)]
    first = [(i, " ".join(words_[20 * i : 20 * i + 30])) for i in range(8)]
    later = [(100, " ".join(words_[45:75])), (101, "x " * 5 + " ".join(words_[300:330])), (102, " ".join(words_[300:330]))]
    one, two = (spark.createDataFrame(rows, "doc_id long, text string") for rows in (first, later))
    whole = {r.doc_id: (r.n_removed, r.kept_sha256) for r in substring_dedup.dedup(one.union(two), window=8).collect()}
    folder = str(tmp_path / "index")
    got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in substring_dedup.dedup(one, window=8, batches=2, fanout=1, folder=folder).collect()}
    index = substring_dedup.FingerprintIndex.open(spark.newSession(), folder)
    assert len(index.runs) == 1 and index.window == 8  # compacted
    (tmp_path / "index" / "runs" / f"run={index.last + 1}").mkdir()
    (tmp_path / "index" / "runs" / f"run={index.last + 1}" / "left.parquet").write_bytes(b"of a failed attempt")
    got |= {r.doc_id: (r.n_removed, r.kept_sha256) for r in substring_dedup.dedup(two, folder=folder).collect()}
    assert got == whole and got[100][0] > 0 and got[102][0] == 30


def test_ranges_of_ids(spark):
    """Pages rise with ids, whatever their spread; null ids come before all."""
    ids = [None, -(2**40), -5, 0, 1, 2, 3, 2**40, 2**62] + list(range(1000, 1500))
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    plan = pages.Plan(df)
    plan.pages = 37
    for ranges in (4, 2048):
        cuts = pages.Cuts(df, plan, ranges=ranges)
        own = np.array([i for i in ids if i is not None])
        page = cuts(own, np.ones(len(own), bool), np.zeros(len(own), np.int64))
        order = np.argsort(own)
        assert (np.diff(page[order]) >= 0).all() and page.min() >= plan.pages and page.max() < cuts.pages
        assert cuts(np.zeros(1, np.int64), np.zeros(1, bool), np.array([5]))[0] == 5
        bounds = cuts.batches(4)
        assert bounds[0][0] is None and bounds[-1][1] is None and all(a[1] == b[0] for a, b in zip(bounds, bounds[1:]))
        for low, high in bounds:  # no page in two batches
            inside = page[((own > low) if low is not None else True) & ((own <= high) if high is not None else np.ones(len(own), bool))]
            assert len(inside) == 0 or not set(inside) & set(page[(own > high) if high is not None else np.zeros(len(own), bool)])


def test_page_plan_grows_with_the_root():
    sizes = [10**8, 10**10, 10**12, 10**14]
    units = [min(pages.MOST, max(pages.LEAST, int((s * pages.BLOB) ** 0.5))) for s in sizes]
    blobs = [(s / u) ** 2 for s, u in zip(sizes, units)]
    assert units[-1] == pages.MOST and all(b * pages.BLOB <= 1.1 * s for b, s in zip(blobs[:2], sizes[:2]))


def test_components_settle_or_raise(spark):
    from rankforge.llm.components import connected

    path = spark.createDataFrame([(i, i + 1) for i in range(9)] + [(100, i) for i in range(101, 120)], "a long, b long")
    for hot in (4, 1 << 17):
        assert {r.node: r.root for r in connected(path, hot=hot).collect()} == {**{i: 0 for i in range(1, 10)}, **{i: 100 for i in range(101, 120)}}
    with pytest.raises(RuntimeError, match="not settled"):
        connected(path, rounds=1)


def test_runs():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**64, 1000, dtype=np.uint64))
    assert (substring_dedup.unpack_pairs(substring_dedup.pack_pairs(keys, keys.astype(np.uint32)))[0] == keys).all()
    assert len(substring_dedup.unpack_pairs(substring_dedup.pack_pairs(keys[:0], keys[:0].astype(np.uint32)))[0]) == 0


@pytest.mark.parametrize("order", [1, 3, 4])
def test_lm_scores(docs, order):
    lower = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(t)]
    own = [lower(t) for t in texts()]
    count = Counter(tuple(w[i : i + n]) for w in own for n in range(1, order + 1) for i in range(len(w) - n + 1))
    total = sum(map(len, own))
    got = {r.doc_id: r for r in lm_scoring.score(docs, order=order).collect()}
    for d, w in enumerate(own):
        s = 0.0
        for i in range(len(w)):
            top = min(order - 1, i)
            for k in range(top, -1, -1):
                c = count[tuple(w[i - k : i + 1])]
                if k == 0 or c >= 2:
                    s += np.log(c / (count[tuple(w[i - k : i])] if k else total)) + (top - k) * np.log(0.4)
                    break
        assert got[d].n_words == len(w) and got[d].score == pytest.approx(s / len(w) if w else 0.0), d


def test_lm_query_against_sql(spark, docs, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from rankforge.llm import registry

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_words, r.score, r.total) for r in registry.queries()["op5_lm_scoring"](spark, str(tmp_path)).collect()}
    own = duckdb.connect()
    own.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = {d: (n, s, t) for d, n, t, s in own.execute(registry.oracle_sql()["op5_lm_scoring"]).fetchall()}
    assert got.keys() == want.keys()
    assert all(got[d][0] == n and got[d][1] == pytest.approx(s, abs=2e-6) and got[d][2] == pytest.approx(t, abs=2e-4) for d, (n, s, t) in want.items())


def components(sets, percent):
    parent = {d: d for d in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in sets:
        for b in sets:
            k = len(sets[a] & sets[b])
            if a < b and k and 100 * k >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}


def shingles(t, n):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(t)]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


@pytest.mark.parametrize("tile", [512, 4])
def test_jaccard_join(spark, tile):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(80)]
    data = list(texts())
    for _ in range(40):  # a family around one text, with links above and below the bound
        own = list(base)
        for _ in range(rng.randint(0, 5)):
            own[rng.randrange(80)] = f"v{rng.randrange(8)}"
        data.append(" ".join(own))
    sets = {d: shingles(t, 4) for d, t in enumerate(data)}
    want = components(sets, 85)
    df = spark.createDataFrame([(d, t) for d, t in enumerate(data)], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.components(df, tile=tile).collect()}
    assert got == {d: (len(sets[d]), want[d]) for d in sets}


def test_overlaps():
    rng = np.random.default_rng(3)
    m = rng.random((60, 90)) < 0.5
    m[:, :5] = True
    row, column = np.nonzero(m)
    assert (jaccard_join.overlaps(row, column, 60) == np.triu(m.astype(int) @ m.T.astype(int), 1)).all()


def test_exact_dedup(docs):
    groups = {}
    for d, t in enumerate(texts()):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), d))
    want = {d: (min(g)[1], len(g), d == min(g)[1], sha(k.encode())) for k, g in groups.items() for _, d in g}
    for digest in (lambda t: F.sha2(t, 256), lambda t: F.substring(F.sha2(t, 256), 1, 1)):  # the second makes digests clash
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.dedup(docs, digest=digest, bytes_per_batch=1).collect()}
        assert got == want
    assert {r.doc_id for r in exact_dedup.one_of_each(docs).collect()} == {v[0] for v in want.values()}


def test_mixing(docs):
    docs = docs.withColumn("from", F.col("source"))
    got = mixing.mix(docs, carry=("from",)).collect()
    size = {d: len(words(t)) for d, t in enumerate(texts())}
    by = {}
    for r in got:
        assert r.size == size[r.doc_id] and 0 <= r.taken <= 2 * r.size
        by.setdefault(r["from"], []).append(r)
    names = sorted((s for s in by if s is not None)) + [None]
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}
    total = 1.5 * sum(size.values())
    cap, goal, full = {s: 2.0 * sum(r.size for r in by[s]) for s in names}, {}, set()
    while True:
        left = total - sum(cap[s] for s in full)
        goal = {s: cap[s] if s in full else left * weight[s] / sum(weight[x] for x in names if x not in full) for s in names}
        over = {s for s in names if s not in full and goal[s] > cap[s]}
        if not over:
            break
        full |= over
    for s in names:
        assert by[s][0].target == pytest.approx(goal[s]) and by[s][0].source_size == sum(r.size for r in by[s])
        assert abs(sum(r.taken for r in by[s]) - goal[s]) <= max(10, 0.01 * goal[s])
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(5), carry=("from",)).collect()), key=str)


def test_mixing_small_beside_large(spark):
    """Sources far smaller than a block of the schedule get their targets too."""
    make = lambda n: " ".join(["w"] * n)
    sizes = {"a": [1], "b": [4, 3], "c": [7] * 5, "d": [50] * 8, "e": [5000] * 80, "f": [3] * 30, None: [2]}
    rows = [(f"{s}{i}", make(n), s) for s, own in sizes.items() for i, n in enumerate(own)]
    docs = spark.createDataFrame([(i, t, s) for i, (_, t, s) in enumerate(rows)], "doc_id long, text string, source string")
    for weights in ((5.0, 2.0, 1.0), (0.001, 0.01, 0.00001, 0.002, 5.0)):
        by = {}
        for r in mixing.mix(docs, weights=weights, slots=64, carry=("source",)).collect():
            assert 0 <= r.taken <= 2 * r.size
            by.setdefault(r.source, []).append(r)
        assert {s: len(x) for s, x in by.items()} == {s: len(x) for s, x in sizes.items()}
        for s, own in by.items():
            assert sum(r.taken for r in own) == max(1, int(own[0].target + 0.5)), s
    plan = mixing.schedule(spark, mixing.targets(mixing.sizes(docs)), slots=64).collect()
    assert len({r.slot for r in plan}) == len(plan)
    for s in sizes:
        assert sorted(r.block for r in plan if r.source == s) == list(range(sum(r.source == s for r in plan)))
    kept = mixing.mixed(docs).groupBy("source").count().collect()
    assert {r.source: r["count"] for r in kept if r.source in ("a", "b", "f")} == {"a": 2, "b": 4, "f": 60}



def test_bpe_against_tiktoken(docs):
    import base64

    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in bpe.encode_decode(docs).collect()}
    for d, t in enumerate(texts()):
        ids = own.encode_ordinary(t or "")
        assert list(got[d].ids) == ids and got[d].decoded == (t or "")
        assert (got[d].n_tokens, got[d].ids_sha256, got[d].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode()))


def test_bpe_long_matches_and_cache(monkeypatch):
    import public_tokenizers

    own = bpe.Encoder(public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN)
    rng = random.Random(2)
    parts = ["".join(rng.choice("abcdeé") for _ in range(n)).encode() for n in (1, 2, 3, 17, 200, 512)] + [b"a" * 300]
    assert own.merge(parts) == [own._heap(p) for p in parts]
    monkeypatch.setattr(bpe, "CACHE", 3)
    assert [i for i, _ in own.texts(["one two three four", "five six seven"])] == [i for i, _ in bpe.Encoder(public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN).texts(["one two three four", "five six seven"])]


def test_language_id(spark):
    rng = random.Random(3)
    parts = {"aa": ["tion", "the", "ing", "er"], "bb": ["ung", "sch", "keit", "der"], "cc": ["eau", "que", "ment", "le"]}
    rows = [(i, " ".join("".join(rng.choice(parts[k]) for _ in range(3)) for _ in range(40)), k) for i in range(240) for k in [list(parts)[i % 3]]] + [(900, None, "aa"), (901, "123 !!", "aa"), (902, "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = language_id.split("doc_id", 4, 2)
    got = {r.doc_id: r for r in language_id.identify(df, language_id.learn(df, "doc_id", "text", "lang", ~held), held_out=held).collect()}
    assert all(got[i].lang_pred == k and 0.5 < got[i].score <= 1 for i, _, k in rows[:240])
    assert (got[900].lang_pred, got[901].lang_pred) == ("und", "und") and got[902].lang_pred in parts
    assert any(r.held_out for r in got.values())


def test_language_pieces_agree(monkeypatch):
    model = language_id.Model(["a", "b"], np.random.default_rng(1).normal(size=(language_id.DIMS, 2)).astype(np.float32), np.zeros(2), 1.0)
    long = ["ab cd éf " * 300, "", "x"]
    whole, ids = model.predict(long)[1], language_id.counts(long)
    monkeypatch.setattr(language_id, "STEP", 100)
    assert np.allclose(model.predict(long)[1], whole)
    assert all((a[0] == b[0]).all() and (a[1] == b[1]).all() for a, b in zip(language_id.counts(long), ids))


def test_toxicity(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows, labels = [], []
    for i in range(600):
        toxic = i % 10 == 0
        w = [word() for _ in range(60)]
        if toxic:
            for bad in ("nastyword", "foulterm", "viletalk"):
                w[rng.randrange(60)] = bad
        rows.append((i, " ".join(w)))
        if i % 2 == 0:
            labels.append((i, int(toxic)))
    df, own = spark.createDataFrame([*rows, (1000, None)], "doc_id long, text string"), spark.createDataFrame(labels + [(4, None)], "doc_id long, toxic int")
    held = language_id.split("doc_id", 3, 1)
    got = {r.doc_id: r for r in toxicity.score(df, toxicity.learn(df, own, ~held), held_out=held).collect()}
    caught = [got[i].predicted for i in range(0, 600, 10)]
    assert np.mean(caught) > 0.9 and sum(got[i].predicted for i in range(600) if i % 10) < 12
    assert all(0 <= r.score <= 1 for r in got.values()) and got[1000].predicted == 0


def _toxicity_table(spark, n, toxic=10):
    """Documents of random words of which each ``toxic``-th has three that no other has."""
    rng = random.Random(16)
    out = []
    for i in range(n):
        w = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(40)]
        if i % toxic == 0:
            w[:3] = "nastyword", "foulterm", "viletalk"
        out.append((i, " ".join(w)))
    return spark.createDataFrame(out, "doc_id long, text string")


def test_toxicity_levels_come_from_all_folds_in_every_block(spark):
    df = _toxicity_table(spark, 480)
    yes = [i for i in range(0, 480, 10) if i % 20 == 0]
    model = toxicity.learn(df, spark.createDataFrame([(i, int(i in yes)) for i in range(0, 480, 2)], "doc_id long, toxic int"), F.lit(True), block=100)
    number = {int(f): k for k, f in enumerate(model.own)}

    def entries(text):
        _, f, _ = toxicity.features(pa.array([text]))
        f = np.array([number[v] for v in f.tolist() if v in number], np.int64)
        return toxicity.counted(np.zeros(len(f), np.int64), f, len(number))[1:]

    hashed = sorted((r.h, r.doc_id, r.text) for r in df.withColumn("h", F.xxhash64("doc_id", "text")).collect())
    fitted = []
    for block in range(5):
        own = [r for r in hashed if r[1] in yes] + [r for r in hashed if r[0] % 5 == block]
        order = np.random.default_rng(5).permutation(len(own))
        parts = [entries(own[k][2]) for k in order]
        row = np.repeat(np.arange(len(own)), [len(f) for f, _ in parts])
        fitted.append(toxicity.fit(row, *(np.concatenate(v) for v in zip(*parts)), order < len(yes), len(yes) / 240, model.own))
    assert model.level == pytest.approx(np.mean([m.level for m in fitted]), abs=1e-3) and np.allclose(model.weight, np.mean([m.weight for m in fitted], axis=0), atol=1e-3)


def test_toxicity_sets_a_level_from_few_confirmed_documents(spark):
    df = _toxicity_table(spark, 300)
    for confirmed in (1, 3, 6):
        yes = list(range(0, 10 * confirmed, 10))
        model = toxicity.learn(df, spark.createDataFrame([(i, 1) for i in yes] + [(i, 0) for i in range(299, 299 - 9 * confirmed, -1) if i % 10], "doc_id long, toxic int"), F.lit(True))
        assert model.bias is not None and model.level != 0.0


def test_toxicity_trainings_side_by_side():
    """Against the loss and its gradient text by text, with texts and features that hold nothing."""
    rng = np.random.default_rng(3)
    n, k, prior = 60, 12, 0.3
    x = np.where(rng.random((n, k)) < 0.4, np.log2(1 + rng.integers(1, 4, (n, k))), 0.0).astype(np.float32)
    x[[0, 7, 59]], x[:, [0, 5, 11]] = 0, 0
    x[:, 3] = np.where(np.arange(n) % 59 > 0, 1.0, 0.0)  # nearly all
    positive, part = np.arange(n) % 3 == 0, rng.integers(0, 4, n)
    uses = np.stack([np.full(n, True), *(part != i for i in range(4))], axis=1)
    r, f = np.nonzero(x)
    w, b, s = toxicity.nnpu(r, f, x[r, f], positive, uses, prior, k, steps=20)
    for j in range(5):
        X, P = x[uses[:, j]].astype(float), positive[uses[:, j]]
        v, c = np.zeros(k), np.log(prior / (1 - prior))
        m1, m2 = np.zeros(k + 1), np.zeros(k + 1)
        for t in range(1, 21):
            z = X @ v + c
            p = 1 / (1 + np.exp(-z))
            negative = np.logaddexp(0, z)[~P].mean() - prior * np.logaddexp(0, z)[P].mean() < 0
            g = np.where(P, prior * p / P.sum(), -p / (~P).sum()) if negative else np.where(P, prior * ((p - 1) - p) / P.sum(), p / (~P).sum())
            grad = np.append(X.T @ g + 1e-2 * prior * v, g.sum())
            m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
            step = 0.05 * (1 - t / 21) * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
            v, c = v - step[:-1], c - step[-1]
        assert np.allclose(w[:, j], v, atol=1e-4) and b[j] == pytest.approx(c, abs=1e-4) and np.allclose(s[:, j], x @ v, atol=1e-3)
    lists = [rng.integers(0, 50, m) for m in (0, 1, 200, 0, 64, 65, 0)]  # longer than a piece
    table = rng.random((50, toxicity.LANES), np.float32)
    got = toxicity.Sums(np.repeat(np.arange(7), [len(a) for a in lists]), np.concatenate(lists), 7)(table)
    assert np.allclose(got, [table[a].sum(0) for a in lists], rtol=1e-4)


def test_toxicity_blocks_are_tasks_of_their_own(spark):
    df, context = _toxicity_table(spark, 480), spark.sparkContext
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(0, 480, 2)], "doc_id long, toxic int")
    context.setJobGroup("toxicity blocks", "")
    try:
        toxicity.learn(df, labels, F.lit(True), block=50)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    seen = context.statusTracker()
    stages = {s for job in seen.getJobIdsForGroup("toxicity blocks") for s in seen.getJobInfo(job).stageIds}
    assert 10 in [info.numTasks for info in map(seen.getStageInfo, stages) if info]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1203))], names=["i"])
    parts = list(toxicity.small(iter([batch, batch.slice(0, 0), batch.slice(0, 1)])))
    assert max(p.num_rows for p in parts) == 500 and [v for p in parts for v in p.column("i").to_pylist()] == [*range(1203), 0]


def test_words_split_as_bytes_do():
    column = pa.array([*texts(), "y" * (common.STEP + 5) + " z", " wide "])
    own = common.Words(column)
    assert own.n.tolist() == [len((t or "").encode().split()) for t in column.to_pylist()]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9)))
    clean = [" ".join(word() for _ in range(90)) for _ in range(60)]
    near = [" ".join([*c.split()[:-1], "end"]) for c in clean[:10]]
    junk = [" ".join(word() + "###" for _ in range(90)) for _ in range(10)]
    rows = [(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate([*clean, *clean[:10], *near, *junk])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = common.documents(spark, str(tmp_path))
    alive = []
    for name, stage in corpus_pipeline.STAGES:
        docs = common.materialize(stage(spark, docs, str(tmp_path)))
        alive.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert alive[0] == set(range(80)) and alive[1] == set(range(60)) | set(range(70, 80)) and alive[2] == set(range(60)) and alive[3] <= alive[2]
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    own = bpe.encoder(*(lambda P: (P.path(bpe.VOCABULARY), P.PATTERN))(__import__("public_tokenizers")))
    text = {r[0]: r[1] for r in rows}
    assert all(r.ids_sha256 == sha(next(own.texts([text[r.doc_id]]))[0].encode()) for r in final)
    assert 1.3 < sum(len(words(text[r.doc_id])) for r in final) / sum(len(words(t)) for t in clean) < 1.7


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Nulls in every column, empty texts, repeated rows and ids, and no rows at all."""
    import corpus_pipeline

    rng = random.Random(12)
    prose = lambda: " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(3, 8))) for _ in range(90))
    a, b, c = prose(), prose(), prose()
    rows = [(None, a, None, None, None), (None, a, None, None, None), (1, b, "en", "s", 1), (1, b, "en", "s", 1), (1, c, None, None, 2), (2, None, "en", "s", 0), (3, "", "en", "s", 0), (4, b + " ", None, "s", 3)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for own, want in ((rows, {(None, a), (1, c), (4, b + " ")}), ([], set())):
        docs = spark.createDataFrame(own, schema)
        for name, stage in corpus_pipeline.STAGES[:3]:
            docs = stage(spark, docs, "")
            assert docs.columns == schema.replace(" long", "").replace(" string", "").split(", "), name
        assert {(r.doc_id, r.text) for r in docs.collect()} == want and docs.count() == len(want)
        docs = corpus_pipeline.mix(spark, docs, "")
        assert {(r.doc_id, r.text) for r in docs.collect()} <= want
        assert corpus_pipeline.encode(spark, docs, "").count() == docs.count()
