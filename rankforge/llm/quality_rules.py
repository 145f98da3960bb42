"""Quality rules as weak supervision (op 2), native: DataFrame and SQL functions only.

A rule looks at one statistic of a text and votes good (1) where it is as in ordinary prose, bad (0) where it is far from
that, and abstains (-) between. No rule decides: expectation-maximisation estimates from the votes alone, without labels,
the prior of good and how often good and bad documents get each vote of each rule (its accuracies; rules are taken as
independent given quality), and a document is kept if its posterior probability of good reaches ``KEEP``. So a bad vote
of a rule that often errs, against good votes of others, is overruled, and several weak signs together reject.

Every document's votes make one of at most ``3 ** len(RULES)`` patterns, so all that expectation-maximisation needs is how
often each pattern occurs: a table whose size does not grow with the corpus, folded into one row and iterated by
``aggregate``. The posterior, by pattern, joins back to the documents.

Cases. A null text has no words: all counts are 0 and it fails the base rule. Rows of equal id are judged apart. An
empty table gives an empty result. Extra columns are not read; ``filter_docs`` carries all columns along, whatever
their names. Very long texts cost in proportion, but for windows of three words that repeat, whose words are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, documents, materialize

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
PRIOR, ROUNDS, KEEP = 0.9, 25, 0.5
#: name, SQL condition of a vote for good, of a vote for bad. Percentages of words, lines or characters of words.
RULES = (
    ("length", "n_words >= 80", "n_words < 20"),
    ("symbols", "p_symbols <= 5", "p_symbols >= 25"),
    ("symbol_runs", "p_runs <= 5", "p_runs >= 20"),
    ("letters", "p_letters >= 92", "p_letters <= 80"),
    ("repeat_words", "p_repeat <= 12", "p_repeat >= 40"),
    ("dup_lines", "p_lines <= 10", "p_lines >= 30"),
    ("marks", "p_marks <= 3", "p_marks >= 25"),
    ("upper", "p_upper <= 6", "p_upper >= 30"),
    ("word_length", "p_long <= 1.2", "p_long >= 2.2"),
    ("distinct", "p_distinct >= 55", "p_distinct <= 25"),
)
#: What the rules speak of.
SHARES = {
    "p_symbols": "100 * n_symbols / greatest(n_words, 1)",
    "p_runs": "100 * n_symbol_runs / greatest(n_words, 1)",
    "p_letters": "100 * n_letters / greatest(word_chars, 1)",
    "p_repeat": "100 * n_repeat_words / greatest(n_words, 1)",
    "p_lines": "100 * n_dup_lines / greatest(n_lines, 1)",
    "p_marks": "100 * n_marks / greatest(n_words, 1)",
    "p_upper": "100 * n_upper / greatest(word_chars, 1)",
    "p_long": "abs(word_chars / greatest(n_words, 1) - 5.2)",
    "p_distinct": "100 * n_distinct / greatest(n_words, 1)",
}
#: What no letter is, of ASCII.
NO_LETTERS = "0123456789!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~ \t\n\x0b\x0c\r"
#: First guesses of how often a good and a bad document get the votes 1, 0 and - from a rule.
FIRST = ((0.85, 0.005, 0.145), (0.45, 0.3, 0.25))
#: Votes that each estimate is smoothed by, in the proportions of its first guess.
WEIGHT = 2.0


def let(value: Column, body) -> Column:
    """body(value) with value computed once for each row, also where body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _without(text: Column, characters: str) -> Column:
    return F.char_length(F.translate(text, characters, ""))


def _repeated(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more. Most texts have none, which distinct hashes prove; windows themselves are compared in the others."""

    def hashes(w: Column) -> Column:
        return F.zip_with(F.zip_with(w, F.slice(w, 2, F.size(w)), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), F.slice(w, 3, F.size(w)), lambda p, c: F.when(c.isNotNull(), F.xxhash64(p["a"], p["b"], c)))

    def count(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("g"), i.alias("i")))
        # equal windows are neighbours once sorted
        pairs = let(F.array_sort(grams), lambda s: F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s)), lambda a, b: F.when(a["g"] == b["g"], F.array(a["i"], b["i"]))))
        places = F.array_sort(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))
        # a window adds the words that the one before it does not cover
        return F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])

    # of n words, the last two begin no window: n - 2 hashes and a null
    return let(words, lambda w: F.when(F.size(F.array_distinct(hashes(w))) < F.size(w) - 1, count(w)).otherwise(0)).cast("long")


def statistics(docs: DataFrame, text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """The carried columns and the statistics that base rule and rules use."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    names = [f"_c{i}" for i in range(len(carry))]  # free of clashes
    own = docs.select(*[F.col(c).alias(n) for c, n in zip(carry, names, strict=True)], text.alias("_t"), F.filter(F.split(text, SPACE + "+"), lambda x: x != "").alias("_w"))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return own.select(
        *[F.col(n).alias(c) for c, n in zip(carry, names, strict=True)],
        F.size("_w").cast("long").alias("n_words"),
        _without(F.col("_t"), " \t\n\x0b\x0c\r").cast("long").alias("word_chars"),
        (F.char_length("_t") - _without(F.col("_t"), "#*$%&|<>")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.when(F.size("_w") >= 3, _repeated(F.col("_w"))).otherwise(0).cast("long").alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.char_length("_t") - F.char_length(F.replace(F.col("_t"), F.lit("!"), F.lit("")))).cast("long").alias("n_marks"),
        F.regexp_count("_t", F.lit("[A-Z]")).cast("long").alias("n_upper"),
        F.size(F.array_distinct("_w")).cast("long").alias("n_distinct"),
        F.regexp_count("_t", F.lit("[#*$%&|<>]+")).cast("long").alias("n_symbol_runs"),
        _without(F.col("_t"), NO_LETTERS).cast("long").alias("n_letters"),
    )


def votes() -> Column:
    """One character for each rule: 1 good, 0 bad, - abstains."""

    def about(condition: str) -> Column:
        for name, share in SHARES.items():
            condition = condition.replace(name, f"({share})")
        return F.expr(condition)

    return F.concat(*[F.when(about(bad), "0").when(about(good), "1").otherwise("-") for _, good, bad in RULES])


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def posteriors(judged: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """votes, quality (posterior of good), prior and by_rule (rates of the votes 1, 0, - among good, then among bad), for each pattern of votes that occurs."""
    m = len(RULES)
    guess = [FIRST for _ in RULES]
    patterns = judged.groupBy("votes").agg(F.count("*").cast("double").alias("c")).agg(F.sort_array(F.collect_list(F.struct("votes", "c"))).alias("p"))

    def good(v: Column, model: Column) -> Column:
        odds = F.log(model["prior"] / (1 - model["prior"]))
        for j in range(m):
            at = F.instr(F.lit("10-"), F.substring(v, j + 1, 1)) - 1
            own = F.get(model["rates"], F.lit(j))
            odds = odds + F.log(F.get(own, at) / F.get(own, at + 3))
        return 1 / (1 + F.exp(-odds))

    def step(model: Column, patterns: Column) -> Column:
        def update(q: Column) -> Column:
            def total(of) -> Column:
                return F.aggregate(q, F.lit(0.0), lambda a, x: a + of(x))

            n_good, n_bad = total(lambda x: x["c"] * x["g"]), total(lambda x: x["c"] * (1 - x["g"]))

            def rates(j: int) -> Column:
                cells = []
                for side, n, share in ((0, n_good, lambda x: x["g"]), (1, n_bad, lambda x: 1 - x["g"])):
                    for k, vote in enumerate("10-"):
                        got = total(lambda x, vote=vote, share=share: F.when(F.substring(x["votes"], j + 1, 1) == vote, x["c"] * share(x)).otherwise(0.0))
                        cells.append((got + WEIGHT * guess[j][side][k] + 1e-6) / (n + WEIGHT + 3e-6))
                return F.array(*cells)

            return F.struct(((n_good + WEIGHT * PRIOR) / (n_good + n_bad + WEIGHT)).alias("prior"), F.array(*[rates(j) for j in range(m)]).alias("rates"))

        return let(F.transform(patterns, lambda x: F.struct(x["votes"].alias("votes"), x["c"].alias("c"), good(x["votes"], model).alias("g"))), update)

    first = F.struct(F.lit(PRIOR).alias("prior"), F.array(*[F.array(*[F.lit(x + 1e-6) for side in g for x in side]) for g in guess]).alias("rates"))
    fitted = patterns.select("p", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first, lambda model, _: step(model, F.col("p"))).alias("model"))
    return fitted.select(F.explode("p").alias("x"), "model").select(F.col("x.votes").alias("votes"), good(F.col("x.votes"), F.col("model")).alias("quality"), F.col("model.prior").alias("prior"), F.col("model.rates").alias("by_rule"))


def judge(docs: DataFrame, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), keep: float = KEEP) -> DataFrame:
    """The carried columns, statistics, votes, quality, base_failed and kept; statistics are computed once and written."""
    judged = materialize(statistics(docs, text_col, carry).withColumns({"votes": votes(), "base_failed": base_failed()}))
    # at most 3 ** rules rows of a few bytes
    by_pattern = F.broadcast(posteriors(judged).select("votes", "quality"))
    return judged.join(by_pattern, "votes").withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= keep))


def filter_docs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows that are kept, with the columns of docs."""
    columns = docs.columns
    names = [f"_c{i}" for i in range(len(columns))]  # free of clashes with the statistics
    own = docs.toDF(*names)
    return judge(own, names[columns.index(text_col)], tuple(names)).filter("kept").select(*names).toDF(*columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 6).alias("quality"))


def _sql() -> str:
    """The same in SQL: statistics of a text, votes, and expectation-maximisation as a recursion over one row."""

    def about(condition: str) -> str:
        for name, share in SHARES.items():
            condition = condition.replace(name, f"({share})")
        return condition

    pattern = " || ".join(f"CASE WHEN {about(bad)} THEN '0' WHEN {about(good)} THEN '1' ELSE '-' END" for _, good, bad in RULES)
    m, quote = len(RULES), lambda text: text.replace("'", "''")
    guess = [f"{x}::DOUBLE" for side in FIRST for x in side]
    first = "[" + ", ".join(["[" + ", ".join(f"{x} + 1e-6" for x in guess) + "]"] * m) + "]"
    good = lambda v: f"1 / (1 + exp(-(ln(prior / (1 - prior)) + list_sum(list_transform(range(1, {m + 1}), lambda j: ln(rates[j][instr('10-', {v}[j])] / rates[j][instr('10-', {v}[j]) + 3]))))))"  # noqa: E731
    cell = lambda side, k: f"(list_sum(list_transform(range(1, len(v) + 1), lambda i: CASE WHEN v[i][j] = '{'10-'[k]}' THEN c[i] * {'g[i]' if side == 0 else '(1 - g[i])'} ELSE 0 END)) + {WEIGHT} * {guess[3 * side + k]} + 1e-6) / ({'n_good' if side == 0 else 'n_bad'} + {WEIGHT} + 3e-6)"  # noqa: E731
    cells = ", ".join(cell(side, k) for side in (0, 1) for k in range(3))
    return rf"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE}+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda k: array_to_string(w[k:k + 2], ' '))) AS g FROM t WHERE len(w) > 2),
q AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
b AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ 	-]')) AS lines FROM t),
s AS (SELECT b.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines, length(t) - length(replace(t, '!', '')) AS n_marks,
  length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS n_upper, len(list_distinct(w)) AS n_distinct, len(regexp_extract_all(t, '[#*$%&|<>]+')) AS n_symbol_runs,
  length(translate(array_to_string(w, ''), '{quote(NO_LETTERS.rstrip(chr(13) + chr(12) + chr(11) + chr(10) + chr(9) + ' '))}', '')) AS n_letters FROM b LEFT JOIN q ON q.doc_id = b.doc_id),
j AS (SELECT *, {pattern} AS votes, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM s),
p AS (SELECT list(votes ORDER BY votes) AS v, list(c ORDER BY votes) AS c FROM (SELECT votes, count(*)::DOUBLE AS c FROM j GROUP BY votes)),
em AS (SELECT 0 AS k, {PRIOR}::DOUBLE AS prior, {first} AS rates UNION ALL
  SELECT k + 1, (n_good + {WEIGHT} * {PRIOR}) / (n_good + n_bad + {WEIGHT}), list_transform(range({m}), lambda z: list_transform([z + 1], lambda j: [{cells}])[1]) FROM (
    SELECT *, list_sum(list_transform(range(1, len(v) + 1), lambda i: c[i] * g[i])) AS n_good, list_sum(list_transform(range(1, len(v) + 1), lambda i: c[i] * (1 - g[i]))) AS n_bad FROM (
      SELECT k, v, c, list_transform(v, lambda x: {good('x')}) AS g FROM em, p WHERE k < {ROUNDS}))),
post AS (SELECT unnest(v) AS votes, unnest(list_transform(v, lambda x: {good('x')})) AS quality FROM em, p WHERE k = {ROUNDS})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND quality >= {KEEP} AS kept, round(quality, 6) AS quality FROM j JOIN post ON j.votes = post.votes
"""


SQL = _sql()
