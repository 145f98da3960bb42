"""Mixing sources to target weights by a low-discrepancy schedule (op 6).

Sizes are words. Each source's documents, in the order of a hash of their ids, form a stream of tokens that is cut
into equal blocks and passes at most ``CAP`` times. A source's blocks are as long as ``SLOTS`` of them for all targets
together, but no longer than a part in ``FINE`` of its own target, so small sources have finer blocks, and than ``LONGEST``
words, from where on their number grows with the corpus; the last block ends where the target does. A schedule gives each slot to a source: slot n has the point ``frac(n * golden ratio)``, mapped
through the cumulative numbers of blocks, so that every stretch of slots holds each source in its share. A source's
slots are ranked, and slot rank r takes block r of its stream; points go on until every source has its number of blocks,
so each is taken up to its target, rounded to words (one at least).

The place of each document in its stream is a running sum in two steps, within ranges of hashes, of some ``ROWS`` rows, and
over the ranges, so that a source with a third of all rows is no task of its own; ties in hash and id go by size.

Cases. A null text has size 0; a null source is a source of its own, last in order. Documents of size 0 take nothing.
Rows of equal id are documents of their own. With no words at all, targets and taken are 0. An empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, WORD, documents, materialize

WEIGHTS, SHARE, CAP = (5.0, 2.0, 1.0), 1.5, 2
SLOTS, FINE, LONGEST, CELLS, ROWS = 1 << 18, 64, 1 << 20, 4096, 1 << 16
GOLDEN = 0.6180339887498949


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, and a hash of 60 bits that shuffles, the same in any engine with md5; written, as several steps read it."""
    return materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.conv(F.substring(F.md5(F.concat(F.lit("mixing-"), F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long").alias("h"), *carry))


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """source, source_size, target: weights in turn by source name; what exceeds a source's cap is shared again by weight.

    Sources fill in the order of cap / weight; the level is that of the first number of full ones that leaves no other above its cap.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1)
    own = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("w", w).withColumn("cap", cap * F.col("source_size").cast("double"))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything) * F.lit(share)
    # the level if exactly the sources before this one are full
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    fits = own.withColumn("level", level)
    filling = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    chosen = F.first(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("level")), ignorenulls=True).over(filling)
    return fits.withColumn("chosen", chosen).select("source", "source_size", F.coalesce(F.least("cap", F.col("chosen") * F.col("w")), F.col("cap")).alias("target"))


def blocks(goal: DataFrame, slots: int = SLOTS) -> DataFrame:
    """goal with words, the target in whole words; tokens, the block length of the source; n, its number of blocks."""
    total = goal.agg(F.sum("target")).first()[0] or 0.0
    tokens = min(LONGEST, max(1, int(total // slots) + (total % slots > 0)))
    words = F.when(F.col("target") > 0, F.greatest(F.lit(1), F.round("target"))).otherwise(0).cast("long")
    own = goal.withColumn("words", words).withColumn("tokens", F.greatest(F.lit(1), F.least(F.lit(tokens), F.expr(f"words div {FINE}"))).cast("long"))
    return own.withColumn("n", F.expr("(words + tokens - 1) div tokens"))


def schedule(spark: SparkSession, goal: DataFrame, slots: int = SLOTS) -> DataFrame:
    """slot, source, block, tokens: slot by slot the source, the block of its stream, and the source's block length."""
    goal = blocks(goal, slots)
    n = goal.agg(F.sum("n")).first()[0] or 0
    whole = Window.orderBy(F.col("source").asc_nulls_last())
    by_name = whole.rowsBetween(Window.unboundedPreceding, 0)
    own = goal.filter("n > 0").withColumn("high", F.sum("n").over(by_name) / F.lit(float(n or 1)))
    own = own.withColumn("low", F.coalesce(F.lag("high").over(whole), F.lit(0.0))).withColumn("high", F.when(F.lead("high").over(whole).isNull(), 2.0).otherwise(F.col("high")))
    # a range join by cells: a source stands in all cells that its range touches
    cells = own.select("source", "tokens", "n", "low", "high", F.explode(F.sequence(F.floor(F.col("low") * CELLS), F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1)))).alias("cell"))
    point = F.col("slot") * F.lit(GOLDEN) - F.floor(F.col("slot") * F.lit(GOLDEN))
    # m golden-ratio points leave no gap over 1.9 / m, so of 2 n points each block's share of the line gets one
    slot = spark.range(0, 2 * n).withColumnRenamed("id", "slot").withColumn("point", point).withColumn("at", F.floor(F.col("point") * CELLS))
    own = slot.join(cells, F.col("at") == F.col("cell")).filter("low <= point AND point < high").select("slot", "source", "tokens", "n")
    rank = F.row_number().over(Window.partitionBy("source").orderBy("slot")) - 1
    return own.withColumn("block", rank.cast("long")).filter("block < n").select("slot", "source", "block", "tokens")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, slots: int = SLOTS, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken (and the carried columns): words the mix takes of each document, repeats counted."""
    spark, names, carried = docs.sparkSession, carry, tuple(f"_c{i}" for i in range(len(carry)))  # free of clashes
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"), *[F.col(c).alias(n) for c, n in zip(carry, carried, strict=True)])
    carry = carried
    sized = sizes(docs, carry=carry)
    goal = materialize(targets(sized, weights, share, cap))
    plan = schedule(spark, goal, slots)
    cut = blocks(goal, slots)

    def same(a: str, b: str):
        return F.col(a).eqNullSafe(F.col(b))

    # ranges of hashes, as many as the rows ask for
    bits = min(24, max(8, (sized.count() // ROWS).bit_length()))
    ranged = sized.withColumn("r", F.shiftright("h", 60 - bits))
    sums = ranged.groupBy("source", "r").agg(F.sum("size").alias("n"))
    start = sums.select(F.col("source").alias("s_source"), F.col("r").alias("s_r"), F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "r").orderBy("h", "doc_id", "size", *carry).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("in_range", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(start, same("source", "s_source") & same("r", "s_r")).withColumn("at", F.col("base") + F.col("in_range"))
    placed = placed.join(cut.select(F.col("source").alias("g_source"), "source_size", "target", "words", "tokens"), same("source", "g_source"))
    own = placed.select("doc_id", "source", "size", "source_size", "target", "words", "tokens", "at", *carry)
    # parts of documents in blocks, over all passes of the stream, up to the target; no block beyond it
    passes = F.explode(F.sequence(F.lit(0), F.lit(cap - 1)))
    key = ["doc_id", "source", "size", "source_size", "target", "at", *carry]
    spans = own.filter("size > 0").select(*key, "words", "tokens", passes.alias("pass")).withColumn("from", F.col("at") + F.col("pass") * F.col("source_size")).withColumn("to", F.col("from") + F.col("size"))
    held = spans.withColumn("to", F.least("to", "words"))
    parts = held.withColumn("block", F.explode(F.when(F.col("from") < F.col("to"), F.expr("sequence(`from` div tokens, (`to` - 1) div tokens)")).otherwise(F.array(F.lit(None).cast("long")))))
    length = F.least("to", (F.col("block") + 1) * F.col("tokens")) - F.greatest("from", F.col("block") * F.col("tokens"))
    parts = parts.withColumn("length", length)
    slot = plan.select(F.col("source").alias("p_source"), F.col("block").alias("p_block"))
    taken = parts.join(slot, same("source", "p_source") & (F.col("block") == F.col("p_block")), "left").groupBy(*key).agg(F.coalesce(F.sum(F.when(F.col("p_block").isNotNull(), F.col("length"))), F.lit(0)).alias("taken"))
    none = own.filter("size = 0").select(*key, F.lit(0).cast("long").alias("taken"))
    return taken.unionByName(none).select("doc_id", *[F.col(n).alias(c) for n, c in zip(carry, names, strict=True)], "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Rows of docs, each as often as the mix takes its words (rounded to whole documents): 0 to ``CAP`` times.

    Columns of docs may have any names. Rows without words are not taken; rows alike in id, text and source share what they get.
    """
    columns, names = docs.columns, [f"_c{i}" for i in range(len(docs.columns))]  # free of clashes
    own = docs.toDF(*names)
    id_, text, source = (names[columns.index(c)] for c in (id_col, text_col, source_col))
    own = own.withColumn("_key", F.xxhash64(F.col(text).cast("string"), F.col(source).cast("string")))
    plan = mix(own, id_, text, source, carry=("_key",))
    plan = plan.filter("size > 0").groupBy(F.col("doc_id").alias("_id"), F.col("_key").alias("_k")).agg(F.floor(F.avg("taken") / F.max("size") + 0.5).cast("int").alias("_copies")).filter("_copies > 0")
    taken = own.join(plan, F.col(id_).cast("long").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_k")))
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*names).toDF(*columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).withColumn("target", F.round("target", 6))


#: The same without a schedule, which decides the order of slots and not what is taken: of each source's stream, its target in whole words.
SQL = rf"""
WITH d AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE}+'), lambda x: x <> ''))::BIGINT AS size, ('0x' || substr(md5('mixing-' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS own, {list(WEIGHTS)!r}[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)})::INT + 1]::DOUBLE AS w FROM d GROUP BY source),
c AS (SELECT source, own, w, {CAP} * own AS cap, row_number() OVER o AS k, {SHARE}::DOUBLE * sum(own) OVER () - coalesce(sum({CAP} * own) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_w FROM s WINDOW o AS (ORDER BY {CAP} * own / w, source NULLS LAST)),
f AS (SELECT rest / left_w AS level FROM c WHERE rest / left_w <= cap / w ORDER BY k LIMIT 1),
g AS (SELECT source, own, least(cap, coalesce((SELECT level FROM f) * w, cap)) AS target FROM c),
o AS (SELECT d.doc_id, size, own::BIGINT AS source_size, target, CASE WHEN target > 0 THEN greatest(1, round(target)) ELSE 0 END::BIGINT AS words,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, round(target, 6) AS target, list_sum(list_transform(range({CAP}), lambda k: greatest(0, least(place + k * source_size + size, words) - place - k * source_size)))::BIGINT AS taken FROM o
"""
