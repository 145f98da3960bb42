"""Class balancing: even spread over groups, then sampling within a group. Draws are md5-hashed, so reruns agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import neighbours

#: Ranges of ids within a class that are numbered apart, at least; rows of a range that more ranges are made for.
RANGES, ROWS, MOST = 32, 1 << 20, 8192
METHODS = ("smote", "nearmiss1", "nearmiss2", "baggingundersampling", "none")


def draw(*parts) -> Column:
    """A number in 0 .. 2**32 - 1 from the parts, the same in any engine with md5."""
    key = F.concat_ws("-", *[F.lit(str(p)) if isinstance(p, int) else (F.lit(p.strip("'")) if p.startswith("'") else F.col(p).cast("string")) for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")


def in_ranges(df: DataFrame, id_col: str) -> DataFrame:
    """Adds _range: about equal ranges of ids in their order, as many as the rows ask for, for running numbers in two steps."""
    n = min(MOST, max(RANGES, df.count() // ROWS))
    top = max(2, int(n**0.5))
    cuts = sorted(set(df.select(F.percentile_approx(id_col, [k / n for k in range(1, n)], max(1000, 4 * n))).first()[0] or []))
    if not cuts:
        return df.withColumn("_range", F.lit(0))
    # found in two steps: among every top-th cut, then among those up to the next
    count = lambda values: F.size(F.filter(values, lambda c: c < F.col(id_col)))
    coarse = cuts[::top]
    fine = [cuts[k : k + top] for k in range(0, len(cuts), top)]
    block = count(F.array(*map(F.lit, coarse)))
    inside = count(F.element_at(F.array(*[F.array(*map(F.lit, own)) for own in fine]), F.greatest(block, F.lit(1))))
    return df.withColumn("_range", F.when(block == 0, 0).otherwise((block - 1) * top + inside))


def spread_classes(df: DataFrame, groups: int, id_col: str, label: str = "label") -> DataFrame:
    """Adds p in 0 .. groups - 1: each class dealt round-robin in the order of ids (numbers).

    Running numbers are made in two steps, within ``RANGES`` ranges of ids and over the ranges, so that a class with
    most of the rows is not one task's work.
    """
    if not 1 <= groups <= 32767:
        raise ValueError("groups must be 1 to 32767")
    if groups == 1:
        return df.withColumn("p", F.lit(0))
    own = in_ranges(df, id_col)
    size = own.groupBy(label, "_range").agg(F.count("*").alias("_n"))
    before = size.select(F.col(label).alias("_label"), F.col("_range").alias("_at"), F.coalesce(F.sum("_n").over(Window.partitionBy(label).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy(label, "_range").orderBy(id_col)) - 1
    placed = own.withColumn("_number", number).join(before, F.col(label).eqNullSafe(F.col("_label")) & (F.col("_range") == F.col("_at")))
    return placed.withColumn("p", F.pmod(F.col("_before") + F.col("_number"), F.lit(groups)).cast("int")).select(*[df[c] for c in df.columns], "p")


def minority(df: DataFrame, keys: tuple[str, ...] = ("p",), label: str = "label") -> DataFrame:
    """keys, label, n of the class with fewest rows (ties: the smallest label) in each group."""
    counts = df.groupBy(*keys, label).agg(F.count("*").alias("n"))
    return counts.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("n", label))).filter("_r = 1").drop("_r")


def _marked(df: DataFrame, keys: tuple[str, ...], label: str) -> DataFrame:
    few = minority(df, keys, label).select(*keys, F.col(label).alias("_min"), F.col("n").alias("n_min"))
    return df.join(few, list(keys)).withColumn("is_minority", F.col(label) == F.col("_min")).drop("_min")


def bagging(df: DataFrame, bags: int, id_col: str, seed: int = 5341, percentage: int = 100, keys: tuple[str, ...] = ("p",), label: str = "label") -> DataFrame:
    """keys, bag, draw, id, is_minority: all of the minority and percentage/100 (whole) times as many draws of the others, with replacement.

    A group of one class passes through. The others are numbered in ranges of ids, so that a group's majority is not one
    task's work.
    """
    own = _marked(df, keys, label)
    bag = F.explode(F.sequence(F.lit(0), F.lit(bags - 1))).alias("bag")
    few = own.filter("is_minority").select(*keys, bag, F.concat(F.lit("m"), F.col(id_col).cast("string")).alias("draw"), F.col(id_col).alias("id"), "is_minority")
    others = in_ranges(own.filter("NOT is_minority"), id_col)
    sizes = others.groupBy(*keys, "_range").agg(F.count("*").alias("_c"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_c").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    others = others.join(before, [*keys, "_range"]).withColumn("_k", F.col("_before") + F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(id_col)) - 1)
    size = others.groupBy(*keys).agg(F.first("n_min").alias("n_min"), F.count("*").alias("_m"))
    picks = size.select(*keys, "_m", bag, F.explode(F.sequence(F.lit(1), F.col("n_min") * (percentage // 100))).alias("i")).withColumn("_k", draw(seed, *keys, "bag", "i") % F.col("_m"))
    drawn = picks.join(others.select(*keys, "_k", F.col(id_col).alias("id"), "is_minority"), [*keys, "_k"])
    return few.unionByName(drawn.select(*keys, "bag", F.concat(F.lit("o"), F.col("i").cast("string")).alias("draw"), "id", "is_minority"))


def near_miss(df: DataFrame, k: int, id_col: str, furthest: bool = False, percentage: int = 100, keys: tuple[str, ...] = ("p",), label: str = "label", blocks: int | None = None, nominal: list[bool] | str | None = None) -> DataFrame:
    """keys, id, is_minority, score: all of the minority, and of the others those whose k nearest (furthest) minority rows are closest in sum (Manhattan)."""
    own = _marked(df, keys, label).withColumn("draw", F.col(id_col)).withColumn("id", F.col(id_col))
    few = own.filter("is_minority")
    found = neighbours.nearest(own.filter("NOT is_minority"), few, k, "manhattan", keys, furthest=furthest, blocks=blocks, nominal=nominal)
    score = found.groupBy(*keys, "id").agg(F.round(F.sum("dist"), 6).alias("score"))
    size = minority(df, keys, label).select(*keys, "n")
    kept = score.join(size, list(keys)).withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("score", "id"))).filter(F.col("_r") <= F.floor(F.col("n") * percentage / 100))
    return kept.select(*keys, "id", F.lit(False).alias("is_minority"), "score").unionByName(few.select(*keys, "id", F.lit(True).alias("is_minority"), F.lit(None).cast("double").alias("score")))


def smote(df: DataFrame, k: int, id_col: str, seed: int = 5341, percentage: int = 100, keys: tuple[str, ...] = ("p",), label: str = "label", gap: float | None = None, blocks: int | None = None, nominal: list[bool] | str | None = None, gap_per_row: bool = False) -> DataFrame:
    """keys, id, i, n_id, label, features of synthetic rows: each minority row moved by one constant gap toward a drawn one of its k nearest.

    gap: None draws one number from the seed for all rows; gap_per_row: one for each synthetic row. nominal: flags, or a
    column that has them (see prep.nominal_flags); a nominal feature takes either row's value by a draw.
    """
    own = _marked(df, keys, label).filter("is_minority").withColumn("draw", F.col(id_col)).withColumn("id", F.col(id_col))
    found = neighbours.nearest(own, own, k, "euclidean", keys, blocks=blocks, nominal=nominal)
    reach = found.groupBy(*keys, "id").agg(F.max("rank").alias("m"))
    wish = reach.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(percentage // 100)))).withColumn("rank", (draw(seed, *keys, "id", "i") % F.col("m") + 1).cast("int"))
    pick = wish.join(found.select(*keys, "id", "rank", "n_id"), [*keys, "id", "rank"])
    flags = F.col(nominal) if isinstance(nominal, str) else F.array(*map(F.lit, nominal)) if nominal else F.lit(None)
    a = own.select(*keys, "id", label, F.col("features").alias("fa"), flags.alias("_flags"))
    b = own.select(*keys, F.col("id").alias("n_id"), F.col("features").alias("fb"))
    step = F.lit(gap) if gap is not None else draw(seed, "'gap'", *((*keys, "id", "i") if gap_per_row else ())) / F.lit(4294967296.0)
    moved = F.zip_with("fa", "fb", lambda x, y: x + step * (y - x))
    if nominal:
        coin = lambda j: F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("id").cast("string"), F.col("i").cast("string"), j.cast("string"))), 1, 8), 16, 10).cast("bigint") % 2 == 0
        moved = F.transform(moved, lambda v, j: F.when(F.get(F.col("_flags"), j), F.when(coin(j), F.get(F.col("fa"), j)).otherwise(F.get(F.col("fb"), j))).otherwise(v))
    return pick.join(a, [*keys, "id"]).join(b, [*keys, "n_id"]).select(*keys, "id", "i", "n_id", label, moved.alias("features"))
