"""Feature preparation. Wide form: ``features`` array of doubles; long form: id, label, f, v."""

from __future__ import annotations

from pyspark.ml.feature import QuantileDiscretizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def assemble(df: DataFrame, columns: list[str], label: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """carried columns, features, label. Null features are errors: a row with one raises."""
    own = F.array(*[F.col(c).cast("double") for c in columns])
    checked = F.when(F.exists(own, lambda x: x.isNull()), F.raise_error(F.lit("null feature"))).otherwise(own)
    return df.select(*carry, checked.alias("features"), F.col(label).alias("label"))


def label_index(df: DataFrame, label: str = "label") -> DataFrame:
    """value, n, idx: labels by falling frequency, then by value; the most frequent is 0.0."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("value")).agg(F.count("*").alias("n"))
    return counts.withColumn("idx", (F.row_number().over(Window.orderBy(F.desc("n"), "value")) - 1).cast("double"))


def index_labels(df: DataFrame, label: str = "label") -> DataFrame:
    index = label_index(df, label).select(F.col("value").alias("_v"), "idx")
    return df.join(index, F.col(label) == F.col("_v")).drop("_v", label).withColumnRenamed("idx", label)


def to_long(df: DataFrame, keys: tuple[str, ...], features: str = "features") -> DataFrame:
    return df.select(*keys, F.posexplode(features).alias("f", "x")).select(*keys, "f", F.col("x").cast("double").alias("v"))


def minmax(long: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys), f, mn, mx; aggregated before it is shuffled."""
    return long.groupBy(*keys, "f").agg(F.min("v").alias("mn"), F.max("v").alias("mx"))


def scaled(v: Column, mn: Column, mx: Column, nan_to_zero: bool = True) -> Column:
    """(v - mn) / (mx - mn); a constant feature is 0.5; NaN becomes 0 or stays."""
    out = F.when(mn == mx, F.lit(0.5)).otherwise((v - mn) / F.nullif(mx - mn, F.lit(0.0)))
    return F.when(F.isnan(v), F.lit(0.0) if nan_to_zero else v).otherwise(out)


def scale(long: DataFrame, bounds: DataFrame, nan_to_zero: bool = True) -> DataFrame:
    """v scaled by the bounds of its feature (a row for each feature; the planner broadcasts it where small)."""
    return long.join(bounds, "f").withColumn("v", scaled(F.col("v"), F.col("mn"), F.col("mx"), nan_to_zero)).drop("mn", "mx")


def bin_of(v: Column, mn: Column, mx: Column, bins: int) -> Column:
    """Equal-width bin from 0: mn + b w <= v < mn + (b + 1) w, the upper end in the last; a constant feature is in bin 0."""
    w = (mx - mn) / F.lit(float(bins))
    k = F.floor((v - mn) / F.nullif(w, F.lit(0.0)))
    # rounding may put a value a bin off its own edges
    k = k + F.when(v >= mn + (k + 1) * w, 1).otherwise(0) - F.when(v < mn + k * w, 1).otherwise(0)
    return F.when(mn == mx, F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(k, F.lit(bins - 1)))).cast("int")


def discretise(long: DataFrame, bins: int = 10, bounds: DataFrame | None = None, low: float = 0.0, high: float = 1.0, strict: bool = False) -> DataFrame:
    """Adds ``bin``. Without bounds, of data scaled to [low, high]. strict: a value below its feature's minimum raises."""
    own = long.join(bounds, "f") if bounds is not None else long.withColumns({"mn": F.lit(low), "mx": F.lit(high)})
    out = bin_of(F.col("v"), F.col("mn"), F.col("mx"), bins)
    if strict:
        out = F.when(F.col("v") < F.col("mn"), F.raise_error(F.lit("value below minimum")).cast("int")).otherwise(out)
    return own.withColumn("bin", out).drop("mn", "mx")


def prepare(df: DataFrame, columns: list[str], label: str, carry: tuple[str, ...] = (), low: float = 0.0, high: float = 1.0) -> DataFrame:
    """carried columns, features scaled to [low, high] by their bounds over all rows, label index: assembly, scaling and indexing as one plan.

    A constant feature becomes the middle of the range. Bounds are one row with an entry for each feature.
    """
    own = index_labels(assemble(df, columns, label, carry))
    bounds = minmax(to_long(own, ())).agg(F.array_sort(F.collect_list(F.struct("f", "mn", "mx"))).alias("_b"))
    scaled_ = F.zip_with("features", "_b", lambda v, b: F.lit(low) + F.lit(high - low) * scaled(v, b["mn"], b["mx"], nan_to_zero=False))
    return own.join(F.broadcast(bounds)).select(*carry, scaled_.alias("features"), "label")


#: Ranges of values of a feature that are numbered apart.
RANGES = 64


def quantile_bins(long: DataFrame, id_col: str, bins: int, ranges: int = RANGES) -> DataFrame:
    """Adds ``bin``: equal-frequency bins from 0, exactly, ties by id. With fewer rows than bins, and for the rest of a division, lower bins are larger, as ``ntile`` deals them.

    Rows are numbered within ranges of values (approximate quantiles of each feature), and the ranges' sizes summed, so
    that a feature is not one task's work. Rows of one value share a range.
    """
    cuts = long.groupBy("f").agg(F.array_distinct(F.percentile_approx("v", [k / ranges for k in range(1, ranges)], 10 * ranges)).alias("_cuts"))
    own = long.join(cuts, "f").withColumn("_range", F.aggregate("_cuts", F.lit(0), lambda n, c: n + (c < F.col("v")).cast("int"))).drop("_cuts")
    size = own.groupBy("f", "_range").agg(F.count("*").alias("_n"))
    per = Window.partitionBy("f")
    before = size.withColumns({"_before": F.coalesce(F.sum("_n").over(per.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_total": F.sum("_n").over(per)}).drop("_n")
    at = F.col("_before") + F.row_number().over(Window.partitionBy("f", "_range").orderBy("v", id_col)) - 1
    whole, rest = F.floor(F.col("_total") / bins), F.col("_total") % bins
    bin_ = F.when(F.col("_at") < rest * (whole + 1), F.floor(F.col("_at") / (whole + 1))).otherwise(rest + F.floor((F.col("_at") - rest * (whole + 1)) / F.greatest(whole, F.lit(1))))
    return own.join(before, ["f", "_range"]).withColumn("_at", at).withColumn("bin", bin_.cast("int")).select(*[own[c] for c in long.columns], "bin")


def quantile_discretiser(columns: list[str], bins: int) -> QuantileDiscretizer:
    """Approximate quantiles, for tables too large for exact ones."""
    return QuantileDiscretizer(numBuckets=bins, inputCols=columns, outputCols=[f"{c}_bin" for c in columns], handleInvalid="keep")


def nominal(long: DataFrame, threshold: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys), f, n_values, is_nominal: fewer distinct values than the threshold."""
    return long.groupBy(*keys, "f").agg(F.countDistinct("v").alias("n_values")).withColumn("is_nominal", F.col("n_values") < threshold)


def nominal_flags(rows: DataFrame, threshold: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, nominal: an array with a flag for each feature of ``features``, over the rows of each group.

    Features with far more values than the threshold are told by an approximate count, so that only values of the few
    others are shuffled.
    """
    own = to_long(rows, keys)
    rough = own.groupBy(*keys, "f").agg(F.approx_count_distinct("v", 0.05).alias("_n"))
    few = rough.filter(F.col("_n") < 4 * threshold + 16).select(*keys, "f")
    exact = nominal(own.join(few, [*keys, "f"], "left_semi"), threshold, keys).filter("is_nominal").select(*keys, "f", F.lit(True).alias("_is"))
    flags = rough.join(exact, [*keys, "f"], "left").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("f", F.coalesce("_is", F.lit(False)).alias("n")))).alias("_flags"))
    return flags.select(*keys, F.transform("_flags", lambda x: x["n"]).alias("nominal"))
