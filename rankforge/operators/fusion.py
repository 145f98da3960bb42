"""Fusing ranked lists: rank tables in, fused rankings out. Lists: (keys), list_id, item (string), pos from 0."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fusing

METHODS = ("mean", "min", "median", "geom.mean", "RRA", "stuart", "owa")


def rank_rows(lists: DataFrame, n: int | None = None, keys: tuple[str, ...] = (), full: bool = False) -> DataFrame:
    """(keys), item, r: an item's normalised ranks (pos + 1) / n, one for each list; 1.0 where a list lacks it (full: NaN).

    n: given, or the number of distinct items, or, with full, the list's length.
    """
    per = F.broadcast if not keys else (lambda df: df)
    size = lists.groupBy(*keys).agg(F.countDistinct("item").alias("items"), F.countDistinct("list_id").alias("lists"))
    own = lists
    if full and n is None:
        own = own.join(lists.groupBy(*keys, "list_id").agg(F.count("*").alias("length")), [*keys, "list_id"])
    own = own.join(size, list(keys)) if keys else own.join(per(size))  # one row
    length = F.lit(float(n)) if n else (F.col("length") if full else F.col("items")).cast("double")
    ranked = own.groupBy(*keys, "item").agg(F.sort_array(F.collect_list((F.col("pos") + 1) / length)).alias("own"), F.max("lists").alias("lists"))
    missing = F.array_repeat(F.lit(float("nan") if full else 1.0), (F.col("lists") - F.size("own")).cast("int"))
    return ranked.select(*keys, "item", F.concat("own", missing).alias("r"))


def _numpy(f) -> Column:
    @F.pandas_udf("double")
    def score(r: pd.Series) -> pd.Series:
        return r.map(lambda x: f(np.asarray(x, float)))

    return score(F.col("r"))


def let(value: Column, body) -> Column:
    """body(value) with value computed once for each row, also where body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def normal_cdf(z: Column) -> Column:
    """Of the standard normal distribution: the odd series about 0, and a continued fraction beyond 4."""

    def about(z: Column) -> Column:
        # z + z^3 / 3 + z^5 / (3 5) + ...
        first = F.struct(z.alias("t"), z.alias("s"))
        terms = F.aggregate(F.sequence(F.lit(1), F.lit(80)), first, lambda a, k: F.struct((a["t"] * z * z / (2 * k + 1)).alias("t"), (a["s"] + a["t"] * z * z / (2 * k + 1)).alias("s")), lambda a: a["s"])
        return 0.5 + density(z) * terms

    def tail(z: Column) -> Column:
        return density(z) / F.aggregate(F.sequence(F.lit(80), F.lit(1)), z, lambda a, k: z + k / a)

    def density(z: Column) -> Column:
        return F.exp(-z * z / 2) / (2 * math.pi) ** 0.5

    return let(z, lambda z: F.when(F.abs(z) < 4, about(z)).when(z < 0, tail(-z)).otherwise(1 - tail(z)))


def _rra(own: Column) -> Column:
    """n times the least probability that the i-th of n sorted uniform numbers is at most the i-th rank: upper tails of binomials, in logarithms."""

    def tail(x: Column, i: Column, n: Column) -> Column:
        # terms of j = n, n - 1, .. i successes in n
        first = F.struct((n * F.log(x)).alias("l"), F.lit(0.0).alias("s"))
        step = lambda a, j: F.struct((a["l"] + F.log(j / (n - j + 1)) + F.log((1 - x) / x)).alias("l"), (a["s"] + F.exp(a["l"])).alias("s"))
        return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(F.aggregate(F.sequence(n, i, F.lit(-1)), first, step, lambda a: F.least(a["s"], F.lit(1.0))))

    def least(own: Column) -> Column:
        n = F.size(own)
        return F.when(n == 0, F.lit(float("nan"))).otherwise(F.least(F.lit(1.0), n * F.array_min(F.transform(own, lambda x, i: tail(x, i + 1, n)))))

    return let(own, least)


def _stuart(own: Column) -> Column:
    """Probability that sorted uniform numbers lie below the sorted ranks: u_k = sum of (-1)^(i-1) C(k, i) x^i u_(k-i), x the k-th largest rank."""

    def after(own: Column) -> Column:
        n = F.size(own)

        def following(u: Column, k: Column) -> Column:
            x = F.element_at(own, n - k + 1)
            first = F.struct(F.lit(-1.0).alias("b"), F.lit(0.0).alias("s"))
            step = lambda a, i: let(-a["b"] * (k - i + 1) / i * x, lambda b: F.struct(b.alias("b"), (a["s"] + b * F.element_at(u, k - i + 1)).alias("s")))
            return F.concat(u, F.array(F.aggregate(F.sequence(F.lit(1), k), first, step, lambda a: a["s"])))

        return F.when(n == 0, 1.0).otherwise(F.aggregate(F.sequence(F.lit(1), n), F.array(F.lit(1.0)), following, lambda u: F.element_at(u, -1)))

    return let(own, after)


def _owa(r: Column, risk: float) -> Column:
    """Ranks from worst to best, weighed by a cut normal density over 0 .. 1."""
    own, shape = F.sort_array(r, asc=False), fusing.owa_shape(risk)

    def average(own: Column) -> Column:
        n = F.size(own)
        at = lambda i: i / (n - 1)
        if shape is None:  # all on the rank nearest to the risk; of two the worse
            gap = F.transform(own, lambda x, i: F.abs(at(i) - risk))
            weighed = F.element_at(own, F.array_position(gap, F.array_min(gap)).cast("int"))
        else:
            logs = F.transform(own, lambda x, i: -F.pow((at(i) - shape[0]) / shape[1], F.lit(2.0)) / 2)
            weighed = let(logs, lambda logs: let(F.transform(logs, lambda v: F.exp(v - F.array_max(logs))), lambda w: _total(F.zip_with(own, w, lambda x, y: x * y)) / _total(w)))
        return F.when(n == 1, F.element_at(own, 1)).otherwise(weighed)

    return let(own, average)


def score(method: str, risk: float = 0.5, exact: bool = False, cutoff: list[float] | None = None) -> Column:
    """Score of the ranks ``r``, lower is better, in the JVM but for RRA with ``exact`` or ``cutoff``."""
    r = F.col("r")
    known = F.filter(r, lambda x: ~F.isnan(x))
    if method == "min":
        return F.array_min(known)
    if method == "median":
        return F.get(F.array_sort(known), F.floor(F.size(known) / 2).cast("int"))
    if method == "geom.mean":
        return F.exp(F.aggregate(known, F.lit(0.0), lambda a, x: a + F.log(x)) / F.size(known))
    if method == "mean":
        return let(known, lambda k: normal_cdf((_total(k) / F.size(k) - 0.5) * F.sqrt(12 * F.size(k))))
    if method == "stuart":
        return _stuart(F.sort_array(known))
    if method == "RRA" and cutoff is not None:
        return _numpy(lambda x: fusing.threshold_rra(x, np.asarray(cutoff)))
    if method == "RRA":
        return _numpy(lambda x: fusing.rra(x, True)) if exact else _rra(F.sort_array(known))
    if method == "owa":
        return _owa(r, risk)
    raise ValueError(f"unknown method {method}; there are {', '.join(METHODS)}")


def fuse(lists: DataFrame, method: str = "min", n: int | None = None, keys: tuple[str, ...] = (), risk: float = 0.5, full: bool = False, exact: bool = False, cutoff: list[float] | None = None) -> DataFrame:
    """(keys), item, score, pos: items best first; equal scores in the order of the items as strings."""
    scored = rank_rows(lists, n, keys, full).withColumn("score", score(method, risk, exact, cutoff)).drop("r")
    place = Window.partitionBy(*keys).orderBy(F.round("score", 12), F.col("item").cast("string"))
    return scored.withColumn("pos", F.row_number().over(place) - 1)


def rankings(weights: DataFrame, keys: tuple[str, ...] = ("p", "bag"), digits: int = 12) -> DataFrame:
    """keys, item, pos from weights (keys, f, w): heaviest first, ties to the higher feature."""
    order = Window.partitionBy(*keys).orderBy(F.desc(F.round("w", digits)), F.desc("f"))
    return weights.select(*keys, F.col("f").cast("string").alias("item"), (F.row_number().over(order) - 1).alias("pos"))


#: Pairs of risks that the sweep tries with ordered averages: cautious to bold, first over bags, then over groups.
RISKS = (0.95, 0.75, 0.50, 0.25, 0.05)


def sweep(weights: DataFrame, risks: tuple[float, ...] = RISKS) -> DataFrame:
    """setting, item, score, pos: two-level fusion by every method, and by owa with every pair of risks, of one table of weights.

    Rankings are made once; a setting is a column of scores, not another pass.
    """
    inner = rank_rows(rankings(weights).withColumnRenamed("bag", "list_id"), None, ("p",))
    plain = [m for m in METHODS if m != "owa"]
    first = [(m, score(m)) for m in plain] + [(f"owa {a:g}", score("owa", a)) for a in risks]
    one = inner.select("p", "item", F.explode(F.array(*[F.struct(F.lit(n).alias("one"), c.alias("score")) for n, c in first])).alias("s")).select("p", "item", "s.*")
    place = Window.partitionBy("p", "one").orderBy(F.round("score", 12), F.col("item").cast("string"))
    lists = one.select(F.col("p").alias("list_id"), "one", "item", (F.row_number().over(place) - 1).alias("pos"))
    outer = rank_rows(lists, None, ("one",))
    second = F.array(*[F.struct(F.concat(F.lit(m)).alias("setting"), score(m).alias("score"), F.lit(m).alias("of")) for m in plain], *[F.struct(F.concat(F.col("one"), F.lit(f" {b:g}")).alias("setting"), score("owa", b).alias("score"), F.lit("owa").alias("of")) for b in risks])
    both = outer.select("one", "item", F.explode(second).alias("s")).filter((F.col("one") == F.col("s.of")) | (F.col("one").startswith("owa") & (F.col("s.of") == "owa"))).select("s.setting", "item", "s.score")
    last = Window.partitionBy("setting").orderBy(F.round("score", 12), F.col("item").cast("string"))
    return both.withColumn("pos", F.row_number().over(last) - 1)


def two_level(weights: DataFrame, first: str = "min", second: str = "min", first_risk: float = 0.05, second_risk: float = 0.95) -> DataFrame:
    """item, score, pos: rankings fused over bags within each group, then over groups. Only orders pass from level to level."""
    inner = fuse(rankings(weights).withColumnRenamed("bag", "list_id"), first, keys=("p",), risk=first_risk)
    return fuse(inner.select(F.col("p").alias("list_id"), "item", "pos"), second, risk=second_risk)
