"""The ensemble: spread classes over groups, balance in bags, weigh features, fuse rankings twice."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import balance, fusion, prep, rankers
from ..sources import io

_ONE_BAG = ("smote", "nearmiss1", "nearmiss2")


def balanced(rows: DataFrame, method: str, bags: int, k: int, seed: int, threshold: int = 1) -> DataFrame:
    """p, bag, draw, id, label, features of the balanced bags. rows: p, id, label, features.

    threshold: features with fewer distinct values in their group are nominal where neighbours are sought (1: none).
    """
    text = F.col("id").cast("string")
    if method == "none":
        return rows.select("p", F.explode(F.sequence(F.lit(0), F.lit(bags - 1))).alias("bag"), text.alias("draw"), "id", "label", "features")
    if method == "baggingundersampling":
        picks = balance.bagging(rows, bags, "id", seed).select("p", "bag", "draw", "id")
        return picks.join(rows, ["p", "id"]).select("p", "bag", "draw", "id", "label", "features")
    flags = "nominal" if threshold > 1 and method in _ONE_BAG else None
    marked = rows.join(prep.nominal_flags(rows, threshold, ("p",)), "p") if flags else rows
    if method in ("nearmiss1", "nearmiss2"):
        kept = balance.near_miss(marked, k, "id", method == "nearmiss2", nominal=flags).select("p", "id")
        return kept.join(rows, ["p", "id"]).select("p", F.lit(0).alias("bag"), text.alias("draw"), "id", "label", "features")
    if method == "smote":
        made = balance.smote(marked, k, "id", seed, nominal=flags).select("p", F.concat_ws("-", F.lit("s"), text, F.col("i").cast("string")).alias("draw"), (-F.col("id") - 1).alias("id"), "label", "features")
        return rows.select("p", text.alias("draw"), "id", "label", "features").unionByName(made).select("p", F.lit(0).alias("bag"), "draw", "id", "label", "features")
    raise ValueError(f"unknown balancing method {method}")


def weights(df: DataFrame, method: str = "QPFS", balancing: str = "baggingundersampling", groups: int = 1, bags: int = 10, bins: int = 10, k: int = 5, samples: int = 20, neighbours: int = 20, seed: int = 5341, threshold: int = 5) -> DataFrame:
    """p, bag, f, w. df: id, label, features."""
    bags = 1 if balancing in _ONE_BAG else bags
    bounds = prep.minmax(prep.to_long(df, ("id",))).agg(F.array_sort(F.collect_list(F.struct("f", "mn", "mx"))).alias("b"))  # one row, an entry for each feature
    own = df.join(F.broadcast(bounds))
    scaled = F.zip_with("features", "b", lambda v, b: prep.scaled(v.cast("double"), b["mn"], b["mx"]))
    rows = balance.spread_classes(own.select("id", "label", scaled.alias("features")), groups, "id")
    # balancing and weighing read their rows many times
    rows = io.cut_lineage(rows) if balancing != "none" else rows
    bagged = balanced(rows, balancing, bags, k, seed, threshold)
    if method == "ReliefF":
        bagged = io.cut_lineage(bagged)
        return rankers.relieff(bagged, samples, neighbours, seed, ("p", "bag"), threshold)
    return rankers.by_matrix(bagged, method, bins)


class _Settings(Params):
    def _declare(self) -> None:
        def p(name: str, doc: str, kind, check=lambda x: True):
            def convert(v):
                v = kind(v)
                if not check(v):
                    raise ValueError(f"{name} can't be {v}")
                return v

            setattr(self, name, Param(self, name, doc, convert))

        whole, real, text = TypeConverters.toInt, TypeConverters.toFloat, TypeConverters.toString
        fusions = lambda x: x in fusion.METHODS
        share = lambda x: 0 < x <= 1
        p("idCol", "column that names a row", text)
        p("labelCol", "label", text)
        p("featuresCol", "array of features", text)
        p("maxBin", "bins of a feature", whole, lambda x: 1 <= x <= 255)
        p("useCache", "keep prepared rows", TypeConverters.toBoolean)
        p("neiNumber", "neighbours for balancing", whole, lambda x: x > 0)
        p("thrNominal", "features with fewer values are nominal", whole)
        p("seed", "seed of all draws", whole, lambda x: x > 0)
        p("bagNum", "bags of a group", whole, lambda x: x > 0)
        p("numSamples", "rows that ReliefF samples", whole)
        p("numNeighbours", "neighbours of ReliefF", whole, lambda x: x > 0)
        p("rankingMethod", "ranker", text, lambda x: x in rankers.METHODS)
        p("balancingMethod", "balancing", lambda x: text(x).lower(), lambda x: x in balance.METHODS)
        p("numPartition", "groups", whole, lambda x: 1 <= x <= 32767)
        p("firstFusionMethod", "fusion over bags", text, fusions)
        p("secondFusionMethod", "fusion over groups", text, fusions)
        p("firstRiskFusion", "risk of the first owa", real, share)
        p("secondRiskFusion", "risk of the second owa", real, share)
        p("selectionThreshold", "share of features that transform keeps", real, share)
        self._setDefault(idCol="id", labelCol="label", featuresCol="features", maxBin=10, useCache=False, neiNumber=5, thrNominal=5, seed=5341, bagNum=10, numSamples=20, numNeighbours=20, rankingMethod="QPFS", balancingMethod="baggingundersampling", numPartition=1, firstFusionMethod="min", secondFusionMethod="min", firstRiskFusion=0.05, secondRiskFusion=0.95, selectionThreshold=0.10)

    def of(self, name: str):
        return self.getOrDefault(getattr(self, name))


class EnsembleRanker(Estimator, _Settings):
    """fit weighs features in balanced bags of evenly spread groups; the model fuses the rankings."""

    @keyword_only
    def __init__(self, **settings):
        super().__init__()
        self._declare()
        self._set(**self._input_kwargs.get("settings", self._input_kwargs))

    def _fit(self, df: DataFrame) -> RankModel:
        rows = df.select(F.col(self.of("idCol")).cast("long").alias("id"), F.col(self.of("labelCol")).cast("double").alias("label"), F.col(self.of("featuresCol")).cast("array<double>").alias("features"))
        cached = rows.persist() if self.of("useCache") else None
        found = weights(rows, self.of("rankingMethod"), self.of("balancingMethod"), self.of("numPartition"), self.of("bagNum"), self.of("maxBin"), self.of("neiNumber"), self.of("numSamples"), self.of("numNeighbours"), self.of("seed"), self.of("thrNominal"))
        # a row for each group, bag and feature; fusion settings can then change without another fit
        found = found.persist()
        if cached is not None:
            found.count()  # the prepared rows have then been used
            cached.unpersist()
        return self._copyValues(RankModel(found))


class RankModel(Model, _Settings):
    def __init__(self, found: DataFrame):
        super().__init__()
        self._declare()
        self.weights = found

    def release(self) -> None:
        """Gives the kept weights back; later calls compute them anew."""
        self.weights.unpersist()

    def ranks(self) -> DataFrame:
        """item, score, pos: features best first."""
        return fusion.two_level(self.weights, self.of("firstFusionMethod"), self.of("secondFusionMethod"), self.of("firstRiskFusion"), self.of("secondRiskFusion"))

    def selected(self) -> list[int]:
        """The best ``selectionThreshold`` of all features, at least one."""
        own = [int(r["item"]) for r in self.ranks().orderBy("pos").collect()]  # a row for each feature
        return own[: max(1, -(-int(round(1e6 * self.of("selectionThreshold") * len(own))) // 1_000_000))]

    def _transform(self, df: DataFrame) -> DataFrame:
        """Adds ``selected``: the features kept, best first."""
        c = F.col(self.of("featuresCol"))
        return df.withColumn("selected", F.array(*[F.get(c, F.lit(i)) for i in self.selected()]))
