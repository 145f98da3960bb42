"""Registered queries: each applies an operator to whole tables. ``oracles.SQL`` has the same in plain SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import fusing
from .operators import balance, fusion, information, neighbours, prep, rankers
from .plans import ensemble
from .sources import io
from .sources.schema import Dataset

NUMERIC = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
GROUPS = 4


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("features"))


def imbalanced(spark: SparkSession, sf: str) -> DataFrame:
    """One class against the rest."""
    return vectors(spark, sf).withColumn("label", F.when(F.col("label") == 0, 1).otherwise(0))


def spread(spark: SparkSession, sf: str, groups: int = GROUPS) -> DataFrame:
    return balance.spread_classes(imbalanced(spark, sf), groups, "id")


def long(spark: SparkSession, sf: str) -> DataFrame:
    return prep.to_long(vectors(spark, sf), ("id", "label"))


def scaled(spark: SparkSession, sf: str) -> DataFrame:
    own = long(spark, sf)
    return prep.scale(own, prep.minmax(own))


def items(spark: SparkSession, sf: str) -> DataFrame:
    return prep.assemble(table(spark, sf, "lineitem"), NUMERIC, "l_returnflag")


def item_bins(spark: SparkSession, sf: str) -> DataFrame:
    """b: array of (f, bin), with the label's index as the last feature."""
    own = items(spark, sf)
    bounds = prep.minmax(prep.to_long(own, ())).agg(F.array_sort(F.collect_list(F.struct("f", "mn", "mx"))).alias("m"))
    index = prep.label_index(own).select(F.col("value").alias("label"), F.col("idx").cast("int").alias("z"))
    bins = F.zip_with("features", "m", lambda v, m: F.struct(m["f"].alias("f"), prep.bin_of(v, m["mn"], m["mx"], 10).alias("bin")))
    return own.join(F.broadcast(bounds)).join(index, "label").select(F.concat(bins, F.array(F.struct(F.lit(len(NUMERIC)).alias("f"), F.col("z").alias("bin")))).alias("b"))


def _r(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# ------------------------------------------------------------------------------------------------ preparation
def feature_minmax(spark, sf):
    return prep.minmax(long(spark, sf))


def minmax_scaled(spark, sf):
    return _r(scaled(spark, sf).select("id", "f", "v"), "v")


def equal_width_bins(spark, sf):
    own = long(spark, sf)
    return prep.discretise(own, 10, prep.minmax(own)).select("id", "f", "bin")


def scaled_bins(spark, sf):
    return prep.discretise(scaled(spark, sf), 10).select("id", "f", "bin")


def scaled_nan_kept(spark, sf):
    """Scaling of values of which some are NaN, by the bounds of the others; NaN stays."""
    own = long(spark, sf)
    holed = own.withColumn("v", F.when((F.col("id") + F.col("f")) % 11 == 0, F.lit(float("nan"))).otherwise(F.col("v")))
    out = prep.scale(holed, prep.minmax(holed.filter("NOT isnan(v)")), nan_to_zero=False)
    return out.select("id", "f", F.isnan("v").alias("is_nan"), F.round(F.when(~F.isnan("v"), F.col("v")), 6).alias("v"))


def strict_bins(spark, sf):
    own = long(spark, sf)
    return prep.discretise(own, 7, prep.minmax(own), strict=True).groupBy("f", "bin").agg(F.count("*").alias("n"))


def prepared(spark, sf):
    """Assembly, scaling and label index of a table in one plan."""
    own = prep.prepare(table(spark, sf, "part"), ["p_size", "p_retailprice"], "p_brand", ("p_partkey",), -1.0, 1.0)
    return _r(own.select("p_partkey", "label", F.posexplode("features").alias("f", "v")), "v")


def quantile_bins_exact(spark, sf):
    return prep.quantile_bins(long(spark, sf), "id", 4).select("id", "f", "bin")


def nominal_features(spark, sf):
    return prep.nominal(prep.to_long(items(spark, sf), ()), 60)


def label_index(spark, sf):
    return prep.label_index(table(spark, sf, "orders"), "o_orderpriority")


# ------------------------------------------------------------------------------------------------ balancing
def class_spread_counts(spark, sf):
    return spread(spark, sf).groupBy("p", "label").agg(F.count("*").alias("n"))


def minority_split(spark, sf):
    return balance.minority(spread(spark, sf))


def bagging_undersample(spark, sf):
    return balance.bagging(spread(spark, sf), 3, "id")


def balanced_none(spark, sf):
    return ensemble.balanced(spread(spark, sf), "none", 2, 5, 5341).groupBy("p", "bag", "label").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def nearmiss1(spark, sf):
    return balance.near_miss(spread(spark, sf), 5, "id")


def nearmiss2(spark, sf):
    return balance.near_miss(spread(spark, sf), 5, "id", furthest=True)


def smote_synthetic(spark, sf):
    made = balance.smote(spread(spark, sf), 5, "id")
    return _r(made.select("p", "id", "i", "n_id", F.posexplode("features").alias("f", "v")), "v")


# ------------------------------------------------------------------------------------------------ neighbours
def _pairs(spark, sf, distance):
    own = spread(spark, sf, 16)
    a, b = own.select("p", "id", F.col("features").alias("fa")), own.select("p", F.col("id").alias("n_id"), F.col("features").alias("fb"))
    return _r(a.join(b, "p").filter("id < n_id").select("p", "id", "n_id", distance(F.col("fa"), F.col("fb")).alias("dist")), "dist")


def pair_euclidean(spark, sf):
    return _pairs(spark, sf, neighbours.euclidean)


def pair_manhattan(spark, sf):
    return _pairs(spark, sf, neighbours.manhattan)


def _knn(relation: str, furthest: bool = False):
    def query(spark, sf):
        own = balance.spread_classes(vectors(spark, sf), GROUPS, "id").withColumn("draw", F.col("id"))
        found = neighbours.nearest(own, own, 3, keys=("p",), relation=relation, furthest=furthest)
        return _r(found.select("p", "id", "n_id", F.col("n_label").cast("int").alias("n_label"), "dist", "rank"), "dist")

    return query


# ------------------------------------------------------------------------------------------------ information
def entropy(spark, sf):
    return _r(information.entropies(information.with_label(prep.discretise(scaled(spark, sf)))), "h")


def contingency(spark, sf):
    return information.pairs(item_bins(spark, sf))


def mi_matrix(spark, sf):
    return _r(information.similarity(information.with_label(prep.discretise(scaled(spark, sf))), normalised=False), "v")


def su_matrix(spark, sf):
    return _r(information.similarity(information.with_label(prep.discretise(scaled(spark, sf)))), "v")


def cmi_matrix(spark, sf):
    return _r(information.conditional(prep.discretise(scaled(spark, sf))), "v")


def su_label_rank(spark, sf):
    found = _r(information.relevance(prep.discretise(scaled(spark, sf))), "v")
    return fusion.rankings(found.select(F.lit(0).alias("p"), "f", F.col("v").alias("w")), ("p",)).join(found.select(F.col("f").cast("string").alias("item"), "v"), "item").select("item", "v", F.col("pos").cast("int").alias("pos"))


# ------------------------------------------------------------------------------------------------ rankers
def _bounded(spark, sf):
    own = imbalanced(spark, sf)
    bounds = prep.minmax(prep.to_long(own, ())).agg(F.array_sort(F.collect_list(F.struct("f", "mn", "mx"))).alias("m"))
    return own.join(F.broadcast(bounds)).select("id", F.col("id").alias("draw"), "label", F.zip_with("features", "m", lambda v, m: prep.scaled(v, m["mn"], m["mx"])).alias("features"))


def relieff_weights(spark, sf):
    return _r(rankers.relieff(_bounded(spark, sf), 20, 10), "w")


def _dense(method: str):
    def query(spark, sf):
        own = _bounded(spark, sf).withColumns({"p": F.pmod("id", F.lit(GROUPS)).cast("int"), "bag": F.lit(0)})
        return _r(rankers.by_matrix(own, method), "w")

    return query


# ------------------------------------------------------------------------------------------------ fusion, ensemble
def lists(spark, sf):
    """Four rankings of the features, by their means in quarters of the rows."""
    w = long(spark, sf).groupBy(F.pmod("id", F.lit(4)).alias("list_id"), "f").agg(F.round(F.avg("v"), 9).alias("w"))
    return fusion.rankings(w, ("list_id",))


OWA_RISK = 0.75


def _fuse(method: str):
    def query(spark, sf):
        return _r(fusion.fuse(lists(spark, sf), method, risk=OWA_RISK).withColumn("pos", F.col("pos").cast("int")), "score", digits=8)

    return query


def _bag_weights(spark, sf):
    return long(spark, sf).groupBy(F.pmod("id", F.lit(4)).alias("p"), F.pmod(F.floor(F.col("id") / 4), F.lit(3)).alias("bag"), "f").agg(F.round(F.avg("v"), 9).alias("w"))


def two_level_fusion_min(spark, sf):
    return fusion.two_level(_bag_weights(spark, sf)).select("item", F.round("score", 9).alias("score"), F.col("pos").cast("int").alias("pos"))


def fusion_sweep(spark, sf):
    """All 31 settings on one table of weights."""
    return fusion.sweep(_bag_weights(spark, sf)).select("setting", "item", F.round("score", 8).alias("score"), F.col("pos").cast("int").alias("pos"))


def _ensemble(method: str, balancing: str = "baggingundersampling", fused: str = "owa", bags: int = 3):
    def query(spark, sf):
        model = ensemble.EnsembleRanker(rankingMethod=method, balancingMethod=balancing, numPartition=GROUPS, bagNum=bags, firstFusionMethod=fused, secondFusionMethod=fused).fit(imbalanced(spark, sf))
        return model.ranks().select("item", F.round("score", 9).alias("score"), F.col("pos").cast("int").alias("pos"))

    return query


def owa_weights(spark, sf):
    """Weights of 4 ranks, and their diagnostics, for a range of risks."""
    rows = [(r, i, w[i], fusing.orness(w), fusing.dispersion(w), fusing.trade_off(w)) for r in (0.25, 0.5, 0.75) for w in (fusing.owa_weights(4, r),) for i in range(4)]
    return _r(spark.createDataFrame(rows, "risk double, i int, w double, orness double, dispersion double, trade_off double"), "w", "orness", "dispersion", "trade_off")


# ------------------------------------------------------------------------------------------------ files
def _folder(spark: SparkSession) -> str:
    return f"{io.shared_folder(spark)}/files-{uuid.uuid4().hex}"


def csv_roundtrip(spark, sf):
    path, data = _folder(spark), Dataset("items", len(NUMERIC))
    table(spark, sf, "lineitem").select(*[F.col(c).cast("double") for c in NUMERIC], F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)).write.csv(path)
    return io.read_csv(spark, path, data)


def binary_records(spark, sf):
    """Bytes of four columns packed into records and unpacked as signed numbers."""
    data = Dataset("bytes", 3, binary=True)
    byte = lambda c: F.lpad(F.conv(F.pmod(F.col(c), F.lit(256)).cast("string"), 10, 16), 2, "0")
    packed = table(spark, sf, "lineitem").select(F.unhex(F.concat(*[byte(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")])).alias("content"))
    return io.unpack(packed, data)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {f.__name__: f for f in (feature_minmax, minmax_scaled, equal_width_bins, scaled_bins, scaled_nan_kept, strict_bins, prepared, balanced_none, quantile_bins_exact, nominal_features, label_index, class_spread_counts, minority_split, bagging_undersample, nearmiss1, nearmiss2, smote_synthetic, pair_euclidean, pair_manhattan, entropy, contingency, mi_matrix, su_matrix, cmi_matrix, su_label_rank, relieff_weights, two_level_fusion_min, fusion_sweep, owa_weights, csv_roundtrip, binary_records)}
    found |= {"knn": _knn("any"), "knn_hit": _knn("hit"), "knn_miss": _knn("miss"), "knn_by_class": _knn("each"), "k_furthest": _knn("any", True)}
    found |= {f"{m.lower()}_weights": _dense(m) for m in ("QPFS", "SRFS", "TPFS")}
    found |= {f"fuse_{m.lower().replace('.', '_')}": _fuse(m) for m in fusion.METHODS}
    found |= {"ensemble_qpfs_owa": _ensemble("QPFS"), "ensemble_srfs_rra": _ensemble("SRFS", fused="RRA"), "ensemble_tpfs_nearmiss2": _ensemble("TPFS", "nearmiss2", "median"), "ensemble_relieff_min": _ensemble("ReliefF", fused="min"), "ensemble_relieff_smote": _ensemble("ReliefF", "smote", "stuart"), "ensemble_qpfs_none": _ensemble("QPFS", "none", "geom.mean", 1)}
    return found
