"""Feature weights of balanced groups. Rows: keys (such as p, bag), id, label, features scaled to 0 .. 1."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import solvers
from . import information, neighbours, prep

METHODS = ("QPFS", "SRFS", "TPFS", "ReliefF")


def bins_of(x: np.ndarray, bins: int) -> np.ndarray:
    """Equal-width bins of values in 0 .. 1."""
    w = 1.0 / bins
    k = np.floor(np.nan_to_num(x) / w)
    k = k + (x >= (k + 1) * w) - (x < k * w)
    return np.clip(k, 0, bins - 1).astype(int)


def qpfs(su: np.ndarray, alpha: float | None = None) -> np.ndarray:
    """Weights from a symmetric-uncertainty matrix with the label last.

    A feature whose row holds a NaN (it is constant, and so is another feature or the label) has no weight of its own
    and gets the least of the others'. The label is never dropped.
    """
    f = len(su) - 1
    keep = np.flatnonzero(~np.isnan(su[:f]).any(axis=1))
    w = solvers.quadratic(su[np.ix_(keep, keep)], su[f, keep], alpha) if len(keep) else np.empty(0)
    out = np.full(f, w.min() if len(w) else 0.0)
    out[keep] = w
    return out


def weigh(method: str, x: np.ndarray, label: np.ndarray, bins: int) -> np.ndarray:
    b, y = bins_of(x, bins), np.unique(label, return_inverse=True)[1]
    if method == "QPFS":
        return qpfs(information.similarity_matrix(np.column_stack([b, y])))
    m = information.conditional_matrix(b, y)
    return solvers.spectral(m) if method == "SRFS" else solvers.truncated_power(m)


def by_matrix(rows: DataFrame, method: str, bins: int = 10, keys: tuple[str, ...] = ("p", "bag")) -> DataFrame:
    """keys, f, w: one dense problem for each group."""
    kinds = dict(rows.dtypes)

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        w = weigh(method, np.stack(pdf.features.to_numpy()), pdf.label.to_numpy(), bins)
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in keys}, "f": np.arange(len(w), dtype=np.int32), "w": w})

    return rows.select(*keys, F.col("label").cast("double").alias("label"), "features").groupBy(*keys).applyInPandas(group, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "f int", "w double"]))


def relieff(rows: DataFrame, samples: int = 20, k: int = 20, seed: int = 5341, keys: tuple[str, ...] = (), threshold: int = 1, blocks: int | None = None) -> DataFrame:
    """keys, f, w. Rows also have draw. Sampled rows against their k nearest of every class: misses add, weighed by prior, hits take away.

    samples <= 0 takes all rows. threshold: features with fewer distinct values in their group are nominal (1: none).
    """
    key = F.md5(F.concat_ws("-", F.lit(str(seed)), *[F.col(c).cast("string") for c in keys], F.col("draw").cast("string")))
    own = rows.withColumn("label", F.col("label").cast("double"))
    chosen = own if samples <= 0 else own.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(key, "draw"))).filter(F.col("_r") <= samples).drop("_r")
    flags = prep.nominal_flags(own, threshold, keys) if threshold > 1 else None
    if flags is not None:
        add = lambda df: df.join(flags, list(keys)) if keys else df.crossJoin(F.broadcast(flags))  # noqa: E731  a row for each group
        own, chosen = add(own), add(chosen)
    found = neighbours.nearest(chosen, own, k, "euclidean", keys, "each", blocks=blocks, nominal=None if flags is None else "nominal")
    n = own.groupBy(*keys).agg(F.count("*").alias("_t")) if keys else own.agg(F.count("*").alias("_t"))
    counts = own.groupBy(*keys, "label").agg(F.count("*").alias("_n"))
    prior = (counts.join(n, list(keys)) if keys else counts.join(F.broadcast(n))).select(*keys, "label", (F.col("_n") / F.col("_t")).alias("prior"))
    own_prior, its_prior = prior.withColumnRenamed("prior", "po"), prior.select(*keys, F.col("label").alias("n_label"), F.col("prior").alias("pn"))
    pairs = found.join(own_prior, [*keys, "label"]).join(its_prior, [*keys, "n_label"]).withColumn("factor", F.when(F.col("label") == F.col("n_label"), -1.0).otherwise(F.col("pn") / F.nullif(1 - F.col("po"), F.lit(0.0))))
    a = own.select(*keys, "draw", F.col("features").alias("fa"), *([] if flags is None else ["nominal"]))
    b = own.select(*keys, F.col("draw").alias("n_draw"), F.col("features").alias("fb"))
    diff = neighbours.difference(F.col("fa"), F.col("fb"), None if flags is None else F.col("nominal"))
    long = pairs.join(a, [*keys, "draw"]).join(b, [*keys, "n_draw"]).select(*keys, "factor", F.posexplode(diff).alias("f", "d"))
    return long.groupBy(*keys, "f").agg(F.sum(F.col("factor") * F.abs("d")).alias("w"))
