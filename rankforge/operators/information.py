"""Entropies and similarity matrices of binned data, by relations. Input rows: (keys), id, f, bin."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def plogp(c: Column, n: Column) -> Column:
    return F.when(c > 0, -(c / n) * F.log2(c / n)).otherwise(0.0)


def with_label(binned: DataFrame, keys: tuple[str, ...] = (), label: str = "label") -> DataFrame:
    """Appends the label as one more feature, numbered after the last."""
    own = binned.select(*keys, "id", "f", "bin")
    last = binned.select(*keys, "id", label, "f").groupBy(*keys, "id", label).agg((F.max("f") + 1).cast("int").alias("f"))
    return own.unionByName(last.select(*keys, "id", "f", F.col(label).cast("int").alias("bin")))


def marginals(binned: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return binned.groupBy(*keys, "f", "bin").agg(F.count("*").alias("n"))


def entropies(binned: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys), f, h in bits, from counts that are aggregated before they are shuffled."""
    counts = marginals(binned, keys)
    total = counts.groupBy(*keys, "f").agg(F.sum("n").alias("t"))
    return counts.join(total, [*keys, "f"]).groupBy(*keys, "f").agg(F.sum(plogp(F.col("n"), F.col("t"))).alias("h"))


def pairs(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys), x, y, i, j, n for x < y. rows: (keys), b = array of (f, bin) in the order of f."""
    one = rows.select(*keys, "b", F.posexplode("b").alias("at", "p"))
    two = one.select(*keys, "p", F.explode(F.slice("b", F.col("at") + 2, F.size("b"))).alias("q"))
    return two.groupBy(*keys, F.col("p.f").alias("x"), F.col("q.f").alias("y"), F.col("p.bin").alias("i"), F.col("q.bin").alias("j")).agg(F.count("*").alias("n"))


def contingency(binned: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """How often feature x is in bin i while y is in j, x < y.

    A row's bins are gathered and paired within the row, so that later only pre-aggregated counts are shuffled.
    """
    return pairs(binned.groupBy(*keys, "id").agg(F.array_sort(F.collect_list(F.struct("f", "bin"))).alias("b")), keys)


def relevance(binned: DataFrame, keys: tuple[str, ...] = (), label: str = "label", normalised: bool = True) -> DataFrame:
    """(keys), f, v: similarity of each feature and the label alone. A constant feature and a constant label: NaN."""
    counts = binned.groupBy(*keys, "f", "bin", F.col(label).alias("z")).agg(F.count("*").alias("n"))

    def entropy(cells: list[str], name: str) -> DataFrame:
        c = counts.groupBy(*keys, "f", *cells).agg(F.sum("n").alias("n"))
        t = c.groupBy(*keys, "f").agg(F.sum("n").alias("t"))
        return c.join(t, [*keys, "f"]).groupBy(*keys, "f").agg(F.sum(plogp(F.col("n"), F.col("t"))).alias(name))

    own = entropy(["bin"], "hx").join(entropy(["z"], "hz"), [*keys, "f"]).join(entropy(["bin", "z"], "hxz"), [*keys, "f"])
    mi = F.col("hx") + F.col("hz") - F.col("hxz")
    return own.select(*keys, "f", (F.coalesce(2 * mi / F.nullif(F.col("hx") + F.col("hz"), F.lit(0.0)), F.lit(float("nan"))) if normalised else mi).alias("v"))


def _joint(table: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    total = table.groupBy(*keys, "x", "y").agg(F.sum("n").alias("t"))
    return table.join(total, [*keys, "x", "y"]).groupBy(*keys, "x", "y").agg(F.sum(plogp(F.col("n"), F.col("t"))).alias("hxy"))


def similarity(binned: DataFrame, keys: tuple[str, ...] = (), normalised: bool = True) -> DataFrame:
    """(keys), x, y, v of the full symmetric matrix: symmetric uncertainty 2 (hx + hy - hxy) / (hx + hy) with diagonal 1, or mutual information with diagonal hx. Two constant features: NaN."""
    h = entropies(binned, keys)
    hx, hy = h.select(*keys, F.col("f").alias("x"), F.col("h").alias("hx")), h.select(*keys, F.col("f").alias("y"), F.col("h").alias("hy"))
    own = _joint(contingency(binned, keys), keys).join(hx, [*keys, "x"]).join(hy, [*keys, "y"])
    mi = F.col("hx") + F.col("hy") - F.col("hxy")
    v = F.coalesce(2 * mi / F.nullif(F.col("hx") + F.col("hy"), F.lit(0.0)), F.lit(float("nan"))) if normalised else mi
    upper = own.select(*keys, "x", "y", v.alias("v"))
    lower = upper.select(*keys, F.col("y").alias("x"), F.col("x").alias("y"), "v")
    diagonal = h.select(*keys, F.col("f").alias("x"), F.col("f").alias("y"), (F.lit(1.0) if normalised else F.col("h")).alias("v"))
    return upper.unionByName(lower).unionByName(diagonal)


def conditional(binned: DataFrame, keys: tuple[str, ...] = (), label: str = "label") -> DataFrame:
    """(keys), x, y, v: half the sum of I(x; label given y) and I(y; label given x); on the diagonal I(x; label). Rows also have the label; one feature is enough."""
    rows = binned.select(*keys, "id", "f", "bin", F.col(label).cast("int").alias("z"))
    single = rows.groupBy(*keys, "f", "bin", "z").agg(F.count("*").alias("n"))

    def entropy(df: DataFrame, by: list[str], cells: list[str], name: str) -> DataFrame:
        c = df.groupBy(*keys, *by, *cells).agg(F.sum("n").alias("n"))
        t = c.groupBy(*keys, *by).agg(F.sum("n").alias("t"))
        return c.join(t, [*keys, *by]).groupBy(*keys, *by).agg(F.sum(plogp(F.col("n"), F.col("t"))).alias(name))

    hx, hxz, hz = entropy(single, ["f"], ["bin"], "hx"), entropy(single, ["f"], ["bin", "z"], "hxz"), entropy(single, ["f"], ["z"], "hz")
    one = hx.join(hxz, [*keys, "f"]).join(hz, [*keys, "f"])
    tagged = rows.select(*keys, "id", "f", F.struct("bin", "z").alias("bin"))
    triple = contingency(tagged, keys).select(*keys, "x", "y", F.col("i.bin").alias("i"), F.col("j.bin").alias("j"), F.col("i.z").alias("z"), "n")
    pair = entropy(triple, ["x", "y"], ["i", "j"], "hxy").join(entropy(triple, ["x", "y"], ["i", "j", "z"], "hxyz"), [*keys, "x", "y"])
    a, b = (one.select(*keys, F.col("f").alias(c), F.col("hx").alias(f"h{c}"), F.col("hxz").alias(f"h{c}z")) for c in ("x", "y"))
    v = 0.5 * (2 * F.col("hxy") + F.col("hyz") + F.col("hxz") - 2 * F.col("hxyz") - F.col("hy") - F.col("hx"))
    upper = pair.join(a, [*keys, "x"]).join(b, [*keys, "y"]).select(*keys, "x", "y", v.alias("v"))
    diagonal = one.select(*keys, F.col("f").alias("x"), F.col("f").alias("y"), (F.col("hx") + F.col("hz") - F.col("hxz")).alias("v"))
    return upper.unionByName(upper.select(*keys, F.col("y").alias("x"), F.col("x").alias("y"), "v")).unionByName(diagonal)


# ------------------------------------------------------------------ the same for one group, as matrices (wide tables)
def _entropy(counts: np.ndarray, axes) -> np.ndarray:
    p = counts / np.maximum(counts.sum(axis=axes, keepdims=True), 1e-300)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p > 0, -p * np.log2(p), 0.0).sum(axis=axes)


def _onehot(bins: np.ndarray, size: int) -> np.ndarray:
    return (bins[:, :, None] == np.arange(size)).astype(np.float32).reshape(len(bins), -1)


#: Rows whose counts are one product; float32 counts exactly up to 2**24.
CHUNK = 1 << 16


def joint_counts(bins: np.ndarray, size: int) -> np.ndarray:
    """How often feature x is in bin i while y is in j, as (x, y, i, j): products of one-hot chunks, added up exactly."""
    n, f = bins.shape
    total = np.zeros((f * size, f * size), np.float64 if n >= 1 << 24 else np.float32)
    for a in range(0, n, CHUNK):
        own = _onehot(bins[a : a + CHUNK], size)
        total += own.T @ own
    return total.reshape(f, size, f, size).transpose(0, 2, 1, 3)


def similarity_matrix(bins: np.ndarray, normalised: bool = True) -> np.ndarray:
    """bins: rows x features, small numbers from 0. Two constant features: NaN."""
    n, f = bins.shape
    joint = joint_counts(bins, int(bins.max()) + 1 if n else 1)
    hxy, h = _entropy(joint, (2, 3)), _entropy(joint[np.arange(f), np.arange(f)].sum(axis=2), 1)
    mi = h[:, None] + h[None, :] - hxy
    with np.errstate(divide="ignore", invalid="ignore"):
        out = 2 * mi / (h[:, None] + h[None, :]) if normalised else mi
    np.fill_diagonal(out, 1.0 if normalised else h)
    return out


def conditional_matrix(bins: np.ndarray, label: np.ndarray) -> np.ndarray:
    n, f = bins.shape
    k = int(bins.max()) + 1 if n else 1
    cube = np.stack([joint_counts(bins[label == z], k) for z in np.unique(label)], axis=-1)
    hxyz, hxy = _entropy(cube, (2, 3, 4)), _entropy(cube.sum(axis=-1), (2, 3))
    single = cube[np.arange(f), np.arange(f)].sum(axis=2)
    hxz, hx, hz = _entropy(single, (1, 2)), _entropy(single.sum(axis=-1), 1), _entropy(single.sum(axis=1), 1)
    out = 0.5 * (2 * hxy + hxz[None, :] + hxz[:, None] - 2 * hxyz - hx[None, :] - hx[:, None])
    np.fill_diagonal(out, hx + hz - hxz)
    return out
