"""Differences, distances, nearest and furthest neighbours.

Neighbours are found block by block: queries and rows of a group are dealt to blocks of about ``ROWS`` by a hash of their
id, as many as the group's size asks for; each pair of (query block, row block) is one task's work in numpy, which
returns at most k neighbours of each query, and a window merges them. No pair of rows is ever a row of a table, and ties
go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries, and rows, of a block: a matrix of distances has at most about the square of it.
ROWS = 2048


def difference(a: Column, b: Column, nominal: Column | None = None) -> Column:
    """Feature by feature: signed difference; 0 or 1 where nominal. Unequal lengths raise."""
    diff = F.zip_with(a, b, lambda x, y: x - y)
    if nominal is not None:
        same = F.zip_with(a, b, lambda x, y: F.when(x == y, 0.0).otherwise(1.0))
        diff = F.zip_with(F.zip_with(diff, same, lambda d, s: F.struct(d.alias("d"), s.alias("s"))), nominal, lambda p, n: F.when(n, p["s"]).otherwise(p["d"]))
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("rows of different length"))).otherwise(diff)


def euclidean(a: Column, b: Column, nominal: Column | None = None) -> Column:
    return F.sqrt(F.aggregate(difference(a, b, nominal), F.lit(0.0), lambda s, d: s + d * d))


def manhattan(a: Column, b: Column, nominal: Column | None = None) -> Column:
    return F.aggregate(difference(a, b, nominal), F.lit(0.0), lambda s, d: s + F.abs(d))


def _distance(a: np.ndarray, b: np.ndarray, metric: str, nominal: np.ndarray | None) -> np.ndarray:
    """All distances between rows of a and rows of b."""
    out = np.empty((len(a), len(b)))
    for i, row in enumerate(a):
        d = row - b
        if nominal is not None and nominal.any():
            d[:, nominal] = (d[:, nominal] != 0).astype(float)
        out[i] = np.sqrt((d * d).sum(axis=1)) if metric == "euclidean" else np.abs(d).sum(axis=1)
    return out


def nearest(queries: DataFrame, rows: DataFrame, k: int, metric: str = "euclidean", keys: tuple[str, ...] = (), relation: str = "any", furthest: bool = False, blocks: int | None = None, digits: int = 9, nominal: list[bool] | str | None = None, must_have: bool = False) -> DataFrame:
    """(keys), id, label, n_id, n_label, dist, rank.

    Both tables: keys, draw (names a row; repeats of a row have several), id, label, features. A row is not its own
    neighbour (nor are its repeats). relation: any; hit (same label); miss (another label); each (k of every label).
    nominal: flags of the features, or the name of a column of both tables that has them as an array, alike in a group
    (see prep.nominal_flags). blocks: how many a group is cut into; None: by its size. Distances are rounded to ``digits`` before they are compared.
    must_have: raises where a query has fewer than k neighbours.
    """
    flagged = (lambda df: df.withColumn("_flags", F.col(nominal) if isinstance(nominal, str) else F.array(*map(F.lit, nominal)) if nominal else F.lit(None).cast("array<boolean>")))
    if blocks is None:
        parts = lambda df, name: df.groupBy(*keys).agg(F.ceil(F.count("*") / ROWS).cast("int").alias(name))
        a, b = parts(queries, "_nq"), parts(rows, "_nr")
        cuts = a.join(b, list(keys)) if keys else a.crossJoin(b)  # a row for each group; without keys, one
        cut = lambda df: df.join(cuts, list(keys)) if keys else df.crossJoin(F.broadcast(cuts))
    else:
        cut = lambda df: df.withColumns({"_nq": F.lit(blocks), "_nr": F.lit(blocks)})

    def side(df: DataFrame, q: bool) -> DataFrame:
        own, other = ("_nq", "_nr") if q else ("_nr", "_nq")
        df = cut(flagged(df.withColumn("label", F.col("label").cast("double"))).select(*keys, "draw", "id", "label", "features", "_flags", F.lit(q).alias("q")))
        df = df.withColumns({"_own": F.pmod(F.xxhash64("draw"), F.greatest(F.col(own), F.lit(1))).cast("int"), "_other": F.explode(F.sequence(F.lit(0), F.greatest(F.col(other), F.lit(1)) - 1))})
        return df.withColumns({"_i": F.col("_own" if q else "_other"), "_j": F.col("_other" if q else "_own")}).drop("_own", "_other", "_nq", "_nr")

    both = side(queries, True).unionByName(side(rows, False))
    kinds = dict(both.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in keys), f"draw {kinds['draw']}", f"id {kinds['id']}", "label double", f"n_draw {kinds['draw']}", f"n_id {kinds['id']}", "n_label double", "dist double"])

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf.q], pdf[~pdf.q]
        if not len(a) or not len(b):
            return pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})
        flags = pdf["_flags"].iloc[0]
        flags = None if flags is None else np.asarray(flags, bool)
        d = np.round(_distance(np.stack(a.features.to_numpy()), np.stack(b.features.to_numpy()), metric, flags), digits)
        same_row, same_label = a.id.to_numpy()[:, None] == b.id.to_numpy()[None, :], a.label.to_numpy()[:, None] == b.label.to_numpy()[None, :]
        allowed = ~same_row & {"any": True, "each": True, "hit": same_label, "miss": ~same_label}[relation]
        parts, labels = [], b.label.to_numpy()
        by_id = np.argsort(b.draw.to_numpy(), kind="stable")
        for value in np.unique(labels) if relation == "each" else [None]:
            ok = allowed & (labels == value)[None, :] if value is not None else allowed
            sign = -1.0 if furthest else 1.0
            order = by_id[np.argsort(np.where(ok, sign * d, np.inf)[:, by_id], axis=1, kind="stable")[:, :k]]
            i = np.repeat(np.arange(len(a)), order.shape[1])
            j = order.ravel()
            keep = ok[i, j]
            parts.append((i[keep], j[keep]))
        i, j = (np.concatenate(x) for x in zip(*parts, strict=True))
        out = {c: a[c].to_numpy()[i] for c in keys}
        out |= {"draw": a.draw.to_numpy()[i], "id": a.id.to_numpy()[i], "label": a.label.to_numpy()[i], "n_draw": b.draw.to_numpy()[j], "n_id": b.id.to_numpy()[j], "n_label": labels[j], "dist": d[i, j]}
        return pd.DataFrame(out)

    found = both.groupBy(*keys, "_i", "_j").applyInPandas(block, schema)
    per = Window.partitionBy(*keys, "draw", *(["n_label"] if relation == "each" else []))
    ranked = found.withColumn("rank", F.row_number().over(per.orderBy(F.desc("dist") if furthest else F.col("dist"), "n_draw"))).filter(F.col("rank") <= k)
    if must_have:
        short = F.max("rank").over(per) < k
        ranked = ranked.withColumn("rank", F.when(short, F.raise_error(F.lit(f"fewer than {k} neighbours")).cast("int")).otherwise(F.col("rank")))
    return ranked


def top_k(df: DataFrame, by: str, k: int, keys: tuple[str, ...] = (), furthest: bool = False, tie: str = "id") -> DataFrame:
    """The k rows of each group with the least (furthest: greatest) ``by``: what a bounded heap keeps, ties to the smaller id."""
    order = [F.desc(by) if furthest else F.asc(by), F.asc(tie)]
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)
