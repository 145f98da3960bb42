"""Connected components by alternating large and small stars; edges stay in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_kept_aside, kept_aside, materialize, skew_join


#: Edges of a node from which on its rows are worth splitting over tasks.
HOT = 1 << 17


def _state(edges: DataFrame) -> tuple:
    """Number and checksum of the stars' edges, and the most that one centre has."""
    by_centre = edges.groupBy("v").agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
    return tuple(by_centre.agg(F.sum("n"), F.sum("h"), F.max("n")).first())


def connected(edges: DataFrame, rounds: int = 100, hot: int = HOT) -> DataFrame:
    """edges: a, b (of any type with an order). Returns node, root for every node that is not its component's smallest.

    A large star links a node's greater neighbours to the smallest of all; a small star its smaller neighbours and
    itself. Both keep components, and when nothing changes each component is a star around its smallest node. The
    number of rounds grows with the logarithm of a component's size; raises if ``rounds`` are not enough. Both steps are
    written, so that a round does not carry the plans of those before; with a node of ``hot`` edges or more its minima are
    too, so that joins can split it.
    """
    spark, had = edges.sparkSession, set(kept_aside())
    at = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _state(at)
    settled = not state[0]
    for _ in range(rounds):
        if settled:
            return at.select(F.col("u").alias("node"), F.col("v").alias("root"))
        join = skew_join if state[2] >= hot else (lambda rows, few, on: rows.join(few, list(on)))
        old, parts = [p for p in kept_aside() if p not in had], max(8, state[0] // (HOT // 2))  # no more files than the edges are worth
        both = at.unionByName(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = materialize(join(both.filter("v > u"), low, ("u",)).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().coalesce(parts))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        at = materialize(join(large, low, ("u",)).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct().coalesce(parts))
        drop_kept_aside(spark, old)
        before, state = state, _state(at)
        settled = state == before
    raise RuntimeError(f"components have not settled in {rounds} rounds")
