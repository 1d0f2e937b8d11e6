"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from readlake.llm.common import discard, materialize


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return least.select("u", F.col("m").alias("v")).union(down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(id, root) of every node of the edges (u, v); a root is its component's smallest id.

    Each step writes its edges to the shared folder. A hub's edges are one row each, and its
    smallest neighbour is a partially aggregated minimum. In the join of both one task reads the
    edges of a hub, a row of two numbers each; nothing holds them in memory.
    """
    at = materialize(edges.select("u", "v").filter("u <> v").distinct(), "edges")
    seen = _print(at)
    for _ in range(most):
        before, at = at, materialize(_small(_large(at)).distinct(), "edges")
        discard(before)
        now = _print(at)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return at.select(F.col("u").alias("id"), F.col("v").alias("root")).union(at.select("v", "v").distinct())
