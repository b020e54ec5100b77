"""Connected components of an edge table, by alternating stars.

Every round hooks the larger neighbours of each node to its smallest one, first the neighbours above the node, then those
below. Edges are rows of a table all along; each round is written to the shared folder, so a lost executor costs at most a
round, and the number of rounds grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostsift.session import staged

MAX_ROUNDS = 60


def _least(edges: DataFrame) -> DataFrame:
    """Smallest neighbour of each ``u``."""
    return edges.groupBy("u").agg(F.min("v").alias("least"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("u", "least").alias("least"))
    return (
        both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u <> v").distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` point from the larger node ``u`` to the smaller ``v``."""
    least = _least(edges)
    moved = edges.join(least, "u").where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return moved.union(least.select("u", F.col("least").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``node``, ``component`` of every node of an edge: the smallest node that can be reached.

    Edges with a null end and loops are left out; repeated edges count once; no edges give no rows.
    """
    now = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where(
        F.col(u).isNotNull() & F.col(v).isNotNull() & (F.col(u) != F.col(v))
    )
    now = staged(now.distinct(), "edges")
    state = _state(now)
    for _ in range(MAX_ROUNDS):
        now = staged(_small_star(_large_star(now)), "edges")
        before, state = state, _state(now)
        if before == state:
            roots = now.select(F.col("v").alias("node")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                roots.select("node", F.col("node").alias("component"))
            )
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
