"""Connected components of an undirected edge list, by alternating star contraction.

Each round rewires every edge towards the smallest known node of its neighbourhood
(large star, then small star), so the number of rounds grows with the logarithm of the
longest chain. Rounds stop when the edge list no longer changes, never at a fixed count.
Ids are only compared, so any orderable type works (numbers near the type's limit, strings).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quire.session import ensure_checkpoint_dir


def _state(edges: DataFrame) -> tuple:
    """Row count and an order-free fingerprint of the edge list (one row to the driver)."""
    h = F.xxhash64("u", "v")
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"),
                  F.sum(F.pmod(h, F.lit(1000003))).alias("s")).first()
    return r["n"], r["x"], r["s"]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.where(F.col("v") > F.col("u")).join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node on an edge; component is the smallest node reachable.

    Edges with a null end and self loops are ignored. Nodes without an edge are not
    returned: the caller keeps them under their own id."""
    ensure_checkpoint_dir(edges.sparkSession)
    x, y = F.col(a), F.col(b)
    e = (edges.where(x.isNotNull() & y.isNotNull() & (x != y))
         .select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct().checkpoint())
    seen = _state(e)
    while seen[0]:
        e = _small_star(_large_star(e)).checkpoint()
        now = _state(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
