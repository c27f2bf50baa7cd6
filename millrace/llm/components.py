"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hinted, settle


def _least(edges: DataFrame) -> DataFrame:
    """Per node u, the smallest of its neighbours."""
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def connected_components(edges: DataFrame, max_rounds: int = 40) -> tuple[DataFrame, int]:
    """Columns u, v (long) in; node, component out, for every node with an edge, and their number; component is the smallest node reachable.

    Each step shuffles on node ids; a hub's rows are pre-aggregated by min and its join is one that adaptive
    execution can split; only tables counted as small are broadcast. No edge reaches the driver, only one row of counts a round. Loops (u = v) and repeated
    edges are ignored; an empty table gives an empty table.
    """
    edges, n = settle(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        parts = max(1, -(-n // 50_000))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both).select("u", F.least("u", "m").alias("m")).coalesce(parts)
        large = both.where("v > u").join(hinted(least, 2 * n), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(parts)
        small = large.join(hinted(_least(large).coalesce(parts), n), "u").coalesce(parts)
        edges, n = settle(
            small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        )
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return settle(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots))
