"""Connected components by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.plans.lineage import written


def connected_components(edges: DataFrame, a: str = "p1", b: str = "p2", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges``; the component is its smallest node.

    Self-loops keep their node; edges with a null end are ignored. Each round replaces the edges by stars and
    halves the distances, so the number of rounds grows with the logarithm of the longest path. Aggregates are
    combined before the shuffle, and the joins back are plain equi-joins that AQE can split where a node is hot.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    loops = pairs.where("u = v").select(F.col("u").alias("node")).distinct()
    now = written(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _fingerprint(now)
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.unionByName(lower.select("u", F.col("m").alias("v"))).distinct())
        before, state = state, _fingerprint(now)
        if state == before:
            break
    else:
        raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    alone = loops.join(stars.select("node").unionByName(roots.select("node")), "node", "left_anti")
    return stars.unionByName(roots).unionByName(alone.select("node", F.col("node").alias("component")))


def _fingerprint(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 40))).first()
    return int(row[0]), int(row[1] or 0)
