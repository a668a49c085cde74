"""Communities of a weighted graph by modularity: local moves in parallel rounds, refinement, contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.operators.components import connected_components
from kinloom.plans.lineage import cut, written


def _undirected(edges: DataFrame) -> DataFrame:
    """``a <= b, w``: one row for each pair of nodes, its largest weight; null ends and weights of 0 or less are left out."""
    return edges.where("p1 is not null and p2 is not null and weight > 0").groupBy(F.least("p1", "p2").alias("a"), F.greatest("p1", "p2").alias("b")).agg(F.max("weight").cast("double").alias("w"))


def _directed(edges: DataFrame) -> DataFrame:
    """Both directions of each edge; a loop stands twice, as it adds twice to its node's degree."""
    return edges.select("a", "b", "w").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))


def modularity(edges: DataFrame, clusters: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row ``modularity`` of ``clusters (profile_id, cluster_id)`` on ``edges (p1, p2, weight)``.

    Nodes without a cluster are their own; a graph without edges has 0. Sums are combined before each shuffle.
    """
    both = _directed(_undirected(edges))
    own = lambda end, name: clusters.select(F.col("profile_id").alias(end), F.struct(F.lit(1).alias("named"), F.col("cluster_id").alias("id")).alias(name))
    alone = lambda end: F.struct(F.lit(0).alias("named"), F.col(end).alias("id"))
    placed = both.join(own("a", "x"), "a", "left").join(own("b", "y"), "b", "left").select(F.coalesce("x", alone("a")).alias("x"), F.coalesce("y", alone("b")).alias("y"), "w")
    per = placed.groupBy("x").agg(F.sum("w").alias("k"), F.sum(F.when(F.col("x") == F.col("y"), F.col("w")).otherwise(0.0)).alias("inside"))
    sums = per.agg(F.sum("k").alias("all"), F.sum("inside").alias("inside"), F.sum(F.col("k") * F.col("k")).alias("squares"))
    value = F.col("inside") / F.col("all") - resolution * F.col("squares") / F.col("all") / F.col("all")
    return sums.select(F.coalesce(F.when(F.col("all") > 0, value), F.lit(0.0)).alias("modularity"))


def _moved(edges: DataFrame, total: float, resolution: float, turns: int, least_gain: float = 1e-3) -> DataFrame:
    """``node, community`` after rounds in which a random half of the nodes goes to its best neighbouring community.

    Half of the nodes stay put so that two do not change places for ever. Rounds end when none wants to move or two in a
    row gain less than ``least_gain``; the labels of the best modularity are given.
    """
    ends = written(_directed(edges))
    links = ends.where("a <> b")
    loops = ends.where("a = b").agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("w")).first().w
    labels = written(ends.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k"))).withColumn("community", F.col("node"))
    best, score, slow = labels, float("-inf"), 0
    for turn in range(turns):
        sums = labels.groupBy("community").agg(F.sum("k").alias("of"), F.count("*").alias("n"))
        near = links.join(labels.select(F.col("node").alias("b"), "community"), "b").groupBy(F.col("a").alias("node"), F.col("community").alias("to")).agg(F.sum("w").alias("w"))
        own = labels.join(sums, "community")
        offers = near.join(own, "node").join(sums.select(F.col("community").alias("to"), F.col("of").alias("to_of"), F.col("n").alias("to_n")), "to")
        stays = F.col("to") == F.col("community")
        gain = F.round(F.col("w") - resolution * F.col("k") * (F.col("to_of") - F.when(stays, F.col("k")).otherwise(0.0)) / total, 9)
        swap = (F.col("n") == 1) & (F.col("to_n") == 1) & (F.col("to") > F.col("community"))
        rest = F.round(-resolution * F.col("k") * (F.first("of") - F.col("k")) / total, 9)
        chosen = offers.withColumn("gain", gain).groupBy("node", "k", "community").agg(
            F.max_by("to", F.when(~stays & ~swap, F.struct("gain", (-F.xxhash64("to")).alias("tie")))).alias("to"),
            F.max(F.when(~stays & ~swap, F.col("gain"))).alias("gain"),
            F.coalesce(F.max(F.when(stays, F.col("gain"))), rest).alias("now"),
            F.coalesce(F.sum(F.when(stays, F.col("w"))), F.lit(0.0)).alias("inside"),
        )
        wants = F.coalesce(F.col("gain") > F.col("now") + 1e-9, F.lit(False))
        decided = written(labels.join(chosen.withColumn("wants", wants).select("node", "to", "wants", "inside"), "node", "left"))
        per = decided.groupBy("community").agg(F.sum("k").alias("of"), F.coalesce(F.sum("inside"), F.lit(0.0)).alias("inside"), F.count_if("wants").alias("wants"))
        counts = per.agg(F.sum("inside").alias("inside"), F.sum(F.col("of") * F.col("of")).alias("squares"), F.sum("wants").alias("wants")).first()
        value = (counts.inside + loops) / total - resolution * counts.squares / total / total
        slow = 0 if value > score + least_gain else slow + 1
        if value > score:
            best, score = labels, value
        if not counts.wants or slow == 2:
            break
        active = F.coalesce("wants", F.lit(False)) & (F.pmod(F.xxhash64(F.lit(turn), "node"), F.lit(2)) == 0)
        labels = decided.select("node", "k", F.when(active, F.col("to")).otherwise(F.col("community")).alias("community"))
    return best.select("node", "community")


def _connected(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels divided where a community is not connected in itself."""
    end = lambda e: labels.select(F.col("node").alias(e), F.col("community").alias(f"of_{e}"))
    inside = edges.join(end("a"), "a").join(end("b"), "b").where("of_a = of_b")
    parts = connected_components(inside, "a", "b")
    return labels.join(parts, "node", "left").select("node", F.coalesce("component", "node").alias("community"))


def communities(edges: DataFrame, resolution: float = 1.0, connected: bool = False, turns: int = 16, most_levels: int = 8) -> DataFrame:
    """``profile_id, cluster_id`` of every node of ``edges (p1, p2, weight)``: communities of high modularity.

    In each level nodes move between communities, then a community becomes one node of the next level, until none
    joins another. With ``connected`` communities are divided into their connected parts before each contraction, so
    none hangs together by a node that has left. A larger ``resolution`` gives smaller communities. Named by their
    smallest node; repeated edges count once, by the largest weight; edges of weight 0 or less and null ends are left
    out; an empty table gives no rows. Work is joins and aggregations by node, so a hot node is divided by AQE.
    """
    now = written(_undirected(edges))
    total = 2 * (now.agg(F.sum("w")).first()[0] or 0.0)
    member = written(_directed(now).select(F.col("a").alias("profile_id"), F.col("a").alias("node")).distinct())
    nodes = member.count()
    for _ in range(most_levels if total else 0):
        labels = _moved(now, total, resolution, turns)
        labels = written(_connected(now, labels) if connected else labels)
        member = written(member.join(labels, "node").select("profile_id", F.col("community").alias("node")))
        end = lambda e: labels.select(F.col("node").alias(e), F.col("community").alias(f"of_{e}"))  # noqa: B023, E731
        now = written(now.join(end("a"), "a").join(end("b"), "b").groupBy(F.least("of_a", "of_b").alias("a"), F.greatest("of_a", "of_b").alias("b")).agg(F.sum("w").alias("w")))
        before, nodes = nodes, labels.select("community").distinct().count()
        if nodes == before:
            break
    least = member.groupBy("node").agg(F.min("profile_id").alias("cluster_id"))
    return member.join(least, "node").select("profile_id", "cluster_id")


def community_blocks(edges: DataFrame, resolution: float = 1.0, connected: bool = False) -> DataFrame:
    """Membership ``block_key, profile_id, source_id`` with a block for each community, as of one source."""
    return communities(edges, resolution, connected).select(F.col("cluster_id").cast("string").alias("block_key"), "profile_id", F.lit(0).alias("source_id"))


def resolution_sweep(edges: DataFrame, resolutions: list[float], connected: bool = False) -> DataFrame:
    """``resolution, clusters, modularity`` (at resolution 1) of the communities at each resolution."""
    own, rows = cut(edges.select("p1", "p2", "weight")), []
    for r in resolutions:
        found = cut(communities(own, r, connected))
        rows.append(found.agg(F.lit(float(r)).alias("resolution"), F.countDistinct("cluster_id").alias("clusters")).crossJoin(F.broadcast(modularity(own, found))))  # one row each
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out
