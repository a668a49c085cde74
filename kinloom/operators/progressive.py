"""Progressive schedules of comparisons as ranked relations, and their scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinloom.operators.blocking import global_position
from kinloom.operators.graph import both_ways


def profile_schedule(edges: DataFrame, k: int = 20, batch: int = 40, seed: int | None = None) -> DataFrame:
    """``phase, batch, weight, p1, p2``: first each profile's best later one, then top ``k`` by profile likelihood.

    Profiles rank by the mean weight of their edges to later ones; a batch of profiles emits its edges by weight,
    without pairs of the first phase and of profiles visited before. Edges of one weight follow the other end's id, or
    an order that ``seed`` draws.
    """
    ties = lambda c: [F.col(c)] if seed is None else [F.xxhash64(F.lit(seed), "p1", "p2"), F.col(c)]
    best = F.row_number().over(Window.partitionBy("p1").orderBy(F.desc("weight"), *ties("p2")))
    first = edges.withColumn("rn", best).where("rn = 1").select(F.lit(1).alias("phase"), F.lit(0).cast("long").alias("batch"), "weight", "p1", "p2")
    means = edges.groupBy(F.col("p1").alias("node")).agg(mean_weight().alias("mean"))
    rank = global_position(means, [F.desc("mean"), F.col("node")]).select("node", (F.col("position") + 1).alias("visit"))
    near = both_ways(edges).join(rank, "node").join(rank.select(F.col("node").alias("other"), F.col("visit").alias("seen")), "other", "left")
    top = near.withColumn("rn", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("weight"), *ties("other")))).where(F.col("rn") <= k)
    fresh = top.where("seen is null or seen > visit").join(first.select("p1", "p2"), ["p1", "p2"], "left_anti")
    second = fresh.select(F.lit(2).alias("phase"), F.expr(f"(visit - 1) div {batch}").alias("batch"), "weight", "p1", "p2")
    return first.unionByName(second)


def mean_weight():
    """The mean of ``weight`` to nine digits, alike in every run and rounded as DuckDB does.

    Halves are common among means of weights of nine digits, and a plain sum of doubles tips them by its order. What each
    addition loses is added at the end, so the sum is that of the doubles themselves, rounded once; weights are added in
    rising order, so that it is alike even where twice the digits do not hold it. The product is rounded, not the
    shortest decimal of the mean.
    """
    zero = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("lost"))

    def add(x, w):
        total = x["sum"] + w
        back = total - x["sum"]
        return F.struct(total.alias("sum"), (x["lost"] + ((x["sum"] - (total - back)) + (w - back))).alias("lost"))

    total = F.aggregate(F.array_sort(F.collect_list("weight")), zero, add, lambda x: x["sum"] + x["lost"])
    return F.round(total / F.count("weight") * 1e9) / 1e9


def within_budget(schedule: DataFrame, budget: int) -> DataFrame:
    """The first ``budget`` comparisons of a schedule, with ``position`` from 1."""
    placed = global_position(schedule, ["phase", "batch", F.desc("weight"), F.col("p1"), F.col("p2")])
    return placed.where(F.col("position") < budget).withColumn("position", F.col("position") + 1)


def neighbourhood_schedule(keys: DataFrame, window: int) -> DataFrame:
    """``p1, p2, weight``: profiles within ``window`` places of the sorted keys, by common / (places - common)."""
    placed = global_position(keys, ["block_key", "profile_id"])
    counts = placed.groupBy("profile_id").agg(F.count("*").alias("n"))
    ahead = placed.select(F.col("profile_id").alias("a"), F.explode(F.sequence(F.col("position") + 1, F.col("position") + window)).alias("position"))
    met = ahead.join(placed.select(F.col("profile_id").alias("b"), "position"), "position").where("a <> b")
    pairs = met.groupBy(F.least("a", "b").alias("p1"), F.greatest("a", "b").alias("p2")).agg(F.count("*").alias("c"))
    of = lambda p: counts.select(F.col("profile_id").alias(p), F.col("n").alias(f"n_{p}"))
    return pairs.join(of("p1"), "p1").join(of("p2"), "p2").select("p1", "p2", (F.col("c") / (F.col("n_p1") + F.col("n_p2") - F.col("c"))).alias("weight"))


def recall_auc(ranked: DataFrame, total: int, levels: tuple[int, ...] = (1, 5, 10, 20)) -> DataFrame:
    """``level, auc`` of a ranking ``(position from 1, hit)``: sum of matches so far over ``total`` for the first
    ``level * total`` places, over their number plus one. A hit at place r counts at every place from r on."""
    rows = ranked.where("hit = 1")
    out = [rows.where(F.col("position") <= n * total).agg(F.lit(n).alias("level"), (F.coalesce(F.sum(F.lit(n * total + 1) - F.col("position")), F.lit(0)) / total / (n * total + 1)).alias("auc")) for n in levels]
    result = out[0]
    for o in out[1:]:
        result = result.unionByName(o)
    return result
