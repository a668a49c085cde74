"""Measures of blocks, pairs and clusters against true pairs, and training samples."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.operators.graph import FEATURES, valid


def feature_sets() -> list[tuple[int, tuple[str, ...]]]:
    """All non-empty feature sets, numbered from 1 by size, then in the order of the features; both degrees go together."""
    pair = {"numCompP1", "numCompP2"}
    every = (c for k in range(1, len(FEATURES) + 1) for c in combinations(FEATURES, k))
    return list(enumerate((c for c in every if pair <= set(c) or not pair & set(c)), 1))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _mean(a: str, b: str) -> Column:
    return _ratio(2.0 * F.col(a) * F.col(b), F.col(a) + F.col(b))


def blocking_quality(found: DataFrame, truth: DataFrame, profiles: DataFrame, clean: bool = False) -> DataFrame:
    """One row: ``reduction, completeness, quality, f1, rm`` of pairs ``(p1, p2)``.

    ``reduction`` is one less the share of all possible pairs, ``rm`` the harmonic mean of it and ``completeness``
    (true pairs found); ``quality`` is the share of found pairs that are true. Repeated pairs count once.
    """
    true = truth.select("p1", "p2").distinct()
    hit = found.select("p1", "p2").distinct().join(true.withColumn("hit", F.lit(1)), ["p1", "p2"], "left")
    sizes = profiles.groupBy("source_id").agg(F.countDistinct("profile_id").cast("double").alias("n"))
    n = F.sum("n")
    possible = (n * n - F.sum(F.col("n") * F.col("n"))) / 2 if clean else n * (n - 1) / 2
    one = hit.agg(F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"), F.count("*").alias("kept")).crossJoin(true.agg(F.count("*").alias("all"))).crossJoin(sizes.agg(possible.alias("possible")))
    shares = one.select((1 - _ratio(F.col("kept"), F.col("possible"))).alias("reduction"), _ratio(F.col("hits"), F.col("all")).alias("completeness"), _ratio(F.col("hits"), F.col("kept")).alias("quality"))
    return shares.withColumn("f1", _mean("completeness", "quality")).withColumn("rm", _mean("reduction", "completeness"))


def cluster_quality(clusters: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: ``matches, pairs, total, completeness, quality`` of the pairs inside clusters ``(profile_id, cluster_id)``.

    Pairs are counted from the clusters' sizes and true pairs by joining both ends, so no pair inside a cluster is made.
    """
    own = clusters.select("profile_id", "cluster_id").distinct()
    sizes = own.groupBy("cluster_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("pairs"))
    true = truth.select("p1", "p2").distinct()
    end = lambda p: own.select(F.col("profile_id").alias(p), F.col("cluster_id").alias(f"c_{p}"))
    together = true.join(end("p1"), "p1").join(end("p2"), "p2").where("c_p1 = c_p2").select("p1", "p2").distinct()
    one = together.agg(F.count("*").alias("matches")).crossJoin(sizes).crossJoin(true.agg(F.count("*").alias("total")))
    return one.select("matches", "pairs", "total", _ratio(F.col("matches"), F.col("total")).alias("completeness"), _ratio(F.col("matches"), F.col("pairs")).alias("quality"))


def cbs_histogram(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """``CBS, cnt``: true pairs by the number of their common blocks, 0 for those that no block holds."""
    joined = truth.select("p1", "p2").distinct().join(pairs.select("p1", "p2", "cbs"), ["p1", "p2"], "left")
    return joined.groupBy(F.coalesce("cbs", F.lit(0)).alias("CBS")).agg(F.count("*").alias("cnt"))


def blast_thresholds(scored: DataFrame, share: float = 0.35) -> DataFrame:
    """One row: ``low, high, mean`` of valid edges' thresholds (``share`` of both ends' best) and the edges ``retained``."""
    both = valid(scored).select("p_match", (share * (F.max("p_match").over(Window.partitionBy("p1")) + F.max("p_match").over(Window.partitionBy("p2")))).alias("t"))
    return both.agg(F.min("t").alias("low"), F.max("t").alias("high"), F.avg("t").alias("mean"), F.count_if(F.col("p_match") >= F.col("t")).alias("retained"))


def null_patterns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows ``n`` by which of the columns are null (``name_null`` booleans)."""
    return df.groupBy(*(F.col(c).isNull().alias(f"{c}_null") for c in columns)).agg(F.count("*").alias("n"))


def matched(pairs: DataFrame, profiles: DataFrame, tokens: Column, threshold: float) -> DataFrame:
    """``p1, p2, weight`` of the candidate pairs whose token sets have a Jaccard similarity of ``threshold`` or more."""
    sets = profiles.select("profile_id", F.array_distinct(tokens).alias("w"))
    end = lambda p: sets.select(F.col("profile_id").alias(p), F.col("w").alias(f"w_{p}"))
    both = pairs.select("p1", "p2").join(end("p1"), "p1").join(end("p2"), "p2")
    common = F.size(F.array_intersect("w_p1", "w_p2"))
    return both.select("p1", "p2", _ratio(common, F.size("w_p1") + F.size("w_p2") - common).alias("weight")).where(F.col("weight") >= threshold)


def balanced_split(edges: DataFrame, size: int, label: str = "is_match", seed: int = 1) -> DataFrame:
    """``edges`` with ``train``: true for ``size / 2`` edges of each label, drawn by a seeded hash of ``p1, p2``.

    The draw is a sampling operator; each label's training edges are found by a top-k, not by sorting all edges.
    """
    drawn = edges.select("p1", "p2", F.xxhash64(F.lit(seed), "p1", "p2").alias("_h"), label)
    picked = [drawn.where(F.col(label) == v).orderBy("_h", "p1", "p2").limit(size // 2).select("p1", "p2", F.lit(True).alias("train")) for v in (1, 0)]
    return edges.join(picked[0].unionByName(picked[1]).distinct(), ["p1", "p2"], "left").withColumn("train", F.coalesce("train", F.lit(False)))
