"""The graph of co-occurring profiles: pairs, weights, features and pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.operators.blocking import global_position


def pairs(membership: DataFrame, clean: bool = False) -> DataFrame:
    """``p1 < p2`` with ``cbs`` (common blocks), ``raccb`` and ``rs`` (sums of 1 / comparisons and 1 / size).

    With an ``entropy`` in ``membership`` also its sum over the common blocks. Purge first: the rows joined are the
    comparisons of the blocks.
    """
    kept = [c for c in ("size", "comparisons", "entropy") if c in membership.columns]
    a, b = (membership.select("block_key", *kept, F.col("profile_id").alias(p), F.col("source_id").alias(f"s_{p}")) for p in ("p1", "p2"))
    met = a.join(b.drop(*kept), "block_key").where("p1 < p2" + (" and s_p1 <> s_p2" if clean else ""))
    return met.groupBy("p1", "p2").agg(F.count("*").alias("cbs"), F.sum(1 / F.col("comparisons")).alias("raccb"), F.sum(1 / F.col("size")).alias("rs"), *(F.sum(c).alias(c) for c in kept[2:]))


def node_stats(membership: DataFrame) -> DataFrame:
    """By profile: blocks, sums of 1 / size, 1 / comparisons and comparisons, and redundant comparisons."""
    return membership.groupBy("profile_id").agg(F.count("*").alias("blocks"), F.sum(1 / F.col("size")).alias("inv_size"), F.sum(1 / F.col("comparisons")).alias("inv_comparisons"), F.sum("comparisons").alias("comparisons"), F.sum(F.col("size") - 1).alias("redundant"))


def degrees(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("p1").alias("profile_id")).unionAll(edges.select(F.col("p2").alias("profile_id")))
    return both.groupBy("profile_id").agg(F.count("*").alias("degree"))


def with_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``edges`` with the node columns of both ends, as ``name_1`` and ``name_2``."""
    for end in ("1", "2"):
        edges = edges.join(nodes.select(*(F.col(c).alias(f"p{end}" if c == "profile_id" else f"{c}_{end}") for c in nodes.columns)), f"p{end}")
    return edges


def weighted(edges: DataFrame, membership: DataFrame, scheme: str, use_entropy: bool = False) -> DataFrame:
    """``p1, p2, weight`` by cbs, js, ecbs, ejs, arcs or chi2, times the edge's ``entropy`` if asked."""
    total = membership.agg(F.countDistinct("block_key").cast("double").alias("b_all"))
    joined = with_ends(edges, node_stats(membership).select("profile_id", "blocks")).crossJoin(F.broadcast(total))
    c, i, j, b = (F.col(x).cast("double") for x in ("cbs", "blocks_1", "blocks_2", "b_all"))
    js = c / (i + j - c)
    if scheme == "ejs":
        joined = with_ends(joined, degrees(edges)).crossJoin(F.broadcast(edges.agg(F.count("*").cast("double").alias("e_all"))))
        weight = js * F.log10(F.col("e_all") / F.col("degree_1")) * F.log10(F.col("e_all") / F.col("degree_2"))
    elif scheme == "chi2":
        seen = ((c, j, i), (j - c, j, b - i), (i - c, b - j, i), (b - (i + j - c), b - j, b - i))
        weight = sum((F.coalesce(F.try_divide((o - r * k / b) * (o - r * k / b), r * k / b), F.lit(0.0)) for o, r, k in seen), F.lit(0.0))
    else:
        weight = {"cbs": c, "js": js, "ecbs": c * F.log10(b / i) * F.log10(b / j), "arcs": F.col("raccb")}[scheme]
    return joined.select("p1", "p2", (weight * F.col("entropy") if use_entropy else weight).alias("weight"))


def features(edges: DataFrame, membership: DataFrame, truth: DataFrame | None = None) -> DataFrame:
    """The nine features of every edge, with ``is_match`` where ``truth (p1, p2)`` is given."""
    nodes = node_stats(membership).join(degrees(edges), "profile_id")
    totals = membership.select("block_key", "comparisons").distinct().agg(F.count("*").cast("double").alias("b_all"), F.sum("comparisons").cast("double").alias("c_all"))
    x = with_ends(edges, nodes).crossJoin(F.broadcast(totals))
    out = x.select(
        "p1", "p2",
        (F.col("cbs") * F.log(F.col("b_all") / F.col("blocks_1")) * F.log(F.col("b_all") / F.col("blocks_2"))).alias("cfibf"),
        F.greatest("raccb", F.lit(1e-6)).alias("raccb"),
        F.try_divide("cbs", F.col("redundant_1") + F.col("redundant_2") - F.col("cbs")).alias("js"),
        F.col("degree_1").alias("numCompP1"), F.col("degree_2").alias("numCompP2"), "rs",
        (F.col("cbs") / (F.col("blocks_1") + F.col("blocks_2") - F.col("cbs")) * F.log(F.col("c_all") / F.col("comparisons_1")) * F.log(F.col("c_all") / F.col("comparisons_2"))).alias("aejs"),
        F.try_divide("rs", F.col("inv_size_1") + F.col("inv_size_2") - F.col("rs")).alias("nrs"),
        F.try_divide("raccb", F.col("inv_comparisons_1") + F.col("inv_comparisons_2") - F.col("raccb")).alias("wjs"),
    )
    if truth is None:
        return out
    return out.join(truth.select("p1", "p2", F.lit(1).alias("is_match")), ["p1", "p2"], "left").withColumn("is_match", F.coalesce("is_match", F.lit(0)))


def both_ways(edges: DataFrame) -> DataFrame:
    turn = lambda a, b: edges.select(F.col(a).alias("node"), F.col(b).alias("other"), "p1", "p2", "weight")
    return turn("p1", "p2").unionAll(turn("p2", "p1"))


def wep(edges: DataFrame) -> DataFrame:
    """Edges at or over the mean weight."""
    return edges.join(F.broadcast(edges.agg(F.avg("weight").alias("mean"))), F.col("weight") >= F.col("mean")).drop("mean")


def wnp(edges: DataFrame, mode: str = "or", threshold: str = "avg", chi2_divider: float | None = None) -> DataFrame:
    """Edges at or over the threshold of one end (or) or both (and): the node's mean, or half its maximum.

    With ``chi2_divider`` one threshold for both ends, the root of the sum of squares over the divider.
    """
    limit = (F.avg("weight") if threshold == "avg" else F.max("weight") / 2).alias("limit")
    nodes = both_ways(edges).groupBy(F.col("node").alias("profile_id")).agg(limit)
    x, w = with_ends(edges, nodes), F.col("weight")
    if chi2_divider:
        keep: Column = w >= F.sqrt(F.col("limit_1") * F.col("limit_1") + F.col("limit_2") * F.col("limit_2")) / chi2_divider
    else:
        keep = (w >= F.col("limit_1")) | (w >= F.col("limit_2")) if mode == "or" else (w >= F.col("limit_1")) & (w >= F.col("limit_2"))
    return x.where(keep).select(*edges.columns)


def _heaviest(edges: DataFrame, weight: str, keep: int) -> DataFrame:
    return global_position(edges, [F.desc(weight), F.col("p1"), F.col("p2")]).where(F.col("position") < keep).select(*edges.columns)


def cep(edges: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` heaviest edges, ties by ids. Their number may grow with the edges: they are found by ranges of the order."""
    return _heaviest(edges, "weight", keep)


def cnp(edges: DataFrame, k: int, mode: str = "or") -> DataFrame:
    """Edges among the ``k`` heaviest of one end (or) or of both (and)."""
    top = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("weight"), "other"))
    hits = both_ways(edges).withColumn("rn", top).where(F.col("rn") <= max(1, k)).groupBy("p1", "p2").agg(F.count("*").alias("hits"), F.first("weight").alias("weight"))
    return hits.where(F.col("hits") >= (1 if mode == "or" else 2)).select("p1", "p2", "weight")


def cardinality(membership: DataFrame) -> DataFrame:
    """One row: ``cep_k``, half the sum of block sizes, and ``cnp_k``, blocks a profile less one (at least 1)."""
    sums = membership.agg(F.count("*").alias("n"), F.countDistinct("profile_id").alias("p"))
    return sums.selectExpr("n div 2 as cep_k", "greatest(1, cast(floor(n / p - 1) as bigint)) as cnp_k")


# pruning of scored edges (p1, p2, p_match, ...) -----------------------------------------------------------------------


def valid(scored: DataFrame) -> DataFrame:
    return scored.where("p_match >= 0.5")


def supervised(scored: DataFrame, algorithm: str, k: int = 1) -> DataFrame:
    """bcl, wep, wnp, rwnp, blast, cep, cnp or rcnp over scored edges; all columns stay."""
    if algorithm == "bcl":
        return scored.where("pred = 1")
    edges, p = valid(scored), F.col("p_match")
    by1, by2 = Window.partitionBy("p1"), Window.partitionBy("p2")
    if algorithm == "wep":
        return edges.join(F.broadcast(edges.agg(F.avg("p_match").alias("_t"))), p >= F.col("_t")).drop("_t")
    if algorithm == "cep":
        return _heaviest(edges, "p_match", k)
    if algorithm == "blast":
        both = edges.withColumn("_a", F.max("p_match").over(by1)).withColumn("_b", F.max("p_match").over(by2))
        return both.where(p >= 0.35 * (F.col("_a") + F.col("_b"))).drop("_a", "_b")
    if algorithm in ("wnp", "rwnp"):
        both = edges.withColumn("_a", F.avg("p_match").over(by1)).withColumn("_b", F.avg("p_match").over(by2))
        one, two = p >= F.col("_a") - 1e-12, p >= F.col("_b") - 1e-12  # equal weights are not under their mean
    else:
        rank = lambda w, other: F.row_number().over(w.orderBy(F.desc("p_match"), other))
        both = edges.withColumn("_a", rank(by1, "p2")).withColumn("_b", rank(by2, "p1"))
        one, two = F.col("_a") <= k, F.col("_b") <= k
    return both.where(one & two if algorithm.startswith("r") else one | two).drop("_a", "_b")


def quality(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: ``matches, retained, total, recall, precision, f1`` of pairs against true pairs (p1, p2)."""
    hit = found.select("p1", "p2").distinct().join(truth.select("p1", "p2", F.lit(1).alias("hit")), ["p1", "p2"], "left")
    counts = hit.agg(F.coalesce(F.sum("hit"), F.lit(0)).alias("matches"), F.count("*").alias("retained")).crossJoin(truth.agg(F.count("*").alias("total")))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    both = counts.withColumn("recall", ratio("matches", "total")).withColumn("precision", ratio("matches", "retained"))
    return both.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("recall") * F.col("precision"), F.col("recall") + F.col("precision")), F.lit(0.0)))


def threshold_sweep(scored: DataFrame, score: str = "p_match", label: str = "is_match", steps: int = 20) -> DataFrame:
    """``threshold, retained, matches, recall, precision, f1`` for the thresholds 0, 1 / steps, ... 1; null scores are never retained.

    Rows are counted by the number of thresholds that they reach, so only ``steps + 2`` rows are shuffled.
    """
    levels = [k / steps for k in range(steps + 1)]
    reached = F.when(F.col(score).isNull(), 0).otherwise(F.size(F.filter(F.array(*map(F.lit, levels)), lambda t: t <= F.col(score))))
    counted = scored.groupBy(reached.alias("k")).agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("hit"))
    given = scored.sparkSession.createDataFrame([(k + 1, t) for k, t in enumerate(levels)], "k int, threshold double")
    every = given.unionByName(scored.sparkSession.createDataFrame([(0, None)], "k int, threshold double")).join(counted, "k", "left").na.fill(0, ["n", "hit"])
    down = Window.orderBy(F.desc("k"))
    sums = every.select("threshold", F.sum("n").over(down).alias("retained"), F.sum("hit").over(down).alias("matches"), F.sum("hit").over(Window.partitionBy()).alias("total"))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("matches"), F.col("retained") + F.col("total")), F.lit(0.0))
    return sums.where("threshold is not null").select("threshold", "retained", "matches", ratio("matches", "total").alias("recall"), ratio("matches", "retained").alias("precision"), f1.alias("f1"))


FEATURES = ("cfibf", "raccb", "js", "numCompP1", "numCompP2", "rs", "aejs", "nrs", "wjs")


def match_probabilities(edges: DataFrame, labelled: DataFrame, columns: tuple[str, ...] = FEATURES, label: str = "is_match") -> DataFrame:
    """``edges`` with ``p_match`` and ``pred`` by logistic regression on ``columns``, fitted to all of ``labelled``.

    Nulls count as 0. ``labelled`` needs both labels; sample it beforehand for a small training set.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    filled = lambda df: df.withColumn("_x", F.struct(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"_{c}") for c in columns))).select("*", "_x.*").drop("_x")
    model = Pipeline(stages=[VectorAssembler(inputCols=[f"_{c}" for c in columns], outputCol="_features"), LogisticRegression(featuresCol="_features", labelCol=label, probabilityCol="_probability", predictionCol="_prediction", rawPredictionCol="_raw", maxIter=100)])
    scored = model.fit(filled(labelled.where(F.col(label).isNotNull()))).transform(filled(edges))
    p = vector_to_array("_probability")[1]
    return scored.select(*edges.columns, p.alias("p_match"), F.col("_prediction").cast("int").alias("pred"))
