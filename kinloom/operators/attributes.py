"""Attributes as things of their own: their token statistics, their clusters, and which of them are worth searching."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinloom.functions import text as X
from kinloom.operators.blocking import band_rows, banded_blocks, bands, block_stats, signatures
from kinloom.operators.components import connected_components
from kinloom.plans.lineage import cut


def attribute_tokens(profiles: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """``source_id, key, token, n``: how often each attribute holds each token, repeats counted."""
    bag = profiles.select("source_id", F.explode("attributes").alias("a")).select("source_id", "a.key", F.explode(X.words(F.col("a.value"))).alias("token"))
    return (bag.where(~F.col("key").isin(*exclude)) if exclude else bag).groupBy("source_id", "key", "token").agg(F.count("*").alias("n"))


def attribute_entropy(counted: DataFrame, normalised: bool = False) -> DataFrame:
    """``source_id, key, entropy``: Shannon entropy in bits of each attribute's tokens, over log2 of their number if normalised.

    Sums of ``n`` and ``n log n`` are enough, so tokens are combined before the shuffle.
    """
    n = F.col("n").cast("double")
    sums = counted.groupBy("source_id", "key").agg(F.sum(n).alias("all"), F.sum(n * F.log2(n)).alias("nlogn"), F.count("*").alias("kinds"))
    entropy = F.log2("all") - F.col("nlogn") / F.col("all")
    return sums.select("source_id", "key", (F.coalesce(F.try_divide(entropy, F.log2(F.col("kinds").cast("double"))), F.lit(0.0)) if normalised else entropy).alias("entropy"))


def similar_attributes(counted: DataFrame, hashes: int = 128, threshold: float = 0.3, clean: bool = True) -> DataFrame:
    """``a, b, similarity`` of attributes (hashes of source and key, ``a < b``) whose MinHash signatures reach the threshold.

    Only attributes that share a band are compared; with ``clean`` only those of different sources.
    """
    least = (F.min(F.xxhash64(F.lit(1000 + i), "token")) for i in range(hashes))
    signed = counted.groupBy("source_id", "key").agg(F.array(*least).alias("s")).select(F.xxhash64("source_id", "key").alias("node"), "source_id", "s")
    count = min(bands(hashes, threshold), hashes)
    rows = max(1, hashes // count)
    parts = F.array(*(F.struct(F.lit(b).alias("band"), F.xxhash64(F.slice("s", b * rows + 1, rows)).alias("h")) for b in range(hashes // rows)))
    banded = signed.select("*", F.explode(parts).alias("x"))
    a, b = (banded.select("x", *(F.col(c).alias(f"{c}_{e}") for c in ("node", "source_id", "s"))) for e in "ab")
    met = a.join(b, "x").where("node_a < node_b" + (" and source_id_a <> source_id_b" if clean else "")).dropDuplicates(["node_a", "node_b"])
    equal = F.aggregate(F.zip_with("s_a", "s_b", lambda p, q: (p == q).cast("int")), F.lit(0), lambda t, v: t + v)
    return met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), (equal / hashes).alias("similarity")).where(F.col("similarity") >= threshold)


def cluster_attributes(profiles: DataFrame, hashes: int = 128, threshold: float = 0.3, factor: float = 0.9, exclude: tuple[str, ...] = (), clean: bool = True, entropy: bool = True, normalised: bool = False) -> DataFrame:
    """``source_id, key, cluster_id, entropy`` for every attribute with a token.

    An attribute links with its partners of at least ``factor`` times its best similarity; clusters are the
    components, numbered from 0 by their smallest member; attributes without a link form cluster -1. A cluster's
    entropy is the mean of its members', or 1 without ``entropy``.
    """
    counted = attribute_tokens(profiles, exclude)
    near = similar_attributes(counted, hashes, threshold, clean)
    turn = lambda p, q: near.select(F.col(p).alias("node"), F.col(q).alias("other"), "similarity")
    best = turn("a", "b").unionAll(turn("b", "a")).withColumn("best", F.max("similarity").over(Window.partitionBy("node"))).where(F.col("similarity") >= factor * F.col("best"))
    own = attribute_entropy(counted, normalised).withColumn("node", F.xxhash64("source_id", "key"))
    placed = own.join(connected_components(best, "node", "other"), "node", "left")
    # one row for each cluster of attributes: as many as a schema has columns
    number = placed.where("component is not null").groupBy("component").agg(F.min(F.struct("source_id", "key")).alias("first"))
    number = number.select("component", (F.row_number().over(Window.orderBy("first")) - 1).alias("cluster_id"))
    named = placed.join(number, "component", "left").withColumn("cluster_id", F.coalesce("cluster_id", F.lit(-1)))
    return named.select("source_id", "key", "cluster_id", (F.avg("entropy").over(Window.partitionBy("cluster_id")) if entropy else F.lit(1.0)).alias("entropy"))


def blocked_profiles(profiles: DataFrame, start: float = 1.0, step: float = 0.05, hashes: int = 128, clean: bool = True) -> tuple[DataFrame, float]:
    """The profiles in a MinHash block that makes a comparison, at the first threshold from ``start`` down that has one.

    Gives that threshold too; where none does, it is the last one tried and no profile is left. Signatures are made
    once; a threshold whose bands are those of one tried before is passed over.
    """
    held = F.array_distinct(F.flatten(F.transform("attributes", lambda a: X.words(a["value"]))))
    signed = cut(signatures(profiles, held, hashes))
    tries = {band_rows(hashes, t): t for t in (start - k * step for k in reversed(range(max(1, round(start / step)))))}
    for threshold in sorted(tries.values(), reverse=True):
        membership = banded_blocks(signed, hashes, threshold)
        blocks = block_stats(membership, clean)
        if not blocks.isEmpty():
            break
    ids = membership.join(blocks, "block_key", "left_semi").select("profile_id").distinct()
    return profiles.join(ids, "profile_id", "left_semi"), threshold


def cluster_attributes_in_two_steps(profiles: DataFrame, hashes: int = 128, threshold: float = 0.3, start: float = 1.0, step: float = 0.05, factor: float = 1.0, exclude: tuple[str, ...] = (), clean: bool = True, entropy: bool = False) -> DataFrame:
    """:func:`cluster_attributes` of those profiles alone that :func:`blocked_profiles` keeps: likely matches show which attributes go together."""
    return cluster_attributes(blocked_profiles(profiles, start, step, clean=clean)[0], hashes, threshold, factor, exclude, clean, entropy)


def column_scores(df: DataFrame, columns: list[str], id_col: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``name, null_rate, mean_words, mean_score``: how well each column's values would find themselves by BM25.

    A value's score is that of its own words against it, over its number of words; a null or empty value counts in
    ``null_rate`` alone.
    """
    named = F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns))
    long = df.select(F.col(id_col).alias("id"), F.explode(named).alias("x")).select("id", "x.name", X.words(F.col("x.value")).alias("w"))
    base = long.groupBy("name").agg(F.count("*").alias("rows"), F.count_if(F.size("w") > 0).alias("held"), F.sum(F.size("w")).alias("words"))
    base = base.select("name", (1 - F.col("held") / F.col("rows")).alias("null_rate"), F.col("held").cast("double").alias("N"), F.try_divide("words", "held").alias("mean_words"))
    tf = long.select("name", "id", F.size("w").alias("dl"), F.explode("w").alias("token")).groupBy("name", "id", "dl", "token").agg(F.count("*").cast("double").alias("tf"))
    df_ = tf.groupBy("name", "token").agg(F.count("*").cast("double").alias("df"))
    part = F.log((F.col("N") + 0.5 - F.col("df")) / (F.col("df") + 0.5) + 1) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("mean_words"))) / F.col("dl")
    score = tf.join(df_, ["name", "token"]).join(F.broadcast(base), "name").groupBy("name").agg((F.sum(part) / F.first("N")).alias("mean_score"))
    return base.join(score, "name", "left").select("name", "null_rate", "mean_words", "mean_score")


def select_columns(df: DataFrame, columns: list[str], id_col: str, k: int, most_null: float = 0.5, most_words: float = 50.0) -> DataFrame:
    """The ``k`` columns of the highest mean score among those neither mostly null nor too long."""
    return column_scores(df, columns, id_col).where((F.col("null_rate") <= most_null) & (F.col("mean_words") <= most_words)).orderBy(F.desc("mean_score"), "name").limit(k)
