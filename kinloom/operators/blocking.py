"""Block building: membership tables ``(block_key, profile_id, source_id)`` and their cleaning."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.plans.lineage import cut


def blocks_by_key(profiles: DataFrame, keys: Column, exclude: tuple[str, ...] = (), unique: bool = True) -> DataFrame:
    """Distinct membership of profiles in the blocks of their keys (any array expression).

    Keys are made distinct in their row, so nothing is shuffled here. Profiles that stand in several rows need
    ``unique=False``, which shuffles the memberships once.
    """
    rows = profiles.select(F.explode(F.array_distinct(keys)).alias("block_key"), "profile_id", "source_id").where("block_key <> ''")
    rows = rows.where(~F.col("block_key").isin(*exclude)) if exclude else rows
    return rows if unique else rows.distinct()


def block_stats(membership: DataFrame, clean: bool = False) -> DataFrame:
    """``block_key, size, comparisons``: ordered pairs of profiles, or pairs of profiles of different sources."""
    if not clean:
        return membership.groupBy("block_key").agg(F.count("*").alias("size")).where("size > 1").withColumn("comparisons", F.col("size") * (F.col("size") - 1))
    by = membership.groupBy("block_key", "source_id").agg(F.count("*").alias("n")).groupBy("block_key").agg(F.sum("n").alias("size"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    return by.select("block_key", "size", F.expr("(size * size - squares) div 2").alias("comparisons")).where("comparisons > 0")


def sorted_neighbourhood(keys: DataFrame, window: int) -> DataFrame:
    """Blocks of ``window`` neighbours in the order of ``(block_key, profile_id)``: ``block_id, profile_id, source_id``.

    The global position is found range by range, so no task sorts all rows.
    """
    placed = global_position(keys, ["block_key", "profile_id"])
    spread = placed.select("profile_id", "source_id", F.explode(F.sequence(F.greatest(F.col("position") - window + 1, F.lit(0)), F.col("position"))).alias("block_id"))
    sizes = spread.groupBy("block_id").agg(F.countDistinct("profile_id").alias("n")).where("n > 1").select("block_id")
    return spread.join(sizes, "block_id").distinct()


def global_position(df: DataFrame, order: list[str | Column]) -> DataFrame:
    """``df`` with ``position`` from 0 in the total order of ``order``; rows alike in it follow each other in any order.

    Rows are dealt by sampled ranges of the order and sorted in each; a range's first position is the count of those
    before it. The ranges are as even as the order's values are distinct.
    """
    bits = 33  # ids of a partition's rows begin at its number, shifted by so many bits
    taken = set(df.columns)
    at = next(n for n in (f"_{i}" for i in range(len(taken) + 1)) if n not in taken)
    ranked = cut(df.orderBy(*order).withColumn(at, F.monotonically_increasing_id()))
    counts = ranked.groupBy(F.shiftright(at, bits).alias("range")).agg(F.count("*").alias("n"))
    first = {r["range"]: r["n"] for r in counts.collect()}
    starts, total = {}, 0
    for k in sorted(first):
        starts[k], total = total, total + first[k]
    if not starts:
        return ranked.withColumn("position", F.col(at)).drop(at)
    before = F.element_at(F.create_map(*(F.lit(x) for pair in starts.items() for x in pair)), F.shiftright(at, bits))
    return ranked.withColumn("position", before + F.col(at).bitwiseAND((1 << bits) - 1)).drop(at)


def minhash(tokens: Column, hashes: int, seed: int = 7) -> Column:
    """Signature of ``hashes`` minima over a token array; null without tokens."""
    def least(salt: int) -> Column:
        return F.array_min(F.transform(tokens, lambda t: F.xxhash64(F.lit(salt), t)))

    minima = F.array(*(least(seed * 1000 + i) for i in range(hashes)))
    return F.when(F.size(tokens) > 0, minima)


def bands(hashes: int, threshold: float) -> int:
    """One more than the most bands ``b`` with ``(1/b) ** (b/hashes)`` at or over the threshold."""
    fit = [b for b in range(1, hashes + 1) if (1 / b) ** (b / hashes) >= threshold]
    return max(fit, default=1) + 1


def lsh_blocks(profiles: DataFrame, tokens: Column, hashes: int = 64, threshold: float = 0.5) -> DataFrame:
    """Membership by equal signature bands."""
    return banded_blocks(signatures(profiles, tokens, hashes), hashes, threshold)


def signatures(profiles: DataFrame, tokens: Column, hashes: int) -> DataFrame:
    """``profile_id, source_id, s``: MinHash signatures of the profiles that have tokens."""
    return profiles.select("profile_id", "source_id", minhash(tokens, hashes).alias("s")).where("s is not null")


def band_rows(hashes: int, threshold: float) -> int:
    """Minima of a signature that a band holds."""
    return max(1, hashes // bands(hashes, threshold))


def banded_blocks(signed: DataFrame, hashes: int, threshold: float) -> DataFrame:
    """Membership by equal bands of :func:`signatures`."""
    count, rows = bands(hashes, threshold), band_rows(hashes, threshold)
    keys = F.array(*(F.concat(F.lit(f"{b}_"), F.xxhash64(F.slice("s", b * rows + 1, rows)).cast("string")) for b in range(min(count, math.ceil(hashes / rows)))))
    return blocks_by_key(signed, keys)


def bounded_blocks(membership: DataFrame, most: int | None = None, least: int = 2) -> DataFrame:
    """Membership in the blocks of ``least`` to ``most`` profiles; no upper bound unless one is asked for."""
    sizes = membership.groupBy("block_key").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return membership.join(sizes.where(F.col("n") <= most) if most is not None else sizes, "block_key", "left_semi")


def block_entropy(membership: DataFrame, per_profile: bool = False) -> DataFrame:
    """``block_key, entropy``: Shannon entropy in nats of the blocks that a block's profiles stand in, over their number.

    With ``per_profile`` over the block's size too. A profile's blocks meet pairwise, so clean the blocks beforehand.
    """
    own = membership.select("block_key", "profile_id")
    met = own.join(own.withColumnRenamed("block_key", "other"), "profile_id").groupBy("block_key", "other").agg(F.count("*").cast("double").alias("n"))
    # a block meets itself once for each of its profiles
    sums = met.groupBy("block_key").agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.log("n")).alias("nlogn"), F.max(F.when(F.col("block_key") == F.col("other"), F.col("n"))).alias("size"))
    entropy = (F.log("all") - F.col("nlogn") / F.col("all")) / F.col("all")
    return sums.select("block_key", (entropy / F.col("size") if per_profile else entropy).alias("entropy"))


def purge_level(blocks: DataFrame, smooth: float = 1.0) -> DataFrame:
    """One row ``level``: blocks of more comparisons are purged (null where all blocks have the same number)."""
    levels = blocks.groupBy("comparisons").agg(F.sum("comparisons").alias("c"), F.sum("size").alias("s"))
    up = Window.orderBy("comparisons")
    upto = up.rowsBetween(Window.unboundedPreceding, 0)
    sums = levels.select("comparisons", F.sum("c").over(upto).alias("cc"), F.sum("s").over(upto).alias("bc"))
    next_ = sums.select("comparisons", "cc", "bc", F.row_number().over(up).alias("at"), *(F.lead(c).over(up).alias(f"next_{c}") for c in ("comparisons", "cc", "bc")))
    stop = F.col("bc").cast("double") * F.col("next_cc") < smooth * F.col("cc").cast("double") * F.col("next_bc")
    return next_.agg(F.coalesce(F.max(F.when(stop, F.col("next_comparisons"))), F.max(F.when(F.col("at") == 2, F.col("comparisons")))).alias("level"))


def purge(membership: DataFrame, blocks: DataFrame, smooth: float = 1.0) -> DataFrame:
    """Membership in the blocks that purging leaves."""
    kept = blocks.join(F.broadcast(purge_level(blocks, smooth)), F.col("comparisons") <= F.col("level")).select("block_key", "size", "comparisons")
    return membership.join(kept, "block_key")


def filter_blocks_top(purged: DataFrame, ratio: float = 0.8, least: int = 1) -> DataFrame:
    """Each profile's ``max(least, round(n * ratio))`` smallest blocks, ties by key; a hard top, unlike :func:`filter_blocks`."""
    own = Window.partitionBy("profile_id")
    ranked = purged.withColumn("n", F.count("*").over(own)).withColumn("rn", F.row_number().over(own.orderBy("comparisons", "block_key")))
    return ranked.where(F.col("rn") <= F.greatest(F.lit(least), F.bround(F.col("n") * F.lit(ratio)).cast("int"))).select("block_key", "profile_id", "source_id")


def filter_blocks(purged: DataFrame, ratio: float = 0.8) -> DataFrame:
    """Each profile's smallest blocks: those up to the comparisons of its ``max(1, round(n * ratio))``-th; ties stay."""
    own = Window.partitionBy("profile_id")
    ranked = purged.withColumn("n", F.count("*").over(own)).withColumn("rn", F.row_number().over(own.orderBy("comparisons", "block_key")))
    at = F.greatest(F.lit(1), F.bround(F.col("n") * F.lit(ratio)).cast("int"))
    limit = F.max(F.when(F.col("rn") == at, F.col("comparisons"))).over(own)
    return ranked.withColumn("limit", limit).where("comparisons <= limit").select("block_key", "profile_id", "source_id")


def clean_blocks(profiles: DataFrame, keys: Column, smooth: float = 1.0, ratio: float = 0.8, clean: bool = False) -> DataFrame:
    """Key blocking, purging and filtering in one plan: membership with the block's final size and comparisons."""
    membership = blocks_by_key(profiles, keys)
    kept = filter_blocks(purge(membership, block_stats(membership, clean), smooth), ratio)
    return kept.join(block_stats(kept, clean), "block_key")


def cluster_blocks(profiles: DataFrame, clusters: DataFrame, words: Callable[[Column], Column], default_entropy: float = 1.0, drop_default: bool = False) -> DataFrame:
    """Token blocks by attribute cluster: key ``token_cluster`` and its entropy; attributes without one go to -1.

    With ``drop_default`` cluster -1 makes no blocks.

    ``clusters (key, cluster_id, entropy)``, with a ``source_id`` where sources differ, is joined as it is; AQE
    broadcasts it where it is small.
    """
    bag = profiles.select("profile_id", "source_id", F.explode("attributes").alias("a")).select("profile_id", "source_id", "a.key", F.explode(words(F.col("a.value"))).alias("token"))
    return _placed_in(bag, clusters, drop_default).select("block_key", "profile_id", "source_id", F.coalesce("entropy", F.lit(default_entropy)).alias("entropy")).distinct()


def _placed_in(bag: DataFrame, clusters: DataFrame, drop_default: bool) -> DataFrame:
    placed = bag.join(clusters, [c for c in ("source_id", "key") if c in clusters.columns], "left")
    placed = placed.where("cluster_id >= 0") if drop_default else placed
    return placed.withColumn("block_key", F.concat_ws("_", "token", F.coalesce("cluster_id", F.lit(-1)).cast("string")))


def cluster_block_attributes(profiles: DataFrame, clusters: DataFrame, words: Callable[[Column], Column], drop_default: bool = False) -> DataFrame:
    """``block_key, profile_id, attributes``: by which attributes (``source_key``, sorted) a profile is in a block of :func:`cluster_blocks`."""
    bag = profiles.select("profile_id", "source_id", F.explode("attributes").alias("a")).select("profile_id", "source_id", "a.key", F.explode(words(F.col("a.value"))).alias("token"))
    named = F.concat_ws("_", F.col("source_id").cast("string"), "key")
    return _placed_in(bag, clusters, drop_default).groupBy("block_key", "profile_id").agg(F.array_sort(F.collect_set(named)).alias("attributes"))
