"""Proportional stratified interleaving, in DataFrame operations only.

Rows of each source are ranked in a seeded order, all rows are sorted by fractional rank ``(2 * rank + 1) / (2 * n)``
and the order is cut into shards of equal counts, so every shard holds each source in its share of the whole.

No source meets in one task: a row's hash names one of many equal buckets of its source, only the bucket counts are
summed in order (at most ``2 ** MOST_BITS`` a source), and rows are ranked inside their bucket. The global order is
cut in the same way by fractional rank. Buckets grow in number with the rows, up to ``2 ** MOST_BITS`` of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.plans.lineage import cut

SHARDS, SEED, BUCKET, MOST_BITS = 24, 29, 4096, 18


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, stratum, size, text_crc32, shard, slot`` and the columns of ``carry`` as ``carried_<name>``, a row for each
    row of ``docs``.

    ``size`` is the UTF-8 length of the text (null: 0) plus 8, ``slot`` the place in the shard, gapless from 0; shard
    counts differ by one at the most. A null source is a source of its own. Rows alike in id and text share a hash
    and follow each other in rank. An empty table gives no rows.
    """
    raw = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("stratum"),
        (F.octet_length(raw) + 8).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        *(F.col(c).alias(f"carried_{c}") for c in carry),
    ).withColumn("h", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text_crc32"), 1))
    base = cut(base)
    total = base.count()
    bits = min(MOST_BITS, max(0, math.ceil(math.log2(max(1, total) / BUCKET)))) if total else 0
    tie = ["h", "doc_id", "text_crc32", "size"]

    rows = base.withColumn("bucket", F.shiftrightunsigned("h", 63 - bits) if bits else F.lit(0).cast("long"))
    counts = rows.groupBy("stratum", "bucket").agg(F.count("*").alias("n"))
    by_source = Window.partitionBy("stratum")
    offsets = counts.select("stratum", "bucket", _before("n", by_source.orderBy("bucket")).alias("before"), F.sum("n").over(by_source).alias("of"))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("stratum", "bucket").orderBy(*tie)) - 1
    ranked = rows.join(offsets, ["stratum", "bucket"]).withColumn("share", (2 * rank + 1) / (2 * F.col("of")))
    ranked = cut(ranked.withColumn("slice", F.floor(F.col("share") * (1 << bits))).drop("bucket", "before", "of"))

    slices = ranked.groupBy("slice").agg(F.count("*").alias("n"))
    starts = slices.select("slice", _before("n", Window.orderBy("slice")).alias("before"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("slice").orderBy("share", "stratum", *tie)) - 1
    placed = ranked.join(starts, "slice").withColumn("place", place)
    number = F.expr(f"place * {shards}L div {max(1, total)}L")
    first = F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")
    return placed.withColumn("shard", number).select("doc_id", "stratum", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("place") - first).alias("slot"), *(F.col(f"carried_{c}") for c in carry))


def _before(column: str, window) -> Column:
    return F.coalesce(F.sum(column).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def write_shards(docs: DataFrame, path: str, rows_per_file: int = 100_000, **options) -> None:
    """Write the rows of ``docs`` as one Parquet folder ``shard=N`` for each shard, with ``slot`` and all their columns.

    A file holds a run of ``rows_per_file`` slots in their order, so a shard is written by many tasks. Columns of
    ``docs`` that are called ``shard``, ``slot`` or ``run`` (in any case) get ``_`` behind their name.
    """
    taken = {"shard", "slot", "run"}
    renamed = docs.toDF(*(f"{c}_" if c.lower() in taken else c for c in docs.columns))
    names = {k: (f"{v}_" if v.lower() in taken else v) for k, v in options.items() if k.endswith("_col")}
    placed = shard(renamed, carry=tuple(renamed.columns), **(options | names))
    out = placed.select("shard", "slot", *(F.col(f"carried_{c}").alias(c) for c in renamed.columns))
    runs = out.withColumn("run", F.floor(F.col("slot") / rows_per_file))
    runs.repartition("shard", "run").sortWithinPartitions("shard", "slot").drop("run").write.partitionBy("shard").mode("overwrite").parquet(path)
