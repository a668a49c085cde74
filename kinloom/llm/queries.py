"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.llm import bpe, embed_dedup, jaccard_join, packing, pii, quality, secrets, sharding, substring_dedup, url_filters


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spans(condition: str | None = None):
    chosen = f"filter(findings, f -> {condition})" if condition else "array_distinct(transform(findings, f -> named_struct('kind', f.kind, 'start', f.start, 'end', f.end)))"
    return F.expr(f"array_join(transform({chosen}, f -> concat_ws(':', f.kind, f.start, f.end)), ',')")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text: counts and digest of the base spans, and all spans."""
    found = secrets.find_secrets(_table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(findings, f -> f.depth = 0 and f.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in secrets.KINDS]
    return found.select("doc_id", *counts, F.sha2(_spans("f.depth = 0"), 256).alias("base_sha256"), _spans().alias("spans"), "layers")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has, exactly or with some words changed."""
    return substring_dedup.repeated_passages(_table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each piece of every document goes in sequences of 4096 tokens."""
    return packing.place(_table(spark, sf_dir, "documents"))


def op4_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features and verdict of every document."""
    judged = quality.cascade(_table(spark, sf_dir, "documents"), all_features=True)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingles have a Jaccard similarity of 0.9 or more."""
    return jaccard_join.components(_table(spark, sf_dir, "documents"), 3, "0.9")


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors."""
    return embed_dedup.near_vectors(_table(spark, sf_dir, "embeddings"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text and their decoding, as counts and hashes."""
    return bpe.digests(_table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document; the law is ``rows``."""
    placed = sharding.shard(_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "stratum")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text: counts and digest of the base spans, and all spans."""
    found = pii.find_pii(_table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(findings, f -> f.base and f.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(_spans("f.base"), 256).alias("base_sha256"), _spans().alias("spans"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page; what no stated rule covers is judged by rules mined from the pages that one covers."""
    pages = _table(spark, sf_dir, "pages")
    return url_filters.judge(pages, url_filters.mine(url_filters.labelled_by_stated(pages)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_secret_scan, op2_substring_dedup, op3_packing, op4_quality_cascade, op5_jaccard_join, op6_embedding_dedup, op7_bpe, op8_sharding, op9_pii, op10_url_filter)
}

SQL: dict[str, str] = {}
