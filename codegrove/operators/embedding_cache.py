"""Embedding cache as a table keyed by content hash (inventory J17, J18, I19-I23, A12, U8, F29, G18)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codegrove.functions import text as T
from codegrove.operators.snapshots import delete_keys, upsert
from codegrove.sources.models import Embedder, embed


def live(cache: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """Entries not older than the time to live; 0 or less keeps everything."""
    if ttl_seconds <= 0:
        return cache
    age = F.unix_micros(now) - F.unix_micros("created_at")
    return cache.filter(age <= ttl_seconds * 1_000_000)


def expired(cache: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """Entries a clean-up removes."""
    if ttl_seconds <= 0:
        return cache.limit(0)
    age = F.unix_micros(now) - F.unix_micros("created_at")
    return cache.filter(age > ttl_seconds * 1_000_000)


def cached_hashes(cache: DataFrame) -> DataFrame:
    """U8."""
    return cache.select("content_hash").distinct()


def missing(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """Chunks whose content is not cached yet (anti join on the hash only)."""
    return chunks.join(cached_hashes(cache), "content_hash", "left_anti")


def lookup(cache: DataFrame, hashes: DataFrame) -> DataFrame:
    """Cached rows for a set of hashes."""
    return cache.join(hashes.select("content_hash").distinct(), "content_hash", "left_semi")


def touch(cache: DataFrame, hashes: DataFrame, now: Column) -> DataFrame:
    """The cache with ``accessed_at`` of the looked-up rows set to ``now``."""
    used = hashes.select("content_hash").distinct().withColumn("_used", F.lit(True))
    rows = cache.join(used, "content_hash", "left")
    return rows.withColumn(
        "accessed_at", F.when(F.col("_used"), now).otherwise(F.col("accessed_at"))
    ).drop("_used")


def put(cache: DataFrame, rows: DataFrame) -> DataFrame:
    """Insert or replace; of several new rows with one hash the last by ``created_at`` is kept."""
    others = [c for c in rows.columns if c != "content_hash"]
    latest = rows.groupBy("content_hash").agg(
        F.max_by(F.struct(*others), F.struct("created_at", "chunk_id")).alias("r")
    ).select("content_hash", "r.*")
    return upsert(cache, latest.select(*cache.columns), "content_hash")


def drop_units(cache: DataFrame, units: DataFrame) -> DataFrame:
    """Forget all entries of some units."""
    return delete_keys(cache, units, "unit_id")


def of_unit(cache: DataFrame, unit_id: str) -> DataFrame:
    """I22."""
    return cache.filter(F.col("unit_id") == unit_id)


def of_units(cache: DataFrame, units: DataFrame) -> DataFrame:
    """I22 for many units (unit_id) at once."""
    return cache.join(units.select("unit_id").distinct(), "unit_id", "left_semi")


def probe_stats(cache: DataFrame, probes: DataFrame) -> DataFrame:
    """Entries, hits, misses and hit rate of a set of probes.

    Probes are counted per hash before they meet the cache, so repeated contents cost one row.
    """
    per_hash = probes.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"))
    marked = per_hash.join(cached_hashes(cache).withColumn("hit", F.lit(True)), "content_hash", "left")
    row = marked.agg(
        F.coalesce(F.sum(F.when(F.col("hit"), F.col("n"))), F.lit(0)).alias("hits"),
        F.coalesce(F.sum(F.when(F.col("hit").isNull(), F.col("n"))), F.lit(0)).alias("misses"),
    )
    rate = F.coalesce(F.try_divide(F.col("hits").cast("double"), F.col("hits") + F.col("misses")), F.lit(0.0))
    return row.withColumn("entries", cached_hashes(cache).agg(F.count(F.lit(1))).scalar()).withColumn("hit_rate", rate)


def embed_chunks(chunks: DataFrame, cache: DataFrame, embedder: Embedder, now: Column, model: str = "mock") -> DataFrame:
    """Vectors for the chunks that are not cached, shaped as cache rows.

    The model sees context and content; line range and token count join the metadata.
    """
    todo = missing(chunks, cache)
    full = F.concat_ws("\n\n", T.present(F.col("context")), F.col("content"))
    rows = embed(todo, full, embedder)
    extra = F.create_map(
        F.lit("start_line"), F.col("start_line").cast("string"),
        F.lit("end_line"), F.col("end_line").cast("string"),
        F.lit("token_count"), F.col("token_count").cast("string"),
    )
    return rows.select(
        "content_hash", F.col("id").alias("chunk_id"), "unit_id",
        F.col("embedding").cast("array<float>").alias("embedding"),
        F.map_concat("metadata", extra).alias("metadata"),
        now.alias("created_at"), now.alias("accessed_at"), F.lit(model).alias("model"),
    )
