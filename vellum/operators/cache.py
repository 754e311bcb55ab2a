"""Caches as tables: time to live, retries, statistics, and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TTL_DAYS, RETRY_DAYS = 30, 7


def _older(now: Column, then: Column, days: int) -> Column:
    return then < now - F.expr(f"INTERVAL {days} DAYS")


def expired(now: Column, cached_at: Column, ttl_days: int = TTL_DAYS) -> Column:
    """Strictly older than the time to live."""
    return F.coalesce(_older(now, cached_at, ttl_days), F.lit(True))


def state(now: Column, cached_at: Column, failed: Column, last_failure: Column, ttl_days: int = TTL_DAYS, retry_days: int = RETRY_DAYS) -> Column:
    """valid, expired, failed or failed_retriable; a failure without its own time counts from when it was stored."""
    retry = _older(now, F.coalesce(last_failure, cached_at), retry_days)
    bad = F.coalesce(failed, F.lit(False))
    return F.when(bad & retry, "failed_retriable").when(bad, "failed").when(expired(now, cached_at, ttl_days), "expired").otherwise("valid")


def retriable(now: Column, cached_at: Column, failed: Column, last_failure: Column) -> Column:
    """Whether an item should be fetched again: there is none, it expired, or its failure is old enough."""
    return cached_at.isNull() | state(now, cached_at, failed, last_failure).isin("expired", "failed_retriable")


def cached(entries: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """Entries with their metadata, where the cache has it and it is still good."""
    good = cache.where(~expired(now, F.col("cached_at")) & F.col("metadata").isNotNull())
    return entries.join(good.select("entry_hash", "metadata"), "entry_hash")


def uncached(entries: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """Entries that need a fetch: without an item, or with one that may be retried."""
    settled = cache.where(~retriable(now, F.col("cached_at"), F.col("failed"), F.col("last_failure_at")))
    return entries.join(settled.select("entry_hash"), "entry_hash", "left_anti")


def statistics(cache: DataFrame, now: Column) -> DataFrame:
    """Counts of items by state, in one pass."""
    s = state(now, F.col("cached_at"), F.col("failed"), F.col("last_failure_at"))
    old = expired(now, F.col("cached_at"))
    bad = F.coalesce("failed", F.lit(False))
    return cache.agg(F.count("*").alias("total"), F.count_if(~old).alias("valid"), F.count_if(old).alias("expired"), F.count_if(~bad).alias("successful"), F.count_if(bad).alias("failed"), F.count_if(s == "failed_retriable").alias("failed_retriable"))


def purge(cache: DataFrame, now: Column) -> DataFrame:
    """The cache without expired items."""
    return cache.where(~expired(now, F.col("cached_at")))


def discover(entries: DataFrame, known: DataFrame, now: Column) -> DataFrame:
    """Entries with the time they were first seen: the stored one, else now."""
    return entries.join(known.select("entry_hash", F.col("discovery_date").alias("_seen")), "entry_hash", "left").withColumn("discovery_date", F.coalesce("_seen", now)).drop("_seen")


def newly_discovered(entries: DataFrame, known: DataFrame, now: Column) -> DataFrame:
    """The rows to append to the table of first sightings."""
    fresh = entries.join(known.select("entry_hash"), "entry_hash", "left_anti")
    return fresh.groupBy("entry_hash").agg(F.min_by("key", "ord").alias("entry_key"), F.min_by("title", "ord").alias("entry_title")).withColumn("discovery_date", now)


def merge(old: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """Rows of both by key; where both have one, the new one stays."""
    n, o = new.withColumn("_new", F.lit(True)).alias("n"), old.alias("o")
    both = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    return both.select(*[F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in old.columns])


def split_hits(keys: DataFrame, cache: DataFrame, now: Column, key: str, ttl_days: int = TTL_DAYS) -> tuple[DataFrame, DataFrame]:
    """Keys that a lookup cache answers, also with "not found", and keys that must be fetched and appended."""
    good = cache.where(~expired(now, F.col("cached_at"), ttl_days))
    return keys.join(good, key), keys.join(good.select(key), key, "left_anti")


def failure_reason(key: Column, doi: Column, title: Column, authors: Column, providers: list[str]) -> Column:
    """What a failed fetch had to go by, as one line."""
    some = lambda c: F.coalesce(c != "", F.lit(False))
    names = F.concat(F.array_join(F.slice(authors, 1, 2), ", "), F.when(F.size(authors) > 2, "...").otherwise(""))
    parts = [
        F.when(some(doi), F.concat(F.lit("DOI: "), doi)).otherwise("No DOI available"),
        F.when(some(title), F.concat(F.lit("Title length: "), F.length(title).cast("string"), F.lit(" chars"))).otherwise("No title available"),
        F.when(F.coalesce(F.size(authors) > 0, F.lit(False)), F.concat(F.lit("Authors: "), names)).otherwise("No authors available"),
    ]
    return F.concat_ws(" | ", F.concat(F.lit("Could not enrich entry: "), key), *parts, F.lit(f"APIs: {', '.join(f'{p} enabled' for p in providers) or 'None enabled'}"))
