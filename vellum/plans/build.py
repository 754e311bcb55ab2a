"""From bibliography files and fetched metadata to feeds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum import schemas
from vellum.functions.ids import entry_hash
from vellum.operators import cache, dedup, feed
from vellum.plans import enrich
from vellum.sources import bibtex, tables


def entries_of(spark: SparkSession, sources: list[tuple[str, str]]) -> DataFrame:
    """Entries of several files, without those an earlier file has."""
    return dedup.cross_source(bibtex.load(spark, sources))


def build_feeds(
    spark: SparkSession, sources: list[tuple[str, str]], out: str, metadata: str | None = None, discovery: str | None = None, title: str = "Bibliography", home: str = "", about: str = "", json_feed: bool = True, rss: bool = False,
    ask: Callable[[DataFrame], dict[str, DataFrame]] | None = None, cache_path: str | None = None, use_cached: bool = True,
) -> DataFrame:
    """Writes ``feed.json`` and ``feed.rss`` folders under ``out`` and returns the items.

    ``metadata`` is a Parquet table of ``schemas.ENRICHED``, ``discovery`` a JSON table of ``schemas.DISCOVERY``. With ``ask`` entries are
    enriched by what it answers (see ``enrich.run``), with the cache in ``cache_path``."""
    e = entries_of(spark, sources).withColumn("entry_hash", entry_hash(F.col("title"), F.col("authors"), F.col("year"), F.col("doi")))
    known = tables.load_json(spark, discovery, schemas.DISCOVERY) if discovery else spark.createDataFrame([], schemas.DISCOVERY)
    e = cache.discover(e, known, F.current_timestamp())
    md = spark.read.schema(schemas.ENRICHED).parquet(metadata) if metadata else spark.createDataFrame([], schemas.ENRICHED)
    if ask is not None:
        old = spark.read.schema(schemas.METADATA_CACHE).parquet(cache_path) if cache_path and tables.exists(spark, cache_path) else spark.createDataFrame([], schemas.METADATA_CACHE)
        one = e.groupBy("key").agg(F.min_by(F.struct(*[c for c in e.columns if c != "key"]), "ord").alias("e")).select("key", "e.*")
        md, saved = enrich.run(one, old, ask, F.current_timestamp(), use_cached=use_cached)
        if cache_path:
            tables.save_table(saved, cache_path)
            now = spark.read.schema(schemas.METADATA_CACHE).parquet(cache_path)  # nothing is asked twice
            md = now.where("metadata IS NOT NULL").select(F.col("entry_key").alias("key"), "metadata.*").dropDuplicates(["key"]) if use_cached else md
    items = feed.items(feed.attach(e, md))
    if json_feed:
        tables.write_document(feed.json_feed(items, title, home, about), f"{out}/feed.json")
    if rss:
        tables.write_document(feed.rss_feed(items, title, home, about), f"{out}/feed.rss")
    return items
