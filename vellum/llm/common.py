"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.session import free as free
from vellum.session import release as release
from vellum.session import shared_dir as shared_dir
from vellum.session import stored as stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blank(c: Column) -> Column:
    """True for NULL, empty and all-space strings."""
    return c.isNull() | (F.trim(F.regexp_replace(c, r"[\s\p{Z}]+", " ")) == "")


def spread(df: DataFrame) -> DataFrame:
    """Give costly per-row work a task for each core, where the scan has fewer tasks (small files)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df
