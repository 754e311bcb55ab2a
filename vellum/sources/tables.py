"""Small tables and files: settings, states, ledgers, outputs."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_VAR = re.compile(r"\$\{(\w+)\}")


def substitute(value: object, env: dict[str, str] | None = None) -> object:
    """Settings with ``${NAME}`` replaced by the environment's value; unknown names stay as they are."""
    env = dict(os.environ) if env is None else env
    if isinstance(value, str):
        return _VAR.sub(lambda m: env.get(m[1], m[0]), value)
    if isinstance(value, dict):
        return {k: substitute(v, env) for k, v in value.items()}
    return [substitute(v, env) for v in value] if isinstance(value, list) else value


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on any file system."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def load_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON table by an explicit schema; a missing path and broken rows give no rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, _broken STRING").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path)
    return rows.where("_broken IS NULL").drop("_broken")


def previous_keys(spark: SparkSession, path: str) -> DataFrame | None:
    """Keys of the previous run; None, not an empty table, where they are missing or any of them is unreadable."""
    try:
        rows = spark.read.schema("key STRING").option("mode", "FAILFAST").json(path)
        seen = rows.agg(F.count_if(F.col("key").isNull()).alias("n")).first()  # reads all of it; a state is one short row a finding
        return rows if seen.n == 0 else None
    except Exception:  # no state is a state of its own
        return None


def save_keys(findings: DataFrame, path: str) -> None:
    """The sorted keys of this run."""
    findings.select("key").distinct().orderBy("key").write.mode("overwrite").json(path)


def save_table(df: DataFrame, path: str) -> None:
    """Replace a table that may be read in its own making, such as a cache: it is written beside the old one, which it then replaces."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    df.write.mode("overwrite").parquet(f"{path}.new")
    fs.delete(hadoop(path), True)
    if not fs.rename(hadoop(f"{path}.new"), hadoop(path)):
        raise OSError(f"could not replace {path}")


def upload_plan(files: DataFrame, stored: DataFrame, overwrite: bool = False) -> DataFrame:
    """Files with ``action``: create, replace or skip, by name."""
    have = stored.select("name").distinct().withColumn("_have", F.lit(True))
    action = F.when(F.col("_have").isNull(), "create").otherwise("replace" if overwrite else "skip")
    return files.join(have, "name", "left").withColumn("action", action).drop("_have")


def write_document(lines: DataFrame, path: str) -> None:
    """Ordered lines (column ``value``) as text; the parts in order are the document."""
    lines.write.mode("overwrite").text(path)


def read_downloads(spark: SparkSession, path: str, responses: DataFrame) -> DataFrame:
    """url, status, content_type, content of downloads: the bodies are files of a folder, what the server said is in
    responses (name of the file, url, status, content_type). A response without a file has no content, and keeps its row."""
    bodies = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    return responses.join(bodies, "name", "left").select("url", F.col("status").cast("int").alias("status"), "content_type", "content")


def load_settings(path: str, env: dict[str, str] | None = None) -> dict:
    """Settings of a JSON or YAML file with ``${NAME}`` replaced; YAML only where its library is there."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith((".yml", ".yaml")):
        import yaml

        return substitute(yaml.safe_load(text) or {}, env)
    import json

    return substitute(json.loads(text), env)
