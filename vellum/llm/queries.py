"""Queries of this subpackage, and the SQL that checks those that SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import formatdup, leakage, linkage, lookalike, names, sentences, survivor, tokenize
from .common import table
from .sql import SQL as SQL


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_matches(spark, d).select("ord", "work_id")


def p1_matches(spark: SparkSession, d: str) -> DataFrame:
    return linkage.match_publications(table(spark, d, "entries"), table(spark, d, "works"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.look_alike_pairs(lookalike.titles(table(spark, d, "entries"), table(spark, d, "resolved_papers")))


def p2_canonical(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.canonical_titles(lookalike.titles(table(spark, d, "entries"), table(spark, d, "resolved_papers")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return survivor.leading_rows(table(spark, d, "enriched"), table(spark, d, "providers"))


def p3_survivors(spark: SparkSession, d: str) -> DataFrame:
    out = survivor.survivors(table(spark, d, "enriched"), table(spark, d, "providers"))
    return out.withColumns({c: F.array_join(c, "|") for c, kind in out.dtypes if kind.startswith("array")} | {"fetched_at": F.unix_micros(F.col("fetched_at").cast("timestamp"))})


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return names.pairs(names.link(names.author_names(table(spark, d, "entries"), table(spark, d, "enriched"))))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return formatdup.members(table(spark, d, "entries"), table(spark, d, "resolved_papers"))


def p5_records(spark: SparkSession, d: str) -> DataFrame:
    return formatdup.representatives(table(spark, d, "entries"), table(spark, d, "resolved_papers"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encode(table(spark, d, "documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.split(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_matches, p2_found, p2_canonical, p3_found, p3_survivors, p4_found, p5_found, p5_records, p6_ids, p7_found, p8_found)}
