"""Removal of records that another source already has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.names import last_word
from vellum.functions.text import fingerprint_text, join_key


def fingerprint(title: Column, authors: Column, year: Column) -> Column:
    """Title, first author's last word and year in one form; NULL if one of them is missing."""
    t, s, y = fingerprint_text(title), fingerprint_text(last_word(F.get(authors, F.lit(0)))), F.trim(F.coalesce(year, F.lit("")))
    return F.when((t != "") & (s != "") & (y != ""), F.concat_ws("\u0001", t, s, y))


def cross_source(entries: DataFrame, empty_matches: bool = False) -> DataFrame:
    """Entries without those that an earlier source has: by DOI, else by fingerprint; the first in ``ord`` stays.

    Copies within one source are kept. Both stages find the first source of a key by aggregation, so a key that many
    rows share is combined before it is shuffled. Rows without a key are spread and meet nothing; with ``empty_matches`` those
    without a fingerprint count as equal to each other.
    """
    doi = F.nullif(F.lower(F.trim("doi")), F.lit(""))
    fp = fingerprint(F.col("title"), F.col("authors"), F.col("year"))
    rows = entries.withColumns({"_doi": doi, "_fp": F.coalesce(fp, F.lit("")) if empty_matches else fp, "_src": F.nullif("source", F.lit(""))})

    def drop_later(df: DataFrame, key: str, subject: Column) -> DataFrame:
        first = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.min_by(F.struct("_src"), "ord").alias("_first"))
        seen = df.withColumn("_k", join_key(F.when(subject, F.col(key)))).join(first, "_k", "left")
        return seen.where(F.col("_first").isNull() | F.col("_first._src").eqNullSafe(F.col("_src"))).drop("_first", "_k")

    kept = drop_later(rows, "_doi", F.col("_doi").isNotNull())
    kept = drop_later(kept, "_fp", F.col("_doi").isNull() & F.col("_fp").isNotNull())
    return kept.select(*entries.columns)
