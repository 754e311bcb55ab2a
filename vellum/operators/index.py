"""Inverted indexes of words to positions, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions.text import SPACE


def words_at(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, word: words of a text by position from 0."""
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), rf"{SPACE}+"), lambda w: w != "")
    return df.select(key, F.posexplode(words).alias("pos", "word"))


def build(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, word, positions: an index of each text; a group is one word of one text."""
    return words_at(df, key, text).groupBy(key, "word").agg(F.array_sort(F.collect_list("pos")).alias("positions"))


def postings(df: DataFrame, key: str, text: str) -> DataFrame:
    """word, docs, places: how many texts hold a word, and how often; combined before the shuffle."""
    per_text = words_at(df, key, text).groupBy("word", key).agg(F.count("*").alias("n"))
    return per_text.groupBy("word").agg(F.count("*").alias("docs"), F.sum("n").alias("places"))


def rebuild(index: DataFrame, key: str) -> DataFrame:
    """key, text: texts from their index, words by position with single spaces."""
    each = index.select(key, "word", F.explode("positions").alias("pos"))
    return each.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("text"))
