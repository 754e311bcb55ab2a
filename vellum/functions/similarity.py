"""Similarity of titles and names, as expressions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import present

#: Words without weight in comparisons. Fixed values.
STOP_WORDS = ("the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by")


#: White space (``SPACE``) by character: a plain space is split at without compiling a pattern for each text.
SPACES = "\t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def word_set(c: Column) -> Column:
    """Distinct words of a text in lower case, without stop words."""
    words = F.filter(F.split(F.translate(F.lower(F.coalesce(c, F.lit(""))), SPACES, " " * len(SPACES)), " "), lambda w: (w != "") & ~w.isin(*STOP_WORDS))
    return F.array_distinct(words)


def similarity(a: Column, b: Column, wa: Column, wb: Column) -> Column:
    """Jaccard of two word sets that are not empty, a bonus where one text in lower case holds the other, at most 1."""
    shared = F.size(F.array_intersect(wa, wb))
    bonus = F.when(a.contains(b) | b.contains(a), 0.2).otherwise(0.0)
    return F.least(F.try_divide(shared, F.size(wa) + F.size(wb) - shared) + bonus, F.lit(1.0))


def set_similarity(a: Column, b: Column, wa: Column, wb: Column) -> Column:
    """The similarity of two texts with these words; 0 without words."""
    empty = (F.size(wa) == 0) | (F.size(wb) == 0)
    return F.when(empty | ~present(a) | ~present(b), 0.0).otherwise(similarity(F.lower(a), F.lower(b), wa, wb))


def text_similarity(a: Column, b: Column) -> Column:
    """Similarity of two texts, 0 to 1."""
    return set_similarity(a, b, word_set(a), word_set(b))


def listed(query: Column) -> Column:
    """The names of a list joined by "and"."""
    return F.transform(F.split(F.coalesce(query, F.lit("")), " and "), lambda a: F.btrim(a, F.lit(SPACES + " ")))


def named(names: Column) -> Column:
    """Names that have words, in lower case (a), with their words (w); none if the array is missing."""
    each = F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda a: F.struct(F.lower(a).alias("a"), word_set(a).alias("w")))
    return F.filter(each, lambda x: F.size(x["w"]) > 0)


def names_similarity(query: Column, names: Column) -> Column:
    """The best similarity between two names of such arrays; 0 if either has none."""
    each = F.flatten(F.transform(query, lambda q: F.transform(names, lambda p: similarity(q["a"], p["a"], q["w"], p["w"]))))
    same = F.arrays_overlap(query["a"], names["a"])  # needs no comparison of words
    return F.when(same, 1.0).otherwise(F.coalesce(F.array_max(each), F.lit(0.0)))


def author_similarity(query: Column, authors: Column) -> Column:
    """The best similarity between a name of a list joined by "and" and a name of an array; 0 if either is missing."""
    return names_similarity(named(listed(query)), named(authors))


def full_names(authors: Column) -> Column:
    """Names from given and family parts; without a family part there is none."""
    names = F.transform(authors, lambda a: F.when(a["given"].isNotNull() & a["family"].isNotNull(), F.concat_ws(" ", a["given"], a["family"])).otherwise(a["family"]))
    return F.filter(names, lambda n: n.isNotNull())


def match_score(title: Column, candidate: Column, authors: Column, candidate_authors: Column, provider_score: Column | None = None) -> Column:
    """Seven parts title, three parts authors, and a small boost by the provider's own score."""
    boost = F.least(F.coalesce(provider_score, F.lit(0.0)) / 100, F.lit(0.1)) if provider_score is not None else F.lit(0.0)
    return 0.7 * text_similarity(title, candidate) + 0.3 * author_similarity(authors, candidate_authors) + boost
