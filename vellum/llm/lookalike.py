"""Visually identical text with different characters, brought to one form.

A title's visual form maps look-alike letters, full-width forms, ligatures and rare spaces to one character
and drops what can't be seen. Equal visual forms are grouped in SQL under Unicode collation, which is
accent-sensitive and treats composed and combining accents alike. Each class gets a deterministic canonical
member, which is joined back to every row. Distinct titles are reduced first, so a title that
many rows share is one row in the grouping.

Two titles are a case if their visual forms agree while their plain forms (case, punctuation, plain
spaces, tabs and line breaks removed) differ, or if they have the same hyphens made of different characters: a hyphen's
look-alikes are characters like a letter's, while its absence is a difference in punctuation. Raised and lowered
digits, accents and sharp s stay apart.
Defined cases: NULL, blank and all-invisible titles have the canonical form NULL and make no pair;
repeated titles share their class; titles are compared whole; extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of other scripts and the Latin letters they look like, lower and upper case in step.
#: Fixed values.
CYRILLIC = ("авекмнорстухіјѕһԁԛԝүѵӏ", "abekmhopctyxijshdqwyvl")
GREEK = ("ορνιαυκτχ", "opviauktx")
GREEK_UPPER = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX")
LATIN = ("ıɡɑȷ", "igaj")
ARMENIAN = ("օսհցո", "ouhgn")
#: Hyphens that look like the one on the keyboard. Fixed values.
HYPHENS = "‐‑﹣－"


@cache
def look_alikes() -> dict[str, str]:
    """The map of single characters, built by rule from the letters above and Unicode's compatibility forms."""
    base: dict[str, str] = {}
    for a, b in zip(*CYRILLIC, strict=True):
        base[a], base[a.upper()] = b, b.upper()
    base |= dict(zip(*GREEK, strict=True)) | dict(zip(*GREEK_UPPER, strict=True)) | dict(zip(*LATIN, strict=True)) | dict(zip(*ARMENIAN, strict=True))
    out = dict(base)
    for cp in range(0xA0, 0x1F000):
        ch = chr(cp)
        kind = unicodedata.decomposition(ch)
        if kind.startswith(("<wide>", "<narrow>", "<noBreak>", "<font>", "<compat>")):
            to = unicodedata.normalize("NFKC", ch)
            if len(to) == 1 and to != ch:
                out[ch] = base.get(to, to)
        elif kind and not kind.startswith("<"):
            first, *marks = unicodedata.normalize("NFD", ch)
            if first in base and marks:
                to = unicodedata.normalize("NFC", base[first] + "".join(marks))
                if len(to) == 1:
                    out[ch] = to
    return out


@cache
def ligatures() -> dict[str, str]:
    """Characters that look like two or more letters, by the same rule."""
    return {chr(cp): to for cp in (*range(0x1C4, 0x1F4), *range(0x2160, 0x2180), *range(0xFB00, 0xFB07)) if unicodedata.decomposition(chr(cp)).startswith("<compat>") and len(to := unicodedata.normalize("NFKC", chr(cp))) > 1}


def plain_form(c: Column) -> Column:
    """Without letter case, punctuation, plain spaces, tabs and line breaks."""
    return F.regexp_replace(F.lower(c), r"[ \t\n\r\x0B\f\p{P}]+", "")


def hyphen_form(c: Column) -> Column:
    """The plain form with its hyphens, as characters."""
    return F.regexp_replace(F.lower(c), rf"[ \t\n\r\x0B\f\p{{P}}&&[^{HYPHENS}\-]]+", "")


def visual_form(c: Column) -> Column:
    """What can be seen of a text, with one character for each look."""
    c = F.regexp_replace(c, r"[\p{Cf}\p{Cc}͏ᅟᅠ឴឵᠋-᠏ㅤﾠ︀-️\x{E0100}-\x{E01EF}&&[^\t\n\x0B\f\r]]", "")
    table = look_alikes()
    c = F.translate(c, "".join(table), "".join(table.values()))
    spelt = c
    for lig, to in ligatures().items():
        spelt = F.replace(spelt, F.lit(lig), F.lit(to))
    c = F.when(c.rlike(f"[{''.join(ligatures())}]"), spelt).otherwise(c)
    return F.regexp_replace(F.lower(c), r"[\s\p{Z}\p{P}]+", "")


def titles(entries: DataFrame, resolved: DataFrame) -> DataFrame:
    """ord and title of both tables."""
    return entries.select("ord", "title").unionByName(resolved.select("ord", "title"))


def classes(rows: DataFrame) -> DataFrame:
    """title, plain, hyphens, canonical, cases: each distinct title with its class's canonical member; cases is true where the class holds different characters."""
    distinct = rows.where("title IS NOT NULL").groupBy("title").agg(F.count("*").alias("n"))
    forms = {"plain": plain_form(F.col("title")), "hyphens": hyphen_form(F.col("title")), "visual": visual_form(F.col("title"))}
    seen = distinct.select("title", "n", *[c.alias(k) for k, c in forms.items()]).where("visual <> ''")
    return rows.sparkSession.sql(
        """
        WITH seen AS (SELECT title, n, plain, hyphens, visual COLLATE UNICODE AS visual FROM {seen}),
        class AS (
          SELECT visual, min(hyphens) <> max(hyphens) AS cases,
                 min_by(title, struct(length(regexp_replace(title, '[\\\\x00-\\\\x7F]', '')), -n, title)) AS canonical
          FROM seen GROUP BY visual)
        SELECT s.title, s.plain, s.hyphens, c.canonical, c.cases FROM seen s JOIN class c ON s.visual = c.visual
        """,
        seen=seen,
    )


def canonical_titles(rows: DataFrame) -> DataFrame:
    """ord, title, canonical: every row with the one form of its title (NULL if nothing can be seen)."""
    return rows.join(classes(rows).select("title", "canonical"), "title", "left").select("ord", "title", "canonical")


def look_alike_pairs(rows: DataFrame) -> DataFrame:
    """ord_a, ord_b: pairs of rows whose titles look the same and are made of different characters."""
    mixed = rows.join(classes(rows).where("cases").select("title", "plain", "hyphens", "canonical"), "title").select("ord", "plain", "hyphens", F.translate("hyphens", HYPHENS, "-" * len(HYPHENS)).alias("level"), "canonical")
    a, b = mixed.alias("a"), mixed.alias("b")
    differ = (F.col("a.plain") != F.col("b.plain")) | ((F.col("a.hyphens") != F.col("b.hyphens")) & (F.col("a.level") == F.col("b.level")))
    return a.join(b, (F.col("a.canonical") == F.col("b.canonical")) & (F.col("a.ord") < F.col("b.ord")) & differ).select(F.col("a.ord").alias("ord_a"), F.col("b.ord").alias("ord_b"))
