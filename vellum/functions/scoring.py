"""Dates and quality of records, as expressions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import present, present_array, valid_title

#: What each part of a record is worth, with the issue its absence raises. Fixed values.
WORTH = (("missing_title", 25), ("missing_authors", 20), ("missing_abstract", 20), ("missing_date", 15), ("missing_link", 10), ("not_enriched", 10))


def resolve_date(publication: Column, year: Column, month: Column) -> Column:
    """A struct (iso, estimated): the fetched date, the record's year and month, the fetched year, the record's year."""
    iso = lambda d, tail: F.concat(d, F.lit(f"{tail}T00:00:00Z"))
    pair = lambda value, est: F.struct(value.alias("iso"), F.lit(est).alias("estimated"))
    dashes = F.size(F.split(publication, "-"))
    return (
        F.when(present(publication) & (dashes >= 3), pair(iso(publication, ""), False))
        .when(present(publication) & (dashes == 2), pair(iso(publication, "-15"), True))
        .when(present(year) & present(month), pair(iso(F.concat_ws("-", year, month), "-15"), True))
        .when(present(publication) & (F.length(publication) == 4), pair(iso(publication, "-01-01"), True))
        .when(present(year), pair(iso(year, "-01-01"), True))
        .otherwise(pair(F.lit(None).cast("string"), False))
    )


def rss_date(iso: Column) -> Column:
    """An ISO time as mail headers write it; NULL if it is none."""
    return F.date_format(F.try_to_timestamp(iso), "EEE, dd MMM yyyy HH:mm:ss Z")


def publication_time(year: Column, month: Column) -> Column:
    """A time from year and month: the 15th if the month is known, else the first of January; NULL if invalid."""
    y = F.when(year.rlike(r"^\d{4}$"), year)
    m = F.when(month.rlike(r"^\d{1,2}$"), F.lpad(month, 2, "0"))
    return F.try_to_timestamp(F.concat(y, F.lit("-"), F.coalesce(m, F.lit("01")), F.when(m.isNotNull(), "-15").otherwise("-01")), F.lit("yyyy-MM-dd"))


def quality(title: Column, authors: Column, has_abstract: Column, has_date: Column, has_link: Column, provider: Column) -> Column:
    """A struct (score, issues) from what a record has; ``provider`` is the metadata's source."""
    enriched = F.coalesce(provider != "url", F.lit(False))
    has = [valid_title(title), present_array(authors), has_abstract, has_date, has_link, enriched]
    score = sum((F.when(h, w).otherwise(0) for h, (_, w) in zip(has[1:], WORTH[1:], strict=True)), F.when(has[0], WORTH[0][1]).otherwise(0))
    issues = F.array_compact(F.array(*[F.when(~h, F.lit(issue)) for h, (issue, _) in zip(has, WORTH, strict=True)]))
    return F.struct(score.cast("int").alias("score"), issues.alias("issues"))


def age_days(now: Column, then: Column) -> Column:
    """Age in days, with fractions."""
    return F.timestamp_diff("SECOND", then, now) / 86400.0


def confirmed_age(first: Column, second: Column, limit: Column) -> Column:
    """The first reading if it is within the limit; else the one that is there, or the lesser of both."""
    return F.when(first <= limit, first).when(first.isNull(), second).when(second.isNull(), first).otherwise(F.least(first, second))
