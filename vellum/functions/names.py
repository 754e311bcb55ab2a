"""Person names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, strip


def natural_order(c: Column) -> Column:
    """"Family, Given" as "Given Family" where there is exactly one comma; other names as they are."""
    parts = F.transform(F.split(c, ","), strip)
    both = (F.get(parts, F.lit(0)) != "") & (F.get(parts, F.lit(1)) != "")
    return F.when(F.size(parts) != 2, c).when(both, F.concat_ws(" ", F.get(parts, F.lit(1)), F.get(parts, F.lit(0)))).otherwise(strip(c))


def first_author(c: Column) -> Column:
    """Family part of the first of several names."""
    return strip(F.get(F.split(F.get(F.split(F.coalesce(c, F.lit("")), " and "), F.lit(0)), ","), F.lit(0)))


def last_word(c: Column) -> Column:
    """The last word of a name, '' if there is none."""
    words = F.filter(F.split(F.coalesce(c, F.lit("")), rf"{SPACE}+"), lambda w: w != "")
    return F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit(""))


def author_string(c: Column) -> Column:
    """A list of names as one string, commas between all of them; NULL if empty."""
    return F.nullif(F.replace(F.array_join(c, ", "), F.lit(" and "), F.lit(", ")), F.lit(""))


def author_objects(enriched: Column, own: Column) -> Column:
    """Names as objects, those of the enrichment first."""
    use = F.when(F.size(enriched) > 0, enriched).otherwise(own)
    return F.transform(F.coalesce(use, F.array().cast("array<string>")), lambda a: F.struct(a.alias("name")))


def display_name(profile_real: Column, real: Column, display: Column, name: Column) -> Column:
    """The name to show of a user, the first that is there."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in (profile_real, real, display, name)])
