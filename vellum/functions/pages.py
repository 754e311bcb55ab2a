"""Identity of a paper from the HTML of its landing page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ids import doi_in_text
from .text import page_title, strip, unescape_core

#: Names of meta tags, by rank. Fixed values.
TITLE_TAGS = ("citation_title", "dc.title", "og:title", "twitter:title")
AUTHOR_TAGS = ("citation_author", "dc.creator")
DATE_TAGS = ("citation_publication_date", "citation_date", "citation_online_date", "dc.date", "article:published_time")
DOI_TAGS = ("citation_doi", "dc.identifier", "dc.identifier.doi", "prism.doi", "bepress_citation_doi", "doi")


def _attribute(tag: Column, *names: str) -> Column:
    """The first of the named attributes that says something, in either quotation mark."""
    one = lambda n: F.nullif(F.coalesce(F.nullif(F.regexp_extract(tag, f'(?i)\\s{n}\\s*=\\s*"([^"]*)"', 1), F.lit("")), F.regexp_extract(tag, f"(?i)\\s{n}\\s*=\\s*'([^']*)'", 1)), F.lit(""))
    return F.coalesce(*map(one, names))


def meta_tags(html: Column) -> Column:
    """Meta tags in order, as structs (label, content); attributes may stand in any order."""
    tags = F.filter(F.split(F.coalesce(html, F.lit("")), "<"), lambda t: F.lower(F.substring(t, 1, 5)) == "meta ")
    inner = F.transform(tags, lambda t: F.substring_index(t, ">", 1))
    both = F.transform(inner, lambda t: F.struct(F.lower(strip(_attribute(t, "name", "property"))).alias("label"), strip(unescape_core(_attribute(t, "content"))).alias("content")))
    return F.filter(both, lambda x: x["label"].isNotNull() & F.coalesce(x["content"] != "", F.lit(False)))


def page_doi(tags: Column) -> Column:
    """The DOI that meta tags tell."""
    dois = F.filter(F.transform(F.filter(tags, lambda x: x["label"].isin(*DOI_TAGS)), lambda x: doi_in_text(x["content"])), lambda d: d.isNotNull())
    return F.get(dois, F.lit(0))


def _ranked(tags: Column, labels: tuple[str, ...], value) -> Column:  # noqa: ANN001
    """The value of the tag of the best rank that has one, the first of equals."""
    names = F.array(*map(F.lit, labels))
    each = F.transform(tags, lambda x, i: F.struct(F.array_position(names, x["label"]).alias("rank"), i.alias("at"), value(x).alias("value")))
    return F.array_min(F.filter(each, lambda x: (x["rank"] > 0) & x["value"].isNotNull()))["value"]


def page_meta(html: Column, tags: Column) -> Column:
    """A struct (title, authors, year): titles by rank with the page's title last, authors in order, the first date's year."""
    whole = F.array(*map(F.lit, TITLE_TAGS[:2]))  # these hold a title and nothing else
    tagged = _ranked(tags, TITLE_TAGS, lambda x: F.when(F.array_contains(whole, x["label"]), x["content"]).otherwise(page_title(x["content"])))
    written = F.substring_index(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?i)<title(?:\s[^>]*)?>([^<]*)", 1), "<", 1)
    year = _ranked(tags, DATE_TAGS, lambda x: F.nullif(F.regexp_extract(x["content"], r"\b((?:19|20)\d{2})\b", 1), F.lit("")))
    authors = F.transform(F.filter(tags, lambda x: x["label"].isin(*AUTHOR_TAGS)), lambda x: x["content"])
    return F.struct(F.coalesce(tagged, page_title(unescape_core(F.nullif(written, F.lit(""))))).alias("title"), authors.alias("authors"), year.alias("year"))


def usable_html(content_type: Column, html: Column, limit: int = 2_000_000) -> Column:
    """The beginning of a page that is HTML or XML, up to the limit; NULL for anything else."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    return F.when(kind.contains("html") | kind.contains("xml"), F.substring(html, 1, limit))
