"""Identifiers: DOIs, preprint ids, record keys and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import last_word
from .text import present, strip

#: Public patterns: DOIs as their registration agency recommends to find them, preprint ids in use since 2007. Fixed values.
DOI = r"\b(10\.\d{4,9}/[-._;()/:A-Za-z0-9]+)"
PREPRINT = r"https?://(?:www\.)?arxiv\.org/(?:abs|pdf)/(\d{4}\.\d{4,5})(?:v\d+)?"


def doi_parsed(c: Column) -> Column:
    """A DOI field of a bibliography file without its prefix; case is kept."""
    return strip(F.regexp_replace(c, r"(?i)^(?:doi:)?(?:https?://)?(?:(?:dx\.)?doi\.org/)?", ""))


def doi_client(c: Column) -> Column:
    """A DOI for a request: three known prefixes are taken out wherever they stand."""
    for prefix in ("https://doi.org/", "http://dx.doi.org/", "doi:"):
        c = F.replace(c, F.lit(prefix), F.lit(""))
    return strip(c)


def doi_open_access(c: Column) -> Column:
    """A DOI as the open-access cache keys it: one prefix off, lower case."""
    return F.lower(strip(F.regexp_replace(strip(c), r"(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:)", "")))


def doi_archive(c: Column) -> Column:
    """A DOI as the archive index keeps it: resolver off, lower case, no full stop at the end; NULL if empty."""
    c = F.lower(strip(F.regexp_replace(strip(c), r"(?i)^(?:https?://)?(?:dx\.)?doi\.org/", "")))
    return F.nullif(F.regexp_replace(c, r"\.+$", ""), F.lit(""))


def valid_doi(c: Column) -> Column:
    """Whether a text has the shape of a DOI."""
    return F.coalesce((F.length(c) >= 7) & c.startswith("10.") & (F.instr(F.substr(c, F.lit(4)), "/") > 0), F.lit(False))


def doi_in_text(c: Column) -> Column:
    """The first DOI in a text, without punctuation after it; NULL if none."""
    return F.nullif(F.regexp_replace(F.regexp_extract(F.coalesce(c, F.lit("")), DOI, 1), r"[.,;)]+$", ""), F.lit(""))


def preprint_id(urls: Column) -> Column:
    """The preprint id of the first URL that has one."""
    ids = F.filter(F.transform(urls, lambda u: F.regexp_extract(u, f"(?i){PREPRINT}", 1)), lambda x: x != "")
    return F.get(ids, F.lit(0))


def entry_hash(title: Column, authors: Column, year: Column, doi: Column) -> Column:
    """Content hash of a record: sixteen hexadecimal digits over title, authors, year and DOI."""
    text = F.concat(F.coalesce(title, F.lit("")), F.coalesce(F.array_join(authors, ","), F.lit("")), F.coalesce(year, F.lit("")), F.coalesce(doi, F.lit("")))
    return F.substring(F.sha2(text, 256), 1, 16)


def guid(key: Column, doi: Column) -> Column:
    """The id of a feed item."""
    return F.when(present(key), F.concat(F.lit("bibtex:"), key)).when(present(doi), F.concat(F.lit("doi:"), doi)).otherwise("bibtex:unknown")


def mint_key(author: Column, year: Column, ts: Column, stub: str = "Slack", tag: str = "sl") -> Column:
    """A record key from the first author's last word, the year and a hash of the time stamp; it is the same on every run."""
    letters = F.regexp_replace(last_word(author), r"[^A-Za-z]", "")
    surname = F.when(letters == "", "Unknown").otherwise(letters)
    digits = F.when(F.coalesce(year, F.lit("")).rlike(r"^\d{4}$"), year).otherwise("ND")
    tail = F.concat(F.lit(f"-{tag}"), F.substring(F.sha1(ts.cast("binary")), 1, 2))
    unknown = (surname == "Unknown") & (digits == "ND")
    return F.when(unknown, F.concat(F.lit(stub), F.substring(F.replace(ts, F.lit("."), F.lit("")), 1, 10), tail)).otherwise(F.concat(surname, digits, tail))


def doi_in_message(text: Column, urls: Column) -> Column:
    """The first DOI of a text, else of its resolver URLs."""
    linked = F.filter(F.transform(F.filter(urls, lambda u: F.lower(u).contains("doi.org")), doi_in_text), lambda d: d.isNotNull())
    return F.coalesce(doi_in_text(text), F.get(linked, F.lit(0)))
