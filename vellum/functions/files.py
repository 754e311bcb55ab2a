"""File names and checks of downloaded files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import last_word
from .text import nfc, present, squeeze, strip

MAX_TITLE = 150
MOST_BYTES, LEAST_BYTES = 50 * 1024 * 1024, 10 * 1024


def scrub(c: Column) -> Column:
    """Text that may stand in a file name: accents composed, no path separators and control characters, squeezed."""
    c = F.regexp_replace(F.translate(nfc(c), "/\\", "--"), r"[\x00-\x1f]", "")
    return squeeze(c)


def file_name(authors: Column, year: Column, title: Column, key: Column | None = None) -> Column:
    """The name of a paper's file: key, surname, year and up to 150 characters of the title."""
    surname = F.coalesce(F.nullif(last_word(F.get(authors, F.lit(0))), F.lit("")), F.lit("Unknown"))
    who = F.concat(surname, F.when(F.size(authors) > 1, " et al.").otherwise(""))
    text = strip(F.substring(scrub(F.coalesce(F.nullif(title, F.lit("")), F.lit("untitled"))), 1, MAX_TITLE))
    name = F.concat(who, F.when(present(year), F.concat(F.lit(" "), year)).otherwise(""), F.lit(" - "), text, F.lit(".pdf"))
    return name if key is None else F.when(present(key), F.concat(scrub(key), F.lit(" - "), name)).otherwise(name)


def pdf_reason(url: Column, status: Column, content_type: Column, content: Column) -> Column:
    """Why a response is no usable PDF, NULL if it is one; the checks are made in this order."""
    kind = F.lower(strip(F.get(F.split(F.coalesce(content_type, F.lit("")), ";"), F.lit(0))))
    named = F.lower(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))).endswith(".pdf")
    size = F.coalesce(F.octet_length(content), F.lit(0))
    return (
        F.when(F.coalesce(status != 200, F.lit(True)), "http_status")
        .when((kind != "application/pdf") & ~(kind.isin("application/octet-stream", "binary/octet-stream") & named), "content_type")
        .when(size > MOST_BYTES, "too_large")
        .when(size < LEAST_BYTES, "too_small")
        .when(F.coalesce(F.substring(content, 1, 5) != F.lit(b"%PDF-"), F.lit(True)), "no_magic")
    )


def first_pdf(files: Column) -> Column:
    """The first attachment that is a PDF."""
    return F.get(F.filter(files, lambda f: F.coalesce((f["mimetype"] == "application/pdf") | (f["filetype"] == "pdf"), F.lit(False))), F.lit(0))
