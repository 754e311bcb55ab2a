"""Payloads of providers as one metadata record each.

Each takes the provider's columns and gives the columns of ``schemas.METADATA``; absent parts become NULL or empty arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import natural_order
from .similarity import full_names
from .text import first_present, present, strip, strip_markup

_NONE = {
    "abstract": "string", "doi": "string", "doi_url": "string", "url": "string", "arxiv_url": "string", "pdf_url": "string", "publication_date": "string", "citation_count": "int", "reference_count": "int",
    "venue": "string", "authors": "array<string>", "keywords": "array<string>", "subjects": "array<string>", "is_open_access": "boolean", "source": "string", "confidence_score": "double",
}


def _metadata(keep: tuple[str, ...], df: DataFrame, **cols: Column) -> DataFrame:
    def value(name: str, kind: str) -> Column:
        c = cols.get(name, F.lit(None))
        return (F.coalesce(c, F.array().cast(kind)) if kind.startswith("array") else c).cast(kind).alias(name)

    return df.select(*keep, *[value(n, k) for n, k in _NONE.items()])


def _doi_url(doi: Column) -> Column:
    return F.when(present(doi), F.concat(F.lit("https://doi.org/"), doi))


def date_parts(parts: Column) -> Column:
    """Year, month and day as a date; anything shorter as the year only."""
    p = F.get(parts, F.lit(0))
    full = F.format_string("%d-%02d-%02d", F.get(p, F.lit(0)), F.get(p, F.lit(1)), F.get(p, F.lit(2)))
    return F.when(F.size(p) >= 3, full).when(F.size(p) >= 1, F.get(p, F.lit(0)).cast("string"))


def inverted_index(c: Column) -> Column:
    """Text from an index of words to positions; NULL if empty."""
    spread = F.flatten(F.transform(F.map_entries(c), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.nullif(F.array_join(F.transform(F.array_sort(spread), lambda x: x["w"]), " "), F.lit(""))


def from_crossref(df: DataFrame, *keep: str) -> DataFrame:
    """Metadata of a Crossref work."""
    printed, online = F.col("`published-print`.`date-parts`"), F.col("`published-online`.`date-parts`")
    doi = F.col("DOI")
    return _metadata(
        keep, df, source=F.lit("crossref"), doi=doi, doi_url=_doi_url(doi), abstract=F.when(F.col("abstract").isNotNull(), strip_markup(F.col("abstract"))), authors=full_names(F.col("author")),
        publication_date=F.when(printed.isNotNull(), date_parts(printed)).otherwise(date_parts(online)), venue=F.get("`container-title`", F.lit(0)),
        citation_count=F.col("`is-referenced-by-count`"), reference_count=F.col("`references-count`"), subjects=F.col("subject"),
    )


def from_semantic_scholar(df: DataFrame, *keep: str) -> DataFrame:
    """Metadata of a Semantic Scholar paper; a free PDF means open access."""
    doi, pdf = F.col("externalIds.DOI"), F.col("openAccessPdf.url")
    preprint = F.col("externalIds.ArXiv")
    return _metadata(
        keep, df, source=F.lit("semantic_scholar"), doi=doi, doi_url=_doi_url(doi), abstract=F.nullif("abstract", F.lit("")), authors=F.filter(F.transform("authors", lambda a: a["name"]), present),
        publication_date=F.nullif(F.col("year"), F.lit(0)).cast("string"), venue=F.nullif("venue", F.lit("")), citation_count=F.col("citationCount"), reference_count=F.col("referenceCount"),
        arxiv_url=F.when(present(preprint), F.concat(F.lit("https://arxiv.org/abs/"), preprint)), pdf_url=F.nullif(pdf, F.lit("")), is_open_access=F.when(present(pdf), F.lit(True)),
    )


def from_arxiv(df: DataFrame, *keep: str) -> DataFrame:
    """Metadata of an arXiv preprint."""
    return _metadata(
        keep, df, source=F.lit("arxiv"), doi=F.nullif("doi", F.lit("")), doi_url=_doi_url(F.col("doi")), abstract=F.nullif(strip("summary"), F.lit("")), authors=F.col("authors"),
        publication_date=F.date_format(F.try_to_timestamp("published"), "yyyy-MM-dd"), arxiv_url=F.nullif("id", F.lit("")), pdf_url=F.nullif("pdf_url", F.lit("")),
        is_open_access=F.when(present(F.col("pdf_url")), F.lit(True)), subjects=F.col("categories"),
    )


def from_openalex(df: DataFrame, *keep: str) -> DataFrame:
    """Metadata of an OpenAlex work: twenty authors, of the first five concepts those above 0.3, the PDF from three places."""
    names = F.filter(F.transform(F.slice("authorships", 1, 20), lambda a: a["author"]["display_name"]), present)
    top = F.filter(F.slice("concepts", 1, 5), lambda c: present(c["display_name"]) & (F.coalesce(c["score"], F.lit(0.0)) > 0.3))
    places = [F.col("open_access.oa_url"), F.col("best_oa_location.pdf_url"), F.col("primary_location.pdf_url")] if "best_oa_location" in df.columns else [F.col("open_access.oa_url"), F.col("primary_location.pdf_url")]
    return _metadata(
        keep, df, source=F.lit("openalex"), doi=F.when(present(F.col("doi")), F.replace("doi", F.lit("https://doi.org/"), F.lit(""))), doi_url=F.nullif("doi", F.lit("")),
        abstract=inverted_index(F.col("abstract_inverted_index")), authors=F.transform(names, natural_order), publication_date=F.nullif("publication_date", F.lit("")), citation_count=F.col("cited_by_count"),
        venue=F.nullif(F.col("primary_location.source.display_name"), F.lit("")), is_open_access=F.col("open_access.is_oa"), pdf_url=first_present(*places),
        url=F.nullif(F.col("primary_location.landing_page_url"), F.lit("")), subjects=F.transform(top, lambda c: c["display_name"]),
    )


def paper_from_crossref(df: DataFrame, *keep: str) -> DataFrame:
    """The short record of a Crossref work that an ingest needs."""
    year = F.coalesce(*[F.get(F.get(F.col(f"`{k}`.`date-parts`"), F.lit(0)), F.lit(0)) for k in ("published-print", "published-online")])
    join = F.filter(F.transform("author", lambda a: strip(F.concat_ws(" ", F.nullif(strip(a["given"]), F.lit("")), F.nullif(strip(a["family"]), F.lit(""))))), lambda n: n != "")
    return df.select(*keep, F.col("DOI").alias("doi"), F.get("title", F.lit(0)).alias("title"), F.coalesce(join, F.array().cast("array<string>")).alias("authors"), year.cast("string").alias("year"), first_present(F.col("URL"), _doi_url(F.col("DOI"))).alias("url"), F.col("abstract"), F.lit("crossref").alias("source"))


def paper_from_datacite(df: DataFrame, *keep: str) -> DataFrame:
    """The short record of a DataCite DOI; one without a title is none."""
    title = F.get(F.filter(F.transform("titles", lambda t: strip(t["title"])), present), F.lit(0))

    def name(c: Column) -> Column:
        parts = F.concat_ws(" ", F.nullif(strip(c["givenName"]), F.lit("")), F.nullif(strip(c["familyName"]), F.lit("")))
        halves = F.split(strip(c["name"]), ",", 2)
        turned = F.when(F.size(halves) == 2, strip(F.concat_ws(" ", strip(F.get(halves, F.lit(1))), strip(F.get(halves, F.lit(0)))))).otherwise(strip(c["name"]))
        return F.when(parts != "", parts).otherwise(turned)

    about = F.filter(F.transform(F.filter("descriptions", lambda d: d["descriptionType"] == "Abstract"), lambda d: strip(d["description"])), present)
    year = F.nullif(F.col("publicationYear"), F.lit(0)).cast("string")
    out = df.select(*keep, title.alias("title"), F.coalesce(F.filter(F.transform("creators", name), present), F.array().cast("array<string>")).alias("authors"), year.alias("year"), F.nullif("url", F.lit("")).alias("url"), F.get(about, F.lit(0)).alias("abstract"), F.lit("datacite").alias("source"))
    return out.where("title IS NOT NULL")


def open_access_result(payload: Column) -> Column:
    """Whether there is a free copy, and where, from the open-access service's payload."""
    from vellum.schemas import OPEN_ACCESS

    p = F.from_json(payload, OPEN_ACCESS)
    best = p["best_oa_location"]
    return F.struct(F.coalesce(p["is_oa"], F.lit(False)).alias("is_oa"), best["url_for_pdf"].alias("best_oa_pdf_url"), best["license"].alias("license"), best["host_type"].alias("host_type"))
