"""The enrichment run: from entries and what providers answered to metadata and an updated cache.

Answers are rows: key of the entry, how it was asked (by ``doi``, ``title`` or the title in its URL, ``url_title``), ``pos`` on the page, the answer's
``title`` and ``score``, and the columns of ``schemas.METADATA``. ``ask`` gets them through an injected transport; tables of answers serve as well.
Everything is a union of candidate rows with a rank, and one aggregation by key takes the first: no entry is looked at one by one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum import schemas
from vellum.functions import payloads
from vellum.functions.names import author_string
from vellum.functions.similarity import match_score
from vellum.functions.text import present, search_title, valid_title
from vellum.functions.urls import clean_url, open_host, quote, title_from_url
from vellum.operators import cache
from vellum.operators.match import accepted, first_provider, is_preprint
from vellum.sources.fetch import Fetcher, fetch

#: Providers in the order in which they are believed, and the most candidates of a page. Fixed values.
ORDER = ("crossref", "openalex", "semantic_scholar")
PAGE = {"crossref": 10, "openalex": 10, "semantic_scholar": 20, "arxiv": 10}
#: Least length of a title found in a URL to search with.
LEAST_TITLE = 10
#: Where providers are asked. Fixed values.
BY_DOI = {"crossref": "https://api.crossref.org/works/", "openalex": "https://api.openalex.org/works/https://doi.org/", "semantic_scholar": "https://api.semanticscholar.org/graph/v1/paper/DOI:"}
BY_TITLE = {"crossref": "https://api.crossref.org/works?rows=10&query.title=", "openalex": "https://api.openalex.org/works?per-page=10&search=", "semantic_scholar": "https://api.semanticscholar.org/graph/v1/paper/search?limit=20&query="}
_SHAPES = {"crossref": (schemas.CROSSREF, "message", "message.items", payloads.from_crossref), "openalex": (schemas.OPENALEX, None, "results", payloads.from_openalex), "semantic_scholar": (schemas.SEMANTIC_SCHOLAR, None, "data", payloads.from_semantic_scholar)}
_IDS = {"crossref": "DOI", "openalex": "doi", "semantic_scholar": "externalIds"}
_FIELDS = ("abstract", "doi", "doi_url", "url", "arxiv_url", "pdf_url", "publication_date", "citation_count", "reference_count", "venue", "authors", "keywords", "subjects", "is_open_access", "source", "confidence_score")


def questions(entries: DataFrame) -> DataFrame:
    """key, asked, title, year, doi: what may be asked about each entry, by DOI, title, and the title in its URL."""
    found = title_from_url(clean_url(F.col("url")))
    ways = F.array(
        F.struct(F.lit("doi").alias("asked"), F.lit(None).cast("string").alias("title"), present(F.col("doi")).alias("ok")),
        F.struct(F.lit("title").alias("asked"), F.col("title").alias("title"), valid_title(F.col("title")).alias("ok")),
        F.struct(F.lit("url_title").alias("asked"), found.alias("title"), (F.length(found) >= LEAST_TITLE).alias("ok")),
    )
    rows = entries.select("key", "doi", "year", author_string(F.col("authors")).alias("authors"), F.explode(F.filter(ways, lambda w: F.coalesce(w["ok"], F.lit(False)))).alias("w"))
    return rows.select("key", "w.asked", "w.title", "year", "doi", "authors")


def ask(asked: DataFrame, provider: str, make: Callable[[], Fetcher], clients: int = 1) -> DataFrame:
    """The answers of a provider to ``questions``; bodies that don't parse are no answers."""
    by_doi = F.col("asked") == "doi"
    url = F.when(by_doi, F.concat(F.lit(BY_DOI[provider]), quote("doi"))).otherwise(F.concat(F.lit(BY_TITLE[provider]), quote(search_title(F.col("title")))))
    requests = asked.withColumns({"_id": F.concat_ws("\u0001", "asked", "key"), "_url": url})
    got = fetch(requests.select("_id", "_url"), make, "_id", "_url", clients).where("status = 200")
    record, one, many, read = _SHAPES[provider]
    inner = f"STRUCT<{', '.join(_typed(c) for c in _columns(record))}>"
    single, listed = (f"{one} {inner}" if one else record), f"{many.split('.')[0]} " + (f"STRUCT<items: ARRAY<{inner}>>" if "." in many else f"ARRAY<{inner}>")
    a, b = F.from_json("body", single), F.from_json("body", listed)
    rows = F.when(F.col("_id").startswith("doi\u0001"), F.array(a[one] if one else a)).otherwise(b[many.split(".")[0]]["items"] if "." in many else b[many])
    each = got.select("_id", F.posexplode(rows).alias("pos", "r")).where(F.col("r.title").isNotNull() | F.col(f"r.{_IDS[provider]}").isNotNull()).select("_id", "pos", "r.*")
    title = F.get("title", F.lit(0)) if provider == "crossref" else F.col("title")
    score = F.col("score") if provider == "crossref" else F.lit(None).cast("double")
    meta = read(each.withColumns({"_title": title, "_score": score}), "_id", "pos", "_title", "_score")
    part = F.split("_id", "\u0001", 2)
    return meta.select(F.get(part, F.lit(1)).alias("key"), F.get(part, F.lit(0)).alias("asked"), "pos", F.col("_title").alias("title"), F.col("_score").alias("score"), *_FIELDS)


def _columns(ddl: str) -> list[str]:
    """Columns of a schema text, split at commas outside of angle brackets."""
    out, depth = [""], 0
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append("")
        else:
            out[-1] += c
    return [c.strip() for c in out]


def _typed(column: str) -> str:
    name, kind = column.split(" ", 1)
    return f"{name}: {kind}"


def best_answers(asked: DataFrame, answers: DataFrame, provider: str) -> DataFrame:
    """key, asked, and metadata: for each question the best answer that passes the provider's gates; by DOI the first one."""
    on_page = answers.where(F.col("pos") < PAGE[provider]).withColumnRenamed("title", "_found")
    q = asked.select("key", "asked", "title", F.col("authors").alias("_asked_authors"))
    met = on_page.join(q, ["key", "asked"])
    boost = F.col("score") if provider == "crossref" else None
    s = F.round(match_score(search_title(F.col("title")), search_title(F.col("_found")), F.col("_asked_authors"), F.col("authors"), boost), 9)
    scored = met.withColumn("_s", F.when(F.col("asked") == "doi", F.lit(None).cast("double")).otherwise(s))
    good = scored.where(F.col("_s").isNull() | accepted(provider, F.col("_s")))
    top = good.withColumn("confidence_score", F.coalesce("_s", "confidence_score")).groupBy("key", "asked").agg(F.max(F.struct("_s", (-F.col("pos")).alias("_p"), *_FIELDS)).alias("b"))
    return top.select("key", "asked", *[F.col(f"b.{f}").alias(f) for f in _FIELDS])


def minimal(entries: DataFrame) -> DataFrame:
    """key and metadata of the last resort: the entry's URL, and whether its host publishes openly."""
    url = clean_url(F.col("url"))
    known: dict[str, Column] = {"url": url, "source": F.lit("url"), "is_open_access": F.when(open_host(url), F.lit(True))}
    kinds = {"citation_count": "int", "reference_count": "int", "is_open_access": "boolean", "confidence_score": "double"} | dict.fromkeys(("authors", "keywords", "subjects"), "array<string>")
    return entries.where(present(F.col("url"))).select("key", *[(F.array().cast("array<string>") if f in ("authors", "keywords", "subjects") else known.get(f, F.lit(None)).cast(kinds.get(f, "string"))).alias(f) for f in _FIELDS])


def chosen(entries: DataFrame, answers: dict[str, DataFrame], overrides: DataFrame | None = None) -> DataFrame:
    """key, provider, and metadata of each entry, from the first that knows it: a curated record (``overrides``, by key), the preprint server for
    preprints, providers by DOI, by title, by the title in the URL, at last the URL itself."""
    asked = questions(entries)
    results: list[tuple[str, DataFrame]] = []
    if overrides is not None:
        results.append(("override", overrides.select("key", *_FIELDS)))
    if "arxiv" in answers:
        preprints = entries.where(is_preprint(F.col("journal"), F.col("doi"), F.col("url"), F.col("raw_fields"))).select("key")
        results.append(("arxiv", best_answers(asked.where("asked = 'title'"), answers["arxiv"], "arxiv").join(preprints, "key", "left_semi").drop("asked")))
    best = {p: best_answers(asked, answers[p], p) for p in ORDER if p in answers}
    results += [(f"{p}:{way}", df.where(F.col("asked") == way).drop("asked")) for way in ("doi", "title", "url_title") for p, df in best.items()]
    results.append(("url", minimal(entries)))
    return first_provider(results)


def run(entries: DataFrame, table: DataFrame, answers: Callable[[DataFrame], dict[str, DataFrame]], now: Column, overrides: DataFrame | None = None, use_cached: bool = True) -> tuple[DataFrame, DataFrame]:
    """Metadata by key (``schemas.ENRICHED``) and the new cache (``schemas.METADATA_CACHE``) of entries with ``entry_hash``, one a key.

    Only entries without a good item are asked about; what they give is put over the old items, failures with their reason. With
    ``use_cached`` the cached metadata stand beside the new, which wins."""
    open_ = cache.uncached(entries, table, now)
    new = chosen(open_, answers(open_), overrides)
    meta = F.struct(*_FIELDS)
    stamp = now.cast("timestamp_ntz")
    given = open_.select("entry_hash", F.col("key").alias("entry_key"), F.col("title").alias("entry_title"), "doi", "authors").join(new.select(F.col("key").alias("entry_key"), meta.alias("metadata")), "entry_key", "left")
    failed = F.col("metadata").isNull()
    rows = given.select(
        "entry_hash", "entry_key", "entry_title", stamp.alias("cached_at"), "metadata", failed.alias("failed"),
        F.when(failed, cache.failure_reason(F.col("entry_key"), F.col("doi"), F.col("entry_title"), F.col("authors"), list(ORDER))).alias("failure_reason"), F.when(failed, stamp).alias("last_failure_at"),
    )
    saved = cache.merge(table.select(*rows.columns), rows, "entry_hash")
    fresh = new.select("key", *_FIELDS)
    if not use_cached:
        return fresh, saved
    old = cache.cached(entries, table, now).select("key", *[F.col(f"metadata.{f}").alias(f) for f in _FIELDS])
    return cache.merge(old, fresh), saved
