"""More named queries: each runs an operator over whole tables in the shape its input has, beside SQL written apart from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import files, pages, payloads, scoring, text, urls
from vellum.functions.names import author_objects, author_string
from vellum.operators import archive, cache, freshness, match
from vellum.plans.catalogue import _CACHE, _LATEST, _RUNS, _STRIP, _VALID, NOW, _cache, _joined, _now, _runs, query
from vellum.session import read_table

# --- caches and archives --------------------------------------------------------------------------------------------


@query(f"SELECT enr_id AS entry_hash FROM enriched WHERE coalesce(source <> 'url', false) AND NOT coalesce(fetched_at AT TIME ZONE 'UTC' < {NOW} - INTERVAL 30 DAY, true)")
def cached_entries(spark: SparkSession, d: str) -> DataFrame:
    items = _cache(spark, d)
    return cache.cached(items.select("entry_hash"), items, _now()).select("entry_hash")


@query(f"WITH {_CACHE} SELECT entry_hash FROM c WHERE NOT coalesce(stored < now - INTERVAL 30 DAY, true)")
def purged_cache(spark: SparkSession, d: str) -> DataFrame:
    return cache.purge(_cache(spark, d), _now()).select("entry_hash")


@query("SELECT ord, coalesce(e.key IN (SELECT key FROM enriched WHERE key IS NOT NULL), false) OR coalesce(nullif(lower(trim(e.doi)), '') IN (SELECT lower(trim(doi)) FROM enriched WHERE coalesce(trim(doi), '') <> ''), false) AS is_there FROM entries e")
def inbox_contains(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "entries").select("ord", "key", "doi")
    return archive.contains(rows, read_table(spark, d, "enriched").select("key", "doi")).select("ord", "is_there")


@query(
    """SELECT ord, 'Could not enrich entry: ' || coalesce(key, '') || ' | ' || CASE WHEN coalesce(doi, '') <> '' THEN 'DOI: ' || doi ELSE 'No DOI available' END || ' | ' || CASE WHEN coalesce(title, '') <> '' THEN 'Title length: ' || length(title) || ' chars' ELSE 'No title available' END
    || ' | ' || CASE WHEN coalesce(len(authors), 0) > 0 THEN 'Authors: ' || coalesce(array_to_string(authors[1:2], ', '), '') || CASE WHEN len(authors) > 2 THEN '...' ELSE '' END ELSE 'No authors available' END || ' | APIs: crossref enabled, arxiv enabled' AS reason FROM entries"""
)
def failure_reasons(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "entries")
    return e.select("ord", cache.failure_reason(F.coalesce("key", F.lit("")), F.col("doi"), F.col("title"), F.col("authors"), ["crossref", "arxiv"]).alias("reason"))


@query("WITH r AS (SELECT doc_id, doc_id - doc_id % 10 AS thread FROM documents WHERE doc_id % 10 <> 0 AND doc_id % 3 = 0), f AS (SELECT thread, min(doc_id) AS first FROM r GROUP BY 1) SELECT d.doc_id::varchar AS ts, f.first::varchar AS reply_ts FROM documents d JOIN f ON f.thread = d.doc_id")
def completed_threads(spark: SparkSession, d: str) -> DataFrame:
    """Every tenth message opens a thread that the nine after it reply to, every third of all with a PDF."""
    docs, i = read_table(spark, d, "documents"), F.col("doc_id")
    file = F.struct(F.lit("application/pdf").alias("mimetype"), F.lit(None).cast("string").alias("filetype"))
    replies = docs.where(i % 10 != 0).select((i - i % 10).cast("string").alias("thread_ts"), i.cast("string").alias("ts"), F.when(i % 3 == 0, F.array(file)).alias("files"))
    return archive.completed(docs.select(i.cast("string").alias("ts")), replies).select("ts", "reply_ts")


@query("SELECT doc_id FROM documents WHERE doc_id > 100.5 AND doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_kind = 'note')")
def unseen_messages(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents").select("doc_id", "doc_kind", F.col("doc_id").cast("string").alias("ts"))
    return archive.unseen(docs, docs.where("doc_kind = 'note'"), "100.5").select("doc_id")


# --- scores, ages, files --------------------------------------------------------------------------------------------


@query(
    """SELECT enr_id, coalesce(c > 0.75, false) AS crossref, coalesce(c > 0.7, false) AS openalex, coalesce(c > 0.7, false) AS semantic_scholar, coalesce(c > 0.6, false) AS arxiv
    FROM (SELECT enr_id, CASE WHEN confidence_score::varchar <> 'nan' THEN confidence_score END AS c FROM enriched)"""
)
def accepted_scores(spark: SparkSession, d: str) -> DataFrame:
    c = F.when(~F.isnan("confidence_score"), F.col("confidence_score"))
    return read_table(spark, d, "enriched").select("enr_id", *[F.coalesce(match.accepted(p, c), F.lit(False)).alias(p) for p in match.GATES])


@query(
    """WITH a AS (SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN value END AS x, CASE WHEN event_id % 7 <> 0 THEN value * 1.5 - 20 END AS y FROM events)
    SELECT event_id, round(CASE WHEN x IS NOT NULL AND x <= 50 THEN x WHEN x IS NULL THEN y WHEN y IS NULL THEN x ELSE least(x, y) END, 6) AS age FROM a"""
)
def confirmed_ages(spark: SparkSession, d: str) -> DataFrame:
    e, i = read_table(spark, d, "events"), F.col("event_id")
    x, y = F.when(i % 9 != 0, F.col("value")), F.when(i % 7 != 0, F.col("value") * 1.5 - 20)
    return e.select("event_id", F.round(scoring.confirmed_age(x, y, F.lit(50.0)), 6).alias("age"))


@query(
    r"""WITH p AS (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 404 WHEN doc_id % 19 <> 0 THEN 200 END AS status,
    CASE doc_id % 5 WHEN 0 THEN 'text/html' WHEN 1 THEN 'application/octet-stream' WHEN 2 THEN 'Application/PDF; charset=x' WHEN 3 THEN 'application/pdf' END AS kind, (doc_id * 137) % 30000 AS n FROM documents)
    SELECT doc_id, CASE WHEN coalesce(status, 0) <> 200 THEN 'http_status' WHEN NOT (coalesce(kind, '') ILIKE 'application/pdf%' OR (coalesce(kind, '') = 'application/octet-stream' AND doc_id % 2 = 0)) THEN 'content_type' WHEN n + 5 < 10240 THEN 'too_small' WHEN doc_id % 23 = 0 THEN 'no_magic' END AS reason FROM p"""
)
def pdf_checks(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    url = F.concat(F.lit("https://files.example.org/"), i.cast("string"), F.when(i % 2 == 0, ".PDF?x=1").otherwise(""))
    kind = F.when(i % 5 == 0, "text/html").when(i % 5 == 1, "application/octet-stream").when(i % 5 == 2, "Application/PDF; charset=x").when(i % 5 == 3, "application/pdf")
    body = F.concat(F.when(i % 23 == 0, "%HTM-").otherwise("%PDF-"), F.repeat(F.lit("x"), ((i * 137) % 30000).cast("int"))).cast("binary")
    return read_table(spark, d, "documents").select("doc_id", files.pdf_reason(url, F.when(i % 17 == 0, 404).when(i % 19 != 0, 200), kind, body).alias("reason"))


@query(
    f"""WITH {_RUNS}, t AS (SELECT DISTINCT user_id::varchar AS repo, event_type AS workflow FROM events), c AS (SELECT repo, workflow, max(began) FILTER (event = 'schedule' AND conclusion = 'success') AS m FROM r GROUP BY 1, 2), o AS (SELECT user_id::varchar AS repo, max(ts) AS m FROM events WHERE event_id % 2 = 0 GROUP BY 1)
    SELECT t.repo || '/' || t.workflow AS key, CASE WHEN c.m IS NULL THEN 'never_ran' ELSE 'stale' END AS finding FROM t LEFT JOIN c ON c.repo = t.repo AND c.workflow = t.workflow WHERE c.m IS NULL OR date_sub('second', c.m, {NOW}) / 86400.0 > 150
    UNION ALL SELECT t.repo || '/out', CASE WHEN o.m IS NULL THEN 'unreadable' ELSE 'stale' END FROM t LEFT JOIN o ON o.repo = t.repo WHERE o.m IS NULL OR date_sub('second', o.m, {NOW}) / 86400.0 > 140"""
)
def target_findings(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events")
    targets = e.select(F.col("user_id").cast("string").alias("repo"), F.col("event_type").alias("workflow")).distinct().select("repo", "workflow", F.lit(150.0).alias("cron_max_days"), F.lit("out").alias("path"), F.lit(140.0).alias("output_max_days"))
    commits = e.where("event_id % 2 = 0").select(F.col("user_id").cast("string").alias("repo"), F.lit("out").alias("path"), F.col("ts").cast("timestamp").alias("committed_at"))
    return freshness.target_findings(targets, _runs(spark, d), commits, _now())


@query("SELECT DISTINCT 'https://github.com/' || user_id || '/actions/workflows/' || event_type AS runs, 'https://github.com/' || user_id || '/commits' || CASE WHEN event_type <> 'view' THEN '/HEAD/' || event_type ELSE '' END AS commits FROM events")
def probe_pages(spark: SparkSession, d: str) -> DataFrame:
    repo, what = F.col("user_id").cast("string"), F.col("event_type")
    return read_table(spark, d, "events").select(urls.runs_url(repo, what).alias("runs"), urls.commits_url(repo, F.when(what != "view", what)).alias("commits")).distinct()


# --- dates ----------------------------------------------------------------------------------------------------------


@query(r"SELECT enr_id, strftime(try_strptime(CASE WHEN regexp_matches(publication_date, '^\d{4}-\d{2}-\d{2}$') THEN publication_date END, '%Y-%m-%d'), '%a, %d %b %Y %H:%M:%S +0000') AS rss FROM enriched")
def rss_dates(spark: SparkSession, d: str) -> DataFrame:
    day = F.when(F.col("publication_date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col("publication_date"))
    return read_table(spark, d, "enriched").select("enr_id", scoring.rss_date(F.concat(day, F.lit("T00:00:00Z"))).alias("rss"))


@query(
    r"""SELECT ord, strftime(try_strptime(CASE WHEN regexp_matches(year, '^\d{4}$') THEN year END || '-' || CASE WHEN regexp_matches(month, '^\d{1,2}$') THEN lpad(month, 2, '0') || '-15' ELSE '01-01' END, '%Y-%m-%d'), '%Y-%m-%d') AS day FROM entries"""
)
def publication_times(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "entries").select("ord", F.date_format(scoring.publication_time(F.col("year"), F.col("month")), "yyyy-MM-dd").alias("day"))


# --- payloads -------------------------------------------------------------------------------------------------------


def _parts(c: Column) -> Column:
    return F.when(c.isNotNull(), F.struct(F.array(F.transform(F.split(c, "-"), lambda x: x.cast("int"))).alias("date-parts")))


def _authors(w: DataFrame) -> Column:
    return F.transform(F.coalesce("authorships", F.array().cast(w.schema["authorships"].dataType)), lambda a: a["author"]["display_name"])


@query(
    rf"""WITH w AS (SELECT *, list_transform(coalesce(authorships, []), lambda a: a.author.display_name) AS ns, CASE WHEN regexp_matches(publication_date, '^\d{{4}}(-\d{{2}}-\d{{2}})?$') THEN publication_date END AS pd FROM works)
    SELECT work_id, doi, CASE WHEN coalesce(doi, '') <> '' THEN 'https://doi.org/' || doi END AS doi_url, {_STRIP.format('title')} AS abstract, array_to_string(list_filter(list_transform(ns, lambda n: CASE WHEN contains(n, ',') THEN trim(string_split(n, ',')[2]) || ' ' || trim(string_split(n, ',')[1]) ELSE n END), lambda x: x IS NOT NULL), '|') AS authors,
    CASE WHEN work_id % 3 = 0 THEN pd WHEN work_id % 3 = 1 THEN substr(pd, 1, 4) END AS publication_date, primary_location.source.display_name AS venue, cited_by_count AS citation_count FROM w"""
)
def crossref_metadata(spark: SparkSession, d: str) -> DataFrame:
    w, i, none = read_table(spark, d, "works"), F.col("work_id"), F.lit(None)
    person = lambda n: F.struct(F.when(n.contains(","), F.trim(F.get(F.split(n, ","), F.lit(1)))).alias("given"), F.when(n.contains(","), F.trim(F.get(F.split(n, ","), F.lit(0)))).otherwise(n).alias("family"))
    date = F.when(F.col("publication_date").rlike(r"^\d{4}(-\d{2}-\d{2})?$"), F.col("publication_date"))
    sent = w.select(
        "work_id", F.col("doi").alias("DOI"), F.col("title").alias("abstract"), F.transform(_authors(w), person).alias("author"), F.array("primary_location.source.display_name").alias("container-title"), _parts(F.when(i % 3 == 0, date)).alias("published-print"),
        _parts(F.when(i % 3 == 1, F.substring(date, 1, 4))).alias("published-online"), F.col("cited_by_count").alias("is-referenced-by-count"), none.cast("int").alias("references-count"), none.cast("array<string>").alias("subject"),
    )
    return payloads.from_crossref(sent, "work_id").select("work_id", "doi", "doi_url", F.coalesce("abstract", F.lit("")).alias("abstract"), F.array_join("authors", "|").alias("authors"), "publication_date", "venue", "citation_count")


@query(
    r"""SELECT work_id, doi, CASE WHEN work_id % 2 = 0 THEN 'https://arxiv.org/abs/2001.' || work_id END AS arxiv_url, nullif(primary_location.pdf_url, '') AS pdf_url, CASE WHEN coalesce(primary_location.pdf_url, '') <> '' THEN true END AS is_open_access,
    CASE WHEN regexp_matches(publication_date, '^\d{4}') THEN substr(publication_date, 1, 4) END AS publication_date, array_to_string(list_filter(list_transform(coalesce(authorships, []), lambda a: a.author.display_name), lambda x: coalesce(x, '') <> ''), '|') AS authors FROM works"""
)
def semantic_scholar_metadata(spark: SparkSession, d: str) -> DataFrame:
    w, i, none = read_table(spark, d, "works"), F.col("work_id"), F.lit(None)
    sent = w.select(
        "work_id", none.cast("string").alias("abstract"), none.cast("string").alias("venue"), none.cast("int").alias("citationCount"), none.cast("int").alias("referenceCount"), F.when(F.col("publication_date").rlike(r"^\d{4}"), F.substring("publication_date", 1, 4).cast("int")).alias("year"),
        F.struct(F.col("doi").alias("DOI"), F.when(i % 2 == 0, F.concat(F.lit("2001."), i.cast("string"))).alias("ArXiv")).alias("externalIds"), F.struct(F.col("primary_location.pdf_url").alias("url")).alias("openAccessPdf"), F.transform(_authors(w), lambda n: F.struct(n.alias("name"))).alias("authors"),
    )
    return payloads.from_semantic_scholar(sent, "work_id").select("work_id", "doi", "arxiv_url", "pdf_url", "is_open_access", "publication_date", F.array_join("authors", "|").alias("authors"))


@query(
    r"""SELECT ord, nullif(doi, '') AS doi, CASE WHEN coalesce(doi, '') <> '' THEN 'https://doi.org/' || doi END AS doi_url, nullif(regexp_replace(abstract, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '') AS abstract, strftime(discovery_date AT TIME ZONE 'UTC', '%Y-%m-%d') AS publication_date,
    nullif(url, '') AS arxiv_url, CASE WHEN ord % 2 = 0 THEN 'https://x.org/' || ord END AS pdf_url, CASE WHEN ord % 2 = 0 THEN true END AS is_open_access FROM entries"""
)
def arxiv_metadata(spark: SparkSession, d: str) -> DataFrame:
    e, i = read_table(spark, d, "entries"), F.col("ord")
    sent = e.select("ord", "doi", F.col("abstract").alias("summary"), "authors", F.date_format("discovery_date", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published"), F.col("url").alias("id"), F.when(i % 2 == 0, F.concat(F.lit("https://x.org/"), i.cast("string"))).alias("pdf_url"), F.col("keywords").alias("categories"))
    return payloads.from_arxiv(sent, "ord").select("ord", "doi", "doi_url", "abstract", "publication_date", "arxiv_url", "pdf_url", "is_open_access")


@query("SELECT work_id, coalesce(open_access.is_oa, false) AS is_oa, CASE WHEN work_id % 3 <> 0 THEN primary_location.pdf_url END AS best_oa_pdf_url FROM works")
def open_access_results(spark: SparkSession, d: str) -> DataFrame:
    best = F.when(F.col("work_id") % 3 != 0, F.struct(F.col("primary_location.pdf_url").alias("url_for_pdf"), F.lit("cc-by").alias("license")))
    r = payloads.open_access_result(F.to_json(F.struct(F.col("open_access.is_oa").alias("is_oa"), best.alias("best_oa_location"))))
    return read_table(spark, d, "works").select("work_id", r["is_oa"].alias("is_oa"), r["best_oa_pdf_url"].alias("best_oa_pdf_url"))


@query(r"SELECT work_id, nullif(regexp_replace(regexp_extract(coalesce(doi, ''), '\b(10\.\d{4,9}/[-._;()/:A-Za-z0-9]+)', 1), '[.,;)]+$', ''), '') AS doi, CASE WHEN regexp_matches(publication_date, '(?:19|20)\d{2}') THEN regexp_extract(publication_date, '\b((?:19|20)\d{2})\b', 1) END AS year, coalesce(len(list_filter(list_transform(authorships, lambda a: a.author.display_name), lambda n: coalesce(trim(n), '') <> '')), 0) AS n_authors FROM works")
def landing_page_meta(spark: SparkSession, d: str) -> DataFrame:
    """Pages with the tags of lower ranks, attributes in either order and either quotation mark."""
    w = read_table(spark, d, "works")
    people = F.array_join(F.transform(_authors(w), lambda n: F.concat(F.lit('<meta content="'), text.escape_html(n), F.lit('" name="dc.creator">'))), "")
    html = F.concat(F.lit("<META NAME='DC.Identifier' content='doi:"), F.coalesce("doi", F.lit("")), F.lit("'><meta name=dc.x><meta property=\"article:published_time\" content=\""), F.coalesce("publication_date", F.lit("")), F.lit('">'), people)
    p = w.select("work_id", html.alias("html")).withColumn("tags", pages.meta_tags(F.col("html")))
    m = pages.page_meta(F.col("html"), F.col("tags"))
    return p.select("work_id", pages.page_doi(F.col("tags")).alias("doi"), m["year"].alias("year"), F.size(m["authors"]).cast("bigint").alias("n_authors"))


# --- parts of feed items --------------------------------------------------------------------------------------------


@query(
    f"""WITH {_LATEST}, n AS (SELECT j.*, m.authors AS mau FROM j LEFT JOIN m USING (key)) SELECT ord, coalesce(array_to_string(CASE WHEN coalesce(len(mau), 0) > 0 THEN mau ELSE authors END, '|'), '') AS names, nullif(replace(array_to_string(authors, ', '), ' and ', ', '), '') AS creator FROM n"""
)
def feed_authors(spark: SparkSession, d: str) -> DataFrame:
    named = author_objects(F.col("md.authors"), F.col("authors"))
    return _joined(spark, d).select("ord", F.array_join(F.transform(named, lambda a: a["name"]), "|").alias("names"), author_string(F.col("authors")).alias("creator"))


_PRETTY = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
_NO_BRACES = r"regexp_replace(regexp_replace(title, '[{}]', '', 'g'), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')"


@query(f"SELECT ord, CASE WHEN {_VALID.format('title')} THEN {_PRETTY.format(_NO_BRACES)} END AS title FROM entries")
def feed_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles to show where they are valid; those taken from a URL are the business of ``titles_from_urls``."""
    return read_table(spark, d, "entries").select("ord", F.when(text.valid_title(F.col("title")), urls.display_title(F.col("title"), F.col("url"))).alias("title"))


_SPARE = r"""regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(trim({0}), '\\url\{{([^}}]*)\}}', '\1', 'g'), '\_', '_'), '\&', '&'), '\%', '%'), '\#', '#'), '\{{', '{{'), '\}}', '}}'), '\~', '~'), '\\', '\'), '\\([a-zA-Z_])', '\1', 'g')"""


@query(
    f"""WITH {_LATEST} SELECT ord, coalesce({', '.join(_SPARE.format(f"nullif({u}, '')") if u else "CASE WHEN coalesce(doi, '') <> '' THEN 'https://doi.org/' || doi END" for u in ('doi_url', '', 'arxiv_url', 'murl', 'pdf_url', 'url'))},
    CASE WHEN coalesce(title, '') <> '' THEN 'https://scholar.google.com/scholar?q=' || replace(url_encode(substr(title, 1, 150)), '%2F', '/') END) AS link FROM j"""
)
def feed_links(spark: SparkSession, d: str) -> DataFrame:
    m = lambda f: F.col(f"md.{f}")
    return _joined(spark, d).select("ord", urls.primary_link(m("doi_url"), F.col("doi"), m("arxiv_url"), m("url"), m("pdf_url"), F.col("url"), F.col("title")).alias("link"))
