"""The named queries over the driver's tables and the SQL that each is checked against.

Times are fixed where a rule needs the present; arrays are joined to text so that results compare by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import files, ids, names, pages, payloads, scoring, text, urls
from vellum.operators import archive, cache, dedup, feed, freshness, index, match
from vellum.session import read_table
from vellum.sources import bibtex

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
NOW = "TIMESTAMP '2024-06-01 00:00:00'"


def query(sql: str | None = None) -> Callable:
    """Registers a query under its name, with the SQL that checks it."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _now():  # noqa: ANN202
    return F.expr(NOW)


# --- texts and identifiers ------------------------------------------------------------------------------------------

_STRIP = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce({0}, ''),
 '</jats:(?:p|title|sec|abstract)>', ' ', 'g'), '</?jats:[^>]+>', '', 'g'), '(?i)</(?:p|title|div|section|br)>', ' ', 'g'),
 '(?i)</?(?:p|title|sec|italic|bold|sub|sup|br|span|div|em|strong)[^>]*>', '', 'g'), '<[^>]+>', '', 'g'), '[\s\p{{Z}}]+', ' ', 'g'))"""
_VALID = r"""(coalesce({0}, '') <> '' AND lower(trim({0})) NOT IN ('untitled', 'no title', 'unknown', 'n/a', 'na', 'none', 'title', 'paper', 'article', 'document', 'pdf')
 AND length(lower(trim({0}))) >= 5 AND NOT regexp_matches({0}, '^[^\p{{L}}_]+$'))"""


@query(f"SELECT enr_id, {_STRIP.format('abstract')} AS text FROM enriched")
def strip_markup(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "enriched").select("enr_id", text.strip_markup(F.col("abstract")).alias("text"))


@query("SELECT doc_id, replace(replace(replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS html FROM documents")
def escape_html(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", text.escape_html(F.col("text")).alias("html"))


@query(
    r"""WITH t AS (SELECT ord, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(title, ''), '\\[a-zA-Z]+\{([^}]*)\}', '\1', 'g'), '[{}]', '', 'g'), '[^\p{L}\p{N}_\s\p{Z}\-:'']', ' ', 'g'), '[\s\p{Z}]+', ' ', 'g')) AS search FROM entries)
    SELECT ord, search, length(search) >= 10 AS long_enough FROM t"""
)
def search_titles(spark: SparkSession, d: str) -> DataFrame:
    t = text.search_title(F.col("title"))
    return read_table(spark, d, "entries").select("ord", t.alias("search"), (F.length(t) >= 10).alias("long_enough"))


@query(f"SELECT ord, {_VALID.format('title')} AS valid FROM entries")
def valid_titles(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "entries").select("ord", text.valid_title(F.col("title")).alias("valid"))


@query("SELECT ord, substr(sha256(coalesce(title, '') || coalesce(array_to_string(authors, ','), '') || coalesce(year, '') || coalesce(doi, '')), 1, 16) AS entry_hash FROM entries")
def entry_hashes(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "entries").select("ord", ids.entry_hash(F.col("title"), F.col("authors"), F.col("year"), F.col("doi")).alias("entry_hash"))


@query(
    r"""SELECT ord, trim(regexp_replace(doi, '(?i)^(?:doi:)?(?:https?://)?(?:(?:dx\.)?doi\.org/)?', '')) AS parsed,
    trim(replace(replace(replace(doi, 'https://doi.org/', ''), 'http://dx.doi.org/', ''), 'doi:', '')) AS client,
    lower(trim(regexp_replace(trim(doi), '(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:)', ''))) AS open_access,
    nullif(regexp_replace(lower(trim(regexp_replace(trim(doi), '(?i)^(?:https?://)?(?:dx\.)?doi\.org/', ''))), '\.+$', ''), '') AS archive,
    coalesce(length(doi) >= 7 AND starts_with(doi, '10.') AND instr(substr(doi, 4), '/') > 0, false) AS valid FROM entries"""
)
def doi_forms(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("doi")
    return read_table(spark, d, "entries").select("ord", ids.doi_parsed(c).alias("parsed"), ids.doi_client(c).alias("client"), ids.doi_open_access(c).alias("open_access"), ids.doi_archive(c).alias("archive"), ids.valid_doi(c).alias("valid"))


@query(
    r"""SELECT ord, coalesce(nullif(regexp_extract(year, '\b((?:19|20)\d{2})\b', 1), ''), trim(year)) AS year4,
    CASE WHEN lower(trim(month)) IN ('jan', 'january') THEN '01' WHEN lower(trim(month)) IN ('feb', 'february') THEN '02' WHEN lower(trim(month)) IN ('mar', 'march') THEN '03'
    WHEN lower(trim(month)) IN ('apr', 'april') THEN '04' WHEN lower(trim(month)) = 'may' THEN '05' WHEN lower(trim(month)) IN ('jun', 'june') THEN '06' WHEN lower(trim(month)) IN ('jul', 'july') THEN '07'
    WHEN lower(trim(month)) IN ('aug', 'august') THEN '08' WHEN lower(trim(month)) IN ('sep', 'september') THEN '09' WHEN lower(trim(month)) IN ('oct', 'october') THEN '10' WHEN lower(trim(month)) IN ('nov', 'november') THEN '11'
    WHEN lower(trim(month)) IN ('dec', 'december') THEN '12' WHEN regexp_extract(lower(trim(month)), '\b(0?[1-9]|1[0-2])\b', 1) <> '' THEN lpad(regexp_extract(lower(trim(month)), '\b(0?[1-9]|1[0-2])\b', 1), 2, '0') END AS month2 FROM entries"""
)
def years_and_months(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "entries").select("ord", text.extract_year(F.col("year")).alias("year4"), text.normalize_month(F.col("month")).alias("month2"))


@query(
    r"""WITH a AS (SELECT unnest(authors) AS name FROM enriched UNION SELECT unnest(authors) FROM entries), p AS (SELECT name, list_transform(string_split(name, ','), lambda x: trim(x)) AS h FROM a WHERE name IS NOT NULL)
    SELECT name, CASE WHEN len(h) <> 2 THEN name WHEN h[1] <> '' AND h[2] <> '' THEN h[2] || ' ' || h[1] ELSE trim(name) END AS natural_name,
    trim(string_split(string_split(name, ' and ')[1], ',')[1]) AS first_author FROM p"""
)
def natural_names(spark: SparkSession, d: str) -> DataFrame:
    of = lambda t: read_table(spark, d, t).select(F.explode("authors").alias("name"))
    rows = of("enriched").unionByName(of("entries")).where("name IS NOT NULL").distinct()
    return rows.select("name", names.natural_order(F.col("name")).alias("natural_name"), names.first_author(F.col("name")).alias("first_author"))


_CLEAN = r"""regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(trim(coalesce({0}, '')), '\\url\{{([^}}]*)\}}', '\1', 'g'),
 '\_', '_'), '\&', '&'), '\%', '%'), '\#', '#'), '\{{', '{{'), '\}}', '}}'), '\~', '~'), '\\', '\'), '\\([a-zA-Z_])', '\1', 'g')"""


@query(
    f"""WITH u AS (SELECT ord, url, {_CLEAN.format('url')} AS clean FROM entries), v AS (SELECT ord, url, clean, trim(clean) AS c FROM u)
    SELECT ord, clean, CASE WHEN coalesce(url, '') = '' THEN NULL ELSE replace(replace(replace(replace(CASE WHEN starts_with(lower(c), 'http://') OR starts_with(lower(c), 'https://') THEN c
    WHEN contains(c, '://') OR starts_with(lower(c), 'javascript:') OR starts_with(lower(c), 'data:') OR starts_with(lower(c), 'vbscript:') THEN NULL
    WHEN contains(c, '.') AND NOT starts_with(c, '/') THEN 'https://' || c END, '"', '%22'), '''', '%27'), '<', '%3C'), '>', '%3E') END AS valid FROM v"""
)
def clean_urls(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "entries").select("ord", urls.clean_url(F.col("url")).alias("clean"), urls.validate_url(F.col("url")).alias("valid"))


@query(
    r"""WITH p AS (SELECT ord, regexp_replace(regexp_replace(regexp_extract(coalesce(url, ''), '^[a-z]+://[^/?#]+([^?#]*)', 1), '(?i)\.(pdf|html?|aspx?|php|xml)$', ''), '/+$', '') AS path FROM entries),
    s AS (SELECT ord, list_filter(string_split(path, '/'), lambda x: x <> '' AND NOT regexp_matches(x, '^\d+$'))[-1] AS seg FROM p),
    w AS (SELECT ord, seg, list_filter(string_split_regex(replace(replace(url_decode(seg), '-', ' '), '_', ' '), '[\s\p{Z}]+'), lambda x: x <> '') AS words FROM s)
    SELECT ord, CASE WHEN seg IS NOT NULL AND lower(seg) NOT IN ('article', 'paper', 'abstract', 'view', 'content', 'doi', 'full', 'download', 'index') AND len(words) >= 2 AND len(list_filter(words, lambda x: NOT regexp_matches(x, '^\d+$'))) > 0
    THEN array_to_string(list_transform(words, lambda x: upper(x[1]) || lower(x[2:])), ' ') ELSE '' END AS title FROM w"""
)
def titles_from_urls(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "entries").select("ord", urls.title_from_url(F.col("url")).alias("title"))


@query("SELECT ord, coalesce(regexp_matches(lower(url), 'arxiv\\.org|biorxiv\\.org|medrxiv\\.org|osf\\.io|zenodo\\.org|ssrn\\.com|researchgate\\.net'), false) AS open FROM entries")
def open_hosts(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "entries").select("ord", urls.open_host(F.col("url")).alias("open"))


@query(
    r"""WITH a AS (SELECT ord, coalesce(regexp_replace(list_filter(string_split_regex(authors[1], '[\s\p{Z}]+'), lambda x: x <> '')[-1], '[^A-Za-z]', '', 'g'), '') AS s, CASE WHEN regexp_matches(coalesce(year, ''), '^\d{4}$') THEN year ELSE 'ND' END AS y FROM entries)
    SELECT ord, CASE WHEN s = '' AND y = 'ND' THEN 'Slack' || substr(ord::varchar, 1, 10) ELSE (CASE WHEN s = '' THEN 'Unknown' ELSE s END) || y END || '-sl' || substr(sha1(ord::varchar), 1, 2) AS key FROM a"""
)
def minted_keys(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "entries").select("ord", ids.mint_key(F.get("authors", F.lit(0)), F.col("year"), F.col("ord").cast("string")).alias("key"))


@query(
    r"""WITH s AS (SELECT ord, authors, year, key, coalesce(nullif(list_filter(string_split_regex(authors[1], '[\s\p{Z}]+'), lambda x: x <> '')[-1], ''), 'Unknown') AS who, trim(regexp_replace(regexp_replace(translate(nfc_normalize(coalesce(nullif(title, ''), 'untitled')), '/\', '--'), '[\x00-\x1f]', '', 'g'), '[\s\p{Z}]+', ' ', 'g')) AS t FROM entries)
    SELECT ord, CASE WHEN coalesce(key, '') <> '' THEN trim(regexp_replace(translate(nfc_normalize(key), '/\', '--'), '[\s\p{Z}]+', ' ', 'g')) || ' - ' ELSE '' END || who || CASE WHEN len(authors) > 1 THEN ' et al.' ELSE '' END || CASE WHEN coalesce(year, '') <> '' THEN ' ' || year ELSE '' END || ' - ' || trim(substr(t, 1, 150)) || '.pdf' AS name FROM s"""
)
def file_names(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "entries").select("ord", files.file_name(F.coalesce("authors", F.array().cast("array<string>")), F.col("year"), F.col("title"), F.col("key")).alias("name"))


@query(r"SELECT ord, regexp_replace(replace(replace(replace(replace(coalesce(title, ''), '\', '\\'), '{', '\{'), '}', '\}'), chr(10), ' '), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS bib FROM entries")
def escaped_bibtex(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "entries").select("ord", text.escape_bibtex(F.col("title")).alias("bib"))


@query(r"SELECT ord, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(title, '\\[a-zA-Z]+\{([^}]*)\}', '\1', 'g'), '\\[a-zA-Z]+', '', 'g'), '\{([^}]*)\}', '\1', 'g'), '[\s\p{Z}]+', ' ', 'g')) AS plain FROM entries")
def latex_stripped(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "entries").select("ord", text.strip_latex(F.col("title")).alias("plain"))


@query("SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS first_value, len(json_keys(props)) AS n_keys FROM events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    keys = F.json_object_keys("props")
    return read_table(spark, d, "events").select("event_id", F.try_element_at(F.from_json("props", "map<string,string>"), F.get(keys, F.lit(0))).alias("first_value"), F.size(keys).cast("bigint").alias("n_keys"))


# --- payloads and indexes -------------------------------------------------------------------------------------------


@query(
    r"""WITH ix AS (SELECT work_id, unnest(map_keys(abstract_inverted_index)) AS w, unnest(map_values(abstract_inverted_index)) AS ps FROM works), ip AS (SELECT work_id, w, unnest(ps) AS p FROM ix), ab AS (SELECT work_id, string_agg(w, ' ' ORDER BY p, w) AS abstract FROM ip GROUP BY 1),
    nm AS (SELECT work_id, array_to_string(list_transform(list_filter(list_transform(authorships[1:20], lambda a: a.author.display_name), lambda x: coalesce(x, '') <> ''), lambda x: CASE WHEN len(string_split(x, ',')) = 2 AND trim(string_split(x, ',')[1]) <> '' AND trim(string_split(x, ',')[2]) <> '' THEN trim(string_split(x, ',')[2]) || ' ' || trim(string_split(x, ',')[1]) WHEN len(string_split(x, ',')) = 2 THEN trim(x) ELSE x END), '|') AS authors FROM works)
    SELECT w.work_id, CASE WHEN coalesce(w.doi, '') <> '' THEN replace(w.doi, 'https://doi.org/', '') END AS doi, nullif(ab.abstract, '') AS abstract, coalesce(nm.authors, '') AS authors, nullif(w.publication_date, '') AS publication_date, w.cited_by_count AS citation_count,
    nullif(w.primary_location.source.display_name, '') AS venue, w.open_access.is_oa AS is_open_access, coalesce(nullif(w.open_access.oa_url, ''), nullif(w.primary_location.pdf_url, '')) AS pdf_url, nullif(w.primary_location.landing_page_url, '') AS url,
    coalesce(array_to_string(list_transform(list_filter(w.concepts[1:5], lambda c: coalesce(c.display_name, '') <> '' AND coalesce(c.score, 0) > 0.3), lambda c: c.display_name), '|'), '') AS subjects
    FROM works w LEFT JOIN ab USING (work_id) LEFT JOIN nm USING (work_id)"""
)
def provider_metadata(spark: SparkSession, d: str) -> DataFrame:
    md = payloads.from_openalex(read_table(spark, d, "works"), "work_id")
    join = lambda c: F.array_join(c, "|").alias(c)
    return md.select("work_id", "doi", "abstract", join("authors"), "publication_date", "citation_count", "venue", "is_open_access", "pdf_url", "url", join("subjects"))


@query(r"SELECT doc_id, array_to_string(list_filter(string_split_regex(text, '[\s\p{Z}]+'), lambda x: x <> ''), ' ') AS text FROM documents WHERE len(list_filter(string_split_regex(text, '[\s\p{Z}]+'), lambda x: x <> '')) > 0")
def index_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return index.rebuild(index.build(read_table(spark, d, "documents"), "doc_id", "text"), "doc_id")


@query(r"WITH w AS (SELECT doc_id, unnest(list_filter(string_split_regex(text, '[\s\p{Z}]+'), lambda x: x <> '')) AS word FROM documents) SELECT word, count(DISTINCT doc_id) AS docs, count(*) AS places FROM w GROUP BY 1")
def index_postings(spark: SparkSession, d: str) -> DataFrame:
    return index.postings(read_table(spark, d, "documents"), "doc_id", "text")


# --- sets of records ------------------------------------------------------------------------------------------------

_WORDS = r"trim(regexp_replace(regexp_replace(lower(nfc_normalize(coalesce({0}, ''))), '[^\p{{L}}\p{{N}}_\s\p{{Z}}]', ' ', 'g'), '[\s\p{{Z}}]+', ' ', 'g'))"
_LAST = r"list_filter(string_split_regex(authors[1], '[\s\p{Z}]+'), lambda x: x <> '')[-1]"


@query(
    f"""WITH k AS (SELECT ord, nullif(source, '') AS src, nullif(lower(trim(doi)), '') AS d, {_WORDS.format('title')} AS t, {_WORDS.format(_LAST)} AS s, trim(coalesce(year, '')) AS y FROM entries),
    f AS (SELECT ord, src, d, CASE WHEN t <> '' AND s <> '' AND y <> '' THEN t || chr(1) || s || chr(1) || y END AS fp FROM k),
    one AS (SELECT * FROM (SELECT *, first_value(src) OVER (PARTITION BY d ORDER BY ord) AS fs FROM f) WHERE d IS NULL OR fs IS NOT DISTINCT FROM src),
    two AS (SELECT ord, src, d, fp, first_value(src) OVER (PARTITION BY fp ORDER BY ord) AS fs FROM one)
    SELECT ord FROM two WHERE d IS NOT NULL OR fp IS NULL OR fs IS NOT DISTINCT FROM src"""
)
def cross_source_dedup(spark: SparkSession, d: str) -> DataFrame:
    return dedup.cross_source(read_table(spark, d, "entries")).select("ord")


_ADOI = r"nullif(regexp_replace(lower(trim(regexp_replace(trim({0}), '(?i)^(?:https?://)?(?:dx\.)?doi\.org/', ''))), '\.+$', ''), '')"
_ATITLE = r"""trim(regexp_replace(regexp_replace(lower(array_to_string(list_transform(string_split(strip_accents(replace(replace(regexp_replace(translate({0}, '⁰¹²³⁴⁵⁶⁷⁸⁹₀₁₂₃₄₅₆₇₈₉ⅰⅴⅹ', '01234567890123456789ivx'), '[\p{{Zs}}]', ' ', 'g'), 'ﬁ', 'fi'), 'ﬂ', 'fl')), ''),
 lambda x: CASE WHEN unicode(x) BETWEEN 65281 AND 65374 THEN chr(unicode(x) - 65248) WHEN unicode(x) < 128 THEN x ELSE '' END), '')), '[^a-z0-9\s]', ' ', 'g'), '[\s\p{{Z}}]+', ' ', 'g'))"""


@query(
    f"""WITH e AS (SELECT {_ADOI.format('doi')} AS d, CASE WHEN length({_ATITLE.format('title')}) >= 8 THEN {_ATITLE.format('title')} END AS t FROM entries),
    r AS (SELECT ord, {_ADOI.format('doi')} AS d, CASE WHEN length({_ATITLE.format('title')}) >= 8 THEN {_ATITLE.format('title')} END AS t FROM resolved_papers)
    SELECT ord, coalesce(d IN (SELECT d FROM e WHERE d IS NOT NULL), false) OR coalesce(t IN (SELECT t FROM e WHERE t IS NOT NULL), false) AS is_known FROM r"""
)
def known_papers(spark: SparkSession, d: str) -> DataFrame:
    dois, titles = archive.index(read_table(spark, d, "entries"))
    return archive.known(read_table(spark, d, "resolved_papers"), dois, titles).select("ord", "is_known")


@query(
    r"""WITH q AS (SELECT ord AS qid, array_to_string(authors, ' and ') AS qa, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(title, ''), '\\[a-zA-Z]+\{([^}]*)\}', '\1', 'g'), '[{}]', '', 'g'), '[^\p{L}\p{N}_\s\p{Z}\-:'']', ' ', 'g'), '[\s\p{Z}]+', ' ', 'g')) AS t FROM entries),
    c AS (SELECT work_id AS cid, list_transform(authorships, lambda a: a.author.display_name) AS ca, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(title, ''), '\\[a-zA-Z]+\{([^}]*)\}', '\1', 'g'), '[{}]', '', 'g'), '[^\p{L}\p{N}_\s\p{Z}\-:'']', ' ', 'g'), '[\s\p{Z}]+', ' ', 'g')) AS u FROM works),
    qw AS (SELECT *, list_distinct(list_filter(string_split_regex(lower(t), '[\s\p{Z}]+'), lambda x: x NOT IN ('', 'the', 'a', 'an', 'and', 'or', 'but', 'in', 'on', 'at', 'to', 'for', 'of', 'with', 'by'))) AS w FROM q),
    cw AS (SELECT *, list_distinct(list_filter(string_split_regex(lower(u), '[\s\p{Z}]+'), lambda x: x NOT IN ('', 'the', 'a', 'an', 'and', 'or', 'but', 'in', 'on', 'at', 'to', 'for', 'of', 'with', 'by'))) AS v FROM c),
    p AS (SELECT qid, cid, qa, ca, least(len(list_intersect(w, v)) / len(list_distinct(list_concat(w, v))) + CASE WHEN contains(lower(t), lower(u)) OR contains(lower(u), lower(t)) THEN 0.2 ELSE 0 END, 1.0) AS ts FROM qw, cw WHERE len(w) > 0 AND len(v) > 0 AND len(list_intersect(w, v)) > 0),
    near AS (SELECT * FROM p WHERE 0.7 * ts + 0.3 > 0.7),
    au AS (SELECT qid, cid, ts, unnest(string_split(qa, ' and ')) AS a, ca FROM near), ab AS (SELECT qid, cid, ts, trim(a) AS a, unnest(ca) AS b FROM au),
    sw AS (SELECT *, list_distinct(list_filter(string_split_regex(lower(a), '[\s\p{Z}]+'), lambda x: x NOT IN ('', 'the', 'a', 'an', 'and', 'or', 'but', 'in', 'on', 'at', 'to', 'for', 'of', 'with', 'by'))) AS aw, list_distinct(list_filter(string_split_regex(lower(b), '[\s\p{Z}]+'), lambda x: x NOT IN ('', 'the', 'a', 'an', 'and', 'or', 'but', 'in', 'on', 'at', 'to', 'for', 'of', 'with', 'by'))) AS bw FROM ab),
    asim AS (SELECT qid, cid, max(CASE WHEN len(aw) = 0 OR len(bw) = 0 THEN 0 ELSE least(len(list_intersect(aw, bw)) / len(list_distinct(list_concat(aw, bw))) + CASE WHEN contains(lower(a), lower(b)) OR contains(lower(b), lower(a)) THEN 0.2 ELSE 0 END, 1.0) END) AS s FROM sw GROUP BY 1, 2),
    sc AS (SELECT n.qid, n.cid, round(0.7 * n.ts + 0.3 * CASE WHEN coalesce(n.qa, '') = '' THEN 0 ELSE coalesce(asim.s, 0) END, 9) AS score FROM near n LEFT JOIN asim USING (qid, cid))
    SELECT qid, cid, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, cid) AS rn FROM sc WHERE score > 0.7) WHERE rn = 1"""
)
def best_title_match(spark: SparkSession, d: str) -> DataFrame:
    q = read_table(spark, d, "entries").select(F.col("ord").alias("qid"), "title", F.array_join("authors", " and ").alias("authors"))
    c = read_table(spark, d, "works").select(F.col("work_id").alias("cid"), F.col("work_id").alias("pos"), "title", F.transform("authorships", lambda a: a["author"]["display_name"]).alias("authors"), F.lit(None).cast("double").alias("score"))
    return match.best_match(q, c, 0.7).select("qid", "cid", F.round("score", 6).alias("score"))


PROVIDERS = ("crossref", "openalex", "semanticscholar", "arxiv")


@query(
    """WITH r AS (SELECT *, list_position(['crossref', 'openalex', 'semanticscholar', 'arxiv'], regexp_replace(lower(source), '[^a-z]', '', 'g')) AS k FROM enriched), o AS (SELECT key, coalesce(k, 5) AS k, min(enr_id) AS enr_id FROM r GROUP BY 1, 2)
    SELECT key, enr_id, CASE k WHEN 1 THEN 'crossref' WHEN 2 THEN 'openalex' WHEN 3 THEN 'semanticscholar' WHEN 4 THEN 'arxiv' ELSE 'url' END AS provider FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY k) AS rn FROM o) WHERE rn = 1"""
)
def provider_chain(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "enriched").withColumn("p", F.regexp_replace(F.lower("source"), "[^a-z]", ""))
    first = lambda df: df.groupBy("key").agg(F.min("enr_id").alias("enr_id"))
    found = [(p, first(rows.where(F.col("p") == p))) for p in PROVIDERS]
    return match.first_provider([*found, ("url", first(rows.where(~F.coalesce(F.col("p").isin(*PROVIDERS), F.lit(False)))))]).select("key", "enr_id", "provider")


@query(
    r"""SELECT ord, coalesce(contains(lower(journal), 'arxiv'), false) OR coalesce(contains(lower(doi), 'arxiv'), false) OR coalesce(contains(lower(url), 'arxiv'), false)
    OR coalesce(len(list_filter(map_entries(raw_fields), lambda e: lower(e.key) IN ('archiveprefix', 'eprint', 'primaryclass') AND contains(lower(e.value), 'arxiv'))), 0) > 0
    OR coalesce(len(list_filter(map_entries(raw_fields), lambda e: lower(e.key) = 'eprint' AND regexp_matches(e.value, '^(\d{4}\.\d{4,5}|[a-z-]+/\d{7})$'))), 0) > 0 AS preprint FROM entries"""
)
def preprints(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "entries").select("ord", match.is_preprint(F.col("journal"), F.col("doi"), F.col("url"), F.col("raw_fields")).alias("preprint"))


@query(
    """SELECT ord, 'entries' AS origin FROM entries UNION ALL SELECT ord, 'resolved' AS origin FROM resolved_papers"""
)
def union_of_sources(spark: SparkSession, d: str) -> DataFrame:
    one = lambda t, o: read_table(spark, d, t).select("ord", F.lit(o).alias("origin"))
    return one("entries", "entries").unionByName(one("resolved_papers", "resolved"))


@query("WITH w AS (SELECT key, max(enr_id) AS enr_id FROM enriched GROUP BY 1), e AS (SELECT key, min(ord) AS ord FROM entries GROUP BY 1) SELECT e.key, e.ord, w.enr_id FROM e LEFT JOIN w USING (key)")
def entries_with_metadata(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "entries").groupBy("key").agg(F.min("ord").alias("ord"))
    return e.join(read_table(spark, d, "enriched").groupBy("key").agg(F.max("enr_id").alias("enr_id")), "key", "left")


@query("WITH o AS (SELECT key, min(enr_id) AS v FROM enriched WHERE source IS DISTINCT FROM 'crossref' GROUP BY 1), n AS (SELECT key, min(enr_id) AS v FROM enriched WHERE source = 'crossref' GROUP BY 1) SELECT coalesce(n.key, o.key) AS key, CASE WHEN n.key IS NOT NULL THEN n.v ELSE o.v END AS v FROM o FULL JOIN n ON o.key = n.key")
def merged_metadata(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "enriched")
    of = F.col("source").eqNullSafe("crossref")
    part = lambda c: rows.where(c).groupBy("key").agg(F.min("enr_id").alias("v"))
    return cache.merge(part(~of), part(of))


# --- caches ---------------------------------------------------------------------------------------------------------

_CACHE = f"""c AS (SELECT enr_id AS entry_hash, fetched_at AT TIME ZONE 'UTC' AS stored, source = 'url' AS failed, {NOW} AS now FROM enriched)"""


def _cache(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "enriched")
    return rows.select(F.col("enr_id").alias("entry_hash"), F.col("fetched_at").cast("timestamp").alias("cached_at"), F.when(F.col("source") != "url", F.struct("doi")).alias("metadata"), F.coalesce(F.col("source") == "url", F.lit(False)).alias("failed"), F.lit(None).cast("timestamp").alias("last_failure_at"))


@query(
    f"""WITH {_CACHE} SELECT entry_hash, CASE WHEN coalesce(failed, false) AND stored < now - INTERVAL 7 DAY THEN 'failed_retriable' WHEN coalesce(failed, false) THEN 'failed' WHEN coalesce(stored < now - INTERVAL 30 DAY, true) THEN 'expired' ELSE 'valid' END AS state FROM c"""
)
def cache_states(spark: SparkSession, d: str) -> DataFrame:
    return _cache(spark, d).select("entry_hash", cache.state(_now(), F.col("cached_at"), F.col("failed"), F.col("last_failure_at")).alias("state"))


@query(
    f"""WITH {_CACHE} SELECT count(*) AS total, count(*) FILTER (NOT coalesce(stored < now - INTERVAL 30 DAY, true)) AS valid, count(*) FILTER (coalesce(stored < now - INTERVAL 30 DAY, true)) AS expired, count(*) FILTER (NOT coalesce(failed, false)) AS successful,
    count(*) FILTER (coalesce(failed, false)) AS failed, count(*) FILTER (coalesce(failed, false) AND stored < now - INTERVAL 7 DAY) AS failed_retriable FROM c"""
)
def cache_statistics(spark: SparkSession, d: str) -> DataFrame:
    return cache.statistics(_cache(spark, d), _now())


@query(f"WITH {_CACHE} SELECT entry_hash FROM c WHERE (coalesce(failed, false) AND stored < now - INTERVAL 7 DAY) OR (NOT coalesce(failed, false) AND coalesce(stored < now - INTERVAL 30 DAY, true))")
def cache_misses(spark: SparkSession, d: str) -> DataFrame:
    items = _cache(spark, d)
    return cache.uncached(items.select("entry_hash"), items, _now())


@query(
    f"""WITH h AS (SELECT ord, source, substr(sha256(coalesce(title, '') || coalesce(array_to_string(authors, ','), '') || coalesce(year, '') || coalesce(doi, '')), 1, 16) AS entry_hash, discovery_date AS dd FROM entries), k AS (SELECT entry_hash, min(dd) AS seen FROM h WHERE source = 'paperpile' GROUP BY 1)
    SELECT ord, k.entry_hash IS NOT NULL AS known, strftime(coalesce(k.seen AT TIME ZONE 'UTC', {NOW}), '%Y-%m-%d %H:%M:%S') AS discovered FROM h LEFT JOIN k USING (entry_hash)"""
)
def discovery_upsert(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "entries").withColumn("entry_hash", ids.entry_hash(F.col("title"), F.col("authors"), F.col("year"), F.col("doi")))
    known = e.where("source = 'paperpile'").groupBy("entry_hash").agg(F.min("discovery_date").alias("discovery_date"))
    flagged = cache.discover(e, known, _now()).join(known.select("entry_hash", F.lit(True).alias("known")), "entry_hash", "left")
    return flagged.select("ord", F.coalesce("known", F.lit(False)).alias("known"), F.date_format("discovery_date", "yyyy-MM-dd HH:mm:ss").alias("discovered"))


# --- feeds ----------------------------------------------------------------------------------------------------------

_LATEST = "m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY fetched_at DESC NULLS LAST, enr_id DESC) AS rn FROM enriched) WHERE rn = 1), j AS (SELECT e.ord, e.key, e.title, e.authors, e.abstract, e.year, e.month, e.doi, e.url, e.entry_type, e.journal, e.keywords, m.key IS NOT NULL AS has_md, m.abstract AS mabs, m.publication_date AS mdate, m.doi_url, m.arxiv_url, m.url AS murl, m.pdf_url, m.source AS msrc, m.keywords AS mkw, m.venue, m.subjects FROM entries e LEFT JOIN m USING (key))"


def _joined(spark: SparkSession, d: str) -> DataFrame:
    return feed.attach(read_table(spark, d, "entries"), feed.one_per_key(read_table(spark, d, "enriched")))


@query(
    f"""WITH {_LATEST} SELECT ord, CASE WHEN contains(coalesce(mdate, ''), '-') AND len(string_split(mdate, '-')) >= 3 THEN mdate || 'T00:00:00Z' WHEN contains(coalesce(mdate, ''), '-') THEN mdate || '-15T00:00:00Z'
    WHEN coalesce(year, '') <> '' AND coalesce(month, '') <> '' THEN year || '-' || month || '-15T00:00:00Z' WHEN length(coalesce(mdate, '')) = 4 THEN mdate || '-01-01T00:00:00Z' WHEN coalesce(year, '') <> '' THEN year || '-01-01T00:00:00Z' END AS iso,
    NOT (contains(coalesce(mdate, ''), '-') AND len(string_split(mdate, '-')) >= 3) AND (contains(coalesce(mdate, ''), '-') OR coalesce(year, '') <> '' OR length(coalesce(mdate, '')) = 4) AS estimated FROM j"""
)
def date_resolution(spark: SparkSession, d: str) -> DataFrame:
    r = scoring.resolve_date(F.col("md.publication_date"), F.col("year"), F.col("month"))
    return _joined(spark, d).select("ord", r["iso"].alias("iso"), r["estimated"].alias("estimated"))


_QUALITY = f"""q AS (SELECT *, {_VALID.format('title')} AS q1, coalesce(len(authors), 0) > 0 AS q2, coalesce(abstract, '') <> '' OR coalesce(mabs, '') <> '' AS q3, coalesce(year, '') <> '' OR coalesce(mdate, '') <> '' AS q4,
    coalesce(doi, '') <> '' OR coalesce(url, '') <> '' OR coalesce(doi_url, '') <> '' OR coalesce(arxiv_url, '') <> '' AS q5, coalesce(msrc <> 'url', false) AS q6 FROM j)"""


@query(
    f"""WITH {_LATEST}, {_QUALITY} SELECT ord, (q1::int * 25 + q2::int * 20 + q3::int * 20 + q4::int * 15 + q5::int * 10 + q6::int * 10)::int AS score,
    array_to_string(list_filter([CASE WHEN NOT q1 THEN 'missing_title' END, CASE WHEN NOT q2 THEN 'missing_authors' END, CASE WHEN NOT q3 THEN 'missing_abstract' END, CASE WHEN NOT q4 THEN 'missing_date' END, CASE WHEN NOT q5 THEN 'missing_link' END, CASE WHEN NOT q6 THEN 'not_enriched' END], lambda x: x IS NOT NULL), '|') AS issues FROM q"""
)
def quality_scores(spark: SparkSession, d: str) -> DataFrame:
    items = feed.items(_joined(spark, d))
    return items.select("ord", F.col("_academic.quality_score").alias("score"), F.coalesce(F.array_join("_academic.quality_issues", "|"), F.lit("")).alias("issues"))


@query(
    f"""WITH {_LATEST}, t AS (SELECT *, nullif({_STRIP.format("coalesce(nullif(mabs, ''), nullif(abstract, ''))")}, '') AS a, array_to_string(authors, ', ') AS names FROM j)
    SELECT ord, CASE WHEN coalesce(key, '') <> '' THEN 'bibtex:' || key WHEN coalesce(doi, '') <> '' THEN 'doi:' || doi ELSE 'bibtex:unknown' END AS id,
    coalesce(CASE WHEN length(a) > 500 THEN substr(a, 1, 500) || '...' ELSE a END, nullif(array_to_string(list_filter([CASE WHEN coalesce(journal, '') <> '' THEN 'Published in ' || journal END, CASE WHEN coalesce(year, '') <> '' THEN 'Year: ' || year END,
    CASE WHEN coalesce(len(authors), 0) > 0 THEN 'Authors: ' || CASE WHEN length(names) > 100 THEN substr(names, 1, 100) || '...' ELSE names END END], lambda x: x IS NOT NULL), ' | '), '')) AS content_text,
    array_to_string(list_sort(list_distinct(list_filter(list_concat(coalesce(mkw, []), coalesce(keywords, []), [upper(entry_type[1]) || lower(entry_type[2:])], CASE WHEN coalesce(venue, '') <> '' THEN [venue] WHEN coalesce(journal, '') <> '' THEN [journal] ELSE [] END, coalesce(subjects, [])), lambda x: x IS NOT NULL))), '|') AS tags,
    coalesce({_CLEAN.format("nullif(doi_url, '')")}, '') AS md_link FROM t"""
)
def feed_items(spark: SparkSession, d: str) -> DataFrame:
    j = _joined(spark, d)
    items = feed.items(j)
    link = j.select("ord", urls.clean_url(F.nullif(F.col("md.doi_url"), F.lit(""))).alias("md_link"))
    return items.select("ord", "id", "content_text", F.array_join("tags", "|").alias("tags")).join(link, "ord")


@query()
def feed_json(spark: SparkSession, d: str) -> DataFrame:
    return feed.json_feed(feed.items(_joined(spark, d)), "Bibliography", "https://feeds.example.org/")


@query()
def feed_rss(spark: SparkSession, d: str) -> DataFrame:
    return feed.rss_feed(feed.items(_joined(spark, d)), "Bibliography", "https://feeds.example.org/", now=_now())


_ESC = r"""regexp_replace(replace(replace(replace(replace(coalesce({0}, ''), '\', '\\'), '{{', '\{{'), '}}', '\}}'), chr(10), ' '), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"""
_BARE = r"""trim(regexp_replace(regexp_replace(regexp_replace({0}, '^"[\s\p{{Z}}]*(.*?)[\s\p{{Z}}]*"$', '\1'), '^"[\s\p{{Z}}]*(.*?)[\s\p{{Z}}]*"$', '\1'), '[\s\p{{Z}}]+', ' ', 'g'))"""
_PLAIN = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '\\[a-zA-Z]+\{{([^}}]*)\}}', '\1', 'g'), '\\[a-zA-Z]+', '', 'g'), '\{{([^}}]*)\}}', '\1', 'g'), '[\s\p{{Z}}]+', ' ', 'g'))"""


@query(
    rf"""WITH b AS (SELECT coalesce(key, 'none') AS key, {', '.join(f"{_BARE.format(_ESC.format(c))} AS {n}" for c, n in (('title', 't'), ("array_to_string(authors, ' and ')", 'a'), ('year', 'y'), ('doi', 'd')))} FROM entries WHERE regexp_matches(coalesce(key, 'none'), '^[^\s,]+$'))
    SELECT key, nullif({_PLAIN.format('t')}, '') AS title, array_to_string(list_filter(list_transform(string_split_regex(a, '(?i)[\s\p{{Z}}]+and[\s\p{{Z}}]+'), lambda x: {_PLAIN.format('x')}), lambda x: x <> ''), ' and ') AS authors,
    CASE WHEN y <> '' THEN coalesce(nullif(regexp_extract(y, '\b((?:19|20)\d{{2}})\b', 1), ''), y) END AS year, nullif(trim(regexp_replace(d, '(?i)^(?:doi:)?(?:https?://)?(?:(?:dx\.)?doi\.org/)?', '')), '') AS doi FROM b"""
)
def bibtex_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "entries")
    none = F.array().cast("array<string>")
    bib = e.select(F.concat_ws("/", F.lit("entry"), "ord").alias("path"), bibtex.render(F.coalesce("key", F.lit("none")), F.col("title"), F.coalesce("authors", none), F.col("year"), F.col("doi"), F.col("url"), F.col("abstract"), F.lit("note")).alias("value"))
    return bibtex.to_entries(bibtex.parse(bib)).select("key", "title", F.array_join("authors", " and ").alias("authors"), "year", "doi")


@query()
def landing_pages(spark: SparkSession, d: str) -> DataFrame:
    w = read_table(spark, d, "works")
    html = F.concat(F.lit('<html><head><meta content="'), text.escape_html(F.col("title")), F.lit('" name="citation_title"><meta name="citation_doi" content="doi:'), F.coalesce("doi", F.lit("")), F.lit('"><title>View of '), text.escape_html(F.col("title")), F.lit(" | Site</title></head></html>"))
    p = w.select("work_id", html.alias("html")).withColumn("tags", pages.meta_tags(F.col("html")))
    m = pages.page_meta(F.col("html"), F.col("tags"))
    return p.select("work_id", m["title"].alias("title"), pages.page_doi(F.col("tags")).alias("doi"))


# --- messages -------------------------------------------------------------------------------------------------------


_INPUTS = r"""u AS (SELECT doc_id, text, CASE WHEN doc_id % 13 = 0 THEN 'channel_join' WHEN doc_id % 13 = 1 THEN 'file_share' WHEN doc_id % 13 = 2 THEN 'bot_message' END AS subtype, CASE WHEN doc_id % 11 = 0 THEN 'B1' WHEN doc_id % 11 = 1 THEN '' END AS bot,
    CASE WHEN doc_id % 5 = 0 THEN 'application/pdf' WHEN doc_id % 7 = 0 THEN 'image/png' END AS mime, CASE WHEN doc_id % 3 = 0 THEN '#zettel ' || coalesce(text, '') WHEN doc_id % 3 = 1 THEN coalesce(text, '') || ' https://arxiv.org/abs/2001.0' || (1000 + doc_id % 9000)::varchar || 'v2.' ELSE text END AS said FROM documents),
 v AS (SELECT *, list_concat(regexp_extract_all(coalesce(said, ''), '<(https?://[^|>\s]+)(?:\|[^>]*)?>', 1), list_transform(regexp_extract_all(regexp_replace(coalesce(said, ''), '<https?://[^>]*>', ' ', 'g'), '(https?://[^\s<>|]+)', 1), lambda x: regexp_replace(x, '[.,;)]+$', ''))) AS us FROM u),
 w AS (SELECT *, len(list_distinct(us)) AS n_urls, us[1] AS first_url, nullif(regexp_replace(regexp_extract(coalesce(said, ''), '\b(10\.\d{4,9}/[-._;()/:A-Za-z0-9]+)', 1), '[.,;)]+$', ''), '') AS own,
  nullif(list_filter(list_transform(us, lambda x: regexp_extract(x, '(?i)https?://(?:www\.)?arxiv\.org/(?:abs|pdf)/(\d{4}\.\d{4,5})(?:v\d+)?', 1)), lambda x: x <> '')[1], '') AS preprint FROM v)"""
_EVENT = "WHEN subtype IN ('channel_join', 'bot_message') THEN 'event' WHEN coalesce(bot, '') <> '' THEN 'bot'"


def _messages(spark: SparkSession, d: str) -> DataFrame:
    """The documents as messages with every kind of input a router meets."""
    i, body = F.col("doc_id"), F.coalesce("text", F.lit(""))
    link = F.concat(body, F.lit(" https://arxiv.org/abs/2001.0"), (1000 + i % 9000).cast("string"), F.lit("v2."))
    mime = F.when(i % 5 == 0, "application/pdf").when(i % 7 == 0, "image/png")
    file = F.struct(mime.alias("mimetype"), F.lit(None).cast("string").alias("filetype"), F.lit("u").alias("url_private_download"))
    return read_table(spark, d, "documents").select(
        "doc_id", F.when(i % 3 == 0, F.concat(F.lit("#zettel "), body)).when(i % 3 == 1, link).otherwise(F.col("text")).alias("text"),
        F.when(i % 13 == 0, "channel_join").when(i % 13 == 1, "file_share").when(i % 13 == 2, "bot_message").alias("subtype"), F.when(i % 11 == 0, "B1").when(i % 11 == 1, "").alias("bot_id"), F.when(mime.isNotNull(), F.array(file)).alias("files"),
    )


def _routed(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.size("urls").cast("bigint").alias("n_urls"), F.get("urls", F.lit(0)).alias("first_url"), "doi", "preprint", F.col("pdf").isNotNull().alias("has_pdf"), "skip")


@query(f"WITH {_INPUTS} SELECT doc_id, n_urls, first_url, own AS doi, preprint, coalesce(mime = 'application/pdf', false) AS has_pdf, CASE {_EVENT} WHEN NOT coalesce(regexp_matches(said, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])#zettel\\b'), false) THEN 'not_asked' END AS skip FROM w")
def message_router(spark: SparkSession, d: str) -> DataFrame:
    return _routed(archive.route(_messages(spark, d), "zettel"))


@query(f"WITH {_INPUTS} SELECT doc_id, n_urls, first_url, own AS doi, preprint, coalesce(mime = 'application/pdf', false) AS has_pdf, CASE {_EVENT} WHEN n_urls = 0 AND coalesce(mime <> 'application/pdf', true) THEN 'not_asked' END AS skip FROM w")
def message_router_untagged(spark: SparkSession, d: str) -> DataFrame:
    return _routed(archive.route(_messages(spark, d), None))


@query(
    f"""WITH x AS (SELECT doc_id, added_at AT TIME ZONE 'UTC' AS seen FROM documents) SELECT doc_id, coalesce(floor(epoch({NOW} - seen) / 86400) >= 30, false) AS is_expired FROM x"""
)
def pending_expiry(spark: SparkSession, d: str) -> DataFrame:
    p = read_table(spark, d, "documents").select("doc_id", F.col("added_at").cast("timestamp").alias("first_seen"))
    return archive.expire(p, _now()).select("doc_id", "is_expired")


@query("WITH o AS (SELECT CASE doc_kind WHEN 'message' THEN 'added' WHEN 'note' THEN 'skipped' WHEN 'review' THEN 'duplicate' ELSE 'errors' END AS outcome FROM documents), z AS (SELECT unnest(['added', 'asked_for_pdf', 'skipped', 'duplicate', 'errors', 'expired']) AS outcome) SELECT z.outcome, count(o.outcome) AS n FROM z LEFT JOIN o ON z.outcome = o.outcome GROUP BY 1")
def outcome_counts(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("doc_kind")
    rows = read_table(spark, d, "documents").select(F.when(kind == "message", "added").when(kind == "note", "skipped").when(kind == "review", "duplicate").otherwise("errors").alias("outcome"))
    return archive.outcomes(rows)


# --- freshness ------------------------------------------------------------------------------------------------------

_RUNS = "r AS (SELECT user_id::varchar AS repo, event_type AS workflow, CASE WHEN event_id % 4 = 0 THEN ts + INTERVAL 1 HOUR ELSE ts END AS began, event_id, ts + INTERVAL 1 HOUR * (event_id % 6) AS upd, CASE WHEN event_id % 3 = 0 THEN 'push' ELSE 'schedule' END AS event, CASE WHEN event_id % 11 = 0 THEN 'in_progress' ELSE 'completed' END AS status, CASE WHEN event_id % 5 = 0 THEN 'failure' WHEN event_id % 7 = 0 THEN 'cancelled' ELSE 'success' END AS conclusion FROM events)"


def _runs(spark: SparkSession, d: str) -> DataFrame:
    i, ts = F.col("event_id"), F.col("ts").cast("timestamp")
    return read_table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("repo"), F.col("event_type").alias("workflow"), F.when(i % 4 == 0, ts + F.expr("INTERVAL 1 HOUR")).alias("run_started_at"), ts.alias("created_at"), i.alias("event_id"), (ts + F.make_dt_interval(hours=(i % 6).cast("int"))).alias("updated_at"),
        F.when(i % 3 == 0, "push").otherwise("schedule").alias("event"), F.when(i % 11 == 0, "in_progress").otherwise("completed").alias("status"), F.when(i % 5 == 0, "failure").when(i % 7 == 0, "cancelled").otherwise("success").alias("conclusion"),
    )


@query(f"WITH {_RUNS} SELECT repo, workflow, date_sub('second', max(began) FILTER (event = 'schedule' AND conclusion = 'success'), {NOW}) AS age_seconds FROM r GROUP BY 1, 2")
def newest_success_age(spark: SparkSession, d: str) -> DataFrame:
    r = _runs(spark, d)
    ages = freshness.newest_age(r, ["repo", "workflow"], freshness.run_start(r), freshness.scheduled_success(r), _now())
    return ages.select("repo", "workflow", F.round(F.col("age") * 86400).cast("bigint").alias("age_seconds"))


@query(
    f"""WITH {_RUNS}, own AS (SELECT * FROM r WHERE event IN ('schedule', 'repository_dispatch')), n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, workflow ORDER BY began DESC, event_id DESC) AS rn FROM own) WHERE rn = 1), c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, workflow ORDER BY began DESC, event_id DESC) AS rn FROM own WHERE status = 'completed') WHERE rn = 1)
    SELECT repo, workflow, 'hung' AS finding FROM n WHERE status <> 'completed' AND date_sub('second', began, {NOW}) / 3600.0 > 3 UNION ALL SELECT repo, workflow, 'failed' FROM c WHERE conclusion IN ('failure', 'timed_out', 'startup_failure') OR (conclusion = 'cancelled' AND date_sub('second', began, upd) / 3600.0 > 3)"""
)
def run_findings(spark: SparkSession, d: str) -> DataFrame:
    return freshness.run_findings(_runs(spark, d), _now())


@query("WITH f AS (SELECT DISTINCT user_id AS key, date_diff('day', DATE '2024-01-01', ts::date) AS run FROM events) SELECT f.key, f.run, p.key IS NOT NULL AS again FROM f LEFT JOIN f p ON p.key = f.key AND p.run = f.run - 1")
def recurring_findings(spark: SparkSession, d: str) -> DataFrame:
    f = read_table(spark, d, "events").select(F.col("user_id").alias("key"), F.date_diff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("bigint").alias("run")).distinct()
    return freshness.recurring(f, "run").select("key", "run", "again")


@query("WITH f AS (SELECT DISTINCT user_id::varchar AS key FROM events WHERE value > 50), p AS (SELECT DISTINCT user_id::varchar AS key FROM events WHERE value <= 50) SELECT key, key IN (SELECT key FROM p) AS post FROM f")
def held_findings(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events")
    part = lambda c: e.where(c).select(F.col("user_id").cast("string").alias("key")).distinct()
    return freshness.hold(part("value > 50"), part("value <= 50"))
