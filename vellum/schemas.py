"""Explicit schemas of the record types; nothing is inferred."""

from __future__ import annotations

ENTRY = (
    "ord BIGINT, entry_type STRING, key STRING, title STRING, authors ARRAY<STRING>, year STRING, month STRING, doi STRING, url STRING, abstract STRING, "
    "keywords ARRAY<STRING>, journal STRING, volume STRING, pages STRING, publisher STRING, discovery_date TIMESTAMP, raw_fields MAP<STRING, STRING>, source STRING"
)
METADATA = (
    "abstract STRING, doi STRING, doi_url STRING, url STRING, arxiv_url STRING, pdf_url STRING, publication_date STRING, citation_count INT, reference_count INT, venue STRING, "
    "authors ARRAY<STRING>, keywords ARRAY<STRING>, subjects ARRAY<STRING>, is_open_access BOOLEAN, source STRING, confidence_score DOUBLE"
)
ENRICHED = f"key STRING, {METADATA}"
METADATA_CACHE = f"entry_hash STRING, entry_key STRING, entry_title STRING, cached_at TIMESTAMP_NTZ, metadata STRUCT<{METADATA.replace(' STRING', ': STRING').replace(' INT', ': INT').replace(' ARRAY', ': ARRAY').replace(' BOOLEAN', ': BOOLEAN').replace(' DOUBLE', ': DOUBLE')}>, failed BOOLEAN, failure_reason STRING, last_failure_at TIMESTAMP_NTZ"
DISCOVERY = "entry_hash STRING, entry_key STRING, entry_title STRING, discovery_date TIMESTAMP"
OPEN_ACCESS_CACHE = "doi STRING, cached_at TIMESTAMP_NTZ, result STRUCT<is_oa: BOOLEAN, best_oa_pdf_url: STRING, license: STRING, host_type: STRING>"
MESSAGE = "ts STRING, text STRING, user STRING, subtype STRING, bot_id STRING, files ARRAY<STRUCT<mimetype: STRING, filetype: STRING, url_private_download: STRING>>, thread_ts STRING"
PENDING = "ts STRING, channel_id STRING, user STRING, text STRING, permalink STRING, first_seen TIMESTAMP, doi STRING, arxiv_id STRING"
RESOLVED = "doi STRING, title STRING, authors ARRAY<STRING>, year STRING, url STRING, abstract STRING, arxiv_id STRING, source STRING"
RUNS = "repo STRING, workflow STRING, run_started_at TIMESTAMP, created_at TIMESTAMP, updated_at TIMESTAMP, event STRING, status STRING, conclusion STRING"
COMMITS = "repo STRING, path STRING, committed_at TIMESTAMP"
TARGETS = "repo STRING, workflow STRING, cron_max_days DOUBLE, path STRING, output_max_days DOUBLE, hint STRING"
PDF_RESPONSE = "url STRING, status INT, content_type STRING, content BINARY"

#: Payloads of providers, as they send them.
CROSSREF = (
    "DOI STRING, title ARRAY<STRING>, abstract STRING, score DOUBLE, subject ARRAY<STRING>, author ARRAY<STRUCT<given: STRING, family: STRING>>, `container-title` ARRAY<STRING>, "
    "`published-print` STRUCT<`date-parts`: ARRAY<ARRAY<INT>>>, `published-online` STRUCT<`date-parts`: ARRAY<ARRAY<INT>>>, `is-referenced-by-count` INT, `references-count` INT, URL STRING"
)
SEMANTIC_SCHOLAR = (
    "title STRING, abstract STRING, url STRING, venue STRING, year INT, publicationDate STRING, citationCount INT, referenceCount INT, isOpenAccess BOOLEAN, "
    "openAccessPdf STRUCT<url: STRING>, externalIds STRUCT<DOI: STRING, ArXiv: STRING>, authors ARRAY<STRUCT<name: STRING>>, fieldsOfStudy ARRAY<STRING>"
)
OPENALEX = (
    "doi STRING, title STRING, display_name STRING, publication_date STRING, cited_by_count INT, referenced_works_count INT, authorships ARRAY<STRUCT<author: STRUCT<display_name: STRING>>>, "
    "primary_location STRUCT<source: STRUCT<display_name: STRING>, landing_page_url: STRING, pdf_url: STRING>, best_oa_location STRUCT<pdf_url: STRING>, open_access STRUCT<is_oa: BOOLEAN, oa_url: STRING>, "
    "concepts ARRAY<STRUCT<display_name: STRING, score: DOUBLE>>, abstract_inverted_index MAP<STRING, ARRAY<INT>>"
)
DATACITE = (
    "titles ARRAY<STRUCT<title: STRING>>, creators ARRAY<STRUCT<name: STRING, givenName: STRING, familyName: STRING>>, publicationYear INT, url STRING, "
    "descriptions ARRAY<STRUCT<description: STRING, descriptionType: STRING>>"
)
ARXIV = "id STRING, title STRING, summary STRING, published STRING, authors ARRAY<STRING>, doi STRING, categories ARRAY<STRING>, pdf_url STRING"
OPEN_ACCESS = "is_oa BOOLEAN, best_oa_location STRUCT<url_for_pdf: STRING, license: STRING, host_type: STRING>"
