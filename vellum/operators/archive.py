"""The archive of known papers, and messages that suggest papers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.files import first_pdf
from vellum.functions.ids import doi_archive, doi_in_message, mint_key, preprint_id
from vellum.functions.text import archive_title, join_key, present
from vellum.functions.urls import urls_in_text
from vellum.sources.bibtex import render

#: Subtypes of messages that report an event of the channel. Fixed values.
CHANNEL_EVENTS = (
    "channel_join", "channel_leave", "channel_topic", "channel_purpose", "channel_name", "channel_archive", "channel_unarchive", "channel_convert_to_private", "channel_convert_to_public",
    "group_join", "group_leave", "group_topic", "group_purpose", "group_name", "group_archive", "group_unarchive", "pinned_item", "unpinned_item", "tombstone",
    "bot_message", "bot_add", "bot_remove", "bot_disable", "bot_enable",
)


def index(*tables: DataFrame, fold: bool = True) -> tuple[DataFrame, DataFrame]:
    """Known DOIs and known titles, each once, of tables with doi and title."""
    rows = None
    for t in tables:
        part = t.select("doi", "title")
        rows = part if rows is None else rows.unionByName(part)
    dois = rows.select(doi_archive(F.col("doi")).alias("known_doi")).where("known_doi IS NOT NULL").distinct()
    titles = rows.select(archive_title(F.col("title"), fold).alias("known_title")).where("known_title IS NOT NULL").distinct()
    return dois, titles


def known(papers: DataFrame, dois: DataFrame, titles: DataFrame, fold: bool = True) -> DataFrame:
    """Papers with ``is_known``: the archive has the DOI or the title. Two equality joins, no join on an alternative."""
    p = papers.withColumns({"_d": join_key(doi_archive(F.col("doi"))), "_t": join_key(archive_title(F.col("title"), fold))})
    d = dois.select(F.col("known_doi").alias("_d"), F.lit(True).alias("_hd"))
    t = titles.select(F.col("known_title").alias("_t"), F.lit(True).alias("_ht"))
    out = p.join(d, "_d", "left").join(t, "_t", "left")
    return out.withColumn("is_known", F.coalesce("_hd", F.lit(False)) | F.coalesce("_ht", F.lit(False))).drop("_d", "_t", "_hd", "_ht")


def index_of_feed(feed: DataFrame, inbox: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Known DOIs and titles of a feed document (column ``value``, its lines as ``feed.json_feed`` writes them, one item a
    line, or the whole document as one) and of bibliography text (column ``value``)."""
    line = F.regexp_replace(F.trim("value"), r"^,|,$", "")
    item = F.from_json(line, "title STRING, _academic STRUCT<doi: STRING>, items ARRAY<STRUCT<title: STRING, _academic: STRUCT<doi: STRING>>>, id STRING")
    each = feed.select(item.alias("i")).select(F.explode(F.concat(F.coalesce("i.items", F.array().cast("array<struct<title:string,_academic:struct<doi:string>>>")), F.when(F.col("i.id").isNotNull(), F.array(F.struct(F.col("i.title").alias("title"), F.col("i._academic").alias("_academic")))).otherwise(F.array().cast("array<struct<title:string,_academic:struct<doi:string>>>")))).alias("i"))
    fed = each.select(F.col("i._academic.doi").alias("doi"), F.col("i.title").alias("title"))
    typed = lambda f: inbox.select(F.explode(F.regexp_extract_all("value", F.lit(rf"(?i)\b{f}\s*=\s*\{{([^}}]*)\}}"), F.lit(1))).alias(f))
    none = F.lit(None).cast("string")
    return index(fed, typed("doi").withColumn("title", none), typed("title").withColumn("doi", none))


def has_tag(text: Column, tag: str) -> Column:
    """Whether a text has the hashtag as a word, in any case."""
    needle = "".join("\\" + c if not c.isalnum() and c != "_" else c for c in tag.lstrip("#").lower())
    return F.coalesce(text.rlike(rf"(?i)(?:^|[^\p{{L}}\p{{N}}_])#{needle}\b"), F.lit(False))


def route(messages: DataFrame, tag: str | None) -> DataFrame:
    """Messages with urls, doi, preprint, pdf and ``skip``: why a message is no suggestion, NULL if it is one."""
    urls = urls_in_text(F.col("text"))
    m = messages.withColumn("urls", urls)
    m = m.withColumns({"doi": doi_in_message(F.col("text"), F.col("urls")), "preprint": preprint_id(F.col("urls")), "pdf": first_pdf(F.col("files"))})
    asked = has_tag(F.col("text"), tag) if tag else (F.size("urls") > 0) | F.col("pdf").isNotNull()
    skip = F.when(F.coalesce(F.col("subtype").isin(*CHANNEL_EVENTS), F.lit(False)), "event").when(present(F.col("bot_id")), "bot").when(~asked, "not_asked")
    return m.withColumn("skip", skip)


def unseen(messages: DataFrame, seen: DataFrame, last_ts: str) -> DataFrame:
    """Messages after the cursor that no ledger has, sorted by time (``ts_number``)."""
    m = messages.withColumn("ts_number", F.col("ts").cast("decimal(20,6)")).where(F.col("ts_number") > F.lit(last_ts).cast("decimal(20,6)"))
    return m.join(seen.select("ts"), "ts", "left_anti").orderBy("ts_number")


def pdf_source(attached: Column, preprint: Column, open_access: Column) -> Column:
    """Where the PDF comes from: the attachment, the preprint server, the open-access copy; NULL if nowhere."""
    return F.when(attached, "attachment").when(preprint, "arxiv").when(open_access, "open_access")


def outcomes(routed: DataFrame, label: str = "outcome", every: tuple[str, ...] = ("added", "asked_for_pdf", "skipped", "duplicate", "errors", "expired")) -> DataFrame:
    """Counts by outcome, with zero for those that didn't occur."""
    spark = routed.sparkSession
    zero = spark.createDataFrame([(e,) for e in every], f"{label} string")
    return zero.join(routed.groupBy(label).agg(F.count("*").alias("n")), label, "left").select(label, F.coalesce("n", F.lit(0)).alias("n"))


def expire(pending: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Pending rows with ``is_expired`` by whole days since they were first seen; a missing time is stamped; 0 turns it off."""
    age = F.floor(F.timestamp_diff("SECOND", F.col("first_seen"), now) / 86400)
    old = F.coalesce(age >= days, F.lit(False)) if days else F.lit(False)
    return pending.withColumn("is_expired", old).withColumn("first_seen", F.coalesce("first_seen", now))


def completed(pending: DataFrame, replies: DataFrame) -> DataFrame:
    """Pending rows that a reply in their thread completed, with the first reply that has a PDF."""
    with_pdf = replies.withColumn("pdf", first_pdf(F.col("files"))).where("pdf IS NOT NULL")
    first = with_pdf.groupBy("thread_ts").agg(F.min_by(F.struct("ts", "pdf"), F.col("ts").cast("decimal(20,6)")).alias("r"))
    return pending.join(first, F.col("thread_ts") == F.col("ts")).select(*[pending[c] for c in pending.columns], F.col("r.ts").alias("reply_ts"), F.col("r.pdf").alias("pdf"))


def contains(rows: DataFrame, inbox: DataFrame) -> DataFrame:
    """Rows (key, doi) with ``is_there``: the inbox (key, doi) has the key, or the DOI in any case. Two equality joins."""
    low = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    keys = inbox.select("key", F.lit(True).alias("_k")).distinct()
    dois = inbox.select(low("doi").alias("_d"), F.lit(True).alias("_o")).where("_d IS NOT NULL").distinct()
    out = rows.withColumns({"_d": join_key(low("doi")), "_q": join_key(F.col("key"))}).join(keys.withColumnRenamed("key", "_q"), "_q", "left").join(dois, "_d", "left")
    return out.select(*rows.columns, F.coalesce("_k", "_o", F.lit(False)).alias("is_there"))


def resolve(suggestions: DataFrame, preprints: DataFrame, crossref: DataFrame, datacite: DataFrame, pages: DataFrame) -> DataFrame:
    """Suggestions with ``paper``, from the first that knows them: preprint server, Crossref, DataCite, landing page, or just their links.

    suggestions: ts, urls, doi, preprint (see ``route``); preprints by arxiv_id, crossref and datacite by doi, with title, authors,
    year, url, abstract; pages: url, title, authors, year, doi. A page's DOI counts where the message has none.
    """
    fields = ("doi", "title", "authors", "year", "url", "abstract", "arxiv_id", "source")

    def paper(source: str, **cols: Column) -> Column:
        kinds = {"authors": "array<string>"}
        return F.struct(*[cols.get(f, F.lit(None)).cast(kinds.get(f, "string")).alias(f) for f in fields[:-1]], F.lit(source).alias("source"))

    each = suggestions.select("ts", F.posexplode("urls").alias("_p", "url")).where(~F.lower("url").contains("arxiv.org"))
    seen = each.join(pages, "url").groupBy("ts").agg(F.min_by(F.struct("title", "authors", "year"), F.when(F.col("title").isNotNull(), F.col("_p"))).alias("page"), F.min_by("doi", F.when(F.col("doi").isNotNull(), F.col("_p"))).alias("page_doi"))
    s = suggestions.join(seen, "ts", "left").withColumn("_doi", F.coalesce("doi", "page_doi")).withColumn("_key", doi_archive(F.col("_doi")))

    def source(df: DataFrame, key: str, name: str, k: Column) -> DataFrame:
        return df.select(k.alias(key), F.struct(*[F.col(c) for c in df.columns]).alias(name)).groupBy(key).agg(F.any_value(name).alias(name))

    s = s.join(source(preprints, "preprint", "_a", F.col("arxiv_id")), "preprint", "left")
    s = s.join(source(crossref, "_key", "_c", doi_archive(F.col("doi"))), "_key", "left").join(source(datacite, "_key", "_d", doi_archive(F.col("doi"))), "_key", "left")
    link = F.get("urls", F.lit(0))
    known = lambda n, src, **more: F.when(F.col(n).isNotNull(), paper(src, **{f: F.col(f"{n}.{f}") for f in ("title", "authors", "year", "url", "abstract")}, **more))
    page = F.when(F.col("page.title").isNotNull(), paper("landing_page", doi=F.col("_doi"), title=F.col("page.title"), authors=F.col("page.authors"), year=F.col("page.year"), url=link, arxiv_id=F.col("preprint")))
    best = F.coalesce(known("_a", "arxiv", doi=F.col("_doi"), arxiv_id=F.col("preprint")), known("_c", "crossref", doi=F.col("_doi")), known("_d", "datacite", doi=F.col("_doi")), page, paper("minimal", doi=F.col("_doi"), url=link, arxiv_id=F.col("preprint")))
    return s.withColumn("paper", best).select(*suggestions.columns, "paper")


def outbox(routed: DataFrame, channel: str, text: Column) -> DataFrame:
    """Replies to send, one row each; delivery is left to the caller."""
    return routed.select(F.lit(channel).alias("channel_id"), F.col("ts").alias("thread_ts"), text.alias("text")).where("text IS NOT NULL")


def cursor(messages: DataFrame) -> DataFrame:
    """The time stamp up to which messages are done."""
    return messages.agg(F.max_by("ts", F.col("ts").cast("decimal(20,6)")).alias("last_ts"))


def published(resolved: DataFrame, inbox: DataFrame | None) -> DataFrame:
    """Settled suggestions with ``key``, ``bib`` (the record as text) and ``is_there``: whether the inbox (key, doi) has the paper already."""
    p = F.col("paper")
    key = mint_key(F.get(p["authors"], F.lit(0)), p["year"], F.col("ts"))
    note = F.concat(F.lit("Suggested in chat, "), F.col("ts"))
    none = F.array().cast("array<string>")
    bib = render(key, p["title"], F.coalesce(p["authors"], none), p["year"], p["doi"], p["url"], p["abstract"], note)
    rows = resolved.withColumns({"key": key, "doi": p["doi"], "bib": bib})
    return contains(rows, inbox) if inbox is not None else rows.withColumn("is_there", F.lit(False))


def reply() -> Column:
    """What to answer to a settled suggestion (see ``published``)."""
    title = F.coalesce(F.col("paper.title"), F.col("paper.url"), F.lit("this paper"))
    return (
        F.when(F.col("is_there"), F.concat(F.lit("Already there: "), title)).when(F.col("outcome") == "added", F.concat(F.lit("Added: "), title))
        .when(F.col("outcome") == "asked_for_pdf", F.concat(F.lit("Please reply with a PDF of "), title)).when(F.col("outcome") == "expired", F.concat(F.lit("No PDF came for "), title))
    )
