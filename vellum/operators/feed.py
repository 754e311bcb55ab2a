"""Feed items from records and their metadata, as JSON Feed and RSS."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.ids import guid
from vellum.functions.names import author_objects, author_string
from vellum.functions.scoring import quality, resolve_date, rss_date
from vellum.functions.text import escape_html, first_present, present, present_array, strip_markup
from vellum.functions.urls import display_title, primary_link, validate_url

#: Keys of the suggestion that may be published. Fixed values.
SUGGESTION = ("channel_id", "ts", "permalink", "pdf_source", "submitted_by", "submitted_by_id")


def attach(entries: DataFrame, enriched: DataFrame) -> DataFrame:
    """Entries with the struct ``md`` of their metadata, NULL if there is none. ``enriched`` has one row per key."""
    cols = [c for c in enriched.columns if c != "key"]
    return entries.join(enriched.select("key", F.struct(*cols).alias("md")), "key", "left")


def one_per_key(enriched: DataFrame) -> DataFrame:
    """The latest metadata of each key, ties to the later ``enr_id``; combined before the shuffle."""
    cols = [c for c in enriched.columns if c not in ("key", "fetched_at", "enr_id")]
    last = enriched.groupBy("key").agg(F.max(F.struct("fetched_at", "enr_id", *cols)).alias("b"))
    return last.select("key", *[F.col(f"b.{c}").alias(c) for c in cols])


def description(md_abstract: Column, abstract: Column, journal: Column, year: Column, authors: Column, limit: int = 500) -> Column:
    """An abstract without markup, cut at the limit, else a line of journal, year and authors."""
    text = F.nullif(strip_markup(first_present(md_abstract, abstract)), F.lit(""))
    cut = F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)
    names = F.array_join(authors, ", ")
    names = F.when(F.length(names) > 100, F.concat(F.substring(names, 1, 100), F.lit("..."))).otherwise(names)
    line = F.concat_ws(" | ", F.when(present(journal), F.concat(F.lit("Published in "), journal)), F.when(present(year), F.concat(F.lit("Year: "), year)), F.when(present_array(authors), F.concat(F.lit("Authors: "), names)))
    return F.coalesce(cut, F.nullif(line, F.lit("")))


def title_case(c: Column) -> Column:
    """An entry type as a tag."""
    return F.initcap(F.coalesce(c, F.lit("")))


def tags(md_keywords: Column, keywords: Column, entry_type: Column, venue: Column, journal: Column, subjects: Column) -> Column:
    """All tags once, in order of the alphabet."""
    none = F.array().cast("array<string>")
    every = F.concat(F.coalesce(md_keywords, none), F.coalesce(keywords, none), F.array(title_case(entry_type)), F.when(present(venue), F.array(venue)).when(present(journal), F.array(journal)).otherwise(none), F.coalesce(subjects, none))
    return F.array_sort(F.array_distinct(F.array_compact(every)))


def _block(head: str, parts: list[Column], item: str, sep: str, wrap: tuple[str, str]) -> Column:
    rows = F.array_compact(F.array(*[F.when(p.isNotNull(), F.concat(F.lit(f"<{item}>" if item else ""), p, F.lit(f"</{item}>" if item else ""))) for p in parts]))
    return F.when(F.size(rows) > 0, F.concat(F.lit(f"<h3>{head}</h3>{wrap[0]}"), F.array_join(rows, sep), F.lit(wrap[1])))


def content_html(df_cols: dict[str, Column], escape: bool = True) -> Column:
    """Abstract, details and links as HTML; ``escape`` false gives the plainer form of RSS."""
    c, esc = df_cols, (escape_html if escape else lambda x: x)
    field = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"<strong>{name}:</strong> "), value))
    some = lambda x: F.nullif(x, F.lit(""))
    names = F.array_join(F.when(present_array(c["md_authors"]), c["md_authors"]).otherwise(c["authors"]) if escape else c["authors"], ", ")
    about = first_present(c["md_abstract"], c["abstract"])
    abstract = F.when(about.isNotNull(), F.concat(F.lit("<h3>Abstract</h3><p>"), esc(strip_markup(about)), F.lit("</p>")))
    venue = first_present(c["venue"], c["journal"]) if escape else some(c["journal"])
    details = [field("Authors", esc(some(names)) if not escape else F.when(some(names).isNotNull(), esc(names))), field("Published in" if escape else "Journal", F.when(venue.isNotNull(), esc(venue))), field("Year", some(c["year"])), field("Volume", some(c["volume"])), field("Pages", some(c["pages"]))]
    if escape:
        details += [field("Citations", c["citations"].cast("string")), field("References", c["references"].cast("string"))]
    link = lambda url, name: F.when(validate_url(url).isNotNull(), F.concat(F.lit('<a href="'), validate_url(url), F.lit(f'">{name}</a>')))
    links = [link(c["doi_url"], "DOI"), link(c["arxiv_url"], "arXiv"), link(c["pdf_url"], "PDF"), link(c["url"], "URL")]
    return F.concat_ws("", abstract, _block("Details", details, "li", "", ("<ul>", "</ul>")), _block("Links", links, "", " | ", ("<p>", "</p>")))


def _cols(md: str = "md") -> dict[str, Column]:
    m = lambda f: F.col(f"{md}.{f}")
    return {"md_authors": m("authors"), "authors": F.col("authors"), "md_abstract": m("abstract"), "abstract": F.col("abstract"), "venue": m("venue"), "journal": F.col("journal"), "year": F.col("year"), "volume": F.col("volume"), "pages": F.col("pages"), "citations": m("citation_count"), "references": m("reference_count"), "doi_url": m("doi_url"), "arxiv_url": m("arxiv_url"), "pdf_url": m("pdf_url"), "url": F.col("url")}


def items(entries: DataFrame) -> DataFrame:
    """Feed items of entries with the struct ``md`` (see ``attach``), one row each, with ``ord`` for order."""
    m = lambda f: F.col(f"md.{f}")
    date = resolve_date(m("publication_date"), F.col("year"), F.col("month"))
    link = primary_link(m("doi_url"), F.col("doi"), m("arxiv_url"), m("url"), m("pdf_url"), F.col("url"), F.col("title"))
    has_abstract = present(F.col("abstract")) | present(m("abstract"))
    has_date = present(F.col("year")) | present(m("publication_date"))
    has_link = present(F.col("doi")) | present(F.col("url")) | present(m("doi_url")) | present(m("arxiv_url"))
    q = quality(F.col("title"), F.col("authors"), has_abstract, has_date, has_link, m("source"))
    academic = F.struct(
        F.nullif(m("doi"), F.lit("")).alias("doi"), m("citation_count").alias("citation_count"), m("reference_count").alias("reference_count"), m("is_open_access").alias("open_access"), F.col("entry_type").alias("type"),
        F.nullif("publisher", F.lit("")).alias("publisher"), F.nullif("volume", F.lit("")).alias("volume"), F.nullif("pages", F.lit("")).alias("pages"), F.when(present_array(m("subjects")), m("subjects")).alias("subjects"),
        F.nullif(m("source"), F.lit("")).alias("metadata_source"), F.when(present(m("source")) & (m("confidence_score") != 0), m("confidence_score")).alias("confidence_score"),
        q["score"].alias("quality_score"), F.when(F.size(q["issues"]) > 0, q["issues"]).alias("quality_issues"),
    )
    dated = entries.withColumn("_d", date)
    extra = ["suggestion"] if "suggestion" in entries.columns else []
    return dated.select(
        "ord", guid(F.col("key"), F.col("doi")).alias("id"), display_title(F.col("title"), F.col("url")).alias("title"),
        description(m("abstract"), F.col("abstract"), F.col("journal"), F.col("year"), F.col("authors")).alias("content_text"),
        F.col("_d.iso").alias("date_published"), F.when(F.col("_d.estimated") & F.col("_d.iso").isNotNull(), F.lit(True)).alias("_date_estimated"), "discovery_date",
        link.alias("url"), author_objects(m("authors"), F.col("authors")).alias("authors"), author_string(F.col("authors")).alias("creator"),
        tags(m("keywords"), F.col("keywords"), F.col("entry_type"), m("venue"), F.col("journal"), m("subjects")).alias("tags"),
        tags(m("keywords"), F.col("keywords"), F.col("entry_type"), F.col("journal"), F.lit(None), F.lit(None).cast("array<string>")).alias("categories"),
        content_html(_cols()).alias("content_html"), content_html(_cols(), escape=False).alias("rss_html"), academic.alias("_academic"), *extra,
    )


def in_order(feed_items: DataFrame) -> DataFrame:
    """Latest discovery first, unknown as the epoch, then by ``ord``."""
    return feed_items.orderBy(F.coalesce("discovery_date", F.lit("1970-01-01").cast("timestamp")).desc(), F.col("ord").asc())


def json_item(df: DataFrame) -> Column:
    """An item as JSON: id, title, content_text and date_published are always there, other keys only with a value."""
    always = F.to_json(F.struct("id", "title", "content_text", "date_published"), {"ignoreNullFields": "false"})
    found = F.date_format("discovery_date", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    some = [found.alias("_discovery_date"), F.col("_date_estimated"), F.nullif("url", F.lit("")).alias("url"), F.nullif("url", F.lit("")).alias("external_url"), F.when(F.size("authors") > 0, F.col("authors")).alias("authors"), F.when(F.size("tags") > 0, F.col("tags")).alias("tags"), F.nullif("content_html", F.lit("")).alias("content_html"), F.col("_academic")]
    if "suggestion" in df.columns:
        some.append(F.col("suggestion").alias("_slack_suggestion"))
    rest = F.to_json(F.struct(*some))
    return F.when(rest == "{}", always).otherwise(F.concat(F.substr(always, F.lit(1), F.length(always) - 1), F.lit(","), F.substr(rest, F.lit(2))))


def json_feed(feed_items: DataFrame, title: str, home: str, about: str = "") -> DataFrame:
    """Lines of a JSON Feed document in order; written as text, the parts in order are the document. No item list is gathered."""
    spark = feed_items.sparkSession
    edge = lambda s, value: spark.range(1).select(F.lit(s).alias("_s"), F.lit(None).cast("timestamp").alias("_d"), F.lit(0).cast("bigint").alias("_o"), value.alias("value"))
    top = F.to_json(F.struct(F.lit("https://jsonfeed.org/version/1.1").alias("version"), F.lit(title).alias("title"), F.lit(home).alias("home_page_url"), F.lit(about).alias("description")))
    when = F.coalesce("discovery_date", F.lit("1970-01-01").cast("timestamp"))
    first = feed_items.agg(F.max(F.struct(when.alias("d"), (-F.col("ord")).alias("o"))).alias("m"))
    lines = feed_items.crossJoin(F.broadcast(first))
    comma = F.when((when == F.col("m.d")) & (F.col("ord") == -F.col("m.o")), "").otherwise(",")
    body = lines.select(F.lit(1).alias("_s"), when.alias("_d"), F.col("ord").alias("_o"), F.concat(comma, json_item(feed_items)).alias("value"))
    head = edge(0, F.concat(F.substr(top, F.lit(1), F.length(top) - 1), F.lit(',"items":[')))
    return head.unionByName(body).unionByName(edge(2, F.lit("]}"))).orderBy("_s", F.col("_d").desc(), "_o").select("value")


def rss_item() -> Column:
    """An item as RSS."""
    tag = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name.split(' ')[0]}>")))
    some = lambda c: F.when(F.nullif(c, F.lit("")).isNotNull(), escape_html(c))
    categories = F.array_join(F.transform(F.filter("categories", lambda c: c != ""), lambda c: F.concat(F.lit("<category>"), escape_html(c), F.lit("</category>"))), "")
    cdata = F.when(F.col("rss_html") != "", F.concat(F.lit("<![CDATA["), F.replace("rss_html", F.lit("]]>"), F.lit("]]]]><![CDATA[>")), F.lit("]]>")))
    return F.concat_ws(
        "", F.lit("<item>"), tag("title", F.col("title")), tag("description", some(F.col("content_text"))), tag("link", some(F.col("url"))), tag('guid isPermaLink="false"', escape_html(F.col("id"))), tag("pubDate", rss_date(F.col("date_published"))),
        tag("dc:creator", some(F.col("creator"))), categories, tag("content:encoded", cdata), tag("dc:date", F.date_format("discovery_date", "EEE, dd MMM yyyy HH:mm:ss Z")), F.lit("</item>"),
    )


def rss_feed(feed_items: DataFrame, title: str, home: str, about: str = "", now: Column | None = None) -> DataFrame:
    """Lines of an RSS document in order, as ``json_feed``."""
    spark = feed_items.sparkSession
    stamp = F.date_format(now if now is not None else F.current_timestamp(), "EEE, dd MMM yyyy HH:mm:ss Z")
    opening = F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?><rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><title>'), escape_html(F.lit(title)), F.lit("</title><link>"), escape_html(F.lit(home)),
        F.lit("</link><description>"), escape_html(F.lit(about)), F.lit("</description><language>en</language><lastBuildDate>"), stamp, F.lit("</lastBuildDate><pubDate>"), stamp, F.lit("</pubDate>"),
    )
    edge = lambda s, value: spark.range(1).select(F.lit(s).alias("_s"), F.lit(None).cast("timestamp").alias("_d"), F.lit(0).cast("bigint").alias("_o"), value.alias("value"))
    when = F.coalesce("discovery_date", F.lit("1970-01-01").cast("timestamp"))
    body = feed_items.select(F.lit(1).alias("_s"), when.alias("_d"), F.col("ord").alias("_o"), rss_item().alias("value"))
    return edge(0, opening).unionByName(body).unionByName(edge(2, F.lit("</channel></rss>"))).orderBy("_s", F.col("_d").desc(), "_o").select("value")


def suggestion(meta: Column, source: Column) -> Column:
    """The publishable part of a suggestion, only for records that came from one."""
    return F.when(source == "slack", F.when(meta.isNotNull(), F.struct(*[meta[k].alias(k) for k in SUGGESTION])))
