"""URLs: cleaning, validation, titles in them, and links of records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import escape_html, present, strip, valid_title

#: Path segments that are no titles. Fixed values.
SKIPPED = ("article", "paper", "abstract", "view", "content", "doi", "full", "download", "index")
#: Hosts that publish openly. Fixed values.
OPEN_HOSTS = ("arxiv.org", "biorxiv.org", "medrxiv.org", "osf.io", "zenodo.org", "ssrn.com", "researchgate.net")


def clean_field_url(c: Column) -> Column:
    """A URL field of a bibliography file without its wrapper and escapes."""
    c = F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"\\url\{([^}]*)\}", "$1")
    for char in "_&%#{}~":
        c = F.replace(c, F.lit("\\" + char), F.lit(char))
    return c


def clean_url(c: Column) -> Column:
    """As ``clean_field_url``, and without backslashes that are left before letters."""
    c = F.replace(clean_field_url(c), F.lit("\\\\"), F.lit("\\"))
    return F.regexp_replace(c, r"\\(?=[a-zA-Z_])", "")


def validate_url(c: Column) -> Column:
    """A web address that is safe to print, NULL otherwise; a bare host gets a scheme."""
    url = strip(clean_url(c))
    low = F.lower(url)
    web = low.startswith("http://") | low.startswith("https://")
    bad = url.contains("://") | low.startswith("javascript:") | low.startswith("data:") | low.startswith("vbscript:")
    bare = url.contains(".") & ~url.startswith("/")
    out = F.when(web, url).when(bad, None).when(bare, F.concat(F.lit("https://"), url))
    for char, code in (('"', "%22"), ("'", "%27"), ("<", "%3C"), (">", "%3E")):
        out = F.replace(out, F.lit(char), F.lit(code))
    return F.when(present(c), out)


def title_from_url(c: Column) -> Column:
    """A title that a URL tells: a query parameter, else the last telling segment of the path; '' if none."""
    spaced = lambda t: F.replace(F.replace(t, F.lit("-"), F.lit(" ")), F.lit("_"), F.lit(" "))
    query = F.coalesce(*[F.nullif(F.try_parse_url(c, F.lit("QUERY"), F.lit(k)), F.lit("")) for k in ("title", "name", "t")])
    path = F.regexp_replace(F.coalesce(F.try_parse_url(c, F.lit("PATH")), F.lit("")), r"(?i)\.(pdf|html?|aspx?|php|xml)$", "")
    segment = F.try_element_at(F.filter(F.split(path, "/"), lambda s: (s != "") & ~s.rlike(r"^\d+$")), F.lit(-1))
    words = F.filter(F.split(spaced(F.try_url_decode(segment)), r"\s+"), lambda w: w != "")
    telling = segment.isNotNull() & ~F.lower(segment).isin(*SKIPPED) & (F.size(words) >= 2) & ~F.forall(words, lambda w: w.rlike(r"^\d+$"))
    capital = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))), " ")
    return F.coalesce(F.when(query.isNotNull(), spaced(F.try_url_decode(query))), F.when(telling, capital), F.lit(""))


def quote(c: Column) -> Column:
    """Percent-encoding as in a path."""
    c = F.url_encode(c)
    for code, char in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        c = F.replace(c, F.lit(code), F.lit(char))
    return c


def display_title(title: Column, url: Column) -> Column:
    """The title to show: a valid one, else the URL's, else whatever is there, else Untitled."""
    from_url = F.when(~valid_title(title) & present(url), F.nullif(title_from_url(clean_url(url)), F.lit("")))
    shown = F.coalesce(from_url, F.nullif(title, F.lit("")), F.lit("Untitled"))
    return escape_html(strip(F.regexp_replace(shown, "[{}]", "")))


def primary_link(doi_url: Column, doi: Column, arxiv_url: Column, md_url: Column, pdf_url: Column, url: Column, title: Column) -> Column:
    """The link to show, by priority; at last a search for the title."""
    some = lambda c: F.when(present(c), clean_url(c))
    search = F.when(present(title), F.concat(F.lit("https://scholar.google.com/scholar?q="), quote(F.substring(title, 1, 150))))
    return F.coalesce(some(doi_url), F.when(present(doi), F.concat(F.lit("https://doi.org/"), doi)), some(arxiv_url), some(md_url), some(pdf_url), some(url), search)


def urls_in_text(c: Column) -> Column:
    """URLs of a chat text in order, wrapped ones first, each once."""
    c = F.coalesce(c, F.lit(""))
    wrapped = F.regexp_extract_all(c, F.lit(r"<(https?://[^|>\s]+)(?:\|[^>]*)?>"), F.lit(1))
    rest = F.regexp_replace(c, r"<https?://[^>]*>", " ")
    naked = F.transform(F.regexp_extract_all(rest, F.lit(r"(https?://[^\s<>|]+)"), F.lit(1)), lambda u: F.regexp_replace(u, r"[.,;)]+$", ""))
    return F.array_distinct(F.concat(wrapped, naked))


def open_host(c: Column) -> Column:
    """Whether a URL belongs to a host that publishes openly."""
    return F.coalesce(F.lower(c).rlike("|".join(h.replace(".", r"\.") for h in OPEN_HOSTS)), F.lit(False))


def runs_url(repo: Column, workflow: Column) -> Column:
    """The page of a workflow's runs."""
    return F.concat(F.lit("https://github.com/"), repo, F.lit("/actions/workflows/"), workflow)


def commits_url(repo: Column, path: Column) -> Column:
    """The page of a path's commits."""
    base = F.concat(F.lit("https://github.com/"), repo, F.lit("/commits"))
    return F.when(present(path), F.concat(base, F.lit("/HEAD/"), path)).otherwise(base)
