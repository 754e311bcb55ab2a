import pytest
from pyspark.sql import functions as F

from vellum.functions import files, ids, names, pages, scoring, similarity, text, urls


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(expr(F.col("c")).alias("r")).first()["r"]


CASES = [
    (text.strip_latex, r"\textbf{Deep} {Nets} \alpha x", "Deep Nets x"),
    (text.extract_year, "in 2019-05", "2019"), (text.extract_year, " soon ", "soon"),
    (text.normalize_month, "Sept", None), (text.normalize_month, "September", "09"), (text.normalize_month, "7", "07"), (text.normalize_month, "mar", "03"),
    (text.strip_markup, "<jats:p>One</jats:p><jats:p>two <i>x</i></jats:p>", "One two x"),
    (text.escape_html, "a & b <c> \"d\" 'e'", "a &amp; b &lt;c&gt; &quot;d&quot; &#x27;e&#x27;"),
    (text.page_title, "View of A long title here | Site", "A long title here"), (text.page_title, "Short | Site", None),
    (text.search_title, r"\emph{EU}'s {rules}: a/b", "EU's rules: a b"),
    (text.html_unescape, "a &amp;amp; &eacute;", "a &amp; é"), (text.nfkd_ascii, "Ünïcode ﬁ", "Unicode fi"),
    (ids.doi_parsed, "https://doi.org/10.1/AbC", "10.1/AbC"), (ids.doi_archive, "http://dx.doi.org/10.1234/AB.", "10.1234/ab"), (ids.doi_archive, " ", None),
    (ids.doi_open_access, "DOI:10.1/X", "10.1/x"), (ids.doi_in_text, "see 10.1234/ab.c). Then", "10.1234/ab.c"),
    (names.natural_order, "Doe, Jane", "Jane Doe"), (names.natural_order, "Doe, Jane, Jr.", "Doe, Jane, Jr."), (names.natural_order, "Doe, ", "Doe,"),
    (names.first_author, "Doe, Jane and Roe, R", "Doe"),
    (urls.clean_url, r" \url{https://a.org/x\_y\%20} ", "https://a.org/x_y%20"), (urls.validate_url, "javascript:alert(1)", None), (urls.validate_url, "a.org/x'y", "https://a.org/x%27y"), (urls.validate_url, "ftp://a.org", None),
    (urls.title_from_url, "https://a.org/papers/deep-nets_now.pdf", "Deep Nets Now"), (urls.title_from_url, "https://a.org/x?title=my-title", "my title"), (urls.title_from_url, "https://a.org/article/123", ""), (urls.title_from_url, None, ""),
    (urls.quote, "a b/c~*", "a%20b/c~%2A"),
]


@pytest.mark.parametrize(("f", "value", "want"), CASES)
def test_scalar(spark, f, value, want):
    assert one(spark, value, f) == want


def test_validity(spark):
    for title, want in [("Untitled", False), ("abc", False), ("12345 !!", False), ("A real title", True), (None, False), ("", False)]:
        assert one(spark, title, text.valid_title) is want
    for doi, want in [("10.1234/x", True), ("10.1234", False), ("11.1234/x", False), (None, False)]:
        assert one(spark, doi, ids.valid_doi) is want


def test_similarity(spark):
    df = spark.createDataFrame([("Deep nets", "deep nets"), ("a b c", "x y"), ("the of", "the of"), ("deep nets for all", "nets"), (None, "x")], "a string, b string")
    got = [round(r[0], 6) for r in df.select(similarity.text_similarity(F.col("a"), F.col("b"))).collect()]
    assert got == [1.0, 0.0, 0.0, round(1 / 3 + 0.2, 6), 0.0]
    a = spark.createDataFrame([("Jane Doe and R Roe", ["R Roe", "X Y"]), ("", ["A"]), ("A B", [])], "q string, p array<string>")
    assert [r[0] for r in a.select(similarity.author_similarity(F.col("q"), F.col("p"))).collect()] == [1.0, 0.0, 0.0]


def test_urls_in_text(spark):
    t = "see <https://a.org/x|label> and https://b.org/y). again https://b.org/y and <https://a.org/x>"
    assert one(spark, t, urls.urls_in_text) == ["https://a.org/x", "https://b.org/y"]


def test_keys(spark):
    df = spark.createDataFrame([("Jane van Doe", "2020", "17.5"), (None, None, "1712345678.1"), ("Ümit Çelik", "20", "1")], "a string, y string, ts string")
    got = [r[0] for r in df.select(ids.mint_key(F.col("a"), F.col("y"), F.col("ts"))).collect()]
    import hashlib

    h = lambda s: hashlib.sha1(s.encode()).hexdigest()[:2]
    assert got == [f"Doe2020-sl{h('17.5')}", f"Slack1712345678-sl{h('1712345678.1')}", f"elikND-sl{h('1')}"]


def test_pages(spark):
    html = """<meta content='A &amp; B study of it' name="citation_title"><meta name="citation_author" content="X Y"><META property="dc.creator" content="Z"><meta name="dc.date" content="2021-02-03"><meta name="dc.identifier" content="doi:10.1234/ab.1">"""
    df = spark.createDataFrame([(html,), ("<title>View of Something long | Site</title>",), (None,)], "h string").withColumn("t", pages.meta_tags(F.col("h")))
    m = df.select(pages.page_meta(F.col("h"), F.col("t")).alias("m"), pages.page_doi(F.col("t")).alias("d")).collect()
    assert (m[0].m.title, m[0].m.authors, m[0].m.year, m[0].d) == ("A & B study of it", ["X Y", "Z"], "2021", "10.1234/ab.1")
    assert m[1].m.title == "Something long" and m[2].m.title is None


def test_dates_and_quality(spark):
    df = spark.createDataFrame([("2020-01-02", "2019", "03"), ("2020-01", None, None), ("2020", "2019", "03"), ("2020", "2019", None), (None, "2019", None), (None, None, None)], "p string, y string, m string")
    got = [tuple(r[0]) for r in df.select(scoring.resolve_date(F.col("p"), F.col("y"), F.col("m"))).collect()]
    assert got == [("2020-01-02T00:00:00Z", False), ("2020-01-15T00:00:00Z", True), ("2019-03-15T00:00:00Z", True), ("2020-01-01T00:00:00Z", True), ("2019-01-01T00:00:00Z", True), (None, False)]
    assert one(spark, "2020-01-02T00:00:00Z", scoring.rss_date) == "Thu, 02 Jan 2020 00:00:00 +0000" and one(spark, "x", scoring.rss_date) is None
    ages = spark.createDataFrame([(1.0, 5.0), (9.0, 8.0), (None, 4.0), (9.0, None), (None, None)], "a double, b double")
    assert [r[0] for r in ages.select(scoring.confirmed_age(F.col("a"), F.col("b"), F.lit(2.0))).collect()] == [1.0, 8.0, 4.0, 9.0, None]


def test_files(spark):
    big = b"%PDF-" + b"x" * 20_000
    rows = [("u", 404, "application/pdf", big), ("u", 200, "text/html", big), ("http://a/x.PDF", 200, "application/octet-stream", big), ("http://a/x", 200, "binary/octet-stream", big), ("u", 200, "application/pdf; v=1", b"%PDF-"), ("u", 200, "application/pdf", b"x" * 20_000), ("u", 200, "application/pdf", big)]
    df = spark.createDataFrame(rows, "u string, s int, t string, c binary")
    assert [r[0] for r in df.select(files.pdf_reason(F.col("u"), F.col("s"), F.col("t"), F.col("c"))).collect()] == ["http_status", "content_type", None, "content_type", "too_small", "no_magic", None]
    n = spark.createDataFrame([(["A B", "C"], "2020", "x/y" * 80, "K1"), ([], None, None, None)], "a array<string>, y string, t string, k string")
    got = [r[0] for r in n.select(files.file_name(F.col("a"), F.col("y"), F.col("t"), F.col("k"))).collect()]
    assert got[0].startswith("K1 - B et al. 2020 - x-yx-y") and len(got[0]) == len("K1 - B et al. 2020 - .pdf") + 150 and got[1] == "Unknown - untitled.pdf"
