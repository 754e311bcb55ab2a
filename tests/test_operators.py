import datetime as dt
import json
import xml.dom.minidom

from pyspark.sql import functions as F

from vellum import schemas
from vellum.functions import payloads
from vellum.operators import archive, cache, dedup, feed, freshness, index, match

class _Now:
    """The fixed present, as a column once there is a session."""

    def __new__(cls):
        return F.lit("2024-06-01 00:00:00").cast("timestamp")


def entries(spark, rows):
    base = {f.split()[0]: None for f in ("ord", "entry_type", "key", "title", "authors", "year", "month", "doi", "url", "abstract", "keywords", "journal", "volume", "pages", "publisher", "discovery_date", "raw_fields", "source")}
    return spark.createDataFrame([tuple({**base, **r}.values()) for r in rows], schemas.ENTRY)


def test_cross_source_dedup_against_the_loop(spark):
    import random

    random.seed(5)
    for _ in range(3):
        rows = [dict(ord=i, source=random.choice(["a", "b", None]), doi=random.choice([None, "", "10.1/X", "10.1/y"]), title=random.choice(["T one", "t, ONE", "two", None]), authors=random.choice([["A Doe"], ["B. doe"], []]), year=random.choice(["2020", None])) for i in range(40)]
        by_doi, by_fp, kept = {}, {}, []
        norm = lambda s: " ".join("".join(c if c.isalnum() or c in "_ " else " " for c in s.lower()).split())
        for r in rows:
            doi = (r["doi"] or "").strip().lower() or None
            fp = (norm(r["title"] or ""), norm(r["authors"][0].split()[-1]) if r["authors"] else "", (r["year"] or "").strip())
            fp = fp if all(fp) else None
            prior = by_doi.get(doi) if doi and doi in by_doi else by_fp.get(fp) if not doi and fp else None
            if prior is not None and prior["source"] != r["source"]:
                continue
            kept.append(r["ord"])
            if doi:
                by_doi.setdefault(doi, r)
            if fp:
                by_fp.setdefault(fp, r)
        assert sorted(r.ord for r in dedup.cross_source(entries(spark, rows)).collect()) == kept


def test_cache_states(spark):
    now = dt.datetime(2024, 6, 1)
    day = lambda n: now - dt.timedelta(days=n)
    rows = [("fresh", day(1), False, None), ("edge", day(30), False, None), ("old", day(31), False, None), ("failed", day(1), True, day(1)), ("again", day(8), True, day(8)), ("stored", day(9), True, None)]
    c = spark.createDataFrame(rows, "entry_hash string, cached_at timestamp, failed boolean, last_failure_at timestamp")
    got = {r.entry_hash: r.s for r in c.select("entry_hash", cache.state(_Now(), F.col("cached_at"), F.col("failed"), F.col("last_failure_at")).alias("s")).collect()}
    assert got == {"fresh": "valid", "edge": "valid", "old": "expired", "failed": "failed", "again": "failed_retriable", "stored": "failed_retriable"}
    e = spark.createDataFrame([(h,) for h in [*got, "new"]], "entry_hash string")
    assert sorted(r.entry_hash for r in cache.uncached(e, c, _Now()).collect()) == ["again", "new", "old", "stored"]
    assert cache.statistics(c, _Now()).first().asDict() == {"total": 6, "valid": 5, "expired": 1, "successful": 3, "failed": 3, "failed_retriable": 2}
    assert cache.purge(c, _Now()).count() == 5


def test_best_match_is_brute_force(spark):
    import random

    random.seed(2)
    words = "deep shallow nets trees panel survey data the of models for urban rural".split()
    q = [(i, " ".join(random.sample(words, 5)), "A B and C D") for i in range(40)]
    c = [(i, i, " ".join(random.sample(words, 5)), random.choice([["A B"], ["X"], []]), None) for i in range(60)]
    qd, cd = spark.createDataFrame(q, "qid int, title string, authors string"), spark.createDataFrame(c, "cid int, pos int, title string, authors array<string>, score double")
    from vellum.functions.similarity import match_score

    every = qd.withColumnRenamed("title", "t").withColumnRenamed("authors", "qa").crossJoin(cd).select("qid", "cid", F.round(match_score(F.col("t"), F.col("title"), F.col("qa"), F.col("authors")), 9).alias("s"))
    want = {r.qid: (r.m.c * -1, r.m.s) for r in every.where("s > 0.6").groupBy("qid").agg(F.max(F.struct("s", (-F.col("cid")).alias("c"))).alias("m")).collect()}
    assert {r.qid: (r.cid, r.score) for r in match.best_match(qd, cd, 0.6).collect()} == want and want
    assert match.best_match(qd.limit(0), cd, 0.6).count() == 0


def test_best_match_meets_titles_that_hold_others(spark):
    import random

    from vellum.functions.similarity import match_score
    from vellum.functions.text import search_title

    random.seed(3)
    words = "the of nets net data panel a models model survey for urban rural deep".split()
    some = lambda most: " ".join(random.choice(words) for _ in range(random.randint(1, most)))
    whole = [some(9) for _ in range(60)]
    part = lambda t: (lambda i: t[i : i + random.randint(3, 30)])(random.randint(0, len(t) // 2))
    q = [(i, random.choice([part(random.choice(whole)), random.choice(whole), some(4)]), random.choice(["A B and C D", "X", None])) for i in range(120)]
    c = [(i, 999 - i, random.choice([part(random.choice(whole)), random.choice(whole), some(4)]), random.choice([["A B"], ["X"], [], None]), random.choice([None, 4.0, 50.0])) for i in range(120)]
    qd, cd = spark.createDataFrame(q, "qid int, title string, authors string"), spark.createDataFrame(c, "cid int, pos int, title string, authors array<string>, score double")
    pairs = qd.withColumnsRenamed({"title": "t", "authors": "qa"}).crossJoin(cd).withColumns({"t": search_title(F.col("t")), "title": search_title(F.col("title"))})
    for gate, boost in ((0.7, False), (0.6, False), (0.6, True), (0.95, False)):
        every = pairs.select("qid", "cid", "pos", F.round(match_score(F.col("t"), F.col("title"), F.col("qa"), F.col("authors"), F.col("score") if boost else None), 9).alias("s"))
        want = {r.qid: (r.m.cid, r.m.s) for r in every.where(F.col("s") > gate).groupBy("qid").agg(F.max(F.struct("s", (-F.col("pos")).alias("p"), "cid")).alias("m")).collect()}
        assert {r.qid: (r.cid, r.score) for r in match.best_match(qd, cd, gate, boost=boost).collect()} == want and want


def test_best_match_ranks_words_once(spark):
    q = spark.createDataFrame([(1, "Deep nets", "A B")], "qid int, title string, authors string")
    c = spark.createDataFrame([(1, 1, "Deep nets", ["A B"], None)], "cid int, pos int, title string, authors array<string>, score double")
    plan = match.best_match(q, c)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") <= 5 and plan.count("Generate") <= 40  # 29 and 72 before, with the ranking of both sides anew in each


def test_best_match_shuffles_in_proportion_to_its_rows(spark):
    def stages():
        none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
        found = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, none, None)
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    title = lambda of: f"rural schools and old panel data: survey of {of} {of}x"
    q = spark.createDataFrame([(i, title(f"q{i}"), f"Ann Q{i}") for i in range(600)], "qid int, title string, authors string")
    c = spark.createDataFrame([(i, i, title(f"c{i}"), [f"Ann C{i}" if i else "Ann Q7"], None) for i in range(600)], "cid int, pos int, title string, authors array<string>, score double")
    before = max(stages(), default=-1)
    assert [(r.qid, r.cid, r.score) for r in match.best_match(q, c).collect()] == [(7, 0, 0.72)]
    assert sum(n for k, n in stages().items() if k > before) < 50 * 1200


def test_payloads(spark):
    item = {"DOI": "10.1/x", "title": ["T"], "abstract": "<jats:p>Hi</jats:p>", "author": [{"given": "A", "family": "B"}, {"family": "C"}], "published-online": {"date-parts": [[2020, 3, 4]]}, "container-title": ["J"], "is-referenced-by-count": 0}
    df = spark.createDataFrame([(json.dumps(item),)], "v string").select(F.from_json("v", schemas.CROSSREF).alias("p")).select("p.*")
    r = payloads.from_crossref(df).first()
    assert (r.doi_url, r.abstract, r.authors, r.publication_date, r.venue, r.citation_count) == ("https://doi.org/10.1/x", "Hi", ["A B", "C"], "2020-03-04", "J", 0)
    work = {"title": "T", "doi": "https://doi.org/10.1/y", "authorships": [{"author": {"display_name": "Doe, Jane"}}, {"author": {"display_name": None}}], "concepts": [{"display_name": "a", "score": 0.9}, {"display_name": "b", "score": 0.1}], "abstract_inverted_index": {"to": [1, 3], "be": [0, 2]}, "best_oa_location": {"pdf_url": "p"}}
    df = spark.createDataFrame([(json.dumps(work),)], "v string").select(F.from_json("v", schemas.OPENALEX).alias("p")).select("p.*")
    r = payloads.from_openalex(df).first()
    assert (r.doi, r.authors, r.subjects, r.abstract, r.pdf_url) == ("10.1/y", ["Jane Doe"], ["a"], "be to be to", "p")
    dc = [({"titles": [{"title": " "}, {"title": "T"}], "creators": [{"name": "Doe, Jane"}, {"givenName": "R", "familyName": "Roe"}], "publicationYear": 2020, "descriptions": [{"description": "n", "descriptionType": "Other"}, {"description": "abs", "descriptionType": "Abstract"}]}), ({"titles": []})]
    df = spark.createDataFrame([(json.dumps(x),) for x in dc], "v string").select(F.from_json("v", schemas.DATACITE).alias("p")).select("p.*")
    rows = payloads.paper_from_datacite(df).collect()
    assert len(rows) == 1 and rows[0].authors == ["Jane Doe", "R Roe"] and rows[0].abstract == "abs" and rows[0].year == "2020"
    oa = spark.createDataFrame([('{"is_oa": true, "best_oa_location": {"url_for_pdf": "u", "license": "cc"}}',), ('{"is_oa": null}',)], "v string")
    assert [tuple(r[0])[:2] for r in oa.select(payloads.open_access_result(F.col("v"))).collect()] == [(True, "u"), (False, None)]


def test_index(spark):
    df = spark.createDataFrame([(1, "a b  a"), (2, None), (3, "")], "id int, t string")
    ix = index.build(df, "id", "t")
    assert {(r.word, tuple(r.positions)) for r in ix.collect()} == {("a", (0, 2)), ("b", (1,))}
    assert [tuple(r) for r in index.rebuild(ix, "id").collect()] == [(1, "a b a")]


def test_feeds_are_documents(spark):
    e = entries(spark, [
        dict(ord=1, entry_type="article", key="K1", title="A <b> title", authors=["A B"], year="2020", keywords=["k"], discovery_date=dt.datetime(2024, 1, 1), source="x"),
        dict(ord=2, entry_type="book", key="K2", title=None, url="https://a.org/some-long-title", authors=[], discovery_date=None, source="slack"),
    ])
    md = spark.createDataFrame([("K1", "Abs <i>x</i>", "10.1/x", "https://doi.org/10.1/x", None, None, None, "2020-05", 0, None, "V", ["M N"], ["kw"], ["s"], True, "crossref", 0.9)], schemas.ENRICHED)
    items = feed.items(feed.attach(e, md))
    doc = json.loads("".join(r.value for r in feed.json_feed(items, "T", "h").collect()))
    a, b = doc["items"]
    assert a["id"] == "bibtex:K1" and a["title"] == "A &lt;b&gt; title" and a["content_text"] == "Abs x" and a["date_published"] == "2020-05-15T00:00:00Z" and a["_date_estimated"] is True
    assert a["_academic"]["citation_count"] == 0 and a["_academic"]["quality_score"] == 100 and "quality_issues" not in a["_academic"] and a["authors"] == [{"name": "M N"}] and a["tags"] == ["Article", "V", "k", "kw", "s"]
    assert b["title"] == "Some Long Title" and b["date_published"] is None and "authors" not in b and b["_academic"]["quality_issues"] == ["missing_title", "missing_authors", "missing_abstract", "missing_date", "not_enriched"]
    rss = xml.dom.minidom.parseString("".join(r.value for r in feed.rss_feed(items, "T & U", "h", now=_Now()).collect()).encode())
    assert len(rss.getElementsByTagName("item")) == 2
    empty = json.loads("".join(r.value for r in feed.json_feed(items.limit(0), "T", "h").collect()))
    assert empty["items"] == []


def test_archive_and_router(spark):
    known = spark.createDataFrame([("https://doi.org/10.1/A", None), (None, "A Known Title!"), (None, "short")], "doi string, title string")
    dois, titles = archive.index(known)
    papers = spark.createDataFrame([(1, "10.1/a.", None), (2, None, "a knówn title"), (3, None, "short"), (4, "10.1/b", "other thing entirely")], "i int, doi string, title string")
    assert {r.i: r.is_known for r in archive.known(papers, dois, titles).collect()} == {1: True, 2: True, 3: False, 4: False}
    rows = [("1", "hello", None, None, None, None), ("2", "#papers <https://arxiv.org/abs/2401.01234v2|x>", None, None, None, None), ("3", "#papers", None, "channel_join", None, None), ("4", "#papersx", None, None, None, None), ("5", "#Papers 10.1234/abc.", None, None, "B1", None)]
    m = spark.createDataFrame(rows, "ts string, text string, user string, subtype string, bot_id string, thread_ts string").withColumn("files", F.lit(None).cast("array<struct<mimetype:string,filetype:string,url_private_download:string>>"))
    got = {r.ts: (r.skip, r.preprint, r.doi) for r in archive.route(m, "#papers").collect()}
    assert got["1"][0] == "not_asked" and got["2"] == (None, "2401.01234", None) and got["3"][0] == "event" and got["4"][0] == "not_asked" and got["5"] == ("bot", None, "10.1234/abc")
    p = spark.createDataFrame([("a", dt.datetime(2024, 5, 2)), ("b", dt.datetime(2024, 5, 3)), ("c", None)], "ts string, first_seen timestamp")
    assert {r.ts: r.is_expired for r in archive.expire(p, _Now()).collect()} == {"a": True, "b": False, "c": False}
    assert not any(r.is_expired for r in archive.expire(p, _Now(), 0).collect())


def test_freshness(spark):
    t = lambda h: dt.datetime(2024, 6, 1) - dt.timedelta(hours=h)
    runs = spark.createDataFrame([
        ("r", "a", t(5), t(5), t(5), "schedule", "in_progress", None), ("r", "a", t(9), t(9), t(8), "schedule", "completed", "success"), ("r", "b", None, t(2), t(1), "push", "completed", "failure"),
        ("r", "b", t(30), t(30), t(29), "schedule", "completed", "failure"), ("r", "c", t(9), t(9), t(8), "schedule", "completed", "cancelled"), ("r", "d", t(9), t(9), t(1), "schedule", "completed", "cancelled"),
    ], schemas.RUNS)
    assert {(r.workflow, r.finding) for r in freshness.run_findings(runs, _Now()).collect()} == {("a", "hung"), ("b", "failed"), ("d", "failed")}
    targets = spark.createDataFrame([("r", "a", 0.2, "p", 1.0, "h"), ("r", "b", 5.0, None, None, "h")], schemas.TARGETS)
    commits = spark.createDataFrame([("r", "p", t(12))], schemas.COMMITS)
    assert {(r.key, r.finding) for r in freshness.target_findings(targets, runs, commits, _Now()).collect()} == {("r/a", "stale"), ("r/b", "never_ran")}
    f = spark.createDataFrame([("x",), ("y",)], "key string")
    assert [r.post for r in freshness.hold(f, None).collect()] == [True, True]
    assert {r.key: r.post for r in freshness.hold(f, spark.createDataFrame([("x",)], "key string")).collect()} == {"x": True, "y": False}
    assert not any(r.post for r in freshness.hold(f, f.limit(0)).collect())


def test_resolver_and_inbox(spark):
    s = spark.createDataFrame([("1", ["https://arxiv.org/abs/2401.01234"], None, "2401.01234"), ("2", [], "10.1234/A", None), ("3", ["https://p.org/x"], None, None), ("4", ["https://q.org/y"], None, None), ("5", ["https://r.org/z"], None, None)], "ts string, urls array<string>, doi string, preprint string")
    kinds = "title string, authors array<string>, year string, url string, abstract string"
    pre = spark.createDataFrame([("2401.01234", "P", ["A"], "2024", "u", "x")], f"arxiv_id string, {kinds}")
    cross = spark.createDataFrame([("10.1234/a", "C", ["B"], "2020", "u", None)], f"doi string, {kinds}")
    data = spark.createDataFrame([("10.5/d", "D", [], "2021", "u", None)], f"doi string, {kinds}")
    pages = spark.createDataFrame([("https://p.org/x", None, None, None, "10.5/D"), ("https://q.org/y", "Page", ["C"], "2019", None)], "url string, title string, authors array<string>, year string, doi string")
    got = {r.ts: (r.paper.source, r.paper.title) for r in archive.resolve(s, pre, cross, data, pages).collect()}
    assert got == {"1": ("arxiv", "P"), "2": ("crossref", "C"), "3": ("datacite", "D"), "4": ("landing_page", "Page"), "5": ("minimal", None)}
    inbox = spark.createDataFrame([("K1", "10.1/X"), ("K2", None)], "key string, doi string")
    rows = spark.createDataFrame([("K2", None), ("K9", "10.1/x"), ("K8", "10.1/y")], "key string, doi string")
    assert {r.key: r.is_there for r in archive.contains(rows, inbox).collect()} == {"K2": True, "K9": True, "K8": False}
    m = spark.createDataFrame([("9.5",), ("10.5",)], "ts string")
    assert archive.cursor(m).first()[0] == "10.5" and [r.ts for r in archive.unseen(m, m.limit(0), "9.5").collect()] == ["10.5"]
    k = spark.createDataFrame([("a",), ("b",)], "doi string")
    c = spark.createDataFrame([("a", dt.datetime(2024, 5, 30), None)], "doi string, cached_at timestamp, result string")
    hits, misses = cache.split_hits(k, c, _Now(), "doi")
    assert (hits.count(), [r.doi for r in misses.collect()]) == (1, ["b"])
    r = spark.range(1).select(cache.failure_reason(F.lit("K"), F.lit(None).cast("string"), F.lit("Tit"), F.array(*map(F.lit, "abc")), ["X"]))
    assert r.first()[0] == "Could not enrich entry: K | No DOI available | Title length: 3 chars | Authors: a, b... | APIs: X enabled"


def test_build(spark, tmp_path):
    from vellum.plans.build import build_feeds

    (tmp_path / "a.bib").write_text("@article{A,\n title = {First title here},\n doi = {10.1/a},\n year = {2020}\n}\n")
    (tmp_path / "b.bib").write_text("@article{B,\n title = {Again},\n doi = {10.1/A}\n}\n@book{C,\n title = {Third title here}\n}\n")
    items = build_feeds(spark, [(f"{tmp_path}/a.bib", "main"), (f"{tmp_path}/b.bib", "inbox")], str(tmp_path / "out"), rss=True)
    assert sorted(r.id for r in items.collect()) == ["bibtex:A", "bibtex:C"]
    text = "".join(p.read_text() for p in sorted((tmp_path / "out/feed.json").glob("part-*")))
    assert len(json.loads(text)["items"]) == 2
