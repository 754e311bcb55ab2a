import json

import pytest
from pyspark.sql import functions as F

from vellum.functions.files import pdf_reason
from vellum.sources import bibtex, fetch, tables
from vellum.streaming import ingest

BIB = r"""% a comment
% kept http://x.org
@article{Doe2020-aa,
  author = {Doe, Jane and Roe, Richard},
  title = {{Deep \emph{Nets}} for All},
  YEAR = "2020",
  date = {2019-01-01},
  month = sep,
  doi = {https://doi.org/10.1/AbC},
  keywords = {a; b, c}
}
garbage {not a record}
@book{Roe2021,
  booktitle = {Only Book},
  url = {\url{https://a.org/x\_y}}
}
"""


def test_bibtex(spark, tmp_path):
    (tmp_path / "a.bib").write_text(BIB)
    (tmp_path / "b.bib").write_bytes("@misc{M1,\n title = {Caf\xe9},\n}\n".encode("latin-1"))
    rows = bibtex.load(spark, [(f"{tmp_path}/a.bib", "main"), (f"{tmp_path}/none.bib", "x"), (f"{tmp_path}/b.bib", "inbox")]).orderBy("ord").collect()
    a, b, m = rows
    assert (a.key, a.title, a.authors, a.year, a.month, a.doi, a.keywords, a.source) == ("Doe2020-aa", "Deep Nets for All", ["Doe, Jane", "Roe, Richard"], "2020", "09", "10.1/AbC", ["a", "b", "c"], "main")
    assert (b.title, b.url, b.entry_type) == ("Only Book", "https://a.org/x_y", "book") and (m.title, m.source) == ("Café", "inbox")
    e = spark.createDataFrame([r.asDict() for r in rows], bibtex.load(spark, [(f"{tmp_path}/a.bib", "main")]).schema)
    assert bibtex.by_key(e, "M1").count() == 1 and bibtex.by_type(e, "BOOK").count() == 1 and bibtex.with_field(e, "doi").count() == 1
    none = F.lit(None).cast("string")
    text = spark.range(1).select(bibtex.render(F.lit("K"), F.lit("A {b}\nc"), F.array(F.lit("X Y"), F.lit("Z")), F.lit("2020"), none, none, none, F.lit("n")).alias("value"))
    assert text.first()[0] == "@article{K,\n  title = {A \\{b\\} c},\n  author = {X Y and Z},\n  year = {2020},\n  note = {n}\n}\n"
    bibtex.append(text, f"{tmp_path}/out")
    assert spark.read.text(f"{tmp_path}/out").count() > 4


def test_braces_of_any_depth_and_files_of_any_number(spark, tmp_path):
    deep = "{" * 9 + "Deep" + "}" * 9
    (tmp_path / "1.bib").write_text("@misc{A,\n title = {x " + deep + ", y},\n note = {a \"b},\n year = 2020\n}\n@misc{B,\n  title = \"{Q, \"\"} z\"\n  }\n@misc{C, title = {no end}\n")
    (tmp_path / "2.bib").write_text("@misc{D,\n title={{{{{{Six}}}}}}\n}\n@misc{E,\n}\n")
    rows = bibtex.load(spark, [(f"{tmp_path}/*.bib", "g"), (f"{tmp_path}/2.bib", "h")]).orderBy("ord").collect()
    assert [(r.key, r.raw_fields["title"], r.source) for r in rows][:2] == [("A", "x " + deep + ", y", "g"), ("B", '{Q, ""} z', "g")]
    assert [r.key for r in rows] == ["A", "B", "C", "D", "D"] and rows[3].title == "Six" and rows[3].source == "g" and rows[4].source == "h"
    assert len({r.ord for r in rows}) == 5 and rows[0].year == "2020"
    assert bibtex.load(spark, [(f"{tmp_path}/none*.bib", "x")]).count() == 0


def test_large_files_are_split_in_order(spark, tmp_path):
    n = 3_000
    (tmp_path / "big.bib").write_text("".join(f"@article{{k{i},\n  title = {{Title {i}}},\n  abstract = {{{'word ' * 40}}}\n}}\n\n" for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        df = bibtex.load(spark, [(f"{tmp_path}/big.bib", "main")])
        assert df.rdd.getNumPartitions() > 4
        assert [r.key for r in df.orderBy("ord").select("key").collect()] == [f"k{i}" for i in range(n)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_bare_values():
    assert bibtex.bare(' {{ "A  b" }} ') == "A b" and bibtex.bare("{" * 7 + "x" + "}" * 7) == "x" and bibtex.bare('"') == "" and bibtex.bare("{a} b {c}") == "a} b {c"
    assert bibtex.fields("A = {1}, a = {2}, b = , C=3") == {"a": "2", "c": "3"}


def test_fetcher_waits_retries_and_breaks(spark):
    now, slept, calls = [0.0], [], []

    def sleep(s):
        slept.append(round(s, 3))
        now[0] += s

    answers = iter([(429, None), (500, None), (200, "ok"), *[(404, None)] * 9])
    f = fetch.Fetcher(lambda u: (calls.append(u), next(answers))[1], spacing=1.0, jitter=0.0, clock=lambda: now[0], sleep=sleep, breaker=3)
    assert f.get("a") == (200, "ok", 3) and 0.5 in slept and 1.0 in slept
    assert [f.get("b")[0] for _ in range(5)] == [404, 404, 404, 0, 0] and len(calls) == 6
    df = spark.createDataFrame([("k", "u")], "key string, url string")
    assert tuple(fetch.fetch(df, lambda: fetch.Fetcher(lambda u: (200, u * 2))).first()) == ("k", 200, "uu", 1)


def test_tables(spark, tmp_path):
    assert tables.substitute({"a": "${X}/${Y}", "b": [1, "${X}"]}, {"X": "1"}) == {"a": "1/${Y}", "b": [1, "1"]}
    assert tables.load_json(spark, f"{tmp_path}/none", "a INT").count() == 0 and tables.previous_keys(spark, f"{tmp_path}/none") is None
    tables.save_keys(spark.createDataFrame([("b",), ("a",), ("a",)], "key string"), f"{tmp_path}/keys")
    assert [r.key for r in tables.previous_keys(spark, f"{tmp_path}/keys").orderBy("key").collect()] == ["a", "b"]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "a.json").write_text('{"key": "a"}\n{"key": "b"}\n{"ke')
    assert tables.previous_keys(spark, f"{tmp_path}/bad") is None
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "a.json").write_text('{"name": "a"}\n')
    assert tables.previous_keys(spark, f"{tmp_path}/other") is None
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "a.json").write_text("")
    assert tables.previous_keys(spark, f"{tmp_path}/empty").count() == 0
    (tmp_path / "pdfs").mkdir()
    (tmp_path / "pdfs" / "a.pdf").write_bytes(b"%PDF-1" + b"x" * 20_000)
    said = spark.createDataFrame([("a.pdf", "https://x.org/a", 200, "text/html"), ("b.pdf", "https://x.org/b", 404, None)], "name string, url string, status int, content_type string")
    got = tables.read_downloads(spark, f"{tmp_path}/pdfs", said)
    assert {r.url: r.why for r in got.select("url", pdf_reason(F.col("url"), F.col("status"), F.col("content_type"), F.col("content")).alias("why")).collect()} == {"https://x.org/a": "content_type", "https://x.org/b": "http_status"}
    files, stored = spark.createDataFrame([("x",), ("y",)], "name string"), spark.createDataFrame([("x",)], "name string")
    assert {r.name: r.action for r in tables.upload_plan(files, stored).collect()} == {"x": "skip", "y": "create"}


@pytest.mark.parametrize("tag", ["papers"])
def test_stream(spark, tmp_path, tag):
    src = tmp_path / "in"
    src.mkdir()
    pdf = [{"mimetype": "application/pdf", "filetype": "pdf", "url_private_download": "u"}]
    msgs = [{"ts": "1.0", "text": "#papers x"}, {"ts": "2.0", "text": "none"}, {"ts": "3.0", "text": "#papers y", "files": pdf}, {"ts": "4.0", "text": "here", "thread_ts": "1.0", "files": pdf}]
    (src / "a.json").write_text("\n".join(map(json.dumps, msgs)))
    rows = ingest.pending(ingest.threads(ingest.read_messages(spark, str(src)), tag), expire_days=0, settled_days=0).where("outcome = 'added'")
    for _ in range(2):  # the second run finds nothing new
        ingest.write_once(rows, str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination(60)
        got = [(r.ts, r.reply_ts) for r in spark.read.parquet(str(tmp_path / "t")).collect()]
        assert sorted(got, key=str) == [("1.0", "4.0"), ("3.0", None)]
    plain = ingest.routed(ingest.read_messages(spark, str(src)), tag).select("ts", "text")
    for _ in range(2):
        ingest.write_once(plain, str(tmp_path / "u"), str(tmp_path / "d")).awaitTermination(60)
    assert sorted(r.ts for r in spark.read.parquet(str(tmp_path / "u")).collect()) == ["1.0", "3.0"]


def test_pending_state_expires():
    import pandas as pd

    class State:
        """What the step uses of a group state."""

        def __init__(self):
            self.value, self.hasTimedOut, self.timeout = None, False, None

        exists = property(lambda self: self.value is not None)
        get = property(lambda self: self.value)

        def update(self, value):
            self.value = value

        def remove(self):
            self.value = None

        def setTimeoutDuration(self, ms):
            self.timeout = ms

    step, state = ingest._step(1000), State()
    ask = pd.DataFrame({"ts": ["1.0"], "text": ["x"], "has_pdf": [False], "asks": [True], "is_reply": [False]})
    assert pd.concat(step(("1.0",), iter([ask]), state)).outcome.tolist() == ["asked_for_pdf"] and state.timeout == 1000
    assert list(step(("1.0",), iter([ask]), state)) == []
    late = pd.DataFrame({"ts": ["10.5", "9.5"], "text": ["x", "y"], "has_pdf": [True, False], "asks": [False, True], "is_reply": [True, False]})
    fresh = State()
    assert pd.concat(ingest._step(1000, 5000)(("9.5",), iter([late]), fresh)).outcome.tolist() == ["asked_for_pdf", "added"] and fresh.timeout == 5000
    fresh.hasTimedOut = True
    assert list(ingest._step(1000, 5000)(("9.5",), iter([]), fresh)) == [] and not fresh.exists
    state.hasTimedOut = True
    assert pd.concat(step(("1.0",), iter([]), state)).outcome.tolist() == ["expired"] and not state.exists


def test_outputs_of_a_batch_are_written_once(spark, tmp_path):
    paper = "struct<doi:string,title:string,authors:array<string>,year:string,url:string,abstract:string,arxiv_id:string,source:string>"
    rows = [("1700000000.5", "x", "added", None), ("1700000001.5", "y", "added", None), ("1700900000.5", "z", "expired", None)]
    batch = spark.createDataFrame(rows, "ts string, text string, outcome string, reply_ts string")
    dois = {"x": "10.1234/new", "y": "10.1234/OLD", "z": None}
    lookup = F.create_map(*[F.lit(v) for kv in dois.items() for v in kv])
    resolve = lambda b: b.withColumn("paper", F.struct(F.try_element_at(lookup, F.col("text")).alias("doi"), F.lit("A title").alias("title"), F.array(F.lit("Jane Doe")).alias("authors"), F.lit("2020").alias("year"), *[F.lit(None).cast("string").alias(c) for c in ("url", "abstract", "arxiv_id", "source")]).cast(paper))
    inbox = spark.createDataFrame([("k", "10.1234/old")], "key string, doi string")
    out = str(tmp_path / "out")
    for _ in range(2):
        ingest.finalise(batch, out, resolve, inbox, "C1")
    got = {r.ts: r.value for r in spark.read.schema("ts string, value string").parquet(f"{out}/ledger").collect()}
    assert got["1700000001.5"] == "(duplicate)" and got["1700900000.5"] == "(expired)" and got["1700000000.5"].startswith("Doe2020-sl") and len(got) == 3
    text = spark.read.parquet(f"{out}/inbox").collect()
    assert len(text) == 1 and "10.1234/new" in text[0].value and text[0].key == got["1700000000.5"]
    assert sorted(r.text for r in spark.read.parquet(f"{out}/outbox").collect()) == ["Added: A title", "Already there: A title", "No PDF came for A title"]
