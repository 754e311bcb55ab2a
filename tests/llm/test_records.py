"""Operators on records: survivors, formatting duplicates, names, linkage."""

import datetime as dt
import math

from pyspark.sql import functions as F

from vellum.llm import formatdup, linkage, names, survivor

ENRICHED = "enr_id bigint, key string, abstract string, doi string, doi_url string, url string, arxiv_url string, pdf_url string, publication_date string, citation_count int, reference_count int, venue string, authors array<string>, keywords array<string>, subjects array<string>, is_open_access boolean, source string, confidence_score double, fetched_at timestamp, trust string"
FULL, CUT = "A full abstract of it.", "A full abs…"


def enriched(spark, rows):
    base = {c.split()[0]: None for c in ENRICHED.split(", ")}
    return spark.createDataFrame([tuple({**base, **r}.values()) for r in rows], ENRICHED), spark.createDataFrame([("crossref", "Crossref", 5), ("url", "URL only", 1)], "source string, display_name string, trust int")


def test_leading_rows(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    good = dict(abstract=FULL, confidence_score=0.9, citation_count=0, source=" CrossRef", fetched_at=day(2))
    rows = [
        dict(enr_id=1, key="a", **good), dict(enr_id=2, key="a", abstract=CUT, confidence_score=0.9, citation_count=7, source="url", fetched_at=day(1)),
        dict(enr_id=3, key="b", **good), dict(enr_id=4, key="b", **good),
        dict(enr_id=5, key="c", **good), dict(enr_id=6, key="c", **{**good, "fetched_at": day(3), "confidence_score": 0.8}),
        dict(enr_id=7, key="d", **good), dict(enr_id=8, key=None, **good),
        dict(enr_id=9, key="e", **{**good, "confidence_score": float("nan")}), dict(enr_id=10, key="e", **{**good, "confidence_score": 87.0, "fetched_at": None}),
        dict(enr_id=11, key="f", **{**good, "abstract": "<p>Abstract A full abstract of it.</p>"}), dict(enr_id=12, key="f", **{**good, "citation_count": -1}),
    ]
    e, p = enriched(spark, rows)
    assert {(r.key, r.enr_id) for r in survivor.leading_rows(e, p).collect()} == {("a", 1), ("e", 9), ("f", 11)}
    assert survivor.leading_rows(e.limit(0), p).count() == 0 and survivor.leading_rows(e, p.limit(0)).count() >= 1


def test_abstract_ranks(spark):
    cases = {None: 0, " ": 0, "N/A": 0, "[abstract not available]": 0, "<p></p>": 0, "Text that ends [truncated]": 1, "Text that en": 1, "Text...": 1, "Text ends.": 2, 'He wrote, "no."': 2, "&lt;jats:p&gt;Ends.&lt;/jats:p&gt;": 2, "Abstract": 0}
    df = spark.createDataFrame([(k,) for k in cases], "a string")
    assert {r.a: r.r for r in df.select("a", survivor.abstract_rank(F.col("a")).alias("r")).collect()} == cases


def some_enriched(n, keys):
    import random

    random.seed(4)
    pick = random.choice
    return [
        dict(enr_id=i, key=pick(keys), abstract=pick([FULL, CUT, None]), doi=pick([None, "10.1234/a", "https://doi.example.org/10.1234/B", "10.1234/c"]), url=pick([None, "u"]), arxiv_url=pick([None, "https://arxiv.example.org/abs/2001.00001v2", "https://arxiv.example.org/abs/2001.00002"]), venue=pick([None, "v"]),
             publication_date=pick([None, "2020"]), citation_count=pick([None, 3]), authors=pick([None, ["A"]]), source=pick(["crossref", "url", "?"]), confidence_score=pick([0.2, 0.9, None]), fetched_at=dt.datetime(2024, 1, random.randint(1, 9)))
        for i in range(n)
    ]


def test_survivors_against_brute_force(spark):
    import itertools

    e, p = enriched(spark, some_enriched(60, "vwxyz"))
    chosen = {r.key: r for r in survivor.choose_bundles(e, p).collect()}
    kinds = dict(e.dtypes)
    ranked = survivor.with_respects(e, p).select("key", "enr_id", survivor.doi_key(F.col("doi")).alias("doi"), survivor.arxiv_key(F.col("arxiv_url")).alias("arxiv"), *[survivor._trust(b, kinds).alias(b) for b in survivor.BUNDLES]).collect()
    for key in "vwxyz":
        own = [r for r in ranked if r.key == key]
        agree = lambda rows, c: len({r[c] for r in rows} - {None}) <= 1
        best = max(sum(r[b] for r, b in zip(rows, survivor.BOUND, strict=True)) for rows in itertools.product(own, repeat=len(survivor.BOUND)) if agree(rows, "doi") and agree(rows, "arxiv"))
        assert chosen[key].trust == best + sum(max(r[b] for r in own) for b in survivor.FREE)
        used = [next(r for r in own if r.enr_id == chosen[key][f"{b}_from"]) for b in survivor.BOUND]
        assert agree(used, "doi") and agree(used, "arxiv") and sum(r[b] for r, b in zip(used, survivor.BOUND, strict=True)) == best
    assert survivor.survivors(e, p).count() == 5
    assert survivor.survivors(e.limit(0), p).count() == 0 and survivor.survivors(e, p.limit(0)).count() == 5


def test_branches_are_cut_by_their_bound(spark):
    e, p = enriched(spark, some_enriched(200, "vwxyz"))
    records = survivor.record_branches(survivor.with_respects(e, p))
    assert records.where("cut IS NOT NULL").count() > records.where("cut IS NULL").count() and {r.cut for r in records.select("cut").distinct().collect()} >= {"text", "provenance"}
    day = lambda n: dt.datetime(2024, 1, n)
    rows = [dict(enr_id=1, key="k", doi="10.1234/best", url="u", pdf_url="p", venue="v", publication_date="2020", citation_count=1, reference_count=1, source="crossref", confidence_score=0.9, fetched_at=day(1))]
    rows += [dict(enr_id=10 + i, key="k", doi=f"10.1234/low{i}", url="u", source="url", confidence_score=0.1, fetched_at=day(2)) for i in range(20)]
    rows += [dict(enr_id=50 + i, key="k", doi="10.1234/mixed", arxiv_url=f"https://arxiv.example.org/abs/2001.0000{i}", venue="v", source="crossref", confidence_score=0.95, fetched_at=day(3), **x) for i, x in enumerate([dict(url="u", pdf_url="p"), dict(publication_date="2021"), dict(citation_count=2, reference_count=2)])]
    e, p = enriched(spark, rows)
    ranked = survivor.with_respects(e, p).withColumns({f"t_{b}": survivor._trust(b, dict(e.dtypes)) for b in survivor.BUNDLES})
    nodes = ranked.select("key", survivor.doi_key(F.col("doi")).alias("doi"), survivor.arxiv_key(F.col("arxiv_url")).alias("arxiv"), *[F.struct(F.col(f"t_{b}").alias("v"), F.col("r_fetched").alias("t"), (-F.col("enr_id")).alias("i")).alias(b) for b in survivor.BOUND], sum(F.col(f"t_{b}") for b in survivor.BOUND).alias("whole"))
    branches = survivor.doi_branches(nodes)
    assert branches.count() == 22
    first = survivor.enter(branches.where("first"), nodes)
    assert [r.doi for r in first.collect()] == ["10.1234/mixed"]  # its bound takes bundles of three preprints, which no solution may
    assert [r.doi for r in survivor.open_branches(branches, first).collect()] == ["10.1234/best"]  # twenty are cut
    assert survivor.choose_bundles(e, p).first().identity_from == 1


def test_formatting_duplicates(spark):
    rows = [
        (1, "A Title", ["Doe, Jane", "Roe, R."], "2020", "10.1234/ab"), (2, "a  title!", ["JANE DOE", "R Roe"], "(2020)", "https://doi.example.org/10.1234/AB,"), (3, "A Title", ["Roe, R.", "Doe, Jane"], "2020", "10.1234/ab"), (4, "A Title", ["Doe, Jane", "Roe, R."], "2020", None),
        (5, "A Title", ["Doe, Jane", "Roe, R."], "2020", " "), (6, "Only", [], None, None), (7, "Only", None, None, ""), (8, None, None, None, "10.1/x"), (9, "", [" "], None, "10.1/x"), (10, None, None, None, None), (11, "A Title", ["Doe, Jane", "Roe, R."], "2020", "10.1234/ab"),
    ]
    e = spark.createDataFrame(rows, "ord bigint, title string, authors array<string>, year string, doi string").withColumn("n", F.lit("clash"))
    assert {(r.ord_first, r.ord_copy) for r in formatdup.members(e, e.limit(0)).collect()} == {(1, 2), (1, 11), (4, 5), (8, 9)}
    reps = {r.ord_first: (r.copies, r.spellings) for r in formatdup.representatives(e, e.limit(0)).collect()}
    assert reps[1] == (3, 2) and reps[4] == (2, 2) and 6 not in reps
    hot = e.where("ord = 1").crossJoin(spark.range(3000)).withColumn("ord", F.col("id") + 100).select(*e.columns)
    assert formatdup.members(e, hot).where("ord_first = 1").count() == 3002
    assert formatdup.members(e.limit(0), e.limit(0)).count() == 0


def linked(spark, *values):
    got = names.pairs(names.link(spark.createDataFrame([(v,) for v in values], "name string")))
    return {(r.name_a, r.name_b) for r in got.collect()}


def test_names(spark):
    one = ["Hiroshi Dario Kadomongo", "Kadomongo, Hiroshi Dario", "KADOMONGO, H. D.", "H D  Kadomongo", "Kadomongo HD", "Prof. Dr. Hiroshi Kadomongo", "Hirsohi Kadomongo", " Kadomongo , Hiroshi", "Kadomongo, Hiroshi D"]
    two = ["Victoria Kadomongo", "Kadomongo, Vicky", "V. Kadomongo"]
    three = ["Søren van der Zovavogar", "Zovavogar, Soeren van der", "van der Zovavogar, S.", "Sören van der Zovavogar"]
    org = ["Ruria Institute for Public Hydrology", "The Ruria Institute for Public Hydrology", "Institute for Public Hydrology, Ruria", "RURIA INST. FOR PUBLIC HYDROLOGY", "Ruria Institute for Public Hydrolgoy", "IPH Ruria"]
    other = ["Bruria Institute for Urban Archives", "William Osterberg"]
    rest = [None, "", "  "]
    got = linked(spark, *one, *one[:2] * 3, *two, *three, *org, *other, *rest)
    want = {tuple(sorted((a, b))) for g in (one, two, three, org) for a in g for b in g if a != b}
    assert got == want
    assert linked(spark) == set() and linked(spark, "Solo Name") == set()


def test_short_and_long_names(spark):
    # an error in a short family name counts if the given name tells more than the family does
    crowd = [f"{g} {f}" for g in ("Ada", "Bela", "Cora", "Dina", "Emil") for f in ("Roe", "Lee", "Wu", "Osterberg")]
    got = linked(spark, *crowd, "Quentilla Roe", "Roe, Quentilla", "Quentilla Reo", "Xaveria Lee", "Lee, Xaveria", "Lea, Xaveria", "Tamsinka Wu", "Wu, Tamsinka", "Tamsinka Uw")
    assert {("Quentilla Reo", "Quentilla Roe"), ("Lea, Xaveria", "Lee, Xaveria")} <= got
    many = ["Roe, Jane A. B. C. D.", "Jane Roe", "Roe, J. A. B. C. D.", "Roe, J. A. B. C. X."]
    got = linked(spark, *many)
    assert ("Roe, J. A. B. C. D.", "Roe, Jane A. B. C. D.") in got and ("Roe, J. A. B. C. X.", "Roe, Jane A. B. C. D.") not in got


def test_given_names_of_their_own_stay_apart_at_any_size(spark):
    # marta and maria each stand in many families, both in one of ten; hirsohi only beside hiroshi
    for families in (10, 100):
        fam = [f"{a}{b}voski" for a in ("Kelu", "Domi", "Prafo", "Wizu", "Zegga", "Tomo", "Ruri", "Sabe", "Lomo", "Quifa") for b in ("nar", "tiko", "bel", "sorum", "dag", "vimo", "lukr", "penz", "hoba", "jiss")][:families]
        rows = [f"{g} {f}" for i, f in enumerate(fam) for g in (["Marta", "Maria"] if i % 10 == 0 else ["Marta"] if i % 2 else ["Maria"])]
        rows += [f"{g} {f}" for i, f in enumerate(fam) for g in (["Hiroshi", "Hiroshi ", "Hirsohi"] if i % 5 == 0 else ["Hiroshi"])]
        got = linked(spark, *rows)
        assert not any({a.split()[0], b.split()[0]} == {"Marta", "Maria"} for a, b in got)
        assert sum({a.split()[0], b.split()[0]} == {"Hiroshi", "Hirsohi"} for a, b in got) >= families // 5


def test_names_of_a_hot_family(spark):
    given = [f"{a}{b}{c}" for a in ("Ka", "Lo", "Mi", "Nu", "Pe", "Ru", "Sa", "To", "Vi", "Zo") for b in ("bran", "culo", "dimo", "fert", "gash") for c in ("dor", "lix", "mund", "par")]
    names_ = spark.createDataFrame([(f"{g} Hotfamily",) for g in given] + [(f"Hotfamily, {g[0]}.",) for g in given], "name string")
    got = names.pairs(names.link(names_))
    assert got.where("name_a LIKE 'Hotfamily%'").select("name_a").distinct().count() == 10


def test_similar_tokens_against_brute_force(spark):
    import random

    random.seed(3)
    tokens = sorted({"".join(random.choices("abcde", k=random.randint(2, 8))) for _ in range(400)})
    df = spark.createDataFrame([("f", t) for t in tokens], "kind string, token string")
    pairs = df.select(F.col("token").alias("a")).join(df.select(F.col("token").alias("b"))).where("a < b")
    want = {(r.a, r.b) for r in pairs.where(names.one_error(F.col("a"), F.col("b"))).collect()}
    got = {(r.a, r.b) for r in names.similar_tokens(df).collect()}
    assert got == want and want


def test_linkage(spark):
    t = "Do northern startups need low-cost seed libraries? Mapping the case through notes on parish registers"
    e = [
        (1, t, ["Doe, Jane", "Roe, Richard"], "2020"), (2, t.upper() + ".", ["J. Doe", "R. Roe"], None), (3, t + " (Part I)", ["Doe, Jane"], "2020"), (4, t + " (Part II)", ["Doe, Jane"], "2020"), (5, "Errata", ["Doe, Jane"], "2019"),
        (6, None, ["Doe, Jane"], "2020"), (7, t, ["Doe, Jane", "Roe, Richard"], "2011"), (8, "Something else about rivers, gauges and quiet towns", None, None), (1_000, t, ["Doe, Jane", "Roe, Richard"], "2020"),
    ]
    w = [
        (1, "[Preprint] " + t.replace("startups", "startusp"), ["Jane Doe", "Richard Roe"], "2020-05-01"), (2, t[:40] + "…", ["Richard Roe"], "2021"), (3, t + " (Part II)", ["Jane Doe"], "2020"), (4, "Errata", ["Max Other"], "2003"), (5, None, [], None),
        (6, "Something else about rivers, gauges and quiet towns", [], "1999"),
    ]
    entries = spark.createDataFrame(e, "ord bigint, title string, authors array<string>, year string").withColumn("node", F.lit("clash"))
    works = spark.createDataFrame([(i, x, None, d, [((a,),) for a in au]) for i, x, au, d in w], "work_id bigint, title string, display_name string, publication_date string, authorships array<struct<author:struct<display_name:string>>>")
    got = {(r.ord, r.work_id): r.confidence_score for r in linkage.match_publications(entries, works).collect()}
    assert set(got) == {(1, 1), (2, 1), (1_000, 1), (1, 2), (2, 2), (1_000, 2), (4, 3)} | ({(8, 6)} & set(got)) and all(0 <= s <= 1 for s in got.values())
    assert linkage.match_publications(entries.limit(0), works).count() == 0 and linkage.match_publications(entries, works.limit(0)).count() == 0


def test_linkage_of_a_hot_publication(spark):
    t = "Do northern startups need low-cost seed libraries? Mapping the case through notes on parish registers"
    noise = "Tidal river gauges in {} clinics: an audit of {} field diaries by quiet towns"
    letters = [i for i, c in enumerate(t) if c.isalpha()]
    more = lambda i: t[: letters[i]] + t[letters[i]] + t[letters[i] :]
    less = lambda i: t[: letters[i]] + t[letters[i] + 1 :]
    e = [(i, more(i % 80), ["Doe, Jane", "Roe, Richard" + " X" * (i // 80)], "2020") for i in range(90)] + [(1000 + i, noise.format(i * "x" + "a", i * "y" + "b"), ["Poe, Max"], "2011") for i in range(40)]
    w = [(i, less(i), ["Jane Doe", "Richard Roe"], "2020") for i in range(60)]
    entries = spark.createDataFrame(e, "ord bigint, title string, authors array<string>, year string")
    works = spark.createDataFrame([(i, x, None, d, [((a,),) for a in au]) for i, x, au, d in w], "work_id bigint, title string, display_name string, publication_date string, authorships array<struct<author:struct<display_name:string>>>")
    got = {(r.ord, r.work_id) for r in linkage.match_publications(entries, works).collect()}
    assert got == {(i, j) for i in range(90) for j in range(60)}


def published(spark, e, w):
    entries = spark.createDataFrame(e, "ord bigint, title string, authors array<string>, year string")
    works = spark.createDataFrame([(i, x, None, d, [((a,),) for a in au]) for i, x, au, d in w], "work_id bigint, title string, display_name string, publication_date string, authorships array<struct<author:struct<display_name:string>>>")
    return {(r.ord, r.work_id) for r in linkage.match_publications(entries, works).collect()}


def test_linkage_of_a_long_title_and_its_beginning(spark):
    t = "Small island newsrooms need self organised map tiles: weighing the case through harbour diaries and ledgers"
    many = ["Jane Doe", "Quentin Abelard", "Ruth Bexley", "Tomas Cindrel"]
    noise = "Tidal gauges {} clinics audit {} quiet towns"
    e = [(1, t, many, "2020")] + [(100 + i, noise.format("a" + i * "x", "b" + i * "y"), ["Jane Doe"], "2011") for i in range(20)]
    w = [(1, "Small island newsrooms need self", ["Jane Doe"], "2021")] + [(100 + i, noise.format("c" + i * "z", "d" + i * "v"), ["Jane Doe"], "1990") for i in range(20)]
    assert published(spark, e, w) == {(1, 1)}


def test_linkage_by_a_frequent_run(spark):
    many = ["Jane Doe", "Quentin Abelard", "Ruth Bexley", "Tomas Cindrel"]
    noise = "Tidal gauges {} clinics audit {} quiet towns"
    end = "{} rumours: insights million posts"
    e = [(1, "River gauges among delta choirs, sampling change: insights million posts", many, "2020")] + [(100 + i, noise.format("a" + i * "x", "b" + i * "y"), ["Jane Doe"], "2011") for i in range(20)]
    w = [(1, "Insights million posts", ["Jane Doe"], "2021")] + [(100 + i, noise.format("c" + i * "z", "d" + i * "v"), ["Jane Doe"], "1990") for i in range(20)]
    e += [(200 + i, end.format("k" + i * "q"), ["Max Poe"], "2011") for i in range(7)]
    w += [(200 + i, end.format("m" + i * "j"), ["Ann Loe"], "1990") for i in range(7)]
    assert published(spark, e, w) == {(1, 1)}


def test_weights_by_shuffle_equal_those_sent(spark, monkeypatch):
    titles = ["River gauges among delta choirs and quiet towns", "River gauges among delta choirs", "Tidal field diaries of quiet towns", "Open seed libraries"]
    e = spark.createDataFrame([(i, titles[i % 4], ["Jane Doe", f"Max Poe{'x' * i}"], "2020") for i in range(12)], "id bigint, t string, a array<string>, d string")
    rows = linkage.records(e, "id", F.col("t"), F.col("a"), F.col("d"))
    every = linkage.nodes(rows.where("id < 8").withColumn("side", F.lit("l")).unionByName(rows.where("id > 3").withColumn("side", F.lit("r"))))
    key = lambda df: sorted((x.side, x.node, tuple(x.t), tuple(x.p), round(x.tt, 4), tuple(x.runs), tuple(x.others)) for x in df.collect())
    sent = key(linkage.weigh(every))
    monkeypatch.setattr(linkage, "SENT_WORDS", 0)
    assert key(linkage.weigh(every)) == sent and sent
    assert max(x.n for x in linkage.frequencies(every).collect()) >= 6


def test_neighbourhoods_of_a_long_chain(spark):
    links = [(i, i) for i in range(1, 200)] + [(i + 1, i) for i in range(1, 199)] + [(1000, 1000), (1001, 1000)]
    got = {(x.side, x.n): x.who for x in linkage.neighbourhoods(spark.createDataFrame(links, "l bigint, r bigint")).collect()}
    assert {got["l", i] for i in range(1, 200)} == {1} and {got["r", i] for i in range(1, 200)} == {1} and got["l", 1001] == got["r", 1000] == 1000


def test_propagation_until_stable(spark):
    scored = [
        (1, 1, 0.9, False), (2, 1, 0.66, False),  # only to one neighbourhood: joins
        (3, 3, 0.9, False), (4, 4, 0.9, False), (5, 3, 0.66, False), (5, 4, 0.66, False),  # to two alike: joins neither
        (6, 6, 0.9, False), (7, 6, 0.66, True),  # other people
        (8, 8, 0.9, False), (9, 9, 0.9, False), (8, 9, 0.66, False),  # two that stand by themselves
        (20, 20, 0.9, False), (20, 23, 0.67, False), (22, 20, 0.62, False), (22, 23, 0.4, False),  # one that joins takes another along
    ]
    who = linkage.propagate(spark.createDataFrame(scored, "l bigint, r bigint, conf double, apart boolean"))
    got = {(x.side, x.n): x.who for x in who.collect()}
    assert got["l", 2] == got["r", 1] and ("l", 5) not in got and ("l", 7) not in got and got["l", 8] != got["l", 9]
    assert got["l", 20] == got["r", 20] == got["r", 23] == got["l", 22]


def test_one_wrong_link_brings_no_product(spark):
    a = "Do northern startups need low-cost seed libraries? Mapping the case through notes on parish registers"
    b = "Tidal river gauges in forested clinics: an audit of paired field diaries by quiet towns"
    e = [(i, a, ["Doe, Jane" + " Q" * i], "2020") for i in range(5)] + [(10 + i, b, ["Poe, Max" + " Q" * i], "2020") for i in range(5)] + [(50, a + " " + b, ["Doe, Jane", "Poe, Max"], "2020")]
    w = [(i, a + "!" * i, ["Jane Doe", "Ann" + "x" * i], "2020") for i in range(5)] + [(10 + i, b + "!" * i, ["Max Poe", "Ann" + "x" * i], "2020") for i in range(5)]
    got = published(spark, e, w)
    assert {(i, j) for k in (0, 10) for i in range(k, k + 5) for j in range(k, k + 5)} <= got
    assert not any(i < 50 and (i < 10) != (j < 10) for i, j in got)


def test_words_of_a_pair_are_compared_once(spark):
    kinds = ", ".join(f"{s} bigint, {s}_t array<bigint>, {s}_tt float, {s}_p array<bigint>, {s}_pt float, {s}_year int, {s}_mark string" for s in "lr")
    met = spark.createDataFrame([], kinds)
    near = linkage.confidence(met.where("l < 5").drop("r", *[c for c in met.columns if c[0] == "r"]).join(met.drop(*[c for c in met.columns if c[0] == "l"]), F.col("l") == F.col("r")))
    plan = near.where("conf >= 0.5").select("l", "r", "conf", "apart")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("array_intersect") == 2


def test_meeting_equals_all_pairs_at_any_lot(spark, monkeypatch):
    few, purge = 2, 3
    sizes = [(0, 4), (30, 0), (1, 1), (1, 2), (1, 3), (2, 2), (2, 1), (9, 1), (1, 9), (20, 20), (3, 1)]
    rows = [(997 * (11 * k + i) % 1009, 1000 * i + n, 2 * k + s) for k in (0, 1) for i, x in enumerate(sizes) for s in (0, 1) for n in range(x[s])]
    want, by = set(), {}
    for a, node, tag in rows:
        by.setdefault((a, tag > 1), ([], []))[tag & 1].append(node)
    for (a, run), (l, r) in by.items():
        n = len(l) * len(r)
        if 0 < n <= (few if run else purge):
            want |= {(linkage.PAIR, False, x, y, round(math.log(1e6 / n) + (0 if run else linkage.NAMED), 6)) for x in l for y in r}
            want |= {(linkage.HELD, s, x, x, 0.0) for s, side in enumerate((l, r)) for x in side if run}
        elif n:
            want |= {(linkage.OFTEN, bool(s), x, a, 0.0) for s, side in enumerate((l, r)) for x in side} if run else {(linkage.FAR, False, a, a, 0.0)}
    df = spark.createDataFrame(rows, "a bigint, node bigint, tag tinyint")
    for lot, batch in ((1 << 17, 10_000), (6, 3), (6, 7)):
        monkeypatch.setattr(linkage, "LOT", lot)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            got = linkage._grouped(df, "a", linkage._meeter(few, purge), linkage._MET, parts=True).collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert {(x.kind, x.r, x.x, x.y, round(x.told, 6)) for x in got} == want
        assert sum(x.kind in (linkage.PAIR, linkage.OFTEN) for x in got) == sum(x[0] in (linkage.PAIR, linkage.OFTEN) for x in want)


def test_frequent_runs_are_gathered_by_node(spark):
    known, alien = 7 * linkage.UNIT + 5, 8 * linkage.UNIT + linkage.ALIEN
    tag = lambda kind, right: 2 * kind + right
    rows = [(1, tag(0, 0), 0, [known, alien]), (1, tag(0, 1), 0, [alien]), (1, tag(linkage.OFTEN, 0), 50, None), (1, tag(linkage.OFTEN, 0), 51, None), (1, tag(linkage.OFTEN, 1), 50, None), (1, tag(linkage.HELD, 1), 1, None)]
    rows += [(2, tag(0, 0), 0, [known]), (2, tag(linkage.HELD, 0), 2, None), (3, tag(0, 1), 0, []), (3, tag(linkage.OFTEN, 1), 52, None)]
    df = spark.createDataFrame(rows, "node bigint, tag tinyint, b bigint, p array<bigint>")
    got = {(x.node, x.r): (x.alone, sorted(x.b), x.w) for x in linkage._grouped(df, "node", linkage._gather, linkage._GATHERED).collect()}
    assert got == {(1, False): (True, [50, 51], [known]), (1, True): (False, [50], []), (3, True): (True, [52], [])}
