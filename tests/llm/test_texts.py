"""Operators on texts: encoding, leaks, sentences, look-alikes."""

import pytest
from pyspark.sql import functions as F

from vellum.llm import leakage, lookalike, sentences, tokenize

DOCS = "doc_id bigint, text string, lang string, ids string, words string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "clash", "clash") for i, t in enumerate(texts)], DOCS)


TEXTS = [None, "", " ", "Hello  world's <|endoftext|>\n\n x", "日本語のテキスト。" * 40, "a" * 5_000, " " * 3_000 + "x", "naïve ﬁ 👍🏽 ​﻿", "Привет, мир", "Hello  world's <|endoftext|>\n\n x"]


def test_encoding_equals_the_tokenizer(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(tokenize.default_path())
    t.encode_special_tokens = True
    got = {r.doc_id: r.ids for r in tokenize.encode(docs(spark, TEXTS)).collect()}
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(TEXTS)}
    assert "".join(t.decode([i]) for i in got[8]) or t.decode(got[8]) == TEXTS[8]
    assert tokenize.encode(docs(spark, TEXTS).limit(0)).count() == 0


ITEM = "Which one fits best? The brittle kiln against the tunnel reluctantly polished one lighthouse, but the ferryman weighed that kiln until the minor locksmith."
ITEMS = [(1, ITEM), (2, "Which one fits best? Another text about small gardens and their many stubborn owners who never water the plants at night."), (3, "Which one fits best? A third."), (4, "昏暗的木桥很少避开一个昏暗的钟楼，于冬天山羊又很少遮住一个倾斜的山羊和另一个灯笼。"), (5, None), (6, "")]


def leaked(spark, texts, items=ITEMS):
    rows = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id bigint, text string, doc_id string")
    return {(r.doc_id, r.item_id) for r in leakage.find(docs(spark, texts), rows).collect()}


def test_leaks(spark):
    body = ITEM.split("? ", 1)[1]
    texts = [
        "before " + body + " after", body.upper().replace(",", " "), "x " + " ".join(body.split()[3:13]), "x " + " ".join(body.split()[3:9]) + " y", "Which one fits best? Yes.",
        body.replace("kiln", r"\emph{kiln}").replace(" ", " "), body.replace("tunnel", "canal").replace("weighed", "lifted"), ITEMS[3][1].replace("，", "、\n"), ITEMS[3][1][:14], None, "", "The " * 20_000 + body,
    ]
    assert leaked(spark, texts) == {(0, 1), (1, 1), (2, 1), (5, 1), (6, 1), (7, 4), (11, 1)}
    assert leaked(spark, texts, []) == set() and leaked(spark, []) == set()


def test_leaks_do_not_depend_on_blocks(spark, monkeypatch):
    body = ITEM.split("? ", 1)[1].split()
    near = [" ".join(w if i % 5 else w + "x" for i, w in enumerate(body)), " ".join(body[:8] + ["other", "words", "stand", "here"])]
    items = [*ITEMS, (7, "Short one"), (8, "Which one fits best? " + " ".join(body[4:16]) + " and then an end of its own with many a word."), *((20 + i, f"Which one fits best? Item {i} about {'abcdefgh'[i] * 5} and {'stuvwxyz'[i] * 6} stays alone.") for i in range(8))]
    texts = ["before " + ITEM + " after", near[0], near[1], "Which one fits best? Yes.", "a short one here", ITEMS[3][1], "Which one fits best? " + " ".join(body[3:15]), "Item 3 about ddddd and vvvvvv stays alone."]
    seen = []
    for block, chars in ((5_000, 10**6), (2, 10**6), (1, 10**6), (5_000, 200), (5_000, 1)):
        monkeypatch.setattr(leakage, "BLOCK", block)
        monkeypatch.setattr(leakage, "BLOCK_CHARS", chars)
        seen.append(leaked(spark, texts, items))
    assert seen[0] and all(s == seen[0] for s in seen) and not any(d == 3 for d, _ in seen[0])


def test_wu_manber_finds_every_occurrence():
    import random

    random.seed(1)
    for _ in range(30):
        patterns = {"".join(random.choices("ab ", k=random.randint(4, 9))): [(0, 0)] for _ in range(12)}
        text = "".join(random.choices("ab ", k=400))
        want = sorted(i for i in range(len(text)) for p in patterns if text.startswith(p, i))
        assert sorted(at for at, _ in leakage.WuManber(patterns).search(text)) == want


def cut(text):
    out, at = [], 0
    for e in sentences.sentence_ends(text):
        out.append(text[at:e].strip())
        at = e
    return out


@pytest.mark.parametrize("want", [
    ["Dr. Kesh v. Orr Ltd. is cited.", "See Fig. 2 and Eq. 5, e.g. p. 3.", "It rose to 4.5 etc.", "Then it fell?!"],
    ["“No. Not now,” she said.", "Well ... perhaps.", "(See Table 3.)", "At 3:15 a.m. it ended."],
    ["He said 'it failed.'", "doi:10.1/x.y points to it.", "iPads, too."],
    ["Sie schrieb: „Das genügt nicht.“", "Am 3. Mai 2014 kam z. B. Fr. Dr. Tosk.", "Nr. 2 fehlt usw.", "Ende."],
    ["Elle écrit : « Rien ne change. »", "« Est-il stable ? » demanda la relectrice.", "M. Tosk et Mme Bruvane citent p. ex. cela."],
    ["«Почему?» — спросил рецензент.", "Учтены повторы и др.", "В 2014 г. проф. Kesh описал это."],
    ["编辑写道：“我们不能发表。”", "“数据不够！”她说，“太多了。”", "版本v1.2.0包含等……但稳定。"],
    ["「もう十分だ！次に進もう。」と彼女は言った。", "Ver. 5.4では安定。"],
    ["كتب د. Kesh: «هل كان ناقصا؟»", "كيف نفسر؟"],
    ["औसत 1.15 से 10.15 तक बढ़ा।", "डॉ. Kesh ने पूछा, \"क्या?\"", "सूची स्थिर रहा।"],
    ["ค่าเฉลี่ย3.23เป็น10.23", "ผลการศึกษา"],
    ["Heading", "One.", "Two\nlines."],
])
def test_sentences(want):
    sep = "" if any("぀" <= c <= "鿿" for c in want[0]) else " "
    text = want[0] + "\r\n \r\n" + " ".join(want[1:]) if want[0] == "Heading" else sep.join(want)
    assert cut(text) == want


@pytest.mark.parametrize("frame, inner", [
    ("He said “{}” and left. Then more came.", "It was late. "), ('He said "{}" and left. Then more came.', "It was late. "), ("Sie schrieb: „{}“ und ging. Dann kam mehr.", "Es war spät. "), ("Er schrieb: »{}« und ging. Dann kam mehr.", "Es war spät. "),
    ("Elle écrit : « {} » puis elle part. Rien ne change.", "Rien ne reste. "), ("「{}」と彼女は言った。次に進もう。", "もう遅い。"), ("“{}”她说，然后走了。数据不够。", "太晚了。"), ("A note (see below. {}) stands here. Then more came.", "It was late. "),
])
@pytest.mark.parametrize("n", [1, 2, 5, 6, 7, 40, 100])
def test_a_quotation_is_never_torn(frame, inner, n):
    text = frame.format((inner * n).strip())
    ends = sentences.sentence_ends(text)
    assert len(ends) == 2 and ends[-1] == len(text)


def test_marks_that_are_not_closed_bind_nothing():
    many = "One more came. " * 30
    assert len(cut('A 5" pipe broke. ' + many)) == 31
    assert len(cut("It broke :( again. " + many + "It holds :) now.")) == 32
    assert len(cut("“It was late. " + many)) == 31
    assert len(cut('He said "so. ' + many + 'He said "yes." Then more came.')) == 33
    assert cut("He said no. The cat left. See no. 3 of it.") == ["He said no.", "The cat left.", "See no. 3 of it."]


def test_spans_against_all_starts():
    """The running best gives the same total as scoring every pair of places."""
    import random

    random.seed(5)
    bits = ["It was. ", "a. ", "1. ", "“No. Yes.” ", "(x. y.) ", "... ", "! ", "Dr. X. ", '"Go. On." ', "„Ja. Nein.“ "]
    for _ in range(40):
        text = "".join(random.choices(bits, k=25)).strip()
        ends = sentences.piece_ends(text)
        at, starts, score, within, cost = sentences._places(text)
        span = lambda i, j: score[j] + sentences._fits(text, starts[i], at[j]) - (0.0 if within[i] == within[j] else cost[i] + cost[j])
        best = [0.0]
        for j in range(1, len(at)):
            best.append(max(best[i] + span(i, j) for i in range(j)))
        path = [0, *(at.index(e, 1) for e in ends)]
        assert abs(sum(span(i, j) for i, j in zip(path, path[1:], strict=False)) - best[-1]) < 1e-9 and ends[-1] == len(text)
        assert not any(a < e < b for e in ends for a, b in sentences._quotations(text)[0])


def test_sentence_cases(spark):
    long = "One two three. " * 20_000
    got = sentences.split(docs(spark, [None, " \n\t", "x", "no end", long, '"never closed. Not here. No']))
    n = {r.doc_id: r.n for r in got.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert n == {2: 1, 3: 1, 4: 20_000, 5: n[5]} and n[5] >= 1
    assert {r.end_pos for r in got.where("doc_id = 3").collect()} == {6}
    assert sentences.split(docs(spark, ["a"]).limit(0)).count() == 0


def test_look_alikes(spark):
    e = [(1, "Search logs in ports"), (2, "Seаrch logs in pοrts"), (3, "search  LOGS, in ports!"), (4, "Search logs in ports"), (5, "Séarch logs in ports"), (6, "Séarch logs in ports"), (7, "x² y"), (8, "x2 y"), (9, "Straße"), (10, "Strasse"), (11, None), (12, " "), (13, "Ｓｅａｒｃｈ logs in ports"), (14, "Seаrch logs in pοrts"), (15, "​"), (16, "A low-cost kiln"), (17, "A low‑cost kiln"), (18, "A low cost kiln"), (19, "a low‐cost KILN"), (20, "A ﬁne kiln"), (21, "a fine kiln")]
    rows = spark.createDataFrame(e, "ord bigint, title string").withColumn("plain", F.lit("clash"))
    t = lookalike.titles(rows, rows.limit(0))
    pairs = {(r.ord_a, r.ord_b) for r in lookalike.look_alike_pairs(t).collect()}
    same, plain = {1: "a", 3: "a", 2: "b", 14: "b", 4: "c", 13: "d"}, None
    del plain
    want = {(i, j) for i in same for j in same if i < j and same[i] != same[j]} | {(5, 6), (16, 17), (16, 19), (17, 19), (20, 21)}
    assert pairs == want
    canon = {r.ord: r.canonical for r in lookalike.canonical_titles(t).collect()}
    assert len(canon) == 21 and canon[11] is None and canon[12] is None and canon[15] is None
    assert len({canon[i] for i in same}) == 1 and canon[5] == canon[6] != canon[1] and canon[7] != canon[8] and canon[9] != canon[10]
