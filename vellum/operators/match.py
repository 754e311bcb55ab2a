"""Best match of records among candidates, and providers in order of preference."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.similarity import listed, named, names_similarity, similarity, word_set
from vellum.functions.text import search_title
from vellum.session import stored

#: Least score of a match and of its acceptance, by provider; whether the match gate itself passes. Fixed values.
GATES = {"crossref": (0.7, 0.75, False), "openalex": (0.7, 0.7, True), "semantic_scholar": (0.6, 0.7, False), "arxiv": (0.6, 0.0, False)}


def accepted(provider: str, score: Column) -> Column:
    """Whether a provider's score passes both gates."""
    least, accept, inclusive = GATES[provider]
    return ((score >= least) if inclusive else (score > least)) & (score > accept)


#: Names that share one word of two each are similar to this at most, with the bonus where one holds the other.
ONE_WORD = 1 / 3 + 0.2
#: Words of the sets that titles meet on, tokens of the runs that a held title meets its holders on, and the size beyond which titles meet on single words.
SET, RUN, LONG = 3, 4, 48
#: Pairs of rows beyond which what names share is met together with a word of the title, and the words up to which their table is sent to all tasks. Results don't depend on either.
HOT, SENT = 100_000, 500_000


def _hashes(c: Column) -> Column:
    """Numbers of the words of a text."""
    return F.transform(word_set(c), lambda w: F.xxhash64(w))


def _ranked(texts: DataFrame) -> DataFrame:
    """id, text, in_q, in_c, words, n, gone, bits, r, short, at: hashes of the words of each title, those that both sides have, r, by how many pairs share them.

    n counts all words, gone those of one side only, which stand before all others in the order; bits has a bit for each word. at is the place of the rarest
    word within the title's ends, and short are titles without a word there; at is missing where the other side lacks a word that is within.
    """
    words = lambda t: t.select("id", "in_q", "in_c", F.explode("words").alias("w"))
    pairs = stored(words(texts).groupBy("w").agg((F.count_if("in_q").cast("double") * F.count_if("in_c")).alias("pairs")))
    bit = F.expr("shiftleft(1L, CAST(pmod(w, 64) AS int))")
    of = words(texts).select("id", "w").join(F.broadcast(pairs) if pairs.count() <= SENT else pairs, "w").groupBy("id").agg(
        F.count("*").cast("int").alias("n"), F.count_if(F.col("pairs") == 0).cast("int").alias("gone"), F.bit_or(bit).alias("bits"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("pairs") > 0, F.struct("pairs", "w")))), lambda x: x["w"]).alias("r"), F.collect_list(F.when(F.col("pairs") == 0, F.col("w"))).alias("lone"),
    )
    rows = of.join(texts, "id").withColumn("inner", _inner(F.col("text")))
    rows = rows.withColumns({"rarest": F.get(F.array_intersect("r", "inner"), F.lit(0)), "lacks": F.arrays_overlap("inner", "lone")})
    short = (F.size("inner") < 2) | (F.col("rarest").isNull() & ~F.col("lacks"))
    at = F.when(~short & ~F.col("lacks"), F.array_position("inner", F.col("rarest")).cast("int"))
    return stored(rows.select("id", "text", "in_q", "in_c", "words", "n", "gone", "bits", "r", short.alias("short"), at.alias("at")), pairs, texts)


def _inner(text: Column) -> Column:
    """Hashes of the words within a title's ends, in their order."""
    tokens = F.split(text, " ")
    return F.transform(F.slice(tokens, 2, F.greatest(F.size(tokens) - 2, F.lit(0))), lambda w: F.xxhash64(w))


def _sets(rows: DataFrame, size: int, kind: int) -> DataFrame:
    """s, and the columns of rows but p: each set of so many of the words p, as a number."""
    keep = [c for c in rows.columns if c != "p"]
    out = rows.where(F.size("p") >= size).select(*keep, F.posexplode("p").alias("_i", "_w1"), "p")
    for k in range(2, size + 1):
        words = [f"_w{i}" for i in range(1, k)]
        rest = out.select(*keep, *words, F.col("_i").alias("_h"), "p", F.posexplode(F.slice("p", F.col("_i") + 2, F.size("p"))).alias("_j", f"_w{k}"))
        out = rest.select(*keep, *words, f"_w{k}", (F.col("_h") + F.col("_j") + 1).alias("_i"), "p")
    of = [F.col("d")] if "d" in keep else []
    return out.select(F.xxhash64(F.lit(kind), *of, *[f"_w{i}" for i in range(1, size + 1)]).alias("s"), *keep)


def _must(share: float) -> Column:
    """Words that a title shares at least with another one that has that share of all their words in common."""
    return F.greatest(F.ceil(F.lit(share) * F.col("n") - 1e-9), F.lit(1))


def _rarest(shared: Column, k: int) -> Column:
    """The rarest words of a title, of which any that shares so many has k."""
    return F.slice("r", 1, F.greatest(F.least(F.col("n") - shared + k, F.col("n")) - F.col("gone"), F.lit(0)).cast("int"))


def _signatures(ranked: DataFrame, need: float, wide: float, side: int) -> DataFrame:
    """s, id, n, bits, near: what a title of one side meets those of the other side by.

    Two titles that must share so many words have as many of their rarest in common, so they meet on sets of ``SET`` words; only where fewer
    may do for both they meet on smaller sets, and long titles on single words.
    A title within another one has all of its inner words there, in their order, and meets it on one run of ``RUN`` of them, or all if it has fewer; one
    without a word to do so is short, as is what holds it, and they meet on words. A title that is held meets only those that may hold it (d: which side's is held).
    """
    at_least = lambda share, k: F.greatest(_must(share), F.lit(k))
    own = ("id", "n", "bits")
    near = [_sets(ranked.where((_must(need) <= k) & (F.col("n") >= k)).select(*own, _rarest(at_least(need, k), k).alias("p")), k, k) for k in range(1, SET)]
    near += [_sets(ranked.where(F.col("n").between(SET, LONG)).select(*own, _rarest(at_least(need, SET), SET).alias("p")), SET, SET)]
    near += [_sets(ranked.where(F.col("n") > need * LONG - 1e-9).select(*own, _rarest(_must(need), 1).alias("p")), 1, 9)]
    role = lambda held, holds: F.explode(F.array_compact(F.array(F.when(held, side), F.when(holds, 1 - side)))).alias("d")
    words = ranked.where(F.col("short") | (wide * F.col("n") <= 3 + 1e-9)).select("*", role(F.col("short"), wide * F.col("n") <= 3 + 1e-9))
    held = [_sets(words.select(*own, "d", _rarest(at_least(wide, 2), 2).alias("p")), 2, 15), _sets(words.where(_must(wide) < 2).select(*own, "d", F.col("r").alias("p")), 1, 16)]
    run = lambda k, d, i: F.xxhash64(F.lit(20 + k), F.lit(d), *[F.get("inner", i + j) for j in range(k)])
    no = F.array().cast("array<bigint>")
    for k in range(2, RUN + 1):
        some = ranked if k == RUN else ranked.where(F.col("n") <= (k + 2) / wide + 1e-9)
        within = some.select(*own, "short", "at", _inner(F.col("text")).alias("inner")).withColumn("last", F.size("inner") - k + 1).where(F.col("last") >= 1)
        mine = F.when(F.col("at").isNotNull() & ~F.col("short") & (F.lit(k == RUN) | (F.col("last") == 1)), F.array(run(k, side, F.least("at", "last") - 1)))
        theirs = F.transform(F.slice("inner", 1, F.col("last")), lambda _, i: run(k, 1 - side, i))  # noqa: B023
        held += [within.select(F.explode(F.concat(F.coalesce(mine, no), theirs)).alias("s"), *own)]
    parts = [df.select("s", *own, F.lit(True).alias("near")) for df in near] + [df.select("s", *own, F.lit(False).alias("near")) for df in held]
    return reduce(DataFrame.unionByName, parts)


def _like(need: float, wide: float) -> tuple[Column, Column]:
    """Whether titles may have the share ``need`` of their words in common, and whether one may hold the other and they the share ``wide``.

    Bits only bound from below what the titles differ by; of a title that is held, only the words at its ends may be missing in the other.
    """
    both, q, c = F.col("q_n") + F.col("c_n"), F.col("q_bits"), F.col("c_bits")
    differ = F.bit_count(q.bitwiseXOR(c))
    of = lambda share: (differ <= both * ((1 - share) / (1 + share)) + 1e-9) & (F.least("q_n", "c_n") >= share * F.greatest("q_n", "c_n") - 1e-9)
    return of(need), of(wide) & (F.least(F.bit_count(q.bitwiseAND(F.bitwise_not(c))), F.bit_count(c.bitwiseAND(F.bitwise_not(q)))) <= 2)


def _met(q: DataFrame, c: DataFrame, like: Column) -> DataFrame:
    """q, c: numbers of different titles of the two sides that have a signature in common and are alike; each pair once."""
    named = lambda df, side: df.select("s", *[F.col(x).alias(f"{side}_{x}") for x in df.columns if x != "s"])
    met = named(q, "q").join(named(c, "c"), "s").where(like & (F.col("q_id") != F.col("c_id")))
    return met.select(F.col("q_id").alias("q"), F.col("c_id").alias("c")).distinct()


def _by_title(ranked: DataFrame, need: float, wide: float) -> DataFrame:
    """q, c: titles so similar by themselves that any shared word of names may do."""
    near, held = _like(need, wide)
    return _met(_signatures(ranked.where("in_q"), need, wide, 0), _signatures(ranked.where("in_c"), need, wide, 1), F.when(F.col("q_near"), near & F.col("c_near")).otherwise(held & ~F.col("c_near")))


def _name_signatures(names: Column, side: int) -> Column:
    """What names meet those of the other side by, to be more similar than ``ONE_WORD``.

    They share two words; or one of them is a single word (by which side's it is), and the other has two at most.
    """
    pairs = lambda w: F.flatten(F.transform(w, lambda x: F.transform(F.filter(w, lambda y: y > x), lambda y: F.xxhash64(F.lit(2), x, y))))
    alone = lambda w, d: F.transform(w, lambda x: F.xxhash64(F.lit(1), F.lit(d), x))
    each = lambda w: F.when(F.size(w) == 1, F.concat(alone(w, side), alone(w, 1 - side))).when(F.size(w) == 2, F.concat(pairs(w), alone(w, 1 - side))).otherwise(pairs(w))
    return F.array_distinct(F.flatten(F.transform(names, lambda x: each(x["w"]))))


def _by_names(q: DataFrame, c: DataFrame, need: float, wide: float) -> DataFrame:
    """q, c: titles that may be similar enough beside names that are more similar than ``ONE_WORD``. Frequent names meet with one of the rarest words of the title."""
    both = reduce(DataFrame.unionByName, [df.select(F.explode("by").alias("s"), F.lit(k).alias("k")) for k, df in enumerate((q, c))])
    hot = stored(both.groupBy("s").agg((F.count_if(F.col("k") == 0).cast("double") * F.count_if(F.col("k") == 1)).alias("pairs")).where(F.col("pairs") > HOT).select("s", F.lit(True).alias("hot")))
    sides = []
    for df in (q, c):
        rows = df.select(F.explode("by").alias("s"), "id", "n", "bits", "rare").join(F.broadcast(hot), "s", "left")
        sides.append(rows.select(F.explode(F.when(F.col("hot"), F.transform("rare", lambda w: F.xxhash64(F.lit(3), F.col("s"), w))).otherwise(F.array("s"))).alias("s"), "id", "n", "bits"))
    near, held = _like(need, wide)
    return stored(_met(*sides, near | held), hot)


def best_match(queries: DataFrame, candidates: DataFrame, gate: float = 0.7, inclusive: bool = False, boost: bool = False, title: str = "title") -> DataFrame:
    """qid, cid, score: each query's best candidate by title and authors, ties to the first candidate by ``pos``.

    queries: qid, title, authors (joined by " and " or NULL); candidates: cid, pos, title, authors (array), score (NULL).
    The gate bounds the similarity that titles must have, and more where names are less alike: names of one common word leave only titles that are
    close to equal, which meet by their rarest words; others meet by what their names share. Every pair that can pass is found without comparing all;
    nothing is capped. Rows of equal title and authors are one, titles are compared once for all rows that have them, and words are ranked once.
    """
    most = 0.1 if boost else 0.0
    need = max((gate - 0.3 - most) / 0.7, 0.01)
    wide = max(need - 0.2, 0.01)  # a title that holds the other has a bonus
    alone = max((gate - 0.3 * ONE_WORD - most) / 0.7 - 1e-8, need)
    lower = F.lower(search_title(F.col(title)))
    q = stored(queries.select("qid", lower.alias("text"), F.col("authors").alias("_qa")).groupBy("text", "_qa").agg(F.collect_list("qid").alias("qids")))
    c = stored(candidates.select("cid", "pos", lower.alias("text"), F.col("authors").alias("_ca"), F.col("score").alias("_s")).groupBy("text", "_ca", "_s").agg(F.max(F.struct((-F.col("pos")).alias("p"), "cid")).alias("_c")))
    each = q.select("text", F.lit(True).alias("in_q")).unionByName(c.select("text", F.lit(False).alias("in_q")))
    texts = each.groupBy("text").agg(F.max("in_q").alias("in_q"), (~F.min("in_q")).alias("in_c")).withColumns({"id": F.monotonically_increasing_id(), "words": _hashes(F.col("text"))})
    ranked = _ranked(stored(texts))
    found = [stored(_by_title(ranked, alone, max(alone - 0.2, 0.01)))] if alone <= 1 else []
    at = ranked.select("text", "id", "n", "bits", _rarest(_must(wide), 1).alias("rare"))
    rows = lambda df, k, names, *own: stored(df.join(at, "text").withColumn("names", named(names)).select("id", "n", "bits", "rare", "names", _name_signatures(F.col("names"), k).alias("by"), *own), df)
    q = rows(q, 0, listed(F.col("_qa")), "qids", F.monotonically_increasing_id().alias("g"))
    c = rows(c, 1, F.col("_ca"), "_c", "_s")
    found.append(_by_names(q, c, need, wide))
    met = reduce(DataFrame.unionByName, found).distinct()
    text = lambda k: ranked.select(F.col("id").alias(k), F.col("text").alias(f"{k}_text"), F.col("words").alias(f"{k}_words"))
    # titles decide first; authors are compared only where they can still lift a pair over the gate
    titled = met.join(text("q"), "q").join(text("c"), "c").select("q", "c", similarity(*map(F.col, ("q_text", "c_text", "q_words", "c_words"))).alias("_ts")).where(0.7 * F.col("_ts") + 0.3 + most + 1e-9 > gate)
    same = ranked.where("in_q AND in_c").select(F.col("id").alias("q"), F.col("id").alias("c"), F.lit(1.0).alias("_ts"))
    titled = stored(titled.unionByName(same), ranked, *found)
    extra = F.least(F.coalesce("_s", F.lit(0.0)) / 100, F.lit(0.1)) if boost else F.lit(0.0)
    joined = titled.join(c.select(F.col("id").alias("c"), "_c", extra.alias("_x"), F.col("names").alias("_cn")), "c").join(q.select(F.col("id").alias("q"), "g", "qids", F.col("names").alias("_qn")), "q")
    # names that share no word are similar to 0.2 at most, where one holds the other
    names = F.when(F.arrays_overlap(F.flatten("_qn.w"), F.flatten("_cn.w")), 0.3).otherwise(0.06)
    near = joined.where(0.7 * F.col("_ts") + names + F.col("_x") + 1e-9 > gate)
    score = 0.7 * F.col("_ts") + 0.3 * names_similarity(F.col("_qn"), F.col("_cn")) + F.col("_x")
    scored = near.select("g", "qids", "_c", F.round(score, 9).alias("score"))
    scored = scored.where(F.col("score") >= gate if inclusive else F.col("score") > gate)
    top = scored.groupBy("g").agg(F.max(F.struct("score", "_c")).alias("m"), F.any_value("qids").alias("qids"))
    return top.select(F.explode("qids").alias("qid"), F.col("m._c.cid").alias("cid"), F.col("m.score").alias("score"))


def first_provider(results: list[tuple[str, DataFrame]], key: str = "key") -> DataFrame:
    """One row per key from several providers, the earliest of the list that has one."""
    every = None
    for rank, (name, df) in enumerate(results):
        part = df.withColumns({"_rank": F.lit(rank), "provider": F.lit(name)})
        every = part if every is None else every.unionByName(part, allowMissingColumns=True)
    cols = [c for c in every.columns if c not in (key, "_rank")]
    best = every.groupBy(key).agg(F.min(F.struct("_rank", *cols)).alias("b"))
    return best.select(key, *[F.col(f"b.{c}").alias(c) for c in cols])


def is_preprint(journal: Column, doi: Column, url: Column, raw: Column) -> Column:
    """Whether a record is a preprint, from its journal, links and typed fields."""
    has = lambda c: F.coalesce(F.lower(c).contains("arxiv"), F.lit(False))
    fields = F.transform_keys(raw, lambda k, v: F.lower(k))
    named = F.exists(F.array(*map(F.lit, ("archiveprefix", "eprint", "primaryclass"))), lambda k: has(F.try_element_at(fields, k)))
    number = F.coalesce(F.try_element_at(fields, F.lit("eprint")).rlike(r"^(\d{4}\.\d{4,5}|[a-z-]+/\d{7})$"), F.lit(False))
    return has(journal) | has(doi) | has(url) | F.coalesce(named, F.lit(False)) | number
