"""Variant spellings of names typed by people, linked to the person or organisation they name.

Distinct strings are read into a family part and given parts (organisations: one part with its words in a standard
order), without case, accents, titles and order. The distinct parts are joined with each other by a
prefix-filtered set-similarity join on positional q-grams: the rarest grams of a token must hold a common one if the
tokens differ by one typing error, so only those are joined. Names whose parts meet this way are verified by
soft weighted token similarity, in which a token weighs by its rarity: a family name that differs can't be made up for
by a frequent given name, an initial or a nickname counts nearly as its name, and two different given names
speak against each other. Each variant points to its best-attested form, pointers are followed to their
end, and the strings of one end are linked. Everything is joins and aggregates over distinct forms, so
a name that is repeated in a third of all rows is a single row.

Defined cases: NULL, empty and blank names are no names; repeated strings count once; a string without a given name
links only with strings of the same form; extra columns are ignored; empty tables give no pairs.
An initial that fits several persons of a family goes to the best-attested of them.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, stored

#: Grams of a token that must hold a common one, for one error (a swap of neighbours changes up to Q + 1 grams).
Q, PREFIX = 3, 5
#: Least soft weighted similarity of two forms of one name.
SIMILAR = 0.82
#: Part of the families of the rarer of two given names in which the other must be found too: an error stands beside
#: the name it was meant to be, a name of its own mostly without it. It is a share, so it holds at any size.
BESIDE = 0.5

#: Given names that stand for each other; the first of a line is the full one. Fixed values, common knowledge.
NICKNAMES = """
alexander sasha alex sandy xander alec
andrew andy drew
anthony tony
benjamin ben benny benji
catherine katherine kate kathy katie cathy kat kitty
charles charlie chuck
charlotte lottie charlie lotte
christopher chris kit
daniel dan danny
daniela dani
david dave
dmitri dima mitya
edward ed eddie ted ned
ekaterina katya katja
elizabeth liz beth betty lizzie eliza lisa libby
francisco paco pancho kiko
frederick fred fritz freddie
giuseppe beppe peppe pino
gwendolyn gwen wendy
henry harry hank
ignacio nacho
isabella bella isa izzy
james jim jimmy jamie
johannes hans johann jan
john jack johnny
jonathan jon
joseph joe joey
josephine josie jo fifi
leonardo leo nardo
margaret peggy maggie meg greta marge
michael mike mick micky
nathaniel nat nate nathan
nicholas nick nicky
oliver ollie olly
patricia pat patty trish
penelope penny
peter pete
philip phil
quentin quent
rebecca becky
richard dick rick rich ricky
robert bob rob bobby robbie bert
ruben rube
samantha sam sammie
samuel sam sammy
stephen steve
susan sue susie
theodora dora thea theo
theodore ted theo
thomas tom tommy
timothy tim
umberto berto
victoria vicky vicki tori
wiktor witek
william bill will billy liam
zachary zack zach zac
"""
#: Words that belong to a family name without telling it, titles, and what follows a name. Fixed values.
PARTICLES = frozenset("van von der den de la le da di do du dos das del della des el al ter ten zu zum zur y e af av".split())
TITLES = frozenset("prof professor dr mr mrs ms miss sir dame rev hon phd md msc ma ba ing dipl herr frau mme mlle sra srta".split())
SUFFIXES = frozenset("jr sr ii iii iv et al others phd md msc".split())
#: Words of organisations and what they are shortened to. Fixed values.
ORG_WORDS = {
    "inst": "institute", "institut": "institute", "soc": "society", "ctr": "centre", "cntr": "centre", "cent": "centre", "center": "centre", "obs": "observatory", "observ": "observatory", "cncl": "council", "coun": "council",
    "lab": "laboratory", "labs": "laboratory", "univ": "university", "uni": "university", "dept": "department", "dep": "department", "assoc": "association", "assn": "association", "natl": "national", "intl": "international",
    "acad": "academy", "coll": "college", "fdn": "foundation", "found": "foundation", "grp": "group", "f": "for", "res": "research", "tech": "technology", "o": "of",
}
ORG_KINDS = frozenset("institute society centre observatory council laboratory university department association academy college foundation group ministry agency museum library school bureau office commission committee network consortium trust union press company".split())
_LETTERS = {"ø": "o", "œ": "o", "æ": "a", "ß": "ss", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ı": "i", "ħ": "h"}
_TOKEN = regex.compile(r"[\p{L}\p{M}\p{N}'’]+\.?|&")


def fold(word: str) -> str:
    """A word without case and accents."""
    word = "".join(_LETTERS.get(c, c) for c in word.lower())
    word = "".join(c for c in unicodedata.normalize("NFKD", word) if c.isalnum())
    return word


def _initials(word: str, shout: bool) -> bool:
    """Initials written together in capitals, within a name that isn't all capitals."""
    return 2 <= len(word) <= 3 and word.isupper() and word.isalpha() and not shout


def _given(words: list[str], shout: bool) -> list[str]:
    """Given parts: full names, initials (one letter), abbreviations (ending in a full stop)."""
    out = []
    for w in words:
        bare = w.rstrip(".")
        f = fold(bare)
        if _initials(bare, shout):
            out += list(f)
            continue
        if not f or f in TITLES or f in SUFFIXES or f in PARTICLES and len(out) > 0 and len(f) > 1:
            continue
        if len(f) == 1:
            out.append(f)
        elif w.endswith(".") and len(f) <= 4:
            out.append(f + ".")
        else:
            out.append(f)
    return out


def _org_word(word: str) -> str:
    if word == "&":
        return "and"
    f = fold(word)
    return f if len(f) == 1 and not word.islower() else ORG_WORDS.get(f, f)


def parse(name: str) -> tuple[bool, str, list[str], list[str], list[str], list[list[str]]]:
    """(organisation?, family, given parts, halves of double names, families and given parts under other readings)."""
    text = regex.sub(r"\([^)]*\)", " ", unicodedata.normalize("NFKC", name))
    before, comma, after = text.partition(",")
    words = [w for w in regex.findall(r"[\p{L}\p{M}\p{N}]+|&", text)]
    plain = [_org_word(w) for w in words]
    if len(plain) >= 3 and (any(w in ORG_KINDS for w in plain) or len(plain) >= 4 and any(w in ("of", "for", "on") for w in plain[1:-1])):
        if comma and (tail := [fold(w) for w in regex.findall(r"[\p{L}\p{M}\p{N}]+", after)]):
            plain = tail + [_org_word(w) for w in regex.findall(r"[\p{L}\p{M}\p{N}]+|&", before)]
        return True, " ".join(w for w in plain if w not in ("the", "of", "for", "on", "and", "in")), [], [], [], []
    shout = text.upper() == text
    split = lambda s, hyphen: [w for w in _TOKEN.findall(s.replace("-", " ") if hyphen else regex.sub(r"(?<=\p{L})-(?=\p{L})", "", regex.sub(r"(?i)\bal-", "al ", s)))]
    if comma:
        family = [fold(w) for w in split(before, False)]
        bare = [f for f in family if f and f not in PARTICLES and f not in TITLES and f not in SUFFIXES]
        given = _given(split(after, True), shout)
        fam = bare[-1] if len(bare) < len(family) and bare else "".join(bare)
        return False, fam, [g for g in given if g not in PARTICLES or len(g) == 1], _halves(before), [], []
    parts = [w for w in split(text, False) if (f := fold(w)) and (_initials(w.rstrip("."), shout) or f not in TITLES and f not in SUFFIXES)]
    if not parts:
        return False, fold(text), [], [], [], []
    low = ["" if _initials(w.rstrip("."), shout) else fold(w) for w in parts]  # initials are no particles
    given = lambda ws: _given(_TOKEN.findall(" ".join(text_given(text, ws)).replace("-", " ")), shout)
    halves = _halves(text)
    first = next((k for k, w in enumerate(low) if w in PARTICLES and len(w) > 1), None)
    if first == 0:
        while len(low) > 1 and low[0] in PARTICLES:
            low, parts = low[1:], parts[1:]
        return False, low[0] or fold(parts[0]), given(parts[1:]), halves, [], []
    if first is not None and first < len(low) - 1:
        return False, low[-1] or fold(parts[-1]), given(parts[:first]), halves, [], []
    if len(parts) == 1:
        return False, fold(parts[0]), [], halves, [], []
    last = parts[-1].rstrip(".")
    if len(last) == 1 or _initials(last, shout) or all(len(w.rstrip(".")) == 1 for w in parts[1:]):
        return False, low[0] or fold(parts[0]), given(parts[1:]), halves, [], []
    low = [fold(w) for w in parts]
    fams, givs = [low[0]], [given(parts[1:])]
    if len(parts) > 2:  # a double name whose hyphen was lost
        fams.append(low[-2] + low[-1])
        givs.append(given(parts[:-2]))
    return False, low[-1], given(parts[:-1]), halves, fams, givs


def _halves(text: str) -> list[str]:
    """Parts of hyphenated names, of which either may stand alone."""
    return [fold(h) for m in regex.findall(r"\p{L}{4,}(?:-\p{L}{4,})+", text) for h in m.split("-")]


def text_given(text: str, joined: list[str]) -> list[str]:
    """The given words as written, with the hyphens that were dropped for family names."""
    raw = {regex.sub(r"-", "", w): w for w in regex.findall(r"[\p{L}\p{M}\p{N}'’-]+\.?", text) if "-" in w}
    return [raw.get(w, w) for w in joined]


_SCHEMA = "name string, n bigint, org boolean, fam string, giv array<string>, halves array<string>, fams array<string>, givs array<array<string>>"
_COLUMNS = [c.split()[0] for c in _SCHEMA.split(", ")]


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.column(0).to_pylist()
        org, fam, giv, halves, fams, givs = zip(*map(parse, names), strict=True) if names else ((),) * 6
        lists = pa.list_(pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(org, pa.bool_()), pa.array(fam, pa.string()), *(pa.array(x, lists) for x in (giv, halves, fams)), pa.array(givs, pa.list_(lists))], _COLUMNS)


def read_forms(names: DataFrame) -> DataFrame:
    """name, n, org, fam, giv, halves, first, full of distinct names (name, n); where a name can be read in several ways,
    the family that other names show wins. first is the given part that counts, full is false for initials and abbreviations."""
    read = stored(names.mapInArrow(_parse_batches, _SCHEMA).where("fam <> ''"))
    sure = read.where("NOT org AND size(fams) = 0 AND size(giv) > 0")
    seen = sure.select(F.explode(F.array(F.struct(F.col("fam").alias("fam"), F.lit(1).alias("k")), F.struct(F.get("giv", F.lit(0)).alias("fam"), F.lit(-1).alias("k")))).alias("x"))
    roles = seen.groupBy("x.fam").agg(F.sum("x.k").alias("k")).where("k > 0").select("fam", F.lit(1).alias("known"))
    zipped = F.arrays_zip(F.concat(F.array("fam"), "fams").alias("fam"), F.concat(F.array("giv"), "givs").alias("giv"), F.sequence(F.lit(0), F.size("fams")).alias("k"))
    ways = read.where("size(fams) > 0").select("name", "n", "halves", F.explode(zipped).alias("w")).select("name", "n", "halves", "w.*")
    ranked = ways.join(roles, "fam", "left").withColumn("known", F.coalesce("known", F.lit(0)))
    order = F.struct("known", F.when((F.col("k") == 2) & (F.col("known") == 1), 3).otherwise(-F.col("k")).alias("p"), "fam", "giv", "n", "halves")
    chosen = ranked.groupBy("name").agg(F.max(order).alias("w")).select("name", "w.n", F.lit(False).alias("org"), "w.fam", "w.giv", "w.halves")
    every = read.where("size(fams) = 0").select("name", "n", "org", "fam", "giv", "halves").unionByName(chosen)
    first = F.when(F.col("org") | (F.size("giv") == 0), F.lit("")).otherwise(F.get("giv", F.lit(0)))
    full = F.col("org") | ((F.length(first) > 1) & ~first.endswith("."))
    return stored(every.withColumns({"first": first, "full": full}), read)


def one_error(a: Column, b: Column) -> Column:
    """Whether two tokens differ by one typing error: a letter more, less or other, or two neighbours swapped."""
    def swapped(i: Column) -> Column:
        at = lambda k, n: F.substr(a, k, n)
        return F.concat(at(F.lit(1), i - 1), at(i + 1, F.lit(1)), at(i, F.lit(1)), F.substr(a, i + 2)) == b

    swap = (F.length(a) == F.length(b)) & (F.length(a) > 1) & (F.levenshtein(a, b, 2) == 2) & F.exists(F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))), swapped)
    return (F.levenshtein(a, b, 1) == 1) | swap


def similar_tokens(tokens: DataFrame) -> DataFrame:
    """kind, a, b: distinct tokens of a kind that differ by one error, by a prefix-filtered join on positional q-grams.

    Tokens have two letters or more; the letters of one of two stand as a gram of their own, as a swap leaves it no other."""
    padded = F.concat(F.lit("^^"), F.col("token"), F.lit("$$"))
    grams = F.transform(F.sequence(F.lit(1), F.length(padded) - Q + 1), lambda i: F.struct(F.substr(padded, i, F.lit(Q)).alias("g"), i.alias("p")))
    pair = F.struct(F.array_join(F.array_sort(F.split("token", "")), "").alias("g"), F.lit(0).alias("p"))
    rows = tokens.select("kind", "token", F.explode(F.when(F.length("token") == 2, F.concat(grams, F.array(pair))).otherwise(grams)).alias("x")).select("kind", "token", "x.g", "x.p")
    freq = rows.groupBy("kind", "g").agg(F.count("*").alias("df"))
    ranked = rows.join(freq, ["kind", "g"]).groupBy("kind", "token").agg(F.slice(F.array_sort(F.collect_list(F.struct("df", "g", "p"))), 1, PREFIX).alias("x"))
    prefix = ranked.select("kind", "token", F.length("token").alias("len"), F.explode("x").alias("x")).select("kind", "token", "len", "x.g", "x.p")
    a = prefix.select("kind", F.col("token").alias("a"), F.col("len").alias("la"), "g", F.explode(F.array(F.col("p") - 1, F.col("p"), F.col("p") + 1)).alias("p"))
    b = prefix.select("kind", F.col("token").alias("b"), F.col("len").alias("lb"), "g", "p")
    near = a.join(b, ["kind", "g", "p"]).where((F.col("a") < F.col("b")) & (F.abs(F.col("la") - F.col("lb")) <= 1))
    return near.where(one_error(F.col("a"), F.col("b"))).select("kind", "a", "b").distinct()


def _nicknames(spark) -> DataFrame:
    rows = [(n, line.split()[0]) for line in NICKNAMES.strip().splitlines() for n in line.split()]
    return spark.createDataFrame(sorted({(fold(a), fold(b)) for a, b in rows}), "first string, full string")


#: How two parts are related.
SAME, KNOWN, SLIP, HALF = 0, 1, 2, 3


def kin(persons: DataFrame, forms: DataFrame) -> DataFrame:
    """kind ('f' families, 'g' given names), a, b, sim, how: parts of names that can stand for each other, both ways round."""
    own = persons.select(F.explode(F.array(F.struct(F.lit("f").alias("kind"), F.col("fam").alias("token")), F.struct(F.lit("g").alias("kind"), F.col("first").alias("token")))).alias("x")).select("x.*")
    tokens = stored(own.unionByName(forms.where("NOT full").select(F.lit("f").alias("kind"), F.col("fam").alias("token"))).distinct())
    near = similar_tokens(tokens.where("length(token) > 1"))
    two = F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("b").alias("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    errors = near.select("kind", two.alias("x")).select("kind", "x.a", "x.b", (1 - 1 / F.greatest(F.length("x.a"), F.length("x.b"))).alias("sim"), F.lit(SLIP).alias("how"))
    firsts = tokens.where("kind = 'g' AND token <> ''").select(F.col("token").alias("first"))
    nick = F.broadcast(_nicknames(persons.sparkSession))  # a fixed list
    plain = F.replace(F.replace(F.replace(F.col("first"), F.lit("oe"), F.lit("o")), F.lit("ae"), F.lit("a")), F.lit("ue"), F.lit("u"))
    # spellings of umlauts and nicknames meet on what they stand for
    stands = firsts.select("first", F.concat(F.lit("="), plain).alias("full"), F.lit(1.0).alias("sim")).unionByName(firsts.join(nick, "first").select("first", "full", F.lit(0.95).alias("sim")))
    other = stands.select(F.col("first").alias("b"), "full")
    known = stands.join(other, "full").where("first <> b").select(F.lit("g").alias("kind"), F.col("first").alias("a"), "b", "sim", F.lit(KNOWN).alias("how"))
    half = forms.where("full AND NOT org AND size(halves) > 1").select(F.explode("halves").alias("a"), F.col("fam").alias("b")).distinct().where("a <> b")
    half = half.select(F.lit("f").alias("kind"), "a", "b", F.lit(0.9).alias("sim"), F.lit(HALF).alias("how"))
    same = tokens.select("kind", F.col("token").alias("a"), F.col("token").alias("b"), F.lit(1.0).alias("sim"), F.lit(SAME).alias("how"))
    every = errors.unionByName(known).unionByName(same)
    best = every.groupBy("kind", "a", "b").agg(F.min(F.struct("how", (-F.col("sim")).alias("d"))).alias("m")).select("kind", "a", "b", (-F.col("m.d")).alias("sim"), F.col("m.how").alias("how"))
    return stored(best.unionByName(half), tokens)


def weigh(forms: DataFrame) -> DataFrame:
    """fam, first, n, org, mid, giv_fams, w_fam, w_giv: the full forms with the rarity of their parts."""
    letters = F.transform(F.slice("giv", 2, F.greatest(F.size("giv"), F.lit(1))), lambda g: F.substr(g, F.lit(1), F.lit(1)))
    persons = forms.where("full").groupBy("fam", "first").agg(F.sum("n").alias("n"), F.bool_or("org").alias("org"), F.array_distinct(F.flatten(F.collect_set(letters))).alias("mid"))
    persons = stored(persons)
    total = persons.agg(F.sum("n").alias("all"))  # one row
    fam_n = persons.groupBy("fam").agg(F.sum("n").alias("fam_n"))
    giv_n = persons.where("first <> ''").groupBy("first").agg(F.sum("n").alias("giv_n"), F.count("*").alias("giv_fams"))
    joined = persons.join(fam_n, "fam").join(giv_n, "first", "left").crossJoin(F.broadcast(total))
    out = joined.select(
        "fam", "first", "n", "org", "mid", F.coalesce("giv_fams", F.lit(0)).alias("giv_fams"),
        F.log(F.lit(1.0) + F.col("all") / F.col("fam_n")).alias("w_fam"), F.when(F.col("first") == "", 0.0).otherwise(F.log(F.lit(1.0) + F.col("all") / F.coalesce("giv_n", F.lit(1)))).alias("w_giv"))
    return stored(out, persons)


def edges(persons: DataFrame, related: DataFrame) -> DataFrame:
    """fam, first, u_fam, u_first: each full form with the best-attested form that it may be a variant of.

    One chain of joins: a form meets others over the relations of its given name and of its family, one of which must be
    the same or known; the last join is on both parts, so no family brings together all that share it."""
    giv = related.where("kind = 'g'").select(F.col("a").alias("l_first"), F.col("b").alias("first"), F.col("sim").alias("g_sim"), F.col("how").alias("g_how"))
    fam = related.where("kind = 'f'").select(F.col("a").alias("l_fam"), F.col("b").alias("fam"), F.col("sim").alias("f_sim"), F.col("how").alias("f_how"))
    low = persons.select(F.col("fam").alias("l_fam"), F.col("first").alias("l_first"), F.col("n").alias("l_n"), F.col("org").alias("l_org"), F.col("giv_fams").alias("l_fams"))
    fits = F.expr(f"(f_how = {SAME} AND g_how IN ({KNOWN}, {SLIP})) OR (f_how = {SLIP} AND g_how IN ({SAME}, {KNOWN})) OR (f_how = {HALF} AND g_how = {SAME})")
    met = low.join(giv, "l_first").join(fam, "l_fam").where(fits).join(persons.drop("mid"), ["fam", "first"]).where("org = l_org")
    # the weights of the better attested form: an error makes any token look rare
    soft = (F.col("w_fam") * F.col("f_sim") + F.col("w_giv") * F.col("g_sim")) / (F.col("w_fam") + F.col("w_giv"))
    upward = (F.col("f_how") == HALF) | (F.col("l_n") < F.col("n")) | ((F.col("l_n") == F.col("n")) & (F.struct("l_fam", "l_first") > F.struct("fam", "first")))
    met = stored(met.where(upward).select("l_fam", "l_first", "l_n", "fam", "first", "n", (F.col("g_how") == SLIP).alias("slip"), F.least("l_fams", "giv_fams").alias("fams"), soft.alias("s")))
    both = [F.least("l_first", "first").alias("x"), F.greatest("l_first", "first").alias("y")]
    beside = met.where("slip").groupBy(*both).agg(F.countDistinct("fam").alias("c"))
    slips = met.where("slip").withColumns({"x": both[0], "y": both[1]}).join(beside, ["x", "y"]).where(F.col("c") >= BESIDE * F.col("fams"))
    every = met.where("NOT slip").unionByName(slips.select(*met.columns)).where(F.col("s") >= SIMILAR)
    top = every.groupBy("l_fam", "l_first").agg(F.max(F.struct("s", "n", "fam", "first")).alias("up"))
    return top.select(F.col("l_fam").alias("fam"), F.col("l_first").alias("first"), F.col("up.fam").alias("u_fam"), F.col("up.first").alias("u_first"))


def roots(persons: DataFrame, up: DataFrame) -> DataFrame:
    """fam, first, mid, n, r_fam, r_first: pointers followed to their end, twice as far each round."""
    root = stored(persons.join(up, ["fam", "first"], "left").select("fam", "first", "mid", "n", F.coalesce("u_fam", "fam").alias("r_fam"), F.coalesce("u_first", "first").alias("r_first")))
    while True:
        # only what points elsewhere can move, and only over what points elsewhere itself
        step = root.where("r_fam <> fam OR r_first <> first").select(F.col("fam").alias("r_fam"), F.col("first").alias("r_first"), F.col("r_fam").alias("x"), F.col("r_first").alias("y"))
        nxt = stored(root.join(step, ["r_fam", "r_first"], "left").select("fam", "first", "mid", "n", F.coalesce("x", "r_fam").alias("r_fam"), F.coalesce("y", "r_first").alias("r_first"), F.col("x").isNotNull().alias("moved")), root)
        root = nxt
        if nxt.where("moved").isEmpty():
            return root


def short_forms(forms: DataFrame, root: DataFrame, related: DataFrame) -> DataFrame:
    """fam, giv, r_fam, r_first: names with an initial or an abbreviation, each with the best-attested person it fits.

    They meet on the family and the first letter of the given name."""
    letter = lambda c: F.substr(c, F.lit(1), F.lit(1))
    who = root.groupBy("r_fam", "r_first", "fam").agg(F.array_distinct(F.flatten(F.collect_set("mid"))).alias("mid"), F.sum("n").alias("n"), F.collect_set("first").alias("firsts"))
    who = who.withColumn("c", F.explode(F.array_distinct(F.transform("firsts", letter)))).where("c <> ''")
    s = forms.where("NOT full AND size(giv) > 0").select("fam", "giv", F.get("giv", F.lit(0)).alias("s")).distinct().withColumn("c", letter(F.col("s")))
    mids = F.transform(F.slice("giv", 2, F.greatest(F.size("giv"), F.lit(1))), letter)
    fits = F.exists("firsts", lambda f: f.startswith(F.rtrim("s", F.lit("."))))
    mid_ok = (F.size("giv") < 2) | (F.size("mid") == 0) | (F.size(F.array_except(mids, F.col("mid"))) == 0)
    near = related.where(f"kind = 'f' AND how IN ({SAME}, {SLIP})").select(F.col("a").alias("s_fam"), F.col("b").alias("fam"), "how")
    met = s.withColumnRenamed("fam", "s_fam").join(near, "s_fam").join(who, ["fam", "c"]).where(fits & mid_ok)
    found = met.groupBy("s_fam", "giv", "r_fam", "r_first").agg((-F.min("how")).alias("d"), F.sum("n").alias("n"))
    top = found.groupBy("s_fam", "giv").agg(F.max(F.struct("d", "n", "r_fam", "r_first")).alias("t"))
    return top.select(F.col("s_fam").alias("fam"), "giv", "t.r_fam", "t.r_first")


def link(names: DataFrame) -> DataFrame:
    """name, who: each distinct name with an id of whom it names."""
    forms = read_forms(names.where(F.trim(F.col("name")) != "").groupBy("name").agg(F.count("*").alias("n")))
    persons = weigh(forms)
    related = kin(persons, forms)
    root = roots(persons, edges(persons, related))
    who = F.concat_ws("|", "r_fam", "r_first")
    full = forms.where("full").join(root.select("fam", "first", who.alias("who")), ["fam", "first"]).select("name", "fam", "giv", "who")
    alone = F.concat_ws("|", "fam", F.array_join("giv", " "), F.lit("?"))
    short = forms.where("NOT full").select("name", "fam", "giv").join(short_forms(forms, root, related).select("fam", "giv", who.alias("who")), ["fam", "giv"], "left")
    both = full.unionByName(short.select("name", "fam", "giv", F.coalesce("who", alone).alias("who")))
    # initials of an organisation's words with its place
    words = F.split("r_fam", " ")
    letters = F.array_join(F.transform(F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda w: F.substr(w, F.lit(1), F.lit(1))), "")
    known = root.where("r_first = '' AND r_fam LIKE '% % %'").select(F.get(words, F.lit(0)).alias("fam"), letters.alias("letters"), who.alias("org_who")).groupBy("fam", "letters").agg(F.min("org_who").alias("org_who"))
    out = stored(both.withColumn("letters", F.array_join("giv", "")).join(known, ["fam", "letters"], "left").select("name", F.coalesce("org_who", "who").alias("who")), forms, related, root)
    free(persons)
    return out


def author_names(entries: DataFrame, enriched: DataFrame) -> DataFrame:
    """Every name of both tables, as stored."""
    return entries.select(F.explode("authors").alias("name")).unionByName(enriched.select(F.explode("authors").alias("name"))).where("name IS NOT NULL")


def pairs(linked: DataFrame) -> DataFrame:
    """name_a, name_b: each pair of strings of one person or organisation."""
    a, b = linked.select(F.col("name").alias("name_a"), "who"), linked.select(F.col("name").alias("name_b"), "who")
    return a.join(b, "who").where("name_a < name_b").select("name_a", "name_b")
