"""Matching publications across sources without keys: collective graph linkage.

1. Records that agree in title words, author words and year are one node, so copies cost nothing.
2. Blocking attributes of a node are runs of three and five title words, an author word with the title's first or last
   words, and the whole title with an author word or the year. Attributes found in one source only are dropped. Words weigh by
   their rarity, counted exactly over both sources.
3. Meta-blocking: an edge weighs the sum of its attributes' rarities. A run of words that more than FEW pairs share is a pattern of
   titles and tells nothing by itself; if a node has no other run, such as a title cut to its opening, its runs are taken
   with each author word instead. An edge below TOLD is pruned. Where more than PURGE pairs share an attribute with an author or a
   whole title, each of its nodes is compared with representatives of the other source only, so a publication that holds
   a third of all rows costs as many comparisons as it has nodes.
4. Each pair that is left gets the rarity-weighted overlap of title words and of author words and the distance in years.
   Where titles agree in part only, what is shared must weigh nearly what singles out one pair of all that there are.
   Parts, supplements and editions of different years contradict each other.
5. Similarity is propagated until stable. Sure pairs form neighbourhoods. An uncertain pair between two of them gains what
   both sides send to each other alone, and loses what they send elsewhere: a record that is as similar to another neighbourhood
   joins neither. Each that joins changes what its neighbours send, so this goes on until no neighbourhood changes.
6. Cohesion: the pairs within a neighbourhood that are not sure are compared by themselves, and are kept if their own similarity, lifted
   by how firmly both records are tied to it, is enough. One wrong link brings no product of two publications.

Defined cases: NULL or placeholder titles link nothing; missing authors and years are neutral evidence; an id
that is there twice gives its pairs once; a table that is empty gives no pairs; extra columns are ignored; texts are taken whole.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, stored
from .lookalike import ligatures, look_alikes

#: Lengths of runs of words, each with the least number of title words it is used for.
RUNS = ((3, 1), (5, 6))
#: Rarest author words used in attributes.
PEOPLE = 3
#: Least weight of an author word in an attribute, other than the rarest: one record in two hundred.
RARE_NAME = math.log(200)
#: Pairs beyond which a run of words is a pattern of titles, and
#: pairs beyond which all nodes are compared with representatives instead of each other.
FEW, PURGE = 24, 500
#: Least sum of log(1e6 / pairs) over the attributes that a pair shares, and what one with an author tells besides.
TOLD, NAMED = 12.0, 1.5
#: Most attributes that are sent to all tasks; a larger table of them is joined by shuffle.
SENT = 500_000
#: Most distinct words whose frequencies are sent to all tasks; a larger table of them is joined by shuffle, with the same weights.
SENT_WORDS = 500_000
#: Weight of a word that only one source has.
UNSEEN = 3.0
#: Least confidence of a pair, and of one that is kept to see whether others support it.
ALONE, SUPPORTED = 0.68, 0.55
#: What an uncertain pair gains at most from neighbourhoods that send to each other alone, and what ties to its neighbourhood add.
GAIN, TIED = 0.25, 0.7
#: Part of both titles' weight that records without a common author must share to gain by propagation.
OTHERS = 0.6
#: Part of the weight that would single out one pair of all, which titles that agree in part must share with their authors.
CHANCE = 0.75

#: Words without content in the languages of titles. Fixed values.
STOP = "the a an of and in on for with to from by at as is do does der die das und zu zur zum eine ein für im von la le les des de du une un et à en el los las y una del al sur в и по на о к".split()
#: Labels that providers put before or after a title. Fixed values.
LABELS = r"^\s*\[[^\]]{1,24}\]\s*|^\s*(op-?ed|article|preprint|paper|research article|working paper|review)\s*:\s*|\s*[(\[](draft|article|preprint|pdf|extended version|no title)[)\]][\s.!]*$"


@cache
def _folding() -> dict[int, str]:
    """What characters are folded to: look-alikes, full-width forms, ligatures, accents; other marks vanish."""
    table = dict(look_alikes())
    for cp in (*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x1F00)):
        ch = chr(cp)
        base = unicodedata.normalize("NFD", table.get(ch, ch))[0]
        if base != ch:
            table[ch] = table.get(base, base)
    table |= {k: v for k, v in ligatures().items() if k in "ﬀﬁﬂﬃﬄﬅﬆ"} | {"ø": "o", "Ø": "o", "ł": "l", "Ł": "l", "đ": "d", "ı": "i", "ß": "ss", "æ": "ae", "Æ": "ae"}
    gone = {chr(cp): "" for cp in range(0x10000) if unicodedata.category(chr(cp)) in ("Mn", "Cf") and not 0x3099 <= cp <= 0x309A}
    return str.maketrans(gone | table)


_NOISE = regex.compile(r"<[^<>]{1,200}>|&[a-z]{2,6};")
_LABELS = regex.compile(LABELS)
_LABELLED = ("[", "op-ed", "oped", "article", "preprint", "paper", "research", "working", "review")
_CUT = regex.compile(r"[\p{L}\p{N}]+$")
_ASCII_WORD = re.compile(r"[a-z0-9]+")
_WORD = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー]|[\p{L}\p{N}--[\p{Han}\p{Hiragana}\p{Katakana}ー]]+", regex.V1)
_ASCII_PERSON = re.compile(r"[a-z]{3,}")
_PERSON = regex.compile(r"\p{L}{3,}")
_YEAR = re.compile(r"(?<!\d)(?:1[5-9]|20)\d{2}(?!\d)")
_PART = re.compile(r"\b(?:part|teil|partie|parte|часть)\s+([ivx]+|\d+)\b")
_SUPPLEMENT = re.compile(r"\bsupplement(?:ary|s)?\b|\berrat(?:a|um)\b|\bcorrigend(?:a|um)\b")
_EDITION = re.compile(r"^\W*((?:annual|yearly|quarterly) [a-z]+:)")
_STOP = frozenset(STOP)
_NO_NAMES = frozenset(("prof", "van", "von", "der", "del", "etc"))
_STRINGS = pa.list_(pa.string())


def fold(text: str | None) -> str:
    """Lower case without markup, accents, look-alikes and invisible characters."""
    if not text:
        return ""
    text = text.lower()
    if "<" in text or "&" in text:
        text = _NOISE.sub("", text)
    return text if text.isascii() else text.translate(_folding()).lower()


def read_record(title: str | None, authors: list[str | None] | None, date: str | None) -> tuple[list[str], list[str], int | None, str]:
    """Words in order, author words, year and mark (part, supplement, edition) of a record."""
    folded = fold(title).strip()
    part = _PART.search(folded) if "part" in folded or "teil" in folded or "часть" in folded else None
    edition = _EDITION.match(folded) if ":" in folded else None
    extra = "s" if ("suppl" in folded or "errat" in folded or "corrig" in folded) and _SUPPLEMENT.search(folded) else ""
    mark = f"{part[1] if part else ''}/{extra}/{edition[1] if edition else ''}"
    if folded.startswith(_LABELLED) or folded.endswith((")", "]", "!", ".")):
        folded = _LABELS.sub("", folded).rstrip()
    if folded.endswith(("…", "...")):
        folded = _CUT.sub("", folded.rstrip("…."))
    found = _ASCII_WORD.findall(folded) if folded.isascii() else _WORD.findall(folded)
    names = fold(" ".join(a for a in authors or () if a)).replace("-", "")
    people = sorted({*(_ASCII_PERSON if names.isascii() else _PERSON).findall(names)} - _NO_NAMES)
    year = _YEAR.search(date or "")
    return [w for w in dict.fromkeys(found) if w not in _STOP], people, int(year[0]) if year else None, mark


def _numbers(words: pa.Array) -> np.ndarray:
    """Strings as 39-bit numbers, all at once from their bytes."""
    words = words.cast(pa.string())
    if not len(words):
        return np.zeros(0, np.int64)
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    size = np.diff(offsets)
    at = np.arange(len(data)) - np.repeat(offsets[:-1] - offsets[0], size)
    power = np.cumprod(np.full(int(size.max(initial=1)), 0x100000001B3, np.uint64))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[at], dtype=np.uint64)))
    return (_mix(sums[offsets[1:] - offsets[0]] - sums[offsets[:-1] - offsets[0]]) >> np.uint64(25)).astype(np.int64)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[tuple] = []
        for i, title, authors, date in zip(*(c.to_pylist() for c in b.columns), strict=True):
            words, people, year, mark = read_record(title, authors, date)
            if words:
                same = xxhash.xxh64_intdigest("\x01".join((*words, "\x02", *people, "\x02", str(year), mark))) - (1 << 63)
                out.append((i, same, words, people, year, mark))
        cols = list(zip(*out, strict=True)) if out else [()] * 6
        kinds = (pa.int64(), pa.int64(), _STRINGS, _STRINGS, pa.int32(), pa.string())
        arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
        arrays[3] = pa.ListArray.from_arrays(arrays[3].offsets, pa.array(_numbers(arrays[3].values), pa.int64()))
        yield pa.RecordBatch.from_arrays(arrays, ["id", "node", "words", "p", "year", "mark"])


def records(df: DataFrame, id_col: str, title: Column, authors: Column, date: Column) -> DataFrame:
    """id, node, words (in order, distinct), p (author words as numbers), year, mark: what the linkage sees of a record.

    node is a number that is equal for records that agree in all of it. Records without a title word are left out."""
    seen = df.select(F.col(id_col).cast("bigint").alias("id"), title.alias("title"), authors.alias("authors"), date.alias("date"))
    return seen.mapInArrow(_read, "id bigint, node bigint, words array<string>, p array<bigint>, year int, mark string")


def _unique(df: DataFrame) -> DataFrame:
    """A side of a join with one row for each key: its partitions are hashed instead of sorting both sides; none can be skewed."""
    return df.hint("shuffle_hash")


def nodes(rows: DataFrame) -> DataFrame:
    """side, node and what is seen of it: records of a side that agree in all that is seen are one node."""
    return stored(rows.select("side", "node", "words", "p", "year", "mark").dropDuplicates(["side", "node"]))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        left, lists = b.column(0).to_numpy(zero_copy_only=False), (b.column(1), b.column(2))
        words = (_numbers(lists[0].flatten()), lists[1].flatten().to_numpy(zero_copy_only=False).astype(np.int64))
        of = [np.repeat(left, x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)) for x in lists]
        h, at = np.unique(np.concatenate(words), return_inverse=True)
        on_left = np.concatenate(of).astype(bool)
        yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), *(pa.array(np.bincount(at, k, len(h)).astype(np.int64)) for k in (on_left, ~on_left))], ["h", "a", "b"])


def frequencies(every: DataFrame) -> DataFrame:
    """h, n: the words that both sides have and the number of nodes with them."""
    both = every.select(F.col("side") == "l", "words", "p").mapInArrow(_count, "h bigint, a bigint, b bigint").groupBy("h").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return both.where("a > 0 AND b > 0").select("h", (F.col("a") + F.col("b")).alias("n"))


def _mix(*parts: np.ndarray | int) -> np.ndarray:
    """One 64-bit number from several."""
    h = np.full(1, 0x9E3779B97F4A7C15, np.uint64)
    for x in parts:
        h = (h ^ np.atleast_1d(x).astype(np.int64).astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        h = h ^ (h >> np.uint64(32))
    return h


def _rarest(x: np.ndarray, w: np.ndarray, o: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, number, weight, rank) of the rarest words of each row."""
    row = np.repeat(np.arange(len(o) - 1), np.diff(o))
    order = np.lexsort((x, -w, row))
    rank = np.arange(len(row)) - o[:-1][row] if len(row) else row
    keep = rank < most
    return row[keep], x[order][keep], w[order][keep], rank[keep]


def _attributes(t: np.ndarray, tw: np.ndarray, ts: np.ndarray, p: np.ndarray, pw: np.ndarray, ps: np.ndarray, year: np.ndarray, least: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of many nodes, (row, number) of runs of words, and of the other attributes. ts and ps are offsets of the lists."""
    n, first = np.diff(ts), ts[:-1]
    row = np.repeat(np.arange(len(n)), n)
    inner = np.arange(len(t)) - first[row]
    sums = np.concatenate(([0.0], np.cumsum(tw, dtype=np.float64)))
    whole = np.add.reduceat(_mix(7, t), np.minimum(first, max(len(t) - 1, 0))) if len(t) else np.zeros(len(n), np.uint64)
    runs = []
    for k, fewest in RUNS:
        short = np.flatnonzero((n < k) & (n >= fewest) & (n > 0))
        at = np.flatnonzero((inner + k <= n[row]) & (n[row] >= fewest))
        at = at[(n[row[at]] == k) | (sums[at + k] - sums[at] >= least)]
        runs.append([(short, _mix(k, whole[short])), (row[at], _mix(k, *(t[at + j] for j in range(k))))])
    # the rarest author words of each node
    who, pp, ww, rank = _rarest(p, pw, ps, PEOPLE)
    rarest = np.zeros(len(n), np.int64)
    rarest[who[rank == 0]] = pp[rank == 0]
    keep = (rank == 0) | (ww > RARE_NAME)
    who, pp = who[keep], pp[keep]
    last = ts[1:] - 1
    head = _mix(t[first], np.where(n > 1, t[np.minimum(first + 1, len(t) - 1)], 0)) if len(t) else whole
    tail = _mix(np.where(n > 1, t[np.maximum(last - 1, 0)], 0), t[last]) if len(t) else whole
    every = np.arange(len(n))
    others = [(who, _mix(1, pp, head[who])), (who, _mix(1, pp, tail[who])), (every, _mix(4, whole, year)), (every, _mix(5, whole, year, rarest))]
    join = lambda pairs: (np.concatenate([r for r, _ in pairs]), np.concatenate([v for _, v in pairs]).astype(np.int64))
    return [join(runs[0] + runs[1]), join(others)]


def _as_lists(rows: int, pairs: tuple[np.ndarray, np.ndarray]) -> pa.ListArray:
    row, value = pairs
    both = np.unique(np.rec.fromarrays([row, value], names="r,v")) if len(row) else np.rec.fromarrays([row, value], names="r,v")
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.bincount(both["r"], minlength=rows)))), pa.int32()), pa.array(both["v"]))


#: A word as a number and its weight in one: the number times UNIT plus the weight in STEP parts.
UNIT, STEP = 1 << 16, 1_000
ALIEN = int(UNSEEN * STEP)
_WEIGHED = "side string, node bigint, year int, mark string, t array<bigint>, tt float, p array<bigint>, pt float, runs array<bigint>, others array<bigint>"


def _weigher(known: tuple[np.ndarray, np.ndarray] | None, least: float):
    """known: words as sorted numbers and their weights; None if the weights are columns of the batch."""
    def look(words: np.ndarray) -> np.ndarray:
        h, w = known
        if not len(h):
            return np.full(len(words), UNSEEN, np.float32)
        at = np.minimum(np.searchsorted(h, words), len(h) - 1)
        return np.where(h[at] == words, w[at], np.float32(UNSEEN)).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            side, node, words, people, year, mark = (b.column(c) for c in ("side", "node", "words", "p", "year", "mark"))
            n = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            t = _numbers(words.flatten())
            ts = np.concatenate(([0], np.cumsum(n)))
            p = people.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            ps = np.concatenate(([0], np.cumsum(people.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))))
            tw, pw = (look(t), look(p)) if known else (b.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.float32) for c in ("tw", "pw"))
            sums = lambda w, o: np.diff(np.concatenate(([0.0], np.cumsum(w, dtype=np.float64)))[o]).astype(np.float32)
            lists = _attributes(t, tw, ts, p, pw, ps, year.fill_null(0).to_numpy(zero_copy_only=False), least)
            # words that only one side has are told by their weight, which no other word has
            seen = lambda w: np.where(w == np.float32(UNSEEN), ALIEN, np.rint(w * STEP) + (np.rint(w * STEP) == ALIEN))
            code = lambda x, w: x * UNIT + np.minimum(seen(w), UNIT - 1).astype(np.int64)
            as_list = lambda o, v, k: pa.ListArray.from_arrays(pa.array(o, pa.int32()), pa.array(v, k))
            cols = [side, node, year, mark, as_list(ts, code(t, tw), pa.int64()), pa.array(sums(tw, ts)), as_list(ps, code(p, pw), pa.int64()), pa.array(sums(pw, ps)), *(_as_lists(len(n), x) for x in lists)]
            yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in _WEIGHED.split(", ")])

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words = b.column(2)
        t = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False)))), pa.int32()), pa.array(_numbers(words.flatten()), pa.int64()))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), t, b.column(3)], ["side", "node", "t", "p"])


def _with_weights(df: DataFrame, weights: DataFrame) -> DataFrame:
    """Adds tw and pw, the weights of title and author words in order, by a join on the words."""
    each = df.select("side", "node", "words", "p").mapInArrow(_hashed, "side string, node bigint, t array<bigint>, p array<bigint>")
    one = lambda c: each.select("side", "node", F.posexplode(c).alias("i", "h")).select("side", "node", F.lit(c).alias("k"), "i", "h")
    found = one("t").unionByName(one("p")).join(weights, "h", "left").select("side", "node", "k", F.struct("i", F.coalesce("w", F.lit(UNSEEN).cast("float")).alias("w")).alias("x"))
    pick = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("k") == k, F.col("x")))), lambda x: x["w"]).alias(f"{k}w")
    return df.join(found.groupBy("side", "node").agg(pick("t"), pick("p")), ["side", "node"])


def weigh(every: DataFrame) -> DataFrame:
    """Nodes with their words as numbers, weights by rarity, sums of weights, and blocking attributes."""
    freq = stored(frequencies(every))
    total = max(every.count(), 1)
    least = math.log(total) - math.log(4 * math.sqrt(FEW))
    weights = freq.select("h", F.log1p(F.lit(float(total)) / F.col("n")).cast("float").alias("w"))
    known = None
    if freq.limit(SENT_WORDS + 1).count() <= SENT_WORDS:
        sent = weights.toPandas().sort_values("h")  # at most SENT_WORDS rows
        known = (sent["h"].to_numpy(np.int64), sent["w"].to_numpy(np.float32))
    else:
        every = _with_weights(every, weights)
    out = stored(every.mapInArrow(_weigher(known, least), _WEIGHED), by="side")
    free(freq)
    return out


#: Rows that are grouped at once in a task; a group of more with both sides is passed on in parts, as it has more pairs than any bound.
LOT = 1 << 17
#: What _meeter tells: two nodes and what an attribute says for them, a node with a frequent run, a node with another run, an attribute beyond the bound.
PAIR, OFTEN, HELD, FAR = range(4)
_MET = "kind tinyint, r boolean, x bigint, y bigint, told double"
_GATHERED = "r boolean, node bigint, alone boolean, b array<bigint>, w array<bigint>"


def _grouped(df: DataFrame, key: str, work: Callable, schema: str, parts: bool = False) -> DataFrame:
    """Rows of a key are brought together, and work gets many whole keys at once, as columns in order of the key; with ``parts``, also
    a key in parts if it has both sides (tag is odd for the right one) and more than LOT rows, and which key had parts before."""
    lot = LOT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, most, parted = 0, lot, None
        for b in batches:
            held.append(b)
            rows += len(b)
            if rows < most:
                continue
            both = pa.concat_batches(held)
            keys = both.column(0).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))
            if parts and rows - cut >= lot and (keys[-1] == parted or len(np.unique(both.column("tag").to_numpy()[cut:] & 1)) == 2):
                yield from work(both, parted)
                held, rows, most, parted = [], 0, lot, keys[-1]
            else:
                yield from work(both.slice(0, cut), parted)
                held, rows = [both.slice(cut)], rows - cut
                most = max(lot, 2 * rows)
        if rows:
            yield from work(pa.concat_batches(held), parted)

    return df.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)


def _meeter(few: int, purge: int):
    """Of attributes (a, node, tag: 2 if it is a run, and 1 if the node is on the right), the pairs of nodes with one that at most ``few``
    pairs share, ``purge`` if it is no run, and who has others that both sides have."""
    names = [c.split()[0] for c in _MET.split(", ")]

    def tell(kind: int, r: np.ndarray, x: np.ndarray, y: np.ndarray, told: np.ndarray | None = None) -> pa.RecordBatch:
        told = np.zeros(len(x)) if told is None else told
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(x), kind, np.int8)), pa.array(r), pa.array(x), pa.array(y), pa.array(told)], names)

    def work(rows: pa.RecordBatch, parted: int | None) -> Iterator[pa.RecordBatch]:
        if not len(rows):
            return
        a, node, tag = (c.to_numpy() for c in rows.columns)
        start = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
        of = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(a))))
        right = (tag & 1).astype(bool)
        run = np.maximum.reduceat(tag, start) > 1
        n_r = np.add.reduceat(right.astype(np.int64), start)
        cost = n_r * np.add.reduceat((~right).astype(np.int64), start)
        if parted is not None:
            cost[a[start] == parted] = few + purge + 1
        held = (cost > 0) & (cost <= np.where(run, few, purge))
        l, r = np.flatnonzero(held[of] & ~right), np.flatnonzero(held[of] & right)
        first = np.cumsum(np.where(held, n_r, 0)) - np.where(held, n_r, 0)
        times = n_r[of[l]]
        inner = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        each, other = np.repeat(l, times), r[np.repeat(first[of[l]], times) + inner]
        told = np.log(1e6 / np.maximum(cost, 1)) + np.where(run, 0.0, NAMED)
        yield tell(PAIR, np.zeros(len(each), bool), node[each], node[other], told[of[each]])
        often = (cost > 0) & run & ~held
        at = np.flatnonzero(often[of])
        yield tell(OFTEN, right[at], node[at], a[at])
        at = np.flatnonzero((held & run)[of])
        for s in (False, True):
            x = np.unique(node[at[right[at] == s]])
            yield tell(HELD, np.full(len(x), s), x, x)
        x = a[start[(cost > 0) & ~run & ~held]]
        yield tell(FAR, np.zeros(len(x), bool), x, x)

    return work


def _gather(rows: pa.RecordBatch, _: None) -> Iterator[pa.RecordBatch]:
    """Of rows (node, tag: twice OFTEN, HELD or 0, and 1 on the right, b, p) those with frequent runs as lists, their author words that the other side has too, and whether they have no other run."""
    if not len(rows):
        return
    node, tag = rows.column("node").to_numpy(), rows.column("tag").to_numpy()
    order = np.lexsort((tag, tag & 1, node))
    node, tag = node[order], tag[order]
    start = np.flatnonzero(np.concatenate(([True], (node[1:] != node[:-1]) | ((tag[1:] & 1) != (tag[:-1] & 1)))))
    count = lambda x: np.add.reduceat(x.astype(np.int64), start)
    often = tag >> 1 == OFTEN
    n = count(often)
    keep = n > 0
    alone = count(tag >> 1 == HELD)[keep] == 0
    people = rows.column("p").take(pa.array(order[start[keep]]))  # as its tag is the least, the row with author words comes first
    word = people.flatten().to_numpy()
    known = word & (UNIT - 1) != ALIEN
    ends = np.cumsum(np.concatenate(([0], known)))[np.concatenate(([0], np.cumsum(people.value_lengths().to_numpy())))]
    lists = [pa.ListArray.from_arrays(pa.array(o, pa.int32()), pa.array(v)) for o, v in ((np.concatenate(([0], np.cumsum(n[keep]))), rows.column("b").take(pa.array(order[often])).to_numpy()), (ends, word[known]))]
    yield pa.RecordBatch.from_arrays([pa.array((tag[start[keep]] & 1).astype(bool)), pa.array(node[start[keep]]), pa.array(alone), *lists], [c.split()[0] for c in _GATHERED.split(", ")])


def _sent(df: DataFrame) -> DataFrame:
    """A table for a join, sent to all tasks if it has at most SENT rows, joined by shuffle otherwise."""
    return F.broadcast(df) if df.limit(SENT + 1).count() <= SENT else df


def candidates(every: DataFrame) -> DataFrame:
    """l, r: the candidate graph after meta-blocking, pairs of nodes whose shared attributes tell enough."""
    right = (F.col("side") == "r").cast("int")
    attributes = lambda c, run: every.select(F.explode(c).alias("a"), "node", (right + run).cast("tinyint").alias("tag"))
    met = stored(_grouped(attributes("runs", 2).unionByName(attributes("others", 0)), "a", _meeter(FEW, PURGE), _MET, parts=True))
    pair = lambda met: met.where(F.col("kind") == PAIR).select(F.col("x").alias("l"), F.col("y").alias("r"), "told")
    # runs of nodes that have no run but frequent ones are taken with author words; other nodes only need those that such nodes have
    nobody = F.lit(None).cast("array<bigint>").alias("p")
    runs = met.where(F.col("kind").isin(OFTEN, HELD)).select(F.col("x").alias("node"), (F.col("kind") * 2 + F.col("r").cast("int")).cast("tinyint").alias("tag"), F.col("y").alias("b"), nobody)
    people = every.select("node", right.cast("tinyint").alias("tag"), F.lit(0).cast("bigint").alias("b"), "p")
    frequent = stored(_grouped(runs.unionByName(people), "node", _gather, _GATHERED))
    each = frequent.select("r", "node", "alone", F.explode("b").alias("b"), "w")
    with_names = lambda df, *keep: df.select(*keep, "b", F.explode("w").alias("w")).select(*keep, "b", F.xxhash64("b", "w").alias("a"))
    wanted = stored(with_names(each.where("alone")).select("a", "b").distinct())
    named = with_names(each.join(_sent(wanted.select("b").distinct()), "b", "left_semi"), "r", "node").join(_sent(wanted.select("a")), "a", "left_semi")
    more = _grouped(named.select("a", "node", F.col("r").cast("tinyint").alias("tag")), "a", _meeter(FEW, FEW), _MET, parts=True)
    told = pair(met).unionByName(pair(more)).groupBy("l", "r").agg(F.sum("told").alias("told"))
    pairs = told.where(F.col("told") >= TOLD).select("l", "r")
    # what more pairs share is compared with two representatives of the other side only, and the neighbourhoods do the rest
    far = met.where(F.col("kind") == FAR).select(F.col("x").alias("a")).distinct()
    if not far.isEmpty():
        near = every.select("side", "node", F.explode("others").alias("a")).join(_sent(far), "a")
        hubs = near.groupBy("a", "side").agg(F.array(F.min("node"), F.max("node")).alias("hub")).select("a", F.when(F.col("side") == "l", "r").otherwise("l").alias("side"), "hub")
        to_hub = near.join(hubs, ["a", "side"]).select("side", "node", F.explode("hub").alias("hub"))
        pairs = pairs.unionByName(to_hub.select(F.when(F.col("side") == "l", F.col("node")).otherwise(F.col("hub")).alias("l"), F.when(F.col("side") == "l", F.col("hub")).otherwise(F.col("node")).alias("r"))).distinct()
    return stored(pairs, met, frequent, wanted)


def _once(df: DataFrame, **exprs: Column) -> DataFrame:
    """Adds a struct column ``own`` of costly expressions. What is generated is computed once a row; a plain column is computed again wherever a filter
    or a join condition names it."""
    return df.select("*", F.explode(F.array(F.struct(*[e.alias(k) for k, e in exprs.items()]))).alias("own"))


def _shared(a: str, b: str) -> Column:
    """Weight of what two word lists share."""
    return F.aggregate(F.array_intersect(a, b), F.lit(0).cast("bigint"), lambda s, x: s + x.bitwiseAND(F.lit(UNIT - 1).cast("bigint"))) / F.lit(float(STEP))


def _overlap(shared: str, ta: str, tb: str) -> Column:
    """What two word lists share: by itself, as a part of the lighter list, and of both together."""
    shared, ta, tb = F.col(shared), F.col(ta), F.col(tb)
    return F.struct(shared.alias("s"), F.coalesce(F.try_divide(shared, F.least(ta, tb)), F.lit(0.0)).alias("part"), F.coalesce(F.try_divide(shared, ta + tb - shared), F.lit(0.0)).alias("share"))


def _clash() -> Column:
    """Whether both titles have a word that the other lacks, also in another spelling: the same phrase about another thing."""
    alike = lambda x, y: (F.levenshtein(x, y) <= F.greatest(F.lit(1.0), F.length(y) * 0.34)) | x.startswith(y) | y.startswith(x)
    l, r = F.array_except("l_words", "r_words"), F.array_except("r_words", "l_words")
    odd = lambda a, b: F.exists(a, lambda x: ~F.exists(b, lambda y: alike(x, y)))
    return odd(l, r) & odd(r, l) & (F.size(l) > 0) & (F.size(r) > 0)


def contradicts() -> Column:
    """Another part, supplement or edition, or years too far apart."""
    far = F.abs(F.col("l_year") - F.col("r_year")) > F.when(F.col("l_mark").contains(":"), 0).otherwise(1)
    return (F.col("l_mark") != F.col("r_mark")) | F.coalesce(far, F.lit(False))


def confidence(pairs: DataFrame, chance: float = 0.0) -> DataFrame:
    """Adds conf, 0 to 1, from the words of title and authors and the years, and apart, whether titles agree in part only and either
    other people wrote them or all that is shared weighs less than ``chance``. Records that contradict each other are dropped."""
    d = F.abs(F.col("l_year") - F.col("r_year"))
    t, p = F.col("st"), F.col("sp")
    nobody = (F.size("l_p") == 0) | (F.size("r_p") == 0)
    people = F.when(nobody, 0.5).otherwise(p["part"])
    when = F.when(d == 0, 1.0).when(d == 1, 0.8).otherwise(0.6)
    raw = 0.55 * t["part"] + 0.3 * people + 0.15 * when
    weak = (t["part"] < 0.55) | (nobody & ((t["part"] < 0.8) | (t["share"] < 0.6) | (t["s"] < 12))) | (~nobody & (people == 0) & ((t["part"] < 0.9) | (t["share"] < 0.75) | (t["s"] < 15)))
    partly = t["share"] < OTHERS
    common = partly & (t["s"] + p["s"] < chance)
    weak = weak | common
    out = _once(pairs.where(~contradicts()), t=_shared("l_t", "r_t"), p=_shared("l_p", "r_p"))
    out = out.withColumns({"st": _overlap("own.t", "l_tt", "r_tt"), "sp": _overlap("own.p", "l_pt", "r_pt")})
    return out.withColumns({"conf": F.when(weak, F.least(raw, F.lit(ALONE - 0.01))).otherwise(raw).cast("double"), "apart": common | (~nobody & (people == 0) & partly)})


#: Most nodes whose records are picked by a table that is sent, instead of bringing all records to their pairs.
PICKED = 20_000


def _side(df: DataFrame, pairs: DataFrame, k: str, *cols: str) -> DataFrame:
    """The records of one side of pairs."""
    wanted = pairs.select(F.col(k).alias("node")).distinct()
    if wanted.limit(PICKED + 1).count() <= PICKED:
        df = df.join(F.broadcast(wanted), "node", "left_semi")
    return _unique(df.select(F.col("node").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in cols]))


def compare(pairs: DataFrame, every: DataFrame, bare: DataFrame, least: float, chance: float, *keep: str) -> DataFrame:
    """l, r, conf, apart of the stored pairs with at least that confidence, and columns to keep: first by word hashes, then those that pass by the words themselves."""

    def met(pairs: DataFrame, nodes: DataFrame, *seen: str) -> DataFrame:
        l, r = (_side(nodes.where(F.col("side") == s), pairs, s, *seen) for s in "lr")
        return pairs.join(l, "l").join(r, "r")

    near = confidence(met(pairs, every, "t", "tt", "p", "pt", "year", "mark"), chance).where(F.col("conf") >= least)
    near = stored(near.select("l", "r", "conf", "apart", *keep, (F.col("st.part") > 0.9999).alias("_whole")))
    # where one title's words are all in the other, nothing can clash
    read = _once(met(near.where("NOT _whole"), bare, "words"), clash=_clash())
    read = read.select("l", "r", (F.col("conf") - F.when(F.col("own.clash"), 0.25).otherwise(0.0)).alias("conf"), "apart", *keep).where(F.col("conf") >= least)
    return stored(near.where("_whole").drop("_whole").unionByName(read), near)


#: Most rows of a table of pairs or labels (a few numbers each) that is worked on in one partition, where nothing needs to be shuffled.
TOGETHER = 200_000


def _together(*tables: DataFrame):  # noqa: ANN202
    """How to read tables for joins among themselves: in one partition if all are small, as they are otherwise."""
    small = all(t.limit(TOGETHER + 1).count() <= TOGETHER for t in tables)
    return (lambda df: df.coalesce(1)) if small else (lambda df: df)


def neighbourhoods(links: DataFrame) -> DataFrame:
    """side, n, who: the neighbourhood of each node of a link graph (the least left node that it reaches).

    Least nodes pass over the links, and each round follows them twice as far, so a long chain takes few rounds."""
    at = _together(links)
    edges = at(links.select("l", "r"))
    left, done = edges.groupBy("l").agg(F.min("l").alias("who")), []
    reached = lambda left: edges.join(left, "l").groupBy("r").agg(F.min("who").alias("who"))
    while True:
        table = stored(edges.join(reached(left), "r").groupBy("l").agg(F.min("who").alias("who")).join(left.withColumnRenamed("who", "was"), "l"), *done)
        seen, done = at(table), [table]
        if seen.where("who <> was").isEmpty():
            break
        jump = seen.where("who <> l").select(F.col("l").alias("who"), F.col("who").alias("_w"))
        left = seen.select("l", "who").join(jump, "who", "left").select("l", F.coalesce("_w", "who").alias("who"))
    left = seen.select("l", "who")
    return stored(left.select(F.lit("l").alias("side"), F.col("l").alias("n"), "who").unionByName(reached(left).select(F.lit("r").alias("side"), F.col("r").alias("n"), "who")), table)


def propagate(scored: DataFrame) -> DataFrame:
    """side, n, who, tie of every node in a neighbourhood; tie is how firmly it is tied to it (its best pair)."""
    sure = scored.where(F.col("conf") >= ALONE)
    table = neighbourhoods(sure)
    one = _together(scored, table)
    who, sure = one(table), one(sure)
    ends = F.explode(F.array(F.struct(F.lit("l").alias("side"), F.col("l").alias("n")), F.struct(F.lit("r").alias("side"), F.col("r").alias("n"))))
    best = sure.select(ends.alias("e"), "conf").groupBy("e.side", "e.n").agg(F.max("conf").alias("tie"))
    out = stored(who.join(best, ["side", "n"]), table)
    at = lambda s: one(out).where(F.col("side") == s).select(F.col("n").alias(s), F.col("who").alias(f"w{s}"))
    u = one(scored).where(F.col("conf") < ALONE).join(at("l"), "l", "left").join(at("r"), "r", "left")
    # a and b: the neighbourhoods of both nodes; a node that is in none is one of its own
    u = stored(u.select("l", "r", "conf", "apart", F.coalesce("wl", "l").alias("a"), F.coalesce("wr", F.xxhash64(F.lit("r"), "r")).alias("b"), F.col("wl").isNotNull().alias("in_a"), F.col("wr").isNotNull().alias("in_b")).where("a <> b"))
    while not u.isEmpty():
        one = _together(u)
        between = one(u).groupBy("a", "b").agg(F.max(F.struct("conf", "l", "r", "apart", "in_a", "in_b")).alias("x"))
        sent = [between.groupBy(k).agg(F.sum("x.conf").alias(f"s{k}")) for k in ("a", "b")]
        s = F.col("conf")
        flow = s / F.col("sa") * s / F.col("sb")
        # two neighbourhoods that each have both sources stay apart: their own links speak against it
        flow = F.when((F.col("in_a") & F.col("in_b")) | F.col("apart"), 0.0).otherwise(flow)
        gained = s + GAIN * (1 - s) * (2 * flow - 1)
        joins = between.join(sent[0], "a").join(sent[1], "b").select("a", "b", "x.*", "sa", "sb").withColumn("tie", gained).where(F.col("tie") >= ALONE)
        joins = stored(joins.select("l", "r", "a", "b", "in_a", "in_b", "tie", F.when(F.col("in_b"), F.col("b")).otherwise(F.col("a")).alias("who")))
        if joins.isEmpty():
            break
        # as each side sends most to the other, none joins twice; what was a neighbourhood before keeps its name
        new = joins.select(F.explode(F.array(F.struct(F.lit("l").alias("side"), F.col("l").alias("n"), "who", "tie", F.col("in_a").alias("old")), F.struct(F.lit("r").alias("side"), F.col("r").alias("n"), "who", "tie", F.col("in_b").alias("old")))).alias("e")).select("e.*").where("NOT old").drop("old")
        out = stored(out.unionByName(new), out)
        moved = [one(joins).select(F.col(k).alias(f"_{k}"), F.col("who").alias(f"to_{k}")) for k in ("a", "b")]
        v = one(u).join(moved[0], F.col("a") == F.col("_a"), "left").join(moved[1], F.col("b") == F.col("_b"), "left")
        u = stored(v.select("l", "r", "conf", "apart", F.coalesce("to_a", "a").alias("a"), F.coalesce("to_b", "b").alias("b"), (F.col("in_a") | F.col("to_a").isNotNull()).alias("in_a"), (F.col("in_b") | F.col("to_b").isNotNull()).alias("in_b")).where("a <> b"), u, joins)
    free(u)
    return out


def link(left_rows: DataFrame, right_rows: DataFrame) -> DataFrame:
    """l_id, r_id, confidence_score: pairs of records of one publication."""
    rows = stored(left_rows.withColumn("side", F.lit("l")).unionByName(right_rows.withColumn("side", F.lit("r"))))
    bare = nodes(rows)
    every = weigh(bare)
    pairs = candidates(every)
    chance = CHANCE * math.log(max(math.prod(every.where(F.col("side") == s).count() for s in "lr"), 1))
    scored = compare(pairs, every, bare, SUPPORTED, chance)
    free(pairs)
    who = propagate(scored)
    one = _together(who, scored)
    side = lambda s: one(who).where(F.col("side") == s).select(F.col("n").alias(s), "who", F.col("tie").alias(f"{s}_tie"))
    sure = scored.where(F.col("conf") >= ALONE).drop("apart")
    inside = side("l").join(side("r"), "who").drop("who").join(one(sure.select("l", "r")), ["l", "r"], "left_anti")
    inside = stored(inside)
    own = compare(inside, every, bare, 0.0, chance, "l_tie", "r_tie")
    lifted = F.col("conf") + TIED * (1 - F.col("conf")) * F.col("l_tie") * F.col("r_tie")
    links = sure.unionByName(own.select("l", "r", lifted.alias("conf")).where(F.col("conf") >= ALONE))
    of = lambda s: rows.where(F.col("side") == s).select(F.col("node").alias(s), F.col("id").alias(f"{s}_id"))
    out = links.join(of("l"), "l").join(of("r"), "r")
    return out.select("l_id", "r_id", F.round(F.least(F.col("conf"), F.lit(1.0)), 4).alias("confidence_score")).distinct()


def match_publications(entries: DataFrame, works: DataFrame) -> DataFrame:
    """ord, work_id, confidence_score."""
    left = records(entries, "ord", F.col("title"), F.col("authors"), F.col("year"))
    names = F.transform("authorships", lambda a: a["author"]["display_name"])
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.col("display_name"))
    right = records(works, "work_id", title, names, F.col("publication_date"))
    return link(left, right).select(F.col("l_id").alias("ord"), F.col("r_id").alias("work_id"), "confidence_score")
