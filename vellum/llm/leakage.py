"""Evaluation texts leaking into training text: Wu-Manber multi-pattern search, then alignment.

Items and documents are brought to words (single characters in Han and Kana) without case, punctuation,
markup and invisible characters. Short word windows of all items are the patterns of a Wu-Manber
search: a table of block shifts skips impossible positions, buckets by suffix block choose candidate
patterns, direct comparison confirms them. Items with enough confirmed windows near each other are aligned with the
document there; a passage counts if ten words (20 characters) run on exactly, or if the aligned score says
so in spite of a few changed words and no other item explains the same place far better.

Items are a stated query set: they are taken in blocks bounded in items and characters, and each block is searched
in all documents in one scan without a shuffle. What depends on several items is settled over all of them: the opening
sentence that several items share, a stock question, is counted before they are cut into blocks and left out, and a
changed passage is given up for another item that explains its place far better after all blocks were searched.
So results don't depend on how the items fall into blocks.
Defined cases: NULL and empty texts leak nothing and are not leaked; an item shorter than ten words counts if all of
it is repeated; repeated items and documents each give their rows (rows of one item_id are no rivals of each other); whole
texts are searched; extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread, stored

#: Most items of a block, and most characters, which bounds what is sent to the tasks and kept by each; a longer item is a block.
BLOCK, BLOCK_CHARS = 5_000, 8_000_000
WORDS, CHARS = 10, 20
#: Words of a pattern, and characters in scripts without spaces.
WINDOW_WORDS, WINDOW_CHARS = 3, 6
#: Least length of a pattern, and length of a block of the shift table.
LEAST, SHIFT_BLOCK = 12, 4
#: Items that must share an opening sentence for it to be a stock question.
STOCK_ITEMS = 3
#: Words that may be put in or left out before the first and after the last confirmed window of a passage.
SLACK = 10
#: Score of an alignment with changes, per unit of the least passage.
ALIGNED = 0.8

_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー]")
_TOKEN = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー]|[\p{L}\p{M}\p{N}--[\p{Han}\p{Hiragana}\p{Katakana}ー]]+", regex.V1)
_NOISE = regex.compile(r"\\[A-Za-z]+|</?[A-Za-z][^<>]{0,200}>|&[a-z]{2,6};")
_INVISIBLE = regex.compile(r"[\p{Cf}\p{Mn}&&[\p{Cf}\u034F\uFE00-\uFE0F]]", regex.V1)
_OPENING = regex.compile(r"\s*[^.?!。？！]*[.?!。？！](?=\s|$)")


def tokens(text: str | None) -> list[str]:
    """Words of a text in one form, characters in Han and Kana."""
    if not text:
        return []
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    if "\\" in text or "<" in text or "&" in text:
        text = _NOISE.sub(" ", text)
    return _TOKEN.findall(text.lower())


def _openings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        opening, rest = [], []
        for t in b.column(1).to_pylist():
            m = _OPENING.match(t) if t else None
            m = m if m and m.end() < len(t.rstrip()) else None
            opening.append(m[0].strip() if m else None)
            rest.append(t[m.end() :] if m else None)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(opening, pa.string()), pa.array(rest, pa.string())], ["item_id", "text", "opening", "rest"])


def without_stock(eval_items: DataFrame) -> DataFrame:
    """item_id, text of all items, without the opening sentence where at least STOCK_ITEMS items have it."""
    rows = eval_items.select("item_id", "text").mapInArrow(_openings, "item_id bigint, text string, opening string, rest string")
    stock = rows.where("opening IS NOT NULL").groupBy("opening").agg(F.countDistinct("item_id").alias("n")).where(F.col("n") >= STOCK_ITEMS).select("opening", F.lit(True).alias("stock"))
    return rows.join(stock, "opening", "left").select("item_id", F.when(F.col("stock"), F.col("rest")).otherwise(F.col("text")).alias("text"))


def prepare(items: list[tuple[int, str | None]]) -> list[tuple[int, list[str]]]:
    """Words of each item that has any."""
    return [(i, ws) for i, t in items if (ws := tokens(t))]


class WuManber:
    """Search for many patterns at once; each pattern carries the (item, place) pairs it stands for."""

    def __init__(self, patterns: dict[str, list[tuple[int, int]]]):
        self.least = m = min(map(len, patterns))
        self.size = b = min(SHIFT_BLOCK, m)
        self.default = m - b + 1
        self.shift: dict[str, int] = {}
        self.buckets: dict[str, dict[str, list[tuple[str, list[tuple[int, int]]]]]] = defaultdict(lambda: defaultdict(list))
        for p, places in patterns.items():
            for j in range(m - b + 1):
                block = p[j : j + b]
                self.shift[block] = min(self.shift.get(block, self.default), m - b - j)
            self.buckets[p[m - b : m]][p[:m]].append((p, places))

    def search(self, s: str) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """Start of each occurrence and what the pattern stands for."""
        m, b, shift, default = self.least, self.size, self.shift.get, self.default
        pos, n = m, len(s)
        while pos <= n:
            step = shift(s[pos - b : pos], default)
            if step:
                pos += step
                continue
            for p, places in self.buckets[s[pos - b : pos]].get(s[pos - m : pos], ()):
                if s.startswith(p, pos - m):
                    yield pos - m, places
            pos += 1


def windows(items: list[tuple[int, list[str]]]) -> list[dict[str, list[tuple[int, int]]]]:
    """Patterns of all items: every window of words, lengthened to the least length where the item allows.

    Three sets, as the shortest pattern of a set bounds its shifts: windows of words, windows with a character of Han or
    Kana, and short ones."""
    out: list[dict[str, list[tuple[int, int]]]] = [defaultdict(list), defaultdict(list), defaultdict(list)]
    for k, (_, ws) in enumerate(items):
        for q in range(len(ws)):
            n = WINDOW_CHARS if _CJK.match(ws[q]) else WINDOW_WORDS
            while q + n < len(ws) and sum(map(len, ws[q : q + n])) + n + 1 < LEAST:
                n += 1
            if q + n <= len(ws) or q == 0:
                p = " " + " ".join(ws[q : q + n]) + " "
                out[1 if _CJK.search(p) else 2 if len(p) < LEAST else 0][p].append((k, q))
    return out


class Matcher:
    """Wu-Manber searches for the windows of a block's items."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        words, han, short = windows(items)
        self.words = [WuManber(p) for p in (words, short) if p]
        self.han = [WuManber(han)] if han else []

    def search(self, s: str) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """Start of each occurrence and what the pattern stands for."""
        for m in self.words:
            yield from m.search(s)
        if self.han and _CJK.search(s):
            for m in self.han:
                yield from m.search(s)


def align(a: list[str], b: list[str], change: float, least: int, most: int) -> tuple[float, int, int, int]:
    """Best local alignment of two word lists between the diagonals least and most (place in a less place in b): score, longest
    exact run, and its place in a."""
    width = len(b) + 1
    prev, pstart, prun = [0.0] * width, [0] * width, [0] * width
    best, run, where = 0.0, 0, (0, 0)
    gap = change + 0.2
    for i, x in enumerate(a):
        cur, start, runs = [0.0] * width, [i + 1] * width, [0] * width
        for j in range(max(1, i - most + 1), min(width, i - least + 2)):
            if x == b[j - 1]:
                s, st = prev[j - 1] + 1.0, pstart[j - 1] if prev[j - 1] > 0 else i
                runs[j] = r = prun[j - 1] + 1
                if r > run:
                    run = r
            else:
                s, st = prev[j - 1] - change, pstart[j - 1]
                if prev[j] - gap > s:
                    s, st = prev[j] - gap, pstart[j]
                if cur[j - 1] - gap > s:
                    s, st = cur[j - 1] - gap, start[j - 1]
            if s > 0:
                cur[j], start[j] = s, st
                if s > best:
                    best, where = s, (st, i + 1)
        prev, pstart, prun = cur, start, runs
    return best, run, *where


def _regions(hits: list[tuple[int, int]], length: int, least: int) -> Iterator[tuple[int, int, int, int]]:
    """Stretches of a document where an item could lie, from the places of its confirmed windows, and the first and last diagonal
    there: those of the windows with some words that were put in or left out."""
    starts = sorted(p - q for p, q in hits)
    slack, lo = length + 10, 0
    for k in range(1, len(starts) + 1):
        if k == len(starts) or starts[k] - starts[k - 1] > slack:
            if k - lo >= least:
                begin = max(0, starts[lo] - SLACK)
                yield begin, starts[k - 1] + length + SLACK, starts[lo] - SLACK - begin, starts[k - 1] + SLACK - begin
            lo = k


def leaks(matcher: Matcher, items: list[tuple[int, list[str]]], text: str | None) -> list[tuple[int, float, bool, int, int]]:
    """item_id, score, whether a passage is exact, and the place, of the items that a text may leak."""
    ws = tokens(text)
    s = " " + " ".join(ws) + " "
    hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
    offsets: list[int] = []
    for at, places in matcher.search(s):
        if not offsets:
            o = 0
            for w in ws:
                offsets.append(o)
                o += len(w) + 1
        p = bisect_right(offsets, at) - 1
        for k, q in places:
            hits[k].append((p, q))
    found = []
    for k, places in hits.items():
        item = items[k][1]
        cjk = bool(_CJK.match(item[len(item) // 2]))
        need = min(CHARS if cjk else WORDS, len(item))
        window = WINDOW_CHARS if cjk else WINDOW_WORDS
        best = (0.0, 0, 0, 0)
        for lo, hi, first, last in _regions(places, len(item), 1 if need <= 2 * window else 3 if cjk else 2):
            got = align(ws[lo:hi], item, 2.0 if cjk else 0.6, first, last)
            best = max(best, (got[0], got[1], lo + got[2], lo + got[3]))
        score, run, lo, hi = best
        if run >= need or score >= (need if cjk else ALIGNED * need):
            found.append((items[k][0], score, run >= need, lo, hi))
    return found


_FOUND = "doc_id bigint, same bigint, item_id bigint, score double, exact boolean, lo int, hi int"
_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.int32(), pa.int32())


def _scanner(block: list[tuple[int, str | None]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = prepare(block)
        matcher = Matcher(items)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if got := leaks(matcher, items, text):
                    same = xxhash.xxh64_intdigest(text) - (1 << 63)
                    rows += [(doc, same, *g) for g in got]
            cols = zip(*rows, strict=True) if rows else [()] * len(_KINDS)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS, strict=True)], [c.split()[0] for c in _FOUND.split(", ")])

    return run


def _blocks(rows: Iterable) -> Iterator[list[tuple[int, str | None]]]:
    block, size = [], 0
    for item_id, text in rows:
        n = len(text or "")
        if block and (len(block) >= BLOCK or size + n > BLOCK_CHARS):
            yield block
            block, size = [], 0
        block.append((item_id, text))
        size += n
    if block:
        yield block


def without_rivals(found: DataFrame) -> DataFrame:
    """doc_id, item_id of what was found, less changed passages at a place that another item explains far better."""
    other = found.select("doc_id", "same", F.col("item_id").alias("r_item"), F.col("score").alias("r_score"), F.col("lo").alias("r_lo"), F.col("hi").alias("r_hi"))
    loose = found.where("NOT exact").alias("f")
    shared = F.least("hi", "r_hi") - F.greatest("lo", "r_lo")
    rival = (F.col("f.doc_id") == F.col("o.doc_id")) & (F.col("f.same") == F.col("o.same")) & (F.col("r_item") != F.col("item_id")) & (F.col("r_score") > 1.5 * F.col("score")) & (shared > 0.5 * (F.col("hi") - F.col("lo")))
    kept = loose.join(other.alias("o"), rival, "left_anti").select("doc_id", "item_id")
    return found.where("exact").select("doc_id", "item_id").unionByName(kept)


def find(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """doc_id, item_id: each document with the items it leaks."""
    docs = spread(documents.select("doc_id", "text"))
    blocks = _blocks((r[0], r[1]) for r in without_stock(eval_items).toLocalIterator())
    parts = [docs.mapInArrow(_scanner(b), _FOUND) for b in blocks] or [documents.sparkSession.createDataFrame([], _FOUND)]
    return without_rivals(stored(reduce(DataFrame.unionByName, parts)))
