"""Sentence boundaries across languages and scripts, by semi-Markov dynamic programming over whole spans.

A text is cut at blank lines. In each piece, places where a sentence could end are found, and dynamic programming
chooses the sequence of spans with the greatest total score. A span is scored as a whole: how it closes (kind
of mark, abbreviation or number before it), how the next one opens (case, script, opening word), whether it cuts a
quotation or bracket, and its length.

A quotation or bracket that is closed within the piece weighs by the ends it holds, more than all of them together could
bring, so it is never torn, however long. Marks that are never closed, emoticons and list numbers bind nothing.
Spans of any length compete: from SHORT characters on, a span's length tells nothing beyond its number, so the best start
of each state of quotation is kept while going along, and only starts nearer than that are scored one by one. That
is exact and takes time in proportion to the text.

Defined cases: NULL and blank texts have no sentence; a piece without any end mark is one sentence; texts are
handled whole, in code points; repeated texts and doc_ids each give their rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import spread

#: Characters from which the length of a span tells nothing more.
SHORT = 12
#: Weight of cutting a quotation or bracket, and what each possible end in it adds; the most that an end can score is 7.
CUT, PER_END = 10.0, 4.0

#: Abbreviations that a name, number or further word follows. Fixed values.
BEFORE_MORE = frozenset(
    "dr prof mr mrs ms st sr sra srta fr hr hrn frl mme mlle mm no nos nr nrn núm num n fig figs eq eqs sect sec ch chap vol vols p pp pg pág págs art abb tab kap bd s z d h u vs v cf vgl ca approx aprox env ex ej ed eds hrsg ee bzw "
    "i.e e.g d.h z.b u.a p.ej op cit resp incl ggf sog bsp av j.-c gen col lt sgt rev hon gov sen rep capt cmdr maj "
    "ver рис с см проф т е г гг акад доц им ул стр табл гл напр тыс млн млрд डॉ प्रो श्री د م أ".split()
)
#: Abbreviations that may also close a sentence. Fixed values.
MAY_CLOSE = frozenset("etc usw др пр al inc ltd co corp jr ff f p.m a.m uu ee.uu u.k u.s d.c u.s.a e.u ph.d b.c a.d".split())
#: Abbreviations that are also words, and words that open a sentence after those. Fixed values.
ALSO_WORDS = frozenset("no art col gen es mm st".split())
OPENING = frozenset("The A An This That These Those It He She We They I In On But And However Der Die Das Ein Eine Es Er Sie Wir Le La Les Un Une Il Elle Nous El Los Las Una Ella".split())
#: German months, which a day number with a full stop goes before. Fixed values.
MONTHS = frozenset("januar jänner februar märz april mai juni juli august september oktober november dezember".split())

CJK = r"\p{Han}\p{Hiragana}\p{Katakana}"
#: A mark that can end a sentence with what closes around it, then what follows: spaces, or none in scripts without them.
_END = regex.compile(
    rf"""(?P<mark>[.!?]+|[。！？｡．؟۔।॥]+[.!?。！？]*|…+|[!?]+)(?P<close>(?:[\"'”’»)\]」』】〉》）〕]|“(?=[\s,.;:!?)–-]|$)|[\x20\xa0\u202f]»)*)(?:(?P<gap>\s+)|(?=(?P<tight>.))|$)""",
    regex.X | regex.S,
)
_BLANK = regex.compile(r"\r?\n[^\S\n]*\r?\n\s*|[ \u0085\f]\s*")
_THAI_GAP = regex.compile(r"(?<=\p{Thai}\S{0,40})\s+(?=\S)|\s+(?=\p{Thai})")
_WORD = regex.compile(rf"[^\s\"'“”«»(\[„‘’「」『』（）。！？!?、，{CJK}]*$")
_LAST_PART = regex.compile(r"(?<=\p{L}{3}[.!?])(?=\p{Lu})")
_PAIRS = {"(": ")", "[": "]", "「": "」", "『": "』", "（": "）", "【": "】", "«": "»", "《": "》", "„": "“”", "“": "”"}
_QUOTES = regex.compile("[" + regex.escape("".join({*_PAIRS, *_PAIRS.values()}) + '"') + "]")
_LOWER_OPENER = regex.compile(r"doi:|https?:|www\.|[a-z]\p{Lu}|[#@]\w")
_THAI = regex.compile(r"\p{Thai}")
_CASELESS = regex.compile(rf"[{CJK}\p{{Thai}}\p{{Arabic}}\p{{Devanagari}}\p{{Hebrew}}]")
#: Two sentences whose space was lost: a word in lower case before the mark, a capitalised or quoted one after it.
_RUN_ON = regex.compile(r"(?:\p{L}{3,}|[\p{Nd}%)\]])\|[\"'“„«(]*(?:\p{Lu}\p{Ll}|\p{Lu} |\p{Lu}')")
_DOTTED = regex.compile(r"(?:\p{L}\.)+\p{L}|\p{L}\.-\p{L}")
_DAY = regex.compile(r"\d{1,2}")
_HAN_KANA = regex.compile(rf"[{CJK}]")
_FIRST = regex.compile(r"\p{L}*")
_TIGHT = regex.compile(rf"[{CJK}“「『（《#\p{{Lu}}\d\"]")


def _opens(text: str, i: int) -> bool | None:
    """Whether a mark that can stand on either side opens by what is around it; None if both would do."""
    before, after = text[i - 1 : i], text[i + 1 : i + 2]
    left, right = not before or before.isspace() or before in _PAIRS or before in "-–—", bool(after) and not after.isspace() and after not in ".,;:!?)]"
    return left if left == right else None


def _quotations(text: str) -> tuple[list[tuple[int, int]], dict[int, int]]:
    """(start, end) of outermost quotations and brackets that are closed, in order, and where each one that closes was opened."""
    stack: list[tuple[str, int]] = []
    opened: dict[int, int] = {}
    outer: list[tuple[int, int]] = []
    for m in _QUOTES.finditer(text):
        c, i = m[0], m.start()
        if c in "()" and text[max(0, i - 2) : i].rstrip("-'")[-1:] in (":", ";"):
            continue  # an emoticon
        if c in '"«»':
            side = _opens(text, i)
            closer = "»" if c == "«" else "«" if c == "»" else c
            closes = [k for k, (want, _) in enumerate(stack) if c in want]
            opens = side if side is not None else (not closes if c != "»" else False)
            if opens:
                if c == '"':  # one that was not closed before the next opens binds nothing
                    stack = [x for x in stack if x[0] != '"']
                stack.append((closer, i))
                continue
        want = next((k for k in range(len(stack) - 1, -1, -1) if c in stack[k][0]), None)
        if want is not None:
            opened[i + 1] = stack[want][1]
            while outer and outer[-1][0] > stack[want][1]:
                outer.pop()
            outer.append((stack[want][1], i + 1))
            del stack[want:]
        elif c in _PAIRS:
            stack.append((_PAIRS[c], i))
    return outer, opened


def _close_open(text: str, m: regex.Match) -> float | None:
    """Score of ending a sentence at a mark and opening the next after it; None if it can't end there."""
    mark, close, tight = m["mark"], m["close"], m["tight"]
    after = text[m.end() : m.end() + 24]
    if not after:
        return None
    last = mark[-1]
    if tight is not None:
        if last in "。！？｡．":
            pass
        elif last in "!?" and (_CASELESS.match(tight) or (_TIGHT.match(tight) and _CASELESS.search(text[max(0, m.start() - 3) : m.start()]))):
            pass
        elif last == "." and close and _CASELESS.match(tight):
            pass
        elif last == "." and _HAN_KANA.match(tight) and _HAN_KANA.match(text[max(0, m.start() - 1) : m.start()]):
            pass
        elif last in "؟۔।॥":
            pass
        elif _RUN_ON.search(text[max(0, m.start() - 12) : m.start()] + "|" + text[m.end() : m.end() + 12]):
            pass
        else:
            return None
        if tight in "、，,;；:：。．.！？!?)）」』”’»]】》…~～·・—–-":
            return None
    nxt = after[0]
    # how the next one opens
    if nxt.islower():
        opens = 1.0 if _LOWER_OPENER.match(after) else -8.0
    elif nxt.isupper():
        opens = 3.0
    elif nxt in "\"“„«「『‘'¿¡([（#@<":
        opens = 2.5
    elif nxt.isdigit():
        opens = 0.5
    elif _CASELESS.match(nxt):
        opens = 2.5
    elif nxt in "—–-,;:)]»…":
        opens = -8.0
    else:
        opens = 1.0
    # how this one closes
    if last in "。！？｡．؟۔।॥":
        closes = 4.0
        if close and nxt in "とだでのはがをにもや":
            closes = -8.0
    elif last in "!?":
        closes = 3.0
        if close and nxt == "と":
            closes = -8.0
    elif last == "…" or mark.startswith(".."):
        closes = -1.0 if not _CASELESS.match(nxt) else -8.0
        if close:
            closes = 2.0
    else:
        word = _WORD.search(text[max(0, m.start() - 40) : m.start()])[0].lstrip("\ufeff\u200b")
        word = _LAST_PART.split(word)[-1]
        bare = word.lower()
        closes = 2.5
        if close and close[0] in ")]）" and word:
            closes = 2.5
        elif not word:
            closes = 1.0 if close else -6.0
        elif bare in MAY_CLOSE:
            closes = 0.5
        elif bare in BEFORE_MORE:
            closes = 1.0 if word in ALSO_WORDS and _FIRST.match(after)[0] in OPENING else -8.0
        elif len(word) == 1 and word.isalpha():
            closes = -8.0 if not _CASELESS.match(word) else -4.0
        elif "." in word and _DOTTED.fullmatch(word):
            closes = -2.0
        elif _DAY.fullmatch(word) and _FIRST.match(after)[0].lower() in MONTHS:
            closes = -8.0
    return closes + opens


def _commented(text: str, start: int, nxt: str) -> bool:
    """Whether a quotation that stands at a sentence's start is followed by who says it, in scripts without capitals."""
    before = text[max(0, start - 4) : start].rstrip()
    return bool(_CASELESS.match(nxt)) and (not text[:start].strip() if start < 4 else not before or before[-1] in "。！？.!?…”」』»\"؟।")


def _fits(text: str, start: int, end: int) -> float:
    """The length term of a span: one without a letter is none, and very short ones are rare. Past SHORT characters it depends on the start only."""
    if not any(c.isalpha() for c in text[start : min(end, start + SHORT)]):
        return -8.0
    return -1.0 if end - start < 4 else 0.0


def _places(text: str) -> tuple[list[int], list[int], list[float], list[int], list[float]] | None:
    """Where a sentence of a piece may end, where the next one starts, what the end scores, the quotation it lies in (-1: none) and what
    cutting that costs; the piece's start and end are the first and last place. None without a place in between."""
    n = len(text)
    cands: dict[int, tuple[float, int]] = {}
    outer, opened = _quotations(text)
    for m in _END.finditer(text):
        if (s := _close_open(text, m)) is not None:
            end = m.end("close")
            if m["close"] and end in opened and _commented(text, opened[end], text[m.end() : m.end() + 1]):
                s -= 12.0
            if s > -5.0:
                cands[end] = (s, m.end())
    if _THAI.search(text):
        for m in _THAI_GAP.finditer(text):
            cands[m.start()] = (6.0, m.end())
    if not cands:
        return None
    ends = sorted(cands)
    at = [0, *ends, n]
    score = [0.0, *(cands[e][0] for e in ends), 0.0]
    starts = [0, *(cands[e][1] for e in ends), n]
    within, inner, q = [], [0] * len(outer), 0
    for p in at:
        while q < len(outer) and outer[q][1] <= p:
            q += 1
        within.append(q if q < len(outer) and outer[q][0] < p else -1)
        if within[-1] >= 0:
            inner[q] += 1
    return at, starts, score, within, [CUT + PER_END * inner[w] if w >= 0 else 0.0 for w in within]


def piece_ends(text: str) -> list[int]:
    """Ends of the sentences of a piece without blank lines or outer spaces."""
    places = _places(text)
    if places is None:
        return [len(text)]
    at, starts, score, within, cost = places
    best, back = [0.0] + [0.0] * (len(at) - 1), [0] * len(at)
    # best starts so far that lie SHORT characters back: of the quotation one is in, and of all less the cost of cutting theirs
    same, free, k = {}, (float("-inf"), 0), 0
    for j in range(1, len(at)):
        while k < j and starts[k] + SHORT <= at[j]:
            value = best[k] + _fits(text, starts[k], starts[k] + SHORT)
            if value > same.get(within[k], (float("-inf"), 0))[0]:
                same[within[k]] = (value, k)
            free = max(free, (value - cost[k], k))
            k += 1
        top, i = same.get(within[j], (float("-inf"), 0))
        top, i = max((top, i), (free[0] - cost[j], free[1]))
        for near in range(k, j):
            value = best[near] + _fits(text, starts[near], at[j]) - (0.0 if within[near] == within[j] else cost[near] + cost[j])
            if value > top:
                top, i = value, near
        best[j], back[j] = top + score[j], i
    out, j = [], len(at) - 1
    while j > 0:
        out.append(at[j])
        j = back[j]
    return out[::-1]


def sentence_ends(text: str | None) -> list[int]:
    """end_pos of every sentence of a text."""
    if not text or not text.strip():
        return []
    out, at = [], 0
    for m in [*_BLANK.finditer(text), None]:
        piece = text[at : m.start() if m else len(text)]
        body = piece.strip()
        if body:
            off = at + len(piece) - len(piece.lstrip())
            out += [off + len(body[:e].rstrip()) for e in piece_ends(body)]
        at = m.end() if m else len(text)
    return out


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, ends = [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            got = sentence_ends(text)
            ids += [doc] * len(got)
            ends += got
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ends, pa.int32())], ["doc_id", "end_pos"])


def split(documents: DataFrame) -> DataFrame:
    """doc_id, end_pos: one row for each sentence."""
    return spread(documents.select("doc_id", "text")).mapInArrow(_run, "doc_id bigint, end_pos int")
