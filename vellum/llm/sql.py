"""SQL that checks queries of this subpackage on whole tables, written apart from the operators."""

from __future__ import annotations

#: Letters that look like Latin ones, and those, as text of its own: Cyrillic, Greek, Armenian, Latin.
_LOOK = "авекмнорстухіјѕһԁԛԝүѵӏАВЕКМНОРСТУХІЈЅҺԀԚԜҮѴӀορνιαυκτχΑΒΕΖΗΙΚΜΝΟΡΤΥΧıɡɑȷօսհցоѐёӓӑӗйӥӧӱӯӳЀЁӒӐӖ"
_LIKE = "abekmhopctyxijshdqwyvlABEKMHOPCTYXIJSHDQWYVLopviauktxABEZHIKMNOPTYXigajouhgoèëäăĕйӥöӱӯӳÈËÄĂĔ"
_GONE = "[\\p{Cf}\\x{34F}\\x{115F}\\x{1160}\\x{17B4}\\x{17B5}\\x{180B}-\\x{180F}\\x{3164}\\x{FFA0}\\x{FE00}-\\x{FE0F}\\x{E0100}-\\x{E01EF}\\x00-\\x08\\x0E-\\x1F\\x7F-\\x9F]"


def _visual(c: str) -> str:
    """Full-width and mathematical letters by their numbers, look-alikes by the text above, ligatures written out, accents composed."""
    number = "unicode(x)"
    wide = f"CASE WHEN {number} BETWEEN 65281 AND 65374 THEN chr({number} - 65248) WHEN {number} BETWEEN 119808 AND 120483 THEN chr(CASE WHEN ({number} - 119808) % 52 < 26 THEN 65 ELSE 71 END + ({number} - 119808) % 52) WHEN {number} BETWEEN 120782 AND 120831 THEN chr(48 + ({number} - 120782) % 10) ELSE x END"
    out = f"array_to_string(list_transform(string_split(regexp_replace({c}, '{_GONE}', '', 'g'), ''), lambda x: {wide}), '')"
    for lig, to in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"), ("ĳ", "ij"), ("Ĳ", "IJ"), ("ǆ", "dž"), ("ǉ", "lj"), ("ǌ", "nj"), ("ⅱ", "ii"), ("ⅲ", "iii"), ("ⅳ", "iv"), ("Ⅱ", "II"), ("Ⅲ", "III"), ("Ⅳ", "IV"), ("ⅰ", "i"), ("ⅴ", "v"), ("ⅹ", "x"), ("Ⅰ", "I"), ("Ⅴ", "V"), ("Ⅹ", "X")):
        out = f"replace({out}, '{lig}', '{to}')"
    return f"nfc_normalize(regexp_replace(lower(translate(nfc_normalize(translate({out}, '{_LOOK}', '{_LIKE}')), '{_LOOK}', '{_LIKE}')), '[\\s\\p{{Z}}\\p{{P}}]+', '', 'g'))"


_TITLES = f"""t AS (SELECT ord, title FROM entries UNION ALL SELECT ord, title FROM resolved_papers),
 v AS (SELECT ord, title, regexp_replace(lower(title), '[ \\t\\n\\r\\x0B\\f\\p{{P}}]+', '', 'g') AS plain, regexp_replace(regexp_replace(translate(lower(title), '‐‑﹣－', '①②③④'), '[ \\t\\n\\r\\x0B\\f]+', '', 'g'), '[^\\P{{P}}-]+', '', 'g') AS hyphens, {_visual('title')} AS visual FROM t WHERE title IS NOT NULL),
 w AS (SELECT *, translate(hyphens, '①②③④', '----') AS level FROM v WHERE visual <> '')"""

_NAME = "regexp_replace(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"
_TAGS = "'</?[A-Za-z][^<>]{0,200}>'"
_ABSTRACT = f"""trim(regexp_replace(trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(coalesce(abstract, ''), {_TAGS}, ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'),
 {_TAGS}, ' ', 'g'), '[\\s\\p{{Z}}]+', ' ', 'g')), '^(?i:abstract|summary)(?:\\s*[:.\\-–—]\\s*|\\s+([^a-z]))', '\\1'))"""

_PARTS = "list_sort(list_filter(string_split_regex(lower(coalesce(a, '')), '[\\s\\p{Z}\\p{P}]+'), lambda t: t <> ''))"
_CANON = f"""e AS (SELECT ord, title, authors, year, doi FROM entries UNION ALL SELECT ord, title, authors, year, doi FROM resolved_papers),
 c AS (SELECT ord, title, authors, year, doi, regexp_replace(lower(coalesce(title, '')), '[\\s\\p{{Z}}\\p{{P}}]+', '', 'g') AS c_title,
  array_to_string(list_filter(list_transform(coalesce(authors, []), lambda a: array_to_string({_PARTS}, '')), lambda n: n <> ''), '|') AS c_authors,
  regexp_replace(lower(coalesce(year, '')), '[\\s\\p{{Z}}\\p{{P}}]+', '', 'g') AS c_year,
  regexp_replace(lower(CASE WHEN regexp_matches(bare, '10\\.\\d{{4,9}}/') THEN regexp_extract(bare, '10\\.\\d{{4,9}}/.*$') ELSE bare END), '[\\s\\p{{Z}}\\p{{P}}]+', '', 'g') AS c_doi
  FROM (SELECT *, regexp_replace(coalesce(doi, ''), '[\\s\\p{{Z}}]+', '', 'g') AS bare FROM e)),
 k AS (SELECT * FROM c WHERE c_authors <> '' OR c_doi <> '')"""

_RANKED = f"""p AS (SELECT s, max(trust) AS trust FROM (SELECT {_NAME.format('source')} AS s, trust FROM providers UNION ALL SELECT {_NAME.format('display_name')}, trust FROM providers) GROUP BY 1),
 a AS (SELECT *, {_ABSTRACT} AS body FROM enriched WHERE key IS NOT NULL),
 r AS (SELECT a.*, CASE WHEN {_NAME.format('body')} IN ('', 'na', 'nan', 'nil', 'null', 'none', 'noabstract', 'noabstractavailable', 'abstractnotavailable', 'abstractunavailable', 'notavailable', 'abstract', 'tba', 'tbd', 'unknown', 'undefined') THEN 0
   WHEN regexp_matches(body, '(?i)(\\.\\.\\.|…|\\[(truncated|…|\\.\\.\\.)\\])[\\s\\p{{Pe}}\\p{{Pf}}"'']*$') OR NOT regexp_matches(body, '[.!?。！？।][\\s\\p{{Pe}}\\p{{Pf}}"''”’]*$') THEN 1 ELSE 2 END AS r1,
   CASE WHEN confidence_score BETWEEN 0 AND 1 AND NOT isnan(confidence_score) THEN confidence_score ELSE -1 END AS r2, CASE WHEN citation_count >= 0 THEN 1 ELSE 0 END AS r3, coalesce(p.trust, 0) AS r4, coalesce(epoch_us(fetched_at), -4611686018427387904) AS r5
  FROM a LEFT JOIN p ON p.s = {_NAME.format('a.source')})"""
#: Every choice of a DOI and a preprint id, and for each bundle the best of all rows that agree with both.
_FIELDS = {"identity": ("doi", "doi_url", "url", "arxiv_url", "pdf_url", "is_open_access"), "text": ("abstract",), "people": ("authors",), "publication": ("publication_date", "venue"), "impact": ("citation_count", "reference_count"), "topics": ("keywords", "subjects"), "provenance": ("source", "confidence_score", "fetched_at")}
_SAYS = {"authors": "len(authors) > 0", "keywords": "len(keywords) > 0", "subjects": "len(subjects) > 0", "citation_count": "citation_count >= 0", "reference_count": "reference_count >= 0", "is_open_access": "is_open_access IS NOT NULL", "confidence_score": "confidence_score IS NOT NULL", "fetched_at": "fetched_at IS NOT NULL"}


def _worth(b: str) -> str:
    says = "r1" if b == "text" else "2 * (" + " + ".join(f"coalesce({_SAYS.get(f) or _NAME.format(f) + chr(32) + chr(60) + chr(62) + chr(32) + chr(39) * 2}, false)::int" for f in _FIELDS[b]) + ")"
    return f"({says}) * ((r4 + 1) * 1000000 + round(greatest(r2, 0) * 1000000)::bigint) AS t_{b}"


def _best(b: str, rows: str, by: str) -> str:
    return f"{b} AS (SELECT {by}, arg_max(enr_id, {{'v': t_{b}, 't': r5, 'i': -enr_id}}) AS {b}_from, max(t_{b}) AS v_{b} FROM {rows} GROUP BY {by})"


_BOUND, _FREE = ("identity", "publication", "impact"), ("text", "people", "topics", "provenance")
_SURVIVORS = f"""{_RANKED}, t AS (SELECT *, nullif(regexp_extract(lower(regexp_replace(doi, '[\\s\\p{{Z}}]+', '', 'g')), '10\\.\\d{{4,9}}/\\S+'), '') AS d, nullif(regexp_extract(lower(arxiv_url), '\\d{{4}}\\.\\d{{4,5}}|[a-z-]+(?:\\.[a-z]{{2}})?/\\d{{7}}'), '') AS x, {', '.join(map(_worth, _FIELDS))} FROM r),
 ds AS (SELECT DISTINCT key, d FROM t WHERE d IS NOT NULL UNION ALL SELECT key, '' FROM t GROUP BY key HAVING count(d) = 0),
 br AS (SELECT ds.key, ds.d AS bd, t.* EXCLUDE (key) FROM ds JOIN t ON t.key = ds.key AND (t.d IS NULL OR t.d = ds.d)),
 xs AS (SELECT DISTINCT key, bd, x FROM br WHERE x IS NOT NULL UNION ALL SELECT key, bd, '' FROM br GROUP BY key, bd HAVING count(x) = 0),
 lf AS (SELECT xs.x AS bx, br.* FROM xs JOIN br ON br.key = xs.key AND br.bd = xs.bd AND (br.x IS NULL OR br.x = xs.x)),
 {', '.join(_best(b, 'lf', 'key, bd, bx') for b in _BOUND)}, {', '.join(_best(b, 't', 'key') for b in _FREE)},
 ch AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY v_identity + v_publication + v_impact DESC, bd DESC, bx DESC) AS rn FROM identity JOIN publication USING (key, bd, bx) JOIN impact USING (key, bd, bx)) WHERE rn = 1)"""

SQL: dict[str, str] = {
    "p2_found": f"""WITH {_TITLES}, m AS (SELECT visual FROM w GROUP BY 1 HAVING min(hyphens) <> max(hyphens)), x AS (SELECT w.* FROM w JOIN m USING (visual))
 SELECT a.ord AS ord_a, b.ord AS ord_b FROM x a JOIN x b ON a.visual = b.visual AND a.ord < b.ord AND (a.plain <> b.plain OR (a.hyphens <> b.hyphens AND a.level = b.level))""",
    "p2_canonical": f"""WITH {_TITLES}, n AS (SELECT visual, title, count(*) AS n FROM w GROUP BY 1, 2),
 f AS (SELECT visual, first(title ORDER BY length(regexp_replace(title, '[\\x00-\\x7F]', '', 'g')), n DESC, title) AS canonical FROM n GROUP BY 1)
 SELECT t.ord, t.title, f.canonical FROM t LEFT JOIN w USING (ord) LEFT JOIN f USING (visual)""",
    "p3_found": f"""WITH {_RANKED}
 SELECT x.key, x.enr_id FROM r x WHERE EXISTS (SELECT 1 FROM r y WHERE y.key = x.key AND y.enr_id <> x.enr_id)
  AND NOT EXISTS (SELECT 1 FROM r y WHERE y.key = x.key AND y.enr_id <> x.enr_id AND (y.r1 > x.r1 OR y.r2 > x.r2 OR y.r3 > x.r3 OR y.r4 > x.r4 OR y.r5 > x.r5 OR (y.r1 = x.r1 AND y.r2 = x.r2 AND y.r3 = x.r3 AND y.r4 = x.r4 AND y.r5 = x.r5)))""",
    "p3_survivors": f"""WITH {_SURVIVORS}, lead AS (SELECT x.key, x.enr_id FROM r x WHERE EXISTS (SELECT 1 FROM r y WHERE y.key = x.key AND y.enr_id <> x.enr_id)
  AND NOT EXISTS (SELECT 1 FROM r y WHERE y.key = x.key AND y.enr_id <> x.enr_id AND (y.r1 > x.r1 OR y.r2 > x.r2 OR y.r3 > x.r3 OR y.r4 > x.r4 OR y.r5 > x.r5 OR (y.r1 = x.r1 AND y.r2 = x.r2 AND y.r3 = x.r3 AND y.r4 = x.r4 AND y.r5 = x.r5))))
 SELECT ch.key, (SELECT count(*) FROM t WHERE t.key = ch.key) AS n_rows, lead.enr_id AS lead_enr_id, (v_identity + v_publication + v_impact + v_text + v_people + v_topics + v_provenance)::bigint AS trust,
  {', '.join((f"array_to_string(f_{b}.{f}, '|') AS {f}" if f in ('authors', 'keywords', 'subjects') else f"epoch_us(f_{b}.{f}) AS {f}" if f == 'fetched_at' else f"f_{b}.{f} AS {f}") for b, fs in _FIELDS.items() for f in fs)}
 FROM ch {' '.join(f'JOIN {b} USING (key)' for b in _FREE)} LEFT JOIN lead USING (key) {' '.join(f'JOIN enriched f_{b} ON f_{b}.enr_id = {b}_from' for b in _FIELDS)}""",
    "p5_found": f"""WITH {_CANON}, g AS (SELECT ord, min(ord) OVER (PARTITION BY c_title, c_authors, c_year, c_doi) AS ord_first FROM k) SELECT ord_first, ord AS ord_copy FROM g WHERE ord <> ord_first""",
    "p5_records": f"""WITH {_CANON} SELECT c_title, c_authors, c_year, c_doi, min(ord) AS ord_first, count(*) AS copies, count(DISTINCT (title, authors, year, doi)) AS spellings FROM k GROUP BY 1, 2, 3, 4""",
}
