"""BibTeX text as records, and records as BibTeX text.

Files are read in pieces that end where a line begins with a closing brace, which is where a record ends, so a large file
is split among tasks. Records are taken apart in Arrow batches: braces may be nested to any depth, which no regular
expression of the engine follows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.ids import doi_parsed
from vellum.functions.text import escape_bibtex, extract_year, first_present, normalize_month, split_authors, split_keywords, strip_latex
from vellum.functions.urls import clean_field_url

#: Bits of a record's number: its file, the place of its piece in the file, its place in the piece.
FILE_BITS, PLACE_BITS, RECORD_BITS = 14, 33, 16

_HEAD = re.compile(r"@(?P<kind>\w+)\s*\{\s*(?P<key>[^\s,]+)\s*,")
_FOOT = re.compile(r"\n\s*\}")
_SCHEME = r"^(\w+):/+"
_MARKS = re.compile(r'[{}",]')
_ENCLOSED = (("{", "}"), ('"', '"'))
#: Names under which a field may stand; the first that says something counts. Fixed values.
ALIASES = {
    "title": ("title", "booktitle"), "author": ("author", "authors"), "year": ("year", "date"), "month": ("month",), "doi": ("doi",), "url": ("url", "link", "howpublished"), "abstract": ("abstract", "summary"),
    "keywords": ("keywords", "keyword"), "journal": ("journal", "journaltitle"), "volume": ("volume",), "pages": ("pages", "page"), "publisher": ("publisher",),
}


def read_text(spark: SparkSession, *paths: str, encoding: str = "UTF-8", first_file: int = 0) -> DataFrame:
    """path, file, place, value: text of files in pieces, each up to where a line begins with a closing brace, which it holds again.

    Pieces that are not UTF-8 are read as Latin-1, as is everything in another ``encoding``. Files are numbered in order of the given paths, then
    of their names."""
    raw = spark.read.option("lineSep", "\n}").text(list(paths)).select(F.regexp_replace("_metadata.file_path", _SCHEME, "$1:/").alias("path"), (F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).alias("place"), F.col("value").cast("binary").alias("b"))
    utf8 = F.is_valid_utf8(F.col("b").cast("string"))
    text = F.when(utf8, F.col("b").cast("string")).otherwise(F.decode("b", "ISO-8859-1")) if encoding.upper().replace("-", "") == "UTF8" else F.decode("b", encoding)
    names = [re.sub(_SCHEME, r"\1:/", f) for p in paths for f in sorted(spark.read.text(p).inputFiles())]
    numbers = spark.createDataFrame([(f, first_file + k) for k, f in enumerate(dict.fromkeys(names))], "path string, file int")
    return raw.join(numbers, "path").select("path", "file", "place", F.concat(text, F.lit("\n}")).alias("value"))


def without_comments(text: str) -> str:
    """Text without lines that begin with a per cent sign, unless they hold a link."""
    return "\n".join(line for line in text.split("\n") if "http" in line or not line.lstrip().startswith("%")) if "%" in text else text


def bare(value: str) -> str:
    """A field's value without the braces or quotation marks around it, white space squeezed."""
    value = value.strip()
    while any(value.startswith(a) and value.endswith(b) for a, b in _ENCLOSED):
        value = value[1:-1].strip()
    return " ".join(value.split())


def fields(body: str) -> dict[str, str]:
    """A record's fields by name in lower case, the last of a repeated one; those that say nothing are left out.

    A field ends at a comma outside of braces and quotation marks."""
    ends, depth, quoted = [], 0, False
    for m in _MARKS.finditer(body):
        mark = m[0]
        if mark == '"':
            quoted ^= depth == 0
        elif quoted:
            continue
        elif mark == ",":
            if depth == 0:
                ends.append(m.start())
        else:
            depth = max(depth + (1 if mark == "{" else -1), 0)
    out, start = {}, 0
    for end in [*ends, len(body)]:
        name, equals, value = body[start:end].partition("=")
        if equals and (value := bare(value)):
            out[name.strip().lower()] = value
        start = end + 1
    return out


def records(text: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """Type, key and fields of every record of a text; what stands between records is passed over, as are records without fields."""
    text, at = without_comments(text), 0
    while (head := _HEAD.search(text, at)) and (foot := _FOOT.search(text, head.end())):
        if found := fields(text[head.end() : foot.start()]):
            yield head["kind"].lower(), head["key"], found
        at = foot.end()


_PARSED = "path string, file int, place bigint, pos int, entry_type string, key string, raw_fields map<string,string>"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()))
    for b in batches:
        rows = [(path, file, place, k, *r) for path, file, place, text in zip(*(c.to_pylist() for c in b.columns), strict=True) for k, r in enumerate(records(text or ""))]
        cols = zip(*rows, strict=True) if rows else [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array([tuple(v.items()) for v in c] if pa.types.is_map(k) else c, k) for c, k in zip(cols, kinds, strict=True)], [c.split()[0] for c in _PARSED.split(", ")])


def parse(files: DataFrame) -> DataFrame:
    """path, file, place, pos, entry_type, key, raw_fields of every record in texts (path, value, and from ``read_text`` file and place)."""
    have = files.columns
    rows = files.select("path", F.col("file") if "file" in have else F.lit(0).alias("file"), F.col("place") if "place" in have else F.lit(0).cast("bigint").alias("place"), "value")
    return rows.mapInArrow(_parse, _PARSED)


def number() -> Column:
    """A record's number over all files, in order of files, places and records."""
    fits = (F.col("file") < 1 << FILE_BITS) & (F.col("place") < 1 << PLACE_BITS) & (F.col("pos") < 1 << RECORD_BITS)
    n = F.shiftleft(F.col("file").cast("bigint"), PLACE_BITS + RECORD_BITS) + F.shiftleft("place", RECORD_BITS) + F.col("pos")
    return F.when(fits, n).otherwise(F.raise_error(F.concat(F.lit("too many files or records to number: "), "path")).cast("bigint"))


def to_entries(parsed: DataFrame, source: str | None = None) -> DataFrame:
    """Entries of parsed records."""
    raw = F.col("raw_fields")
    pick = lambda name: first_present(*[F.trim(F.try_element_at(raw, F.lit(a))) for a in ALIASES[name]])
    text = lambda name: F.nullif(strip_latex(pick(name)), F.lit(""))
    return parsed.select(
        number().alias("ord"), "entry_type", "key", text("title").alias("title"), split_authors(pick("author")).alias("authors"), extract_year(pick("year")).alias("year"),
        normalize_month(pick("month")).alias("month"), F.nullif(doi_parsed(pick("doi")), F.lit("")).alias("doi"), F.nullif(clean_field_url(pick("url")), F.lit("")).alias("url"), text("abstract").alias("abstract"),
        split_keywords(pick("keywords")).alias("keywords"), text("journal").alias("journal"), text("volume").alias("volume"), text("pages").alias("pages"), text("publisher").alias("publisher"),
        F.lit(None).cast("timestamp").alias("discovery_date"), raw.alias("raw_fields"), F.lit(source).alias("source"),
    )


def load(spark: SparkSession, sources: list[tuple[str, str]]) -> DataFrame:
    """Entries of several files in order of preference, each with its source; files that are missing are left out."""
    from vellum.schemas import ENTRY

    out, files = spark.createDataFrame([], ENTRY), 0
    for path, tag in sources:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop):
            continue
        out = out.unionByName(to_entries(parse(read_text(spark, path, first_file=files)), tag))
        files += len(spark.read.text(path).inputFiles())
    return out


def with_field(entries: DataFrame, name: str) -> DataFrame:
    """Entries in which a field says something."""
    c = F.col(name)
    kind = dict(entries.dtypes)[name]
    return entries.where(F.size(c) > 0 if kind.startswith(("array", "map")) else (c != "" if kind == "string" else c.isNotNull()))


def by_type(entries: DataFrame, entry_type: str) -> DataFrame:
    """Entries of a type."""
    return entries.where(F.lower("entry_type") == entry_type.lower())


def by_key(entries: DataFrame, key: str) -> DataFrame:
    """The first entry with a key."""
    return entries.where(F.col("key") == key).orderBy("ord").limit(1)


def render(key: Column, title: Column, authors: Column, year: Column, doi: Column, url: Column, abstract: Column, note: Column) -> Column:
    """A record as BibTeX text; fields without a value are left out, the note is always there."""
    field = lambda name, c: F.when(F.coalesce(c != "", F.lit(False)), F.concat(F.lit(f"  {name} = {{"), escape_bibtex(c), F.lit("}")))
    always = F.concat(F.lit("  note = {"), escape_bibtex(note), F.lit("}"))
    body = F.concat_ws(",\n", field("title", title), field("author", F.array_join(authors, " and ")), field("year", year), field("doi", doi), field("url", url), field("abstract", abstract), always)
    return F.concat(F.lit("@article{"), key, F.lit(",\n"), body, F.lit("\n}\n"))


def append(rendered: DataFrame, path: str) -> None:
    """Append records as text, each after a blank line."""
    rendered.select(F.concat(F.lit("\n"), F.col("value")).alias("value")).write.mode("append").text(path)
