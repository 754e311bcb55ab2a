"""Encoding of the whole corpus with a public byte-level BPE tokenizer, by recursive SQL in each partition.

Spark splits each text into words with the tokenizer's own pattern. In every partition an embedded DuckDB
holds the merge table and a dictionary of the words met so far. New words become token-position rows; a
recursive query joins neighbouring tokens to the merge table and contracts each word's leftmost pair of least
rank until no word has one; further places of that same pair are contracted in the same round, which cannot
differ, as a pair with the new token always ranks later. An ordered aggregation then puts each text's ids together. Words repeat far more
than they differ, so the recursion runs over few rows. Work is by row and nothing is shuffled; the dictionary
is emptied beyond a fixed size, which costs time only.

Defined cases: NULL and empty texts give an empty list; names of special tokens are ordinary text; texts are
encoded whole; repeated doc_ids each keep their row; extra columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The word pattern of the tokenizer family, a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words kept in a partition's dictionary, and words of texts taken through it at once.
MAX_WORDS, CHUNK = 400_000, 400_000
#: Token rows that enter one recursion.
SEED_ROWS = 60_000

CONTRACT = """
INSERT INTO dict
WITH RECURSIVE step(wid, pos, tok, open) AS (
  SELECT wid, pos, tok, true FROM seed
  UNION ALL
  SELECT wid, pos, CASE WHEN used THEN new ELSE tok END, least IS NOT NULL
  FROM (
    SELECT *, lag(used) OVER w AS eaten
    FROM (
      SELECT *, coalesce(rank = least AND (rn - max(CASE WHEN starts THEN rn END) OVER (PARTITION BY wid ORDER BY pos ROWS UNBOUNDED PRECEDING)) % 2 = 0, false) AS used
      FROM (
        SELECT *, rank = least AND coalesce(lag(rank) OVER w, -1) <> least AS starts
        FROM (
          SELECT s.*, m.rank, m.new, min(m.rank) OVER (PARTITION BY s.wid) AS least
          FROM (SELECT wid, pos, tok, lead(tok) OVER w AS nxt, row_number() OVER w AS rn FROM step WHERE open WINDOW w AS (PARTITION BY wid ORDER BY pos)) s
          LEFT JOIN merges m ON m.l = s.tok AND m.r = s.nxt)
        WINDOW w AS (PARTITION BY wid ORDER BY pos)))
    WINDOW w AS (PARTITION BY wid ORDER BY pos))
  WHERE eaten IS NULL OR NOT eaten
)
SELECT w.word, list(s.tok ORDER BY s.pos) FROM step s JOIN new_words w USING (wid) WHERE NOT s.open GROUP BY w.word
"""
DECODE = """
SELECT c.row, flatten(list(d.ids ORDER BY c.p)) AS ids
FROM (SELECT row, unnest(words) AS word, unnest(range(len(words))) AS p FROM chunk) c JOIN dict d USING (word) GROUP BY c.row
"""


def _byte_names() -> dict[str, int]:
    """The family's one-character names of bytes: printable ones stand for themselves, the others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_merges(path: str) -> tuple[np.ndarray, pa.Table]:
    """Token ids of single bytes, and the merge table (l, r, rank, new), from a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    ids = np.zeros(256, np.int32)
    for name, b in _byte_names().items():
        ids[b] = vocab[name]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    l, r, new = ([vocab[x] for x in xs] for xs in (*zip(*pairs, strict=True), [a + b for a, b in pairs]))
    return ids, pa.table({"l": pa.array(l, pa.int32()), "r": pa.array(r, pa.int32()), "rank": pa.array(range(len(l)), pa.int64()), "new": pa.array(new, pa.int32())})


def _encoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "preserve_insertion_order": False})
        byte_ids, merges = load_merges(path)
        con.register("merges_in", merges)
        con.execute("CREATE TABLE merges AS SELECT * FROM merges_in").fetchall()
        con.unregister("merges_in")
        con.execute("CREATE TABLE dict (word VARCHAR, ids INTEGER[])").fetchall()
        for batch in batches:
            doc, words = batch.column(0), batch.column(1)
            ends = np.cumsum(np.asarray(words.value_lengths().fill_null(0)))
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CHUNK, "right")))
                yield from _chunk(con, byte_ids, doc.slice(lo, hi - lo), words.slice(lo, hi - lo))
                lo = hi
        con.close()

    return run


def _chunk(con, byte_ids: np.ndarray, doc: pa.Array, words: pa.Array) -> Iterator[pa.RecordBatch]:
    if con.execute("SELECT count(*) FROM dict").fetchall()[0][0] > MAX_WORDS:
        con.execute("DELETE FROM dict").fetchall()
    con.register("chunk", pa.table({"row": pa.array(np.arange(len(doc))), "words": words}))
    fresh = con.sql("SELECT DISTINCT word FROM (SELECT unnest(words) AS word FROM chunk) ANTI JOIN dict USING (word)").to_arrow_table().column(0).to_pylist()
    fresh.sort(key=len)
    at = 0
    while at < len(fresh):
        part, rows = [], 0
        while at < len(fresh) and (not part or rows + len(fresh[at].encode()) <= SEED_ROWS):
            part.append(fresh[at])
            rows += len(part[-1].encode())
            at += 1
        raw = [w.encode() for w in part]
        n = np.fromiter(map(len, raw), np.int64, len(raw))
        wid = np.repeat(np.arange(len(raw)), n)
        pos = np.arange(len(wid)) - np.repeat(np.cumsum(n) - n, n)
        con.register("seed", pa.table({"wid": wid, "pos": pos, "tok": byte_ids[np.frombuffer(b"".join(raw), np.uint8)]}))
        con.register("new_words", pa.table({"wid": np.arange(len(raw)), "word": part}))
        con.execute(CONTRACT).fetchall()
        con.unregister("seed")
        con.unregister("new_words")
    got = con.sql(DECODE).to_arrow_table()
    con.unregister("chunk")
    order = np.full(len(doc), -1)
    rows = np.asarray(got.column("row"))
    order[rows] = np.arange(len(rows))
    ids = got.column("ids").combine_chunks().cast(pa.list_(pa.int32()))
    full = pa.concat_arrays([ids, pa.array([[]], pa.list_(pa.int32()))])
    yield pa.RecordBatch.from_arrays([doc, full.take(pa.array(np.where(order < 0, len(rows), order)))], ["doc_id", "ids"])


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def encode(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids: every text's token ids."""
    words = documents.select("doc_id", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"(?U){PATTERN}"), F.lit(0)).alias("words"))
    return words.mapInArrow(_encoder(path or default_path()), "doc_id bigint, ids array<int>")
