"""Benchmark decontamination with an Aho-Corasick automaton over normalised item windows.

Benchmark items and documents are normalised to words (A-Z lower-cased, ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``).
The automaton holds every run of 13 consecutive words of every item (all words, if an item has
fewer) as a sequence of word numbers; a document's words are numbered alike and scanned once.  What
is found are word positions, and the offsets of the words lead back to the original text.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import uuid
from collections.abc import Callable, Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, col, extended, fresh, mapped, pieces, small_or_hashed, stored, utf8
from .words import WORD_BYTES, words_of

WINDOW = 13
#: Bytes of benchmark text in one automaton; a larger benchmark is scanned in blocks of this size.  2 MB of items make
#: an automaton of some 340 MB, in 20 seconds, once in each Python worker.
BLOCK_BYTES = 2 << 20
_ORIGINAL_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


class Matcher:
    """The automaton of some items; finds hit words and the items whose windows occur."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        import ahocorasick

        self.number: dict[bytes, int] = {}
        held: dict[tuple[int, ...], set[str]] = {}
        for name, text in items:
            ids = tuple(self.number.setdefault(w, len(self.number) + 1) for w in words_of(text))
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                held.setdefault(ids[i : i + window], set()).add(name)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for ids, names in held.items():
            self.automaton.add_word(ids, (len(ids), tuple(sorted(names))))
        if held:
            self.automaton.make_automaton()
        self.any = bool(held)

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged ranges of hit words (end exclusive) and the items found."""
        ranges: list[tuple[int, int]] = []
        names: set[str] = set()
        if not self.any or not words:
            return ranges, names
        for end, (n, found) in self.automaton.iter(tuple(map(self.number.get, words, repeat(0)))):
            names.update(found)
            lo, hi = end - n + 1, end + 1
            while ranges and ranges[-1][1] >= lo:
                lo = min(lo, ranges.pop()[0])
            ranges.append((lo, hi))
        return ranges, names


def original_spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of words as offsets in code points of the original text."""
    if not ranges:
        return []
    at = [m.span() for m in _ORIGINAL_WORD.finditer(text)]
    return [(at[a][0], at[b - 1][1]) for a, b in ranges]


_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_HITS = T.StructType(
    [
        T.StructField("doc", T.LongType()),
        T.StructField("row", T.LongType()),
        T.StructField("ranges", T.ArrayType(T.ArrayType(T.IntegerType()))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)
_ADDED = (T.LongType(), T.LongType(), T.ArrayType(T.StringType()), _SPAN)
#: The automaton that this Python worker has built last, and the name of its block.
_built: dict[str, Matcher] = {}


def _matcher(name: str, items: list[tuple[str, str]], window: int) -> Matcher:
    if name not in _built:
        _built.clear()
        _built[name] = Matcher(items, window)
    return _built[name]


def _blocks(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[str, str]]]:
    """Items in blocks of about ``limit`` bytes; only one block is with the driver at a time."""
    block, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null and text is not null")
    for row in rows.toLocalIterator():
        if block and size + len(row.text) > limit:
            yield block
            block, size = [], 0
        block.append((row.item_id, row.text))
        size += len(row.text)
    if block:
        yield block


def _counted(raw: bytes, words: int, ranges: list[tuple[int, int]], names: list[str]) -> tuple:
    spans = [{"start": a, "end": b} for a, b in original_spans(raw.decode(), ranges)] if ranges else []
    return words, sum(b - a for a, b in ranges), names, spans


def _hits(docs: DataFrame, block: list[tuple[str, str]], window: int) -> DataFrame:
    """The texts (``doc``, ``row``, ``text``) in which items of one block occur, written out, so that the block can go."""
    name, shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(block)
    schema = arrow_schema(_HITS)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(name, shared.value, window)
        for batch in pieces(batches, "text"):
            found = [matcher.find(raw.translate(WORD_BYTES).split()) for raw in utf8(batch.column("text"))]
            some = pa.array([i for i, (ranges, _) in enumerate(found) if ranges], pa.int64())
            own = [found[i] for i in some.to_pylist()]
            more = [pa.array([r for r, _ in own], schema.field("ranges").type), pa.array([sorted(n) for _, n in own], schema.field("items").type)]
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(some), batch.column("row").take(some), *more], schema=schema)

    out = stored(mapped(docs, rows, _HITS), "decontaminate-hits")
    shared.destroy()
    return out


def with_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    names: tuple[str, str, str, str] = ("n_words", "n_hit", "items", "spans"),
) -> DataFrame:
    """``docs`` and how many words each text has, how many are hit, the sorted ids of items and the hit passages, called ``names``.

    A benchmark beyond ``block_bytes`` is scanned block by block; only hits are kept of each scan, and brought back to
    their texts in the end.
    """
    fields = [T.StructField(n, t) for n, t in zip(names, _ADDED, strict=True)]
    blocks = _blocks(benchmark, block_bytes)
    block, after = next(blocks, []), next(blocks, None)
    if after is None:
        name, shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(block)  # of block_bytes at most

        def one() -> Callable[[pa.RecordBatch, int], list]:
            matcher = _matcher(name, shared.value, window)

            def made(batch: pa.RecordBatch, at: int) -> list:
                out = []
                for raw in utf8(batch.column(at)):
                    words = raw.translate(WORD_BYTES).split()
                    ranges, which = matcher.find(words)
                    out.append(_counted(raw, len(words), ranges, sorted(which)))
                return list(zip(*out, strict=True)) or [[]] * 4

            return made

        return extended(docs, text_col, one, fields)
    last = F.lit((1 << 63) - 1)
    doc, row = F.coalesce(col(id_col).cast("long"), last), F.xxhash64(col(text_col))
    texts = docs.select(doc.alias("doc"), row.alias("row"), col(text_col).alias("text"))
    found = None
    for part in itertools.chain([block, after], blocks):
        hits = _hits(texts, part, window)
        found = hits if found is None else found.unionByName(hits)
    own = fresh(docs.columns, "doc", "row", "hits")
    # Texts are told apart by id and hash: rows that repeat both have the same hits, and count them once.
    whole = found.distinct().groupBy("doc", "row").agg(F.collect_list(F.struct("ranges", "items")).alias("hits")).toDF(*own)
    whole = stored(whole, "decontaminate-texts")
    width = whole.agg(F.max(F.aggregate(own[2], F.lit(0), lambda n, h: n + 24 * F.size(h["ranges"]) + 64 * F.size(h["items"])))).first()[0] or 0
    met = docs.withColumn(own[0], doc).withColumn(own[1], row).join(small_or_hashed(whole, 64 + width), own[:2], "left")

    def several() -> Callable[[pa.RecordBatch, int], list]:
        def made(batch: pa.RecordBatch, at: int) -> list:
            out = []
            for raw, parts in zip(utf8(batch.column(at)), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                ranges = _union([tuple(r) for p in parts or () for r in p["ranges"]])
                out.append(_counted(raw, len(raw.translate(WORD_BYTES).split()), ranges, sorted({x for p in parts or () for x in p["items"]})))
            return list(zip(*out, strict=True)) or [[]] * 4

        return made

    return extended(met.select(*map(col, [*docs.columns, own[2]])), text_col, several, fields).drop(col(own[2]))


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_hit``, ``items`` (sorted ids) and ``spans`` of every row of ``docs``.

    ``spans`` are the hit passages as code point offsets of the original text.  Null and empty
    texts have no words and no hits; texts of any length are read whole.  Items without text or id are passed over; an empty
    benchmark hits nothing.  Repeated rows and null ids come back as they are.  Other columns are never read, whatever
    their names.
    """
    own = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text"))
    return with_hits(own, benchmark, window=window, block_bytes=block_bytes).drop("text")


def _union(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def contaminated(n_words: str = "n_words", n_hit: str = "n_hit"):
    """The rule: some hit word, and at least one word in twenty hit."""
    return (col(n_hit) > 0) & (20 * col(n_hit) >= col(n_words))


def items_digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Hit words and items of every document, and whether it is contaminated."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


OP5_SQL = r"""
WITH words AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
items AS (SELECT id AS item_id, w, len(w) AS n FROM words WHERE kind = 'b' AND len(w) > 0),
windows AS (
  SELECT DISTINCT item_id, least(n, 13) AS size, array_to_string(w[i:i + least(n, 13) - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, greatest(n - 13, 0) + 2)) AS i FROM items)),
sizes AS (SELECT DISTINCT size FROM windows),
docs AS (SELECT id AS doc_id, w, len(w) AS n FROM words WHERE kind = 'd'),
places AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, n - size + 2)) AS i FROM docs, sizes WHERE n >= size)),
hits AS (SELECT p.doc_id, p.i, p.size, v.item_id FROM places p JOIN windows v ON p.win = v.win AND p.size = v.size),
hit_words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM hits) GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(t.names, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= d.n AS contaminated
FROM docs d LEFT JOIN hit_words h ON d.doc_id = h.doc_id LEFT JOIN hit_items t ON d.doc_id = t.doc_id
"""
