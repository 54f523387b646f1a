"""Line dedup with a once-seen and a twice-seen Bloom filter.

Three passes over the texts, none of which shuffles lines that occur once, but for the places of their bits:

1. lines are counted, which sets the size of the filters; then every task hashes its lines into bit positions and sends
   each segment of the two filters its own positions, four bytes per position; a segment's task sets a bit in *once*
   when it first comes up and in *twice* when it comes up again.  Only *twice* leaves the segments: a bitmap of
   ``FILTER_BITS`` to ``MAX_FILTER_BITS``, which is broadcast;
2. lines whose bits are all set in *twice* are suspected repeats.  Only they, as 16-byte digests with
   their document, are written out and grouped for exact confirmation (two documents at least) and
   the choice of the first document.  A full filter costs more suspects, never a wrong result;
3. each document gets the digests that it has to drop, and is put together again.  Documents that drop nothing
   stay where they are, as long as a list of the others is small enough to be broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, col, fits, fresh, mapped, pieces, stored, utf8

#: White space that is stripped at both ends of a line: space, and tab to carriage return.
STRIPPED = b" \t\n\x0b\x0c\r"
MIN_CHARS = 10
#: Bits of each filter for each line of the input, as a power of two between these bounds (16 and 128 MB).
LINE_BITS, FILTER_BITS, MAX_FILTER_BITS = 8, 1 << 27, 1 << 30
#: Bits of one segment of a filter, the work of one task.
SEGMENT_BITS = 1 << 19
HASHES = 2
_FLUSH = 1 << 20


def _key(line: bytes) -> bytes | None:
    key = line.strip(STRIPPED)
    n = len(key)
    if n < MIN_CHARS or (n < 4 * MIN_CHARS and len(key.decode("utf-8", "replace")) < MIN_CHARS):
        return None
    return key


def line_key(line: bytes) -> bytes | None:
    """The key that lines are compared by, or None if it is shorter than 10 code points."""
    return _key(line.lower())


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _document_digests(text: bytes) -> dict[bytes, None]:
    """Digests of the distinct keys of a text, in order of appearance."""
    return {_digest(k): None for x in text.lower().split(b"\n") if (k := _key(x)) is not None}


def _shape(bits: int) -> tuple[int, int]:
    """Segments of a filter, and bits of each."""
    return max(1, bits // SEGMENT_BITS), min(bits, SEGMENT_BITS)


def _places(digests: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The segment of each digest and its ``HASHES`` bit places within the segment."""
    raw = np.frombuffer(b"".join(digests), dtype="<u4").reshape(-1, 4)
    segments, width = _shape(bits)
    return (raw[:, 0] % np.uint32(segments)).astype(np.int32), (raw[:, 1 : 1 + HASHES] % np.uint32(width)).astype(np.uint32)


def _positions(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Bit places by segment: those that came up once in this task, and those that came up again."""

    def flush(digests: list[bytes]) -> pa.RecordBatch:
        segment, places = _places(digests, bits)
        out: dict[str, list] = {"segment": [], "once": [], "again": []}
        order = np.argsort(segment, kind="stable")
        found, cuts = np.unique(segment[order], return_index=True)
        for s, lo, hi in zip(found.tolist(), cuts, [*cuts[1:], len(order)], strict=True):
            values, counts = np.unique(places[order[lo:hi]].ravel(), return_counts=True)
            out["segment"].append(s)
            out["once"].append(values.astype("<u4").tobytes())
            out["again"].append(values[counts > 1].astype("<u4").tobytes())
        return pa.RecordBatch.from_pydict(out, schema=arrow_schema(_POSITIONS))

    held: list[bytes] = []
    for batch in batches:
        for text in utf8(batch.column(0)):
            held += _document_digests(text)
            if len(held) >= _FLUSH:
                yield flush(held)
                held = []
    if held:
        yield flush(held)


_POSITIONS = T.StructType(
    [T.StructField("segment", T.IntegerType()), T.StructField("once", T.BinaryType()), T.StructField("again", T.BinaryType())]
)
_SEGMENT = T.StructType([T.StructField("segment", T.IntegerType()), T.StructField("twice", T.BinaryType())])


def _merge(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """The twice-seen bitmap of every segment that this task was dealt."""
    width = _shape(bits)[1]
    once: dict[int, np.ndarray] = {}
    twice: dict[int, np.ndarray] = {}
    for batch in batches:
        for s, a, b in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if s not in once:
                once[s], twice[s] = np.zeros(width, dtype=bool), np.zeros(width, dtype=bool)
            new = np.frombuffer(a, dtype="<u4")
            twice[s][new[once[s][new]]] = True
            once[s][new] = True
            twice[s][np.frombuffer(b, dtype="<u4")] = True
    for s, found in twice.items():
        yield pa.RecordBatch.from_pydict(
            {"segment": [s], "twice": [np.packbits(found).tobytes()]}, schema=arrow_schema(_SEGMENT)
        )


def filter_bits(docs: DataFrame, text_col: str = "text") -> int:
    """Bits for the lines that ``docs`` has, counted; twice-seen places of lines seen once stay few."""
    text = col(text_col)
    lines = docs.agg(F.sum(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"))) + 1)).first()[0] or 1
    return min(MAX_FILTER_BITS, max(FILTER_BITS, 1 << (LINE_BITS * lines - 1).bit_length()))


def twice_filter(docs: DataFrame, text_col: str, bits: int) -> np.ndarray:
    """The twice-seen filter of all lines of ``docs`` as a row of packed bits for each segment."""
    segments, width = _shape(bits)
    spread = mapped(docs.select(col(text_col)), lambda b: _positions(b, bits), _POSITIONS)
    merged = mapped(spread.repartition("segment"), lambda b: _merge(b, bits), _SEGMENT)
    table = np.zeros((segments, -(-width // 8)), dtype=np.uint8)
    for row in merged.toLocalIterator():  # MAX_FILTER_BITS in all, a segment at a time
        table[row.segment] = np.frombuffer(row.twice, dtype=np.uint8)
    return table


_SUSPECTS = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("doc", T.LongType()), T.StructField("row", T.LongType())])


def suspects(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int | None = None) -> DataFrame:
    """(digest, doc, row) of every line that the twice-seen filter holds, once per row; ``row`` is a hash of its text."""
    bits = bits or filter_bits(docs, text_col)
    twice = docs.sparkSession.sparkContext.broadcast(twice_filter(docs, text_col, bits))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = twice.value
        for batch in batches:
            digests: list[bytes] = []
            counts = []
            for text in utf8(batch.column("text")):
                own = _document_digests(text)
                digests += own
                counts.append(len(own))
            if not digests:
                continue
            segment, places = _places(digests, bits)
            hit = np.ones(len(digests), dtype=bool)
            for j in range(HASHES):
                hit &= (table[segment, places[:, j] >> 3] >> (7 - (places[:, j] & 7)).astype(np.uint8)) & 1 == 1
            owner = pa.array(np.repeat(np.arange(len(counts)), counts)[hit])
            yield pa.RecordBatch.from_arrays(
                [pa.array([digests[i] for i in np.flatnonzero(hit)], pa.binary()), batch.column("doc").take(owner), batch.column("row").take(owner)],
                schema=arrow_schema(_SUSPECTS),
            )

    text = col(text_col)
    return mapped(docs.select(col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("row"), text.alias("text")), scan, _SUSPECTS)


def _with_drops(docs: DataFrame, drops: DataFrame, keys: list[str], dropped: str) -> DataFrame:
    """``docs`` and the digests that each row has to drop, or null.  ``drops`` is stored.

    Only texts that change are shuffled, as long as a list of their keys may be broadcast.
    """
    if not fits(drops.count(), 16):
        return docs.join(drops.hint("shuffle_hash"), keys, "left")
    named = F.broadcast(drops.select(*map(col, keys)))
    changed = docs.join(named, keys, "left_semi").join(drops.hint("shuffle_hash"), keys, "left")
    return docs.join(named, keys, "left_anti").withColumn(dropped, F.lit(None).cast("array<binary>")).unionByName(changed)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int | None = None, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """``docs`` with its texts rid of repeated lines, plus the numbers of lines and of dropped ones as ``counts``.

    A text is split at ``\\n``; null and empty texts are one empty line and come back as empty texts.
    Lines compare by their key (``[\\x20\\x09-\\x0D]`` stripped, A-Z lower-cased).  Keys of at least
    10 code points in at least 2 documents lose all their lines but those in the smallest id.  Other
    columns pass, whatever their names; own columns named like ``counts`` are replaced.

    Rows that share an id count as one document (a line repeated only there stays).  Rows without an
    id come after all ids and count as one document.  An empty table gives an empty table.  Texts of any length are
    read whole.
    """
    found = stored(suspects(docs, id_col, text_col, bits), "line-suspects")
    last = (1 << 63) - 1
    place = F.coalesce(F.col("doc"), F.lit(last))
    # Stored, so that both sides of the join come from plain shuffles: a line that a third of all documents have
    # makes one large partition, and Spark can split that only if nothing else depends on how it is dealt.
    owners = stored(
        found.groupBy("digest")
        .agg(F.min(place).alias("owner"), F.max(place).alias("other"))
        .where("owner <> other")
        .select("digest", "owner"),
        "line-owners",
    )
    kept = [c for c in docs.columns if c.lower() not in {n.lower() for n in counts}]
    doc, row, dropped = fresh(docs.columns, "doc", "row", "dropped")
    # Rows are told apart by id and text, so rows without an id do not meet in one place.
    drops = stored(
        found.join(owners, "digest")
        .where(place != F.col("owner"))
        .groupBy(place.alias(doc), F.col("row").alias(row))
        .agg(F.collect_set("digest").alias(dropped)),
        "line-drops",
    )
    keyed = docs.select(*map(col, kept), F.coalesce(col(id_col).cast("long"), F.lit(last)).alias(doc), F.xxhash64(col(text_col)).alias(row))
    # Spark does not pass columns with odd names (``a.b``) to Python: they go by number, and come back under their names.
    joined = _with_drops(keyed, drops, [doc, row], dropped).select(*map(col, [*kept, dropped])).toDF(*map(str, range(len(kept) + 1)))
    fields = [docs.schema[c] for c in kept]
    schema = T.StructType([*fields, *[T.StructField(c, T.LongType()) for c in counts]])
    at = kept.index(text_col)
    out_schema = arrow_schema(schema)

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, str(at), 16 << 20):
            texts, n_lines, n_dropped = [], [], []
            for raw, drops_ in zip(utf8(batch.column(at)), batch.column(len(kept)).to_pylist(), strict=True):
                total, gone = raw.count(b"\n") + 1, 0
                if drops_:
                    gone_keys, keep = set(drops_), []
                    for line in raw.split(b"\n"):
                        key = line_key(line)
                        if key is not None and _digest(key) in gone_keys:
                            gone += 1
                        else:
                            keep.append(line)
                    raw = b"\n".join(keep)
                texts.append(raw)
                n_lines.append(total)
                n_dropped.append(gone)
            arrays = [batch.column(i).cast(out_schema.field(i).type) for i in range(len(kept))]
            arrays[at] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(n_lines), pa.array(n_dropped)], schema=out_schema)

    return mapped(joined, rebuild, schema)


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Lines kept and dropped per document of ``documents``, and a digest of the kept text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH lines AS (
  SELECT doc_id, n, line,
         translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n
        FROM documents)),
owners AS (
  SELECT key, min(doc_id) AS owner FROM lines WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT l.*, o.owner IS NOT NULL AND o.owner <> l.doc_id AS gone
  FROM lines l LEFT JOIN owners o ON l.key = o.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines,
       CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
