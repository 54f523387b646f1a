"""N-gram Jaccard self-join of documents by MinHash banding.

1. One pass makes each document's set of five-word shingles, a digest of the set and ``BANDS`` band
   hashes of ``ROWS`` minima each.  Documents with equal sets form a *class*; from then on its smallest id stands for it.
2. Classes meet in buckets (band, hash).  A bucket is not turned into pairs: its members are dealt to
   blocks of ``BLOCK`` members, and each two blocks meet in one bounded task group, however large the bucket is.
3. There full shingle sets are intersected by matrix products.  A pair that an earlier band has in
   common is left to that band, so every pair is verified once.  What leaves a group is linear in
   its members: the number of links of each class, and a spanning forest of the links.
4. Connected components of the forests give the near-duplicate groups.

At a similarity of 0.8, 28 bands of 5 rows meet with probability 1 - (1 - 0.8**5)**28 = 0.99999, at 0.9
with 1 - 1e-10.  Candidates below 0.8 cost time but are never reported, as sets are verified in full.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, mapped, pieces, small_or_hashed, stored, utf8
from .components import components
from .words import odd_constants, shingles, splitmix

NGRAM = 5
SIMILARITY = 0.8
BANDS, ROWS = 28, 5
BLOCK = 256

_SIGNATURES = T.StructType(
    [
        T.StructField("doc", T.LongType()),
        T.StructField("digest", T.BinaryType()),
        T.StructField("n", T.IntegerType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
    ]
)
_SETS = T.StructType(
    [T.StructField("rep", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("grams", T.BinaryType())]
)
_FOUND = T.StructType([T.StructField("rep", T.LongType()), T.StructField("other", T.LongType()), T.StructField("links", T.LongType())])


def shingle_set(text: bytes, ngram: int = NGRAM) -> np.ndarray:
    return np.unique(shingles([text], ngram)[0])


def _digest(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def _signatures(batches: Iterator[pa.RecordBatch], ngram: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    mult = odd_constants(bands * rows, 21)
    fold = odd_constants(rows, 22)
    schema = arrow_schema(_SIGNATURES)
    for batch in pieces(batches, "text", 512 << 10):
        texts = utf8(batch.column("text"))
        grams, bounds = shingles(texts, ngram)
        counts = np.diff(bounds)
        full = np.flatnonzero(counts)
        low = np.empty((bands * rows, len(full)), dtype=np.uint64)
        if len(full):
            starts = bounds[:-1][full]
            for k in range(bands * rows):
                low[k] = np.minimum.reduceat(grams * mult[k], starts)
        hashed = np.zeros((len(texts), bands), dtype=np.uint64)
        for b in range(bands):
            part = np.full(len(full), b + 1, dtype=np.uint64)  # so that hashes of different bands never meet
            for r in range(rows):
                part = splitmix(part + low[b * rows + r] * fold[r])
            hashed[full, b] = part
        digests, sizes = [], []
        for i, text in enumerate(texts):
            own = np.unique(grams[bounds[i] : bounds[i + 1]])
            sizes.append(len(own))
            digests.append(_digest(own.tobytes() if len(own) else b"\0" + text))
        signed = hashed.view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc"),
                pa.array(digests, pa.binary()),
                pa.array(sizes, pa.int32()),
                pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(np.where(counts > 0, bands, 0))]), pa.int32()), pa.array(signed[full].ravel())
                ).cast(schema.field(3).type),
            ],
            schema=schema,
        )


def _grams(batches: Iterator[pa.RecordBatch], ngram: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text", 512 << 10):
        grams, bounds = shingles(utf8(batch.column("text")), ngram)
        sets = [np.unique(grams[a:b]).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        digests = [_digest(x) for x in sets]
        yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(digests, pa.binary()), pa.array(sets, pa.binary())], schema=arrow_schema(_SETS))


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of ``left`` with all of ``right``.

    Only shingles of both sides count.  They are numbered, and the two incidence matrices multiplied in slices of columns, so
    memory is bounded by the two blocks.
    """
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    a, b = np.concatenate(left), np.concatenate(right)
    common = np.intersect1d(a, b)
    if not len(common):
        return out
    sides = []
    for sets in (left, right):
        rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        values = np.concatenate(sets)
        at = np.minimum(np.searchsorted(common, values), len(common) - 1)
        ok = common[at] == values
        order = np.argsort(at[ok], kind="stable")
        sides.append((rows[ok][order], at[ok][order], len(sets)))
    step = 4096
    for lo in range(0, len(common), step):
        width = min(step, len(common) - lo)
        made = []
        for rows, at, n in sides:
            x, y = np.searchsorted(at, [lo, lo + width])
            m = np.zeros((n, width), dtype=np.float32)
            m[rows[x:y], at[x:y] - lo] = 1
            made.append(m)
        out += made[0] @ made[1].T
    return out


def _forest(pairs: np.ndarray, names: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links, as pairs of names."""
    parent = list(range(len(names)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in pairs:
        a, b = root(int(i)), root(int(j))
        if a != b:
            parent[b] = a
            out.append((int(names[i]), int(names[j])))
    return out


def _verify(group: dict[str, list], band: int, same_block: bool, low_block: int, similarity: float) -> tuple[list, list, list]:
    """Links among the members of two blocks of one bucket: rows of ``_FOUND``."""
    reps, order = np.unique(np.array(group["rep"], dtype=np.int64), return_index=True)  # a repeated row counts once
    blocks = np.array(group["block"])[order]
    sets = [np.frombuffer(group["grams"][i], dtype=np.uint64) for i in order]
    copies = np.array(group["copies"], dtype=np.int64)[order]
    bands = np.array([group["bands"][i] for i in order], dtype=np.int64).reshape(len(reps), -1)
    left = np.arange(len(reps)) if same_block else np.flatnonzero(blocks == low_block)
    right = left if same_block else np.flatnonzero(blocks != low_block)
    if not len(left) or not len(right):
        return [], [], []
    wanted = np.ones((len(left), len(right)), dtype=bool)
    for b in range(band):
        wanted &= bands[left, b][:, None] != bands[right, b][None, :]
    if same_block:
        wanted &= left[:, None] < right[None, :]
    sizes = np.array([len(s) for s in sets], dtype=np.float64)
    x, y = sizes[left][:, None], sizes[right][None, :]
    wanted &= np.minimum(x, y) >= similarity * np.maximum(x, y) - 1e-9
    if not wanted.any():
        return [], [], []
    rows, cols = np.flatnonzero(wanted.any(1)), np.flatnonzero(wanted.any(0))
    both = intersections([sets[left[i]] for i in rows], [sets[right[j]] for j in cols]).astype(np.float64)
    x, y = sizes[left[rows]][:, None], sizes[right[cols]][None, :]
    # The quotient of two integers is exact enough: 0.8 itself counts.
    linked = wanted[np.ix_(rows, cols)] & (both >= similarity * (x + y - both) - 1e-9)
    i, j = np.nonzero(linked)
    if not len(i):
        return [], [], []
    i, j = left[rows[i]], right[cols[j]]
    degree = np.zeros(len(reps), dtype=np.int64)
    np.add.at(degree, i, copies[j])
    np.add.at(degree, j, copies[i])
    some = np.flatnonzero(degree)
    edges = _forest(np.column_stack([i, j]), reps)
    return (
        [*reps[some].tolist(), *(a for a, _ in edges)],
        [*[None] * len(some), *(b for _, b in edges)],
        [*degree[some].tolist(), *[0] * len(edges)],
    )


def _meet(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Reads rows sorted by group; a group may span batches and is at most two blocks."""
    keys = ("band", "hash", "low", "high")
    fields = ("rep", "block", "copies", "bands", "grams")
    held: dict[str, list] = {f: [] for f in fields}
    now: tuple | None = None
    out: tuple[list, list, list] = ([], [], [])

    def close() -> None:
        if now is not None and len(held["rep"]) > 1:
            for a, b in zip(out, _verify(held, now[0], now[2] == now[3], now[2], similarity), strict=True):
                a.extend(b)

    for batch in batches:
        if not batch.num_rows:
            continue
        ids = [batch.column(k).to_numpy() for k in keys]
        cut = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in ids])) + 1
        data = {f: batch.column(f).to_pylist() for f in fields}
        edges = [0, *cut.tolist(), batch.num_rows]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            key = tuple(int(x[lo]) for x in ids)
            if key != now:
                close()
                now, held = key, {f: [] for f in fields}
            for f in fields:
                held[f] += data[f][lo:hi]
        if len(out[0]) > 50_000:
            yield pa.RecordBatch.from_pydict(dict(zip(_FOUND.names, out, strict=True)), schema=arrow_schema(_FOUND))
            out = ([], [], [])
    close()
    if out[0]:
        yield pa.RecordBatch.from_pydict(dict(zip(_FOUND.names, out, strict=True)), schema=arrow_schema(_FOUND))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    similarity: float = SIMILARITY,
    ngram: int = NGRAM,
    bands: int = BANDS,
    rows: int = ROWS,
    block: int = BLOCK,
) -> DataFrame:
    """One row per document: ``doc_id``, ``class_id``, ``copy_id``, ``n_copies``, ``n_links``.

    ``copy_id`` is the smallest id with the same shingle set (``n_copies`` documents), ``class_id`` the
    smallest id of the near-duplicate group (connected by links of at least ``similarity``), and
    ``n_links`` how many other documents are that similar to this one.

    A text with fewer than five words has one shingle of all its words.  Texts without words are alike only if they are the
    same text; null counts as an empty text, and all empty texts are copies of each other.  Rows without
    an id have no name to be linked by and are left out.  Rows that repeat an id give one row of result; their first text
    by order counts.  Other columns are never read, whatever their names.
    """
    named = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).where("doc is not null")
    signatures = stored(mapped(named, lambda b: _signatures(b, ngram, bands, rows), _SIGNATURES), "near-signatures")
    one = signatures.groupBy("doc").agg(F.min(F.struct("digest", "n", "bands")).alias("s")).select("doc", "s.*")
    classes = stored(
        one.groupBy("digest").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands")),
        "near-classes",
    )
    posted = classes.where("n > 0").select("rep", F.posexplode("bands").alias("band", "hash"))
    shared = (
        posted.groupBy("hash")
        .agg(F.count(F.lit(1)).alias("size"), F.min("band").alias("band"), F.bit_xor(F.xxhash64("rep")).alias("sum"), F.min("rep").alias("low"), F.max("rep").alias("high"))
        .where("size > 1")
    )
    # Buckets with the same members, told by size, ends and a sum of hashes, hold the same pairs: only the first band's stays.
    first = shared.groupBy("size", "sum", "low", "high").agg(F.min(F.struct("band", "hash")).alias("b")).select("size", "b.hash")
    members = stored(posted.select("rep", "hash").join(first, "hash"), "near-buckets")
    wanted = stored(members.select(F.col("rep").alias("doc")).distinct(), "near-members")
    small = small_or_hashed(wanted, 16)
    # Rows that repeat an id may differ in text: the digest tells which of them stands for it.
    sets = mapped(named.join(small, "doc", "left_semi"), lambda b: _grams(b, ngram), _SETS)
    known = sets.join(classes.select("rep", "digest", "copies", "bands"), ["rep", "digest"])
    n_blocks = F.ceil(F.col("size") / block).cast("int")
    met = (
        members.withColumn("block", F.pmod(F.xxhash64("rep"), n_blocks).cast("int"))
        .withColumn("with", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
        .select("rep", "hash", "block", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"))
        .join(known, "rep")
        .withColumn("band", (F.array_position("bands", F.col("hash")) - 1).cast("int"))
    )
    group = ["band", "hash", "low", "high"]
    found = stored(
        mapped(met.repartition(*group).sortWithinPartitions(*group), lambda b: _meet(b, similarity), _FOUND), "near-links"
    )
    grouped = components(found.where("other is not null").select("rep", "other"))
    degrees = found.where("other is null").groupBy("rep").agg(F.sum("links").alias("links"))
    named_classes = (
        classes.select("digest", "rep", "copies")
        .join(grouped.withColumnRenamed("node", "rep"), "rep", "left")
        .join(degrees, "rep", "left")
    )
    return (
        one.select("doc", "digest")
        .join(named_classes, "digest")
        .select(
            F.col("doc").alias("doc_id"),
            F.coalesce("component", "rep").alias("class_id"),
            F.col("rep").alias("copy_id"),
            F.col("copies").alias("n_copies"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        )
    )


def op6_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate group, class of equal shingle sets and number of links of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
