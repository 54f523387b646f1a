"""Nearest neighbours by inner product with a permutation index.

A vector is represented by the order of its nearest pivots.

1. Copies are found by two hashes, and one vector stands for all of its copies; of a copied vector only as many of
   the smallest ids as an answer can hold are ever looked at again.
2. Every vector is posted to the inverted files of its ``POSTED`` nearest file pivots, and every query looks into the
   files of its own nearest ones.  There are about ``FILES`` times the square root of n files, and a query looks into a
   number that grows with the root of that, so both the length of a file and the share of files that are read fall as
   the index grows.
3. In a file, vectors are ranked by the footrule distance between their pivot order and the query's: nothing but places
   of pivots is compared.  A vector that an earlier file of the query's holds as well is left to that one.
4. The best few of each file, a number that does not depend on n, are reranked by inner product on the original vectors.

Lengths count for inner products, so orders are taken by angle after every vector has been given one more component
that makes all of them equally long (Bachrach et al., "Speeding Up the Xbox Recommender System"): what has a
large product with a query is then near to it.  Places are kept in four bins; the footrule distance of two vectors of bins
is the number of thresholds that only one of them is below, so all distances between a file and its queries are one
matrix product.

Files that a bounded sample shows to be long are dealt in blocks, which the queries of the file visit one and all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import arrow_schema, mapped, small_or_hashed, stored

NEIGHBOURS = 20
#: Pivots whose order represents a vector; the first of them have files.
PIVOTS = 256
#: Files are this times the square root of the number of vectors; 16 at least, and at most so many that pivots stay small.
FILES, MAX_FILES = 0.3, 16_384
#: Files that a vector is posted to; a query looks into this times the square root of the number of files.
POSTED, PROBED = 2, 3.5
#: Reranked of a query's nearest file, of the n-th nearest an n-th part of it, and the least of any file.
RERANKED, RERANKED_LEAST = 1024, 32
#: Vectors that pivots are taken from, and that lengths of files are estimated from.
SAMPLE = 4096
#: Vectors in a block of a file, and queries that are compared with it at once.
BLOCK, QUERY_BLOCK = 8192, 256
#: Bins of places end at these shares of the pivots.
BINS = (1 / 8, 1 / 4, 1 / 2)


def valid(column: str) -> Column:
    """Not null, no null or non-finite component, and not zero."""
    v = F.col(column)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(v, lambda x: x != 0)


def lengths(vectors: np.ndarray) -> np.ndarray:
    """Euclidean lengths; squares neither overflow nor vanish."""
    top = np.abs(vectors).max(1)
    return top * np.sqrt(((vectors / top[:, None]) ** 2).sum(1))


def lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Vectors of unit length with one more component; without ``longest`` (queries) it is zero."""
    own = lengths(vectors)
    if not longest:
        return np.column_stack([vectors / own[:, None], np.zeros(len(own))])
    part = np.minimum(1.0, own / longest)
    return np.column_stack([vectors * (part / own)[:, None], np.sqrt(1 - part**2)])


def bins(near: np.ndarray) -> np.ndarray:
    """A row of zeros and ones for each row of nearness to pivots: for every threshold, which pivots are placed above it.

    Two rows differ in as many columns as the footrule distance of their binned places says.
    """
    m = near.shape[1]
    cuts = sorted({max(1, int(m * b)) for b in BINS})
    sorted_ = np.partition(near, [m - c for c in cuts], axis=1)
    return np.concatenate([near >= sorted_[:, m - c, None] for c in cuts], axis=1).astype(np.float32)


@dataclass(frozen=True)
class Index:
    """What all tasks know: pivots (one in each row), how many have files, and in how many blocks each file is."""

    pivots: np.ndarray
    blocks: np.ndarray
    longest: float
    probed: int

    def near(self, vectors: np.ndarray, query: bool, only: int | None = None) -> np.ndarray:
        return lifted(vectors, 0.0 if query else self.longest) @ self.pivots[:only].T

    def nearest_files(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        """The files that vectors are posted to, or that queries look into, nearest first."""
        near = -self.near(vectors, query, len(self.blocks))
        n = min(self.probed if query else POSTED, near.shape[1])
        some = np.argpartition(near, n - 1, axis=1)[:, :n]
        return np.take_along_axis(some, np.argsort(np.take_along_axis(near, some, 1), axis=1, kind="stable"), 1)


def sample_of(vectors: DataFrame, n: int, count: int = SAMPLE) -> pa.Array:
    """``count`` distinct vectors, chosen by a hash of their components.

    Only some 4 times as many rows are grouped (all copies of a vector share its hash); the whole table is, if
    these are too much alike.
    """
    for one_in in sorted({max(1, n // (4 * count)), 1}, reverse=True):
        some = vectors.where(F.pmod(F.xxhash64("vec"), F.lit(one_in)) == 0)
        v = some.groupBy("vec").agg(F.min("id").alias("id")).orderBy(F.xxhash64("vec"), "id").limit(count).select("vec").toArrow().column(0).combine_chunks()
        if len(v) == count:
            break
    return v


def build(vectors: DataFrame, d: int, k: int, pivots: int = PIVOTS, files: int | None = None, probed: int | None = None) -> Index:
    """The index's bounded part, from one row of statistics and a sample of ``vectors``, of which there is one at least."""
    squares = F.aggregate("vec", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    n, longest = vectors.agg(F.count(F.lit(1)), F.max(F.sqrt(squares))).first()
    longest = longest if np.isfinite(longest) else 0.0  # beyond the range of squares, orders are by angle alone
    rows = lifted(matrix(sample_of(vectors, n), d), longest)
    files = min(MAX_FILES, len(rows), files or max(16, round(FILES * n**0.5)))
    chosen = rows[: max(min(pivots, len(rows)), files)]
    posted = min(POSTED, files)
    share = np.bincount(np.argpartition(-(rows @ chosen[:files].T), posted - 1, axis=1)[:, :posted].ravel(), minlength=files) / len(rows)
    # Every file holds its own pivot, so among k files and one more a query always finds k others.
    looked = min(files, max(probed or int(np.ceil(PROBED * files**0.5)), k + 1))
    return Index(chosen, np.maximum(1, np.ceil(share * n / BLOCK)).astype(np.int64), longest, looked)


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """A column of lists of ``d`` numbers, without a Python object for any of them."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def _routed(df: DataFrame, index: Index, d: int, query: bool) -> DataFrame:
    """A row for each vector and file (of queries: and block) with all of the vector's files."""
    shared = df.sparkSession.sparkContext.broadcast(index)  # at most MAX_FILES vectors
    schema = T.StructType(
        [
            T.StructField("file", T.IntegerType()),
            T.StructField("block", T.IntegerType()),
            T.StructField("asks", T.BooleanType()),
            T.StructField("id", T.LongType()),
            T.StructField("key", T.LongType()),
            T.StructField("vec", df.schema["vec"].dataType),
            T.StructField("files", T.BinaryType()),
        ]
    )
    arrow = arrow_schema(schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            files = made.nearest_files(matrix(batch.column("vec"), d), query).astype(np.int32)
            at, file = np.repeat(np.arange(len(files)), files.shape[1]), files.ravel()
            if query:
                times = made.blocks[file]
                block = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                at, file = np.repeat(at, times), np.repeat(file, times)
            else:
                block = batch.column("key").to_numpy().view(np.uint64)[at] % made.blocks[file].astype(np.uint64)
            take = pa.array(at)
            raw = pa.array([x.tobytes() for x in files], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(file), pa.array(block.astype(np.int32)), pa.array(np.full(len(at), query)), *[batch.column(c).take(take).cast(arrow.field(c).type) for c in ("id", "key", "vec")], raw.take(take)],
                schema=arrow,
            )

    return mapped(df.select("id", "vec", F.xxhash64("vec").alias("key")), rows, schema)


_FOUND = T.StructType(
    [
        T.StructField("query", T.LongType()),
        T.StructField("query_key", T.LongType()),
        T.StructField("scored", T.LongType()),
        T.StructField("best", T.ArrayType(T.StructType([T.StructField("score", T.DoubleType()), T.StructField("id", T.LongType()), T.StructField("key", T.LongType())]))),
    ]
)


class _Block:
    """One block of a file: what is posted there, then queries against it.

    Members are named by id and key, the hash of the vector, as an id may come with several vectors.
    """

    def __init__(self, index: Index, file: int, keep: int):
        self.index, self.file, self.keep = index, file, keep
        self.parts: list[tuple] = []
        self.codes: np.ndarray | None = None

    def post(self, names: np.ndarray, vecs: np.ndarray, files: np.ndarray) -> None:
        self.parts.append((names, vecs, files))

    def ready(self) -> None:
        names, vecs, files = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(names[:, 0], kind="stable")  # of equal footrules and scores, the smaller id
        self.names, self.vecs, self.files = names[order], vecs[order], files[order]
        self.codes = bins(self.index.near(self.vecs, False))
        self.repeats = (self.names[1:, 0] == self.names[:-1, 0]).any()
        self.parts = []

    def ask(self, vecs: np.ndarray, files: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """The best of this block for each query: scores, names, and how many were scored."""
        if self.codes is None:
            self.ready()
        # The more pivots both have placed high, the smaller the footrule distance.
        close = bins(self.index.near(vecs, True)) @ self.codes.T
        beyond = files.shape[1]
        place = np.full((len(vecs), len(self.index.blocks)), beyond, dtype=np.int16)
        np.put_along_axis(place, files, np.arange(beyond, dtype=np.int16)[None, :], axis=1)
        here = place[:, self.file]
        for j in range(self.files.shape[1]):
            close[place[:, self.files[:, j]] < here[:, None]] = -1  # found in an earlier file
        out = []
        for row, vec, nth in zip(close, vecs, here, strict=True):
            limit = max(RERANKED_LEAST, RERANKED // (int(nth) + 1))
            some = np.flatnonzero(row >= 0)
            if limit < len(some):
                own = row[some]
                least = np.partition(own, len(own) - limit)[len(own) - limit]
                nearer = some[own > least]
                some = np.concatenate([nearer, some[own == least][: limit - len(nearer)]])
            score = np.einsum("ij,j->i", self.vecs[some], vec)
            order = np.lexsort((self.names[some, 0], -score))
            if self.repeats:  # the best of each id
                order = order[np.sort(np.unique(self.names[some, 0][order], return_index=True)[1])]
            order = order[: self.keep]
            out.append((score[order], self.names[some[order]], len(some)))
        return out


def _search(batches: Iterator[pa.RecordBatch], index: Index, d: int, keep: int) -> Iterator[pa.RecordBatch]:
    """Reads blocks of files, sorted; in each, what is posted there comes before the queries."""
    schema = arrow_schema(_FOUND)
    now, block = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(x).to_numpy(zero_copy_only=False) for x in ("file", "block", "asks")]
        cut = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in keys])) + 1
        names, vecs = np.column_stack([batch.column("id").to_numpy(), batch.column("key").to_numpy()]), matrix(batch.column("vec"), d)
        for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows], strict=True):
            key = (int(keys[0][lo]), int(keys[1][lo]))
            if key != now:
                now, block = key, _Block(index, key[0], keep)
            files = np.frombuffer(b"".join(batch.column("files").slice(lo, hi - lo).to_pylist()), dtype=np.int32).reshape(hi - lo, -1)
            if not keys[2][lo]:
                block.post(names[lo:hi], vecs[lo:hi], files)
                continue
            if block.codes is None and not block.parts:
                continue
            for a in range(lo, hi, QUERY_BLOCK):
                b = min(a + QUERY_BLOCK, hi)
                found = block.ask(vecs[a:b], files[a - lo : b - lo])
                members = np.concatenate([x for _, x, _ in found])
                pairs = pa.StructArray.from_arrays(
                    [pa.array(np.concatenate([s for s, _, _ in found])), pa.array(members[:, 0]), pa.array(members[:, 1])], names=["score", "id", "key"]
                )
                best = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *[len(s) for s, _, _ in found]]), pa.int32()), pairs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[a:b, 0]), pa.array(names[a:b, 1]), pa.array([n for _, _, n in found], pa.int64()), best.cast(schema.field("best").type)], schema=schema
                )


def _hashed(df: DataFrame) -> DataFrame:
    return df.withColumn("h1", F.xxhash64("vec")).withColumn("h2", F.xxhash64(F.lit(1), "vec"))


def _single(df: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """One row for each distinct vector, with its smallest id, and the hashes of those that occur more than once (with
    that id as ``rep``), if any do.  Only hashes are shuffled for it, and the vectors of copies."""
    hashed = _hashed(df)
    several = stored(hashed.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("rep")).where("n > 1").select("h1", "h2", "rep"), "ann-copies")
    if several.isEmpty():
        return df, None
    small = small_or_hashed(several, 24)
    copied = hashed.join(small, ["h1", "h2"]).groupBy("h1", "h2").agg(F.min("id").alias("id"), F.first("vec").alias("vec"))
    return hashed.join(small, ["h1", "h2"], "left_anti").select("id", "vec").unionByName(copied.select("id", "vec")), several


def _found(vectors: DataFrame, queries: DataFrame, d: int, k: int, pivots: int, files: int | None, probed: int | None) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """What the files give for each distinct query (``_FOUND``), the vectors that are copies, and the queries that are."""
    index = build(vectors, d, k, pivots, files, probed)
    (base, several), (asked, alike) = _single(vectors), _single(queries)
    both = _routed(base, index, d, False).unionByName(_routed(asked, index, d, True))
    shared = vectors.sparkSession.sparkContext.broadcast(index)
    dealt = both.repartition("file", "block").sortWithinPartitions("file", "block", "asks")
    return mapped(dealt, lambda b: _search(b, shared.value, d, k + 1), _FOUND), several, alike


def search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = NEIGHBOURS,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    pivots: int = PIVOTS,
    files: int | None = None,
    probed: int | None = None,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score``: each query's ``k`` nearest found.

    Nearness is the inner product in double precision; ties go to the smaller id.  Vectors that are null, zero or hold
    null or non-finite components, rows without an id, and vectors whose number of components is not the most common one
    (the larger of equally common ones) take no part.  A query never finds rows of its own id; an id
    that repeats is found once, with its best score.  Fewer candidates give fewer rows, an empty table none.  Other
    columns are never read, whatever their names.
    """
    kind = vectors.schema[vec_col].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    one = lambda df: df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast(kind).alias("vec")).where(F.col("id").isNotNull() & valid("vec"))
    base, asked = one(vectors), one(queries)
    common = base.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n")).agg(F.max(F.struct("n", "d")).alias("m")).first().m
    if common is None:
        return asked.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).where("false")
    base, asked = base.where(F.size("vec") == common.d), asked.where(F.size("vec") == common.d)
    found, several, alike = _found(base, asked, common.d, k, pivots, files, probed)
    flat = found.select("query", "query_key", F.explode("best").alias("b")).select("query", "query_key", F.col("b.id").alias("vec_id"), F.col("b.key").alias("key"), F.col("b.score").alias("score"))

    def first(df: DataFrame, keys: list[str], n: int) -> DataFrame:
        """The best ``n`` of each query, every id once.  A query meets a best list from each file it has looked into."""
        once = df.groupBy(*keys, "vec_id").agg(F.max("score").alias("score"))
        number = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id"))
        return once.withColumn("rank", number).where(F.col("rank") <= n)

    query = ["query", "query_key"]
    if several is not None:
        # Of a vector that a third of all rows share, only the k + 1 smallest ids can ever be among anybody's nearest.
        members = _hashed(base).join(small_or_hashed(several, 24), ["h1", "h2"]).select("h1", "h2", "rep", "id")
        nth = F.dense_rank().over(Window.partitionBy("h1", "h2").orderBy("id"))
        names = stored(members.withColumn("nth", nth).where(F.col("nth") <= k + 1).select(F.col("rep").alias("vec_id"), F.col("h1").alias("key"), "id").distinct(), "ann-names")
        flat = flat.join(small_or_hashed(names, 32), ["vec_id", "key"], "left").withColumn("vec_id", F.coalesce("id", "vec_id"))
    best = first(flat, query, k + 1)  # one more, as the query's own id may be among them
    if alike is None:
        best = best.withColumn("query_id", F.col("query"))
    else:
        hashed = _hashed(asked).join(small_or_hashed(alike, 24), ["h1", "h2"], "left")
        best = best.join(hashed.select(F.coalesce("rep", "id").alias("query"), F.col("h1").alias("query_key"), F.col("id").alias("query_id")).distinct(), query)
    return first(best.where("query_id <> vec_id"), ["query_id"], k).select("query_id", "rank", "vec_id", "score")


def op2_permutation_index(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest found for every vector whose id is divisible by 20, against all."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(vectors, vectors.where("vec_id % 20 = 0"))
