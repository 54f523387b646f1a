"""Stage one: which photos hold a region that looks like the query.

``knn_exact`` scores every region against a handful of query vectors with one matrix product per Arrow
batch and keeps each task's best, so what is shuffled is bounded by k per task and query.
The LSH and inverted-list forms trade recall for scoring fewer regions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Regions that each query vector may bring in for every photo asked for.
REGIONS_PER_PHOTO = 20
#: Query vectors that one pass over the regions is asked with; more of them take more passes.
MAX_QUERIES = 4096


def _query_blocks(queries: DataFrame) -> Iterator[tuple[list[int], np.ndarray]]:
    """Query numbers and vectors, at most ``MAX_QUERIES`` with the driver at a time."""
    numbers: list[int] = []
    vectors: list[list[float]] = []
    for row in queries.select("query_no", "vec").orderBy("query_no").toLocalIterator():
        numbers.append(row.query_no)
        vectors.append(row.vec)
        if len(numbers) == MAX_QUERIES:
            yield numbers, np.array(vectors, dtype=np.float64)
            numbers, vectors = [], []
    if numbers:
        yield numbers, np.array(vectors, dtype=np.float64)


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)


def _kind(regions: DataFrame) -> str:
    return regions.schema["photo_id"].dataType.simpleString()


def _nearest(regions: DataFrame, queries: DataFrame, k: int, allowed: Callable | None = None) -> DataFrame:
    """The ``k`` best regions of each query vector.  ``allowed`` makes of the query vectors what tells, of a batch, which
    regions each of them may meet; without it they meet all."""
    photo, found = _kind(regions), None
    for numbers, matrix in _query_blocks(queries):
        shared, may = regions.sparkSession.sparkContext.broadcast(matrix), allowed(matrix) if allowed else None

        def best(batches: Iterator[pa.RecordBatch], numbers=numbers, shared=shared, may=may) -> Iterator[pa.RecordBatch]:
            q = shared.value
            held: list[tuple | None] = [None] * len(numbers)  # scores, rows and photos of each query, best first
            for batch in batches:
                if not batch.num_rows:
                    continue
                rows, photos, vectors = batch.column("row_id").to_numpy(), batch.column("photo_id").to_numpy(zero_copy_only=False), _vectors(batch)
                score = np.round(q @ vectors.T, 6)
                meet = None if may is None else may(batch, vectors)
                for i, own in enumerate(score):
                    some = np.arange(len(own)) if meet is None else np.flatnonzero(meet[i])
                    last = held[i]
                    if last is not None and len(last[0]) == k:
                        some = some[own[some] >= last[0][-1]]
                    if not len(some):
                        continue
                    if len(some) > k:
                        least = np.partition(own[some], len(some) - k)[len(some) - k]
                        some = some[own[some] >= least]
                    new = (own[some], rows[some], photos[some])
                    if last is not None:
                        new = tuple(np.concatenate(x) for x in zip(last, new, strict=True))
                    order = np.lexsort((new[1], -new[0]))[:k]
                    held[i] = tuple(x[order] for x in new)
            for number, one in zip(numbers, held, strict=True):
                if one is not None:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(one[0]), number, dtype=np.int32)), pa.array(one[1]), pa.array(one[2]), pa.array(one[0])],
                        names=["query_no", "row_id", "photo_id", "score"],
                    )

        columns = [c for c in ("row_id", "photo_id", "vec", "cell") if c in regions.columns]
        part = regions.select(*columns).mapInArrow(best, f"query_no int, row_id long, photo_id {photo}, score double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return regions.sparkSession.createDataFrame([], f"query_no int, rank int, row_id long, photo_id {photo}, score double")
    ranked = Window.partitionBy("query_no").orderBy(F.desc("score"), "row_id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)


def knn_exact(regions: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` best regions of each query vector: ``query_no``, ``rank``, ``row_id``, ``photo_id``, ``score``.

    ``regions`` has ``row_id``, ``photo_id``, ``vec``; ``queries`` has ``query_no``, ``vec``.  Scores are rounded to six
    digits before ranking, and ties go to the smaller ``row_id``, so that the order is the same everywhere.
    """
    return _nearest(regions, queries, k)


def best_scores(regions: DataFrame, queries: DataFrame) -> DataFrame:
    """Every region with its best score over all query vectors: ``row_id``, ``photo_id``, ``score``."""
    photo, found, blocks = _kind(regions), None, 0
    for _, matrix in _query_blocks(queries):
        shared = regions.sparkSession.sparkContext.broadcast(matrix)

        def score(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    top = np.round((shared.value @ _vectors(batch).T).max(0), 6)
                    yield pa.RecordBatch.from_arrays([batch.column("row_id"), batch.column("photo_id"), pa.array(top)], names=["row_id", "photo_id", "score"])

        part = regions.select("row_id", "photo_id", "vec").mapInArrow(score, f"row_id long, photo_id {photo}, score double")
        found, blocks = part if found is None else found.unionByName(part), blocks + 1
    if found is None:
        return regions.sparkSession.createDataFrame([], f"row_id long, photo_id {photo}, score double")
    return found if blocks == 1 else found.groupBy("row_id", "photo_id").agg(F.max("score").alias("score"))


def best_region_per_photo(scored: DataFrame) -> DataFrame:
    """Each photo's best region over all query vectors; the smaller row wins ties."""
    best = F.max(F.struct(F.col("score"), (-F.col("row_id")).alias("r")))
    return scored.groupBy("photo_id").agg(best.alias("b")).select("photo_id", F.col("b.score").alias("score"), (-F.col("b.r")).alias("row_id"))


def top_photos(best: DataFrame, top_k: int) -> DataFrame:
    return best.orderBy(F.desc("score"), "photo_id").limit(top_k)


def alive(regions: DataFrame, photos: DataFrame) -> DataFrame:
    """Regions whose photo is still there: vectors without an owner use up no place."""
    return regions.join(photos.select("photo_id"), "photo_id", "left_semi")


def recall(regions: DataFrame, queries: DataFrame, top_k: int, source: int | None = None, rejected: DataFrame | None = None, photos: DataFrame | None = None) -> DataFrame:
    """Stage one as a whole.  The source photo and rejected ones are dropped *after* the limit: they use up places.

    With ``photos``, regions of other photos are passed over beforehand, and at most as many regions are looked for as are
    left.
    """
    k = top_k * REGIONS_PER_PHOTO
    if photos is not None:
        regions = alive(regions, photos)
        k = max(1, min(k, regions.count()))
    hits = top_photos(best_region_per_photo(knn_exact(regions, queries, k)), top_k)
    if source is not None:
        hits = hits.where(F.col("photo_id") != source)
    if rejected is not None:
        hits = hits.join(rejected.select("photo_id"), "photo_id", "left_anti")
    return hits


def active_exemplars(fresh: DataFrame, stored: DataFrame, photos: DataFrame) -> DataFrame:
    """The drawn box and the stored exemplars whose photo is still there, fresh ones first, each (photo, box) once.

    Inputs have ``object_id``, ``photo_id``, ``x1``, ``y1``, ``x2``, ``y2``.
    """
    key = ["object_id", "photo_id", "x1", "y1", "x2", "y2"]
    live = stored.join(photos.select("photo_id"), "photo_id", "left_semi")
    both = fresh.select(*key, F.lit(0).alias("priority")).unionByName(live.select(*key, F.lit(1).alias("priority")))
    return both.groupBy(*key).agg(F.min("priority").alias("priority"))


def knn_lsh(regions: DataFrame, queries: DataFrame, k: int, tables: int = 28, bits: int = 4, seed: int = 7) -> DataFrame:
    """Random-hyperplane LSH: a query ranks only regions that share a bucket of one of the tables with it.

    With the given tables a neighbour at a cosine of 0.3 is found with probability 0.97.
    """
    sample = regions.select(F.size("vec").alias("d")).head()
    if sample is None:
        return _nearest(regions, queries, k)
    planes = np.random.default_rng(seed).standard_normal((tables * bits, sample.d))
    weights = 1 << np.arange(bits)
    keys = lambda m: ((m @ planes.T) > 0).reshape(len(m), tables, bits) @ weights

    def allowed(matrix: np.ndarray) -> Callable:
        wanted = keys(matrix)
        return lambda _, vectors: (keys(vectors)[None, :, :] == wanted[:, None, :]).any(2)

    return _nearest(regions, queries, k, allowed)


def ivf_cells(regions: DataFrame, cells: int = 16, rounds: int = 4, sample: int = 20_000, seed: int = 7) -> np.ndarray:
    """Cell centres by k-means on a bounded sample (the first ``sample`` rows by a hash of their id)."""
    rows = regions.select("row_id", "vec").orderBy(F.xxhash64("row_id"), "row_id").limit(sample).select("vec").collect()
    points = np.array([r.vec for r in rows], dtype=np.float64)
    if not len(points):
        return points
    centres = points[: min(cells, len(points))].copy()
    for _ in range(rounds):
        near = np.argmax(points @ centres.T, axis=1)
        for c in range(len(centres)):
            if (near == c).any():
                mean = points[near == c].mean(0)
                centres[c] = mean / max(np.linalg.norm(mean), 1e-12)
    return centres


def with_cell(regions: DataFrame, centres: np.ndarray) -> DataFrame:
    """``regions`` and the number of each one's cell: what an index table is partitioned by."""
    shared = regions.sparkSession.sparkContext.broadcast(centres)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _vectors(batch) if batch.num_rows else np.zeros((0, 0))
            cell = np.argmax(vectors @ shared.value.T, axis=1).astype(np.int32) if batch.num_rows else np.zeros(0, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), batch.column("photo_id"), batch.column("vec"), pa.array(cell)], names=["row_id", "photo_id", "vec", "cell"])

    return regions.select("row_id", "photo_id", "vec").mapInArrow(add, "row_id long, photo_id long, vec array<float>, cell int")


def knn_ivf(indexed: DataFrame, centres: np.ndarray, queries: DataFrame, k: int, probes: int = 12) -> DataFrame:
    """A query ranks the regions of its nearest ``probes`` cells only.

    The regions are read once, and of a table partitioned by cell only the cells that any query looks into.
    """
    if not len(centres):
        return _nearest(indexed, queries, k)
    n = min(probes, len(centres))

    def nearest(matrix: np.ndarray) -> np.ndarray:
        out = np.zeros((len(matrix), len(centres)), dtype=bool)
        np.put_along_axis(out, np.argsort(-(matrix @ centres.T), axis=1, kind="stable")[:, :n], True, axis=1)
        return out

    def allowed(matrix: np.ndarray) -> Callable:
        may = nearest(matrix)
        return lambda batch, _: may[:, batch.column("cell").to_numpy()]

    used = np.zeros(len(centres), dtype=bool)
    for _, matrix in _query_blocks(queries):
        used |= nearest(matrix).any(0)
    return _nearest(indexed.where(F.col("cell").isin(np.flatnonzero(used).tolist())), queries, k, allowed)
