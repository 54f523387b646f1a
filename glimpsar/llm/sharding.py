"""Sharding by Karmarkar-Karp differencing.

Documents with equal texts form a group that stays together.  Groups are dealt to buckets; each
bucket's task runs multiway differencing: every group starts as a partial partition with all its bytes
in one part, and the two partial partitions with the largest spread are combined again and again, the fullest
part of one with the emptiest of the other.  A bucket ends as one partial partition, and the buckets
are combined in the same way one level up, until one is left.  No task and no driver sees more than
one bucket's groups.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import arrow_schema, mapped, small_or_hashed, stored

SHARDS = 24
#: Items that one bucket's task combines.
BUCKET_ITEMS = 20_000
#: Rows whose slots one task numbers, and the number of such cells of a shard at least.
CELL_ROWS = 100_000
CELLS = 16


def difference(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp for partial partitions given as rows of ``vectors`` (one column per part).

    Returns the total of each part, ascending, and for each row which part each of its own columns
    went to.  Ties are broken by the order of the rows.
    """
    n, k = vectors.shape
    order = np.argsort(vectors, axis=1, kind="stable")
    loads = np.take_along_axis(vectors, order, axis=1)
    # A node's place p holds, for each child, the child's place; leaves map places to their own columns.
    children: list[tuple[int, int, np.ndarray] | None] = [None] * n
    held = dict(enumerate(loads))
    heap = [(-(int(v[-1]) - int(v[0])), i) for i, v in enumerate(loads)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        total = held.pop(a) + held.pop(b)[::-1]
        place = np.argsort(total, kind="stable")
        total = total[place]
        children.append((a, b, place))
        held[len(children) - 1] = total
        heapq.heappush(heap, (-(int(total[-1]) - int(total[0])), len(children) - 1))
    root = len(children) - 1
    part = {root: np.arange(k)}
    for node in range(root, n - 1, -1):
        mine = part.pop(node)
        a, b, place = children[node]
        at = np.empty(k, dtype=np.int64)
        at[place] = mine  # unsorted column of the sum -> part
        part[a] = at
        part[b] = at[::-1]
    out = np.empty((n, k), dtype=np.int64)
    for i in range(n):
        out[i, order[i]] = part[i]
    return held[root], out


_VECTOR = T.ArrayType(T.LongType())
_LEVEL = T.StructType([T.StructField("item", T.StringType()), T.StructField("bucket", T.StringType()), T.StructField("parts", _VECTOR), T.StructField("total", _VECTOR)])


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads (bucket, item, loads) sorted by bucket; a row per item, and one per bucket with its totals."""
    schema = arrow_schema(_LEVEL)
    items: list[str] = []
    loads: list[list[int]] = []
    now: str | None = None

    def close() -> Iterator[pa.RecordBatch]:
        if items:
            total, parts = difference(np.array(loads, dtype=np.int64))
            yield pa.RecordBatch.from_pydict(
                {"item": [*items, None], "bucket": [now] * (len(items) + 1), "parts": [*parts.tolist(), None], "total": [*[None] * len(items), total.tolist()]},
                schema=schema,
            )

    for batch in batches:
        for bucket, item, vector in zip(*(batch.column(c).to_pylist() for c in ("bucket", "item", "loads")), strict=True):
            if bucket != now:
                yield from close()
                now, items, loads = bucket, [], []
            items.append(item)
            loads.append(vector)
    yield from close()


def assign(groups: DataFrame, shards: int = SHARDS, bucket_items: int = BUCKET_ITEMS) -> DataFrame:
    """(item, shard) for ``groups`` of (item string, size long)."""
    single = lambda c: F.array(F.col(c), *[F.lit(0).cast("long")] * (shards - 1))
    level = groups.select("item", single("size").alias("loads"))
    n = level.count()
    steps: list[DataFrame] = []
    depth = 0
    while True:
        buckets = max(1, -(-n // bucket_items))
        dealt = level.withColumn("bucket", F.concat(F.lit(f"{depth}:"), F.pmod(F.xxhash64("item"), F.lit(buckets)).cast("string")))
        done = stored(
            mapped(dealt.repartition("bucket").sortWithinPartitions("bucket", "item"), _combine, _LEVEL), "sharding-level"
        )
        steps.append(done.where("item is not null").select("item", "bucket", "parts"))
        if buckets == 1:
            break
        level = done.where("item is null").select(F.col("bucket").alias("item"), F.col("total").alias("loads"))
        n, depth = level.count(), depth + 1
    # The place of a group's only loaded part, followed up the levels.
    place = steps[0].select("item", "bucket", F.element_at("parts", 1).alias("part"))
    for step in steps[1:]:
        above = step.select(F.col("item").alias("__child"), F.col("bucket").alias("__up"), "parts")
        place = place.join(small_or_hashed(above, 16 + 8 * shards), F.col("bucket") == F.col("__child")).select(
            "item", F.col("__up").alias("bucket"), F.element_at("parts", (F.col("part") + 1).cast("int")).alias("part")
        )
    return place.select("item", F.col("part").cast("int").alias("shard"))


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``shard`` and ``slot`` of every row of ``docs``.

    The size is the text's UTF-8 bytes (null: none) plus 8.  Rows of equal texts go to one shard; null is
    a text of its own.  Within a shard slots run from 0 without gaps, in order of a hash cell of id and text, then the id;
    rows without an id come first in their cell.  Repeated rows are kept, each with a slot.  An empty table gives an empty table.
    Texts of any length count whole.  Other columns are never read, whatever their names.
    """
    text = F.col(text_col)
    rows = stored(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
            F.coalesce(F.sha2(text, 256), F.lit("null")).alias("item"),
        ),
        "sharding-rows",
    )
    n = rows.count()
    groups = stored(rows.groupBy("item").agg(F.sum("size").alias("size")), "sharding-groups")
    cells = max(CELLS, -(-n // (shards * CELL_ROWS)))
    placed = stored(
        rows.join(assign(groups, shards), "item")
        .withColumn("cell", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(cells)).cast("int"))
        .select("doc_id", "size", "text_crc32", "shard", "cell"),
        "sharding-placed",
    )
    counts = placed.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(counts.select("shard", "cell", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset")), "sharding-offsets")
    within = Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size")
    return (
        placed.withColumn("__n", F.row_number().over(within))
        .join(small_or_hashed(offsets, 24), ["shard", "cell"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("__n") - 1).alias("slot"))
    )


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, bytes balanced."""
    placed = shard(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
