"""Region windows over a grid of tokens, integral images and mean pooling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

GRID = 32
# Sizes and strides of the windows below the whole frame.
SCALES = ((16, 8), (8, 6))


def windows() -> list[tuple[int, int, int, int]]:
    """Top, left, bottom and right of the whole frame and of the windows of each scale, by row and column."""
    out = []
    for size, stride in ((GRID, GRID), *SCALES):
        starts = range(0, GRID - size + 1, stride)
        out += [(r, c, r + size, c + size) for r in starts for c in starts]
    return out


def pyramid(spark: SparkSession) -> DataFrame:
    """The whole frame and the windows of each scale, by row and column, with their normalised boxes."""
    levels = [(0, GRID, GRID), *[(i + 1, size, stride) for i, (size, stride) in enumerate(SCALES)]]
    df = spark.createDataFrame(levels, "level int, size int, stride int")
    starts = F.sequence(F.lit(0), F.lit(GRID) - F.col("size"), F.col("stride"))
    df = df.withColumn("r0", F.explode(starts)).withColumn("c0", F.explode(starts))
    numbered = df.withColumn("region_no", (F.row_number().over(Window.orderBy("level", "r0", "c0")) - 1).cast("int"))
    end = lambda c: (F.col(c) + F.col("size")).cast("int")
    return numbered.select("region_no", "r0", "c0", end("r0").alias("r1"), end("c0").alias("c1")).select(
        "*", (F.col("c0") / GRID).alias("x1"), (F.col("r0") / GRID).alias("y1"), (F.col("c1") / GRID).alias("x2"), (F.col("r1") / GRID).alias("y2")
    )


def integral_image(tokens: DataFrame, key: str = "photo_id") -> DataFrame:
    """``total``: the sum of ``value`` over all tokens above and to the left, by two running sums."""
    frame = (Window.unboundedPreceding, Window.currentRow)
    across = F.sum("value").over(Window.partitionBy(key, "r").orderBy("c").rowsBetween(*frame))
    down = F.sum("across").over(Window.partitionBy(key, "c").orderBy("r").rowsBetween(*frame))
    return tokens.withColumn("across", across).withColumn("total", down).drop("across")


def pool(photos: DataFrame, dim: int, key: str = "photo_id", tokens: str = "tokens", vec: str = "vec") -> DataFrame:
    """Mean of the tokens in each window of the pyramid, brought to unit length: ``key``, ``region_no`` and ``vec``.

    ``tokens`` is one array for each photo, of ``dim`` numbers for each place of the grid, row by row; null and wrongly sized
    ones give nothing.  A photo's integral image answers for all windows with four look-ups each; nothing is shuffled.
    """
    at = np.array(windows())
    sizes = (at[:, 2] - at[:, 0]) * (at[:, 3] - at[:, 1])
    schema = T.StructType([photos.schema[key], T.StructField("region_no", T.IntegerType()), T.StructField(vec, T.ArrayType(T.DoubleType()))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, (1 << 21) // (GRID * GRID * dim))  # photos whose integral images are held at once
        for whole in batches:
            for lo in range(0, whole.num_rows, step):
                batch = whole.slice(lo, step)
                grids = batch.column("tokens").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, GRID, GRID, dim)
                total = np.zeros((batch.num_rows, GRID + 1, GRID + 1, dim))
                total[:, 1:, 1:] = grids.cumsum(1).cumsum(2)
                top, left, bottom, right = at.T
                means = (total[:, bottom, right] - total[:, top, right] - total[:, bottom, left] + total[:, top, left]) / sizes[None, :, None]
                norm = np.linalg.norm(means, axis=2, keepdims=True)
                flat = pa.array((means / np.where(norm > 0, norm, 1.0)).ravel())
                n = batch.num_rows * len(at)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("key").take(pa.array(np.repeat(np.arange(batch.num_rows), len(at)))).cast(arrow.field(0).type),
                        pa.array(np.tile(np.arange(len(at), dtype=np.int32), batch.num_rows)),
                        pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), flat).cast(arrow.field(2).type),
                    ],
                    schema=arrow,
                )

    given = photos.where(F.size(tokens) == GRID * GRID * dim).select(F.col(key).alias("key"), F.col(tokens).alias("tokens"))
    return given.mapInArrow(run, schema)
