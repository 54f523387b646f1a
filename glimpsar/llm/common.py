"""Plumbing shared by the operators: Arrow mapping, shared tables and size-checked joins."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: A side of a join is broadcast only if its measured rows times their width in memory stay below this.
BROADCAST_BYTES, ROW_OVERHEAD = 32 << 20, 80
#: Bytes of an Arrow batch that Spark sends to Python (one row at least).
BATCH_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the session names none, a plain local one gets a temporary folder of this machine; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), f"glimpsar-{os.getpid()}")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there.

    A lost executor costs no recomputation of what is above, and nothing lives in executors' own
    folders.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


_written: list[str] = []


def discard_stored(spark: SparkSession) -> None:
    """Delete all tables that ``stored`` has written in this session.

    Results are lazy and read them, so call this once the results themselves have been written.
    """
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def mapped(df: DataFrame, rows: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """``mapInArrow`` for rows that may hold long texts.

    Spark's bound on the bytes of an Arrow batch, 64 MB unless told otherwise, is lowered to ``BATCH_BYTES``: workers hold several
    copies of what they work on.  It has to hold until the plan runs, so it stays with the session; it decides nothing
    but how much is sent at once.  At the end of a task memory that is free goes back to the system, as workers live on.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < _bytes(conf.get(name, "64m")) <= BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # tasks make no cycles, and the collector would walk their caches again and again
        try:
            yield from rows(batches)
        finally:
            gc.enable()
            release()

    return df.mapInArrow(run, schema)


def _bytes(size: str) -> int:
    """A size as Spark writes it: 67108864b, 64m."""
    number, unit = re.fullmatch(r"(-?\d+)\s*([a-z]*)", size.strip().lower()).groups()
    return int(number) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30}[unit[:1]]


def release() -> None:
    """Give freed memory back to the operating system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def arrow_schema(schema: T.StructType) -> pa.Schema:
    return to_arrow_schema(schema)


def col(name: str) -> Column:
    """A column by its very name, whatever characters that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(taken: Iterable[str], *wanted: str) -> list[str]:
    """Names like ``wanted`` that no column in ``taken`` has, in any case."""
    held = {name.lower() for name in taken}
    out = []
    for name in wanted:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


def pieces(batches: Iterable[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """``batches`` cut and joined so that ``column``'s strings come to about ``limit`` bytes (one row at least)."""
    held: list[pa.RecordBatch] = []
    total = 0

    def joined() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        lo = 0
        for i, n in enumerate(sizes):
            if total and total + n > limit:
                if i > lo:
                    held.append(batch.slice(lo, i - lo))
                yield joined()
                held, total, lo = [], 0, i
            total += n
        if lo < len(sizes):
            held.append(batch.slice(lo))
    if held:
        yield joined()


def extended(docs: DataFrame, text_col: str, made: Callable[[], Callable[[pa.RecordBatch, int], list]], fields: list[T.StructField], limit: int = 4 << 20) -> DataFrame:
    """``docs`` and more columns that each row's text decides; no row is moved, and other columns pass, whatever their names.

    ``made`` is called once in a task; what it gives turns a batch and the number of its text column into the new columns.
    """
    at, schema = docs.columns.index(text_col), T.StructType([*docs.schema.fields, *fields])
    out_schema = arrow_schema(schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        more = made()
        for batch in pieces(batches, str(at), limit):
            own = [batch.column(i).cast(out_schema.field(i).type) for i in range(batch.num_columns)]
            new = [pa.array(c, out_schema.field(len(own) + i).type) for i, c in enumerate(more(batch, at))]
            yield pa.RecordBatch.from_arrays([*own, *new], schema=out_schema)

    # Spark does not pass columns with odd names (``a.b``) to Python: they go by number, and come back under their names.
    return mapped(docs.toDF(*map(str, range(len(docs.columns)))), rows, schema)


def utf8(column: pa.Array) -> list[bytes]:
    """The values of a string column as bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def fits(rows: int, row_bytes: int) -> bool:
    """Whether so many rows may be broadcast: a hash table takes ``ROW_OVERHEAD`` bytes for each of them besides."""
    return rows * (row_bytes + ROW_OVERHEAD) <= BROADCAST_BYTES


def small_or_hashed(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` marked for broadcast if its measured size allows, else for a shuffled hash join.

    ``df`` has to be stored or cheap to count.  The hash table of a shuffled join is built from this
    side, so that the other one (texts) is never sorted.
    """
    return F.broadcast(df) if fits(df.count(), row_bytes) else df.hint("shuffle_hash")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
