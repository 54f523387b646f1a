"""Folders as tables: what is there to index, without opening a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.media import media_kind, photo_id
from ..operators.library import under


def scan_folder(spark: SparkSession, folder: str, index_root: str | None = None) -> DataFrame:
    """Images and videos below ``folder``: ``path``, ``kind``, ``photo_id``, ``size``, ``mtime_ns``.

    The content column is pruned, so this reads directory listings only.  Hidden files are skipped (hidden folders are
    not), and so is all below ``index_root``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    path = F.regexp_replace("path", r"^file:/*(?=/)", "")
    listed = files.select(path.alias("path"), F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"))
    found = listed.withColumn("kind", media_kind(F.col("path"))).where("kind is not null")
    if index_root is not None:
        found = found.where(~under(F.col("path"), index_root))
    return found.select("path", "kind", photo_id(F.col("path")).alias("photo_id"), "size", "mtime_ns")


def container_time(captured: DataFrame, column: str = "probe") -> DataFrame:
    """``created_at`` (UTC, without zone) from captured container metadata (JSON); null if it does not read."""
    tags = F.from_json(column, "format struct<tags: struct<creation_time: string>>")
    return captured.withColumn("created_at", F.try_to_timestamp(tags["format"]["tags"]["creation_time"]).cast("timestamp_ntz"))
