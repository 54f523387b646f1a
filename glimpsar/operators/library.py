"""The catalogue's life: comparing scans with what is stored, deleting, upserting, finding missing features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.media import parent


def diff(old: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """``key`` and ``action``: new, changed, gone or unchanged.  A file is unchanged if size and mtime both are."""
    a = old.select(key, F.col("size").alias("old_size"), F.col("mtime_ns").alias("old_mtime"), F.lit(True).alias("was"))
    b = new.select(key, "size", "mtime_ns", F.lit(True).alias("is"))
    same = F.col("old_size").eqNullSafe(F.col("size")) & F.col("old_mtime").eqNullSafe(F.col("mtime_ns"))
    action = F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "gone").when(same, "unchanged").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, action.alias("action"), "size", "mtime_ns")


def pending(old: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """The scanned files that have to be indexed: those without a stored twin of the same size and mtime."""
    same = [F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in (key, "size", "mtime_ns")]
    return new.alias("n").join(old.alias("o"), same, "left_anti")


def unchanged_videos(frames: DataFrame, videos: DataFrame) -> DataFrame:
    """Videos that have frames, all of which carry the video's present size and mtime."""
    stored = frames.where(F.col("source_video_path").isNotNull()).select(F.col("source_video_path").alias("path"), "size", "mtime_ns")
    joined = stored.alias("f").join(videos.alias("v"), "path")
    same = (F.col("f.size") == F.col("v.size")) & (F.col("f.mtime_ns") == F.col("v.mtime_ns"))
    return joined.groupBy("path").agg(F.every(same).alias("unchanged"), F.count(F.lit(1)).alias("frames"))


def under(path: Column, folder: str) -> Column:
    """Whether a path is the folder or lies in it (not merely begins with its name)."""
    return (path == folder) | path.startswith(folder.rstrip("/") + "/")


def stale(stored: DataFrame, seen: DataFrame, folder: str, key: str = "path") -> DataFrame:
    """Stored rows within ``folder`` that the scan of it has not seen; other folders are none of its business."""
    return stored.where(under(F.col(key), folder)).join(seen.select(key), key, "left_anti")


def without(stored: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return stored.join(gone.select(key), key, "left_anti")


def upsert(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Fresh rows replace stored ones of the same key."""
    return without(stored, fresh, key).unionByName(fresh)


def missing_features(photos: DataFrame, cache: DataFrame) -> DataFrame:
    """Photos without cached features for their present size and mtime: a changed file never gets its old ones."""
    return photos.join(cache.select("photo_id", "mtime_ns", "size"), ["photo_id", "mtime_ns", "size"], "left_anti")


def indexed_folder(photos: DataFrame) -> DataFrame:
    """The folder that all sources lie in, or how many folders there are if they share none; null without photos.

    The common path of all folders is that of the smallest and the largest, part by part.
    """
    folder = parent(F.coalesce("source_video_path", "path"))
    ends = photos.select(F.split(folder, "/").alias("d")).agg(F.min("d").alias("a"), F.max("d").alias("b"), F.countDistinct("d").alias("n"))
    least = F.least(F.size("a"), F.size("b"))
    parts = F.sequence(F.lit(0), least - 1)
    differ = F.filter(parts, lambda i: F.get("a", i) != F.get("b", i))
    shared = F.when(F.size(differ) > 0, F.array_min(differ)).otherwise(least)
    root = F.array_join(F.slice("a", F.lit(1), shared), "/")
    text = F.when(F.col("n") == 1, F.array_join("a", "/")).when(root.isin("", "/"), F.concat(F.col("n").cast("string"), F.lit(" folders"))).otherwise(root)
    return ends.select(F.when(F.col("n") > 0, text).alias("folder"), F.col("n").alias("folders"))
