"""Indexing a folder: scan, compare, read what is new or changed, drop what is gone."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import library as L
from .files import scan_folder
from .providers import CHUNK, Provider, chunks, with_content
from .store import IndexStore


@dataclass(frozen=True)
class Progress:
    """How far a run has come: its phase, and files done and to do."""

    phase: str
    done: int = 0
    todo: int = 0


@dataclass
class Run:
    """What a run has done.  Frames count as photos; ``kept`` are the files that were as they had been."""

    photos_indexed: int = 0
    photos_removed: int = 0
    frames: int = 0
    kept: int = 0
    total_photos: int = 0
    index_bytes: int = 0
    took: float = 0.0

    def rate(self) -> float:
        """Photos a second."""
        return self.photos_indexed / self.took if self.took > 0 else 0.0


def index_folder(store: IndexStore, folder: str, provider: Provider, report: Callable[[Progress], None] = lambda _: None, chunk: int = CHUNK, features: bool = True) -> Run:
    """Bring the store up to date with ``folder``; a second run over unchanged files writes nothing.

    Files are taken ``chunk`` at a time, and each chunk is one commit, so a run that is broken off keeps what it has done.  A video
    is taken apart anew if it or any of its frames' notes of it have changed, whatever interval its frames were made with.
    Without ``features`` keypoints are left to be found when they are asked for.
    """
    began, run = time.perf_counter(), Run()
    report(Progress("scanning"))
    scanned = scan_folder(store.spark, folder, store.root)
    seen = (scanned if provider.videos else scanned.where("kind = 'image'")).persist()
    stored = store.table("photos").persist()
    try:
        stills, frames = stored.where("source_video_path is null"), stored.where("source_video_path is not null")
        images, videos = seen.where("kind = 'image'"), seen.where("kind = 'video'")
        same = L.unchanged_videos(frames, videos).where("unchanged").select("path")
        changed = videos.join(same, "path", "left_anti")
        todo = L.pending(stills.select("photo_id", "size", "mtime_ns"), images, "photo_id").unionByName(changed).persist()
        gone = L.stale(stills, images, folder, "path").select("photo_id")
        if provider.videos:
            gone = gone.unionByName(L.stale(frames, videos.withColumnRenamed("path", "source_video_path"), folder, "source_video_path").select("photo_id"))
            gone = gone.unionByName(frames.join(changed.select(F.col("path").alias("source_video_path")), "source_video_path", "left_semi").select("photo_id"))
        waiting, run.photos_removed = todo.count(), gone.count()
        run.kept = seen.count() - waiting
        if run.photos_removed:
            store.drop_photos(gone)
        done = 0
        for part in chunks(todo, chunk):
            report(Progress("reading", done, waiting))
            files = with_content(part)
            entries = provider.photos(files).persist()
            store.upsert_photos(entries, provider.regions(files), provider.keypoints(files) if features else None)
            n, from_videos = entries.agg(F.count(F.lit(1)), F.count("source_video_path")).first()
            run.photos_indexed, run.frames = run.photos_indexed + n, run.frames + from_videos
            entries.unpersist()
            done += part.count()
        todo.unpersist()
    finally:
        seen.unpersist()
        stored.unpersist()
    run.total_photos, run.index_bytes, run.took = store.table("photos").count(), store.size(), time.perf_counter() - began
    report(Progress("done", waiting, waiting))
    return run


def missing_keypoints(store: IndexStore, provider: Provider, photos: DataFrame) -> int:
    """Find and keep the keypoints of those of ``photos`` (``photo_id``) that have none for their present file; how many photos that were.

    A photo in which nothing stands out is looked at again each time.
    """
    wanted = store.table("photos").join(F.broadcast(photos.select("photo_id").distinct()), "photo_id", "left_semi")
    known = store.table("keypoints").join(F.broadcast(photos.select("photo_id").distinct()), "photo_id", "left_semi").select("photo_id", "mtime_ns", "size").distinct()
    missing = L.missing_features(wanted, known).persist()
    count = missing.count()
    if count:
        video = F.col("source_video_path")
        kind = F.when(video.isNotNull(), "video").otherwise("image")
        # The frames of a video share a file; which of them are wanted is told by their own ids afterwards.
        ids = F.when(video.isNotNull(), F.substring(F.sha1(video), 1, 16)).otherwise(F.col("photo_id"))
        files = missing.select(F.coalesce(video, "path").alias("path"), kind.alias("kind"), ids.alias("photo_id"), "size", "mtime_ns").distinct()
        for part in chunks(files):
            found = provider.keypoints(with_content(part)).join(F.broadcast(missing.select("photo_id")), "photo_id", "left_semi")
            store.commit({"keypoints": found})
    missing.unpersist()
    return count
