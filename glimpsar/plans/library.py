"""Queries of the catalogue: scanning, incremental differences, deletes and upserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import media as M
from ..operators import library as L
from . import fixtures as X
from .registry import query

_KIND = """CASE WHEN starts_with(split_part(path, '/', -1), '.') THEN NULL WHEN lower(regexp_extract(path, '(\\.[^./]+)$', 1)) IN ('.jpg', '.jpeg', '.png', '.heic', '.heif', '.webp', '.tif', '.tiff', '.bmp') THEN 'image'
  WHEN lower(regexp_extract(path, '(\\.[^./]+)$', 1)) IN ('.mp4', '.mov', '.m4v', '.avi', '.mkv', '.webm') THEN 'video' END"""
_ODD = "CASE WHEN size % 12 = 0 THEN replace(path, '/lib/', '/lib/.hidden/') WHEN size % 12 = 1 THEN regexp_replace(path, '/([^/]*)$', '/.\\1') WHEN size % 12 = 2 THEN upper(path) ELSE path END"


@query("scan_media_files", X.sql("f_files_new", f"""
o AS (SELECT {_ODD} AS path, size, mtime_ns FROM f_files_new), k AS (SELECT path, {_KIND} AS kind, size, mtime_ns FROM o)
SELECT * FROM k WHERE kind IS NOT NULL AND NOT starts_with(path, '/lib/src3/')"""))
def scan_media_files(spark, sf_dir):
    """Images and videos by suffix in any case; hidden files are skipped, hidden folders are not; one folder holds the index."""
    n, p = F.col("size") % 12, F.col("path")
    odd = F.when(n == 0, F.replace(p, F.lit("/lib/"), F.lit("/lib/.hidden/"))).when(n == 1, F.regexp_replace(p, r"/([^/]*)$", "/.$1")).when(n == 2, F.upper(p)).otherwise(p)
    files = X.files_new(spark, sf_dir).select(odd.alias("path"), "size", "mtime_ns")
    return files.select("path", M.media_kind(F.col("path")).alias("kind"), "size", "mtime_ns").where("kind is not null").where(~L.under(F.col("path"), "/lib/src3"))


@query("video_frame_grid", X.sql("f_files_new", """
v AS (SELECT path, CAST(size % 40 AS DOUBLE) AS duration FROM f_files_new WHERE ends_with(path, '.mp4')),
g AS (SELECT path, unnest(range(0, CAST(floor(duration / 2) AS BIGINT) + 1)) AS i FROM v)
SELECT path AS source_video_path, CAST(i AS INT) AS frame_no, CAST(i * 2 AS DOUBLE) AS frame_time, substr(sha1(concat(path, '@', i * 2, '.0')), 1, 16) AS photo_id FROM g"""))
def video_frame_grid(spark, sf_dir):
    """A frame every two seconds, at its nominal time, with its id."""
    v = X.files_new(spark, sf_dir).where(F.endswith("path", F.lit(".mp4"))).select("path", (F.col("size") % 40).cast("double").alias("duration"))
    g = v.select("path", F.explode(F.sequence(F.lit(0), F.floor(F.col("duration") / 2).cast("int"))).alias("frame_no"))
    at = (F.col("frame_no") * 2).cast("double")
    return g.select(F.col("path").alias("source_video_path"), "frame_no", at.alias("frame_time"), M.photo_id(F.concat("path", F.lit("@"), at.cast("string"))).alias("photo_id"))


@query("incremental_diff", X.sql("f_files_old f_files_new", """
SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'gone' WHEN o.size = n.size AND o.mtime_ns = n.mtime_ns THEN 'unchanged' ELSE 'changed' END AS action, coalesce(n.size, -1) AS size, coalesce(n.mtime_ns, -1) AS mtime_ns
FROM f_files_old o FULL OUTER JOIN f_files_new n ON o.path = n.path"""))
def incremental_diff(spark, sf_dir):
    return L.diff(X.files_old(spark, sf_dir), X.files_new(spark, sf_dir)).fillna(-1, ["size", "mtime_ns"])


@query("incremental_pending", X.sql("f_files_old f_files_new", """
SELECT n.path, n.size, n.mtime_ns FROM f_files_new n WHERE NOT EXISTS (SELECT 1 FROM f_files_old o WHERE o.path = n.path AND o.size = n.size AND o.mtime_ns = n.mtime_ns)"""))
def incremental_pending(spark, sf_dir):
    return L.pending(X.files_old(spark, sf_dir), X.files_new(spark, sf_dir))


@query("incremental_video", X.sql("f_files_old f_files_new", """
v AS (SELECT * FROM f_files_new WHERE ends_with(path, '.mp4')),
e AS (SELECT path, size, CASE WHEN i = 2 AND size % 5 = 0 THEN mtime_ns - 1 ELSE mtime_ns END AS mtime_ns FROM (SELECT *, unnest(range(0, 3)) AS i FROM f_files_old WHERE ends_with(path, '.mp4')))
SELECT e.path, bool_and(e.size = v.size AND e.mtime_ns = v.mtime_ns) AS unchanged, count(*) AS frames FROM e JOIN v ON e.path = v.path GROUP BY e.path"""))
def incremental_video(spark, sf_dir):
    """Three stored frames a video, some of them older than the video: then it is sampled again."""
    end = F.endswith("path", F.lit(".mp4"))
    frames = X.files_old(spark, sf_dir).where(end).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(2))))
    old = F.when((F.col("i") == 2) & (F.col("size") % 5 == 0), F.col("mtime_ns") - 1).otherwise(F.col("mtime_ns"))
    frames = frames.select(F.col("path").alias("source_video_path"), "size", old.alias("mtime_ns"))
    return L.unchanged_videos(frames, X.files_new(spark, sf_dir).where(end))


@query("stale_under_folder", X.sql("f_files_old f_files_new", """
SELECT path, size, mtime_ns FROM f_files_old WHERE (path = '/lib/src1' OR starts_with(path, '/lib/src1/')) AND path NOT IN (SELECT path FROM f_files_new)"""))
def stale_under_folder(spark, sf_dir):
    """``/lib/src1`` is not a part of ``/lib/src10``."""
    return L.stale(X.files_old(spark, sf_dir), X.files_new(spark, sf_dir), "/lib/src1")


@query("apply_deletes", X.sql("f_files_old f_files_new", "SELECT path, size, mtime_ns FROM f_files_old WHERE path IN (SELECT path FROM f_files_new)"))
def apply_deletes(spark, sf_dir):
    old, new = X.files_old(spark, sf_dir), X.files_new(spark, sf_dir)
    return L.without(old, old.join(new.select("path"), "path", "left_anti"), "path")


@query("upsert_photos", X.sql("f_files_old f_files_new", "SELECT path, size, mtime_ns FROM f_files_new UNION ALL SELECT path, size, mtime_ns FROM f_files_old WHERE path NOT IN (SELECT path FROM f_files_new)"))
def upsert_photos(spark, sf_dir):
    return L.upsert(X.files_old(spark, sf_dir), X.files_new(spark, sf_dir), "path")


@query("feature_cache_misses", X.sql("f_files_old f_files_new", """
SELECT substr(sha1(n.path), 1, 16) AS photo_id, n.mtime_ns, n.size FROM f_files_new n WHERE NOT EXISTS (SELECT 1 FROM f_files_old o WHERE o.path = n.path AND o.size = n.size AND o.mtime_ns = n.mtime_ns)"""))
def feature_cache_misses(spark, sf_dir):
    named = lambda df: df.select(M.photo_id(F.col("path")).alias("photo_id"), "mtime_ns", "size")
    return L.missing_features(named(X.files_new(spark, sf_dir)), named(X.files_old(spark, sf_dir)))


@query("library_status", X.sql("f_photos", "SELECT count(*) AS photos, count(source_video_path) AS frames, count(taken_at) AS dated, min(taken_at) AS first, max(taken_at) AS last FROM f_photos"))
def library_status(spark, sf_dir):
    return X.photos(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("photos"), F.count("source_video_path").alias("frames"), F.count("taken_at").alias("dated"), F.min("taken_at").alias("first"), F.max("taken_at").alias("last")
    )


@query("list_photos", X.sql("f_photos", "SELECT photo_id, path, source_video_path, taken_at, width, height, (SELECT count(*) FROM f_photos) AS total FROM f_photos ORDER BY photo_id LIMIT 25 OFFSET 10"))
def list_photos(spark, sf_dir):
    """One page of the listing, with the number of all photos."""
    photos = X.photos(spark, sf_dir)
    page = photos.orderBy("photo_id").offset(10).limit(25)
    return page.crossJoin(F.broadcast(photos.agg(F.count(F.lit(1)).alias("total"))))


_ROOTS = """
d AS (SELECT g, regexp_replace(coalesce(source_video_path, path), '/[^/]*$', '') AS dir FROM (
   SELECT 'one' AS g, path, source_video_path FROM f_photos WHERE photo_id % 7 = 2 AND photo_id % 4 <> 0 UNION ALL SELECT 'shared', path, source_video_path FROM f_photos
   UNION ALL SELECT 'mixed', CASE WHEN photo_id % 2 = 0 THEN concat('/mnt', path) ELSE path END, NULL FROM f_photos))"""


@query("indexed_folder", X.sql("f_photos", _ROOTS + """
SELECT g AS library, CASE WHEN count(DISTINCT dir) = 1 THEN min(dir) WHEN g = 'shared' THEN '/lib' ELSE concat(count(DISTINCT dir), ' folders') END AS folder, count(DISTINCT dir) AS folders FROM d GROUP BY g"""))
def indexed_folder(spark, sf_dir):
    """Of a library in one folder, of one in several that share a parent, and of one whose folders share nothing."""
    photos = X.photos(spark, sf_dir)
    one = photos.where("photo_id % 7 = 2 and photo_id % 4 <> 0")
    mixed = photos.select(F.when(F.col("photo_id") % 2 == 0, F.concat(F.lit("/mnt"), "path")).otherwise(F.col("path")).alias("path"), F.lit(None).cast("string").alias("source_video_path"))
    parts = [L.indexed_folder(df).select(F.lit(name).alias("library"), "folder", "folders") for name, df in (("one", one), ("shared", photos), ("mixed", mixed))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("index_stats", X.sql("f_files_old f_files_new", """
j AS (SELECT o.path AS op, n.path AS np, n.size AS bytes, o.path IS NOT NULL AND n.path IS NOT NULL AND o.size = n.size AND o.mtime_ns = n.mtime_ns AS same FROM f_files_old o FULL OUTER JOIN f_files_new n ON o.path = n.path)
SELECT count(np) AS total, count(*) FILTER (WHERE np IS NOT NULL AND NOT same) AS indexed, count(*) FILTER (WHERE np IS NULL) AS removed, count(*) FILTER (WHERE same) AS unchanged, CAST(sum(bytes) AS BIGINT) AS bytes,
  round(count(*) FILTER (WHERE np IS NOT NULL AND NOT same) / CAST(12.5 AS DOUBLE), 6) AS per_second FROM j"""))
def index_stats(spark, sf_dir):
    """A run's counters; gone photos are the stale ones only, changed ones count as indexed."""
    d = L.diff(X.files_old(spark, sf_dir), X.files_new(spark, sf_dir))
    seconds = F.lit(12.5)
    indexed = F.count_if(F.col("action").isin("new", "changed"))
    return d.agg(
        F.count_if(F.col("action") != "gone").alias("total"), indexed.alias("indexed"), F.count_if(F.col("action") == "gone").alias("removed"), F.count_if(F.col("action") == "unchanged").alias("unchanged"), F.sum("size").alias("bytes"),
        F.round(F.when(seconds > 0, indexed / seconds).otherwise(0.0), 6).alias("per_second"),
    )
