"""The driver's tables seen as photos, regions, scored pairs, sightings, feedback and file lists.

Each view exists twice with the same meaning: as a DataFrame, and as SQL text for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VIEWS = {
    "f_regions": """
SELECT vec_id AS row_id, CAST(floor(vec_id / 5) AS BIGINT) AS photo_id, CAST(vec_id % 5 AS INT) AS region_no, embedding AS vec,
       CAST(CASE WHEN vec_id % 5 IN (2, 4) THEN 0.5 ELSE 0 END AS DOUBLE) AS x1,
       CAST(CASE WHEN vec_id % 5 IN (3, 4) THEN 0.5 ELSE 0 END AS DOUBLE) AS y1,
       CAST(CASE WHEN vec_id % 5 IN (1, 3) THEN 0.5 ELSE 1 END AS DOUBLE) AS x2,
       CAST(CASE WHEN vec_id % 5 IN (1, 2) THEN 0.5 ELSE 1 END AS DOUBLE) AS y2
FROM embeddings""",
    "f_photos": """
SELECT p.photo_id, concat('/lib/', CAST(p.photo_id % 7 AS VARCHAR), '/', CAST(p.photo_id AS VARCHAR), '.jpg') AS path,
       CASE WHEN p.photo_id % 17 = 0 THEN NULL ELSE e.ts END AS taken_at,
       CASE WHEN p.photo_id % 4 = 0 THEN concat('/lib/v', CAST(p.photo_id % 3 AS VARCHAR), '.mp4') END AS source_video_path,
       1600 AS width, 1200 AS height
FROM (SELECT DISTINCT CAST(floor(vec_id / 5) AS BIGINT) AS photo_id FROM embeddings) p LEFT JOIN events e ON e.event_id = p.photo_id""",
    "f_pairs": """
SELECT l_suppkey AS query_id, l_partkey AS photo_id, l_orderkey AS pair_id, l_linenumber AS pair_no,
       CASE WHEN l_returnflag = 'A' AND l_partkey % 9 = 0 THEN 'twin' WHEN l_returnflag = 'A' THEN 'same' WHEN l_returnflag = 'N' THEN 'same_class' ELSE 'unrelated' END AS label,
       CAST(l_quantity AS INT) AS inliers, CAST(CAST(l_quantity AS INT) + l_partkey % 60 AS INT) AS raw_matches, l_discount AS recall_score
FROM lineitem""",
    "f_sightings": "SELECT user_id AS object_id, event_id AS photo_id, ts AS taken_at, value AS score FROM events",
    "f_feedback": """
SELECT event_id AS seq, user_id AS object_id, event_id % 50 AS photo_id, event_type = 'signup' AS confirmed
FROM events WHERE event_type IN ('signup', 'error')""",
    "f_files_old": """
SELECT concat('/lib/', source, '/', CAST(doc_id AS VARCHAR), CASE WHEN doc_id % 9 = 0 THEN '.mp4' WHEN doc_id % 10 = 0 THEN '.txt' ELSE '.jpg' END) AS path,
       n_chars AS size, doc_id AS mtime_ns FROM documents WHERE doc_id % 17 <> 0""",
    "f_files_new": """
SELECT concat('/lib/', source, '/', CAST(doc_id AS VARCHAR), CASE WHEN doc_id % 9 = 0 THEN '.mp4' WHEN doc_id % 10 = 0 THEN '.txt' ELSE '.jpg' END) AS path,
       n_chars AS size, CASE WHEN doc_id % 13 = 0 THEN doc_id + 1 ELSE doc_id END AS mtime_ns FROM documents WHERE doc_id % 11 <> 0""",
}


def sql(views: str, body: str) -> str:
    """``body`` with the named views in front; it may begin with more common table expressions (``name AS (...)``)."""
    head = ", ".join(f"{v} AS ({VIEWS[v]})" for v in views.split())
    body = body.strip()
    if not head:
        return body
    return f"WITH {head} {body}" if body.upper().startswith("SELECT") else f"WITH {head}, {body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five regions a photo: the whole frame, then its quadrants."""
    no = F.col("vec_id") % 5
    edge = lambda values, then, other: F.when(no.isin(*values), then).otherwise(other).cast("double")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"),
        F.floor(F.col("vec_id") / 5).cast("long").alias("photo_id"),
        no.cast("int").alias("region_no"),
        F.col("embedding").alias("vec"),
        edge((2, 4), 0.5, 0.0).alias("x1"),
        edge((3, 4), 0.5, 0.0).alias("y1"),
        edge((1, 3), 0.5, 1.0).alias("x2"),
        edge((1, 2), 0.5, 1.0).alias("y2"),
    )


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 17th photo has no date, every fourth is a frame of a video."""
    ids = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 5).cast("long").alias("photo_id")).distinct()
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("photo_id"), "ts")
    p = F.col("photo_id")
    return ids.join(events, "photo_id", "left").select(
        "photo_id",
        F.concat(F.lit("/lib/"), (p % 7).cast("string"), F.lit("/"), p.cast("string"), F.lit(".jpg")).alias("path"),
        F.when(p % 17 != 0, F.col("ts")).alias("taken_at"),
        F.when(p % 4 == 0, F.concat(F.lit("/lib/v"), (p % 3).cast("string"), F.lit(".mp4"))).alias("source_video_path"),
        F.lit(1600).alias("width"),
        F.lit(1200).alias("height"),
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored (query, photo) pairs of the size of ``lineitem``."""
    flag = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("query_id"),
        F.col("l_partkey").alias("photo_id"),
        F.col("l_orderkey").alias("pair_id"),
        F.col("l_linenumber").alias("pair_no"),
        F.when((flag == "A") & (F.col("l_partkey") % 9 == 0), "twin").when(flag == "A", "same").when(flag == "N", "same_class").otherwise("unrelated").alias("label"),
        F.col("l_quantity").cast("int").alias("inliers"),
        (F.col("l_quantity").cast("int") + F.col("l_partkey") % 60).cast("int").alias("raw_matches"),
        F.col("l_discount").alias("recall_score"),
    )


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("object_id"), F.col("event_id").alias("photo_id"), F.col("ts").alias("taken_at"), F.col("value").alias("score")
    )


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .where(F.col("event_type").isin("signup", "error"))
        .select(F.col("event_id").alias("seq"), F.col("user_id").alias("object_id"), (F.col("event_id") % 50).alias("photo_id"), (F.col("event_type") == "signup").alias("confirmed"))
    )


def _files(docs: DataFrame, mtime) -> DataFrame:
    d = F.col("doc_id")
    end = F.when(d % 9 == 0, ".mp4").when(d % 10 == 0, ".txt").otherwise(".jpg")
    return docs.select(F.concat(F.lit("/lib/"), "source", F.lit("/"), d.cast("string"), end).alias("path"), F.col("n_chars").alias("size"), mtime.alias("mtime_ns"))


def files_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(table(spark, sf_dir, "documents").where("doc_id % 17 <> 0"), F.col("doc_id"))


def files_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return _files(table(spark, sf_dir, "documents").where("doc_id % 11 <> 0"), F.when(d % 13 == 0, d + 1).otherwise(d))
