"""Queries of the answer: the gate, the timeline, last sightings, duplicate warnings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import gate as G
from ..functions import media as M
from ..operators import timeline as T
from . import fixtures as X
from .registry import query

_GATE = "(inliers >= 30 OR (inliers >= 6 AND CAST(inliers AS DOUBLE) / greatest(raw_matches, 1) >= CAST(0.45 AS DOUBLE)))"


@query("accept_gate", X.sql("f_pairs", f"SELECT pair_id, pair_no, inliers, raw_matches, {_GATE} AS accepted FROM f_pairs"))
def accept_gate(spark, sf_dir):
    return X.pairs(spark, sf_dir).select("pair_id", "pair_no", "inliers", "raw_matches", G.accept(F.col("inliers"), F.col("raw_matches")).alias("accepted"))


@query("accept_gate_params", X.sql("f_pairs", """
g AS (SELECT CAST(unnest([4, 8, 12]) AS INT) AS least), h AS (SELECT CAST(unnest([0.2, 0.6]) AS DOUBLE) AS fraction)
SELECT least, fraction, count(*) AS pairs, count(*) FILTER (WHERE inliers >= 30 OR (inliers >= least AND CAST(inliers AS DOUBLE) / greatest(raw_matches, 1) >= fraction)) AS accepted
FROM f_pairs, g, h GROUP BY least, fraction"""))
def accept_gate_params(spark, sf_dir):
    """Accepted pairs under several parameters, all counted in one pass."""
    grid = [(n, f) for n in (4, 8, 12) for f in (0.2, 0.6)]
    counts = X.pairs(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("pairs"), *[F.count_if(G.accept(F.col("inliers"), F.col("raw_matches"), n, f)).alias(f"a{i}") for i, (n, f) in enumerate(grid)]
    )
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("least"), F.lit(f).alias("fraction"), F.col(f"a{i}").alias("accepted")) for i, (n, f) in enumerate(grid)]))
    return counts.select("pairs", rows.alias("g")).select("g.least", "g.fraction", "pairs", "g.accepted")


_MATCHES = f"""
m AS (SELECT p.query_id, p.pair_id, p.pair_no, p.photo_id, p.inliers, p.recall_score AS score, h.taken_at FROM f_pairs p JOIN f_photos h ON p.photo_id = h.photo_id
      WHERE {_GATE} AND p.pair_no <> 7)"""


def _matches(spark, sf_dir):
    """Accepted pairs that have a box (a seventh of an order's lines has none), with their photos' dates."""
    pairs = X.pairs(spark, sf_dir).where(G.accept(F.col("inliers"), F.col("raw_matches")) & (F.col("pair_no") != 7))
    photos = X.photos(spark, sf_dir).select("photo_id", "taken_at")
    return pairs.join(photos, "photo_id").select("query_id", "pair_id", "pair_no", "photo_id", "inliers", F.col("recall_score").alias("score"), "taken_at")


@query("timeline", X.sql("f_pairs f_photos", _MATCHES + """
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY taken_at ASC NULLS LAST, photo_id, pair_id, pair_no) AS INT) AS place, photo_id, pair_id, pair_no, inliers AS inlier_count, score, true AS verified, taken_at FROM m"""))
def timeline(spark, sf_dir):
    place = F.row_number().over(T.ordered("query_id", "photo_id", "pair_id", "pair_no"))
    return _matches(spark, sf_dir).select("query_id", place.alias("place"), "photo_id", "pair_id", "pair_no", F.col("inliers").alias("inlier_count"), "score", F.lit(True).alias("verified"), "taken_at")


_SEEN = """
z AS (SELECT object_id, photo_id, CASE WHEN object_id % 10 = 0 OR photo_id % 17 = 0 THEN NULL ELSE date_trunc('hour', taken_at) END AS taken_at, score FROM f_sightings)"""


def _seen(spark, sf_dir):
    """Sightings to the hour (so that some are equal); some are undated, and some objects' all are."""
    undated = (F.col("object_id") % 10 == 0) | (F.col("photo_id") % 17 == 0)
    at = F.when(~undated, F.date_trunc("hour", F.col("taken_at")).cast("timestamp_ntz"))
    return X.sightings(spark, sf_dir).select("object_id", "photo_id", at.alias("taken_at"), "score")


@query("last_seen", X.sql("f_sightings", _SEEN + """,
o AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY taken_at ASC NULLS LAST, photo_id) AS place FROM z),
r AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY taken_at DESC NULLS LAST, CASE WHEN taken_at IS NULL THEN -place ELSE place END) AS n FROM o)
SELECT object_id, photo_id, taken_at, score FROM r WHERE n = 1"""))
def last_seen(spark, sf_dir):
    return T.last_seen(_seen(spark, sf_dir))


@query("last_seen_vs_newest", X.sql("f_sightings", _SEEN + """,
a AS (SELECT object_id, max(taken_at) AS newest, max(taken_at) FILTER (WHERE score >= 50) AS last_verified FROM z GROUP BY object_id)
SELECT object_id, newest, last_verified, newest IS DISTINCT FROM last_verified AS ignored_newer FROM a"""))
def last_seen_vs_newest(spark, sf_dir):
    """The newest candidate against the newest verified one, in one pass."""
    a = _seen(spark, sf_dir).groupBy("object_id").agg(F.max("taken_at").alias("newest"), F.max(F.when(F.col("score") >= 50, F.col("taken_at"))).alias("last_verified"))
    return a.withColumn("ignored_newer", ~F.col("newest").eqNullSafe(F.col("last_verified")))


@query("duplicate_photos", X.sql("f_pairs", f"""
SELECT query_id, photo_id, count(*) FILTER (WHERE {_GATE}) AS detections FROM f_pairs GROUP BY query_id, photo_id HAVING count(*) FILTER (WHERE {_GATE}) >= 2"""))
def duplicate_photos(spark, sf_dir):
    """Photos with two accepted detections or more of one query's object."""
    counted = X.pairs(spark, sf_dir).groupBy("query_id", "photo_id").agg(F.count_if(G.accept(F.col("inliers"), F.col("raw_matches"))).alias("detections"))
    return counted.where("detections >= 2")


@query("duplicate_warning", X.sql("f_pairs", f"""
d AS (SELECT query_id, photo_id, count(*) FILTER (WHERE {_GATE}) AS detections, max(recall_score) AS score FROM f_pairs GROUP BY query_id, photo_id),
e AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, photo_id) AS n FROM d WHERE detections >= 2)
SELECT query_id, max(detections) AS copies, count(*) AS photos, concat('Seen ', max(detections), ' times in photo ', max(photo_id) FILTER (WHERE n = 1), '.jpg',
  CASE WHEN count(*) > 1 THEN concat(', and more than once in ', count(*) - 1, ' more') ELSE '' END, ': the matches need not be one and the same thing.') AS warning FROM e GROUP BY query_id"""))
def duplicate_warning(spark, sf_dir):
    """Per query: most detections in one photo, photos with several, and a sentence naming the first by score."""
    d = (
        X.pairs(spark, sf_dir)
        .groupBy("query_id", "photo_id")
        .agg(F.count_if(G.accept(F.col("inliers"), F.col("raw_matches"))).alias("detections"), F.max("recall_score").alias("score"))
        .where("detections >= 2")
    )
    first = F.max_by("photo_id", F.struct(F.col("score"), -F.col("photo_id")))
    a = d.groupBy("query_id").agg(F.max("detections").alias("copies"), F.count(F.lit(1)).alias("photos"), first.alias("first"))
    return a.select("query_id", "copies", "photos", T.several_text(F.col("copies"), F.concat(F.lit("photo "), F.col("first").cast("string"), F.lit(".jpg")), F.col("photos")).alias("warning"))


_LAGGED = """,
l AS (SELECT *, lag(taken_at) OVER (PARTITION BY object_id ORDER BY taken_at ASC NULLS LAST, photo_id) AS before FROM z),
g AS (SELECT *, coalesce((epoch_us(taken_at) - epoch_us(before)) / CAST(86400000000 AS DOUBLE), 0) AS days FROM l)"""
#: Sightings forty times as far apart, so that gaps of weeks and years come about.
_APART = _SEEN.replace("z AS", "y AS") + """,
z AS (SELECT object_id, photo_id, score, make_timestamp(epoch_us(TIMESTAMP '2000-01-01') + 40 * (epoch_us(taken_at) - epoch_us(TIMESTAMP '2024-01-01'))) AS taken_at FROM y)"""


def _apart(spark, sf_dir):
    micros = F.unix_micros(F.col("taken_at").cast("timestamp"))
    start, base = (F.unix_micros(F.to_timestamp(F.lit(f"{y}-01-01 00:00:00"))) for y in (2024, 2000))
    return _seen(spark, sf_dir).withColumn("taken_at", F.timestamp_micros(base + 40 * (micros - start)).cast("timestamp_ntz"))


@query("timeline_gaps", X.sql("f_sightings", _APART + _LAGGED + """,
t AS (SELECT *, CAST(floor(days / CAST(365.25 AS DOUBLE)) AS BIGINT) AS y, CAST(floor((days - floor(days / CAST(365.25 AS DOUBLE)) * CAST(365.25 AS DOUBLE)) / CAST(30.44 AS DOUBLE)) AS BIGINT) AS m FROM g)
SELECT object_id, photo_id, round(days, 6) AS days, CASE WHEN days > 21 THEN round(least(72, 14 + (log2(days) - 4.4) * 12), 4) END AS gap_px,
  CASE WHEN days > 21 THEN CASE WHEN y <> 0 AND m <> 0 THEN concat(y, ' yr ', m, ' mo') WHEN y <> 0 THEN concat(y, ' yr') WHEN m <> 0 THEN concat(m, ' mo') ELSE concat(CAST(floor(days + 0.5) AS BIGINT), ' days') END END AS gap_text FROM t"""))
def timeline_gaps(spark, sf_dir):
    """Days between sightings, and how long and with what words a gap is drawn."""
    out = T.with_gaps(_apart(spark, sf_dir))
    return out.select("object_id", "photo_id", F.round("days", 6).alias("days"), F.round("gap_px", 4).alias("gap_px"), "gap_text")


@query("timeline_year_breaks", X.sql("f_sightings", _APART + _LAGGED + """
SELECT object_id, photo_id, CAST(coalesce(year(taken_at), 0) AS INT) AS year, taken_at IS NOT NULL AND (before IS NULL OR year(before) <> year(taken_at)) AS new_year FROM g"""))
def timeline_year_breaks(spark, sf_dir):
    return T.with_year_breaks(_apart(spark, sf_dir)).select("object_id", "photo_id", F.coalesce("year", F.lit(0)).alias("year"), "new_year")


@query("timeline_summary", X.sql("f_sightings", _SEEN + """,
a AS (SELECT object_id, count(*) AS sightings, min(taken_at) AS first, max(taken_at) AS last, count(taken_at) AS dated FROM z GROUP BY object_id),
b AS (SELECT *, CASE WHEN dated > 1 THEN (epoch_us(last) - epoch_us(first)) / CAST(86400000000 AS DOUBLE) ELSE 0 END AS arc FROM a),
y AS (SELECT *, CAST(floor(arc / CAST(365.25 AS DOUBLE)) AS BIGINT) AS y FROM b), w AS (SELECT *, CAST(floor((arc - y * CAST(365.25 AS DOUBLE)) / CAST(30.44 AS DOUBLE)) AS BIGINT) AS m FROM y)
SELECT object_id, sightings, first, last, round(arc, 6) AS arc_days,
  CASE WHEN arc > 0 THEN CASE WHEN y <> 0 AND m <> 0 THEN concat(y, ' yr ', m, ' mo') WHEN y <> 0 THEN concat(y, ' yr') WHEN m <> 0 THEN concat(m, ' mo') ELSE concat(CAST(floor(arc + 0.5) AS BIGINT), ' days') END END AS across FROM w"""))
def timeline_summary(spark, sf_dir):
    s = T.summary(_seen(spark, sf_dir))
    across = F.when(F.col("arc_days") > 0, M.span_text(F.col("arc_days")))
    return s.select("object_id", "sightings", "first", "last", F.round("arc_days", 6).alias("arc_days"), across.alias("across"))


@query("latency_stats", """
SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median, min(value) AS least, max(value) AS most FROM events WHERE value IS NOT NULL GROUP BY event_type""")
def latency_stats(spark, sf_dir):
    """Here the median is the mean of the two middle values."""
    return X.table(spark, sf_dir, "events").where("value is not null").groupBy("event_type").agg(
        F.round(F.percentile("value", F.lit(0.5)), 6).alias("median"), F.min("value").alias("least"), F.max("value").alias("most")
    )
