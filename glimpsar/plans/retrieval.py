"""Queries of stage one: nearest regions, photos, exemplars and feedback."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vectors as V
from ..operators import feedback as B
from ..operators import recall as R
from . import fixtures as X
from .registry import query

#: The photo that is asked about, and how many photos are wanted.
SOURCE, TOP_K = 0, 20

_SCORED = """
q AS (SELECT region_no AS query_no, vec FROM f_regions WHERE photo_id = 0),
s AS (SELECT q.query_no, r.row_id, r.photo_id, round(list_inner_product(q.vec::DOUBLE[], r.vec::DOUBLE[]), 6) AS score FROM f_regions r, q)"""
_BEST = _SCORED + """,
b AS (SELECT photo_id, score, row_id FROM (SELECT *, row_number() OVER (PARTITION BY photo_id ORDER BY score DESC, row_id) AS n FROM s) WHERE n = 1),
t AS (SELECT * FROM b ORDER BY score DESC, photo_id LIMIT 20)"""


def _queries(spark, sf_dir):
    return X.regions(spark, sf_dir).where(F.col("photo_id") == SOURCE).select(F.col("region_no").alias("query_no"), "vec")


@query("knn_exact", X.sql("f_regions", _SCORED + """,
n AS (SELECT *, row_number() OVER (PARTITION BY query_no ORDER BY score DESC, row_id) AS rank FROM s)
SELECT query_no, CAST(rank AS INT) AS rank, row_id, photo_id, score FROM n WHERE rank <= 20"""))
def knn_exact(spark, sf_dir):
    return R.knn_exact(X.regions(spark, sf_dir), _queries(spark, sf_dir), 20).select("query_no", F.col("rank").cast("int").alias("rank"), "row_id", "photo_id", "score")


@query("best_region_per_photo", X.sql("f_regions", _BEST + " SELECT photo_id, score, row_id FROM b"))
def best_region_per_photo(spark, sf_dir):
    return R.best_region_per_photo(R.best_scores(X.regions(spark, sf_dir), _queries(spark, sf_dir)))


@query("recall_topk", X.sql("f_regions", _BEST + " SELECT photo_id, score, row_id FROM t WHERE photo_id <> 0"))
def recall_topk(spark, sf_dir):
    """The source photo is dropped after the limit, so 19 photos remain."""
    return R.recall(X.regions(spark, sf_dir), _queries(spark, sf_dir), TOP_K, SOURCE)


@query("recall_alive", X.sql("f_regions f_photos", _SCORED + """,
a AS (SELECT s.* FROM s WHERE photo_id IN (SELECT photo_id FROM f_photos WHERE photo_id % 3 <> 1)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_no ORDER BY score DESC, row_id) AS rank FROM a),
b AS (SELECT photo_id, score, row_id FROM (SELECT *, row_number() OVER (PARTITION BY photo_id ORDER BY score DESC, row_id) AS n FROM r WHERE rank <= 30 * 20) WHERE n = 1),
t AS (SELECT * FROM b ORDER BY score DESC, photo_id LIMIT 30)
SELECT photo_id, score, row_id FROM t WHERE photo_id <> 0"""))
def recall_alive(spark, sf_dir):
    """A third of the photos are gone, and their regions take nobody's place; no more are looked for than are left."""
    there = X.photos(spark, sf_dir).where("photo_id % 3 <> 1")
    return R.recall(X.regions(spark, sf_dir), _queries(spark, sf_dir), 30, SOURCE, photos=there)


_STATE = """
lastr AS (SELECT object_id, photo_id, max(seq) FILTER (WHERE NOT confirmed) AS rejected_at, arg_max(confirmed, seq) AS confirmed FROM f_feedback GROUP BY object_id, photo_id),
st AS (SELECT l.object_id, l.photo_id, l.confirmed, CASE WHEN l.confirmed THEN (SELECT min(f.seq) FROM f_feedback f WHERE f.object_id = l.object_id AND f.photo_id = l.photo_id AND f.confirmed AND f.seq > coalesce(l.rejected_at, -1)) END AS box_seq FROM lastr l)"""


@query("feedback_state", X.sql("f_feedback", _STATE.strip() + " SELECT object_id, photo_id, confirmed, coalesce(box_seq, -1) AS box_seq, CAST(count(*) FILTER (WHERE confirmed) OVER (PARTITION BY object_id) AS BIGINT) AS exemplars FROM st"))
def feedback_state(spark, sf_dir):
    state = B.feedback_state(X.feedback(spark, sf_dir))
    return state.fillna(-1, ["box_seq"]).withColumn("exemplars", F.count_if("confirmed").over(Window.partitionBy("object_id")))


@query("feedback_fold", X.sql("", """
WITH RECURSIVE taps AS (SELECT event_id AS seq, user_id AS object_id, event_id % 12 AS photo_id, CASE event_type WHEN 'signup' THEN 'confirm' WHEN 'error' THEN 'reject' ELSE 'seed' END AS kind FROM events WHERE event_type IN ('signup', 'error') OR event_id % 3 = 0),
t AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY seq) AS k FROM taps),
g AS (SELECT object_id, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(photo_id BIGINT, box_seq BIGINT)[]) AS state FROM (SELECT DISTINCT object_id FROM taps)
  UNION ALL
  SELECT g.object_id, t.k, CASE
      WHEN t.kind <> 'reject' AND len(list_filter(g.state, lambda o: o.photo_id = t.photo_id AND o.box_seq IS NOT NULL)) > 0 THEN g.state
      WHEN t.kind = 'seed' AND len(list_filter(g.state, lambda o: o.box_seq IS NOT NULL)) > 0 THEN g.state
      ELSE list_append(list_filter(g.state, lambda o: o.photo_id <> t.photo_id), struct_pack(photo_id := t.photo_id, box_seq := CASE WHEN t.kind = 'reject' THEN NULL ELSE t.seq END)) END
  FROM g JOIN t ON g.object_id = t.object_id AND t.k = g.k + 1),
e AS (SELECT object_id, unnest(state) AS s FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY k DESC) AS last FROM g) WHERE last = 1)
SELECT object_id, s.photo_id AS photo_id, s.box_seq IS NOT NULL AS confirmed, coalesce(s.box_seq, -1) AS box_seq FROM e"""))
def feedback_fold(spark, sf_dir):
    """Logs in which objects are seeded again and again, replayed step by step."""
    kind = F.when(F.col("event_type") == "signup", "confirm").when(F.col("event_type") == "error", "reject").otherwise("seed")
    taps = X.table(spark, sf_dir, "events").where(F.col("event_type").isin("signup", "error") | (F.col("event_id") % 3 == 0))
    log = taps.select(F.col("user_id").alias("object_id"), (F.col("event_id") % 12).alias("photo_id"), F.col("event_id").alias("seq"), kind.alias("kind"))
    return B.fold_ordered(log).fillna(-1, ["box_seq"])


@query("recall_with_feedback", X.sql("f_regions f_feedback", _BEST.strip() + "," + _STATE + """
SELECT photo_id, score, row_id FROM t WHERE photo_id <> 0 AND photo_id NOT IN (SELECT photo_id FROM st WHERE NOT confirmed AND object_id = (SELECT min(object_id) FROM f_feedback))"""))
def recall_with_feedback(spark, sf_dir):
    """What the first object's user has rejected is dropped after the limit as well."""
    regions, log = X.regions(spark, sf_dir), X.feedback(spark, sf_dir)
    own = log.join(F.broadcast(log.agg(F.min("object_id").alias("object_id"))), "object_id")
    rejected = B.feedback_state(own).where("not confirmed")
    return R.recall(regions, _queries(spark, sf_dir), TOP_K, SOURCE, rejected)


@query("active_exemplars", X.sql("f_photos f_feedback", _STATE.strip() + """,
boxes AS (SELECT object_id, photo_id, CAST(box_seq % 4 AS DOUBLE) / 10 AS x1, CAST(box_seq % 3 AS DOUBLE) / 10 AS y1, CAST(box_seq % 4 AS DOUBLE) / 10 + CAST(0.5 AS DOUBLE) AS x2, CAST(box_seq % 3 AS DOUBLE) / 10 + CAST(0.5 AS DOUBLE) AS y2 FROM st WHERE confirmed),
fresh AS (SELECT DISTINCT object_id, object_id % 50 AS photo_id, CAST(0 AS DOUBLE) AS x1, CAST(0 AS DOUBLE) AS y1, CAST(0.5 AS DOUBLE) AS x2, CAST(0.5 AS DOUBLE) AS y2 FROM f_feedback),
u AS (SELECT *, 0 AS priority FROM fresh UNION ALL SELECT b.*, 1 FROM boxes b WHERE photo_id IN (SELECT photo_id FROM f_photos WHERE photo_id % 11 <> 3))
SELECT object_id, photo_id, x1, y1, x2, y2, min(priority) AS priority FROM u GROUP BY object_id, photo_id, x1, y1, x2, y2"""))
def active_exemplars(spark, sf_dir):
    log = X.feedback(spark, sf_dir)
    b = F.col("box_seq")
    boxes = B.feedback_state(log).where("confirmed").select(
        "object_id", "photo_id", ((b % 4).cast("double") / 10).alias("x1"), ((b % 3).cast("double") / 10).alias("y1"), ((b % 4).cast("double") / 10 + 0.5).alias("x2"), ((b % 3).cast("double") / 10 + 0.5).alias("y2")
    )
    fresh = log.select("object_id", (F.col("object_id") % 50).alias("photo_id")).distinct().select("*", *[F.lit(v).alias(c) for c, v in (("x1", 0.0), ("y1", 0.0), ("x2", 0.5), ("y2", 0.5))])
    return R.active_exemplars(fresh, boxes, X.photos(spark, sf_dir).where("photo_id % 11 <> 3"))


@query("score_by_class", X.sql("f_regions", """
l AS (SELECT r.*, e.label FROM f_regions r JOIN embeddings e ON e.vec_id = r.row_id), q AS (SELECT label AS l, vec AS u FROM l WHERE photo_id = 0)
SELECT q.l = r.label AS same_label, count(*) AS n, round(avg(list_inner_product(q.u::DOUBLE[], r.vec::DOUBLE[])), 6) AS mean_score FROM l r, q WHERE r.photo_id <> 0 GROUP BY 1"""))
def score_by_class(spark, sf_dir):
    """Mean score of the source photo's regions with all others, by whether their labels agree."""
    labels = X.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), "label")
    r = X.regions(spark, sf_dir).join(labels, "row_id")
    q = F.broadcast(r.where(F.col("photo_id") == SOURCE).select(F.col("label").alias("l"), F.col("vec").alias("u")))  # five regions
    joined = r.where(F.col("photo_id") != SOURCE).crossJoin(q)
    return joined.groupBy((F.col("l") == F.col("label")).alias("same_label")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(V.dot(F.col("u"), F.col("vec"))), 6).alias("mean_score"))


@query("knn_lsh")
def knn_lsh(spark, sf_dir):
    return R.knn_lsh(X.regions(spark, sf_dir), _queries(spark, sf_dir), 20)


@query("knn_ivf")
def knn_ivf(spark, sf_dir):
    regions = X.regions(spark, sf_dir)
    centres = R.ivf_cells(regions)
    return R.knn_ivf(R.with_cell(regions, centres), centres, _queries(spark, sf_dir), 20)


@query("capture_time_fallback", X.sql("f_photos", """
SELECT photo_id, coalesce(taken_at, CASE WHEN source_video_path IS NOT NULL THEN TIMESTAMP '2021-03-01 00:00:00' ELSE TIMESTAMP '2020-01-01 00:00:00' + to_seconds(photo_id) END
  + to_seconds(CASE WHEN source_video_path IS NOT NULL THEN photo_id * 2 ELSE 0 END)) AS taken_at, taken_at IS NULL AND source_video_path IS NULL AS taken_at_inferred FROM f_photos"""))
def capture_time_fallback(spark, sf_dir):
    """The picture's own time, else its video's (or its file's) and the frame's offset."""
    video = F.col("source_video_path").isNotNull()
    plus = lambda t, s: t + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), s.cast("decimal(18,6)"))
    file_time = plus(F.to_timestamp_ntz(F.lit("2020-01-01 00:00:00")), F.col("photo_id"))
    base = F.when(video, F.to_timestamp_ntz(F.lit("2021-03-01 00:00:00"))).otherwise(file_time)
    guess = plus(base, F.when(video, F.col("photo_id") * 2).otherwise(F.lit(0)))
    return X.photos(spark, sf_dir).select("photo_id", F.coalesce(F.col("taken_at").cast("timestamp_ntz"), guess).alias("taken_at"), (F.col("taken_at").isNull() & ~video).alias("taken_at_inferred"))
