"""Queries of the scalar functions: boxes, vectors, names, dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import media as M
from ..functions import vectors as V
from . import fixtures as X
from .registry import query

_BOX = ("x1", "y1", "x2", "y2")


def _named(columns, names=_BOX, digits: int | None = 9):
    return [(F.round(c, digits) if digits is not None else c).alias(n) for c, n in zip(columns, names, strict=True)]


@query("dilate_boxes", X.sql("f_regions", """
SELECT row_id, frac, round(greatest(0, x1 - (x2 - x1) * frac), 9) AS x1, round(greatest(0, y1 - (y2 - y1) * frac), 9) AS y1,
       round(least(1, x2 + (x2 - x1) * frac), 9) AS x2, round(least(1, y2 + (y2 - y1) * frac), 9) AS y2
FROM f_regions, (SELECT CAST(unnest([0, 0.15, 0.4]) AS DOUBLE) AS frac)"""))
def dilate_boxes(spark, sf_dir):
    df = X.regions(spark, sf_dir).select("row_id", *_BOX, F.explode(F.array(*[F.lit(d) for d in G.DILATIONS])).alias("frac"))
    return df.select("row_id", "frac", *_named(G.dilate(*[F.col(c) for c in _BOX], F.col("frac"))))


@query("box_iou", X.sql("f_regions", """
v AS (SELECT a.photo_id, a.region_no AS region_a, b.region_no AS region_b,
        greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS shared,
        (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS areas
      FROM f_regions a JOIN f_regions b ON a.photo_id = b.photo_id AND a.region_no < b.region_no)
SELECT photo_id, region_a, region_b, round(CASE WHEN areas - shared > 0 THEN shared / (areas - shared) ELSE 0 END, 9) AS iou FROM v"""))
def box_iou(spark, sf_dir):
    r = X.regions(spark, sf_dir).drop("vec", "row_id")
    a = r.select("photo_id", F.col("region_no").alias("region_a"), *[F.col(c).alias(f"a_{c}") for c in _BOX])
    b = r.select("photo_id", F.col("region_no").alias("region_b"), *[F.col(c).alias(f"b_{c}") for c in _BOX])
    joined = a.join(b, "photo_id").where("region_a < region_b")
    return joined.select("photo_id", "region_a", "region_b", F.round(G.iou([F.col(f"a_{c}") for c in _BOX], [F.col(f"b_{c}") for c in _BOX]), 9).alias("iou"))


@query("pad_boxes", X.sql("f_regions", """
v AS (SELECT row_id, x1, y1, x2, y2, greatest(x2 - x1, y2 - y1) * CAST(0.05 AS DOUBLE) AS m FROM f_regions)
SELECT row_id, round(x1 - m, 9) AS x1, round(y1 - m, 9) AS y1, round(x2 + m, 9) AS x2, round(y2 + m, 9) AS y2 FROM v"""))
def pad_boxes(spark, sf_dir):
    return X.regions(spark, sf_dir).select("row_id", *_named(G.pad(*[F.col(c) for c in _BOX])))


_RAW_BOXES = """
raw AS (SELECT l_orderkey AS pair_id, l_linenumber AS pair_no, l_discount * 12 - 0.1 AS x1, l_tax * 12 - 0.05 AS y1,
               l_discount * 12 + l_quantity / 100 - 0.1 AS x2, l_tax * 12 + (l_quantity - 3) / 60 AS y2 FROM lineitem)"""


def _raw_boxes(spark, sf_dir):
    d, t, q = F.col("l_discount"), F.col("l_tax"), F.col("l_quantity")
    return X.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("pair_id"),
        F.col("l_linenumber").alias("pair_no"),
        (d * 12 - 0.1).alias("x1"),
        (t * 12 - 0.05).alias("y1"),
        (d * 12 + q / 100 - 0.1).alias("x2"),
        (t * 12 + (q - 3) / 60).alias("y2"),
    )


@query("crop_rect", "WITH" + _RAW_BOXES + """,
c AS (SELECT pair_id, pair_no, greatest(0, least(1, x1)) AS x1, greatest(0, least(1, y1)) AS y1, greatest(0, least(1, x2)) AS x2, greatest(0, least(1, y2)) AS y2 FROM raw),
p AS (SELECT pair_id, pair_no, CAST(trunc(x1 * 1600) AS INT) AS l, CAST(trunc(y1 * 1200) AS INT) AS t, CAST(trunc(x2 * 1600) AS INT) AS r, CAST(trunc(y2 * 1200) AS INT) AS b FROM c)
SELECT pair_id, pair_no, l, t, greatest(r, l + 1) AS embed_r, greatest(b, t + 1) AS embed_b, greatest(r, l + 2) AS feature_r, greatest(b, t + 2) AS feature_b FROM p""")
def crop_rect(spark, sf_dir):
    box = [F.col(c) for c in _BOX]
    one, two = (G.crop_rect(*box, F.lit(1600), F.lit(1200), n) for n in (1, 2))
    return _raw_boxes(spark, sf_dir).select(
        "pair_id", "pair_no", one[0].alias("l"), one[1].alias("t"), one[2].alias("embed_r"), one[3].alias("embed_b"), two[2].alias("feature_r"), two[3].alias("feature_b")
    )


@query("crop_scale_plan", """
WITH s AS (SELECT o_orderkey AS photo_id, CAST(200 + o_orderkey % 4000 AS INT) AS w, CAST(150 + o_custkey % 3000 AS INT) AS h FROM orders),
t AS (SELECT *, least(1, CAST(1024 AS DOUBLE) / greatest(w, h)) AS scale FROM s),
u AS (SELECT *, CASE WHEN scale < 1 THEN greatest(2, CAST(trunc(w * scale) AS INT)) ELSE w END AS cw, CASE WHEN scale < 1 THEN greatest(2, CAST(trunc(h * scale) AS INT)) ELSE h END AS ch FROM t)
SELECT photo_id, round(scale, 9) AS index_scale, cw AS crop_w, ch AS crop_h, round(greatest(1, CAST(256 AS DOUBLE) / greatest(1, least(cw, ch))), 9) AS upscale FROM u""")
def crop_scale_plan(spark, sf_dir):
    """Crops are rendered at the scale that pictures are indexed at, then enlarged if tiny."""
    s = X.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("photo_id"), (200 + F.col("o_orderkey") % 4000).cast("int").alias("w"), (150 + F.col("o_custkey") % 3000).cast("int").alias("h")
    )
    s = s.withColumn("scale", G.index_scale(F.col("w"), F.col("h")))
    shrunk = lambda c: F.when(F.col("scale") < 1, F.greatest(F.lit(2), (F.col(c) * F.col("scale")).cast("int"))).otherwise(F.col(c))
    s = s.select("photo_id", "scale", shrunk("w").alias("crop_w"), shrunk("h").alias("crop_h"))
    up = F.greatest(F.lit(1.0), F.lit(float(G.CROP_SIDE)) / F.greatest(F.lit(1), F.least("crop_w", "crop_h")))
    return s.select("photo_id", F.round("scale", 9).alias("index_scale"), "crop_w", "crop_h", F.round(up, 9).alias("upscale"))


@query("validate_boxes", "WITH" + _RAW_BOXES + """,
o AS (SELECT *, x1 >= 0 AND x1 <= 1 AND y1 >= 0 AND y1 <= 1 AND x2 >= 0 AND x2 <= 1 AND y2 >= 0 AND y2 <= 1 AS in_range, x1 < x2 AND y1 < y2 AS ordered,
  greatest(0, least(1, least(x1, x2))) AS cx1, greatest(0, least(1, least(y1, y2))) AS cy1, greatest(0, least(1, greatest(x1, x2))) AS cx2, greatest(0, least(1, greatest(y1, y2))) AS cy2 FROM raw)
SELECT pair_id, pair_no, in_range, ordered, round(cx1, 9) AS x1, round(cy1, 9) AS y1, round(cx2, 9) AS x2, round(cy2, 9) AS y2,
       (cx2 - cx1) * (cy2 - cy1) >= CAST(0.0012 AS DOUBLE) AS large_enough FROM o""")
def validate_boxes(spark, sf_dir):
    """Range and order of drawn boxes, their sorted and clamped corners, and whether they are large enough."""
    x1, y1, x2, y2 = (F.col(c) for c in _BOX)
    inside = F.lit(True)
    for c in (x1, y1, x2, y2):
        inside = inside & c.between(0, 1)
    fixed = [G.clamp(F.least(x1, x2)), G.clamp(F.least(y1, y2)), G.clamp(F.greatest(x1, x2)), G.clamp(F.greatest(y1, y2))]
    area = (fixed[2] - fixed[0]) * (fixed[3] - fixed[1])
    return _raw_boxes(spark, sf_dir).select(
        "pair_id", "pair_no", inside.alias("in_range"), ((x1 < x2) & (y1 < y2)).alias("ordered"), *_named(fixed), (area >= G.MIN_AREA).alias("large_enough")
    )


@query("project_box", """
WITH m AS (SELECT p_partkey AS photo_id, (0.2 + (p_partkey % 40) / CAST(20 AS DOUBLE)) * cos(p_size / CAST(8 AS DOUBLE)) AS a, (0.2 + (p_partkey % 40) / CAST(20 AS DOUBLE)) * sin(p_size / CAST(8 AS DOUBLE)) AS b,
   CAST(p_partkey * 37 % 1500 AS DOUBLE) AS tx, CAST(p_partkey * 53 % 1100 AS DOUBLE) AS ty FROM part),
c AS (SELECT photo_id, a, b, [tx, a * 300 + tx, a * 300 - b * 200 + tx, tx - b * 200] AS xs, [ty, b * 300 + ty, b * 300 + a * 200 + ty, a * 200 + ty] AS ys FROM m)
SELECT photo_id, round(sqrt(a * a + b * b), 6) AS scale, round(greatest(0, least(1, list_min(xs) / 1600)), 6) AS x1, round(greatest(0, least(1, list_min(ys) / 1200)), 6) AS y1,
  round(greatest(0, least(1, list_max(xs) / 1600)), 6) AS x2, round(greatest(0, least(1, list_max(ys) / 1200)), 6) AS y2 FROM c""")
def project_box(spark, sf_dir):
    """A 300 x 200 crop under planted similarities, in a frame of 1600 x 1200, and their scale."""
    p = F.col("p_partkey")
    size, turn = 0.2 + (p % 40) / 20.0, F.col("p_size") / 8.0
    df = X.table(spark, sf_dir, "part").select(
        p.alias("photo_id"), (size * F.cos(turn)).alias("a"), (size * F.sin(turn)).alias("b"), (p * 37 % 1500).cast("double").alias("tx"), (p * 53 % 1100).cast("double").alias("ty")
    )
    m = [F.col("a"), -F.col("b"), F.col("tx"), F.col("b"), F.col("a"), F.col("ty")]
    return df.select("photo_id", F.round(F.hypot("a", "b"), 6).alias("scale"), *_named(G.project(m, F.lit(300.0), F.lit(200.0), F.lit(1600.0), F.lit(1200.0)), digits=6))


@query("cosine_scores", """
SELECT a.vec_id AS vec_a, b.vec_id AS vec_b, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) /
       (sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 7""")
def cosine_scores(spark, sf_dir):
    e = X.table(spark, sf_dir, "embeddings")
    a = e.select(F.col("vec_id").alias("vec_a"), F.col("embedding").alias("u"), (F.col("vec_id") + 7).alias("vec_b"))
    b = e.select(F.col("vec_id").alias("vec_b"), F.col("embedding").alias("v"))
    return a.join(b, "vec_b").select("vec_a", "vec_b", F.round(V.cosine(F.col("u"), F.col("v")), 6).alias("cosine"))


@query("l2_normalize", """
WITH v AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * (1 + vec_id % 5)) AS e FROM embeddings),
n AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS norm FROM v)
SELECT vec_id, round(norm, 6) AS norm, round(e[1] / norm, 6) AS first, round(e[64] / norm, 6) AS last FROM n""")
def l2_normalize(spark, sf_dir):
    scaled = F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("vec_id") % 5))
    df = X.table(spark, sf_dir, "embeddings").select("vec_id", scaled.alias("e"))
    unit = V.normalize(F.col("e"))
    return df.select("vec_id", F.round(V.norm(F.col("e")), 6).alias("norm"), F.round(unit[0], 6).alias("first"), F.round(unit[63], 6).alias("last"))


@query("photo_ids", X.sql("f_files_new", "SELECT path, substr(sha1(path), 1, 16) AS photo_id FROM f_files_new"))
def photo_ids(spark, sf_dir):
    return X.files_new(spark, sf_dir).select("path", M.photo_id(F.col("path")).alias("photo_id"))


@query("region_pyramid", """
WITH s AS (SELECT 1 AS level, 16 AS size, CAST(unnest([0, 8, 16]) AS INT) AS at UNION ALL SELECT 2, 8, CAST(unnest([0, 6, 12, 18, 24]) AS INT)),
w AS (SELECT 0 AS level, 0 AS r0, 0 AS c0, 32 AS size UNION ALL SELECT a.level, a.at, b.at, a.size FROM s a JOIN s b ON a.level = b.level)
SELECT CAST(row_number() OVER (ORDER BY level, r0, c0) - 1 AS INT) AS region_no, r0, c0, r0 + size AS r1, c0 + size AS c1, CAST(c0 AS DOUBLE) / 32 AS x1, CAST(r0 AS DOUBLE) / 32 AS y1,
  CAST(c0 + size AS DOUBLE) / 32 AS x2, CAST(r0 + size AS DOUBLE) / 32 AS y2 FROM w""")
def region_pyramid(spark, sf_dir):
    from ..operators.pooling import pyramid

    return pyramid(spark)


@query("exif_capture_time", """
WITH t AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'not a date' WHEN event_id % 5 = 0 THEN NULL ELSE concat(' ', strftime(ts, '%Y:%m:%d %H:%M:%S'), '.25 ') END AS original,
  CASE WHEN event_id % 7 = 0 THEN '0000:00:00 00:00:00' WHEN event_id % 2 = 0 THEN strftime(ts + INTERVAL 1 DAY, '%Y:%m:%d %H:%M:%S') END AS digitized, strftime(ts + INTERVAL 2 DAY, '%Y:%m:%d %H:%M:%S') AS changed FROM events)
SELECT event_id, coalesce(try_strptime(substr(trim(original), 1, 19), '%Y:%m:%d %H:%M:%S'), try_strptime(substr(trim(digitized), 1, 19), '%Y:%m:%d %H:%M:%S'), try_strptime(substr(trim(changed), 1, 19), '%Y:%m:%d %H:%M:%S')) AS taken_at FROM t""")
def exif_capture_time(spark, sf_dir):
    e, ts = F.col("event_id"), F.col("ts")
    text = lambda c: F.date_format(c, "yyyy:MM:dd HH:mm:ss")
    original = F.when(e % 3 == 0, "not a date").when(e % 5 == 0, F.lit(None)).otherwise(F.concat(F.lit(" "), text(ts), F.lit(".25 ")))
    digitized = F.when(e % 7 == 0, "0000:00:00 00:00:00").when(e % 2 == 0, text(ts + F.expr("INTERVAL 1 DAY")))
    return X.table(spark, sf_dir, "events").select("event_id", M.exif_time(original, digitized, text(ts + F.expr("INTERVAL 2 DAY"))).alias("taken_at"))


_DMS = """
d AS (SELECT event_id, CAST(event_id % 95 AS DOUBLE) + CAST(user_id % 60 AS DOUBLE) / 60 + CAST(event_id % 59 AS DOUBLE) / 3600 AS lat0,
  CAST(event_id % 190 AS DOUBLE) + CAST(user_id % 59 AS DOUBLE) / 60 + CAST(event_id % 61 AS DOUBLE) / 3600 AS lon0, event_id % 2 = 0 AS south, event_id % 3 = 0 AS west FROM events),
g AS (SELECT event_id, CASE WHEN south THEN -lat0 ELSE lat0 END AS lat, CASE WHEN west THEN -lon0 ELSE lon0 END AS lon FROM d),
p AS (SELECT event_id, CASE WHEN abs(lat) <= 90 AND abs(lon) <= 180 AND NOT (lat = 0 AND lon = 0) THEN lat END AS lat, CASE WHEN abs(lat) <= 90 AND abs(lon) <= 180 AND NOT (lat = 0 AND lon = 0) THEN lon END AS lon FROM g)"""


def _places(spark, sf_dir):
    e, u = F.col("event_id"), F.col("user_id")
    d = lambda c: c.cast("double")
    lat = M.degrees(d(e % 95), d(u % 60), d(e % 59), F.when(e % 2 == 0, "S").otherwise("N"))
    lon = M.degrees(d(e % 190), d(u % 59), d(e % 61), F.when(e % 3 == 0, "W").otherwise("E"))
    return X.table(spark, sf_dir, "events").select("event_id", M.gps(lat, lon).alias("gps")).select("event_id", "gps.lat", "gps.lon")


@query("gps_from_dms", "WITH" + _DMS + " SELECT event_id, round(lat, 8) AS lat, round(lon, 8) AS lon FROM p")
def gps_from_dms(spark, sf_dir):
    return _places(spark, sf_dir).select("event_id", F.round("lat", 8).alias("lat"), F.round("lon", 8).alias("lon"))


@query("coord_text", "WITH" + _DMS + """
SELECT event_id, concat(printf('%.4f', abs(lat)), '° ', CASE WHEN lat >= 0 THEN 'N' ELSE 'S' END) AS lat_text, concat(printf('%.4f', abs(lon)), '° ', CASE WHEN lon >= 0 THEN 'E' ELSE 'W' END) AS lon_text FROM p WHERE lat IS NOT NULL""")
def coord_text(spark, sf_dir):
    return _places(spark, sf_dir).where("lat is not null").select("event_id", M.coord_text(F.col("lat"), "N", "S").alias("lat_text"), M.coord_text(F.col("lon"), "E", "W").alias("lon_text"))


@query("span_text", """
WITH d AS (SELECT DISTINCT CAST(l_quantity * l_linenumber * 3 AS DOUBLE) + CAST(l_linenumber AS DOUBLE) / 4 AS days FROM lineitem),
p AS (SELECT days, CAST(floor(days / CAST(365.25 AS DOUBLE)) AS BIGINT) AS y FROM d), q AS (SELECT *, CAST(floor((days - y * CAST(365.25 AS DOUBLE)) / CAST(30.44 AS DOUBLE)) AS BIGINT) AS m FROM p)
SELECT days, CASE WHEN y <> 0 AND m <> 0 THEN concat(y, ' yr ', m, ' mo') WHEN y <> 0 THEN concat(y, ' yr') WHEN m <> 0 THEN concat(m, ' mo') ELSE concat(CAST(floor(days + 0.5) AS BIGINT), ' days') END AS span FROM q""")
def span_text(spark, sf_dir):
    days = F.col("l_quantity") * F.col("l_linenumber") * 3 + F.col("l_linenumber") / 4
    return X.table(spark, sf_dir, "lineitem").select(days.cast("double").alias("days")).distinct().select("days", M.span_text(F.col("days")).alias("span"))


#: "Now" of the relative ages, fixed so that results do not move.
NOW = "2025-01-01 00:00:00"


@query("relative_age", f"""
WITH d AS (SELECT event_id, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / CAST(86400000000 AS DOUBLE) AS d FROM events)
SELECT event_id, CASE WHEN abs(d) < 1 THEN 'hour' WHEN abs(d) < 45 THEN 'day' WHEN abs(d) < 365 THEN 'month' ELSE 'year' END AS unit,
  -CAST(floor(CASE WHEN abs(d) < 1 THEN d * 24 WHEN abs(d) < 45 THEN d WHEN abs(d) < 365 THEN d / CAST(30.44 AS DOUBLE) ELSE d / CAST(365.25 AS DOUBLE) END + 0.5) AS BIGINT) AS n FROM d""")
def relative_age(spark, sf_dir):
    days = M.days_between(F.to_timestamp_ntz(F.lit(NOW)), F.col("ts"))
    n, unit = M.relative_age(days)
    return X.table(spark, sf_dir, "events").select("event_id", unit.alias("unit"), n.alias("n"))


@query("frame_clock", """
WITH f AS (SELECT DISTINCT CAST(l_quantity * 7 AS DOUBLE) / 2 AS s FROM lineitem)
SELECT s AS seconds, concat(CAST(floor(s / 60) AS BIGINT), ':', lpad(CAST(CAST(floor(s % 60) AS BIGINT) AS VARCHAR), 2, '0')) AS clock FROM f""")
def frame_clock(spark, sf_dir):
    s = X.table(spark, sf_dir, "lineitem").select((F.col("l_quantity") * 7 / 2).cast("double").alias("seconds")).distinct()
    return s.select("seconds", M.frame_clock(F.col("seconds")).alias("clock"))


_NAMES = "concat('/s/', CASE WHEN p_size % 4 = 0 THEN 'unrelated_' WHEN p_size % 4 = 1 THEN 'A_' WHEN p_size % 4 = 2 THEN 'B_' ELSE 'T_' END, CAST(p_partkey AS VARCHAR), '.jpg')"


@query("instance_from_name", f"""
WITH n AS (SELECT p_partkey, {_NAMES} AS path FROM part), b AS (SELECT p_partkey, path, split_part(path, '/', 3) AS name FROM n),
i AS (SELECT p_partkey, CASE WHEN NOT starts_with(name, 'unrelated') THEN substr(name, 1, 1) END AS instance FROM b)
SELECT p_partkey AS photo_id, instance, CASE WHEN instance = 'A' THEN 'same' WHEN instance = 'T' THEN 'twin' WHEN instance IS NOT NULL THEN 'same_class' ELSE 'unrelated' END AS label FROM i""")
def instance_from_name(spark, sf_dir):
    kind = F.col("p_size") % 4
    path = F.concat(F.lit("/s/"), F.when(kind == 0, "unrelated_").when(kind == 1, "A_").when(kind == 2, "B_").otherwise("T_"), F.col("p_partkey").cast("string"), F.lit(".jpg"))
    df = X.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("photo_id"), M.instance_of(path).alias("instance"))
    return df.select("photo_id", "instance", M.label_of(F.col("instance")).alias("label"))


@query("clock_text", "SELECT event_id, coalesce(CASE WHEN hour(t) <> 0 OR minute(t) <> 0 THEN strftime(t, '%H:%M') END, '') AS clock FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN date_trunc('day', ts) ELSE ts END AS t FROM events)")
def clock_text(spark, sf_dir):
    at = F.when(F.col("event_id") % 5 == 0, F.date_trunc("day", "ts").cast("timestamp_ntz")).otherwise(F.col("ts").cast("timestamp_ntz"))
    return X.table(spark, sf_dir, "events").select("event_id", F.coalesce(M.clock_text(at), F.lit("")).alias("clock"))


@query("area_pixels", X.sql("f_regions", "SELECT row_id, CAST(floor((x2 - x1) * 1599 + 0.5) AS BIGINT) AS w, CAST(floor((y2 - y1) * 1201 + 0.5) AS BIGINT) AS h FROM f_regions"))
def area_pixels(spark, sf_dir):
    w, h = G.area_pixels(*[F.col(c) for c in _BOX], F.lit(1599), F.lit(1201))
    return X.regions(spark, sf_dir).select("row_id", w.alias("w"), h.alias("h"))


@query("box_keys", X.sql("f_regions", "SELECT row_id, concat(photo_id, '|', printf('%.4f', x1), ',', printf('%.4f', y1), ',', printf('%.4f', x2), ',', printf('%.4f', y2)) AS box_key FROM f_regions"))
def box_keys(spark, sf_dir):
    return X.regions(spark, sf_dir).select("row_id", M.box_key(F.col("photo_id"), *[F.col(c) for c in _BOX]).alias("box_key"))


@query("tile_cover", "WITH" + _RAW_BOXES + """,
c AS (SELECT pair_id, pair_no, x1, y1, x2, y2, greatest(132::DOUBLE / greatest((x2 - x1) * 1600, (y2 - y1) * 1200, 1), 132::DOUBLE / 1600, 132::DOUBLE / 1200) AS s FROM raw),
d AS (SELECT *, 1600 * s AS w, 1200 * s AS h FROM c)
SELECT pair_id, pair_no, round(w, 6) AS w, round(h, 6) AS h, round(least(0, greatest(132 - w, 66 - (x1 + x2) / 2 * w)), 6) + 0.0::DOUBLE AS x, round(least(0, greatest(132 - h, 66 - (y1 + y2) / 2 * h)), 6) + 0.0::DOUBLE AS y FROM d""")
def tile_cover(spark, sf_dir):
    """How a picture is scaled and shifted to show a box in a tile of 132 pixels."""
    made = G.cover(*[F.col(c) for c in _BOX], F.lit(1600.0), F.lit(1200.0), 132)
    return _raw_boxes(spark, sf_dir).select("pair_id", "pair_no", *[(F.round(c, 6) + 0.0).alias(n) for c, n in zip(made, "whxy", strict=True)])  # no negative zero


@query("scene_seed")
def scene_seed(spark, sf_dir):
    """A seed for each scene from its name; DuckDB has no crc32, so only the rows are checked."""
    return X.files_new(spark, sf_dir).select("path", F.crc32("path").bitwiseXOR(F.lit(7).cast("long")).alias("seed"))
