"""The gate's boundaries, planted transforms, feedback folds, dates, boxes and empty inputs."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glimpsar.functions import gate, geometry, media
from glimpsar.operators import evaluation, feedback, library, matching, recall, timeline


@pytest.mark.parametrize(("inliers", "matches", "accepted"), [(30, 10000, True), (6, 13, True), (6, 14, False), (5, 5, False), (29, 1000, False)])
def test_gate_boundaries(spark, inliers, matches, accepted):
    df = spark.createDataFrame([(inliers, matches)], "i int, m int")
    assert df.select(gate.accept(F.col("i"), F.col("m"))).first()[0] is accepted


def _similar(points, angle=0.4, size=1.7, shift=(210.0, 90.0)):
    c, s = size * np.cos(angle), size * np.sin(angle)
    return points @ np.array([[c, -s], [s, c]]).T + np.array(shift)


@pytest.mark.parametrize("count", [6, 10, 14, 18, 22, 26])
def test_planted_inliers(count):
    rng = np.random.default_rng(count)
    src = rng.uniform(0, 200, (40, 2))
    dst = rng.uniform(0, 1500, (40, 2))
    dst[:count] = _similar(src[:count]) + rng.uniform(-0.25, 0.25, (count, 2))
    found = matching.detect(src, dst, (200, 200), (1600, 1200))[0]
    assert found["inliers"] == count
    assert found["scale"] == pytest.approx(1.7, abs=0.05)
    assert found["matches"] == 40


def test_two_copies_in_one_photo_share_the_denominator():
    rng = np.random.default_rng(1)
    src = rng.uniform(0, 100, (30, 2))
    dst = np.concatenate([_similar(src[:16], 0.0, 1.0, (0, 0)), _similar(src[16:], 0.0, 1.0, (800, 600))])
    found = matching.detect(src, dst, (100, 100), (1600, 1200))
    assert [f["inliers"] for f in found] == [16, 14]
    assert {f["matches"] for f in found} == {30}


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_too_few_matches_give_one_empty_detection(n):
    assert matching.detect(np.zeros((n, 2)), np.zeros((n, 2)), (10, 10), (10, 10)) == [{"inliers": 0, "matches": n, "box": None, "scale": 0.0}]


def test_slivers_are_dropped_but_their_inliers_go():
    src = np.array([[x, y] for x in range(0, 100, 20) for y in range(0, 100, 20)], dtype=float)
    tiny = src * 0.01 + 50
    assert matching.detect(src, tiny, (100, 100), (1600, 1200))[0]["inliers"] == 0


def test_affine_fits_what_a_similarity_cannot():
    src = np.random.default_rng(2).uniform(0, 100, (12, 2))
    dst = src @ np.array([[2.0, 0.5], [0.0, 0.7]]).T + 30
    assert matching.detect(src, dst, (100, 100), (400, 400), affine=True)[0]["inliers"] == 12


def test_feedback_closed_form_is_the_fold(spark):
    rnd = random.Random(4)
    log, seq = [], 0
    for obj in range(60):
        for _ in range(rnd.randint(1, 25)):
            seq += 1
            log.append((seq, obj, rnd.randint(0, 4), rnd.random() < 0.6))
    df = spark.createDataFrame(log, "seq long, object_id long, photo_id long, confirmed boolean")
    closed = {tuple(r) for r in feedback.feedback_state(df).collect()}
    kinds = df.select("object_id", "photo_id", "seq", F.when(F.col("confirmed"), "confirm").otherwise("reject").alias("kind"))
    assert closed == {tuple(r) for r in feedback.fold_ordered(kinds).collect()}


def test_confirm_reject_confirm_keeps_the_second_box_and_confirm_twice_the_first(spark):
    df = spark.createDataFrame([(1, 1, 7, True), (2, 1, 7, False), (3, 1, 7, True), (4, 1, 7, True), (5, 2, 7, True), (6, 2, 7, True)], "seq long, object_id long, photo_id long, confirmed boolean")
    assert {(r.object_id, r.box_seq) for r in feedback.feedback_state(df).collect()} == {(1, 3), (2, 5)}


def test_seed_fills_only_an_empty_object():
    assert feedback.replay([("reject", 1, 1), ("seed", 1, 2), ("seed", 2, 3)]) == {1: 2}
    assert feedback.replay([("confirm", 1, 1), ("reject", 1, 2), ("seed", 2, 3), ("confirm", 2, 4), ("seed", 1, 5)]) == {1: None, 2: 3}


def brute_state(events):
    """The state of the definitions: exemplars and rejected photos as two sets that each event moves photos between."""
    views, rejected = {}, set()
    for kind, photo, seq in events:
        if kind == "reject":
            views.pop(photo, None)
            rejected.add(photo)
        elif kind == "confirm" or not views:
            rejected.discard(photo)
            views.setdefault(photo, seq)
    return views, rejected


def test_replay_in_pieces_is_replay():
    rnd = random.Random(3)
    for _ in range(300):
        events = [(rnd.choice(["seed", "confirm", "reject"]), rnd.randrange(4), i) for i in range(rnd.randrange(14))]
        cut = rnd.randrange(len(events) + 1)
        boxes = feedback.replay(events[cut:], feedback.replay(events[:cut]))
        assert ({p: s for p, s in boxes.items() if s is not None}, {p for p, s in boxes.items() if s is None}) == brute_state(events)


def test_last_seen_ties_and_undated(spark):
    df = spark.createDataFrame([(1, 5, "2024-01-02"), (1, 3, "2024-01-02"), (1, 9, None), (2, 1, None), (2, 4, None)], "object_id long, photo_id long, t string")
    df = df.select("object_id", "photo_id", F.col("t").cast("timestamp_ntz").alias("taken_at"))
    assert {(r.object_id, r.photo_id) for r in timeline.last_seen(df).collect()} == {(1, 3), (2, 4)}
    assert timeline.last_seen(df.where("false")).count() == 0


def test_boxes(spark):
    one = spark.range(1)
    lit = lambda *v: [F.lit(float(x)) for x in v]
    assert one.select(geometry.iou(lit(0, 0, 0, 0), lit(0, 0, 0, 0))).first()[0] == 0.0
    assert one.select(geometry.iou(lit(0, 0, 1, 1), lit(0.5, 0, 1, 1))).first()[0] == 0.5
    assert list(one.select(*geometry.crop_rect(*lit(0.5, 0.5, 0.5, 0.5), F.lit(100), F.lit(80), 2)).first()) == [50, 40, 52, 42]
    assert list(one.select(*geometry.dilate(*lit(0.1, 0.1, 0.5, 0.9), F.lit(0.5))).first()) == pytest.approx([0.0, 0.0, 0.7, 1.0])


def test_dates_and_places(spark):
    one = spark.range(1)
    taken = media.exif_time(F.lit("nonsense"), F.lit(None).cast("string"), F.lit("  2024:05:06 07:08:09.5"))
    assert str(one.select(taken).first()[0]) == "2024-05-06 07:08:09"
    assert one.select(media.gps(F.lit(0.0), F.lit(0.0))).first()[0] is None
    assert one.select(media.gps(F.lit(91.0), F.lit(0.0))).first()[0] is None
    assert one.select(media.media_kind(F.lit("/a/.b.JPG"))).first()[0] is None
    assert one.select(media.media_kind(F.lit("/a.b/c.MP4"))).first()[0] == "video"
    assert [one.select(media.span_text(F.lit(float(d)))).first()[0] for d in (3, 40, 366, 800)] == ["3 days", "1 mo", "1 yr", "2 yr 2 mo"]


def test_library_differences(spark):
    old = spark.createDataFrame([("/a/1.jpg", 1, 1), ("/a/2.jpg", 1, 1), ("/ab/3.jpg", 1, 1), ("/a/4.jpg", 1, None)], "path string, size long, mtime_ns long")
    new = spark.createDataFrame([("/a/1.jpg", 1, 1), ("/a/2.jpg", 2, 1), ("/a/5.jpg", 1, 1), ("/a/4.jpg", 1, None)], "path string, size long, mtime_ns long")
    assert {r.path: r.action for r in library.diff(old, new).collect()} == {"/a/1.jpg": "unchanged", "/a/2.jpg": "changed", "/ab/3.jpg": "gone", "/a/4.jpg": "unchanged", "/a/5.jpg": "new"}
    assert {r.path for r in library.pending(old, new).collect()} == {"/a/2.jpg", "/a/5.jpg"}
    assert library.stale(old, new, "/a").count() == 0
    assert library.pending(new, new).count() == 0  # a second run has nothing to do
    photos = old.select("path", F.lit(None).cast("string").alias("source_video_path"))
    assert library.indexed_folder(photos).first().folder == "2 folders"
    assert library.indexed_folder(photos.where("false")).first().folder is None


def test_recall_with_nothing(spark):
    regions = spark.createDataFrame([], "row_id long, photo_id long, vec array<float>")
    queries = spark.createDataFrame([(0, [1.0, 0.0])], "query_no int, vec array<float>")
    assert recall.recall(regions, queries, 5).count() == 0
    full = spark.createDataFrame([(0, 0, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (2, 2, [0.0, 1.0])], "row_id long, photo_id long, vec array<float>")
    assert recall.recall(full, queries, 0).count() == 0
    # The source takes up one of the two places; equal scores go to the smaller photo.
    assert [r.photo_id for r in recall.recall(full, queries, 2, source=0).collect()] == [1]


def test_upper_median_and_full_grid(spark):
    pairs = spark.createDataFrame([("same", i, 100) for i in (1, 2, 3, 4)], "label string, inliers int, raw_matches int")
    assert evaluation.inlier_distribution(pairs).first().median == 3
    assert pairs.groupBy("label").agg(evaluation.upper_median(F.collect_list("inliers")).alias("m")).first().m == 3
    sweep = evaluation.gate_sweep(pairs)
    assert sweep.count() == 66
    assert evaluation.best_gate(sweep).count() == 1


def test_no_pair_of_matches_is_passed_over():
    """Five matches of 300 agree, and none of their pairs is among every fourth one."""
    rng = np.random.default_rng(24)
    src, dst = rng.uniform(0, 10000, (300, 2)), rng.uniform(0, 10000, (300, 2))
    true = np.sort(rng.choice(300, 5, replace=False))
    dst[true] = _similar(src[true])
    _, inside = matching.fit_similarity(src, dst)
    assert np.flatnonzero(inside).tolist() == true.tolist()


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """Regions of no structure, the hardest case for an approximate search, and five query vectors."""
    rng = np.random.default_rng(4)
    v = rng.standard_normal((3000, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    path = str(tmp_path_factory.mktemp("regions") / "r")
    spark.createDataFrame([(i, i // 5, [float(x) for x in r]) for i, r in enumerate(v)], "row_id long, photo_id long, vec array<float>").repartition(3).write.parquet(path)
    asked = spark.createDataFrame([(i, [float(x) for x in v[700 * i]]) for i in range(4)] + [(4, [float(x) for x in rng.standard_normal(64)])], "query_no int, vec array<float>")
    return spark.read.parquet(path), asked


def _found(df):
    return {(r.query_no, r["rank"]): (r.row_id, r.score) for r in df.collect()}


def test_exact_search_whatever_the_batches(spark, table, monkeypatch):
    """One pass or several over the regions, large or tiny Arrow batches: the same answer, that of brute force."""
    regions, asked = table
    rows = {r.row_id: np.array(r.vec) for r in regions.collect()}
    want = {}
    for q in asked.collect():
        score = {i: round(float(np.array(q.vec) @ v), 6) for i, v in rows.items()}
        for n, i in enumerate(sorted(score, key=lambda i: (-score[i], i))[:50]):
            want[q.query_no, n + 1] = i
    assert {k: i for k, (i, _) in _found(recall.knn_exact(regions, asked, 50)).items()} == want
    monkeypatch.setattr(recall, "MAX_QUERIES", 2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        small = recall.knn_exact(regions, asked, 50)
        assert {k: i for k, (i, _) in _found(small).items()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    best = {r.row_id: r.score for r in recall.best_scores(regions, asked).collect()}
    assert len(best) == 3000
    assert best[0] == 1.0


def test_approximate_searches_find_nine_in_ten(spark, table):
    regions, asked = table
    exact = _found(recall.knn_exact(regions, asked, 20))
    centres = recall.ivf_cells(regions)
    for found in (recall.knn_lsh(regions, asked, 20), recall.knn_ivf(recall.with_cell(regions, centres), centres, asked, 20)):
        got = set(_found(found).values())
        assert len(got & set(exact.values())) / len(exact) >= 0.9
    none = asked.where("false")
    assert recall.knn_lsh(regions, none, 20).count() == recall.knn_ivf(recall.with_cell(regions, centres), centres, none, 20).count() == recall.knn_exact(regions, none, 5).count() == 0


def test_recall_passes_over_regions_without_owner(spark, table):
    regions, asked = table
    photos = spark.createDataFrame([(i,) for i in range(0, 600, 2)], "photo_id long")
    hits = recall.recall(regions, asked, 1000, source=0, photos=photos).collect()
    assert len(hits) == 299
    assert all(r.photo_id % 2 == 0 for r in hits)


def test_affine_fit():
    """All triples of few points and drawn ones of many find the transform; nothing is cut off at any number."""
    rng = np.random.default_rng(5)
    m = np.array([[1.2, 0.3, 40.0], [-0.2, 0.8, 10.0]])
    for n, right in ((10, 6), (60, 40), (400, 160), (2000, 700)):
        src = rng.uniform(0, 500, (n, 2))
        dst = src @ m[:, :2].T + m[:, 2]
        dst[right:] = rng.uniform(0, 900, (n - right, 2))
        matrix, inside = matching.fit_affine(src, dst)
        assert inside[:right].all()
        assert np.allclose(matrix, m, atol=1e-6) or inside.sum() >= right
    line = np.column_stack([np.arange(5.0), np.arange(5.0)])
    assert matching.fit_affine(line, line) is None
    assert matching.fit_affine(line[:2], line[:2]) is None


def test_scene_seeds(spark, small):
    import zlib

    from glimpsar.plans import catalog

    rows = catalog.queries()["scene_seed"](spark, small).collect()
    assert rows
    assert all(r.seed == zlib.crc32(r.path.encode()) ^ 7 for r in rows)
