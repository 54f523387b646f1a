"""A planted library asked end to end: recall, verification, timeline, feedback."""

from __future__ import annotations

import numpy as np
import pytest

from glimpsar.engine import Library, ratio_matches
from glimpsar.sources.store import SCHEMAS, IndexStore

BOX = (0.25, 0.25, 0.75, 0.75)


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    """Photos a0 to a3 hold one object (a3 twice, a2 undated), b0 to b3 another of its kind."""
    rng = np.random.default_rng(0)
    store = IndexStore(spark, str(tmp_path_factory.mktemp("index") / "t"), "planted")
    store.create()
    kinds = {k: (rng.uniform(0, 200, (40, 2)), rng.standard_normal((40, 16))) for k in "ab"}
    centre = rng.standard_normal(8)
    photos, regions, points = [], [], []
    for k, (xy, desc) in kinds.items():
        for i in range(4):
            pid = f"{k}{i}"
            taken = None if pid == "a2" else f"2024-0{i + 1}-01 00:00:00"
            photos.append((pid, f"/lib/{pid}.jpg", None, None, taken, False, None, 1000, 800, 1, 1))
            for r in range(2):
                v = centre + 0.1 * rng.standard_normal(8)
                regions.append((pid, r, *(BOX if r else (0.0, 0.0, 1.0, 1.0)), [float(x) for x in v / np.linalg.norm(v)]))
            spots = [(300, 250)] if pid != "a3" else [(50, 50), (600, 450)]
            n = 0
            for sx, sy in spots:
                half = slice(None) if len(spots) == 1 else (slice(0, 20) if sx == 50 else slice(20, 40))
                for p, d in zip(xy[half] + (sx, sy), desc[half], strict=True):
                    points.append((pid, 1, 1, n, float(p[0]), float(p[1]), [float(x) for x in d]))
                    n += 1
            for _ in range(10):
                points.append((pid, 1, 1, n, float(rng.uniform(0, 1000)), float(rng.uniform(0, 800)), [float(x) for x in 3 * rng.standard_normal(16)]))
                n += 1
    from pyspark.sql import functions as F

    df = spark.createDataFrame(photos, SCHEMAS["photos"].replace("timestamp_ntz", "string")).withColumn("taken_at", F.col("taken_at").cast("timestamp_ntz"))
    store.append("photos", df)
    store.append("regions", spark.createDataFrame(regions, SCHEMAS["regions"]))
    store.append("keypoints", spark.createDataFrame(points, SCHEMAS["keypoints"].replace("`desc`", "desc")))
    return Library(store)


def test_finds_the_object_and_not_its_like(library):
    answer = library.query("a0", BOX)
    got = answer.matches.collect()
    assert [r.photo_id for r in got] == ["a1", "a3", "a2"]  # in order of time, the undated one last
    assert answer.last_seen.first().photo_id == "a3"
    assert answer.candidates.count() == 7
    traps = [r for r in answer.candidates.collect() if r.photo_id.startswith("b")]
    assert all(r.inliers < 6 for r in traps)
    assert "a3.jpg" in answer.warning()
    assert {r.photo_id: r.inliers for r in got}["a1"] == 40


def test_feedback_sticks(library):
    first = library.query("a0", BOX)
    obj = first.query_id
    assert library.exemplar_count(obj) == 1  # seeded with what was drawn
    assert library.feedback(obj, "a1", True, BOX) == 2
    assert library.feedback(obj, "a2", True) == 3  # without a box the object is looked for
    assert library.feedback(obj, "a3", False) == 3
    again = {r.photo_id: r for r in library.query("a0", BOX, object_id=obj).matches.collect()}
    assert set(again) == {"a1", "a2"}
    assert library.feedback(obj, "a1", False) == 2
    with pytest.raises(ValueError):
        library.feedback("nobody", "a1", True)
    with pytest.raises(ValueError):
        library.feedback(obj, "b1", True)


def test_listing_and_errors(library):
    assert [r.photo_id for r in library.photos(1, 2).collect()] == ["a1", "a2"]
    status = library.status().first()
    assert (status.photos, status.dated, status.folder) == (8, 7, "/lib")
    with pytest.raises(LookupError):
        library.query("zz", BOX)
    with pytest.raises(ValueError):
        library.query("a0", (0, 0, 2, 1))
    with pytest.raises(ValueError):
        library.index("/lib")


def test_top_k_counts_the_source(library):
    assert library.query("a0", BOX, top_k=1).candidates.count() <= 1


def test_every_confirmed_view_is_used(spark, tmp_path, monkeypatch):
    """The newest of 260 confirmed views is the only one that finds p259 and x; y looks a little like all the others."""
    from glimpsar.operators import recall

    rng = np.random.default_rng(2)
    xy, desc = rng.uniform(0, 200, (40, 2)), rng.standard_normal((40, 16))
    store = IndexStore(spark, str(tmp_path / "t"), "planted")
    store.create()
    names = [*(f"p{i:03d}" for i in range(260)), "x", "y"]
    photos = spark.createDataFrame([(p, f"/lib/{p}.jpg", None, None, None, False, None, 1000, 800, 1, 1) for p in names], SCHEMAS["photos"])
    store.append("photos", photos)
    vecs = {"p000": [1.0, 0.0], "y": [0.8, 0.6], "x": [0.0, 1.0], "p259": [0.0, 1.0]}
    store.append("regions", spark.createDataFrame([(p, 0, *BOX, v) for p, v in vecs.items()], SCHEMAS["regions"]))
    points = [("x", 1, 1, n, float(p[0] + 300), float(p[1] + 250), [float(v) for v in d]) for n, (p, d) in enumerate(zip(xy, desc, strict=True))]
    store.append("keypoints", spark.createDataFrame(points, SCHEMAS["keypoints"].replace("`desc`", "desc")))
    store.append("feedback", spark.createDataFrame([(i + 1, "o", f"p{i:03d}", True, BOX) for i in range(260)], store.table("feedback").schema))

    class Features:
        def vectors(self, photo_id, boxes):
            return [vecs["x"] if photo_id == "p259" else [1.0, 0.0]] * len(boxes)

        def keypoints(self, photo_id, box, width, height):
            some = slice(None) if photo_id == "p259" else slice(0, 0)
            return xy[some], desc[some], (200.0, 200.0)

    monkeypatch.setattr(recall, "MAX_QUERIES", 500)  # 780 query vectors in two blocks
    library = Library(store, Features())
    assert len(library._exemplars("o")) == library.exemplar_count("o") == 260
    got = {r.photo_id: r for r in library.query("p000", BOX, top_k=3, object_id="o").matches.collect()}
    assert {p: r.inliers for p, r in got.items()} == {"x": 40, "p259": 30}
    assert (got["p259"].x1, got["p259"].y2) == (0.25, 0.75)


def test_ratio_matches_are_brute_force():
    rng = np.random.default_rng(1)
    q, c = rng.standard_normal((600, 6)), rng.standard_normal((50, 6))
    d = np.sqrt(((q[:, None] - c[None]) ** 2).sum(2))
    order = np.sort(d, axis=1)
    want = [(i, int(d[i].argmin())) for i in range(600) if order[i, 0] < 0.85 * order[i, 1]]
    assert [tuple(x) for x in ratio_matches(q, c).tolist()] == want
    assert len(ratio_matches(q[:1], c)) == len(ratio_matches(q, c[:1])) == 0
