"""Folders of real files: indexed, asked, changed and asked again."""

from __future__ import annotations

import datetime
import os

import numpy as np
import pytest

from glimpsar.engine import Library
from glimpsar.operators import matching
from glimpsar.sources import pictures
from glimpsar.sources.indexer import index_folder
from glimpsar.sources.providers import PlainPictures, TableEmbeddings, chunks, with_content
from glimpsar.sources import store as store_module
from glimpsar.sources.store import SCHEMAS, IndexStore

from . import media

MUG, TRAP = media.object_(1), media.object_(2)


def at(name):
    return name.rsplit("/", 1)[-1]


@pytest.fixture
def folder(tmp_path):
    """The mug in four pictures (in one of them in two pieces) and in the middle of a video, something of its kind in two, nothing in two."""
    root = tmp_path / "lib"
    (root / "sub [2024]").mkdir(parents=True)
    files = {
        "m1.png": media.png(media.scene(1, [(MUG, 20, 30)]), media.exif("2024:03:01 10:00:00", (48.2, -16.5))),
        "m2.bmp": media.bmp(media.scene(2, [(MUG, 200, 120)])),
        "sub [2024]/m3.png": media.png(media.scene(3, [(MUG, 100, 100)]), media.exif("2024:01:05 08:30:00"), 4),
        "twice.png": media.png(media.scene(4, [(MUG[:, :42], 10, 10), (MUG[:, 42:], 200, 130)]), media.exif("2024:02:01 00:00:00"), 2),
        "t1.png": media.png(media.scene(5, [(TRAP, 50, 60)]), None, 1),
        "t2.png": media.png(media.scene(6, [(TRAP, 150, 60)]), None, 3),
        "n1.png": media.png(media.scene(7, [])),
        "n2.bmp": media.bmp(media.scene(8, [])),
        "clip.avi": media.avi([media.scene(20 + i, [(MUG, 60, 80)] if 4 <= i < 8 else []) for i in range(12)], 1),
        "head.jpg": media.jpeg_header(4000, 3000, media.exif("2020:12:31 23:59:59", (-33.0, 151.25))),
        "broken.png": b"\x89PNG\r\n\x1a\nnothing",
        "notes.txt": b"x",
    }
    for i, (name, raw) in enumerate(files.items()):
        path = root / name
        path.write_bytes(raw)
        os.utime(path, (1_600_000_000 + i, 1_600_000_000 + i))
    return root


def test_formats():
    p = media.scene(3, [(MUG, 100, 100)])[:121, 60:223]
    for kind in range(5):
        assert (pictures.grey(media.png(p, None, kind)) == p).all()
    assert np.abs(pictures.grey(media.bmp(p)) - p).max() < 1e-3
    shown = list(pictures.frames(media.avi([p, p // 2, p // 3, p // 4, p // 5], 2), 1.0))
    assert [t for t, _ in shown] == [0.0, 1.0, 2.0]
    assert np.abs(shown[1][1] - p // 3).max() < 1e-3
    whole = media.png(p, media.exif("2024:03:01 10:00:00", (48.2, -16.5)))
    f = pictures.facts(whole)
    assert (f.width, f.height, f.times) == (163, 121, ["2024:03:01 10:00:00", None, None])
    assert (f.lat[3], f.lon[3]) == ("N", "W")
    assert f.lat[0] + f.lat[1] / 60 + f.lat[2] / 3600 == pytest.approx(48.2, abs=1e-6)
    rng = np.random.default_rng(0)
    for raw in (whole, media.bmp(p), media.avi([p, p], 1), media.jpeg_header(40, 30, media.exif("2020:12:31 23:59:59"))):
        for _ in range(60):  # damage gives nothing, not an error
            cut = bytearray(raw[: rng.integers(0, len(raw))])
            for k in rng.integers(0, max(1, min(len(cut), 200)), 3):
                if len(cut):
                    cut[k] = rng.integers(0, 256)
            pictures.facts(bytes(cut)), pictures.grey(bytes(cut)), list(pictures.frames(bytes(cut), 1.0))


def test_index_then_query(spark, folder, tmp_path):
    store = IndexStore(spark, f"{tmp_path}/index", "plain")
    store.create()
    library, steps = Library(store, provider=PlainPictures()), []
    run = library.index(str(folder), steps.append, chunk=4)
    assert (run.photos_indexed, run.frames, run.total_photos, run.kept) == (16, 6, 16, 0)
    assert [(s.phase, s.done, s.todo) for s in steps] == [("scanning", 0, 0), ("reading", 0, 11), ("reading", 4, 11), ("reading", 8, 11), ("done", 11, 11)]
    photos = {at(r.path): r for r in store.table("photos").collect()}
    assert (photos["m1.png"].width, photos["m1.png"].height, photos["m1.png"].taken_at) == (320, 240, datetime.datetime(2024, 3, 1, 10))
    assert photos["m1.png"].gps.lat == pytest.approx(48.2, abs=1e-6)
    assert photos["m1.png"].gps.lon == pytest.approx(-16.5, abs=1e-6)
    assert not photos["m1.png"].taken_at_inferred
    assert (photos["head.jpg"].width, photos["head.jpg"].taken_at) == (4000, datetime.datetime(2020, 12, 31, 23, 59, 59))
    assert photos["head.jpg"].gps.lat == -33.0
    assert photos["m2.bmp"].taken_at_inferred
    assert photos["m2.bmp"].taken_at == datetime.datetime(2020, 9, 13, 12, 26, 41)
    assert photos["broken.png"].width is None
    clip = sorted(r.frame_time_sec for r in photos.values() if r.source_video_path)
    assert clip == [0.0, 2.0, 4.0, 6.0, 8.0, 10.0]
    assert photos["clip.avi@4.0"].taken_at == datetime.datetime(2020, 9, 13, 12, 26, 52)
    assert photos["clip.avi@4.0"].photo_id == __import__("hashlib").sha1(f"{folder}/clip.avi@4.0".encode()).hexdigest()[:16]

    box = (20 / 320, 30 / 240, 110 / 320, 120 / 240)
    answer = library.query(photos["m1.png"].photo_id, box)
    got = [at(r.path) for r in answer.matches.collect()]
    assert got == ["m2.bmp", "clip.avi@4.0", "clip.avi@6.0", "m3.png", "twice.png"]  # by time
    assert at(answer.last_seen.first().path) == "twice.png"
    assert "twice.png" in answer.warning()
    first = answer.matches.where("path like '%m2.bmp'").first()
    assert (first.x1 * 320, first.y1 * 240, first.x2 * 320, first.y2 * 240) == pytest.approx((200, 120, 290, 210), abs=3)

    again = library.index(str(folder))
    assert (again.photos_indexed, again.photos_removed, again.kept) == (0, 0, 11)
    (folder / "m2.bmp").unlink()
    (folder / "clip.avi").write_bytes(media.avi([media.scene(40, [(MUG, 60, 80)])] * 3, 1))
    (folder / "n1.png").write_bytes(media.png(media.scene(7, [(MUG, 150, 90)]), media.exif("2025:01:01 00:00:00")))
    third = library.index(str(folder))
    assert (third.photos_indexed, third.photos_removed, third.total_photos) == (3, 7, 11)
    got = [at(r.path) for r in library.query(photos["m1.png"].photo_id, box).matches.collect()]
    assert sorted(got) == ["clip.avi@0.0", "clip.avi@2.0", "m3.png", "n1.png", "twice.png"]
    (folder / "clip.avi").unlink()
    assert library.index(str(folder)).photos_removed == 2


def test_keypoints_are_found_when_they_are_asked_for(spark, folder, tmp_path):
    store = IndexStore(spark, f"{tmp_path}/index", "plain")
    store.create()
    index_folder(store, str(folder), PlainPictures(), features=False)
    assert store.table("keypoints").count() == 0
    photos = {at(r.path): r.photo_id for r in store.table("photos").collect()}
    box = (20 / 320, 30 / 240, 110 / 320, 120 / 240)
    library = Library(store, provider=PlainPictures())
    got = {at(r.path) for r in library.query(photos["m1.png"], box, top_k=16).matches.collect()}
    assert got == {"m2.bmp", "clip.avi@4.0", "clip.avi@6.0", "m3.png", "twice.png"}
    known = store.table("keypoints").count()
    assert known > 0
    library.query(photos["m1.png"], box, top_k=16)
    assert store.table("keypoints").count() == known


def test_another_verifier(spark, folder, tmp_path):
    """Stage two is a seam, and the six-parameter form a switch."""
    store = IndexStore(spark, f"{tmp_path}/index", "plain")
    store.create()
    index_folder(store, str(folder), PlainPictures())
    photos = {at(r.path): r.photo_id for r in store.table("photos").collect()}
    box = (20 / 320, 30 / 240, 110 / 320, 120 / 240)

    def all_of_it(src, dst, q_size, c_size, affine=False):
        return [{"inliers": 99, "matches": len(src), "box": [0.0, 0.0, 1.0, 1.0], "scale": 1.0}]

    everything = Library(store, verifier=all_of_it).query(photos["m1.png"], box)
    assert {r.inliers for r in everything.matches.collect()} == {99}
    plain = Library(store).query(photos["m1.png"], box)
    affine = Library(store, affine=True).query(photos["m1.png"], box)
    assert {r.path for r in affine.matches.collect()} == {r.path for r in plain.matches.collect()}
    assert matching.DETECTIONS == 2


def test_tables_of_many_parts(spark, tmp_path, monkeypatch):
    """Commits add and drop by id; a dead writer changes nothing; many parts are rewritten as one."""
    store = IndexStore(spark, f"{tmp_path}/index", "m")
    store.create()
    row = lambda i, size: (f"p{i}", f"/l/{i}.jpg", None, None, None, True, None, None, None, 1, size)
    photos = lambda *r: spark.createDataFrame(list(r), SCHEMAS["photos"])
    regions = lambda *ids: spark.createDataFrame([(f"p{i}", 0, 0.0, 0.0, 1.0, 1.0, [float(i)]) for i in ids], SCHEMAS["regions"])
    store.upsert_photos(photos(row(1, 1), row(2, 1), row(3, 1)), regions(1, 2, 3))
    store.upsert_photos(photos(row(2, 2)), regions(2, 2))
    store.drop_photos(photos(row(1, 1)))
    store.upsert_photos(photos(row(1, 3)), regions(1))
    state = lambda: (sorted((r.photo_id, r.size) for r in store.table("photos").collect()), sorted(r.photo_id for r in store.table("regions").collect()))
    assert state() == ([("p1", 3), ("p2", 2), ("p3", 1)], ["p1", "p2", "p2", "p3"])
    monkeypatch.setattr(store, "_stamp", lambda *_: (_ for _ in ()).throw(RuntimeError))
    with pytest.raises(RuntimeError):
        store.drop_photos(photos(row(3, 1)))
    monkeypatch.undo()
    before = state()
    assert before == ([("p1", 3), ("p2", 2), ("p3", 1)], ["p1", "p2", "p2", "p3"])
    assert store_module.PARTS > 4
    monkeypatch.setattr(store_module, "PARTS", 4)
    for _ in range(2):
        store.drop_photos(photos(row(9, 1)))
    assert sorted(n for n, _ in store._latest()[1]) in (["photos", "regions"], ["dropped", "photos", "regions"])
    assert state() == before
    assert len(os.listdir(f"{tmp_path}/index/photos")) == 1


def test_tables_made_elsewhere(spark, folder, tmp_path):
    store = IndexStore(spark, f"{tmp_path}/index", "tables")
    store.create()
    from glimpsar.sources.files import scan_folder

    ids = [r.photo_id for r in scan_folder(spark, str(folder)).where("kind = 'image'").collect()]
    vectors = spark.createDataFrame([(i, 0, 0.0, 0.0, 1.0, 1.0, [1.0, 0.0]) for i in [*ids, "other"]], SCHEMAS["regions"])
    points = spark.createDataFrame([(i, 0, 0, 0, 1.0, 1.0, [1.0]) for i in ids], SCHEMAS["keypoints"].replace("`desc`", "desc"))
    run = index_folder(store, str(folder), TableEmbeddings(vectors, points))
    assert (run.photos_indexed, run.frames) == (10, 0)
    assert store.table("regions").count() == store.table("keypoints").count() == 10
    assert store.table("keypoints").where("size > 0").count() == 10


def test_chunks_and_content(spark, folder):
    from glimpsar.sources.files import scan_folder

    files = scan_folder(spark, str(folder))
    parts = list(chunks(files, 4))
    assert [p.count() for p in parts] == [4, 4, 3]
    read = {r.path: len(r.content) for p in parts for r in with_content(p).collect()}
    assert read == {r.path: r.size for r in files.collect()}
