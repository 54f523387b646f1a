"""Scanning a real folder, indexing it twice, stamps, and the streaming fold."""

from __future__ import annotations

import os

import pytest

from glimpsar.sources.files import container_time, scan_folder
from glimpsar.sources.indexer import index_folder
from glimpsar.sources.providers import PlantedEmbeddings
from glimpsar.sources.store import IndexStore, StampError
from glimpsar.streaming.feedback import append_stream, feedback_stream


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "lib"
    for name in ("A_1.jpg", "A_2.JPG", "B_1.png", ".hidden.jpg", "notes.txt", "sub/clip.mp4", "index/x.jpg"):
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(name.encode())
    return root


def test_scan(spark, folder):
    found = scan_folder(spark, str(folder), f"{folder}/index").collect()
    assert {os.path.basename(r.path): r.kind for r in found} == {"A_1.jpg": "image", "A_2.JPG": "image", "B_1.png": "image", "clip.mp4": "video"}
    assert all(len(r.photo_id) == 16 and r.size > 0 and r.mtime_ns > 0 for r in found)


def test_container_time(spark):
    df = spark.createDataFrame([('{"format": {"tags": {"creation_time": "2024-01-02T03:04:05.000000Z"}}}',), ("junk",), (None,)], "probe string")
    assert [str(r.created_at) for r in container_time(df).collect()] == ["2024-01-02 03:04:05", "None", "None"]


def test_index_is_incremental(spark, folder, tmp_path):
    store = IndexStore(spark, f"{tmp_path}/index", "planted")
    store.create()
    first = index_folder(store, str(folder), PlantedEmbeddings())
    assert (first.photos_indexed, first.total_photos) == (4, 4)
    again = index_folder(store, str(folder), PlantedEmbeddings())
    assert (again.photos_indexed, again.photos_removed, again.kept) == (0, 0, 4)
    (folder / "A_1.jpg").unlink()
    (folder / "B_1.png").write_bytes(b"longer than it was before")
    third = index_folder(store, str(folder), PlantedEmbeddings())
    assert (third.photos_indexed, third.photos_removed, third.total_photos) == (1, 1, 3)
    assert store.table("regions").count() == 15
    other = tmp_path / "other"
    other.mkdir()
    (other / "T_1.jpg").write_bytes(b"x")
    index_folder(store, str(other), PlantedEmbeddings())
    assert store.table("photos").count() == 4  # the first folder's photos are untouched
    assert third.index_bytes > 0
    assert third.rate() > 0
    store.compact()
    assert (store.table("photos").count(), store.table("regions").count()) == (4, 20)
    with pytest.raises(StampError):
        IndexStore(spark, f"{tmp_path}/index", "another").table("photos")


def test_feedback_stream(spark, tmp_path):
    src, out = f"{tmp_path}/in", []
    schema = "object_id long, photo_id long, seq long, confirmed boolean"
    for batch in ([(1, 5, 1, True), (1, 6, 2, False)], [(1, 5, 3, False), (2, 9, 4, True)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
        stream = feedback_stream(spark.readStream.schema(schema).parquet(src))
        q = stream.writeStream.outputMode("update").foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
    last = {r.object_id: (r.exemplars, r.rejected) for r in out}
    assert last == {1: ([], [6, 5]), 2: ([9], [])}


def test_feedback_stream_with_seeds(spark, tmp_path):
    src, out = f"{tmp_path}/in", []
    schema = "object_id long, photo_id long, seq long, kind string"
    for batch in ([(1, 5, 1, "seed"), (1, 6, 2, "seed"), (1, 7, 3, "confirm")], [(1, 5, 4, "reject"), (1, 7, 5, "reject"), (1, 6, 6, "seed")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
        stream = feedback_stream(spark.readStream.schema(schema).parquet(src))
        q = stream.writeStream.outputMode("update").foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
    assert [(r.exemplars, r.box_seqs, r.rejected) for r in out] == [([5, 7], [1, 3], []), ([6], [6], [5, 7])]


def test_append_stream(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/in")
    got = []
    append_stream(spark.readStream.schema("id long").parquet(f"{tmp_path}/in"), lambda df, _: got.extend(df.collect()), f"{tmp_path}/cp").awaitTermination()
    assert len(got) == 3
