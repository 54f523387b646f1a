from __future__ import annotations

import os

import pyarrow as pa
import pytest

from glimpsar.llm import common, words


def test_stored_tables_lie_in_the_shared_folder_and_go(spark):
    before = os.listdir(common.shared_dir(spark).removeprefix("file://")) if os.path.isdir(common.shared_dir(spark).removeprefix("file://")) else []
    assert common.stored(spark.range(3), "three").count() == 3
    common.discard_stored(spark)
    left = os.listdir(common.shared_dir(spark).removeprefix("file://"))
    assert not [x for x in left if x.startswith("three")]
    assert len(left) <= len(before) + 1


@pytest.mark.parametrize("limit", [1, 7, 100])
def test_pieces_cut_and_join(limit):
    values = ["abc", None, "", "defghij", "k", "lm"]
    batches = [pa.RecordBatch.from_pydict({"t": values[i : i + 2]}) for i in (0, 2, 4)]
    out = list(common.pieces(batches, "t", limit))
    assert [x for b in out for x in b.column("t").to_pylist()] == values
    assert all(sum(len(x or "") for x in b.column("t").to_pylist()) <= max(limit, 7) for b in out)
    assert list(common.pieces([pa.RecordBatch.from_pydict({"t": pa.array([], pa.string())})], "t")) == []


def test_small_sides_are_broadcast_and_large_ones_hashed(spark):
    few = common.small_or_hashed(spark.range(10), 8)
    many = common.small_or_hashed(spark.range(10), common.BROADCAST_BYTES)
    assert "broadcast" in few._jdf.queryExecution().analyzed().toString()
    assert "shuffle_hash" in many._jdf.queryExecution().analyzed().toString().lower()


def test_words_and_shingles_follow_their_definition():
    texts = ["", "a", "A b-C d", "x " * 9, "\u00e9\u00c9 2_3", "word" * 3000]
    hashes, bounds = words.hash_words([t.encode() for t in texts])
    listed = [words.words_of(t) for t in texts]
    assert [len(w) for w in listed] == (bounds[1:] - bounds[:-1]).tolist()
    by_word: dict = {}
    for i, own in enumerate(listed):
        for word, h in zip(own, hashes[bounds[i] : bounds[i + 1]], strict=True):
            assert by_word.setdefault(word, h) == h
    assert len(set(by_word.values())) == len(by_word)
    grams, edges = words.shingles([t.encode() for t in texts], 5)
    assert (edges[1:] - edges[:-1]).tolist() == [0, 1, 1, 5, 1, 1]
    assert len(set(grams[edges[3] : edges[4]].tolist())) == 1
    assert words.shingles([], 5)[0].size == 0
