from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glimpsar.llm import bpe, token_counts

from .data import SCHEMA, documents

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

PARTS = ["a", "aa", "e", " ", "the", "ing", "\n", "é", "ß", "1", "23", "'s", "'", "_", "²", "中", "😀", "\x1c", "\x85", "\xa0", "  ", "\t", "!", "...", "́", "Ⅷ", "<|endoftext|>", "<|endof", "text|>", "====", "\x00", " ", "﻿"]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.Vocabulary(bpe.tokenizer_content()))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=40).map("".join))
def test_ids_are_the_library_s(library, encoder, text):
    ids = encoder.encode([text])[0].tolist()
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert encoder.vocabulary.decode(ids) == library.decode(ids, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(library, encoder, text):
    assert encoder.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_trie_is_merging_by_rank(encoder):
    rnd = random.Random(1)
    words = sorted({bytes(rnd.choice(b"abcdefgh etaoin\xc3\xa9") for _ in range(rnd.randint(1, 14))) for _ in range(800)})
    assert list(encoder.vocabulary.encode_sorted(words)) == [encoder.vocabulary.merge(w) for w in words]


def test_round_trip(spark, library):
    docs = [*documents(4), (None, "null id", *[None] * 7), (1, "again", *[None] * 7)]
    got = bpe.round_trip(spark.createDataFrame(docs, SCHEMA)).collect()
    texts = sorted((d[1] or "") for d in docs)
    assert sorted(r.decoded for r in got) == texts
    assert all(r.ids == library.encode(r.decoded, add_special_tokens=False).ids for r in got)
    assert bpe.round_trip(spark.createDataFrame(docs, SCHEMA).where("false")).count() == 0


def test_generations_of_the_cache(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 20)
    monkeypatch.setattr(bpe, "CACHE_STEMS", 5)
    monkeypatch.setattr(bpe, "CACHE_PAIRS", 10)
    small = bpe.Encoder(bpe.Vocabulary(bpe.tokenizer_content()))
    for d in documents(5, 40):
        if d[1] and len(d[1]) < 5000:
            assert small.encode([d[1]])[0].tolist() == library.encode(d[1], add_special_tokens=False).ids


def test_edits_are_counted_as_by_counting_again(library, encoder, monkeypatch):
    monkeypatch.setattr(token_counts, "LEAF", 4)
    monkeypatch.setattr(token_counts, "FULL_LEAF", 16)
    rnd = random.Random(2)
    counter = token_counts.Counter(encoder)
    for _ in range(250):
        text = "".join(rnd.choice(PARTS) for _ in range(rnd.choice([0, 5, 60, 300])))
        (tree,) = counter.trees([text])
        for _ in range(5):
            start, removed, new = rnd.randint(0, len(text) + 3), rnd.choice([0, 1, 4, 200]), "".join(rnd.choice(PARTS) for _ in range(rnd.choice([0, 1, 3, 30])))
            count = tree.edit(start, removed, new)
            at = min(start, len(text))
            text = text[:at] + new + text[at + removed :]
            assert tree.text() == text
            assert count == len(library.encode(text, add_special_tokens=False).ids)


def test_a_small_edit_of_a_long_text_encodes_little(encoder):
    (tree,) = token_counts.Counter(encoder).trees(["some words here. " * 5000])
    tree.edit(40_000, 3, "other")
    assert tree.reencoded < 20


def test_edits_of_rows(spark, library):
    rows = [(1, "a b c", [(1, 1, "x"), (0, 0, "y ")]), (2, None, None), (None, "z", [(5, 9, None)]), (1, "a b c", []), (3, "", [(None, None, "new text")])]
    df = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<start:int,removed:int,inserted:string>>")
    got = {(r.doc_id, r.edited): (r.n_tokens, r.counts) for r in token_counts.count_with_edits(df).collect()}
    n = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    assert got == {(1, "y axb c"): (3, [n("axb c"), n("y axb c")]), (2, ""): (0, []), (None, "z"): (1, [1]), (1, "a b c"): (3, []), (3, "new text"): (0, [n("new text")])}
    assert token_counts.count_with_edits(df.where("false")).count() == 0
