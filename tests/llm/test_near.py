from __future__ import annotations

import random

import pytest

from glimpsar.llm import components, near_duplicates
from glimpsar.llm.words import words_of

from .data import SCHEMA, documents


def brute(docs, n=5, limit=0.8):
    sets = {}
    for i, text, *_ in docs:
        w = words_of(text)
        sets[i] = frozenset(tuple(w[a : a + n]) for a in range(max(1, len(w) - n + 1))) if w else frozenset([("", text or "")])
    ids = sorted(sets)
    links = {i: set() for i in ids}
    for a in ids:
        for b in ids:
            if a < b and len(sets[a] & sets[b]) >= limit * len(sets[a] | sets[b]):
                links[a].add(b)
                links[b].add(a)
    group = {}
    for i in ids:
        if i not in group:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in group:
                    group[x] = i
                    todo += links[x]
    return {i: (group[i], len(links[i])) for i in ids}


def test_against_brute_force(spark):
    docs = documents(3, 120)
    got = near_duplicates.near_duplicates(spark.createDataFrame(docs, SCHEMA)).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == brute(docs)
    assert len(got) == len(docs)


def _variants(count, seed):
    rnd = random.Random(seed)
    base = [f"v{i}" for i in range(120)]
    out = []
    for i in range(count):
        w = list(base)
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(len(w))] = f"n{rnd.random()}"
        out.append((i, " ".join(w)))
    return out


@pytest.mark.parametrize("block", [8, 256])
def test_one_large_group_in_blocks_loses_no_link(spark, block):
    docs = _variants(90, 5)
    got = near_duplicates.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), block=block).collect()
    want = brute(docs)
    assert {r.doc_id: r.class_id for r in got} == {i: g for i, (g, _) in want.items()}
    assert sum(r.n_links for r in got) >= 0.999 * sum(n for _, n in want.values())
    assert all(r.n_links <= want[r.doc_id][1] for r in got)


def test_repeated_ids_null_ids_and_nothing(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c, d e f!"), (None, "a b c d e f"), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.copy_id, r.n_copies, r.n_links) for r in near_duplicates.near_duplicates(df).collect()}
    assert got == {1: (1, 1, 2, 1), 2: (1, 1, 2, 1), 3: (3, 3, 2, 1), 4: (3, 3, 2, 1)}
    assert near_duplicates.near_duplicates(df.where("false")).count() == 0


def test_components(spark):
    rnd = random.Random(6)
    chain = [(i, i + 1) for i in range(50)] + [(100, rnd.randint(101, 140)) for _ in range(60)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(51))
    assert {got[b] for a, b in chain if a == 100} == {100}
    assert got[201] == 200
