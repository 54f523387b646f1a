from __future__ import annotations

import re

import pytest

from glimpsar.llm import decontaminate

from .data import SCHEMA, documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    out = []
    for i, text, *_ in docs:
        w, hit, names = words(text), set(), set()
        for name, item in items:
            v = words(item)
            n = min(13, len(v))
            wanted = {tuple(v[a : a + n]) for a in range(len(v) - n + 1 if v else 0)}
            for b in range(len(w) - n + 1 if wanted else 0):
                if tuple(w[b : b + n]) in wanted:
                    hit.update(range(b, b + n))
                    names.add(str(name))
        out.append((i, len(w), len(hit), sorted(names)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [8 << 20, 150])
def test_against_brute_force(spark, block_bytes):
    docs = documents(2)
    docs += [(1000, " ".join(["w1 w2 w3 w5 w7"] * 4000) + " " + docs[40][1], *docs[0][2:]), (None, docs[40][1], *docs[0][2:]), docs[40]]
    texts = [d[1] for d in docs if d[1] and len(words(d[1])) > 20]
    items = [(1, " ".join(texts[0].split()[2:20])), (8, texts[5]), (2, texts[1].upper()), (3, "one, two: THREE"), (4, None), (5, ""), (6, "...!"), (7, "w1 w2"), (30, " ".join(texts[0].split()[4:24])), (None, "w3 w4")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_contamination(spark.createDataFrame(docs, SCHEMA), bench, block_bytes=block_bytes).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got), key=str) == brute(docs, [x for x in items if x[0] is not None])
    by_id = {d[0]: d[1] for d in docs}
    own = decontaminate.with_hits(spark.createDataFrame(docs, SCHEMA).withColumnRenamed("rep", "row.x").withColumnRenamed("digest", "Doc"), bench, block_bytes=block_bytes)
    assert own.columns == [*SCHEMA.replace(",", "").replace("rep", "row.x").replace("digest", "Doc").split()[::2], "n_words", "n_hit", "items", "spans"]
    assert sorted(((r[0], r[-4], r[-3], r[-2]) for r in own.collect()), key=str) == brute(docs, [x for x in items if x[0] is not None])
    for r in got:  # offsets lead to the words of the original
        assert sum(len(words(by_id[r.doc_id][s.start : s.end])) for s in r.spans) == r.n_hit


def test_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_words, r.n_hit) for r in decontaminate.find_contamination(docs, none).collect()) == [(0, 0, 0), (1, 2, 0), (1, 2, 0)]
    assert decontaminate.find_contamination(docs.where("false"), none).count() == 0
