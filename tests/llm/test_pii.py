from __future__ import annotations

import random
import re

import numpy as np
import pytest

from glimpsar.llm import pii

from .data import SCHEMA, documents

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def fits(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 if kind == "phone" else True


def brute(text):
    found = [(m.start(), k, m.end()) for k, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if fits(kind, m.group())]
    return sorted(found)


def odd_texts(n=400):
    rnd = random.Random(3)
    bits = ["a@b.c", "x.y+z@mail-1.example.com", "@", ".", "..", "1.2.3.4", "256.1.1.1", "007.0.0.1", "1.2.3.4.5.6.7.8", "4539 1488 0343 6467", "4539148803436467", "6011-0009-9013-9424", "1", "12", " ", "-", "  ", "+1 (555) 123-4567", "+", "+49", "(0)30 123456", "é", "😀", "\n", "word ", "_", "%", "4111111111111111", "0" * 25, "a.b@c"]
    return ["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 12))) for _ in range(n)]


def test_base_spans_are_the_patterns(spark):
    texts = odd_texts() + ["9" * 5000 + "@", "1-" * 4000 + "1", ("a" * 3000 + "." + "b" * 3000), "a@b.c " * 1500, "1." * 3000, "+" + "1 " * 4000]
    docs = [(i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: [tuple(s) for s in r.base] for r in pii.find(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, t in docs:
        assert got[i] == brute(t), t[:80]


def test_nulls_and_nothing(spark):
    docs = [*documents(8), (None, "me@x.org", *[None] * 7), (1, "me@x.org", *[None] * 7)]
    got = pii.find(spark.createDataFrame(docs, SCHEMA)).collect()
    assert len(got) == len(docs)
    assert sorted(len(r.base) for r in got)[-2:] == [1, 1]
    assert pii.find(spark.createDataFrame(docs, SCHEMA).where("false")).count() == 0


def test_added_spans(spark):
    rnd = random.Random(5)
    token = lambda: "".join(rnd.choice("0123456789abcdef") for _ in range(40))
    docs = [(i, f'some words token = "{token()}" and mail a{i}@mail.example.com or call 555 {200 + i}-{4000 + i}') for i in range(60)]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.find(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, t in docs:
        kinds = {pii.KINDS[k]: t[a:b] for a, k, b in got[i]}
        assert kinds["email"] == f"a{i}@mail.example.com"
        assert re.fullmatch('"[0-9a-f]{40}"', kinds["secret"])
        assert sorted(got[i]) == got[i]


def test_reliabilities_find_the_better_labeler():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.4
    votes = np.column_stack([np.where(rng.random(4000) < p, np.where(truth, 1, -1), np.where(truth, -1, 1)) for p in (0.95, 0.8, 0.6)])
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    right, post = pii.reliabilities([(0, tuple(p), float(c)) for p, c in zip(patterns.tolist(), counts.tolist(), strict=True)])
    assert right.tolist() == sorted(right, reverse=True)
    assert right[0] == pytest.approx(0.95, abs=0.03)
    assert min(post) < 0.1 < 0.9 < max(post)
    assert pii.classifier([])[0] < 0


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a@b.c")], "doc_id long, text string")
    plan = pii.candidates(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
