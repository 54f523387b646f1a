from __future__ import annotations

import hashlib
import re

import pytest

from glimpsar.llm import common, line_dedup

from .data import SCHEMA, documents


def key(line: str) -> str:
    stripped = re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line)
    return re.sub("[A-Z]", lambda m: m[0].lower(), stripped)


def brute(docs):
    holders: dict[str, set] = {}
    for i, text, *_ in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, text, *_ in docs:
        lines = (text or "").split("\n")
        keep = [x for x in lines if len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == i]
        out.append((i, "\n".join(keep), len(lines), len(lines) - len(keep)))
    return sorted(out)


@pytest.mark.parametrize("bits", [None, 2048])
def test_against_brute_force(spark, bits):
    """A filter that is full all over suspects every line, and the result is the same."""
    docs = documents(1)
    out = line_dedup.dedup_lines(spark.createDataFrame(docs, SCHEMA), bits=bits)
    assert set(out.columns) == {*SCHEMA.replace(",", "").split()[::2]} | {"n_dropped"}
    assert sorted((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect()) == brute(docs)


def test_repeated_rows_null_ids_and_nothing(spark):
    line = "the same long line"
    df = spark.createDataFrame([(5, line), (5, line), (None, line + "\nshort"), (None, line)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.text, r.n_dropped) for r in line_dedup.dedup_lines(df).collect()), key=str)
    assert got == sorted([(5, line, 0), (5, line, 0), (None, "short", 1), (None, "", 1)], key=str)
    only_null = line_dedup.dedup_lines(df.where("doc_id is null")).collect()
    assert sum(r.n_dropped for r in only_null) == 0  # rows without an id are one document
    assert line_dedup.dedup_lines(df.where("false")).count() == 0


@pytest.mark.parametrize("bound", [32 << 20, 100])
def test_every_way_back_to_the_texts(spark, monkeypatch, bound):
    """Keys of changed texts broadcast, or nothing: the same texts, with clashing and odd column names kept."""
    monkeypatch.setattr(common, "BROADCAST_BYTES", bound)
    docs = [(*d[:2], "mine", "yours", "x", "y") for d in documents(3, 90)] + [(None, "w1 w2 w3 w4 w5 w6\n" + "x" * n, "mine", "yours", "x", "y") for n in (3, 3, 4)]
    df = spark.createDataFrame(docs, "doc_id long, text string, DOC string, `row.x` string, Dropped string, `a``b` string")
    out = line_dedup.dedup_lines(df, counts=("lines", "gone"))
    assert out.columns == [*df.columns, "lines", "gone"]
    got = out.collect()
    assert all((r["DOC"], r["row.x"], r["Dropped"], r["a`b"]) == ("mine", "yours", "x", "y") for r in got)
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    numbered = [(10**9 if d[0] is None else d[0], *d[1:]) for d in docs]  # as one document after all others
    assert order((r.doc_id, r.text, r.lines, r.gone) for r in got) == order((None if i == 10**9 else i, *rest) for i, *rest in brute(numbered))


def test_filter_follows_the_lines(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "FILTER_BITS", 64)
    df = spark.createDataFrame([(1, "a\nb\nc"), (2, None), (3, "")], "doc_id long, text string")
    assert line_dedup.filter_bits(df) == 64
    assert line_dedup.filter_bits(spark.createDataFrame([(1, "x\n" * 99)], "doc_id long, text string")) == 1024
    assert line_dedup.filter_bits(df.where("false")) == 64


def test_query_digest(spark, small):
    from glimpsar.llm.catalog import queries

    docs = spark.read.parquet(f"{small}/documents.parquet")
    want = {i: hashlib.sha256(t.encode()).hexdigest() for i, t, _, _ in brute([(r.doc_id, r.text) for r in docs.collect()])}
    assert {r.doc_id: r.kept_sha256 for r in queries()["op3_line_dedup"](spark, small).collect()} == want
