from __future__ import annotations

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from glimpsar.llm import decontaminate, toxicity  # noqa: E402

from .test_contamination import brute as contaminated_brute  # noqa: E402
from .test_lines import brute as lines_brute  # noqa: E402
from .test_near import brute as near_brute  # noqa: E402


def test_stages_do_what_their_operators_say(spark, small):
    """Each stage against a brute-force version of it, on what the one before has kept."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}

    model = toxicity.train(docs, spark.read.parquet(f"{small}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.score(docs, model).collect() if r.score >= 0.5}
    one = stages["toxicity"](spark, docs, small).persist()
    assert one.columns == columns
    assert texts(one) == {i: t for i, t in texts(docs).items() if i not in bad}

    two = stages["line_dedup"](spark, one, small).persist()
    assert two.columns == columns
    assert texts(two) == {i: t for i, t, _, _ in lines_brute(sorted(texts(one).items()))}
    assert all(r.n_chars == len(r.text) for r in two.collect())

    three = stages["ngram_jaccard"](spark, two, small).persist()
    groups = near_brute(sorted(texts(two).items()))
    assert three.columns == columns
    assert set(texts(three)) == {i for i, (g, _) in groups.items() if g == i}

    four = stages["decontaminate"](spark, three, small).persist()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    gone = {i for i, n, hit, _ in contaminated_brute(sorted(texts(three).items()), items) if hit and 20 * hit >= n}
    assert four.columns == columns
    assert set(texts(four)) == set(texts(three)) - gone

    last = stages["bpe"](spark, four, small)
    assert {r.doc_id for r in last.collect()} == set(texts(four))
    assert decontaminate.WINDOW == 13


def test_run_and_odd_rows(spark, small, tmp_path):
    import shutil

    for name in ("labels", "benchmark"):
        shutil.copy(f"{small}/{name}.parquet", tmp_path)
    rows = [(1, None, "en", None, None), (2, "", None, "s", 0), (None, "a text without an id", "en", "s", 20), (4, "plain words here to keep", "en", "s", 24)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {1, None, 4}
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


SCHEMA = "doc_id long, text string, n_lines string, Score string, `a.b` string, items string, n_chars int, number string, class_id long, gone string, repeated string"


def _rows(spark, pairs):
    return spark.createDataFrame([(i, t, "mine", "s", "dot", "i", -1, "n", 7, "g", "r") for i, t in pairs], SCHEMA)


def _stage(spark, small, name, pairs):
    """(id, text) of what a stage keeps; all other columns come through as they were."""
    df = _rows(spark, pairs)
    out = dict(corpus_pipeline.STAGES)[name](spark, df, small)
    assert out.columns == df.columns
    assert [f.dataType for f in out.schema] == [f.dataType for f in df.schema]
    got = out.collect()
    assert all(tuple(r)[2:6] + tuple(r)[7:] == ("mine", "s", "dot", "i", "n", 7, "g", "r") for r in got)
    return sorted(((r.doc_id, r.text) for r in got), key=str)


LONG = " ".join(f"word{i}" for i in range(30_000))


def test_toxic_rows_go_one_by_one(spark, small):
    clean, bad = "the garden is green in summer", "you are an idiot. stupid idiot, you moron. you disgusting worthless scum!"
    pairs = [(1, clean), (1, bad), (None, clean), (None, bad), (None, bad), (2, None), (3, ""), (4, clean), (4, clean), (5, LONG), (6, LONG + " " + bad * 40)]
    want = sorted(((i, t) for i, t in pairs if bad not in (t or "")), key=str)
    assert _stage(spark, small, "toxicity", pairs) == want
    assert _stage(spark, small, "toxicity", []) == []


def test_lines_of_odd_rows(spark, small):
    line = "a line that is here again"
    pairs = [(5, line), (5, line), (None, line + "\nshort"), (None, line), (2, None), (3, ""), (7, "x\n" + line), (8, LONG), (9, LONG + "\nend")]
    want = sorted([(5, line), (5, line), (None, "short"), (None, ""), (2, ""), (3, ""), (7, "x"), (8, LONG), (9, "end")], key=str)
    assert _stage(spark, small, "line_dedup", pairs) == want
    assert _stage(spark, small, "line_dedup", []) == []


@pytest.mark.parametrize("top", [20, (1 << 63) - 1])
def test_one_of_each_group_of_odd_rows(spark, small, top):
    a, b = " ".join(f"a{i}" for i in range(200)), " ".join(f"b{i}" for i in range(50))
    near = a + " and more"
    pairs = [(9, a), (3, near), (None, a), (7, b), (7, b), (8, LONG), (top, LONG + " x"), (None, "c c c"), (None, "c c c"), (None, "d d d"), (6, "e"), (6, "f"), (10, None), (11, ""), (2, "e")]
    got = _stage(spark, small, "ngram_jaccard", pairs)
    if top == 20:
        want = [(3, near), (7, b), (8, LONG), (None, "c c c"), (None, "d d d"), (2, "e"), (6, "f"), (10, None)]
        assert got == sorted(want, key=str)
    else:  # no room beyond the ids: odd rows come first
        want = [(None, a), (7, b), (8, LONG), (None, "c c c"), (None, "d d d"), (6, "e"), (6, "f"), (10, None)]
        assert got == sorted(want, key=str)
    assert _stage(spark, small, "ngram_jaccard", []) == []


def test_contaminated_rows_go_one_by_one(spark, small):
    passage = next(r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect() if r.text and len(r.text.split()) > 20)
    pairs = [(1, "clean words"), (1, passage), (None, passage), (None, "clean words"), (2, None), (3, ""), (4, passage), (4, passage), (5, LONG), (6, LONG + " " + passage)]
    want = sorted(((i, t) for i, t in pairs if t != passage), key=str)
    assert _stage(spark, small, "decontaminate", pairs) == want
    assert _stage(spark, small, "decontaminate", []) == []


def test_last_stage_of_odd_rows(spark, small):
    got = corpus_pipeline.encode(spark, _rows(spark, [(1, None), (1, None), (None, "a"), (5, LONG)]), small).collect()
    assert sorted(((r.doc_id, r.n_tokens > 0) for r in got), key=str) == sorted([(1, False), (1, False), (None, True), (5, True)], key=str)
