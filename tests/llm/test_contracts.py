"""The ten queries as they are registered, on whole tables, against brute force: columns, types and every digest."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest

from glimpsar.llm import catalog

from .test_contamination import brute as contaminated_brute
from .test_lines import brute as lines_brute
from .test_near import brute as near_brute
from .test_pii import PATTERNS
from .test_pii import brute as pii_brute
from .test_shards_index_pages import brute_nearest

sha = lambda text: hashlib.sha256(text.encode()).hexdigest()

COLUMNS = {
    "op2_permutation_index": "query_id bigint, rank int, vec_id bigint, score double",
    "op3_line_dedup": "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string",
    "op4_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op5_decontaminate": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op6_ngram_jaccard": "doc_id bigint, class_id bigint, n_links bigint",
    "op7_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op8_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op9_html_extract": "page_id bigint, url string, text string, n_chars bigint",
    "op10_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
}


@pytest.fixture(scope="module")
def ask(spark, small):
    """A query's rows by document, after a look at its columns and types."""

    def asked(name: str, key: str = "doc_id") -> dict:
        df = catalog.queries()[name](spark, small)
        types = {f.name: f.dataType.simpleString() for f in df.schema}
        for column in COLUMNS.get(name, "").split(", "):
            if column:
                assert types[column.split()[0]] == column.split()[1], column
        rows = df.collect()
        out = {r[key]: r for r in rows} if key else rows
        assert len(out) == len(rows)
        return out

    return asked


@pytest.fixture(scope="module")
def texts(spark, small):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def library():
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    return tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))


def test_token_counts(ask, texts, library):
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    got = ask("op1_token_counts")
    assert set(got) == set(texts)
    for i, t in texts.items():
        t = t or ""
        counts = [count(t)]
        for start, removed, added in ((len(t) // 2, 0, " [revised]"), (len(t) // 3, 12, ""), (len(t) + 100, 0, "\nAdded later.")):
            t = t[:start] + added + t[start + removed :]
            counts.append(count(t))
        assert [got[i].n_tokens, got[i].n_tokens_1, got[i].n_tokens_2, got[i].n_tokens_3] == counts
        assert got[i].edited_sha256 == sha(t)


def test_permutation_index(ask, spark, small):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    got: dict = {}
    for r in sorted(ask("op2_permutation_index", ""), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r)
    want = brute_nearest(rows, {i for i, _ in rows if i % 20 == 0}, 20)
    assert set(got) == set(want)
    assert all([r["rank"] for r in found] == list(range(1, len(want[q]) + 1)) for q, found in got.items())
    vec = {i: np.array(v) for i, v in rows}
    assert all(r.score == pytest.approx(vec[q] @ vec[r.vec_id], abs=1e-12) and r.vec_id != q for q, found in got.items() for r in found)
    assert all([(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found) for found in got.values())
    assert np.mean([len({r.vec_id for r in got[q]} & {x for x, _ in want[q]}) / len(want[q]) for q in want]) >= 0.9


def test_line_dedup(ask, texts):
    got = ask("op3_line_dedup")
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in got.values()) == sorted((i, n, d, sha(t)) for i, t, n, d in lines_brute(sorted(texts.items())))


def test_toxicity(ask, texts):
    got = ask("op4_toxicity")
    assert set(got) == set(texts)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())


def test_decontaminate(ask, texts, spark, small):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    got = ask("op5_decontaminate")
    want = contaminated_brute(sorted(texts.items()), items)
    assert [(i, got[i].n_words, got[i].n_hit, got[i].n_items, got[i].items_sha256, got[i].contaminated) for i, *_ in want] == [
        (i, n, hit, len(names), sha(",".join(names)), hit > 0 and 20 * hit >= n) for i, n, hit, names in want
    ]


def test_ngram_jaccard(ask, texts):
    got = ask("op6_ngram_jaccard")
    assert {i: (r.class_id, r.n_links) for i, r in got.items()} == near_brute(sorted(texts.items()))


def test_bpe(ask, texts, library):
    got = ask("op7_bpe")
    assert set(got) == set(texts)
    for i, t in texts.items():
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_sharding(ask, texts):
    got = ask("op8_sharding")
    assert set(got) == set(texts)
    for i, t in texts.items():
        raw = (t or "").encode()
        assert (got[i].size, got[i].text_crc32, got[i].law, got[i].grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
    for s in range(24):
        slots = sorted(r.slot for r in got.values() if r.shard == s)
        assert slots == list(range(len(slots)))
    assert {r.shard for r in got.values()} <= set(range(24))
    where: dict = {}
    for i, t in texts.items():
        where.setdefault(t, set()).add(got[i].shard)
    assert all(len(s) == 1 for s in where.values())
    loads = np.bincount([r.shard for r in got.values()], weights=[r.size for r in got.values()], minlength=24)
    groups = {t: sum(got[i].size for i, u in texts.items() if u == t) for t in where}
    greedy = np.zeros(24)
    for size in sorted(groups.values(), reverse=True):
        greedy[greedy.argmin()] += size
    assert loads.max() - loads.min() <= greedy.max() - greedy.min()


def test_html_extract(ask, spark, small):
    pages = {r.page_id: r for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    got = ask("op9_html_extract", "page_id")
    assert set(got) == set(pages)
    assert all(r.url == pages[i].url and r.n_chars == len(r.text) for i, r in got.items())
    assert all(" ".join(block.split()) == block for r in got.values() for block in r.text.split("\n"))
    assert not any("<" in r.text and ">" in r.text for r in got.values())


def test_pii(ask, texts):
    got = ask("op10_pii")
    assert set(got) == set(texts)
    names = list(PATTERNS)
    for i, t in texts.items():
        base = pii_brute(t)
        listed = [f"{names[k]}:{a}:{b}" for a, k, b in base]
        r = got[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for _, k, _ in base) for n in range(4)]
        assert r.base_sha256 == sha(",".join(listed))
        assert set(listed) <= set(r.spans.split(",")) | {""}
        starts = [int(s.split(":")[1]) for s in r.spans.split(",") if s]
        assert starts == sorted(starts)


def test_long_texts_and_clashing_columns(spark):
    """Operators that read a text and give one row for it: whole texts of megabytes, and any other columns."""
    from glimpsar.llm import bpe, pii, sharding, token_counts

    long = "some words 1.2.3.4 and a@b.example. " * 60_000
    rows = [(1, long, "x", 1, 2.0, [], "y"), (2, None, "x", 1, 2.0, [], "y"), (2, "", "x", 1, 2.0, [], "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, shard int, score double, edits array<struct<start: int, removed: int, inserted: string>>, spans string")
    counts = sorted((r.doc_id, r.n_tokens) for r in token_counts.count_with_edits(df).collect())
    tokens = sorted((r.doc_id, len(r.ids)) for r in bpe.round_trip(df).collect())
    assert counts == tokens
    assert tokens[0][1] > 500_000
    assert [len(r.decoded) for r in bpe.round_trip(df.where("doc_id = 1")).collect()] == [len(long)]
    assert sorted((r.doc_id, r.size) for r in sharding.shard(df, 3).collect()) == [(1, len(long) + 8), (2, 8), (2, 8)]
    assert sorted((r.doc_id, len(r.base)) for r in pii.find(df).collect()) == [(1, 120_000), (2, 0), (2, 0)]


def test_long_words_are_told_apart():
    from glimpsar.llm import words

    a = bytearray(b"ab" * 10_000)
    variants = [bytes(a)]
    for far in (4096, 8192, 12_288):
        b = bytearray(a)
        b[0], b[far + 1] = b[far + 1], b[0]  # the same bytes at the same places modulo 4096, but for one step
        b[0], b[far] = ord("x"), ord("y")
        variants.append(bytes(b))
        c = bytearray(a)
        c[0], c[far] = ord("y"), ord("x")
        variants.append(bytes(c))
    hashes, _ = words.hash_words(variants)
    assert len(set(hashes.tolist())) == len(set(variants)) == len(variants)
