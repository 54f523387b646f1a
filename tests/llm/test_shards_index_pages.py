from __future__ import annotations

import random
import time
import zlib

import numpy as np
import pytest

from glimpsar.llm import html_extract, permutation_index, sharding

from .data import SCHEMA, documents


def test_differencing_keeps_totals_and_balances():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 1000, 500)
    vectors = np.zeros((500, 24), dtype=np.int64)
    vectors[:, 0] = sizes
    total, parts = sharding.difference(vectors)
    loads = np.bincount(parts[:, 0], weights=sizes, minlength=24)
    assert (loads == total).all()
    greedy = np.zeros(24)
    for s in sorted(sizes, reverse=True):
        greedy[greedy.argmin()] += s
    assert total.max() - total.min() <= greedy.max() - greedy.min()
    again = rng.integers(0, 50, (30, 4))
    total, parts = sharding.difference(again)
    assert total.tolist() == [sum(again[i, c] for i in range(30) for c in range(4) if parts[i, c] == p) for p in range(4)]
    assert all(sorted(row) == [0, 1, 2, 3] for row in parts.tolist())


@pytest.mark.parametrize("bucket_items", [20_000, 3])
def test_shards(spark, monkeypatch, bucket_items):
    monkeypatch.setattr(sharding, "BUCKET_ITEMS", bucket_items)
    docs = [*documents(7, 90), (None, "x", *[None] * 7), (1, "x", *[None] * 7), (1, "x", *[None] * 7)]
    groups = spark.createDataFrame([(str(i), s) for i, s in enumerate(range(1, 41))], "item string, size long")
    placed = sharding.assign(groups, 4, bucket_items).collect()
    assert sorted(int(r.item) for r in placed) == list(range(40))
    loads = [sum(int(r.item) + 1 for r in placed if r.shard == s) for s in range(4)]
    assert max(loads) - min(loads) <= (2 if bucket_items > 3 else 30)
    got = sharding.shard(spark.createDataFrame(docs, SCHEMA), 5).collect()
    assert len(got) == len(docs)
    by_id = {d[0]: d[1] for d in docs}
    for r in got:
        if r.doc_id not in (None, 1):
            raw = (by_id[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
    for s in range(5):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    where: dict = {}
    for d in docs:
        where.setdefault(d[1], set()).update(r.shard for r in got if r.doc_id == d[0] and r.size == len((d[1] or "").encode()) + 8 and r.text_crc32 == zlib.crc32((d[1] or "").encode()))
    assert all(len(s) == 1 for t, s in where.items() if t)
    assert sharding.shard(spark.createDataFrame(docs, SCHEMA).where("false")).count() == 0


def _vectors(n=1500, d=16, seed=0):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, d))
    v[100:400] = v[100]  # ties
    rows = [(i, [float(x) for x in r], 0, 0.5) for i, r in enumerate(v)]
    rows[20] = (20, None, 0, 0.5)
    rows[40] = (40, [0.0] * d, 0, 0.5)
    rows[60] = (60, [float("nan")] * d, 0, 0.5)
    rows[80] = (80, [None, *[1.0] * (d - 1)], 0, 0.5)
    return rows


def brute_nearest(rows, ids, k):
    ok = [(i, np.array(v)) for i, v, *_ in rows if v is not None and None not in v and np.isfinite(v).all() and any(v)]
    names, m = np.array([i for i, _ in ok]), np.array([v for _, v in ok])
    out = {}
    for i, v in ok:
        if i in ids:
            s = m @ v
            order = [j for j in np.lexsort((names, -np.round(s, 12))) if names[j] != i][:k]
            out[i] = [(int(names[j]), s[j]) for j in order]
    return out


def test_nearest(spark):
    rows = _vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int, score double")
    got = permutation_index.search(df, df.where("vec_id % 20 = 0")).collect()
    want = brute_nearest(rows, set(range(0, 1500, 20)), 20)
    mine: dict = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        mine.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(mine) == set(want)
    assert all(len(v) == 20 for v in mine.values())
    recall = np.mean([len({x for x, _ in mine[q]} & {x for x, _ in want[q]}) / 20 for q in want])
    assert recall >= 0.9
    vec = {i: np.array(v) for i, v, *_ in rows if i in mine or v is not None}
    assert all(abs(s - vec[q] @ vec[x]) < 1e-9 for q, found in mine.items() for x, s in found)
    tied = {i for i in range(100, 400)}
    assert [x for x, _ in mine[120]] == [x for x, _ in want[120]]
    assert {x for x, _ in mine[120]} <= tied


@pytest.mark.parametrize("spread", [0.0, 0.5])
def test_nearest_in_clusters(spark, spread):
    """Clustered vectors, of unit length and of unequal lengths, with the shipped parameters."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((20, 64))
    v = centres[rng.integers(0, 20, 3000)] / 8 + rng.standard_normal((3000, 64)) / 16
    v *= (np.exp(spread * rng.standard_normal(3000)) / np.linalg.norm(v, axis=1))[:, None]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    mine: dict = {}
    for r in permutation_index.search(df, df.where("vec_id % 20 = 0")).collect():
        mine.setdefault(r.query_id, set()).add(r.vec_id)
    want = brute_nearest(rows, set(range(0, 3000, 20)), 20)
    recall = [len(mine[q] & {x for x, _ in want[q]}) / 20 for q in want]
    assert np.mean(recall) >= 0.99
    assert min(recall) >= 0.9


def test_few_or_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [0.5, 1.0]), (2, [1.0, 1.0]), (None, [1.0, 1.0]), (3, [9.0, 9.0, 9.0]), (4, [])], "vec_id long, embedding array<float>")
    got = permutation_index.search(df, df.where("vec_id = 0")).collect()
    assert [(r["rank"], r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 2, 1.0), (2, 1, 0.5)]
    assert permutation_index.search(df.where("false"), df.where("false")).count() == 0
    assert permutation_index.search(df, df.where("false")).count() == 0


def test_nearest_of_repeated_ids_copies_and_odd_lengths(spark):
    """Rows and ids that repeat, copies on both sides, and lengths whose squares are beyond the range of doubles."""
    v = [[1.0, 2.0], [1.0, 2.0], [2.0, 1.0], [3.0, 0.5], [1.0, 2.0], [0.5, 0.5]]
    rows = [(0, v[0]), (0, v[0]), (0, v[2]), (5, v[1]), (5, v[3]), (7, v[4]), (7, v[4]), (9, v[5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in permutation_index.search(df, df.where("vec_id in (0, 5)"), k=2).collect()}
    best = lambda q, x: max(np.dot(a, b) for i, a in rows for j, b in rows if i == q and j == x)
    want = {(q, n + 1): (x, best(q, x)) for q in (0, 5) for n, x in enumerate(sorted({0, 5, 7, 9} - {q}, key=lambda x: (-best(q, x), x))[:2])}
    assert got == want
    far = spark.createDataFrame([(i, [x * s for x in r]) for i, (r, s) in enumerate(zip(v[2:], (1e200, 1e-200, 1.0, 1e150), strict=True))], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in sorted(permutation_index.search(far, far.where("vec_id = 2")).collect(), key=lambda r: r["rank"])] == [0, 3, 1]


@pytest.mark.parametrize("block", [8192, 100])
def test_ties_go_to_the_smaller_id_wherever_they_are(spark, monkeypatch, block):
    """Vectors that differ, but not for any query: their scores are the same to the last bit, in every block of a file."""
    monkeypatch.setattr(permutation_index, "BLOCK", block)
    rng = np.random.default_rng(1)
    v = rng.standard_normal((2000, 33))
    v[::20, 20:] = 0  # queries
    alike = [i for i in range(500, 1500) if i % 20]
    v[alike, :20] = v[0, :20]
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    got = permutation_index.search(df, df.where("vec_id = 0"), k=20, files=16, probed=16).collect()
    assert len({r.score for r in got if r.vec_id in alike}) == 1
    got = [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.vec_id in alike]
    assert got == sorted(got)


def test_few_are_reranked(spark, tmp_path):
    """The share that is reranked falls as the table grows, and recall stays."""
    rng = np.random.default_rng(2)
    shares = []
    for n in (4000, 16_000):
        v = rng.standard_normal((n, 24)).astype(np.float32)
        path = f"{tmp_path}/{n}"
        spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, vec array<float>").write.parquet(path)
        base = spark.read.parquet(path)
        asked = base.where("id % 100 = 0")
        scored = permutation_index._found(base, asked, 24, 20, permutation_index.PIVOTS, None, None)[0].groupBy("query").sum("scored").collect()
        assert len(scored) == n // 100
        shares.append(np.mean([r[1] for r in scored]) / n)
        mine: dict = {}
        for r in permutation_index.search(base, asked, id_col="id", vec_col="vec").collect():
            mine.setdefault(r.query_id, set()).add(r.vec_id)
        want = brute_nearest([(i, x.astype(float).tolist()) for i, x in enumerate(v)], set(range(0, n, 100)), 20)
        assert np.mean([len(mine[q] & {x for x, _ in want[q]}) / 20 for q in want]) >= 0.9
    assert shares[1] < shares[0] / 2


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a = "</p><p>no</p>";</script></head><body class="b3">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav><div class="ad-box">Buy <b>now</b></div>
<article class="post-17"><header><h1>Head &amp; line</h1></header><p>First <b>para
 graph<br>goes&nbsp;on<p>Second&#33; <a href="x">link</a><ul><li>one<li>two</ul><form><input>Name</form>
<div class="comments"><p>reader says</p></div><p hidden>not seen</p></article><aside>side</aside><footer>&copy; 2024</footer>"""
TEXT = "Head & line\nFirst para graph goes on\nSecond! link\none\ntwo"


def test_pages(spark):
    rows = [(1, "http://a.example/1", PAGE), (2, "http://a.example/2", PAGE.replace("post-17", "post-9")), (3, "http://b.example/", "<div><p>a<p>b</div>c"), (4, None, None), (5, "x", ""), (1, "http://a.example/1", PAGE), (None, "http://a.example/3", "<p>cut off <")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    texts = sorted(((r.page_id or 0), r.text) for r in got)
    assert texts == [(0, "cut off <"), (1, TEXT), (1, TEXT), (2, TEXT), (3, "a\nb\nc"), (4, ""), (5, "")]
    assert {r.path for r in got if r.page_id in (1, 2)} == {"body.b>article.post-"}
    assert html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").where("false")).count() == 0


def test_hosts_outvote_a_page(spark):
    """A page whose comments are longer than its article is read where its host's articles are."""
    good = "<body><div class='story'><p>" + "good words here. " * 20 + "</p></div><div class='replies2'><p>reply</p></div></body>"
    odd = "<body><div class='story'><p>short story</p></div><div class='chat'><p>" + "chatter " * 200 + "</p></div></body>"
    rows = [(i, f"http://h.example/{i}", good) for i in range(5)] + [(9, "http://h.example/9", odd)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == "short story"
    assert got[0] == ("good words here. " * 20).strip()


def test_nothing_of_a_wrapped_article_is_dropped(spark):
    body = "<div class=body><p>" + "long text. " * 40 + "</p></div>"
    article = f"<body><div class=menu2><a href=x>Home</a></div><article><h1>Title</h1><div class=lead>Lead</div>{body}<section><h2>More</h2><p>Last</p></section></article><p>outside</p>"
    main = f"<body><main><h1>Title</h1>{body}<div class=cards><a href=x>Other story</a></div><section>Last</section></main><p>outside</p>"
    rows = [(1, "http://a.example/", article), (2, "http://b.example/", main)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    text = ("long text. " * 40).strip()
    assert got == {1: f"Title\nLead\n{text}\nMore\nLast", 2: f"Title\n{text}\nLast"}


def test_words_in_class_or_id_do_not_drop_an_article(spark):
    pages = {
        '<article><div class="post social-share"><p>Real article</p></div></article>': "Real article",
        '<body><div class="widget-area main-content"><p>Text</p></div></body>': "Text",
        '<article><p>One</p><p id="post-comment-rules">Two</p></article>': "One\nTwo",
        '<body><form id="f"><div><h1>T</h1><p>all of the page</p></div></form></body>': "T\nall of the page",
        "<body><article><p>short</p><div class=comments><p>" + "chat " * 300 + "</p></div></article></body>": "short",
        "<body><article><p>s</p></article><footer>" + "long " * 50 + "</footer></body>": "s",
        "<body><aside><article><p>teaser</p></article></aside><main><p>the longer main part</p><div class='ad-box'>buy</div></main></body>": "the longer main part",
        "<div class=sidebar-layout><article><p>in a wrapper</p></article></div>": "in a wrapper",
    }
    rows = [(i, f"http://h{i}.example/", x) for i, x in enumerate(pages)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == dict(enumerate(pages.values()))


def test_a_host_agrees_about_noise(spark):
    """One page's box takes most of its article; the pages of the host where it does not decide."""
    page = "<article><p>%s</p><div class=box-widget><p>%s</p></div></article>"
    rows = [(i, f"http://h.example/{i}", page % ("article " * 40, "see more")) for i in range(4)] + [(9, "http://h.example/9", page % ("brief", "see " * 60))]
    rows += [(20 + i, f"http://other.example/{i}", page % ("brief", "all of the article " * 9)) for i in range(3)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == ("article " * 40).strip()
    assert got[9] == "brief"
    assert got[20].startswith("brief\nall of the article")


def test_made_pages_give_what_they_were_made_of(spark):
    """Pages put together from a known article, with other parts around and within it, under each host's own class names."""
    rnd = random.Random(5)
    say = lambda n: " ".join(rnd.choice("lorem ipsum dolor sit amet & consetetur <sadipscing> elitr".split()) for _ in range(n))
    show = lambda t: t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&#62;")
    rows, want = [], {}
    for i in range(120):
        host = i % 4
        blocks = [say(rnd.randint(1, 40)) for _ in range(rnd.randint(1, 9))]
        inner = "".join(f"<p class=t{rnd.randint(1, 9)}>{show(b)}\n" + rnd.choice(["</p>", ""]) for b in blocks)
        for part in ("div class=share-bar", "ul class=social", "div id=comments", "div class='ad ad-3'", "aside", "form"):
            if rnd.random() < 0.4:
                inner += f"<{part}><p>{show(say(rnd.randint(1, 5)))}</p></{part.split()[0]}>"
        body = [f"<article class=a{i}>{inner}</article>", f"<main><div class=c{i}>{inner}</div></main>", f"<div class='content x{i}'>{inner}</div>", f"<form><section class=story>{inner}</section></form>"][host]
        around = lambda tag: f"<{tag}><a href=/>{show(say(3))}</a></{tag}>"
        html = f"<html><head><title>{show(say(3))}</title><script>if (a<b) '</p>'</script></head><body>{around('header')}{around('nav')}{body}{around('footer')}"
        rows.append((i, f"https://h{host}.example/{i}", html, "x", 1))
        want[i] = "\n".join(" ".join(b.split()) for b in blocks)
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, path int")
    got = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    assert got == want


def test_long_and_deep_pages(spark):
    """Half a megabyte of nested or unclosed tags, and a text of millions of characters."""
    deep = ["<div class=a>" * 40_000 + "x", "<b>" * 50_000 + "<article>" + "<i>y</b>" * 40_000, "<form><aside>" * 30_000 + "z", "<li>a" * 60_000, "<p>" + "long words " * 400_000]
    began = time.perf_counter()
    rows = [(i, "http://a.example/", x) for i, x in enumerate(deep)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert time.perf_counter() - began < 60
    assert got[0] == "x"
    assert got[1] == "y" * 40_000
    assert got[3] == "\n".join("a" * 60_000)
    assert got[4] == ("long words " * 400_000).strip()


def test_markup_noise_never_raises():
    rnd = random.Random(0)
    bits = ["<p>", "</p>", "<div class=x>", "</div>", "text ", "&amp", "&lt;", "<!--", "-->", "<script>", "</script>", "<", ">", "</", "<a href='", "'>", "<li>", "<table><tr><td>", "</article>", "<article>", "\x00", "<![CDATA[", "]]>", "<br/>", "<P CLASS=AD>"]
    for _ in range(500):
        page = html_extract.parse("".join(rnd.choice(bits) for _ in range(rnd.randint(0, 40))))
        html_extract.text_of(page)
