"""Main text of web pages by consensus host paths.

Every page's containers are scored (text in blocks, less the text in links, of the container itself and, at a
discount, of its children).  The best container's generalised path, tags with classes whose digits
are dropped, is the page's vote.  Votes are counted per host in Spark, and every page is extracted again from the
container on its host's winning path; a page without that path uses its own best one.  A container within an
article (or within the page's main part) stands for the whole of it, so headings and sections beside it stay.

What is noise inside is voted on as well.  Menus, scripts and what is hidden never count.  Sidebars, footers, forms and elements
whose class or id names an advert, a notice, comments and the like are only suspected: a page takes them for content if
they hold its longest article or most of the text there is.  Where pages of a host disagree about a path, the majority decides for all.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, mapped, pieces, small_or_hashed, stored

# Element names of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CONTAINERS = frozenset("article body div main section td".split())
#: Elements that never belong to the main text, and those that do not unless they hold it.
_SKIPPED = frozenset("head script style noscript template nav button select option input iframe object svg canvas audio video menu dialog".split())
_SUSPECTED = frozenset("aside footer form header".split())
_MAIN = frozenset("article main".split())
#: What an opening tag closes if it is still open, up to the nearest of the elements after it.
_CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
_CLOSES = {tag: (mine.split(), until.split()) for tag, (mine, until) in _CLOSES.items()}
#: An open paragraph ends before any block, unless one of these has been opened since.
_HOLDS_P = (*sorted(_CONTAINERS), "table", "li")
#: What an end tag of another element does not reach beyond.
_WALLS = ("article", "main", "table")
_THROUGH = frozenset("body html article main section div table".split())
#: Words that mark noise if a name in class or id begins or ends with them, and words of content.
_NOISE = frozenset(
    "ad ads advert advertisement advertising adsense banner breadcrumb breadcrumbs consent cookie cookies footer menu nav navbar navigation newsletter "
    "notice popup share sharing sidebar social subscribe widget".split()
)
#: Of these there can be more on a page than of its article.
_LOUD = frozenset("comment comments commentlist disqus replies related promo promoted promotion sponsor sponsored teaser ad ads advert advertisement".split())
_CONTENT = frozenset("article body content entry main page post story text".split())
#: Share of the text around it that a suspected element has to hold to be content; a loud one needs all of it.
_BULK, _LOUD_BULK = 0.6, 1.0
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?P<closed>>?)|<[!?/][^>]*>?", re.S)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in _RAW}
_MASK = 0xFFFFFFFFFFFFFFFF
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Node:
    """An element that can hold the main text or is suspected noise, or the root."""

    tag: str
    step: str
    parent: int
    name: int  # hash of the path
    skipped: bool
    suspect: float = 0.0  # share of the text around it that would clear it; nothing for no suspicion
    own: int = 0  # characters of text in this node's blocks, other nodes' not counted
    linked: int = 0


@dataclass
class Page:
    nodes: list[Node] = field(default_factory=list)
    #: (node, text) of each block, in page order; skipped text is not listed.
    blocks: list[tuple[int, str]] = field(default_factory=list)

    def path(self, node: int) -> str:
        steps = []
        while node:
            steps.append(self.nodes[node].step)
            node = self.nodes[node].parent
        return ">".join(reversed(steps))


def _cached(size: int):
    """Remembers results for short arguments; long ones are rare and would fill the memory."""

    def around(made: Callable) -> Callable:
        short = lru_cache(size)(made)
        return lambda *args: short(*args) if len(args[-1]) <= 200 else made(*args)

    return around


@_cached(50_000)
def _step_hash(step: str) -> int:
    return int.from_bytes(hashlib.blake2b(step.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def _below(name: int, step: str) -> int:
    """The hash of a path one step longer, as a signed 64-bit number; paths of deep pages are never written out."""
    mixed = ((name & _MASK) * 0x9E3779B97F4A7C15 + _step_hash(step)) & _MASK
    mixed ^= mixed >> 29
    return mixed - (1 << 64) if mixed >> 63 else mixed


def _named(value: str) -> tuple[int, int, bool]:
    """How many names in a class or id are of noise and of content, and whether a noise word is a loud one."""
    noise = content = 0
    loud = False
    for token in value.split():
        parts = [p.lower() for p in _PARTS.findall(token)]
        ends = {parts[0], parts[-1]} if parts else set()
        if ends & _NOISE or ends & _LOUD:
            noise += 1
            loud = loud or bool(ends & _LOUD)
        elif not _CONTENT.isdisjoint(parts):
            content += 1
    return noise, content, loud


@_cached(20_000)
def _attributes(name: str, attrs: str) -> tuple[str, bool, float]:
    """The generalised path step of a tag, whether it is hidden, and the share that clears it of suspicion (0: none)."""
    classes, hidden, noise, content, loud, suspect = "", name in _SKIPPED, 0, 0, False, _BULK if name in _SUSPECTED else 0.0
    if attrs and not attrs.isspace():
        for key, a, b, c in _ATTR.findall(attrs):
            key, value = key.lower(), a or b or c
            if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
                hidden = True
            elif key == "role" and value.lower() in _ROLES:
                suspect = _BULK
            elif key in ("class", "id"):
                more = _named(value)
                noise, content, loud = noise + more[0], content + more[1], loud or more[2]
            if key == "class":
                classes = ".".join(sorted({re.sub(r"\d+", "", x) for x in value.split()} - {""}))
    if noise > content and name not in ("html", "body", "main") and (loud or name != "article"):
        suspect = _LOUD_BULK if loud else _BULK
    return name + ("." + classes if classes else ""), hidden, suspect


def parse(html: str) -> Page:
    """Containers and text blocks of a page; any markup is accepted, in time and memory in proportion to its length."""
    page = Page([Node("", "", 0, 0, False)])
    stack: list[tuple[str, int, bool]] = []  # tag, node it lies in, skipped
    where: defaultdict[str, list[int]] = defaultdict(list)  # depths at which a tag is open
    at, node, skipped = 0, 0, False
    text: list[str] = []
    links = 0

    def last(*names: str) -> int:
        return max((where[n][-1] for n in names if where[n]), default=-1)

    def flush() -> None:
        nonlocal text, links
        if text:
            if not skipped:
                block = " ".join(entities.unescape("".join(text)).split())
                if block:
                    page.nodes[node].own += len(block)
                    page.nodes[node].linked += min(links, len(block))
                    page.blocks.append((node, block))
            text, links = [], 0

    def leave(depth: int) -> None:
        nonlocal node, skipped
        while len(stack) > depth:
            name, node_, skipped_ = stack.pop()
            where[name].pop()
            if name in _BLOCKS or name in _SKIPPED or skipped_ != skipped:
                flush()
            node, skipped = node_, skipped_

    def add(raw: str) -> None:
        nonlocal links
        text.append(raw)
        if where["a"]:
            links += len(raw)

    size = len(html)
    while at < size:
        m = _TOKEN.search(html, at)
        if m is None:
            add(html[at:])
            break
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        if m["cdata"] is not None:
            add(entities.escape(m["cdata"], quote=False))
            continue
        if m["name"] is None:
            continue
        if not m["closed"] and at >= size:
            break  # a tag that the page ends in
        name = m["name"].lower()
        if m["end"]:
            if name == "br":
                text.append(" ")
            elif name == "p" and not where["p"]:
                flush()
            elif where[name] and (name in _THROUGH or where[name][-1] >= last(*_WALLS)):
                leave(where[name][-1])
            continue
        if name in _VOID:
            if name == "hr":
                flush()
            elif name in ("br", "img", "wbr"):
                text.append("" if name == "wbr" else " ")
            continue
        if name in _RAW:
            close = _RAW_END[name].search(html, at)
            raw = html[at : close.start()] if close else html[at:]
            at = close.end() if close else size
            if name == "xmp" and raw:
                add(raw)
            continue
        if name in _BLOCKS and where["p"] and where["p"][-1] > last(*_HOLDS_P):
            leave(where["p"][-1])
        if name in _CLOSES:
            mine, until = _CLOSES[name]
            barrier = last(*until)
            first = min((where[t][k] for t in mine if (k := bisect_right(where[t], barrier)) < len(where[t])), default=None)
            if first is not None:
                leave(first)
        if name in _BLOCKS:
            flush()
        step, hidden, suspect = _attributes(name, m["attrs"])
        if name == "header" and suspect == _BULK and (where["article"] or where["main"]):
            suspect = 0.0  # a page's header is noise, an article's own holds its heading
        if (hidden or suspect) and not skipped:
            flush()
        where[name].append(len(stack))
        stack.append((name, node, skipped))
        if name in _CONTAINERS or (suspect and not hidden and not skipped):
            page.nodes.append(Node(name, step, node, _below(page.nodes[node].name, step), skipped or hidden, suspect))
            node = len(page.nodes) - 1
        skipped = skipped or hidden
    flush()
    return page


def _free(page: Page) -> list[int]:
    """Characters outside links in each node and what lies in it."""
    out = [max(0, n.own - n.linked) for n in page.nodes]
    for i in range(len(out) - 1, 0, -1):
        out[page.nodes[i].parent] += out[i]
    return out


def noisy(page: Page) -> dict[int, bool]:
    """The page's own opinion of each suspected node: noise or content.

    Whatever holds the longest article (or main part) is content, and nothing beside it is; an article that is suspected itself
    is not looked for.  Else it takes most of the text of the article around it, or of a page without one.
    """
    nodes, free = page.nodes, _free(page)
    long = max((i for i, n in enumerate(nodes) if n.tag in _MAIN and not n.suspect and not n.skipped), key=lambda i: (free[i], -i), default=0)
    holds = set()
    i = long
    while i:
        holds.add(i)
        i = nodes[i].parent
    around = [0] * len(nodes)  # nearest article or main part, or the root
    out = {}
    for i, n in enumerate(nodes):
        if i:
            around[i] = n.parent if nodes[n.parent].tag in _MAIN else around[n.parent]
        if n.suspect and not n.skipped:
            beside = long > 0 and not around[i]
            out[i] = i not in holds and (beside or free[i] == 0 or free[i] < n.suspect * free[around[i]])
    return out


def _shut(page: Page, noise: dict[int, bool]) -> list[bool]:
    """Which nodes are noise or lie in it."""
    out = [False] * len(page.nodes)
    for i, n in enumerate(page.nodes):
        out[i] = n.skipped or noise.get(i, False) or (i > 0 and out[n.parent])
    return out


def scores(page: Page, shut: list[bool]) -> list[float]:
    """A score for each node: its blocks' text outside links, and half of its child nodes' scores."""
    out = [0.0 if x else max(0.0, n.own - 2.0 * n.linked) for n, x in zip(page.nodes, shut, strict=True)]
    for i in range(len(out) - 1, 0, -1):
        out[page.nodes[i].parent] += 0.5 * out[i]
    main = [False] * len(out)  # an article, or a section within one
    for i, n in enumerate(page.nodes):
        main[i] = n.tag in _MAIN or main[n.parent]
        if main[i]:
            out[i] *= 1.5
    return out


def best(page: Page, shut: list[bool]) -> int:
    s = scores(page, shut)
    return max(range(len(s)), key=lambda i: (s[i], -i))


def opinion(page: Page) -> tuple[int, dict[int, bool]]:
    """What a page votes for: its best node, and noise or content for each suspected path (noise, if its nodes differ)."""
    noise = noisy(page)
    parts: dict[int, bool] = {}
    for i, x in noise.items():
        parts[page.nodes[i].name] = parts.get(page.nodes[i].name, False) or x
    return best(page, _shut(page, noise)), parts


def text_of(page: Page, winner: int | None = None, parts: dict[int, bool] | None = None) -> str:
    """The blocks of the articles around the nodes on the path with hash ``winner`` (the best node, if there is none).

    ``parts`` overrules the page's opinion on paths.  Without an article it is the main part, less containers beside the
    winner that are mostly links; without that, the container.
    """
    nodes, noise = page.nodes, noisy(page)
    if parts:
        noise = {i: parts.get(nodes[i].name, x) for i, x in noise.items()}
    shut = _shut(page, noise)
    chosen = {i for i, n in enumerate(nodes) if winner is not None and n.name == winner and i and not shut[i]} or {best(page, shut)}
    article, main = [0] * len(nodes), [0] * len(nodes)  # nearest such node around, itself included
    for i, n in enumerate(nodes):
        if i:
            article[i] = i if n.tag == "article" else article[n.parent]
            main[i] = i if n.tag == "main" else main[n.parent]
    inside, wide, between = set(), set(), set()
    for i in chosen:
        if article[i]:
            inside.add(article[i])
        elif main[i]:
            wide.add(main[i])
            while i != main[i] and i not in between:
                between.add(i)
                i = nodes[i].parent
        else:
            inside.add(i)
    for i, n in enumerate(nodes):
        if not i or shut[i]:
            continue
        if n.parent in inside:
            inside.add(i)
        elif n.parent in wide and (i in between or 2 * n.linked <= n.own):
            wide.add(i)
    inside |= wide
    return "\n".join(b for i, b in page.blocks if i in inside and not shut[i])


_VOTE = T.StructType([T.StructField("host", T.StringType()), T.StructField("name", T.LongType()), T.StructField("path", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("noise", T.BooleanType())])


def host_of(url: str):
    """The lower-cased host of a URL; nothing for a URL without one."""
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``path`` (the host's winning one, null without votes) of every page.

    White space within a block becomes one space, blocks are joined by ``\\n`` in page order.  Null and
    empty pages have an empty text.  Pages without a host vote with each other.  Votes are ordered by
    number, then summed score, then path, so ties are settled alike everywhere; a tie about noise says noise.  Repeated rows and
    null ids are kept.  Long and deeply nested pages take time and memory in proportion to their length.  Other columns are never
    read, whatever their names.
    """
    own = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html")).withColumn("host", host_of("url"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html"):
            rows = []
            for host, raw in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                if raw:
                    page = parse(raw)
                    i, parts = opinion(page)
                    if i and page.nodes[i].own:
                        rows.append((host, page.nodes[i].name, page.path(i), float(page.nodes[i].own), None))
                    rows += [(host, name, None, 0.0, noise) for name, noise in parts.items()]
            columns = list(zip(*rows, strict=True)) or [[]] * len(_VOTE)
            yield pa.RecordBatch.from_pydict(dict(zip(_VOTE.names, columns, strict=True)), schema=arrow_schema(_VOTE))

    # A hot host's votes are summed before they are shuffled.
    votes = stored(
        mapped(own.select("host", "html"), vote, _VOTE)
        .groupBy("host", "name")
        .agg(F.count("path").alias("n"), F.sum("score").alias("score"), F.min("path").alias("path"), F.count_if("noise").alias("noise"), F.count_if(~F.col("noise")).alias("content")),
        "html-votes",
    )
    # The largest count, then score, then path.  Of noise only what is disputed: pages agree on all else by themselves.
    disputed = F.when((F.col("noise") > 0) & (F.col("content") > 0), F.struct("name", (F.col("noise") >= F.col("content")).alias("noise")))
    winner = F.max(F.when(F.col("n") > 0, F.struct("n", F.round("score").alias("score"), "path", "name")))
    hosts = stored(votes.groupBy("host").agg(winner.alias("w"), F.collect_list(disputed).alias("parts")).select("host", F.col("w.path").alias("path"), F.col("w.name").alias("name"), "parts"), "html-winners")
    schema = T.StructType([own.schema["page_id"], T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("path", T.StringType())])
    out_schema = arrow_schema(schema)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html"):
            made = [
                text_of(parse(raw), name, {p["name"]: p["noise"] for p in parts or ()}) if raw else ""
                for raw, name, parts in zip(batch.column("html").to_pylist(), batch.column("name").to_pylist(), batch.column("parts").to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id").cast(out_schema.field(0).type), batch.column("url"), pa.array(made, pa.string()), batch.column("path")], schema=out_schema
            )

    # A row of hosts is as wide as its path and disputes, of which the largest counts for all.
    width = hosts.agg(F.max(F.octet_length("path") + 9 * F.size("parts"))).first()[0] or 0
    joined = own.join(small_or_hashed(hosts, 64 + width), "host", "left").select("page_id", "url", "html", "path", "name", "parts")
    return mapped(joined, again, schema)


def op9_html_extract(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    out = extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
