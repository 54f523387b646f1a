"""Edit-aware token counts.

A document is kept as a segment tree over its pre-tokens: leaves hold runs of pre-tokens, inner nodes
the sums of characters and tokens below them.  An edit is located through the character sums; the text
is split into pre-tokens again from one pre-token before the edit until the new
boundaries meet the old ones beyond it, only those pre-tokens are encoded again, and the sums
on the paths to the root are updated.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import Encoder, tokenizer_content, worker_encoder
from .common import arrow_schema, mapped, pieces

#: Pre-tokens of a leaf: at first, and at most (a fuller leaf makes the tree be built anew).
LEAF, FULL_LEAF = 64, 512
#: Characters looked at beyond an edit before boundaries are compared; doubled until they meet.
AHEAD = 64
#: Distinct pre-tokens that a worker remembers per generation; there is no other state to hold here.
CACHE_WORDS = 350_000


class Counter:
    """Token counts of pre-tokens by an encoder, and the pre-tokens of a text."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder
        self.special = encoder.vocabulary.special

    def split(self, text: str) -> list[str]:
        splitter = self.encoder.vocabulary.splitter
        if splitter is None or not any(s in text for s in self.special):
            return self.encoder.pretokens(text)
        out: list[str] = []
        for i, part in enumerate(splitter.split(text)):
            out += [part] if i % 2 else self.encoder.pretokens(part)
        return out

    def _sizes(self, distinct: set[str]) -> dict[str, int]:
        """Tokens of each of some pre-tokens; a special token's string is one."""
        plain = distinct.difference(self.special)
        self.encoder.learn(plain)
        cache = self.encoder.cache
        sizes = {w: len(cache[w]) >> 2 for w in plain}
        for w in distinct - plain:
            sizes[w] = 1
        return sizes

    def counts(self, words: list[str]) -> list[int]:
        return list(map(self._sizes(set(words)).__getitem__, words))

    def trees(self, texts: list[str]) -> list[TokenTree]:
        """Trees of many texts; their distinct pre-tokens are encoded in one traversal."""
        split = [self.split(t) for t in texts]
        distinct: set[str] = set()
        for words in split:
            distinct.update(words)
        size = self._sizes(distinct).__getitem__
        return [TokenTree(words, list(map(size, words)), self) for words in split]


class TokenTree:
    """The segment tree of one document."""

    def __init__(self, words: list[str], counts: list[int], counter: Counter):
        self.counter = counter
        self.reencoded = 0
        self._build(words, counts)

    def _build(self, words: list[str], counts: list[int]) -> None:
        self.leaves = [(words[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, len(words), LEAF)] or [([], [])]
        self.width = 1
        while self.width < len(self.leaves):
            self.width *= 2
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for i, (w, c) in enumerate(self.leaves):
            self.chars[self.width + i], self.tokens[self.width + i] = sum(map(len, w)), sum(c)
        for i in range(self.width - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def _set(self, leaf: int, words: list[str], counts: list[int]) -> None:
        self.leaves[leaf] = (words, counts)
        i = self.width + leaf
        self.chars[i], self.tokens[i] = sum(map(len, words)), sum(counts)
        while i > 1:
            i //= 2
            self._sum(i)

    @property
    def count(self) -> int:
        return self.tokens[1]

    @property
    def length(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join(w for words, _ in self.leaves for w in words)

    def _locate(self, at: int) -> tuple[int, int, int]:
        """Leaf and number of the pre-token that holds character ``at``, and where it begins."""
        i, begin = 1, 0
        while i < self.width:
            i *= 2
            if at >= begin + self.chars[i] and begin + self.chars[i] < self.chars[1]:
                begin += self.chars[i]
                i += 1
        leaf = min(i - self.width, len(self.leaves) - 1)
        words = self.leaves[leaf][0]
        for k, w in enumerate(words):
            if at < begin + len(w) or k == len(words) - 1:
                return leaf, k, begin
            begin += len(w)
        return leaf, 0, begin

    def _before(self, leaf: int, k: int) -> tuple[int, int] | None:
        if k:
            return leaf, k - 1
        leaf -= 1
        while leaf >= 0 and not self.leaves[leaf][0]:
            leaf -= 1
        return (leaf, len(self.leaves[leaf][0]) - 1) if leaf >= 0 else None

    def edit(self, start: int, removed: int, inserted: str) -> int:
        """Replace ``removed`` characters from ``start`` on by ``inserted``; returns the new count.

        A start beyond the end appends; what would be removed beyond the end is not there.
        """
        start = max(0, min(start, self.length))
        removed = max(0, min(removed, self.length - start))
        if not removed and not inserted:
            return self.count
        leaf, k, begin = self._locate(start)
        # Splitting looks back no further than where a pre-token begins, but an edit can join what it
        # touches to the pre-token before, and white space looks ahead: so two are taken back.  A special
        # token's string may be made of several pre-tokens, of as many characters as it is long.
        back = max((len(s) for s in self.counter.special), default=0)
        steps = 0
        while (steps < 2 or start - begin < back) and (p := self._before(leaf, k)) is not None:
            leaf, k = p
            begin -= len(self.leaves[leaf][0][k])
            steps += 1
        # What follows, until old and new boundaries meet.
        need = AHEAD
        while True:
            old, ends, at, n = [], [], begin, 0
            i, j = leaf, k
            while i < len(self.leaves) and at < start + removed + need:
                words = self.leaves[i][0]
                while j < len(words) and at < start + removed + need:
                    old.append(words[j])
                    at += len(words[j])
                    ends.append(at)
                    j += 1
                if j >= len(words):
                    i, j = i + 1, 0
            whole = at >= self.length
            joined = "".join(old)
            new = self.counter.split(joined[: start - begin] + inserted + joined[start - begin + removed :])
            shift = len(inserted) - removed
            if whole:
                n_old, n_new = len(old), len(new)
                break
            # The last pre-tokens of the region are uncertain, as the text is cut off behind them.
            places, pos, met = {e: x + 1 for x, e in enumerate(ends) if start + removed + back < e <= at - max(AHEAD // 2, back)}, begin, None
            for x, w in enumerate(new):
                pos += len(w)
                if pos - shift in places and x + 1 < len(new) and self._same_after(new, x, old, places[pos - shift]):
                    met = (places[pos - shift], x + 1)
                    break
            if met:
                n_old, n_new = met
                break
            need *= 2
        words = new[:n_new]
        counts = self.counter.counts(words)
        self.reencoded += len(words)
        # The new pre-tokens take the old ones' places: all into the first leaf, the rest is cut.
        head_words, head_counts = self.leaves[leaf]
        left = n_old
        i, j = leaf, k
        first = True
        while left or first:
            own_words, own_counts = self.leaves[i]
            take = min(left, len(own_words) - j)
            left -= take
            if first:
                self._set(i, [*head_words[:j], *words, *own_words[j + take :]], [*head_counts[:j], *counts, *own_counts[j + take :]])
                first = False
            else:
                self._set(i, own_words[take:], own_counts[take:])
            i, j = i + 1, 0
        if len(self.leaves[leaf][0]) > FULL_LEAF:
            self._build([w for words_, _ in self.leaves for w in words_], [c for _, counts_ in self.leaves for c in counts_])
        return self.count

    def _same_after(self, new: list[str], x: int, old: list[str], y: int) -> bool:
        """Whether both go on with the same pre-tokens (two of them are enough to be in step)."""
        return new[x + 1 : x + 3] == old[y : y + 2]


_EDIT = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("removed", T.IntegerType()), T.StructField("inserted", T.StringType())]))
_OUT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("counts", T.ArrayType(T.LongType())),
        T.StructField("n_pretokens", T.LongType()),
        T.StructField("n_reencoded", T.LongType()),
        T.StructField("edited", T.StringType()),
    ]
)


def count_with_edits(docs: DataFrame, edits_col: str = "edits", path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token counts of every row before (``n_tokens``) and after each of its edits (``counts``).

    ``edits_col`` is an array of (start, removed, inserted), applied one after the other, offsets in
    code points of the text at that time; null or empty: no edits.  Null fields count as 0 and an empty string.
    ``n_reencoded`` is how many pre-tokens the edits had encoded again, ``edited`` the final text.
    Null texts are empty, and texts of any length are read whole.  Rows are independent: repeated rows and null ids come back as
    they are.  Other columns are never read, whatever their names.
    """
    content = docs.sparkSession.sparkContext.broadcast(tokenizer_content(path))
    schema = arrow_schema(_OUT)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(worker_encoder(content.value, CACHE_WORDS))
        for batch in pieces(batches, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            out: dict[str, list] = {f: [] for f in _OUT.names[1:]}
            for text, tree, edits in zip(texts, counter.trees(texts), batch.column("edits").to_pylist(), strict=True):
                out["n_tokens"].append(tree.count)
                out["n_pretokens"].append(sum(len(w) for w, _ in tree.leaves))
                out["counts"].append([tree.edit(e["start"] or 0, e["removed"] or 0, e["inserted"] or "") for e in edits or [] if e is not None])
                out["n_reencoded"].append(tree.reencoded)
                out["edited"].append(tree.text() if edits else text)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(out[f.name], f.type) for f in list(schema)[1:]]], schema=schema)

    return mapped(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(edits_col).cast(_EDIT).alias("edits")), rows, _OUT)


def revisions(text: str = "text"):
    """Three revisions of a document: a note put into the middle, a removal after a third, an addition at the end."""
    n = F.coalesce(F.length(text), F.lit(0))
    edit = lambda a, b, c: F.struct(a.cast("int").alias("start"), F.lit(b).cast("int").alias("removed"), F.lit(c).alias("inserted"))
    return F.array(edit(F.floor(n / 2), 0, " [revised]"), edit(F.floor(n / 3), 12, ""), edit(n + 100, 0, "\nAdded later."))


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after three revisions."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").withColumn("edits", revisions())
    out = count_with_edits(docs)
    return out.select(
        "doc_id",
        "n_tokens",
        *[F.get("counts", F.lit(i)).alias(f"n_tokens_{i + 1}") for i in range(3)],
        "n_pretokens",
        "n_reencoded",
        F.sha2("edited", 256).alias("edited_sha256"),
    )
