"""Byte-level BPE encoding by prefix-sharing trie traversal, and decoding.

The last token of the encoding of a text's prefix determines that encoding: with the last token
``t`` of the prefix that ends at ``i``, what precedes ``t`` is the encoding of the prefix that ends
at ``i - len(t)``.  And ``t`` is the one vocabulary token that ends there and is *compatible* with the
last token of the prefix before it: merging the two tokens' bytes by rank gives back the two tokens.  So
a word is encoded by filling in one last token per byte, and two words that begin alike share what
they begin with.

A task collects its distinct pre-tokens, sorts them, which is the depth-first order of the trie of
them, and keeps the last tokens along the current path: only bytes beyond the prefix shared with
the word before are worked on.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, mapped, pieces, release

# The pattern that splits texts into pre-tokens, as the vocabulary was made with it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of the characters below, in the faster re module.
_QUICK = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Characters on whose classes the two modules might differ.
_ODD = re.compile(r"[\x1c-\x1f\x85\xb2\xb3\xb9\xbc-\xbe]|[^\x00-ɏ‐-‧€]")
#: Distinct pre-tokens that a worker remembers in each of two generations: when the younger is full, it
#: takes the older one's place, and what is met again moves back into the younger.
CACHE_WORDS = 150_000
#: Pairs of tokens whose compatibility a task remembers.
CACHE_PAIRS = 250_000
#: Depth at which branches of the trie are remembered from one traversal to the next, and how many of them.
STEM, CACHE_STEMS = 5, 60_000


def byte_characters() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable Latin-1 characters are
    themselves, the other bytes follow from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merge ranks and special tokens of a byte-level BPE file (``tokenizers`` JSON)."""

    def __init__(self, content: str):
        data = json.loads(content)
        model = data["model"]
        as_byte = byte_characters()
        raw = lambda t: bytes(as_byte[c] for c in t)
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.ids = {raw(t): i for t, i in model["vocab"].items() if t not in self.special}
        self.bytes_of = {i: b for b, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.longest = max(map(len, self.ids))
        #: Rank and result of each mergeable pair, and the pair that made each token.
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b = self.ids[raw(left)], self.ids[raw(right)]
            made = self.ids[raw(left) + raw(right)]
            self.merges[a, b] = (rank, made)
            self.halves.setdefault(made, (a, b))
        self._canonical: dict[int, bool] = {}
        self._pairs: dict[tuple[int, int], bool] = {}
        self.stems: dict[bytes, tuple[int, ...]] = {}
        self.length = [len(self.bytes_of.get(i, b"")) for i in range(max(self.bytes_of) + 1)]
        self.splitter = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        #: For three bytes, the lengths of the tokens that end with them or a part of them, longest first.
        self.endings: dict[bytes, tuple[int, ...]] = {}
        ends: dict[bytes, set[int]] = {}
        for token in self.ids:
            if len(token) > 2:
                ends.setdefault(token[-3:], set()).add(len(token))
        for tail, own in ends.items():
            self.endings[tail] = (*sorted(own, reverse=True), *self._short(tail))

    def _short(self, tail: bytes) -> tuple[int, ...]:
        return (2, 1) if tail[-2:] in self.ids and len(tail) > 1 else (1,)

    def merge(self, raw: bytes) -> list[int]:
        """Merging by rank, lowest first and leftmost among equals: the definition of BPE."""
        ids = [self.ids[raw[i : i + 1]] for i in range(len(raw))]
        while len(ids) > 1:
            best = min(((self.merges[p][0], i) for i in range(len(ids) - 1) if (p := (ids[i], ids[i + 1])) in self.merges), default=None)
            if best is None:
                break
            i = best[1]
            ids[i : i + 2] = [self.merges[ids[i], ids[i + 1]][1]]
        return ids

    def canonical(self, token: int) -> bool:
        """Whether merging the token's bytes gives the token."""
        if token not in self._canonical:
            self._canonical[token] = self.merge(self.bytes_of[token]) == [token]
        return self._canonical[token]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens gives these two tokens."""
        found = self._pairs.get((left, right))
        if found is None:
            if len(self._pairs) >= CACHE_PAIRS:
                self._pairs.clear()
            found = self._pairs[left, right] = self._stays_apart(left, right)
        return found

    def _stays_apart(self, left: int, right: int) -> bool:
        """Undo the later of the two tokens' merges step by step, and look whether a merge across the
        border would have come first.

        A merge across the border happens if, at some moment, the last part on the left and the first
        part on the right can merge at a rank before both of the merges that would next consume them.
        """
        never = len(self.merges)
        # The next merge that consumes each of the two bordering parts.
        left_use = right_use = never
        while True:
            across = self.merges.get((left, right))
            # On the left a merge at an equal rank comes first; on the right the one across does.
            if across is not None and across[0] < left_use and across[0] <= right_use:
                return False
            a = self.merges[self.halves[left]][0] if left in self.halves else -1
            b = self.merges[self.halves[right]][0] if right in self.halves else -1
            if a < 0 and b < 0:
                return True
            # The part made last is undone first.
            if a > b:  # of two equal merges the right one is made last
                left_use, left = a, self.halves[left][1]
            else:
                right_use, right = b, self.halves[right][0]

    def encode_sorted(self, words: Iterable[bytes]) -> Iterator[list[int]]:
        """Encodings of sorted distinct words, sharing the work on common prefixes."""
        ids, endings, pairs, stems, length = self.ids, self.endings, self._pairs, self.stems, self.length
        compatible, canonical = self.compatible, self.canonical
        last: list[int] = []  # last token of the prefix that ends after each byte of the path
        push = last.append
        before = b""
        for word in words:
            total = len(word)
            shared, most = 0, min(len(before), total)
            if before[:most] == word[:most]:
                shared = most
            else:
                while before[shared] == word[shared]:
                    shared += 1
            fresh = None
            if shared < STEM <= total:
                # A branch of the trie that an earlier traversal has been in is taken up from there.
                fresh = word[:STEM]
                known = stems.get(fresh)
                if known is not None:
                    last[:] = known
                    shared, fresh = STEM, None
            del last[shared:]
            for end in range(shared + 1, total + 1):
                tail = word[end - 3 if end > 3 else 0 : end]
                sizes = endings.get(tail)
                if sizes is None:
                    sizes = endings[tail] = self._short(tail)
                for n in sizes:
                    if n < end:
                        token = ids.get(word[end - n : end])
                        if token is None:
                            continue
                        left = last[end - n - 1]
                        fits = pairs.get((left, token))
                        if fits or (fits is None and compatible(left, token)):
                            push(token)
                            break
                    elif n == end:
                        token = ids.get(word[:end])
                        if token is not None and canonical(token):
                            push(token)
                            break
                else:
                    raise ValueError("the vocabulary lacks a byte")
            if fresh is not None:
                if len(stems) >= CACHE_STEMS:
                    stems.clear()
                stems[fresh] = tuple(last[:STEM])
            out, end = [], total
            while end:
                token = last[end - 1]
                out.append(token)
                end -= length[token]
            out.reverse()
            before = word
            yield out

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


class Encoder:
    """Encodes texts, a batch at a time, remembering the distinct pre-tokens met so far."""

    def __init__(self, vocabulary: Vocabulary, cache_words: int | None = None):
        import regex

        self.vocabulary = vocabulary
        self.cache_words = cache_words or CACHE_WORDS
        self.exact = regex.compile(PATTERN)
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def pretokens(self, text: str) -> list[str]:
        return self.exact.findall(text) if _ODD.search(text) else _QUICK.findall(text)

    def learn(self, words: set[str]) -> None:
        """Have all of ``words`` in the cache."""
        if len(self.cache) + len(words) > self.cache_words:
            self.older, self.cache = self.cache, {}
        cache, older = self.cache, self.older
        words = words.difference(cache)
        known = {w for w in words if w in older}  # not an intersection, which would walk the whole dict
        for word in known:
            cache[word] = older[word]
        new = sorted(words - known)  # strings sort as their UTF-8 does
        for word, ids in zip(new, self.vocabulary.encode_sorted([w.encode() for w in new]), strict=True):
            cache[word] = array("i", ids).tobytes()

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Token ids of each text; null and empty texts have none.  Special tokens' strings are one token."""
        split = []
        for text in texts:
            if self.vocabulary.splitter is not None and text and any(s in text for s in self.vocabulary.special):
                parts = self.vocabulary.splitter.split(text)
                words = []
                for i, part in enumerate(parts):
                    words += [self.vocabulary.special[part]] if i % 2 else self.pretokens(part)
                split.append(words)
            else:
                split.append(self.pretokens(text) if text else [])
        distinct: set = set()
        for words in split:
            distinct.update(words)
        plain = {w for w in distinct if isinstance(w, str)}
        self.learn(plain)
        for w in distinct - plain:
            self.cache[w] = np.array([w], dtype=np.int32).tobytes()
        return [np.frombuffer(b"".join(map(self.cache.__getitem__, words)), dtype=np.int32) for words in split]


_encoders: dict[int, Encoder] = {}


def worker_encoder(content: str, cache_words: int | None = None) -> Encoder:
    """One encoder per Python worker, kept from task to task."""
    key = hash((content, cache_words))
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(Vocabulary(content), cache_words)
        release()  # of what reading the file has left behind
    return _encoders[key]


_ROUND = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])


def tokenizer_content(path: str | None = None) -> str:
    """The vocabulary file, read by the driver; executors get its content (2 MB, fixed)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, token ``ids`` and the text ``decoded`` from them, for every row of ``docs``.

    Null and empty texts have no ids and decode to an empty text; texts of any length are read whole.  Rows are independent of each
    other: ties, repeated rows and null ids come back as they are.  Other columns are never read, whatever their names.
    """
    content = docs.sparkSession.sparkContext.broadcast(tokenizer_content(path))
    schema = arrow_schema(_ROUND)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(content.value)
        for batch in pieces(batches, "text", 3 << 20):
            ids = encoder.encode(batch.column("text").to_pylist())
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
            flat = np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32)
            decoded = [encoder.vocabulary.decode(x.tolist()) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32())).cast(schema.field(1).type),
                    pa.array(decoded, pa.string()),
                ],
                schema=schema,
            )

    return mapped(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), rows, _ROUND)


def digests(docs: DataFrame) -> DataFrame:
    done = round_trip(docs)
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded text of every document."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
