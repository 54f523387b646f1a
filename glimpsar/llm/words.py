"""Vectorised word and shingle kernel shared by the text operators of this subpackage.

A *word* is a maximal run of the characters ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are
lower-cased: digits, ASCII letters and everything beyond ASCII.  In UTF-8 every byte of a character
beyond ASCII is 0x80 or more, so one byte translation finds exactly the same words as the character
class does, and numpy can work on whole batches of documents without a Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: A-Z to a-z, every other byte that is no part of a word to a space.
WORD_BYTES = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in _LOWER)

_MASK = 0xFFFFFFFFFFFFFFFF


def splitmix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers (Steele, Lea and Flood's SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def odd_constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit multipliers, the same on every machine."""
    return splitmix(np.arange(n, dtype=np.uint64) + np.uint64((seed * 0x1000003) & _MASK)) | np.uint64(1)


_BYTE = odd_constants(256, 11)
_BYTE[0x20] = 0  # spaces add nothing, so a word's sum may run on to the next word's start
_POWERS = 4096
_PLACE = odd_constants(_POWERS, 12)


def words_of(text: str | None) -> list[bytes]:
    """The words of one text, in order, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


def chunks(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items whose sizes add up to about ``limit`` (one item at least)."""
    lo, total = 0, 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > limit:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


def hash_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of ``texts`` in order, and where each text's words begin.

    The second array has ``len(texts) + 1`` entries.  Words are hashed by position-weighted byte sums
    followed by a finaliser; everything is numpy, so 1 MB takes a few milliseconds.
    """
    flat = np.frombuffer(b" ".join([b"", *texts, b""]).translate(WORD_BYTES), dtype=np.uint8)
    inside = flat != 0x20
    starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    edges = np.concatenate([[1], 1 + np.cumsum(lengths)])
    bounds = np.searchsorted(starts, edges)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), bounds
    place = np.arange(len(flat) - starts[0], dtype=np.int64)
    place -= np.repeat(starts - starts[0], np.diff(np.append(starts, len(flat))))
    value = _BYTE[flat[starts[0] :]]
    value *= _PLACE[place & (_POWERS - 1)]
    beyond = np.flatnonzero(place >= _POWERS)  # of words longer than that, each further stretch has weights of its own
    if len(beyond):
        far = place[beyond] >> 12
        value[beyond] *= splitmix(far.astype(np.uint64)) | np.uint64(1)
    return splitmix(np.add.reduceat(value, starts - starts[0])), bounds


def shingles(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` consecutive words of each text, and where each text's begin.

    A text with fewer words, but not none, has one shingle of all its words; one without words has
    none.  Shingles repeat if their words do.
    """
    words, bounds = hash_words(texts)
    counts = np.diff(bounds)
    made = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    out_bounds = np.concatenate([[0], np.cumsum(made)])
    owner_start = np.repeat(bounds[:-1], made)
    at = np.arange(out_bounds[-1]) - np.repeat(out_bounds[:-1], made) + owner_start
    end = np.repeat(bounds[1:], made)
    mult = odd_constants(width, 13)
    total = np.zeros(len(at), dtype=np.uint64)
    for j in range(width):
        k = at + j
        ok = k < end
        total += np.where(ok, words[np.where(ok, k, 0)] * mult[j], np.uint64(0)) if len(words) else 0
    return splitmix(total), out_bounds
