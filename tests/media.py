"""Real files to index: pictures and uncompressed videos with planted objects, made with numpy and nothing else."""

from __future__ import annotations

import struct
import zlib

import numpy as np


def object_(seed: int, side: int = 90) -> np.ndarray:
    """A grey square with a pattern of bright and dark spots of its own."""
    rng = np.random.default_rng(seed)
    out = np.full((side, side), 128.0)
    for _ in range(60):
        y, x = rng.integers(4, side - 8, 2)
        out[y : y + rng.integers(2, 5), x : x + rng.integers(2, 5)] = rng.choice([0, 60, 200, 255])
    return out


def scene(seed: int, things: list[tuple[np.ndarray, int, int]], size: tuple[int, int] = (240, 320)) -> np.ndarray:
    """A background of soft noise with things put into it at (x, y)."""
    rng = np.random.default_rng(1000 + seed)
    out = 110 + 20 * np.kron(rng.random((size[0] // 40, size[1] // 40)), np.ones((40, 40)))
    for _ in range(30):
        y, x = rng.integers(4, size[0] - 8), rng.integers(4, size[1] - 8)
        out[y : y + rng.integers(2, 5), x : x + rng.integers(2, 5)] = rng.choice([0, 60, 200, 255])
    for thing, x, y in things:
        out[y : y + thing.shape[0], x : x + thing.shape[1]] = thing
    return out.round().astype(np.uint8)


def exif(when: str | None = None, place: tuple[float, float] | None = None) -> bytes:
    """A TIFF block with a time of origin and a place."""
    data, base = b"", 200
    first, sub, gps = [], [], []

    def far(raw: bytes) -> int:
        nonlocal data
        at = base + len(data)
        data += raw
        return at

    if when:
        text = when.encode() + b"\0"
        sub.append(struct.pack("<HHII", 0x9003, 2, len(text), far(text)))
    for ref, value, sides in ((1, place and place[0], "NS"), (3, place and place[1], "EW")):
        if value is not None:
            gps.append(struct.pack("<HHI4s", ref, 2, 2, (sides[value < 0] + "\0").encode()))
            whole = int(abs(value))
            minutes = (abs(value) - whole) * 60
            gps.append(struct.pack("<HHII", ref + 1, 5, 3, far(struct.pack("<6I", whole, 1, int(minutes), 1, round((minutes % 1) * 60 * 1000), 1000))))
    size = lambda d: 2 + 12 * len(d) + 4
    at = 8 + size([0, 0])
    first = [struct.pack("<HHII", 0x8769, 4, 1, at), struct.pack("<HHII", 0x8825, 4, 1, at + size(sub))]
    directory = lambda d: struct.pack("<H", len(d)) + b"".join(d) + b"\0" * 4
    head = b"II*\0" + struct.pack("<I", 8) + directory(first) + directory(sub) + directory(gps)
    assert len(head) <= base
    return head.ljust(base, b"\0") + data


def png(picture: np.ndarray, tags: bytes | None = None, kind: int = 0) -> bytes:
    """An eight-bit grey PNG whose rows are all filtered by ``kind``."""
    chunk = lambda name, raw: struct.pack(">I", len(raw)) + name + raw + struct.pack(">I", zlib.crc32(name + raw))
    p = picture.astype(np.int32)
    left, up = np.pad(p, ((0, 0), (1, 0)))[:, :-1], np.pad(p, ((1, 0), (0, 0)))[:-1]
    corner = np.pad(p, ((1, 0), (1, 0)))[:-1, :-1]
    whole = left + up - corner
    off = np.abs(np.stack([whole - left, whole - up, whole - corner]))
    paeth = np.where((off[0] <= off[1]) & (off[0] <= off[2]), left, np.where(off[1] <= off[2], up, corner))
    guess = [0 * p, left, up, (left + up) // 2, paeth][kind]
    rows = np.column_stack([np.full(len(p), kind), (p - guess) & 255]).astype(np.uint8)
    head = struct.pack(">IIBBBBB", p.shape[1], p.shape[0], 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + (chunk(b"eXIf", tags) if tags else b"") + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def _bottom_up(picture: np.ndarray) -> bytes:
    h, w = picture.shape
    rows = np.zeros((h, -(-w * 24 // 32) * 4), dtype=np.uint8)
    rows[:, : 3 * w] = np.repeat(picture[::-1], 3, axis=1)
    return rows.tobytes()


def bmp(picture: np.ndarray) -> bytes:
    h, w = picture.shape
    raw = _bottom_up(picture)
    return b"BM" + struct.pack("<IHHI", 54 + len(raw), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(raw), 0, 0, 0, 0) + raw


def avi(pictures: list[np.ndarray], rate: int) -> bytes:
    """An uncompressed video of ``rate`` pictures a second."""
    h, w = pictures[0].shape
    chunk = lambda name, raw: name + struct.pack("<I", len(raw)) + raw + b"\0" * (len(raw) % 2)
    listed = lambda name, raw: chunk(b"LIST", name + raw)
    main = chunk(b"avih", struct.pack("<14I", 1_000_000 // rate, 0, 0, 0, len(pictures), 0, 1, 0, w, h, 0, 0, 0, 0))
    form = chunk(b"strf", struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, 0, 0, 0, 0, 0))
    body = listed(b"hdrl", main + listed(b"strl", chunk(b"strh", b"vidsDIB " + b"\0" * 48) + form)) + listed(b"movi", b"".join(chunk(b"00db", _bottom_up(p)) for p in pictures))
    return chunk(b"RIFF", b"AVI " + body)


def jpeg_header(width: int, height: int, tags: bytes) -> bytes:
    """No picture, but a JPEG's head: EXIF tags and a frame header."""
    app = b"Exif\0\0" + tags
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(app) + 2) + app + b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, height, width, 1) + b"\1\x11\0\xff\xd9"
