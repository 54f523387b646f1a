"""Bytes of media files as pictures and facts, as far as that takes no more than numpy: PNG, BMP and uncompressed AVI.

Sizes, capture times and places are read from headers (PNG, BMP, GIF, JPEG and TIFF with their EXIF tags), also of
files whose picture is not decoded.  Whatever does not read gives nothing rather than an error.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

# EXIF and TIFF tags.
_WIDTH, _HEIGHT, _ORIENTATION, _DATE_TIME, _EXIF, _GPS = 0x0100, 0x0101, 0x0112, 0x0132, 0x8769, 0x8825
_ORIGINAL, _DIGITIZED = 0x9003, 0x9004
_UNITS = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 7: "s", 9: "i", 10: "ii"}
_WRONG = (struct.error, ValueError, IndexError, KeyError, TypeError, ZeroDivisionError, OverflowError, zlib.error, UnicodeError, MemoryError)


@dataclass
class Facts:
    """What a header says: size, texts of the three time tags in order of preference, and the parts of a place."""

    width: int | None = None
    height: int | None = None
    times: list[str | None] = field(default_factory=lambda: [None] * 3)
    lat: tuple | None = None  # degrees, minutes, seconds, N or S
    lon: tuple | None = None


def _tiff(raw: bytes) -> dict[int, dict[int, object]]:
    """The tags of a TIFF block by directory: 0 for the first, else the tag that points there."""
    order = {b"II": "<", b"MM": ">"}[raw[:2]]
    out: dict[int, dict[int, object]] = {}
    todo = [(0, struct.unpack_from(order + "I", raw, 4)[0])]
    while todo:
        name, at = todo.pop()
        tags = out[name] = {}
        for i in range(struct.unpack_from(order + "H", raw, at)[0]):
            tag, kind, count = struct.unpack_from(order + "HHI", raw, at + 2 + 12 * i)
            unit = _UNITS.get(kind)
            if unit is None or count > 4096:
                continue
            shape = order + (f"{count}s" if unit == "s" else unit * count)
            place = at + 10 + 12 * i
            if struct.calcsize(shape) > 4:
                place = struct.unpack_from(order + "I", raw, place)[0]
            tags[tag] = struct.unpack_from(shape, raw, place)
        todo += [(p, tags[p][0]) for p in (_EXIF, _GPS) if p in tags and p not in out and name == 0]
    return out


def _text(value) -> str | None:
    return value[0].split(b"\0")[0].decode("ascii") if value else None


def _angle(tags: dict, ref: int) -> tuple | None:
    v, side = tags.get(ref + 1), _text(tags.get(ref))
    if not v or len(v) < 6 or not side:
        return None
    return (*(v[2 * i] / v[2 * i + 1] for i in range(3)), side)


def _of_tags(raw: bytes, facts: Facts) -> None:
    try:
        dirs = _tiff(raw)
    except _WRONG:
        return
    first, exif, gps = dirs.get(0, {}), dirs.get(_EXIF, {}), dirs.get(_GPS, {})
    for i, (tags, tag) in enumerate(((exif, _ORIGINAL), (exif, _DIGITIZED), (first, _DATE_TIME))):
        try:
            facts.times[i] = _text(tags.get(tag))
        except _WRONG:
            pass
    try:
        facts.lat, facts.lon = _angle(gps, 1), _angle(gps, 3)
    except _WRONG:
        pass
    if facts.width is None and _WIDTH in first and _HEIGHT in first:
        facts.width, facts.height = int(first[_WIDTH][0]), int(first[_HEIGHT][0])
    if first.get(_ORIENTATION, (1,))[0] in (5, 6, 7, 8) and facts.width is not None:
        facts.width, facts.height = facts.height, facts.width


def facts(raw: bytes) -> Facts:
    """Size, times and place of a picture, from its header."""
    out = Facts()
    try:
        if raw[:8] == b"\x89PNG\r\n\x1a\n":
            out.width, out.height = struct.unpack_from(">II", raw, 16)
            at = 8
            while at + 12 <= len(raw):
                size, kind = struct.unpack_from(">I4s", raw, at)
                if kind == b"eXIf":
                    _of_tags(raw[at + 8 : at + 8 + size], out)
                at += 12 + size
        elif raw[:2] == b"BM":
            w, h = struct.unpack_from("<ii", raw, 18)
            out.width, out.height = w, abs(h)
        elif raw[:6] in (b"GIF87a", b"GIF89a"):
            out.width, out.height = struct.unpack_from("<HH", raw, 6)
        elif raw[:4] in (b"II*\0", b"MM\0*"):
            _of_tags(raw, out)
        elif raw[:2] == b"\xff\xd8":
            at, tags = 2, None
            while at + 4 <= len(raw) and raw[at] == 0xFF:
                mark, size = raw[at + 1], struct.unpack_from(">H", raw, at + 2)[0]
                if mark == 0xE1 and raw[at + 4 : at + 10] == b"Exif\0\0":
                    tags = raw[at + 10 : at + 2 + size]
                elif 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                    out.height, out.width = struct.unpack_from(">HH", raw, at + 5)
                    break
                at += 2 + size
            if tags:
                _of_tags(tags, out)
    except _WRONG:
        pass
    return out


def _rows(raw: np.ndarray, width: int, height: int, bits: int, upward: bool) -> np.ndarray:
    """Rows of 24 or 32 bits a pixel (blue first, padded to four bytes) as grey values."""
    step = -(-width * bits // 32) * 4
    pixels = raw[: step * height].reshape(height, step)[:, : width * bits // 8].reshape(height, width, bits // 8)
    grey = pixels[..., :3].astype(np.float32) @ np.array([0.114, 0.587, 0.299], dtype=np.float32)
    return grey[::-1] if upward else grey


def _png(raw: bytes) -> np.ndarray | None:
    at, parts, head = 8, [], None
    while at + 12 <= len(raw):
        size, kind = struct.unpack_from(">I4s", raw, at)
        if kind == b"IHDR":
            head = struct.unpack_from(">IIBBBBB", raw, at + 8)
        elif kind == b"IDAT":
            parts.append(raw[at + 8 : at + 8 + size])
        at += 12 + size
    if head is None or head[2] != 8 or head[6] or head[3] not in (0, 2, 4, 6):
        return None
    width, height, channels = head[0], head[1], {0: 1, 2: 3, 4: 2, 6: 4}[head[3]]
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), dtype=np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height, width, channels), dtype=np.uint8)
    above = np.zeros((width, channels), dtype=np.uint8)
    for y, line in enumerate(lines):
        own, kind = line[1:].reshape(width, channels), line[0]
        if kind == 0:
            now = own
        elif kind == 1:
            now = np.cumsum(own, axis=0, dtype=np.uint8)
        elif kind == 2:
            now = own + above
        else:  # these look at the pixel before, which is known one by one only
            now, before, corner = np.zeros_like(own), np.zeros(channels, dtype=np.int32), np.zeros(channels, dtype=np.int32)
            for x in range(width):
                up = above[x].astype(np.int32)
                if kind == 3:
                    guess = (before + up) // 2
                else:
                    whole = before + up - corner
                    off = np.abs(np.stack([whole - before, whole - up, whole - corner]))
                    guess = np.where((off[0] <= off[1]) & (off[0] <= off[2]), before, np.where(off[1] <= off[2], up, corner))
                before, corner = (own[x] + guess) & 255, up
                now[x] = before
        out[y] = above = now
    colours = out[..., :3] if channels > 2 else out[..., :1]
    return colours.astype(np.float32) @ np.array([0.299, 0.587, 0.114] if channels > 2 else [1.0], dtype=np.float32)


def grey(raw: bytes) -> np.ndarray | None:
    """A picture's grey values, or nothing for a format (or a depth, or damage) that is not read."""
    try:
        if raw[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(raw)
        if raw[:2] == b"BM":
            start, _, width, height, _, bits, packed = struct.unpack_from("<IIiiHHI", raw, 10)
            if bits in (24, 32) and packed == 0:
                return _rows(np.frombuffer(raw, dtype=np.uint8, offset=start), width, abs(height), bits, height > 0)
    except _WRONG:
        pass
    return None


def frames(raw: bytes, interval: float) -> Iterator[tuple[float, np.ndarray]]:
    """Grey frames of an uncompressed AVI with their nominal seconds, one for each ``interval``."""
    try:
        if raw[:4] != b"RIFF" or raw[8:12] != b"AVI ":
            return
        todo, micros, shape, shown = [(12, len(raw))], 0, None, []
        while todo:
            at, end = todo.pop(0)
            while at + 8 <= end:
                name, size = struct.unpack_from("<4sI", raw, at)
                if name == b"LIST":
                    todo.append((at + 12, min(end, at + 8 + size)))
                elif name == b"avih":
                    micros = struct.unpack_from("<I", raw, at + 8)[0]
                elif name == b"strf" and shape is None:
                    _, width, height, _, bits, packed = struct.unpack_from("<IiiHHI", raw, at + 8)
                    shape = (width, abs(height), bits, height > 0) if packed == 0 and bits in (24, 32) else None
                elif name[2:] == b"db" and size:
                    shown.append(at + 8)
                at += 8 + size + size % 2
        if not micros or shape is None:
            return
        n = 0
        while (k := int(n * interval * 1e6 / micros + 1e-9)) < len(shown):
            yield n * interval, _rows(np.frombuffer(raw, dtype=np.uint8, offset=shown[k]), *shape)
            n += 1
    except _WRONG:
        return


def shrunk(picture: np.ndarray, side: int) -> tuple[np.ndarray, float]:
    """A picture whose longer side is ``side`` at most, and the factor that leads back."""
    step = max(1, -(-max(picture.shape) // side))
    h, w = (n // step * step for n in picture.shape)
    return picture[:h, :w].reshape(h // step, step, w // step, step).mean((1, 3)), float(step)


def spots(picture: np.ndarray, most: int = 3000, patch: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Places (x, y) and descriptors of spots that stand out from what surrounds them, the strongest ``most``.

    A spot is where the difference to the mean around it is the largest of its neighbourhood; its descriptor is the patch
    around it, less its mean, of unit length.
    """
    r, h, w = patch, *picture.shape
    if h <= 4 * r or w <= 4 * r:
        return np.zeros((0, 2)), np.zeros((0, (2 * r + 1) ** 2))
    total = np.zeros((h + 1, w + 1))
    total[1:, 1:] = picture.astype(np.float64).cumsum(0).cumsum(1)
    box = lambda k: (total[2 * k + 1 :, 2 * k + 1 :] - total[: -2 * k - 1, 2 * k + 1 :] - total[2 * k + 1 :, : -2 * k - 1] + total[: -2 * k - 1, : -2 * k - 1]) / (2 * k + 1) ** 2
    strength = np.abs(box(1)[r - 1 : h - r - 1, r - 1 : w - r - 1] - box(r))
    around = np.lib.stride_tricks.sliding_window_view(np.pad(strength, 3), (7, 7)).max((2, 3))
    y, x = np.nonzero((strength >= around) & (strength > 20.0))
    order = np.lexsort((x, y, -strength[y, x]))[:most]
    y, x = y[order] + r, x[order] + r
    keep = (y >= r) & (y < h - r) & (x >= r) & (x < w - r)
    y, x = y[keep], x[keep]
    patches = np.lib.stride_tricks.sliding_window_view(picture, (2 * r + 1, 2 * r + 1))[y - r, x - r].reshape(len(y), -1).astype(np.float64)
    patches -= patches.mean(1, keepdims=True)
    return np.column_stack([x, y]).astype(float), patches / np.maximum(np.linalg.norm(patches, axis=1, keepdims=True), 1e-9)


def texture(picture: np.ndarray, bins: int = 16) -> np.ndarray:
    """A unit vector of what a window looks like: histograms of its grey values and of the directions of its edges."""
    dy, dx = np.gradient(picture) if min(picture.shape) > 1 else (np.zeros_like(picture), np.zeros_like(picture))
    edges = np.histogram(np.arctan2(dy, dx), bins, (-np.pi, np.pi), weights=np.hypot(dx, dy))[0]
    levels = np.histogram(picture, bins, (0, 256))[0].astype(float)
    v = np.concatenate([np.sqrt(levels / max(1.0, levels.sum())), np.sqrt(edges / max(1e-9, edges.sum()))])
    return v / max(1e-9, np.linalg.norm(v))
