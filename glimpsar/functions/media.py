"""Names, dates and places of media files as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes of the files that are indexed.
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".heic", ".heif", ".webp", ".tif", ".tiff", ".bmp")
VIDEO_SUFFIXES = (".mp4", ".mov", ".m4v", ".avi", ".mkv", ".webm")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def media_kind(path: Column) -> Column:
    """``image``, ``video`` or null for any other file and for hidden ones."""
    hidden = basename(path).startswith(".")
    return F.when(hidden, F.lit(None)).when(suffix(path).isin(*IMAGE_SUFFIXES), "image").when(suffix(path).isin(*VIDEO_SUFFIXES), "video")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def photo_id(key: Column) -> Column:
    """The first 16 hex digits of the SHA-1 of a path (or ``path@second`` for a video frame)."""
    return F.substring(F.sha1(key), 1, 16)


def exif_time(*tags: Column) -> Column:
    """The first tag, in order of preference, that reads as a time; null if none does."""
    return F.coalesce(*[F.try_to_timestamp(F.substring(F.trim(t), 1, 19), F.lit("yyyy:MM:dd HH:mm:ss")).cast("timestamp_ntz") for t in tags])


def degrees(d: Column, m: Column, s: Column, ref: Column) -> Column:
    value = d + m / 60.0 + s / 3600.0
    return F.when(ref.isin("S", "W"), -value).otherwise(value)


def gps(lat: Column, lon: Column) -> Column:
    """A place, or null beyond the ranges and at exactly (0, 0)."""
    fine = lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0) & ~((lat == 0.0) & (lon == 0.0))
    return F.when(fine, F.struct(lat.alias("lat"), lon.alias("lon")))


def days_between(later: Column, earlier: Column) -> Column:
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    return (micros(later) - micros(earlier)) / F.lit(86_400_000_000.0)


def span_text(days: Column) -> Column:
    """The length of an absence: years and months, months, or days."""
    y = F.floor(days / 365.25).cast("long")
    m = F.floor((days - y * 365.25) / 30.44).cast("long")
    return (
        F.when((y != 0) & (m != 0), F.concat(y.cast("string"), F.lit(" yr "), m.cast("string"), F.lit(" mo")))
        .when(y != 0, F.concat(y.cast("string"), F.lit(" yr")))
        .when(m != 0, F.concat(m.cast("string"), F.lit(" mo")))
        .otherwise(F.concat(F.floor(days + 0.5).cast("long").cast("string"), F.lit(" days")))
    )


def relative_age(days: Column) -> tuple[Column, Column]:
    """How long ago: a signed whole number (negative: in the past) and its unit."""
    size = F.abs(days)
    near = lambda x: -F.floor(x + 0.5).cast("long")  # noqa: E731  halves go up, as clocks round
    unit = F.when(size < 1, "hour").when(size < 45, "day").when(size < 365, "month").otherwise("year")
    n = F.when(size < 1, near(days * 24)).when(size < 45, near(days)).when(size < 365, near(days / 30.44)).otherwise(near(days / 365.25))
    return n, unit


def coord_text(value: Column, positive: str, negative: str) -> Column:
    return F.concat(F.format_string("%.4f", F.abs(value)), F.lit("° "), F.when(value >= 0, positive).otherwise(negative))


def frame_clock(seconds: Column) -> Column:
    return F.concat(F.floor(seconds / 60).cast("string"), F.lit(":"), F.lpad(F.floor(seconds % 60).cast("string"), 2, "0"))


def clock_text(at: Column) -> Column:
    """The time of day; nothing at midnight, which stands for a date without a time."""
    return F.when((F.hour(at) != 0) | (F.minute(at) != 0), F.date_format(at, "HH:mm"))


def box_key(photo: Column, *corners: Column) -> Column:
    """A photo and a box to four digits, as a key of what has been asked before."""
    return F.concat(photo.cast("string"), F.lit("|"), F.concat_ws(",", *[F.format_string("%.4f", c) for c in corners]))


def instance_of(path: Column) -> Column:
    """The instance a generated file name begins with; null for unrelated pictures."""
    name = basename(path)
    return F.when(~name.startswith("unrelated"), F.substring(name, 1, 1))


def label_of(instance: Column) -> Column:
    return F.when(instance == "A", "same").when(instance == "T", "twin").when(instance.isNotNull() & (instance != ""), "same_class").otherwise("unrelated")
