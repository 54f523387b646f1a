"""Seams for what is not relational: decoding, embedding, keypoint detection, frame extraction.

A provider turns files into rows of the index tables, inside ``mapInArrow``, so a model is loaded once per task.  ``Decoded``
is the seam for real ones: it decodes, and asks for the vectors and the keypoints of each picture.  ``PlainPictures`` needs no
model, ``TableEmbeddings`` takes vectors made elsewhere, and ``PlantedEmbeddings`` is for tests.
"""

from __future__ import annotations

import hashlib
from abc import ABC, abstractmethod
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import media as M
from ..operators.pooling import GRID, SCALES
from . import pictures as P
from .store import SCHEMAS

#: Files that one pass reads; their paths are with the driver.
CHUNK = 10_000


def schema_of(name: str) -> T.StructType:
    return T._parse_datatype_string(SCHEMAS[name])


class Provider(ABC):
    """Rows of the index for files: ``path``, ``kind``, ``photo_id``, ``size``, ``mtime_ns`` and ``content`` (read only if it is used)."""

    #: Whether videos are taken apart into frames; otherwise they are passed over.
    videos = False

    def photos(self, files: DataFrame) -> DataFrame:
        """An entry for each file, dated by the file."""
        null = lambda t: F.lit(None).cast(t)
        made = {"source_video_path": null("string"), "frame_time_sec": null("double"), "taken_at": file_time("mtime_ns"), "taken_at_inferred": F.lit(True)}
        made |= {"gps": null("struct<lat: double, lon: double>"), "width": null("int"), "height": null("int")}
        return files.withColumns(made).select(*schema_of("photos").names)

    @abstractmethod
    def regions(self, files: DataFrame) -> DataFrame:
        """Region vectors of each photo."""

    def keypoints(self, files: DataFrame) -> DataFrame:
        """Local features of each photo; none, unless a provider has them."""
        return files.sparkSession.createDataFrame([], schema_of("keypoints"))


def file_time(column: str):
    return F.timestamp_micros((F.col(column) / 1000).cast("long")).cast("timestamp_ntz")


class TableEmbeddings(Provider):
    """Vectors that lie in a table already: ``photo_id``, ``region_no``, the box and ``vec``; keypoints likewise."""

    def __init__(self, table: DataFrame, keypoints: DataFrame | None = None):
        self.table, self.points = table, keypoints

    def regions(self, files: DataFrame) -> DataFrame:
        return self.table.join(files.select("photo_id"), "photo_id", "left_semi")

    def keypoints(self, files: DataFrame) -> DataFrame:
        if self.points is None:
            return super().keypoints(files)
        own = self.points.drop("mtime_ns", "size")
        return own.join(files.select("photo_id", "mtime_ns", "size"), "photo_id").select(*schema_of("keypoints").names)


class PlantedEmbeddings(Provider):
    """Deterministic unit vectors from a picture's name: pictures of one instance are near each other."""

    def __init__(self, dim: int = 64, regions: int = 5, noise: float = 0.2):
        self.dim, self.count, self.noise = dim, regions, noise

    def regions(self, files: DataFrame) -> DataFrame:
        schema = to_arrow_schema(schema_of("regions"))
        return files.select("photo_id", "path").mapInArrow(lambda batches: self.embed(batches, schema), SCHEMAS["regions"])

    def embed(self, batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        import zlib

        for batch in batches:
            rows = []
            for photo, path in zip(batch.column("photo_id").to_pylist(), batch.column("path").to_pylist(), strict=True):
                name = path.rsplit("/", 1)[-1]
                centre = np.random.default_rng(zlib.crc32(name[:1].encode())).standard_normal(self.dim)
                own = np.random.default_rng(zlib.crc32(path.encode()))
                for r in range(self.count):
                    v = centre + self.noise * own.standard_normal(self.dim)
                    rows.append({"photo_id": photo, "region_no": r, "x1": 0.0, "y1": 0.0, "x2": 1.0, "y2": 1.0, "vec": (v / np.linalg.norm(v)).astype(np.float32).tolist()})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


#: One picture: the file's photo id and path (for a frame: of the video), the second it is from, and its grey values, if they read.
Shot = tuple[str, str, float | None, np.ndarray | None]


class Decoded(Provider):
    """Pictures and frames of videos, decoded by ``shots``; subclasses say what a picture's vectors and keypoints are."""

    videos = True

    def __init__(self, interval: float = 2.0):
        self.interval = interval

    @abstractmethod
    def vectors(self, picture: np.ndarray) -> Iterable[tuple[tuple[float, float, float, float], np.ndarray]]:
        """Normalised boxes of a picture's regions, and their vectors."""

    @abstractmethod
    def features(self, picture: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in pixels and descriptors of a picture's local features."""

    def decode(self, content: bytes) -> np.ndarray | None:
        return P.grey(content)

    def frames(self, content: bytes) -> Iterable[tuple[float, np.ndarray]]:
        return P.frames(content, self.interval)

    def shots(self, kind: str, photo: str, path: str, content: bytes) -> Iterator[Shot]:
        if kind == "image":
            yield photo, path, None, self.decode(content)
        else:
            for second, picture in self.frames(content):
                yield hashlib.sha1(f"{path}@{second}".encode()).hexdigest()[:16], path, second, picture

    def _each(self, files: DataFrame, schema: T.StructType, rows) -> DataFrame:
        """A batch of rows for each file, as a file's content may be large."""
        arrow = to_arrow_schema(schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    yield pa.RecordBatch.from_pylist(list(rows(batch.slice(i, 1).to_pylist()[0])), schema=arrow)

        return files.select("kind", "photo_id", "path", "size", "mtime_ns", "content").mapInArrow(run, schema)

    def photos(self, files: DataFrame) -> DataFrame:
        """Entries with size, capture time and place.  A frame is dated by its video's container or file, and its own second."""
        raw = T._parse_datatype_string(
            "photo_id string, path string, source_video_path string, frame_time_sec double, times array<string>, lat array<double>, lat_ref string, lon array<double>, lon_ref string, "
            "width int, height int, mtime_ns bigint, size bigint"
        )

        def rows(file: dict) -> Iterator[dict]:
            own = P.facts(file["content"]) if file["kind"] == "image" else P.Facts()
            for photo, path, second, picture in self.shots(file["kind"], file["photo_id"], file["path"], file["content"]):
                shape = picture.shape if picture is not None else (own.height, own.width)
                out = {"photo_id": photo, "path": path if second is None else f"{path}@{second}", "source_video_path": None if second is None else path, "frame_time_sec": second}
                out |= {"times": own.times, "width": shape[1], "height": shape[0], "mtime_ns": file["mtime_ns"], "size": file["size"]}
                for name, angle in (("lat", own.lat), ("lon", own.lon)):
                    out |= {name: list(map(float, angle[:3])) if angle else None, f"{name}_ref": angle[3] if angle else None}
                yield out

        degrees = lambda c: M.degrees(*[F.get(c, i) for i in range(3)], F.col(f"{c}_ref"))
        own = M.exif_time(*[F.get("times", i) for i in range(3)])
        frame = F.col("frame_time_sec").isNotNull()
        plus = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.coalesce("frame_time_sec", F.lit(0.0)).cast("decimal(18,6)"))
        entries = self._each(files, raw, rows).withColumn("own", own).withColumn("gps", M.gps(degrees("lat"), degrees("lon")))
        started = self.started(files)
        if started is not None:
            entries = entries.join(F.broadcast(started.select(F.col("path").alias("source_video_path"), "created_at")), "source_video_path", "left").withColumn("own", F.coalesce("own", F.col("created_at") + plus))
        entries = entries.withColumn("taken_at_inferred", F.col("own").isNull()).withColumn("taken_at", F.coalesce("own", file_time("mtime_ns") + F.when(frame, plus).otherwise(F.expr("interval 0 seconds"))))
        return entries.select(*schema_of("photos").names)

    def started(self, files: DataFrame) -> DataFrame | None:
        """``path`` and ``created_at`` of the videos among ``files`` (at most ``CHUNK``) whose container says it; see ``files.container_time``."""
        return None

    def regions(self, files: DataFrame) -> DataFrame:
        def rows(file: dict) -> Iterator[dict]:
            for photo, _, _, picture in self.shots(file["kind"], file["photo_id"], file["path"], file["content"]):
                for n, (box, vec) in enumerate(self.vectors(picture) if picture is not None else ()):
                    yield {"photo_id": photo, "region_no": n, **dict(zip(("x1", "y1", "x2", "y2"), map(float, box), strict=True)), "vec": vec.astype(np.float32).tolist()}

        return self._each(files, schema_of("regions"), rows)

    def keypoints(self, files: DataFrame) -> DataFrame:
        def rows(file: dict) -> Iterator[dict]:
            for photo, _, _, picture in self.shots(file["kind"], file["photo_id"], file["path"], file["content"]):
                places, descs = self.features(picture) if picture is not None else ((), ())
                for n, (at, desc) in enumerate(zip(places, descs, strict=True)):
                    yield {"photo_id": photo, "mtime_ns": file["mtime_ns"], "size": file["size"], "kp_no": n, "x": float(at[0]), "y": float(at[1]), "desc": desc.astype(np.float32).tolist()}

        return self._each(files, schema_of("keypoints"), rows)


class PlainPictures(Decoded):
    """No model: windows are told by their texture, keypoints are spots with the patch around them."""

    def __init__(self, interval: float = 2.0, side: int = 1024, most: int = 3000):
        super().__init__(interval)
        self.side, self.most = side, most

    def vectors(self, picture):
        h, w = picture.shape
        spans = [(0, GRID)], *[[(a, a + size) for a in range(0, GRID - size + 1, stride)] for size, stride in SCALES]
        for level in spans:
            for top, bottom in level:
                for left, right in level:
                    box = (left / GRID, top / GRID, right / GRID, bottom / GRID)
                    part = picture[int(box[1] * h) : max(int(box[1] * h) + 1, int(box[3] * h)), int(box[0] * w) : max(int(box[0] * w) + 1, int(box[2] * w))]
                    yield box, P.texture(part)

    def features(self, picture):
        small, factor = P.shrunk(picture, self.side)
        places, descs = P.spots(small, self.most)
        return places * factor, descs


def with_content(files: DataFrame) -> DataFrame:
    """``files``, at most ``CHUNK`` of them, and their bytes, read when they are used."""
    spark = files.sparkSession
    paths = [r.path for r in files.select("path").limit(CHUNK + 1).collect()]
    if len(paths) > CHUNK:
        raise ValueError(f"more than {CHUNK} files at once: use chunks()")
    if not paths:
        return files.withColumn("content", F.lit(b""))
    plain = ["".join("\\" + c if c in "\\[]{}*?," else c for c in p) for p in paths]  # no wildcards
    content = spark.read.format("binaryFile").load(plain).select(F.regexp_replace("path", r"^file:/*(?=/)", "").alias("path"), "content")
    return content.join(F.broadcast(files), "path")


def chunks(files: DataFrame, size: int = CHUNK) -> Iterator[DataFrame]:
    """``files`` in parts of ``size``, by path; the driver holds one part's rows at a time."""
    held = []
    for row in files.orderBy("path").toLocalIterator():
        held.append(row)
        if len(held) == size:
            yield files.sparkSession.createDataFrame(held, files.schema)
            held = []
    if held:
        yield files.sparkSession.createDataFrame(held, files.schema)
