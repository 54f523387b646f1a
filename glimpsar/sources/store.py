"""The index as Parquet tables: a stamp, photos, regions, keypoints and the feedback log."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = 2
SCHEMAS = {
    "photos": "photo_id string, path string, source_video_path string, frame_time_sec double, taken_at timestamp_ntz, taken_at_inferred boolean, "
    "gps struct<lat: double, lon: double>, width int, height int, mtime_ns bigint, size bigint",
    "regions": "photo_id string, region_no int, x1 double, y1 double, x2 double, y2 double, vec array<float>",
    "keypoints": "photo_id string, mtime_ns bigint, size bigint, kp_no int, x double, y double, `desc` array<float>",
    "feedback": "seq bigint, object_id string, photo_id string, confirmed boolean, box struct<x1: double, y1: double, x2: double, y2: double>",
}
#: Photos that a commit has removed or replaced: none of their rows of earlier commits counts.
_DROPPED = "dropped"
#: Parts of a table beyond which a commit is followed by compaction.
PARTS = 32


class StampError(ValueError):
    """The index was made by another version or model."""


class IndexStore:
    """Tables below one root, each in parts.  A commit adds parts and names them in one stamp.

    What a commit removes or replaces is written down by id and passed over when a table is read, so a commit costs what it adds, not
    what is there; ``compact`` rewrites tables of many parts.  Readers follow the last stamp: a writer that dies half way
    leaves everything as it was.  The index has one writer at a time; the feedback log is merely appended to, by any number of them.
    """

    def __init__(self, spark: SparkSession, root: str, model: str):
        self.spark, self.root, self.model = spark, root.rstrip("/"), model
        self.stamps = f"{self.root}/meta"

    def create(self) -> None:
        self.spark.createDataFrame([], SCHEMAS["feedback"]).write.mode("errorifexists").parquet(f"{self.root}/feedback")
        self._stamp(0, [])

    def _stamp(self, number: int, parts: list[tuple[str, str]]) -> None:
        schema = "number bigint, version int, model string, parts array<struct<name: string, part: string>>"
        self.spark.createDataFrame([(number, VERSION, self.model, parts)], schema).coalesce(1).write.mode("append").parquet(self.stamps)

    def _latest(self) -> tuple[int, list[tuple[str, str]]]:
        stamp = self.spark.read.parquet(self.stamps).orderBy(F.desc("number")).first()
        if (stamp.version, stamp.model) != (VERSION, self.model):
            raise StampError(f"index of version {stamp.version} and model {stamp.model}, wanted {VERSION} and {self.model}")
        return stamp.number, [(p["name"], p["part"]) for p in stamp.parts]

    def _read(self, name: str, schema: T.StructType, parts: list[tuple[str, str]]) -> DataFrame:
        whole = T.StructType([*schema.fields, T.StructField("added", T.LongType())])
        paths = [f"{self.root}/{n}/{p}" for n, p in parts if n == name]
        return self.spark.read.schema(whole).parquet(*paths) if paths else self.spark.createDataFrame([], whole)

    def table(self, name: str) -> DataFrame:
        if name == "feedback":
            self._latest()
            return self.spark.read.schema(T._parse_datatype_string(SCHEMAS[name])).parquet(f"{self.root}/feedback")
        return self._live(name, self._latest()[1]).drop("added")

    def _live(self, name: str, parts: list[tuple[str, str]]) -> DataFrame:
        rows = self._read(name, T._parse_datatype_string(SCHEMAS[name]), parts)
        if not any(n == _DROPPED for n, _ in parts):
            return rows
        gone = self._read(_DROPPED, T.StructType([T.StructField("photo_id", T.StringType())]), parts)
        last = gone.groupBy(F.col("photo_id").alias("gone_id")).agg(F.max("added").alias("gone_at"))
        return rows.join(last, (F.col("photo_id") == F.col("gone_id")) & (F.col("added") < F.col("gone_at")), "left_anti")

    def commit(self, add: dict[str, DataFrame] | None = None, drop: DataFrame | None = None) -> None:
        """Add rows to tables, and remove all rows so far of the photos in ``drop`` (``photo_id``), in one step."""
        number, parts = self._latest()
        written = [self._write(name, number + 1, rows) for name, rows in (add or {}).items()]
        if drop is not None:
            written.append(self._write(_DROPPED, number + 1, drop))
        self._stamp(number + 1, parts + written)
        if max(sum(n == name for n, _ in parts + written) for name in {n for n, _ in parts + written} | {""}) > PARTS:
            self.compact()

    def _write(self, name: str, number: int, rows: DataFrame) -> tuple[str, str]:
        schema = T._parse_datatype_string("photo_id string" if name == _DROPPED else SCHEMAS[name])
        part = f"p{number:06d}-{uuid.uuid4().hex[:8]}"
        rows.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in schema], F.lit(number).cast("long").alias("added")).write.parquet(f"{self.root}/{name}/{part}")
        return name, part

    def append(self, name: str, rows: DataFrame) -> None:
        if name == "feedback":
            wanted = T._parse_datatype_string(SCHEMAS[name])
            rows.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in wanted]).write.mode("append").parquet(f"{self.root}/feedback")
        else:
            self.commit({name: rows})

    def drop_photos(self, gone: DataFrame) -> None:
        """Remove photos and all that belongs to them, but not what users have said about them."""
        self.commit(drop=gone)

    def upsert_photos(self, photos: DataFrame, regions: DataFrame, keypoints: DataFrame | None = None) -> None:
        """New entries replace old ones together with their regions and keypoints."""
        self.commit({"photos": photos, "regions": regions} | ({"keypoints": keypoints} if keypoints is not None else {}), photos)

    def compact(self) -> None:
        """Rewrite every table as one part without what has been removed, and delete the files that no stamp needs any more.

        Readers that have begun before are given no files to finish with: compact when nobody reads.
        """
        number, parts = self._latest()
        names = [n for n in SCHEMAS if n != "feedback"]
        written = [self._write(name, number + 1, self._live(name, parts)) for name in names if any(n == name for n, _ in parts)]
        self._stamp(number + 1, written)
        for name, part in parts:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/{part}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def size(self) -> int:
        """Bytes of all files of the index."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
