"""A library of photos that can be asked: index, query, confirm or reject, list.

Everything is tables (``sources.store``) and operators; only answers that are asked for are computed.  Two steps look at
pictures, and are a provider's: the vectors of a drawn box, and the local features in it.  ``TableFeatures`` takes both from
the index itself.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .functions import gate
from .functions import geometry as G
from .operators import feedback as B
from .operators import matching as K
from .operators import recall as R
from .operators import timeline as T
from .operators.library import indexed_folder
from .sources.indexer import Progress, Run, index_folder, missing_keypoints
from .sources.store import IndexStore

Box = tuple[float, float, float, float]
#: Photos that stage two looks at for one query.
TOP_K = 200
#: Exemplars whose crops are broadcast together; an object has one per confirmed photo, and all are used.
EXEMPLAR_BLOCK = 32


class TableFeatures:
    """Query features from the index: the regions that overlap the box most, and the keypoints inside it."""

    def __init__(self, store: IndexStore):
        self.store = store

    def vectors(self, photo_id: str, boxes: Sequence[Box]) -> list[list[float]]:
        """A vector for each box."""
        own = self.store.table("regions").where(F.col("photo_id") == photo_id)
        best = []
        for i, box in enumerate(boxes):
            overlap = G.iou([F.col(c) for c in ("x1", "y1", "x2", "y2")], [F.lit(float(v)) for v in box])
            best.append(F.max_by("vec", F.struct(overlap.alias("o"), -F.col("region_no"))).alias(f"v{i}"))
        row = own.agg(*best).first()
        return [list(v) for v in row if v is not None]

    def keypoints(self, photo_id: str, box: Box, width: int, height: int) -> tuple[np.ndarray, np.ndarray, tuple[float, float]]:
        """Places in the crop, descriptors, and the crop's size.  A photo's keypoints are bounded by its detector."""
        x1, y1, x2, y2 = box[0] * width, box[1] * height, box[2] * width, box[3] * height
        inside = F.col("x").between(x1, x2) & F.col("y").between(y1, y2)
        rows = self.store.table("keypoints").where(F.col("photo_id") == photo_id).where(inside).orderBy("kp_no").select("x", "y", "desc").collect()
        xy = np.array([(r.x - x1, r.y - y1) for r in rows], dtype=float).reshape(-1, 2)
        return xy, np.array([r.desc for r in rows], dtype=float), (x2 - x1, y2 - y1)


@dataclass
class Answer:
    """What a query gives: accepted matches in order of time, the last one seen, all candidates, and a warning or nothing."""

    query_id: str
    matches: DataFrame
    last_seen: DataFrame
    candidates: DataFrame

    def warning(self) -> str | None:
        """Evidence in one photo that there is more than one such object."""
        twice = self.candidates.where("detections >= 2")
        name = F.element_at(F.split("path", "/"), -1)
        a = twice.agg(F.max("detections").alias("most"), F.count(F.lit(1)).alias("photos"), F.max_by(name, F.struct("score", "photo_id")).alias("first"))
        return a.select(F.when(F.col("photos") > 0, T.several_text(F.col("most"), F.col("first"), F.col("photos")))).first()[0]


class Library:
    """Queries and feedback over one index.

    ``provider`` reads files; ``verifier`` stands for stage two: it has the signature of ``matching.detect`` and gives detections among
    matched points.  Without one the built-in verifier runs, with six-parameter transforms if ``affine``.
    """

    def __init__(
        self,
        store: IndexStore,
        features: TableFeatures | None = None,
        provider=None,
        min_inliers: int = gate.MIN_INLIERS,
        min_fraction: float = gate.MIN_FRACTION,
        verifier: Callable[..., list[dict]] | None = None,
        affine: bool = False,
    ):
        self.store, self.features, self.provider = store, features or TableFeatures(store), provider
        self.min_inliers, self.min_fraction = min_inliers, min_fraction
        self.verifier, self.affine = verifier or K.detect, affine

    # -- the catalogue

    def index(self, folder: str, report: Callable[[Progress], None] = lambda _: None, **options) -> Run:
        if self.provider is None:
            raise ValueError("indexing needs a provider")
        return index_folder(self.store, folder, self.provider, report, **options)

    def status(self) -> DataFrame:
        photos = self.store.table("photos")
        counts = photos.agg(F.count(F.lit(1)).alias("photos"), F.count("source_video_path").alias("frames"), F.count("taken_at").alias("dated"))
        return counts.crossJoin(F.broadcast(indexed_folder(photos)))

    def photos(self, offset: int = 0, limit: int = 100) -> DataFrame:
        """A page of the listing, without what only the index needs to know."""
        return self.store.table("photos").orderBy("photo_id").offset(offset).limit(limit).drop("mtime_ns", "size", "taken_at_inferred")

    def photo(self, photo_id: str) -> Row:
        found = self.store.table("photos").where(F.col("photo_id") == photo_id).first()
        if found is None:
            raise LookupError(photo_id)
        return found

    # -- what an object is known by

    def _log(self, object_id: str) -> DataFrame:
        return self.store.table("feedback").where(F.col("object_id") == object_id)

    def _exemplars(self, object_id: str) -> list[tuple[str, Box]]:
        log = self._log(object_id)
        kept = B.feedback_state(log).where("confirmed").join(log.select(F.col("seq").alias("box_seq"), "box"), "box_seq")
        live = kept.join(self.store.table("photos").select("photo_id"), "photo_id", "left_semi")
        return [(r.photo_id, tuple(r.box)) for r in live.orderBy("box_seq").collect()]  # one user's taps

    def exemplar_count(self, object_id: str) -> int:
        return B.feedback_state(self._log(object_id)).where("confirmed").count()

    def feedback(self, object_id: str, photo_id: str, confirmed: bool, box: Box | None = None) -> int:
        """One tap; returns how many views the object is now known by.  A confirmation without a box looks for the
        object in the photo with the first exemplar."""
        if confirmed and box is None:
            known = self._exemplars(object_id)
            if not known:
                raise ValueError("unknown object: a box is needed")
            if self.provider is not None:
                missing_keypoints(self.store, self.provider, self.store.spark.createDataFrame([(p,) for p in {photo_id, known[0][0]}], "photo_id string"))
            found = self._verified(known[:1], self.store.table("photos").where(F.col("photo_id") == photo_id).select("photo_id")).where("detection = 0 and x1 is not null").first()
            if found is None:
                raise ValueError("the object is not found in that photo: a box is needed")
            box = (found.x1, found.y1, found.x2, found.y2)
        self._append(object_id, photo_id, confirmed, box)
        return self.exemplar_count(object_id)

    def _append(self, object_id: str, photo_id: str, confirmed: bool, box: Box | None) -> None:
        # The clock orders events, so writers need not know of each other.
        row = [(time.time_ns(), object_id, photo_id, confirmed, tuple(map(float, box)) if box is not None else None)]
        self.store.append("feedback", self.store.spark.createDataFrame(row, self.store.table("feedback").schema))

    # -- asking

    def query(self, photo_id: str, box: Box, top_k: int = TOP_K, object_id: str | None = None) -> Answer:
        """Photos that hold what is in ``box`` of a photo.

        A known object is asked for with its confirmed views as well, and photos that were rejected for it are
        left out (after the limit).  An object that nothing is known of is seeded with the box.
        """
        source = self.photo(photo_id)
        box = tuple(float(v) for v in box)
        if not all(0 <= v <= 1 for v in box):
            raise ValueError("a box's corners lie between 0 and 1")
        exemplars = [(photo_id, box), *[e for e in (self._exemplars(object_id) if object_id else []) if e != (photo_id, box)]]
        hits = self._recall(exemplars, top_k).where(F.col("photo_id") != photo_id)
        if object_id:
            hits = hits.join(B.feedback_state(self._log(object_id)).where("not confirmed").select("photo_id"), "photo_id", "left_anti")
        hits = hits.persist()
        if self.provider is not None:
            asked = self.store.spark.createDataFrame([(p,) for p in {e[0] for e in exemplars}], "photo_id string")
            missing_keypoints(self.store, self.provider, hits.select("photo_id").unionByName(asked))
        candidates = self._candidates(hits, exemplars).persist()
        accepted = F.col("x1").isNotNull() & gate.accept(F.col("inliers"), F.col("matches"), self.min_inliers, self.min_fraction)
        name = object_id or uuid.uuid4().hex
        if not object_id or not self.exemplar_count(object_id):
            self._append(name, source.photo_id, True, box)
        matches = candidates.where(accepted).withColumn("object_id", F.lit(name))
        placed = matches.withColumn("place", F.row_number().over(T.ordered("object_id", "stage_one")))
        return Answer(name, placed.orderBy("place"), T.last_seen(matches, tie="stage_one"), candidates)

    def _recall(self, exemplars: list[tuple[str, Box]], top_k: int) -> DataFrame:
        """Stage one with all exemplars, over the regions of photos that are still there."""
        spark, vectors = self.store.spark, []
        for photo, box in exemplars:
            x1, y1, x2, y2 = box
            grown = [(max(0.0, x1 - (x2 - x1) * s), max(0.0, y1 - (y2 - y1) * s), min(1.0, x2 + (x2 - x1) * s), min(1.0, y2 + (y2 - y1) * s)) for s in G.DILATIONS]
            vectors += self.features.vectors(photo, grown)
        regions = self.store.table("regions").select(F.xxhash64("photo_id", "region_no").alias("row_id"), "photo_id", "vec")
        queries = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "query_no int, vec array<float>")
        return R.recall(regions, queries, top_k, photos=self.store.table("photos"))

    def _verified(self, exemplars: list[tuple[str, Box]], shortlist: DataFrame) -> DataFrame:
        """Detections of every exemplar in every shortlisted photo.

        Exemplars' features are broadcast in blocks of a bounded few; a photo's keypoints are one group, bounded by the detector.
        """
        photos = self.store.table("photos").select("photo_id", "width", "height")
        sized = photos.where("width is not null").join(shortlist.select("photo_id"), "photo_id", "left_semi")
        points = self.store.table("keypoints").join(F.broadcast(sized), "photo_id")

        groups = points.select("photo_id", "kp_no", "x", "y", "desc", "width", "height").groupBy("photo_id")

        def verified(crops: list[tuple]) -> DataFrame:
            shared = self.store.spark.sparkContext.broadcast(crops)
            verifier, affine = self.verifier, self.affine

            def run(pdf: pd.DataFrame) -> pd.DataFrame:
                first = pdf.iloc[0]
                pdf = pdf.sort_values("kp_no")
                places, theirs = pdf[["x", "y"]].to_numpy(), np.array(pdf["desc"].tolist(), dtype=float)
                rows = []
                for number, xy, desc, size in shared.value:
                    pairs = ratio_matches(desc, theirs)
                    found = verifier(xy[pairs[:, 0]], places[pairs[:, 1]], size, (first.width, first.height), affine=affine)
                    rows += [(first.photo_id, number, n, f["inliers"], f["matches"], f["scale"], *(f["box"] or [None] * 4)) for n, f in enumerate(found)]
                out = pd.DataFrame(rows, columns=["photo_id", "exemplar_no", "detection", "inliers", "matches", "scale", "x1", "y1", "x2", "y2"])
                return out.astype({c: "float64" for c in ("scale", "x1", "y1", "x2", "y2")})

            return groups.applyInPandas(run, f"photo_id string, exemplar_no int, {K.VERIFIED}")

        out, number = None, 0
        for lo in range(0, len(exemplars), EXEMPLAR_BLOCK):
            block, crops = exemplars[lo : lo + EXEMPLAR_BLOCK], []
            sizes = {r.photo_id: r for r in photos.where(F.col("photo_id").isin([p for p, _ in block])).collect()}
            for photo, box in block:
                if sizes[photo].width is None:  # a format that no provider has read
                    continue
                xy, desc, size = self.features.keypoints(photo, box, sizes[photo].width, sizes[photo].height)
                if len(desc):
                    crops.append((number, xy, desc, size))
                    number += 1
            if crops:
                part = verified(crops)
                out = part if out is None else out.unionByName(part)
        return verified([]) if out is None else out

    def _candidates(self, hits: DataFrame, exemplars: list[tuple[str, Box]]) -> DataFrame:
        """Shortlisted photos with their best exemplar's first detection, and how many detections pass the gate."""
        verified = self._verified(exemplars, hits).persist()
        own = self.store.spark.createDataFrame([(p, *b) for p, b in dict(reversed(exemplars)).items()], "photo_id string, e1 double, e2 double, e3 double, e4 double")
        first = verified.where("detection = 0")
        best = K.best_exemplar(first, hits, own, gate.STRONG_INLIERS)
        passed = F.count_if(gate.accept(F.col("inliers"), F.col("matches"), self.min_inliers, self.min_fraction))
        several = verified.groupBy("photo_id", "exemplar_no").agg(passed.alias("detections"))
        box = first.select("photo_id", "exemplar_no", "scale", "x1", "y1", "x2", "y2")
        photos = self.store.table("photos").select("photo_id", "path", "taken_at", "gps")
        joined = best.join(box, ["photo_id", "exemplar_no"], "left").join(several, ["photo_id", "exemplar_no"], "left").join(F.broadcast(own), "photo_id", "left")
        ranked = hits.select("photo_id", "score").join(joined, "photo_id").join(photos, "photo_id")
        stage_one = F.row_number().over(R.Window.orderBy(F.desc("score"), "photo_id"))  # at most top_k rows
        return ranked.select(
            "photo_id", "path", "score", "inliers", "matches", *[F.coalesce(a, b).alias(a) for a, b in (("x1", "e1"), ("y1", "e2"), ("x2", "e3"), ("y2", "e4"))],
            F.coalesce("scale", F.lit(0.0)).alias("scale"), F.coalesce("detections", F.lit(0)).alias("detections"), "taken_at", "gps", stage_one.alias("stage_one"),
        )


def ratio_matches(query: np.ndarray, theirs: np.ndarray, ratio: float = K.RATIO) -> np.ndarray:
    """Pairs (query keypoint, candidate keypoint) whose nearest neighbour is clearly nearer than the second, exactly."""
    if len(query) < 2 or len(theirs) < 2:
        return np.zeros((0, 2), dtype=int)
    out = []
    for lo in range(0, len(query), 512):
        part = query[lo : lo + 512]
        d2 = np.maximum((part**2).sum(1)[:, None] + (theirs**2).sum(1)[None, :] - 2 * part @ theirs.T, 0)
        two = np.argpartition(d2, 1, axis=1)[:, :2]
        near = np.take_along_axis(d2, two, axis=1)
        swap = near[:, 0] > near[:, 1]
        two[swap], near[swap] = two[swap][:, ::-1], near[swap][:, ::-1]
        good = np.flatnonzero(np.sqrt(near[:, 0]) < ratio * np.sqrt(near[:, 1]))
        out.append(np.column_stack([good + lo, two[good, 0]]))
    return np.concatenate(out)
