"""What a user's confirmations and rejections add up to for each object.

Events are kept in a log and folded.  The closed form needs two aggregations: a photo is what its last event says, and its
exemplar box is that of the first confirmation after its last rejection.  ``fold_ordered`` is the step by step
form, for logs in which objects are seeded again in between.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def feedback_state(log: DataFrame) -> DataFrame:
    """``object_id``, ``photo_id``, ``confirmed`` and ``box_seq`` (the event whose box is kept; null if rejected)."""
    by_photo = (
        log.groupBy("object_id", "photo_id")
        .agg(F.max("seq").alias("last"), F.max_by("confirmed", "seq").alias("confirmed"), F.max(F.when(~F.col("confirmed"), F.col("seq"))).alias("rejected_at"))
        .select("object_id", "photo_id", "confirmed", "rejected_at")
    )
    joined = log.where("confirmed").select("object_id", "photo_id", "seq").join(by_photo.where("confirmed"), ["object_id", "photo_id"])
    boxes = joined.where("rejected_at is null or seq > rejected_at").groupBy("object_id", "photo_id").agg(F.min("seq").alias("box_seq"))
    return by_photo.select("object_id", "photo_id", "confirmed").join(boxes, ["object_id", "photo_id"], "left")


def replay(events: Iterable[tuple[str, int, int]], boxes: dict[int, int | None] | None = None) -> dict[int, int | None]:
    """What (kind, photo, seq), in order, make of one object: each photo with the event whose box is its exemplar, or none if it
    is rejected.  ``boxes`` is where earlier events have led to, and is carried on.

    A seed is a confirmation that only an object without any exemplar takes.
    """
    boxes = {} if boxes is None else boxes
    views = sum(seq is not None for seq in boxes.values())
    for kind, photo, seq in events:
        was_view = boxes.get(photo) is not None
        if kind == "reject":
            becomes = None
        elif was_view or (kind == "seed" and views):
            continue
        else:
            becomes = seq
        if becomes is not None or was_view or photo not in boxes:
            boxes.pop(photo, None)  # the latest turn comes last
            boxes[photo] = becomes
        views += (becomes is not None) - was_view
    return boxes


def fold_ordered(log: DataFrame) -> DataFrame:
    """The same state by replaying each object's events (``kind`` is seed, confirm or reject) in order of ``seq``.

    An object's events are those of one user's taps; they are replayed in one task per object.
    """

    def fold(events: pd.DataFrame) -> pd.DataFrame:
        order = events.sort_values("seq")
        boxes = replay(zip(order["kind"], order["photo_id"], order["seq"], strict=True))
        out = pd.DataFrame([(p, s is not None, s) for p, s in boxes.items()], columns=["photo_id", "confirmed", "box_seq"]).astype({"photo_id": "int64", "box_seq": "Int64"})
        out.insert(0, "object_id", events["object_id"].iloc[0])
        return out

    return log.groupBy("object_id").applyInPandas(fold, "object_id long, photo_id long, confirmed boolean, box_seq long")
