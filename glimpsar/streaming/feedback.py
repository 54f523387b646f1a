"""Feedback as a stream: each object's state is kept between batches and folded on."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.feedback import replay

OUTPUT = "object_id long, exemplars array<long>, box_seqs array<long>, rejected array<long>"


def _update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    boxes = {int(p): s for p, s in json.loads(state.get[0])} if state.exists else {}
    events = pd.concat(list(batches), ignore_index=True).sort_values("seq")
    replay(((e.kind, int(e.photo_id), int(e.seq)) for e in events.itertuples(index=False)), boxes)
    state.update((json.dumps(list(boxes.items())),))
    views = [p for p, s in boxes.items() if s is not None]
    yield pd.DataFrame({"object_id": [key[0]], "exemplars": [views], "box_seqs": [[boxes[p] for p in views]], "rejected": [[p for p, s in boxes.items() if s is None]]})


def feedback_stream(events: DataFrame) -> DataFrame:
    """The state of every object that a batch of events (``object_id``, ``photo_id``, ``seq`` and ``kind`` or ``confirmed``) touches.

    ``kind`` is seed, confirm or reject; ``box_seqs`` are the events whose boxes the exemplars are known by.
    """
    if "kind" not in events.columns:
        events = events.withColumn("kind", F.when(F.col("confirmed"), "confirm").otherwise("reject"))
    return events.select("object_id", "photo_id", "seq", "kind").groupBy("object_id").applyInPandasWithState(
        _update, OUTPUT, "boxes string", "update", GroupStateTimeout.NoTimeout
    )


def append_stream(arrivals: DataFrame, write, checkpoint: str):
    """Arriving rows handed to ``write(batch, number)`` batch by batch.

    A file source tells of arrivals only: what is changed or gone is found by comparing scans.
    """
    return arrivals.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
