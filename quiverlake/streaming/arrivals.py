"""A stream of arriving edges in front of the update path: each micro-batch is classified against the stored order and appended to a delta.

A batch that is delivered again after a crash is recognised by its number and skipped, so the delta holds each edge once.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.delta import MutableDelta, classify
from ..plans.info import EdgeInfo
from ..plans.types import DST, SRC, AdjListType


def classified_stream(arrivals: DataFrame, info: EdgeInfo, layout: AdjListType | str, frontier: tuple[int, int] | None) -> DataFrame:
    """The stream with arrival_class and vertex_chunk; stateless."""
    return classify(arrivals, info, layout, frontier)


def arrivals_by_window(arrivals: DataFrame, time_column: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts of arrivals by tumbling window and class; late rows beyond the watermark are left out."""
    return arrivals.withWatermark(time_column, late).groupBy(F.window(time_column, width).alias("window"), "arrival_class").agg(F.count("*").alias("n"))


def append_stream(arrivals: DataFrame, delta: MutableDelta, checkpoint: str, **trigger):
    """Start appending a stream of (src, dst) to a delta; each batch is sealed. Returns the streaming query."""
    mark = f"{delta.path}/stream.json"

    def take(batch: DataFrame, number: int) -> None:
        store = delta.store
        done = json.loads(store.read_text(mark)) if store.exists(mark) else {"batch": -1, "end": delta.floor}
        if number <= done["batch"]:
            return
        if done.get("begun") == number and delta.next > done["begun_at"]:
            end = delta.next  # the batch was committed, but the crash came before its mark
        else:
            store.write_text(mark, json.dumps(done | {"begun": number, "begun_at": delta.next}))
            _, end = delta.append_all(batch.select(SRC, DST))
        delta.seal()
        store.write_text(mark, json.dumps({"batch": number, "end": end}))

    return arrivals.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
