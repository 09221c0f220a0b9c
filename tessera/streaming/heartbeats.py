"""Streams: liveness of nodes, states of jobs, and suggestions for requests as they arrive."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.platform import EXPIRY_MINUTES

EXPIRES_MS = (EXPIRY_MINUTES + 1) * 60_000


def liveness(beats: DataFrame, clock: str = "processing") -> DataFrame:
    """(node_id, state, at_ms): UP on a node's first beat, DOWN once three minutes passed without one; a later beat
    brings it UP again. ``beats`` have node_id and ts. The clock is the server's by default; ``event`` uses the
    watermark of ts instead, for replays."""
    event = clock == "event"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"node_id": [key[0]], "state": ["DOWN"], "at_ms": [last + EXPIRES_MS]})
            return
        newest = max(int(b["ms"].max()) for b in batches)
        if state.exists:
            newest = max(newest, state.get[0])
        else:
            yield pd.DataFrame({"node_id": [key[0]], "state": ["UP"], "at_ms": [newest]})
        state.update((newest,))
        if event:
            state.setTimeoutTimestamp(max(newest + EXPIRES_MS, state.getCurrentWatermarkMs() + 1))
        else:
            state.setTimeoutDuration(EXPIRES_MS)

    rows = beats.where("node_id is not null").withColumn("node_id", F.col("node_id").cast("string")).withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    if event:
        rows = rows.withWatermark("ts", "0 seconds")
    timeout = GroupStateTimeout.EventTimeTimeout if event else GroupStateTimeout.ProcessingTimeTimeout
    return rows.groupBy("node_id").applyInPandasWithState(step, "node_id string, state string, at_ms long", "last long", "append", timeout)


def each_request(profiles: DataFrame, suggest: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, stream: str = "requests", report: Callable[[int, str], None] | None = None):
    """Run ``suggest`` on each micro-batch of profiles and append what it gives to ``path``; a batch that is run again
    after a failure replaces its own rows, and ``stream`` keeps those of several streams on one path apart. ``report``
    is told (percent, message) when a batch begins and ends."""

    def batch(df: DataFrame, number: int) -> None:
        tell = report or (lambda percent, message: None)
        tell(1, f"Batch {number}…")
        rows = suggest(df).withColumns({"stream": F.lit(stream), "batch": F.lit(number)})
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("stream", "batch").parquet(path)
        tell(100, "Done.")

    return profiles.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
