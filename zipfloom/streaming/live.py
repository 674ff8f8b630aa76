"""Streams: live scores of the latest text of each session, windowed event counts, and orphan tracking."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.orphans import OrphanState


def latest_per_key(rows: DataFrame, key: str, generation: str) -> DataFrame:
    """The row of the highest generation of each key; earlier ones are superseded."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max(F.struct(F.col(generation).alias("_g"), *rest)).alias("m")).select(key, *[f"m.{c}" for c in rest])


def live_scores(stream: DataFrame, score: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], key: str, generation: str, checkpoint: str, delay: str = "300 milliseconds") -> StreamingQuery:
    """Scores, each interval, only the latest text of each key. `score` is any batch operator of this library."""

    def each(batch: DataFrame, epoch: int) -> None:
        sink(score(latest_per_key(batch, key, generation)), epoch)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(processingTime=delay).start()


def windowed_counts(events: DataFrame, time: str, kind: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, kind, n): append mode closes a window once the watermark passes its end."""
    e = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return e.groupBy(F.window(time, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), kind, "n")


def orphan_stream(concepts: DataFrame, aliases: DataFrame, path: str, checkpoint: str) -> list[StreamingQuery]:
    """Feeds arriving concepts and aliases into the orphan state at `path`, a batch at a time each.

    The state notes each feed's batch with what the batch changed, so a stream started again goes on from both its
    checkpoint and the state, and a batch that is delivered again counts once.
    """
    lock, state = threading.Lock(), OrphanState(concepts.sparkSession, path)
    none = {"c": aliases.sparkSession.createDataFrame([], aliases.schema), "a": concepts.sparkSession.createDataFrame([], concepts.schema)}

    def feed(batch: DataFrame, epoch: int, which: str) -> None:
        with lock:
            if which == "c":
                state.update(batch, none["c"], which, epoch)
            else:
                state.update(none["a"], batch, which, epoch)

    one = lambda df, w: df.writeStream.foreachBatch(lambda b, e: feed(b, e, w)).option("checkpointLocation", f"{checkpoint}/{w}").trigger(availableNow=True).start()
    return [one(concepts, "c"), one(aliases, "a")]
