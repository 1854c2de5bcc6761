"""Streams: typed ingestion, windows with late data, sessions, idempotent sinks, progress."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..plans.tables import Table


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A stream of Parquet files with an event time that a watermark accepts."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def parsed(events: DataFrame) -> DataFrame:
    """Typed fields of the payload; malformed payloads are dropped."""
    v = F.try_parse_json("props")
    return events.filter(v.isNotNull()).withColumn("k", F.try_variant_get(v, "$.k", "long"))


def tumbling(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums by window and type."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("v"))


def daily(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Counts by day; rows of a day that closed before the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"))


def sliding(events: DataFrame, width: str = "2 days", step: str = "1 day", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n"))


def session_counts(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))


def run_once(stream: DataFrame, checkpoint: str, each_batch: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """All that is there now, through a batch function; the checkpoint keeps the position."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each_batch).start().awaitTermination()


def upserting(table: Table, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A sink that may see a batch twice: rows replace those of the same keys, in the files that hold them."""

    def write(batch: DataFrame, epoch: int) -> None:
        table.merge(batch, keys) if table.exists() else table.overwrite(batch)

    return write


def every(stream: DataFrame, checkpoint: str, each_batch: Callable[[DataFrame, int], None], seconds: float = 1, mode: str = "append") -> int:
    """Refreshes at a cadence until all that is there has been read; returns how many batches had rows."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").foreachBatch(each_batch).start()
    try:
        query.processAllAvailable()
        return sum(p["numInputRows"] > 0 for p in query.recentProgress)
    finally:
        query.stop()


def positioned(stream: DataFrame) -> DataFrame:
    """A file stream with the place of each row, as a broker's partition and offset: its file, and its number there."""
    return stream.withColumn("partition", F.col("_metadata.file_name")).withColumn("offset", F.col("_metadata.row_index"))


def maintained(view, applied: Table) -> Callable[[DataFrame, int], None]:
    """Keeps an incremental aggregate up to date from a stream. A batch that is seen twice is applied once: its number is
    written down beside the view, and one that crashed in between is told by the version that the view then has."""

    def write(batch: DataFrame, epoch: int) -> None:
        done = applied.read().agg(F.max("epoch"), F.max_by("version", "epoch")).first() if applied.exists() else (None, None)
        if done[0] is not None and epoch < done[0]:
            return
        now = view.table.version() if view.table.exists() else ""
        if done[0] == epoch and done[1] != now:
            return  # the view has moved on since this batch was noted: it is in
        if done[0] != epoch:
            applied.overwrite(batch.sparkSession.createDataFrame([(epoch, now)], "epoch long, version string"))
        view.refresh(batch) if view.table.exists() else view.create(batch)

    return write


def totals_by_user(events: DataFrame) -> DataFrame:
    """A running count for each user, in state of our own."""
    import pandas as pd

    def step(key, batches, state):
        n = (state.get[0] if state.exists else 0) + sum(len(b) for b in batches)
        state.update((n,))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, n long", "n long", "update", "NoTimeout")


class Progress(StreamingQueryListener):
    """Rows and batches of the session's streams."""

    def __init__(self):
        self.rows = self.batches = 0

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        self.rows += event.progress.numInputRows
        self.batches += 1

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass

    def wait_for(self, rows: int, seconds: float = 20) -> None:
        """Progress is told after the fact."""
        end = time.monotonic() + seconds
        while self.rows < rows and time.monotonic() < end:
            time.sleep(0.05)
