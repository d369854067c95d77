"""Structured Streaming over a table's commits: new data as a stream, and triggers fed by it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from sluice.automation import Event, EventType, Triggers


def changes(spark: SparkSession, folder: str, schema: StructType, max_files: int | None = None) -> DataFrame:
    """The Parquet files that arrive in a folder (of one table's commits, at any depth) as a stream."""
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


def to_batches(stream: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Runs a function on each micro-batch; progress is kept in ``checkpoint``."""
    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def fire_on_arrival(stream: DataFrame, table: str, triggers: Triggers, checkpoint: str) -> StreamingQuery:
    """Fires a table's after-insert triggers with each micro-batch's number of rows."""

    def run(batch: DataFrame, batch_id: int) -> None:
        triggers.fire(Event(EventType.AFTER_INSERT, table, {"rows": batch.count(), "batch": batch_id}), rows=False)

    return to_batches(stream, run, checkpoint)
