"""Runs that start again where they stopped, and event streams, over folders of JSON Lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import agent


def resumable(
    spark: SparkSession, source: str, schema: T.StructType, work: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, files_at_once: int = 1000
) -> StreamingQuery:
    """Works off the files of a folder that are new since the last run, then stops; call it again for the rest.

    Each micro-batch is written whole under its number, so a batch that runs again replaces what it wrote before.
    """

    def write(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).json(source)
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def results(spark: SparkSession, sink: str, schema: T.StructType | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(sink).drop("batch")


def event_stream(requests: DataFrame, key: str = "id", size: int = 24) -> DataFrame:
    """The service's events of a stream (or table) of finished requests, row by row."""
    return agent.service_events(requests, key, size)


def windowed_counts(events: DataFrame, at: str, width: str, late: str, by: str) -> DataFrame:
    """An extension: counts of events by time window; rows later than the watermark are left out of finished windows."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), by).agg(F.count("*").alias("n"))
