"""Incremental ingestion: what arrived since the last run is judged or stored once.

An extension: the batch pipeline keeps its state by rewriting files after each item; here a checkpoint and
a keyed table do that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracewright.sources.sinks import append_keyed


def store_new(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """All files of `source` that no run has seen, in one run; rows whose key is stored are left out."""
    rows = spark.readStream.schema(schema).parquet(source)

    def batch(df: DataFrame, _: int) -> None:
        append_keyed(df.dropDuplicates(keys), target, keys)

    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()


def late_counts(events: DataFrame, time: str = "ts", window: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Events by type and window with a watermark, for streams as for tables."""
    rows = events.withWatermark(time, delay) if events.isStreaming else events
    return rows.groupBy(F.window(time, window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))
