"""Incremental pulls as streams: late and repeated events, idempotent upserts, windowed counts, trailing state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plinthwork.sources import sinks

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, folder: str, schema: str = EVENTS, files: int = 1) -> DataFrame:
    """New Parquet files of a folder, a few a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def once(stream: DataFrame, id: str = "event_id", time: str = "ts", lateness: str = "1 day") -> DataFrame:
    """Each event once; state older than the watermark is dropped."""
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark([id])


def windowed(stream: DataFrame, length: str, slide: str | None = None, time: str = "ts", lateness: str = "1 day") -> DataFrame:
    """Counts and sums by tumbling or sliding window and type."""
    w = F.window(time, length, slide) if slide else F.window(time, length)
    return stream.withWatermark(time, lateness).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(stream: DataFrame, gap: str, key: str = "user_id", time: str = "ts", lateness: str = "1 day") -> DataFrame:
    return stream.withWatermark(time, lateness).groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("n"))


def upsert_into(stream: DataFrame, root: str, keys: list[str], newest: str, checkpoint: str) -> StreamingQuery:
    """Merge each batch into a published table; a batch that is run again changes nothing."""
    def apply(batch: DataFrame, _: int) -> None:
        sinks.merge(batch, root, keys, newest)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def matched(stream: DataFrame, masters: DataFrame, key: str) -> DataFrame:
    """New rows with their master, by a stream-static join; rows without one stay, for the next tier."""
    return stream.join(masters, key, "left")
