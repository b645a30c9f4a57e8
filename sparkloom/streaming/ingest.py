"""Streams into the index: an extension, for files that keep arriving, and event windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkloom.operators import chunking


def index_stream(files: DataFrame, checkpoint: str, upsert: Callable[[DataFrame], None], chunk: Callable[[DataFrame], DataFrame] = chunking.chunk_files) -> StreamingQuery:
    """Chunk a stream of files batch by batch.  Chunk ids are made from content, so a batch that runs again changes nothing."""

    def each(batch: DataFrame, _: int) -> None:
        upsert(chunk(batch))

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _timed(events: DataFrame, time: str) -> DataFrame:
    """Watermarks need a time with a zone; one without is read in the session's."""
    return events.withColumn(time, F.col(time).cast("timestamp")) if dict(events.dtypes)[time] == "timestamp_ntz" else events


def windowed(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "2 hours", time: str = "ts", by: str = "event_type", value: str = "value") -> DataFrame:
    """Counts and sums by event-time window and key; works on streams and on tables alike."""
    window = F.window(time, length, slide) if slide else F.window(time, length)
    return _timed(events, time).withWatermark(time, late).groupBy(window.alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours", time: str = "ts", by: str = "user_id") -> DataFrame:
    """Sessions of a key: runs of events with no pause of ``gap``."""
    grouped = _timed(events, time).withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), by)
    return grouped.agg(F.count(F.lit(1)).alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def fresh(chunks: DataFrame, late: str = "1 day", time: str = "arrived") -> DataFrame:
    """A stream of chunks without those that came already within ``late``."""
    return chunks.withWatermark(time, late).dropDuplicatesWithinWatermark(["chunk_id"])
