"""Event windows and incremental ingest with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_windows(events: DataFrame, width: str = "1 day", slide: str | None = None) -> DataFrame:
    """Counts and sums by window and type; the same plan for a table and for a stream with a watermark."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
        F.col("w.start").alias("window_start"), "event_type", "n", "total"
    )


def ingest(stream: DataFrame, known: Callable[[], DataFrame], keys: list[str], append: Callable[[DataFrame], None], checkpoint: str):
    """Append rows with new keys only, batch by batch, of all that is there now; a batch that is run again adds nothing."""

    def batch(rows: DataFrame, number: int) -> None:
        append(rows.dropDuplicates(keys).join(known().select(*keys), keys, "left_anti"))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
