"""Matching as records arrive: micro-batches against the stored records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def deduplicated(events: DataFrame, key: str, time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Each key once, as long as it comes within ``delay``; state of older keys is dropped."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, by: list[str], time: str = "ts", width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Arrivals per window; windows close when the watermark has passed them."""
    return events.withWatermark(time, delay).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"))


def on_arrival(new: DataFrame, match: Callable[[DataFrame, str], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs a batch match of each micro-batch of new records, of either type, against the other type.

    ``match(records, target_type)`` is the batch pipeline; ``sink(matches, epoch)``
    must be idempotent per epoch, as an upsert by pair is.
    """

    def step(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        try:
            for kind, other in (("LOST", "FOUND"), ("FOUND", "LOST")):
                part = batch.filter(F.col("record_type") == kind)
                if not part.isEmpty():
                    sink(match(part, other), epoch)
        finally:
            batch.unpersist()

    return new.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
