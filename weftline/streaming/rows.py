"""Row functions under Structured Streaming: the same stateless projections, and windowed counts with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.cleaning import clean


def clean_stream(raw: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """The serving projection on a stream: no aggregation, so no state and no watermark."""
    return clean(raw, targets=False, extra=extra)


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums per window and type; state older than the watermark goes."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    g = timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")
