"""The daily panel as a stream: events counted by cell and day with a watermark for late ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_counts(events: DataFrame, *, lateness: str = "1 day", time: str = "ts", cell: str = "cell", value: str | None = None) -> DataFrame:
    """``cell, day, y`` of a stream (or table) of events; days close once the watermark has passed them.

    Events later than ``lateness`` behind the newest are dropped, as a stream must; a table is counted whole.
    """
    stamped = events.withColumn(time, F.col(time).cast("timestamp"))
    y = F.count(F.lit(1)) if value is None else F.sum(value)
    marked = stamped.withWatermark(time, lateness) if events.isStreaming else stamped
    return marked.groupBy(F.window(time, "1 day"), cell).agg(y.alias("y")).select(cell, F.to_date("window.start").alias("day"), "y")
