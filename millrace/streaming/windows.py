"""Time windows over event streams, batch or streaming; beyond what the SQL surface asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, time: str, width: str, slide: str | None = None, late: str | None = None, keys: tuple[str, ...] = (), value: str = "value") -> DataFrame:
    """Counts and sums per window. With ``late``, a stream drops what comes later than that and state stays bounded."""
    rows = events.withWatermark(time, late) if late else events
    span = F.window(time, width, slide) if slide else F.window(time, width)
    out = rows.groupBy(span.alias("span"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("span.start").alias("start"), F.col("span.end").alias("stop"), *keys, "n", "total")


def sessions(events: DataFrame, time: str, gap: str, key: str, late: str | None = None) -> DataFrame:
    """Runs of events of a key without a gap longer than ``gap``."""
    rows = events.withWatermark(time, late) if late else events
    out = rows.groupBy(F.session_window(time, gap).alias("span"), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("span.start").alias("start"), F.col("span.end").alias("stop"), "n")
