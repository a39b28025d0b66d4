"""Advertising events: view filter, campaign lookup, windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import running

#: A dimension is broadcast up to this many rows, beyond that it joins by shuffle.
BROADCAST_ROWS = 1_000_000


def sized(dim: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The side of a join, broadcast if a count finds it small."""
    return F.broadcast(dim) if dim.limit(most + 1).count() <= most else dim


def filter_event_type(events: DataFrame, event_type: str = "view") -> DataFrame:
    return events.where(F.col("event_type") == event_type)


def join_dim_lookup(events: DataFrame, dim: DataFrame, *, on: str = "ad_id") -> DataFrame:
    """Inner lookup; events without a match are dropped."""
    return events.join(sized(dim), on, "inner")


def campaign_views(events: DataFrame, dim: DataFrame) -> DataFrame:
    """Views with their campaign: what batch and stream share."""
    return join_dim_lookup(filter_event_type(events), dim)


def window_count(rows: DataFrame, *, key: str = "campaign_id", at: str = "at", length: str = "10 seconds", slide: str | None = None) -> DataFrame:
    """Rows of each key in tumbling or sliding event-time windows, with the latest time; works on streams behind a watermark."""
    w = F.window(at, length, slide) if slide else F.window(at, length)
    grouped = rows.groupBy(w.alias("w"), key).agg(F.count("*").alias("count"), F.max(at).alias("last"))
    return grouped.select(key, F.unix_seconds(F.col("w")["start"]).alias("window_start"), "count", F.unix_micros("last").alias("last_us"))


def session_count(rows: DataFrame, *, key: str = "campaign_id", at: str = "at", gap: str = "10 minutes") -> DataFrame:
    """Rows of each key in sessions that end after ``gap`` without a row."""
    grouped = rows.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("count"))
    return grouped.select(key, F.unix_micros(F.col("w")["start"]).alias("session_start_us"), "count")


def watermarks(rows: DataFrame, *, time: str, order: str, delay: int = 0, out: str = "watermark", block: int | None = None) -> DataFrame:
    """Rows in arrival order with the watermark in force as they arrive: the greatest time before them, less ``delay``; null ahead of the first time.

    Rows without a place in the order arrive first; rows without a time move no watermark.
    """
    return running(rows, [], order, [], tops={out: F.col(time)}, own=False, rows=block).withColumn(out, F.col(out) - delay)


def late_rows(rows: DataFrame, *, time: str, order: str, length: int, delay: int = 0, block: int | None = None) -> DataFrame:
    """Rows in arrival order with ``late``: their window of ``length`` had closed by the watermark. A row without a time isn't late."""
    end = (F.floor(F.col(time) / length) + 1) * length
    marked = watermarks(rows, time=time, order=order, delay=delay, out="_mark", block=block)
    return marked.withColumn("late", F.coalesce(end <= F.col("_mark"), F.lit(False))).select(*rows.columns, "late")
