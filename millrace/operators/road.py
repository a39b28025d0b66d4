"""Highway tolls from position reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import along, only_own

SEGMENT = ["xway", "direction", "segment"]
#: Fixed value: the lane of exits.
EXIT_LANE = 4


def avg_speed_vehicle_minute(reports: DataFrame) -> DataFrame:
    """Whole mean speed of each vehicle in each minute and segment."""
    return reports.groupBy("vid", "minute", *SEGMENT).agg(F.floor(F.sum("speed") / F.count("speed")).alias("avg_speed"))


def avg_speed_literal(reports: DataFrame, *, order: str = "time", tie: str = "event_id") -> DataFrame:
    """Each report with its vehicle's speed before: a mean that is flushed at every report is of one."""
    rows, w = along(reports, ["vid"], order, [tie], 1)
    return only_own(rows.withColumn("avg_speed", F.lag("speed").over(w))).where("avg_speed is not null").drop("n")


def count_vehicles_minute(reports: DataFrame, *, min_count: int = 50) -> DataFrame:
    """Reports of each segment and minute, where there are more than ``min_count``."""
    return reports.groupBy("minute", *SEGMENT).agg(F.count("*").alias("count")).where(F.col("count") > min_count)


def last_avg_speed(speeds: DataFrame, *, minutes: int = 5, max_values: int | None = 11) -> DataFrame:
    """For the minute after each segment's minute: whole mean of the vehicles' mean speeds in its last ``minutes`` minutes.

    Only the first ``max_values`` speeds count, by minute and vehicle; None takes all. Speeds are gathered under
    each output minute, so that no list is longer than ``max_values``.
    """
    present = speeds.select(*SEGMENT, "minute").distinct()
    spread = speeds.withColumn("out", F.explode(F.sequence(F.col("minute"), F.col("minute") + minutes - 1))).join(present.withColumnRenamed("minute", "out"), [*SEGMENT, "out"])
    if max_values is not None:
        w = Window.partitionBy(*SEGMENT, "out").orderBy("minute", "vid")
        spread = spread.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= max_values)
    means = spread.groupBy(*SEGMENT, "out").agg(F.floor(F.sum("avg_speed") / F.count("*")).alias("lav"))
    return means.select(*SEGMENT, (F.col("out") + 1).alias("minute"), "lav")


def segment_changes(reports: DataFrame, *, order: str = "time", tie: str = "event_id") -> DataFrame:
    """Reports off the exit lane whose segment differs from the vehicle's last such report."""
    rows, w = along(reports.where(F.col("lane") != EXIT_LANE), ["vid"], order, [tie], 1)
    changed = only_own(rows.withColumn("_last", F.lag("segment").over(w)))
    return changed.where("_last is null or _last <> segment").drop("_last", "n")


def toll_minute_state(changes: DataFrame, lavs: DataFrame, counts: DataFrame) -> DataFrame:
    """Changes with the speed known for their minute and the count of the minute before."""
    with_lav = changes.join(lavs, [*SEGMENT, "minute"], "left")
    return with_lav.join(counts.select(*SEGMENT, (F.col("minute") + 1).alias("minute"), F.col("count").alias("cars")), [*SEGMENT, "minute"], "left")


def toll(reports: DataFrame, *, min_count: int = 50, slow: int = 50, accidents: DataFrame | None = None) -> DataFrame:
    """Toll of each segment change: 2 (cars - min_count)^2 where traffic is slow and dense and no accident lies in the next five segments.

    ``accidents`` (minute and segment columns) is empty by default; an accident counts for the minute after its own.
    """
    state = toll_minute_state(segment_changes(reports), last_avg_speed(avg_speed_vehicle_minute(reports)), count_vehicles_minute(reports, min_count=min_count))
    clear = F.lit(True)
    if accidents is not None:
        step = F.when(F.col("direction") == 0, 1).otherwise(-1)
        near = accidents.select("xway", "direction", (F.col("minute") + 1).alias("minute"), F.col("segment").alias("_s"))
        ahead = state.select("event_id", "xway", "direction", "minute", F.explode(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.col("segment") + step * i)).alias("_s"))
        blocked = ahead.join(near, ["xway", "direction", "minute", "_s"], "left_semi").select("event_id").distinct().withColumn("_blocked", F.lit(True))
        state = state.join(blocked, "event_id", "left")
        clear = F.col("_blocked").isNull()
    due = (F.coalesce("lav", F.lit(0)) < slow) & (F.coalesce("cars", F.lit(0)) > min_count) & clear
    amount = F.when(due, 2 * (F.col("cars") - min_count) * (F.col("cars") - min_count)).otherwise(0)
    return state.select("event_id", "vid", "minute", *SEGMENT, F.coalesce("lav", F.lit(0)).alias("speed"), amount.alias("toll"))
