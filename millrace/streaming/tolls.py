"""The toll chain on a stream: segment changes by vehicle, then minutes of each segment that turn with the watermark.

The first step emits changes as they come; the second holds a segment's last minutes (vehicles' speeds, counts, accidents ahead) and
its changes, and settles a change once the watermark has passed the begin of its minute, when all of the minute before is known.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.road import EXIT_LANE, SEGMENT
from . import kind_of, ordered_columns, with_null_marks
from .joins import _frame

REPORT, CHANGE, ACCIDENT = range(3)
MINUTE_MS = 60_000
#: Parts that vehicles are dealt to.
SHARDS = 64
#: Segments ahead that an accident closes to tolls, its own included.
AHEAD = 5


class SegmentChanges(StatefulProcessor):
    """The last segment of each of a shard's vehicles; emits the reports that differ from it, with their event time."""

    def __init__(self, order: list[str], names: list[str]):
        self.order, self.names = order, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getListState("last", "vid long, segment long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(rows)
        columns = ordered_columns(pdf, self.order)
        last, out = dict(map(tuple, self.last.get())) if self.last.exists() else {}, []
        for i, (vid, segment) in enumerate(zip(columns["vid"], columns["segment"], strict=True)):
            if segment != last.get(vid):
                out.append(tuple(columns[n][i] for n in self.names))
            last[vid] = segment
        self.last.put([(int(v), int(s)) for v, s in last.items()])
        frame = _frame(out, self.names)
        yield frame.assign(at=pd.to_datetime(frame["at"]).astype(pdf["at"].dtype))

    def close(self) -> None:
        pass


class SegmentMinutes(StatefulProcessor):
    """A segment's minutes: state is a few minutes of vehicles and the changes that wait; timers turn the minute."""

    def __init__(self, names: list[str], zero_ms: int, min_count: int, slow: int, minutes: int, max_values: int | None):
        self.names, self.zero_ms, self.min_count, self.slow, self.minutes, self.max_values = names, zero_ms, min_count, slow, minutes, max_values

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # reports by vehicle: sum and count of speeds; changes: event and vehicle; accidents
        self.rows = handle.getListState("rows", "kind int, minute long, id long, a long, b long")

    def _begin(self, minute: int) -> int:
        return self.zero_ms + (minute - 1) * MINUTE_MS

    def _load(self) -> tuple[dict, dict, set]:
        speeds, changes, accidents = {}, {}, set()
        for kind, minute, i, a, b in map(tuple, self.rows.get()) if self.rows.exists() else ():
            if kind == REPORT:
                speeds[minute, i] = (a, b)
            elif kind == CHANGE:
                changes[minute, i] = a
            else:
                accidents.add(minute)
        return speeds, changes, accidents

    def _keep(self, speeds: dict, changes: dict, accidents: set) -> None:
        rows = [(REPORT, m, i, a, b) for (m, i), (a, b) in speeds.items()] + [(CHANGE, m, i, a, 0) for (m, i), a in changes.items()] + [(ACCIDENT, m, 0, 0, 0) for m in accidents]
        if rows:
            self.rows.put(rows)
        else:
            self.rows.clear()

    def _tolls(self, asked: set, speeds: dict, accidents: set) -> dict:
        """Speed and toll of changes in each minute asked for, from the minutes before: a minute's vehicles are sorted once."""
        minutes: dict = {}
        for (m, vehicle), (total, n) in speeds.items():
            minutes.setdefault(m, []).append((vehicle, total // n, n))
        cars = {m: sum(n for _, _, n in seen) for m, seen in minutes.items()}
        means = {m: [mean for _, mean, _ in sorted(seen)][: self.max_values] for m, seen in minutes.items()}
        found = {}
        for minute in asked:
            now = cars.get(minute - 1, 0)
            recent = [mean for m in range(minute - self.minutes, minute) for mean in means.get(m, ())] if now else []
            recent = recent[: self.max_values]
            speed = sum(recent) // len(recent) if recent else 0
            due = speed < self.slow and now > self.min_count and minute - 1 not in accidents
            found[minute] = speed, 2 * (now - self.min_count) ** 2 if due else 0
        return found

    def _settle(self, key, mark: int, speeds: dict, changes: dict, accidents: set) -> list[tuple]:
        """Tolls of the changes whose minute has begun by the watermark; minutes that no later change needs go.

        What stays waits for one timer, at the first minute that turns: the watermark may pass many at once, and each timer reads all of the state.
        """
        tolls = self._tolls({m for m, _ in changes if self._begin(m) <= mark}, speeds, accidents)
        out = [(event, changes[minute, event], minute, *key, *tolls[minute]) for minute, event in sorted(changes) if minute in tolls]
        gone = {m for m in {m for m, _ in speeds} | accidents if self._begin(m + self.minutes + 1) <= mark}
        speeds, changes, accidents = {k: v for k, v in speeds.items() if k[0] not in gone}, {k: v for k, v in changes.items() if k[0] not in tolls}, accidents - gone
        self._keep(speeds, changes, accidents)
        turns = {self._begin(m) for m, _ in changes} | {self._begin(m + self.minutes + 1) for m in {m for m, _ in speeds} | accidents}
        if turns:
            self.handle.registerTimer(min(turns))
        return out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        columns = ordered_columns(pd.concat(rows), [])
        speeds, changes, accidents = self._load()
        for kind, minute, i, a in zip(columns["kind"], columns["minute"], columns["id"], columns["a"], strict=True):
            if kind == REPORT:
                total, n = speeds.get((minute, i), (0, 0))
                speeds[minute, i] = (total + a, n + 1)
            elif kind == CHANGE:
                changes[minute, i] = a
            else:
                accidents.add(minute)
        yield _frame(self._settle(key, timerValues.getCurrentWatermarkInMs(), speeds, changes, accidents), self.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield _frame(self._settle(key, timerValues.getCurrentWatermarkInMs(), *self._load()), self.names)

    def close(self) -> None:
        pass


def segment_reports(reports: DataFrame, *, accidents: bool) -> DataFrame:
    """Reports under their segment and, with ``accidents``, stopped vehicles under each segment that they close to tolls."""
    own = F.struct(F.lit(REPORT).alias("kind"), F.col("segment").cast("long").alias("at_segment"), F.col("vid").cast("long").alias("id"), F.col("speed").cast("long").alias("a"))
    if not accidents:
        spread = reports.withColumn("x", own)
    else:
        step = F.when(F.col("direction") == 0, 1).otherwise(-1)
        behind = F.transform(F.sequence(F.lit(0), F.lit(AHEAD - 1)), lambda i: F.struct(F.lit(ACCIDENT).alias("kind"), (F.col("segment") - step * i).cast("long").alias("at_segment"), F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("a")))
        spread = reports.withColumn("x", F.explode(F.when(F.col("speed") == 0, F.concat(F.array(own), behind)).otherwise(F.array(own))))
    return spread.select("xway", "direction", F.col("x.at_segment").alias("segment"), "minute", "x.kind", "x.id", "x.a", "at")


def tolls(reports: DataFrame, *, at: str, order: list[str], zero: int, delay: str = "1 second", min_count: int = 50, slow: int = 50, minutes: int = 5, max_values: int | None = 11, accidents: bool = False) -> DataFrame:
    """The stream twin of ``toll``: event_id, vid, minute, the segment's columns, speed and toll.

    Reports come in the order of each vehicle's time, cut into micro-batches in any way; ``at`` is the event time of their ``minute``
    (minute 1 begins ``zero`` seconds past the epoch, which is to lie before all reports: Spark takes a time of 0 for late). A change leaves once the watermark, ``delay`` behind the latest report, has reached its minute:
    changes of the last minute wait for reports to come. Reports without a time, vehicle, segment or speed are left out.
    """
    whole = reports.where(" and ".join(f"{c} is not null" for c in (at, "vid", "minute", "speed", *SEGMENT))).withColumn("at", F.col(at)).withWatermark("at", delay)
    names = ["event_id", "vid", "minute", *SEGMENT, "at"]
    moving = whole.where(F.col("lane") != EXIT_LANE).select("vid", "event_id", "minute", *[c for c in SEGMENT], *[c for c in order if c not in ("event_id", "at")], "at")
    schema = ", ".join(f"{n} {kind_of(whole, n)}" for n in names)
    # a micro-batch calls Python once for a shard and not once for a vehicle
    dealt = with_null_marks(moving.withColumn("shard", F.pmod(F.xxhash64("vid"), F.lit(SHARDS)).cast("int")), ["shard"])
    changes = dealt.groupBy("shard").transformWithStateInPandas(statefulProcessor=SegmentChanges(order, names), outputStructType=schema, outputMode="append", timeMode="EventTime", eventTimeColumnName="at")
    tagged = changes.select(*SEGMENT, "minute", F.lit(CHANGE).alias("kind"), F.col("event_id").alias("id"), F.col("vid").cast("long").alias("a"), "at")
    both = segment_reports(whole, accidents=accidents).unionByName(tagged).withColumn("segment", F.col("segment").cast("long"))
    out = ["event_id", "vid", "minute", *SEGMENT, "speed", "toll"]
    kinds = ", ".join(f"{n} {kind_of(both, n) if n in (*SEGMENT, 'minute') else 'long'}" for n in out)
    return with_null_marks(both, SEGMENT).groupBy(*SEGMENT).transformWithStateInPandas(statefulProcessor=SegmentMinutes(out, zero * 1000, min_count, slow, minutes, max_values), outputStructType=kinds, outputMode="append", timeMode="EventTime")
