"""Structured Streaming twins of the batch operators, with the same step functions.

Row-wise operators (parsers, filters, projections, dimension lookups) run on streams as they are. Here are those
that need watermarks or state.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import ads
from ..operators.frames import frame_means, round_of
from ..operators.road import EXIT_LANE
from ..operators.traffic import AnchoredWindow, SpeedGate

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keep state on disk: keyed processors need it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def campaign_counts(events: DataFrame, dim: DataFrame, *, delay: str = "0 seconds", length: str = "10 seconds") -> DataFrame:
    """Views of each campaign in tumbling windows; in append mode a window leaves once the watermark passes it."""
    views = ads.campaign_views(events.withWatermark("at", delay), dim)
    return ads.window_count(views, length=length)


def word_counts(words: DataFrame) -> DataFrame:
    """Running counts of words, for update or complete mode."""
    return words.groupBy("word").agg(F.count("*").alias("count"))


def new_pairs(calls: DataFrame, *, at: str, keep: str) -> DataFrame:
    """The first call of each caller and callee; a pair is forgotten ``keep`` after it, as a rotating filter would."""
    return calls.withWatermark(at, keep).dropDuplicatesWithinWatermark(["calling", "called"])


def score_join(left: DataFrame, right: DataFrame, *, at: str, within: str) -> DataFrame:
    """Two tagged streams joined on the call; a side waits at most ``within`` for the other."""
    a = left.withWatermark(at, within).alias("a")
    b = right.withWatermark(at, within).withColumnRenamed(at, "_at").alias("b")
    same = (F.col("a.calling") == F.col("b.calling")) & (F.col("a.call_id") == F.col("b.call_id"))
    near = F.expr(f"_at BETWEEN {at} - INTERVAL {within} AND {at} + INTERVAL {within}")
    return a.join(b, same & near).drop(F.col("b.calling"), F.col("b.call_id"), "_at")


class Stepper(StatefulProcessor):
    """Runs a scan over each key's rows of a micro-batch in order.

    ``state`` names the kind of state and its schema: ``value`` is one row of plain values, ``list`` rows of them, ``map`` rows
    by key (key schema, value schema). With ``ttl_ms`` state that hasn't changed for so long expires.
    ``scan`` takes the state (None, a list of rows, or the map state itself), the key and columns as lists, and returns the
    next state (None leaves it) and output columns.
    """

    def __init__(self, state: tuple, order: list[str], scan: Callable, names: list[str], ttl_ms: int | None = None):
        self.kind, self.schemas, self.order, self.scan, self.names, self.ttl_ms = state[0], state[1:], order, scan, names, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        make = {"value": handle.getValueState, "list": handle.getListState, "map": handle.getMapState}[self.kind]
        self.state = make("state", *self.schemas, self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        columns = ordered_columns(pd.concat(rows), self.order)
        if self.kind == "value":
            held = tuple(self.state.get()) if self.state.exists() else None
        elif self.kind == "list":
            held = [tuple(r) for r in self.state.get()] if self.state.exists() else []
        else:
            held = self.state
        held, out = self.scan(held, key, columns)
        if held is not None and self.kind == "value":
            self.state.update(held)
        elif held and self.kind == "list":
            self.state.put(held)
        yield pd.DataFrame({n: pd.Series(c, dtype=object) for n, c in zip(self.names, out, strict=True)}, columns=self.names)

    def close(self) -> None:
        pass


class ShardStepper(StatefulProcessor):
    """``Stepper`` over a shard of keys: a micro-batch calls Python once for a shard and not once for a key, and a shard's states are one packed value."""

    def __init__(self, kind: str, keys: list[str], order: list[str], scan: Callable, names: list[str]):
        self.kind, self.keys, self.order, self.scan, self.names = kind, keys, order, scan, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("states", "states binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        columns = ordered_columns(pd.concat(rows), self.order)
        states = pickle.loads(self.state.get()[0]) if self.state.exists() else {}
        places: dict[tuple, list[int]] = {}
        for i, own in enumerate(zip(*[columns[k] for k in self.keys], strict=True)):
            # NaN is a key that equals itself, in this micro-batch and the next
            places.setdefault(tuple("NaN" if isinstance(v, float) and v != v else v for v in own), []).append(i)
        made: list[list] = [[] for _ in self.names]
        for own, at in places.items():
            held = states.get(own, None if self.kind == "value" else [])
            held, out = self.scan(held, tuple(columns[k][at[0]] for k in self.keys), {c: [v[i] for i in at] for c, v in columns.items()})
            if held is not None if self.kind == "value" else held:
                states[own] = held
            for column, more in zip(made, out, strict=True):
                column.extend(more)
        self.state.update((pickle.dumps(states),))
        yield pd.DataFrame({n: pd.Series(c, dtype=object) for n, c in zip(self.names, made, strict=True)}, columns=self.names)

    def close(self) -> None:
        pass


#: Parts that keys are dealt to where Python takes many keys at once.
SHARDS = 64


def with_null_marks(df: DataFrame, keys: list[str]) -> DataFrame:
    """Numbers that may be null with a mark of their own beside a zero: pandas would turn them to NaN, and long ids to doubles."""
    numbers = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.nullable and f.name not in keys]
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast(df.schema[c].dataType)).alias(c)
    return df.select(*[zero(c) if c in numbers else c for c in df.columns], *[F.col(c).isNull().alias(f"absent_{c}") for c in numbers])


def sorted_rows(pdf: pd.DataFrame, order: list[str]) -> pd.DataFrame:
    """Rows of ``with_null_marks`` in order, nulls first."""
    by = [x for c in order for x in ((f"absent_{c}", False), (c, True)) if x[0] in pdf.columns]
    return pdf.sort_values([c for c, _ in by], ascending=[up for _, up in by], kind="stable") if by else pdf


def without_marks(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows of ``with_null_marks`` with None for null in place of marks."""
    return pd.DataFrame({c: pdf[c].astype(object).where(~pdf[f"absent_{c}"].astype(bool), None) if f"absent_{c}" in pdf.columns else pdf[c] for c in pdf.columns if not c.startswith("absent_")})


def ordered_columns(pdf: pd.DataFrame, order: list[str]) -> dict[str, list]:
    """Rows of ``with_null_marks`` in order, nulls first, as lists with None for null."""
    pdf = sorted_rows(pdf, order)
    columns = {c: pdf[c].tolist() for c in pdf.columns if not c.startswith("absent_")}
    for c in columns:
        if f"absent_{c}" in pdf.columns:
            columns[c] = [None if gone else v for v, gone in zip(columns[c], pdf[f"absent_{c}"].tolist(), strict=True)]
    return columns


def kind_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _stateful(df: DataFrame, keys: list[str], state: tuple, order: list[str], scan: Callable, schema: str, ttl_ms: int | None = None) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    if state[0] != "map" and ttl_ms is None and all(isinstance(df.schema[k].dataType, (T.NumericType, T.StringType)) and not k.startswith("_") for k in keys):
        dealt = with_null_marks(df, []).withColumn("_shard", F.pmod(F.xxhash64(*keys), F.lit(SHARDS)).cast("int"))
        return dealt.groupBy("_shard").transformWithStateInPandas(statefulProcessor=ShardStepper(state[0], keys, order, scan, names), outputStructType=schema, outputMode="append", timeMode="None")
    return with_null_marks(df, keys).groupBy(*keys).transformWithStateInPandas(statefulProcessor=Stepper(state, order, scan, names, ttl_ms), outputStructType=schema, outputMode="append", timeMode="ProcessingTime" if ttl_ms else "None")


def timed(rows: DataFrame, *, mode: str = "event", time: str | None = None, out: str = "at") -> DataFrame:
    """Rows with the time that windows go by: ``event`` takes a column of theirs, ``ingress`` the moment their micro-batch began.

    Event time with a total order of rows gives the same results however a stream is cut; ingress time doesn't.
    """
    if mode not in ("event", "ingress"):
        raise ValueError("mode is event or ingress")
    if mode == "event" and time is None:
        raise ValueError("event time needs a column")
    return rows.withColumn(out, F.col(time).cast("timestamp") if mode == "event" else F.current_timestamp())


def anchored_counts(rows: DataFrame, *, key: str, time: str, order: list[str], length: int, ttl_ms: int | None = None) -> DataFrame:
    """The stream twin of ``win_anchored_count``."""

    def scan(state, k, columns):
        window = AnchoredWindow(length, *(state or ()))
        counts, triggers = window.take([int(t) for t in columns[time]])
        return (window.start, window.count), ([k[0]] * len(counts), counts, triggers)

    return _stateful(rows.where(F.col(time).isNotNull()), [key], ("value", "start long, count long"), order, scan, f"{key} {kind_of(rows, key)}, count long, trigger_ts long", ttl_ms)


def gated_speeds(rows: DataFrame, *, order: list[str], ttl_ms: int | None = None) -> DataFrame:
    """The stream twin of ``speed_outlier_gate``; columns road_id, speed and ``order``, the first of which is kept."""

    def scan(state, k, columns):
        gate = SpeedGate(list(state[0]), state[1]) if state else SpeedGate()
        made = [gate.step(int(s)) for s in columns["speed"]]
        return (gate.speeds, gate.mean), ([k[0]] * len(made), [m for m, _ in made], [n for _, n in made], columns[order[0]])

    return _stateful(rows.where("speed is not null"), ["road_id"], ("value", "speeds array<int>, mean int"), order, scan, f"road_id {kind_of(rows, 'road_id')}, average_speed int, count int, seq {kind_of(rows, order[0])}", ttl_ms)


def decayed_counts(rows: DataFrame, *, key: str, time: str, order: list[str], amount: str, beta: float, ttl_ms: int | None = None) -> DataFrame:
    """The stream twin of ``decayed``: one sum and its time for each key. A null amount counts 0; a row without a time gets null."""

    def scan(state, k, columns):
        value, last, out = *(state or (0.0, None)), []
        for at, x in zip(columns[time], columns[amount], strict=True):
            if at is not None:
                value, last = float(x or 0.0) + (value * beta ** (at - last) if last is not None else 0.0), int(at)
            out.append(None if at is None else value)
        return None if last is None else (value, last), ([k[0]] * len(out), columns[order[-1]], out)

    return _stateful(rows, [key], ("value", "value double, at long"), order, scan, f"{key} {kind_of(rows, key)}, row_id {kind_of(rows, order[-1])}, value double", ttl_ms)


def moving_averages(rows: DataFrame, *, key: str, value: str, order: list[str], size: int = 1000, with_value: bool = False, ttl_ms: int | None = None) -> DataFrame:
    """The stream twin of ``moving_avg``, to the last bit: a list of the last values for each key; nulls take a place in it and count nothing. ``with_value`` keeps the row's own.

    A frame is added up as the batch operator does it, in blocks, so that values keep their place among them.
    """
    rounds = round_of(size)

    def scan(state, k, columns):
        now = columns[value]
        first = (state[-1][2] + 1 - len(state)) % rounds if state else 0
        places = np.arange(first, first + len(state) + len(now))
        values = np.array([v for v, _, _ in state] + [float(v or 0.0) for v in now])
        known = np.array([f for _, f, _ in state] + [v is not None for v in now])
        lengths = np.minimum(np.arange(len(state), len(places)) + 1, size)
        means, some = frame_means(places, values, known, lengths, len(state))
        means = [float(m) if any_ else None for m, any_ in zip(means, some, strict=True)]
        kept = [(float(values[i]), bool(known[i]), int(places[i]) % rounds) for i in range(max(0, len(places) - size + 1), len(places))]
        return kept, ([k[0]] * len(now), columns[order[-1]], means, *([now] if with_value else []))

    return _stateful(rows, [key], ("list", "value double, known boolean, place int"), order, scan, f"{key} {kind_of(rows, key)}, row_id {kind_of(rows, order[-1])}, moving_avg double" + (f", {value} {kind_of(rows, value)}" if with_value else ""), ttl_ms)


def seen_callees(rows: DataFrame, *, order: list[str], ttl_ms: int | None = None) -> DataFrame:
    """The stream twin of ``new_pair_flag``: a map of each caller's callees, forgotten ``ttl_ms`` after they were first seen. A null callee is one."""

    def scan(seen, k, columns):
        flags = []
        for callee in map(str, columns["called"]):
            new = not seen.containsKey((callee,))
            if new:
                seen.updateValue((callee,), (True,))
            flags.append(new)
        return None, ([k[0]] * len(flags), columns["called"], columns[order[-1]], flags)

    return _stateful(rows, ["calling"], ("map", "called string", "seen boolean"), order, scan, f"calling {kind_of(rows, 'calling')}, called {kind_of(rows, 'called')}, row_id {kind_of(rows, order[-1])}, new_callee boolean", ttl_ms)


def global_means(rows: DataFrame, *, value: str, order: list[str], age: float = 86400.0, warm: float = 10.0) -> DataFrame:
    """The stream twin of ``ewma_global``: the whole stream is one key with two numbers of state, so one task takes each micro-batch. A null value counts 0."""
    alpha = 2 / (age + 1)

    def scan(state, k, columns):
        (run, mean), out = state or (0.0, None), []
        for v in columns[value]:
            if mean is None:
                run += float(v or 0.0)
                mean = run if run > warm else None
            else:
                mean = (1 - alpha) * mean + alpha * float(v or 0.0)
            out.append(mean if mean is not None and mean > warm else 0.0)
        return (run, mean), (columns[order[-1]], out)

    return _stateful(rows.withColumn("_all", F.lit(0)), ["_all"], ("value", "run double, mean double"), order, scan, f"row_id {kind_of(rows, order[-1])}, average double")


def segment_changes(reports: DataFrame, *, order: list[str], ttl_ms: int | None = None) -> DataFrame:
    """The stream twin of the toll chain's first step: reports off the exit lane whose segment differs from the vehicle's last such report, or that follow one without a segment."""

    def scan(state, k, columns):
        last, ids, segments = state[0] if state else None, [], []
        for i, s in zip(columns[order[-1]], columns["segment"], strict=True):
            if last is None or (s is not None and s != last):
                ids.append(i)
                segments.append(s)
            last = s
        return (last,), ([k[0]] * len(ids), ids, segments)

    rows = reports.where(F.col("lane") != EXIT_LANE)
    return _stateful(rows, ["vid"], ("value", "segment long"), order, scan, f"vid {kind_of(rows, 'vid')}, row_id {kind_of(rows, order[-1])}, segment long", ttl_ms)


def by_batch(rows: DataFrame, operator: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Run an operator whose rows don't depend on each other, such as the map match, over each micro-batch; results are Parquet.

    A micro-batch that is run again after a failure overwrites what it wrote.
    """

    def each(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tagged_late(rows: DataFrame, *, source: str, time: str, order: list[str], length: int, delay: int = 0) -> DataFrame:
    """Every row of a source with ``late``: Spark itself only counts the rows that its watermark drops. A row without a time isn't late."""

    def scan(state, k, columns):
        top, flags = state[0] if state else None, []
        for at in columns[time]:
            flags.append(at is not None and top is not None and (at // length + 1) * length <= top - delay)
            top = at if top is None else max(at, top) if at is not None else top
        return (top,), ([k[0]] * len(flags), columns[order[-1]], flags)

    return _stateful(rows, [source], ("value", f"top {kind_of(rows, time)}"), order, scan, f"{source} {kind_of(rows, source)}, row_id {kind_of(rows, order[-1])}, late boolean")


def count_sink(df: DataFrame, name: str, checkpoint: str, *, stamp: str | None = None) -> tuple:
    """Drain a stream, counting the rows of each micro-batch and, given their source's time ``stamp``, their mean and greatest latency in milliseconds.

    Returns the query and the list that fills, one small entry for each micro-batch.
    """
    seen: list[dict] = []
    delay = F.unix_millis(F.current_timestamp()) - F.unix_millis(F.col(stamp)) if stamp else F.lit(None).cast("long")

    def each(batch: DataFrame, number: int) -> None:
        rows, mean, worst = batch.agg(F.count("*"), F.avg(delay), F.max(delay)).first()
        seen.append({"batch": number, "rows": rows, "mean_latency": mean, "worst_latency": worst})

    return df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).queryName(name).trigger(availableNow=True).start(), seen
