"""Joins of streams beyond two sides: values of one key gathered from many streams, and the latest version as of a row."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from . import kind_of, ordered_columns, sorted_rows, with_null_marks, without_marks

_AT = "at_ms"


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pd.DataFrame({n: pd.Series(list(c), dtype=object) for n, c in zip(names, columns, strict=True)}, columns=names)


class Gatherer(StatefulProcessor):
    """A shard's keys with their values by tag: a key's values leave as one row once all are there; a key that isn't whole goes ``within_ms`` after its last value.

    State is a list of the keys that wait, and one timer, at the first of them to go.
    """

    def __init__(self, tags: list[str], keys: list[str], kinds: list[str], within_ms: int):
        self.tags, self.keys, self.kinds, self.within_ms = tags, keys, kinds, within_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        held = [f"k{i} {kind}" for i, kind in enumerate(self.kinds)] + [x for i in range(len(self.tags)) for x in (f"v{i} double", f"h{i} boolean")]
        self.handle, self.state = handle, handle.getListState("waiting", ", ".join([*held, "last long"]))

    def _load(self) -> dict[tuple, tuple[dict, int]]:
        held, n = {}, len(self.keys)
        for row in map(tuple, self.state.get()) if self.state.exists() else ():
            held[row[:n]] = {t: v for t, v, there in zip(self.tags, row[n:-1:2], row[n + 1 : -1 : 2], strict=True) if there}, row[-1]
        return held

    def _keep(self, held: dict[tuple, tuple[dict, int]]) -> None:
        if held:
            self.state.put([(*key, *[x for t in self.tags for x in (values.get(t), t in values)], last) for key, (values, last) in held.items()])
            self.handle.registerTimer(min(last for _, last in held.values()) + self.within_ms)
        else:
            self.state.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        columns = ordered_columns(pd.concat(rows), [_AT])
        held, out = self._load(), []
        for own, tag, value, at in zip(zip(*[columns[k] for k in self.keys], strict=True), columns["tag"], columns["value"], columns[_AT], strict=True):
            values, _ = held.pop(own, ({}, None))
            values[tag] = value
            if len(values) == len(self.tags):
                out.append((*own, *[values[t] for t in self.tags]))
            else:
                held[own] = values, int(at)
        self._keep(held)
        yield _frame(out, [*self.keys, *self.tags])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        self._keep({own: (values, last) for own, (values, last) in self._load().items() if last + self.within_ms > mark})
        yield _frame([], [*self.keys, *self.tags])

    def close(self) -> None:
        pass


def gathered(streams: dict[str, DataFrame], *, keys: list[str], at: str, within: str, shards: int = 64) -> DataFrame:
    """One row for each key once every stream has given its value (the column of its name): keys and a double column for each stream.

    The streams are one, tagged, and keys are dealt to ``shards``, so that a micro-batch calls Python once for a shard and not once for a key. A second
    value of a stream before the row is whole takes the place of the first; after it, it begins a new row. A key that stays in part is
    forgotten ``within`` after its last value, behind a watermark of the same delay. Null values are values; null keys are keys.
    """
    first = next(iter(streams.values()))
    tagged = [s.withWatermark(at, within).select(*keys, F.lit(tag).alias("tag"), F.col(tag).cast("double").alias("value"), F.col(at), F.unix_millis(at).alias(_AT)) for tag, s in streams.items()]
    kinds = [kind_of(first, k) for k in keys]
    schema = ", ".join([f"{k} {kind}" for k, kind in zip(keys, kinds, strict=True)] + [f"{tag} double" for tag in streams])
    within_ms = first.sparkSession.range(1).select(F.expr(f"cast(unix_millis(timestamp_seconds(0) + interval {within}) as long)")).first()[0]
    both = with_null_marks(reduce(DataFrame.unionByName, tagged).withColumn("shard", F.pmod(F.xxhash64(*keys), F.lit(shards)).cast("int")), ["shard"])
    return both.groupBy("shard").transformWithStateInPandas(statefulProcessor=Gatherer(list(streams), keys, kinds, within_ms), outputStructType=schema, outputMode="append", timeMode="EventTime")


class AsOf(StatefulProcessor):
    """One key's rows and versions, held until the watermark has passed them and then released in total order."""

    def __init__(self, names: list[str], order: list[str], value: str, keys: list[str], pending: str, latest: str):
        self.names, self.order, self.value, self.keys, self.pending_schema, self.latest_schema = names, order, value, keys, pending, latest
        self.fields = [f.split()[0] for f in pending.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending, self.latest = handle.getListState("pending", self.pending_schema), handle.getValueState("latest", self.latest_schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        columns = ordered_columns(pd.concat(rows), [])
        columns |= {k: [v] * len(columns["side"]) for k, v in zip(self.keys, key, strict=True)}
        self.pending.appendList(list(zip(*[columns[f] for f in self.fields], strict=True)))
        self.handle.registerTimer(int(min(columns[_AT])))
        yield _frame([], self.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        held = [dict(zip(self.fields, tuple(r), strict=True)) for r in self.pending.get()] if self.pending.exists() else []
        due = sorted((r for r in held if r[_AT] <= mark), key=lambda r: (*[(r[c] is not None, r[c]) for c in self.order], r["side"]))
        rest = [tuple(r.values()) for r in held if r[_AT] > mark]
        now, out = tuple(self.latest.get())[0] if self.latest.exists() else None, []
        for r in due:
            if r["side"] == 1:
                out.append(tuple(now if n == self.value else r[n] for n in self.names))
            elif r[self.value] is not None:
                now = r[self.value]
        if now is not None:
            self.latest.update((now,))
        if rest:
            self.pending.put(rest)
            self.handle.registerTimer(int(min(r[self.fields.index(_AT)] for r in rest)))
        elif held:
            self.pending.clear()
        yield _frame(out, self.names)

    def close(self) -> None:
        pass


class BlockAsOf(StatefulProcessor):
    """A stretch of time's rows and versions: those that the watermark has passed leave in total order.

    A row with a version before it in the stretch has its value (``asof_part`` from 0); another has ``asof_part`` -1 and ``asof_kind`` 1, and the last version of what leaves
    follows as a row of ``asof_kind`` 2. What waits is packed, a piece for each micro-batch.
    """

    def __init__(self, names: list[str], order: list[str], value: str, kind: str, shards: int):
        self.names, self.order, self.value, self.kind, self.shards = names, order, value, kind, shards

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending, self.latest = handle.getListState("pending", "rows binary"), handle.getValueState("latest", f"{self.value} {self.kind}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(rows)
        self.pending.appendList([(pickle.dumps(pdf),)])
        self.handle.registerTimer(int(pdf[_AT].min()))
        yield _frame([], [*self.names, "asof_stretch", "asof_part", "asof_kind"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = [pickle.loads(r[0]) for r in self.pending.get()] if self.pending.exists() else []
        if not held:
            yield _frame([], [*self.names, "asof_stretch", "asof_part", "asof_kind"])
            return
        pdf = pd.concat(held, ignore_index=True)
        passed = pdf[_AT] <= timerValues.getCurrentWatermarkInMs()
        if passed.all():
            self.pending.clear()
        else:
            self.pending.put([(pickle.dumps(pdf[~passed]),)])
            self.handle.registerTimer(int(pdf[_AT][~passed].min()))
        # versions come first among equals
        due = without_marks(sorted_rows(pdf[passed].sort_values("side", kind="stable"), self.order))
        side, values = due["side"].to_numpy(), due[self.value].to_numpy(dtype=object)
        version = (side == 0) & np.array([v is not None for v in values.tolist()], bool)  # NaN is a value
        last = np.maximum.accumulate(np.where(version, np.arange(len(due)), -1)) if len(due) else np.zeros(0, np.int64)
        before = self.latest.get()[0] if self.latest.exists() else None
        found = np.array([before if i < 0 else values[i] for i in last.tolist()], dtype=object)
        known = (last >= 0) | (before is not None)
        out = due.assign(**{self.value: pd.Series(found, index=due.index, dtype=object), "asof_stretch": key[0], "asof_kind": np.where(known, 0, 1)})
        out["asof_part"] = np.where(known, np.arange(len(due)) % self.shards, -1)
        out = out[side == 1]
        yield out[[*self.names, "asof_stretch", "asof_part", "asof_kind"]]
        if version.any():
            newest = values[last[-1]]
            newest = newest.item() if isinstance(newest, np.generic) else newest
            self.latest.update((newest,))
            yield _frame([tuple(newest if n == self.value else None for n in self.names) + (key[0], -1, 2)], [*self.names, "asof_stretch", "asof_part", "asof_kind"])

    def close(self) -> None:
        pass


class Carry(StatefulProcessor):
    """Rows of ``BlockAsOf`` that found no version in their stretch take the last one of the stretches before; others pass."""

    def __init__(self, names: list[str], value: str, kind: str):
        self.names, self.value, self.kind = names, value, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", f"{self.value} {self.kind}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if key[0] >= 0:
            for pdf in rows:
                yield without_marks(pdf)[self.names]
            return
        pdf = without_marks(pd.concat(rows).sort_values(["asof_stretch", "asof_kind"], kind="stable"))
        now, found = self.latest.get()[0] if self.latest.exists() else None, []
        for kind, value in zip(pdf["asof_kind"].tolist(), pdf[self.value].tolist(), strict=True):
            now = value if kind == 2 else now
            found.append(now)
        if now is not None:
            self.latest.update((now,))
        yield pdf.assign(**{self.value: pd.Series(found, index=pdf.index, dtype=object)})[pdf["asof_kind"] == 1][self.names]

    def close(self) -> None:
        pass


def asof_joined(left: DataFrame, right: DataFrame, *, order: list[str], value: str, at: str, delay: str, key: list[str] | None = None, shards: int = 1) -> DataFrame:
    """The stream twin of ``asof_latest``: each left row with the latest ``value`` at or before it in ``order`` (along which ``at`` rises), right first on ties.

    Rows and versions may arrive in any order within ``delay``: both wait until the watermark passes them. Without ``key`` both go to stretches of time as long as
    the delay, each a state of its own that gives its rows their value; one state carries the last version from stretch to stretch, and takes no
    rows but those ahead of the first version of theirs. Rows that have their value pass it in ``shards`` parts. Rows behind the watermark are dropped, as
    Spark does it; so are rows without a time.
    """
    keys = key or ["_block"]
    kind = kind_of(right, value)
    sides = [left.withColumn("side", F.lit(1)).withColumn(value, F.lit(None).cast(kind)), right.select(*(key or []), *order, value, at).withColumn("side", F.lit(0))]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [s.where(F.col(at).isNotNull()).withWatermark(at, delay) for s in sides]).withColumn(_AT, F.unix_millis(at))
    fields = [c for c in both.columns if c not in (at, "_block")]
    names = [c for c in left.columns if c != at] + [value]
    typed = lambda columns: ", ".join(f"{c} {kind_of(both, c)}" for c in columns)
    if key:
        processor = AsOf(names, order, value, keys, typed(fields), f"{value} {kind}")
        return with_null_marks(both, keys).groupBy(*keys).transformWithStateInPandas(statefulProcessor=processor, outputStructType=typed(names), outputMode="append", timeMode="EventTime")
    length = left.sparkSession.range(1).select(F.expr(f"cast(unix_millis(timestamp_seconds(0) + interval {delay}) as long)")).first()[0]
    placed = with_null_marks(both.withColumn("_block", F.floor(F.col(_AT) / max(1, length))), ["_block"])
    solved = placed.groupBy("_block").transformWithStateInPandas(statefulProcessor=BlockAsOf(names, order, value, kind, shards), outputStructType=typed(names) + ", asof_stretch long, asof_part long, asof_kind long", outputMode="append", timeMode="EventTime")
    return with_null_marks(solved, ["asof_part"]).groupBy("asof_part").transformWithStateInPandas(statefulProcessor=Carry(names, value, kind), outputStructType=typed(names), outputMode="append", timeMode="None")
