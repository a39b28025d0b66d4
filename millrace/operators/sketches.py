"""Counts and memberships in fixed space, whatever the number of keys: decaying count sketches and rotating membership filters.

A key's cells come from one MD5 digest, so that batch, stream and SQL agree on them. Cells are dealt to shards; a key has all of
its cells in one shard, which makes a shard a sketch of its own and a stream's state one value of fixed size for each shard.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.storage import stored
from .ads import sized
from .ordered import block_count, decayed_sums
from .traffic import ordered_scan

#: Rows of cells at most: a digest has four numbers of 32 bits, and one of them picks the shard.
MOST_ROWS = 3


def _numbers(keys: list[str]) -> list[Column]:
    """Four numbers of 32 bits for a key; null parts are a key like any other."""
    digest = F.md5(F.concat_ws(":", *[F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in keys]).cast("binary"))
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


@dataclass(frozen=True)
class SketchShape:
    """``rows`` cells for each key, out of ``width`` in each row, in ``shards`` parts. A key is overrated where all its cells are shared."""

    width: int = 1 << 16
    rows: int = 3
    shards: int = 64

    def __post_init__(self) -> None:
        if not 1 <= self.rows <= MOST_ROWS or self.shards < 1 or self.width < self.shards or self.width % self.shards:
            raise ValueError(f"a sketch has 1 to {MOST_ROWS} rows, and shards that divide its width")

    @property
    def share(self) -> int:
        """Cells of a shard in each row."""
        return self.width // self.shards

    def cells(self, keys: list[str]) -> tuple[Column, list[Column]]:
        """A key's shard, and its cell in each row."""
        *own, last = _numbers(keys)
        shard = last % self.shards
        return shard, [shard * self.share + n % self.share for n in own[: self.rows]]


def decayed_estimates(df: DataFrame, *, keys: list[str], time: str, tie: list[str], amount: Column, beta: float, out: str, shape: SketchShape = SketchShape(), rows: int | None = None) -> DataFrame:
    """``decayed`` with the memory of a sketch: after each row the least of the decayed sums in its key's cells.

    Never under the exact sum. A cell's rows are a key like any other, so that a cell with most of them is split over tasks. Nulls as ``decayed``
    has them.
    """
    _, cells = shape.cells(keys)
    placed = df.select("*", amount.alias("_q"), *[c.alias(f"_cell{i}") for i, c in enumerate(cells)])
    blocks = block_count(df, rows)
    for i in range(shape.rows):
        placed = decayed_sums(placed, keys=[f"_cell{i}"], time=time, tie=tie, amounts={f"_e{i}": F.col("_q")}, beta=beta, rows=rows, blocks=blocks)
    estimates = [F.col(f"_e{i}") for i in range(shape.rows)]
    return placed.withColumn(out, F.least(*estimates) if len(estimates) > 1 else estimates[0]).select(*df.columns, out)


def decayed_sketch(df: DataFrame, *, keys: list[str], time: str, amount: Column, beta: float, shape: SketchShape = SketchShape()) -> DataFrame:
    """A table as a sketch: row, cell, value, at. At most ``rows * width`` rows, whatever it sums up; rows without a time take no part.

    All values are as of the table's last time, to which older ones have decayed: only that time reaches the driver.
    """
    _, cells = shape.cells(keys)
    timed = df.where(F.col(time).isNotNull())
    last = timed.agg(F.max(time)).first()[0]
    spread = timed.select(F.col(time).alias("_at"), F.coalesce(amount.cast("double"), F.lit(0.0)).alias("_q"), F.posexplode(F.array(*cells)).alias("row", "cell"))
    return _aged(spread, "_q", "_at", last, beta)


def _aged(rows: DataFrame, value: str, at: str, last: int | None, beta: float) -> DataFrame:
    last = 0 if last is None else last
    old = F.pow(F.lit(beta), (F.lit(last) - F.col(at)).cast("double"))
    return rows.groupBy("row", "cell").agg(F.sum(F.col(value) * old).alias("value")).withColumn("at", F.lit(last).cast("long"))


def merged_sketches(sketches: DataFrame, *, beta: float) -> DataFrame:
    """Sketches of one shape, put under each other, as one: cells add up once they are as old as the newest."""
    return _aged(sketches, "value", "at", sketches.agg(F.max("at")).first()[0], beta)


def read_sketch(sketch: DataFrame, asked: DataFrame, *, keys: list[str], time: str, beta: float, out: str, shape: SketchShape = SketchShape()) -> DataFrame:
    """Distinct keys and times of ``asked`` with the sketch's estimate as of then; times lie at or after the sketch's own."""
    _, cells = shape.cells(keys)
    spread = asked.select(*keys, time).distinct().select("*", F.posexplode(F.array(*cells)).alias("row", "cell"))
    met = spread.join(sketch.select("row", "cell", "value", "at"), ["row", "cell"], "left")
    now = F.coalesce(F.col("value") * F.pow(F.lit(beta), (F.col(time) - F.col("at")).cast("double")), F.lit(0.0))
    return met.groupBy(*keys, time).agg(F.min(now).alias(out))


class DecayingCells:
    """One shard's cells: value and time of each. Batch tests and streams share it."""

    def __init__(self, shape: SketchShape, beta: float, values: list[float] | None = None, times: list[int] | None = None):
        n = shape.rows * shape.share
        self.shape, self.beta = shape, beta
        self.values, self.times = np.array(values) if values else np.zeros(n), np.array(times, np.int64) if times else np.zeros(n, np.int64)

    def add(self, cells: list[int], at: int, amount: float) -> float:
        """The estimate after an amount; a time before a cell's own counts as its own."""
        places = [i * self.shape.share + c % self.shape.share for i, c in enumerate(cells)]
        now = np.maximum(self.times[places], at)
        self.values[places] = self.values[places] * self.beta ** (now - self.times[places]).astype(float) + amount * self.beta ** (now - at).astype(float)
        self.times[places] = now
        return float(self.values[places].min())


@dataclass(frozen=True)
class FilterShape:
    """A pair of membership filters of the size for ``expected`` keys at a false-positive rate of ``error``, in ``shards`` parts."""

    expected: int = 180_000
    error: float = 0.05
    shards: int = 16

    @property
    def hashes(self) -> int:
        return math.ceil(-math.log2(self.error))

    @property
    def bits(self) -> int:
        """Bits of a filter of one shard."""
        return math.ceil(math.ceil(self.hashes / math.log(2) * self.expected) / self.shards)


#: Keys that a shard's filter of ``filter_shape`` takes.
SHARD_KEYS = 11_250


def filter_shape(df: DataFrame, keys: list[str], *, error: float = 0.05) -> FilterShape:
    """A shape whose filters take all keys of a table and don't rotate; shards grow in number with the keys, not in size. Only a count reaches the driver."""
    n = df.agg(F.approx_count_distinct(F.struct(*keys))).first()[0]
    # a fifth more than the count tells, which may be off by some per cent
    expected = max(FilterShape.expected, math.ceil(n * 1.2))
    return FilterShape(expected=expected, error=error, shards=math.ceil(expected / SHARD_KEYS))


class RotatingFilters:
    """One shard's detector, which tells what was seen, and learner, which takes its place once it is full. Batch and stream share it.

    A key met before is taken for new only after the detector that had it was replaced without its coming again in between; a new one passes for
    known at a rate that grows to ``error`` as the detector fills, and beyond it until the filters rotate at one part in the root of two.
    """

    def __init__(self, shape: FilterShape, detector: bytes | None = None, learner: bytes | None = None):
        self.shape, n = shape, shape.bits
        read = lambda b: np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) if b else np.zeros(n, bool)
        self.detector, self.learner = read(detector), read(learner)
        self.full, self.set = n / math.sqrt(2), int(self.detector.sum())

    def is_new(self, first: int, step: int) -> bool:
        places = (first + np.arange(self.shape.hashes) * (step | 1)) % self.shape.bits
        self.learner[places] = True
        new = not self.detector[places].all()
        if new:
            self.set += int((~self.detector[np.unique(places)]).sum())
            self.detector[places] = True
        if self.set > self.full:
            self.detector, self.learner = self.learner, np.zeros(self.shape.bits, bool)
            self.set = int(self.detector.sum())
        return new

    def state(self) -> tuple[bytes, bytes]:
        return np.packbits(self.detector).tobytes(), np.packbits(self.learner).tobytes()


def filter_places(df: DataFrame, keys: list[str], shape: FilterShape) -> DataFrame:
    """Rows with ``_shard``, ``_first`` and ``_step``: where their key's bits are."""
    first, step, _, last = _numbers(keys)
    return df.select("*", (last % shape.shards).alias("_shard"), first.alias("_first"), step.alias("_step"))


def seen_filter(df: DataFrame, *, keys: list[str], order: str, tie: list[str], row_id: str, shape: FilterShape = FilterShape()) -> DataFrame:
    """row_id and ``new``: whether a row's key is new to rotating filters of fixed size, in the order of ``order`` and ``tie``.

    When filters rotate depends on all keys before, so that a shard's rows go one after the other: a shard is a task, and its rows stream through it.
    """
    placed = filter_places(df, keys, shape)
    slim = placed.select("_shard", F.col("_first"), F.col("_step"), F.col(row_id).alias("_id"), F.col(order).alias("_o"), *[F.col(c).alias(f"_t{i}") for i, c in enumerate(tie)])

    def scan(filters, shard, batch):
        filters = filters or RotatingFilters(shape)
        new = [filters.is_new(a, b) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        return filters, [batch.column(3), new]

    schema = T.StructType([T.StructField(row_id, slim.schema["_id"].dataType), T.StructField("new", T.BooleanType())])
    return ordered_scan(slim, scan, key="_shard", order=["_o", *(f"_t{i}" for i in range(len(tie)))], schema=schema)


def confirmed(flags: DataFrame, rows: DataFrame, *, keys: list[str], order: str, tie: list[str], row_id: str) -> DataFrame:
    """``seen_filter``'s row_id and ``new``, made exact where the filters didn't rotate (``filter_shape``).

    What such a filter calls new is new. A key that passed for known from the start has no new row: only the first row of such keys, a share of them that
    the filter's error bounds, is looked up in ``rows``. ``row_id`` tells rows apart.
    """
    flags = stored(flags.select(row_id, "new"), "flags")
    place = F.struct(*dict.fromkeys([order, *tie, row_id]))
    met = rows.select(*dict.fromkeys([*keys, order, *tie, row_id])).join(flags, row_id)
    missed = met.groupBy(*keys).agg(F.bool_or("new").alias("_met"), F.min(place).alias("_first")).where("not _met").select(F.col(f"_first.{row_id}").alias(row_id), F.lit(True).alias("_missed"))
    return flags.join(sized(stored(missed, "missed")), row_id, "left").select(row_id, (F.col("new") | F.coalesce("_missed", F.lit(False))).alias("new"))
