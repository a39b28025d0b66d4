"""Sketches as stream state: one value of fixed size for each shard, whatever the number of keys."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.sketches import DecayingCells, FilterShape, RotatingFilters, SketchShape, filter_places
from . import kind_of, ordered_columns, with_null_marks
from .joins import _frame


class CellState(StatefulProcessor):
    def __init__(self, shape: SketchShape, beta: float, time: str, order: list[str], row_id: str, names: list[str]):
        self.shape, self.beta, self.time, self.order, self.row_id, self.names = shape, beta, time, order, row_id, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("cells", "cells array<double>, times array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        columns = ordered_columns(pd.concat(rows), self.order)
        sketch = DecayingCells(self.shape, self.beta, *(map(list, self.state.get()) if self.state.exists() else ()))
        cells = zip(*[columns[f"cell{i}"] for i in range(self.shape.rows)], strict=True)
        out = [(i, None if at is None else sketch.add(list(c), at, float(x or 0.0))) for i, c, at, x in zip(columns[self.row_id], cells, columns[self.time], columns["amount"], strict=True)]
        self.state.update((sketch.values.tolist(), sketch.times.tolist()))
        yield _frame(out, self.names)

    def close(self) -> None:
        pass


def sketched_counts(rows: DataFrame, *, keys: list[str], time: str, order: list[str], row_id: str, amount, beta: float, out: str = "value", shape: SketchShape = SketchShape()) -> DataFrame:
    """The stream twin of ``decayed_estimates``: row_id and the estimate after the row.

    State is ``rows * width`` cells of 16 bytes in all, dealt to ``shards``; a cell needs no expiry, it fades.
    """
    shard, cells = shape.cells(keys)
    slim = rows.select(shard.alias("shard"), *[c.alias(f"cell{i}") for i, c in enumerate(cells)], F.col(row_id), F.col(time), amount.alias("amount"), *[F.col(c) for c in order if c not in (row_id, time)])
    names = [row_id, out]
    return with_null_marks(slim, ["shard"]).groupBy("shard").transformWithStateInPandas(statefulProcessor=CellState(shape, beta, time, order, row_id, names), outputStructType=f"{row_id} {kind_of(rows, row_id)}, {out} double", outputMode="append", timeMode="None")


class FilterState(StatefulProcessor):
    def __init__(self, shape: FilterShape, order: list[str], row_id: str, names: list[str]):
        self.shape, self.order, self.row_id, self.names = shape, order, row_id, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("filters", "detector binary, learner binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        columns = ordered_columns(pd.concat(rows), self.order)
        filters = RotatingFilters(self.shape, *(map(bytes, self.state.get()) if self.state.exists() else ()))
        out = [(i, filters.is_new(a, b)) for i, a, b in zip(columns[self.row_id], columns["first"], columns["step"], strict=True)]
        self.state.update(filters.state())
        yield _frame(out, self.names)

    def close(self) -> None:
        pass


def seen_filters(rows: DataFrame, *, keys: list[str], order: list[str], row_id: str, shape: FilterShape = FilterShape()) -> DataFrame:
    """The stream twin of ``seen_filter``: row_id and ``new``; state is two filters for each shard."""
    slim = filter_places(rows, keys, shape).select(F.col("_shard").alias("shard"), F.col("_first").alias("first"), F.col("_step").alias("step"), F.col(row_id), *[F.col(c) for c in order if c != row_id])
    names = [row_id, "new"]
    return with_null_marks(slim, ["shard"]).groupBy("shard").transformWithStateInPandas(statefulProcessor=FilterState(shape, order, row_id, names), outputStructType=f"{row_id} {kind_of(rows, row_id)}, new boolean", outputMode="append", timeMode="None")
