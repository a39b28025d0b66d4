"""Whole applications on streams: spikes of sensors, frauds by state sequences, sentiment of messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import markov, ordered, text
from . import _stateful, by_batch, kind_of, moving_averages


def spikes(rows: DataFrame, *, key: str, value: str, order: list[str], size: int = 1000, threshold: float = 0.25, ttl_ms: int | None = None) -> DataFrame:
    """The stream twin of ``spike_detect``: key, row_id, moving_avg and the value."""
    means = moving_averages(rows, key=key, value=value, order=order, size=size, with_value=True, ttl_ms=ttl_ms)
    return ordered.filter_spike(means, value=value, threshold=threshold)


def state_sequences(rows: DataFrame, *, key: str, state: str, order: list[str], size: int = markov.SEQUENCE, ttl_ms: int | None = None) -> DataFrame:
    """The stream twin of ``state_sequence``: key, row_id and the last ``size`` states, once a key has as many; a list of states for each key."""

    def scan(held, k, columns):
        line = [s for (s,) in held] + columns[state]
        ends = [i for i in range(len(held), len(line)) if i + 1 >= size]
        ids = columns[order[-1]]
        return [(s,) for s in line[1 - size :]] if size > 1 else [], ([k[0]] * len(ends), [ids[i - len(held)] for i in ends], [line[i + 1 - size : i + 1] for i in ends])

    known = rows.where(F.col(state).isNotNull())
    return _stateful(known, [key], ("list", "state string"), order, scan, f"{key} {kind_of(rows, key)}, row_id {kind_of(rows, order[-1])}, sequence array<string>", ttl_ms)


def frauds(rows: DataFrame, model: DataFrame, *, key: str, state: str, order: list[str], threshold: float = 0.96, predictor: str = "miss_probability", size: int = markov.SEQUENCE, ttl_ms: int | None = None) -> DataFrame:
    """The stream twin of ``fraud_detect`` under a given model: key, row_id and score of the rows that score over the threshold.

    A sequence's transitions meet the model one after the other, by joins of the stream with a table, so that scoring needs no state.
    """
    scored = state_sequences(rows, key=key, state=state, order=order, size=size, ttl_ms=ttl_ms).withColumn("total", F.lit(0.0))
    for i in range(size - 1):
        pair = scored.withColumn("prev", F.col("sequence")[i]).withColumn("cur", F.col("sequence")[i + 1])
        met = markov.join_model(pair, model, state="cur")
        scored = met.withColumn("total", F.col("total") + markov.PREDICTORS[predictor]("cur")).select(*scored.columns)
    return scored.select(key, "row_id", (F.col("total") / (size - 1)).alias("score")).where(F.col("score") > threshold)


def sentiments(messages: DataFrame, lexicon: DataFrame, *, key: str, path: str, checkpoint: str, column: str = "text"):
    """``sentiment`` of each micro-batch's messages, stored under ``path``: a message is whole in its micro-batch, so that none needs state."""
    return by_batch(messages, lambda batch: text.sentiment(batch, lexicon, key=key, text=column), path, checkpoint)
