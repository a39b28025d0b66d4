"""Markov-chain scores of state sequences against a transition model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ads import sized
from .ordered import along, block_count, framed, held, only_own, running

#: States of a scored sequence.
SEQUENCE = 5


def transitions(df: DataFrame, *, key: str, order: str, tie: list[str], state: str, blocks: int | None = None) -> DataFrame:
    """Rows numbered in their key (``n``), with the previous state (null on the first). Rows without a state take no part."""
    rows, w = along(df.where(F.col(state).isNotNull()), [key], order, tie, 1, blocks=blocks)
    return only_own(rows.withColumn("prev", F.lag(state).over(w)))


def model_of(pairs: DataFrame, *, state: str) -> DataFrame:
    """Transition probabilities (prev, cur, p) of ``transitions``."""
    counts = pairs.where("prev is not null").groupBy("prev", F.col(state).alias("cur")).agg(F.count("*").alias("c"))
    return counts.withColumn("p", F.col("c") / F.sum("c").over(Window.partitionBy("prev"))).drop("c")


def model_fit(df: DataFrame, *, key: str, order: str, tie: list[str], state: str) -> DataFrame:
    """Transition probabilities (prev, cur, p) from adjacent states of each key."""
    return model_of(transitions(df.select(key, order, *tie, state), key=key, order=order, tie=tie, state=state), state=state)


def state_sequence(df: DataFrame, *, key: str, order: str, tie: list[str], state: str, size: int = SEQUENCE) -> DataFrame:
    """The last ``size`` states of a key, once it has as many; rows without a state take no part."""
    rows, w = along(df.where(F.col(state).isNotNull()), [key], order, tie, size - 1)
    seq = F.collect_list(state).over(w.rowsBetween(1 - size, 0))
    return only_own(rows.withColumn("sequence", seq)).where(F.col("n") >= size).drop("n")


def join_model(pairs: DataFrame, model: DataFrame, *, state: str) -> DataFrame:
    """Each transition with its probability (0 if unknown), its row's total and its row's likeliest state (the first by name on ties).

    The model, a row for each pair of states that meet, is kept for the uses here.
    """
    model = model.persist(StorageLevel.MEMORY_AND_DISK)
    states = model.groupBy("prev").agg(F.sum("p").alias("row_total"), F.min_by("cur", F.struct(-F.col("p"), "cur")).alias("best"))
    rows = pairs.join(sized(states), "prev", "left")
    return rows.join(sized(model.withColumnRenamed("cur", state)), ["prev", state], "left").na.fill(0.0, ["p", "row_total"])


def miss_probability() -> F.Column:
    """Probability of the states that did not come."""
    return F.col("row_total") - F.col("p")


def miss_rate(state: str) -> F.Column:
    """1 where the state was not the likeliest; a state without a model row misses."""
    return F.when(F.col("best") == F.col(state), 0.0).otherwise(1.0)


#: Predictors by name: each scores one transition.
PREDICTORS: dict[str, Callable[[str], F.Column]] = {"miss_probability": lambda state: miss_probability(), "miss_rate": miss_rate, "entropy_reduction": miss_rate}


def score_transitions(pairs: DataFrame, model: DataFrame, *, key: str, state: str, predictor: str = "miss_probability", size: int = SEQUENCE, blocks: int | None = None) -> DataFrame:
    """``transitions`` with ``score``, the mean score of the last ``size`` states' transitions, once a key has as many."""
    scored = join_model(pairs, model, state=state).withColumn("_miss", F.when(F.col("prev").isNotNull(), PREDICTORS[predictor](state)))
    rows, w = framed(scored, [key], size - 2, blocks=blocks)
    scored = only_own(rows.withColumn("score", F.sum("_miss").over(w.rowsBetween(2 - size, 0)) / (size - 1)))
    return scored.where(F.col("n") >= size).select(*pairs.columns, "score")


def score_sequences(df: DataFrame, model: DataFrame, *, key: str, order: str, tie: list[str], state: str, predictor: str = "miss_probability", size: int = SEQUENCE, rows: int | None = None) -> DataFrame:
    """Mean transition score of the last ``size`` states, once a key has as many."""
    blocks = block_count(df, rows)
    pairs = transitions(df, key=key, order=order, tie=tie, state=state, blocks=blocks)
    return score_transitions(pairs, model, key=key, state=state, predictor=predictor, size=size, blocks=blocks).select(*df.columns, "score")


def fit_and_score(df: DataFrame, *, key: str, order: str, tie: list[str], state: str, predictor: str = "miss_probability", size: int = SEQUENCE) -> DataFrame:
    """Fit a model on a table's transitions and score the same transitions with it: they are numbered once."""
    blocks = block_count(df)
    pairs = held(transitions(df, key=key, order=order, tie=tie, state=state, blocks=blocks), blocks)
    return score_transitions(pairs, model_of(pairs, state=state), key=key, state=state, predictor=predictor, size=size, blocks=blocks).select(*df.columns, "score")


def metric_of(pairs: DataFrame, model: DataFrame, *, key: str, state: str, blocks: int | None = None) -> DataFrame:
    """``transitions`` that have a previous state, with ``score``: the running ratio of missed to all probability of a key so far."""
    known = join_model(pairs, model, state=state).where("prev is not null")
    sums = running(known, [key], "n", [], sums={"_missed": miss_probability(), "_all": F.col("row_total")}, blocks=blocks)
    return sums.withColumn("score", F.try_divide("_missed", "_all")).select(*pairs.columns, "score")


def global_metric(df: DataFrame, model: DataFrame, *, key: str, order: str, tie: list[str], state: str, rows: int | None = None) -> DataFrame:
    """Running ratio of missed to all probability over all transitions of a key so far."""
    blocks = block_count(df, rows)
    return metric_of(transitions(df, key=key, order=order, tie=tie, state=state, blocks=blocks), model, key=key, state=state, blocks=blocks).select(*df.columns, "score")


def state_entropy(model: DataFrame) -> DataFrame:
    """Entropy of each state's transitions."""
    return model.where("p > 0").groupBy("prev").agg((-F.sum(F.col("p") * F.log("p"))).alias("entropy"))


def fraud_detect(df: DataFrame, model: DataFrame | None = None, *, key: str, order: str, tie: list[str], state: str, threshold: float = 0.96, predictor: str = "miss_probability") -> DataFrame:
    """Rows whose sequence scores over the threshold; without a model one is fitted on the rows themselves."""
    by = {"key": key, "order": order, "tie": tie, "state": state, "predictor": predictor}
    scored = fit_and_score(df, **by) if model is None else score_sequences(df, model, **by)
    return scored.where(F.col("score") > threshold)
