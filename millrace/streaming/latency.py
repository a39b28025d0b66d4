"""Latency of a stream's results: a quantile sketch for each micro-batch, stored, and merged over a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Size of a sketch: ranks are within 0.7 % of the true ones, with 99 % confidence; a sketch has some 15 kB.
SKETCH_SIZE = 800
PERCENTS = (5, 25, 50, 75, 95)


def latency_sketch(rows: DataFrame, latency: Column) -> DataFrame:
    """One row: n, total, least, greatest and a mergeable sketch of a latency; nulls count nothing."""
    x = rows.select(latency.cast("double").alias("x")).where("x is not null")
    return x.agg(F.count("x").alias("n"), F.sum("x").alias("total"), F.min("x").alias("least"), F.max("x").alias("greatest"), F.kll_sketch_agg_double("x", F.lit(SKETCH_SIZE)).alias("sketch"))


def latency_sink(stream: DataFrame, latency: Column, path: str, checkpoint: str):
    """Drain a stream into a latency sketch for each micro-batch, one small file each under ``path``.

    A micro-batch that is run again after a failure overwrites its own sketch, so that nothing counts twice.
    """

    def each(batch: DataFrame, number: int) -> None:
        latency_sketch(batch, latency).where("n > 0").coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_sketches(spark: SparkSession, path: str) -> DataFrame:
    schema = "n long, total double, least double, greatest double, sketch binary, batch long"
    return spark.read.schema(schema).parquet(path)


def merged_latency(sketches: DataFrame, percents: tuple[int, ...] = PERCENTS) -> DataFrame:
    """Sketches of any micro-batches, runs or days as one summary: n, mean, p0, p100 and percentiles; no row where there is no sketch."""
    whole = sketches.agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("mean"), F.min("least").alias("p0"), F.max("greatest").alias("p100"), F.kll_merge_agg_double("sketch", F.lit(SKETCH_SIZE)).alias("s")).where("n > 0")
    return whole.select("n", "mean", "p0", "p100", *[F.kll_sketch_get_quantile_double("s", F.lit(p / 100)).alias(f"p{p}") for p in percents])


def rank_errors(summary: DataFrame, rows: DataFrame, latency: str, percents: tuple[int, ...] = PERCENTS) -> DataFrame:
    """How far each percentile's rank lies from its own, as a share of all rows: 0 where the rows equal to it span its rank."""
    both = rows.where(F.col(latency).isNotNull()).select(F.col(latency).alias("_x")).join(F.broadcast(summary.select(*[f"p{p}" for p in percents])))  # one row
    under = lambda p, c: F.avg(F.when(c, 1.0).otherwise(0.0))
    spans = both.agg(*[x for p in percents for x in (under(p, F.col("_x") < F.col(f"p{p}")).alias(f"lo{p}"), under(p, F.col("_x") <= F.col(f"p{p}")).alias(f"hi{p}"))])
    return spans.select(*[F.greatest(F.col(f"lo{p}") - p / 100, F.lit(p / 100) - F.col(f"hi{p}"), F.lit(0.0)).alias(f"error{p}") for p in percents])
