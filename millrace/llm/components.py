"""Connected components over an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Up to so many edges (16 bytes each) a node's least neighbour is broadcast instead of joined by shuffle.
BROADCAST_EDGES = 300_000


def _large_star(edges: DataFrame, hint) -> DataFrame:
    """Every larger neighbour of a node moves to the smallest node of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(hint(least), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, hint) -> DataFrame:
    """A node's smaller neighbours, and the node itself, move to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(hint(least), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def connected_components(edges: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """Node and smallest reachable node, for every node of ``edges`` (columns a and b, no nulls) with a smaller one.

    Each round groups, joins and writes its edges to the shared folder; only a count and a checksum reach the
    driver. A round never has more edges than the one before. Self-links and repeated links don't matter;
    no edges give an empty table.
    """
    spark = edges.sparkSession
    now, old, last = common.stored(edges.where("a <> b").select("a", "b").distinct(), "edges"), None, (None, None)
    count = now.count()
    for _ in range(most_rounds):
        hint = F.broadcast if count <= BROADCAST_EDGES else (lambda df: df)
        path = common.scratch(spark, "edges")
        _small_star(_large_star(now, hint), hint).where("a <> b").distinct().write.parquet(path)
        now = spark.read.schema(now.schema).parquet(path)
        count, checksum = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if old:
            common.drop_path(spark, old)
        old = path
        if (count, checksum) == last:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        last = (count, checksum)
    raise RuntimeError("components did not settle")
