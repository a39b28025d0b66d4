"""Feeds derived from the driver's tables; every query starts from one of these."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ``k`` from the properties, microseconds ``us``, floored epoch seconds ``et`` and a zoned ``at``, whatever the session's zone."""
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts AS timestamp_ntz))")
    rows = table(spark, sf_dir, "events").withColumn("us", us).withColumn("et", F.floor(F.col("us") / 1_000_000))
    return rows.withColumn("k", F.get_json_object("props", "$.k").cast("int")).withColumn("at", F.timestamp_micros("us")).drop("ts", "props")


def ads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Ad events and the ad to campaign table."""
    rows = events(spark, sf_dir).select("event_id", F.col("user_id").alias("ad_id"), "event_type", "at", "et", "us")
    dim = table(spark, sf_dir, "events").select(F.col("user_id").alias("ad_id")).distinct().where("ad_id % 17 <> 0").withColumn("campaign_id", F.col("ad_id") % 10)
    return rows, dim


def cdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call records: call_id, calling, called, answer_ts, duration, established."""
    e = events(spark, sf_dir)
    return e.select(
        F.col("event_id").alias("call_id"),
        F.col("user_id").alias("calling"),
        ((F.col("user_id") + 1 + F.col("k") % 7) % 150).alias("called"),
        F.floor(F.col("et") / 600).alias("answer_ts"),
        F.floor(F.col("value") * 60).alias("duration"),
        (F.col("event_type") != "error").alias("established"),
    )


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Highway position reports."""
    e = events(spark, sf_dir)
    return e.select(
        "event_id",
        F.floor((F.col("et") - 1704067200) / 240).alias("time"),
        F.col("user_id").alias("vid"),
        (F.floor("value") % 101).alias("speed"),
        (F.col("user_id") % 2).alias("xway"),
        (F.col("k") % 5).alias("lane"),
        (F.col("event_id") % 2).alias("direction"),
        F.floor(F.col("k") / 10).alias("segment"),
    ).withColumn("minute", F.floor(F.col("time") / 60) + 1)


def gps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vehicle positions near the roads of ``roads``."""
    e = events(spark, sf_dir)
    return e.select("event_id", F.col("user_id").alias("vehicle"), (39.7005 + (F.col("event_id") % 400) / 1000.0 + (F.col("k") - 50) * 2e-6).alias("lat"), (116.1005 + (F.col("user_id") % 80) / 1000.0).alias("lon"), F.col("value").alias("speed"), "et")


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Straight west-east roads, one segment each, in file order ``road_no``."""
    s = table(spark, sf_dir, "supplier")
    y = 39.7005 + (F.col("s_suppkey") * 4 % 400) / 1000.0
    rows = s.select(F.col("s_suppkey").cast("long").alias("road_no"), F.col("s_suppkey").cast("long").alias("road_id"), F.lit(None).cast("int").alias("width"), F.lit(0).alias("seg_no"), F.lit(116.1).alias("x1"), y.alias("y1"), F.lit(116.1995).alias("x2"), y.alias("y2"))
    return rows.withColumn("cell", F.concat_ws("_", F.floor(F.col("y1") * 10), F.floor(F.col("x1") * 10)))


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concave polygons of five corners around the positions: polygon_id and ring."""
    s = table(spark, sf_dir, "supplier").where("s_suppkey % 5 = 0")
    cx, cy, r = 116.1005 + (F.col("s_suppkey") % 80) / 1000.0, 39.7005 + (F.col("s_suppkey") * 7 % 400) / 1000.0, 0.001 * (1 + F.col("s_suppkey") % 60)
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return s.select(F.col("s_suppkey").cast("long").alias("polygon_id"), F.array(corner(cx - r, cy), corner(cx, cy + r / 2), corner(cx + r, cy), corner(cx, cy + r / 5), corner(cx, cy - r)).alias("ring"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents: ``pos`` orders them, with room for a thousand million lines in a document."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return d.select("doc_id", (F.col("doc_id") * 1_000_000_000 + F.col("line_no")).alias("pos"), "line")


def tweets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents wrapped as JSON lines."""
    return table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct(F.struct("text").alias("data"))).alias("value"))


def lexicon(spark: SparkSession) -> DataFrame:
    """Scores of frequent words."""
    return spark.createDataFrame([("the", 1), ("and", -1), ("that", 2), ("for", -2), ("was", 3), ("with", -3)], "word string, score int")
