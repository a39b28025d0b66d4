"""Parsers of the line feeds: each takes rows with a ``value`` line, from a batch or a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Places of the measured fields in a sensor line.
SENSOR_FIELDS = {"temp": 4, "humid": 5, "light": 6, "volt": 7}
#: Fields of a city bus line, in order.
BUS_FIELDS = ["ts", "line", "direction", "pattern", "frame", "journey", "operator", "congestion", "lon", "lat", "delay", "block", "vehicle", "stop", "at_stop"]


def read_lines(spark: SparkSession, path: str, *, stream: bool = False, files_per_trigger: int | None = None) -> DataFrame:
    """Text lines of files, as a batch or as a stream paced by files."""
    if not stream:
        return spark.read.text(path)
    reader = spark.readStream.format("text")
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).load(path)


def csv_kv(lines: DataFrame) -> DataFrame:
    """``entity,rest``: split on the first comma only; lines without one have a null record."""
    parts = F.split("value", ",", 2)
    return lines.select(parts[0].alias("entity"), F.get(parts, F.lit(1)).alias("record"))


def sensor(lines: DataFrame, *, value_field: str = "temp") -> DataFrame:
    """Blank-separated readings with eight fields or more; shorter lines are dropped."""
    p = F.split(F.trim("value"), r"\s+")
    kept = lines.select(p.alias("p")).where(F.size("p") >= 8)
    return kept.select(F.col("p")[0].alias("date"), F.col("p")[1].alias("time"), F.col("p")[2].try_cast("int").alias("epoch"), F.col("p")[3].alias("device"), F.col("p")[SENSOR_FIELDS[value_field]].try_cast("double").alias("value"))


def taxi(lines: DataFrame) -> DataFrame:
    """Taxi traces: vehicle, nid, date, lat, lon, speed, bearing; lines with fewer fields are dropped."""
    p = F.split("value", ",")
    kept = lines.select(p.alias("p")).where(F.size("p") >= 7)
    names = [("vehicle", "string"), ("nid", "int"), ("date", "string"), ("lat", "double"), ("lon", "double"), ("speed", "double"), ("bearing", "int")]
    return kept.select(*[F.col("p")[i].try_cast(t).alias(n) for i, (n, t) in enumerate(names)])


def bus(lines: DataFrame) -> DataFrame:
    """The bus feed, projected to the columns of the taxi feed (no speed or bearing there: zero)."""
    p = F.split("value", ",")
    kept = lines.select(p.alias("p")).where(F.size("p") >= len(BUS_FIELDS))
    at = {n: F.col("p")[i] for i, n in enumerate(BUS_FIELDS)}
    return kept.select(at["vehicle"].alias("vehicle"), at["line"].try_cast("int").alias("nid"), at["ts"].alias("date"), at["lat"].try_cast("double").alias("lat"), at["lon"].try_cast("double").alias("lon"), F.lit(0.0).alias("speed"), F.lit(0).alias("bearing"))


def cdr(lines: DataFrame) -> DataFrame:
    """Call records: calling, called, ISO answer time with zone as epoch seconds, duration, established."""
    p = F.split("value", ",")
    kept = lines.select(p.alias("p")).where(F.size("p") >= 5)
    return kept.select(
        F.col("p")[0].alias("calling"),
        F.col("p")[1].alias("called"),
        F.unix_seconds(F.try_to_timestamp(F.col("p")[2], F.lit("yyyy-MM-dd'T'HH:mm:ss.SSS[XXX][XX]"))).alias("answer_ts"),
        F.col("p")[3].try_cast("int").alias("duration"),
        (F.lower(F.trim(F.col("p")[4])) == "true").alias("established"),
    )


def road_reports(lines: DataFrame) -> DataFrame:
    """Highway reports of nine fields; types but 0 are dropped."""
    p = F.split("value", ",")
    names = [("type", "int"), ("time", "int"), ("vid", "int"), ("speed", "int"), ("xway", "int"), ("lane", "int"), ("direction", "int"), ("segment", "int"), ("position", "int")]
    rows = lines.select(p.alias("p")).where(F.size("p") >= 9).select(*[F.trim(F.col("p")[i]).try_cast(t).alias(n) for i, (n, t) in enumerate(names)])
    return rows.where("type = 0").drop("type")


def tweets(lines: DataFrame, *, keep: list[str] | None = None) -> DataFrame:
    """The text of JSON objects, ``data.text``; what doesn't parse is null."""
    return lines.select(*(keep or []), F.from_json("value", "data struct<text: string>")["data"]["text"].alias("text"))


def cyclic_ads(rows: DataFrame, n: Column, *, ads: int) -> DataFrame:
    """Synthetic ad events from a row number: ads in turn, three event types and five ad types in turn."""
    event = F.element_at(F.array(F.lit("view"), F.lit("click"), F.lit("purchase")), (n % 3 + 1).cast("int"))
    return rows.select(n.alias("n"), (n % ads).alias("ad_id"), event.alias("event_type"), (n % 5).cast("int").alias("ad_type"))


def rate_ads(spark: SparkSession, *, rows_per_second: int, ads: int) -> DataFrame:
    """``cyclic_ads`` as a paced stream."""
    return cyclic_ads(spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load(), F.col("value"), ads=ads)


def sharded(lines: DataFrame, pos: str, *, offset: int, stride: int) -> DataFrame:
    """What one of ``stride`` parallel readers takes: every line whose place leaves ``offset``. The filter reaches the scan where the place is a column of it."""
    return lines.where(F.pmod(F.col(pos), F.lit(stride)) == offset)


def routed(rows: DataFrame, how: str, tasks: int, *, by: list[str] | None = None, out: str = "task") -> DataFrame:
    """Rows with the downstream task that a grouping sends them to.

    ``fields``: by a hash of ``by``, equal fields together, null a value like any other; ``shuffle``: evenly, by a hash of the
    columns ``by`` that tell rows apart; ``all``: a copy for each task; ``global``: the first task. Repartition by ``out`` to move them.
    """
    if how in ("fields", "shuffle"):
        point = F.conv(F.substring(F.md5(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by or []])), 1, 8), 16, 10).cast("long")
        return rows.withColumn(out, point % tasks)
    if how == "all":
        return rows.withColumn(out, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tasks - 1).cast("long"))))
    if how == "global":
        return rows.withColumn(out, F.lit(0).cast("long"))
    raise ValueError(f"no grouping named {how}")


def branched(rows: DataFrame, branches: dict[str, Column], *, out: str = "branch") -> DataFrame:
    """Every row once for each branch whose condition holds: one scan feeds them all."""
    taken = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in branches.items()]))
    return rows.withColumn(out, F.explode(taken))


def rekey(df: DataFrame, row_id: str, keys: int, *, out: str = "key") -> DataFrame:
    """Replace the key by one of ``keys`` uniform keys, a hash of the row id (md5: the same everywhere)."""
    point = F.conv(F.substring(F.md5(F.col(row_id).cast("string")), 1, 8), 16, 10).cast("long")
    return df.withColumn(out, point % keys)
