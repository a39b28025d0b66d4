"""Tables as streams and back: a table replayed in an order, a stream drained to a table."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import bucketed, numbered
from ..sources.storage import shared_folder


#: Rows of one file of a replayed table: one task's work.
FILE_ROWS = 20_000


def replayed(df: DataFrame, order: str, *, parts: int = 3, name: str = "feed", file_rows: int = FILE_ROWS) -> DataFrame:
    """A table as a stream: written in ``parts`` by the order of a numeric column, one after the other, which arrive as one micro-batch each.

    A part has as many files as its rows need, ``file_rows`` each, so that no task takes a part whole. All parts have equally many files, empty ones
    where rows don't suffice, since a micro-batch is a count of files. Rows without an order value come with the first part.
    """
    spark, path = df.sparkSession, shared_folder(df.sparkSession, name)
    cut = bucketed(df, order, parts).withColumn("_bucket", F.greatest("_bucket", F.lit(0).cast("long"))).persist(StorageLevel.MEMORY_AND_DISK)
    counts = dict(cut.groupBy("_bucket").count().collect()) or {0: 0}  # a row for each part
    files = max(1, -(-max(counts.values()) // file_rows))
    for i, part in enumerate(sorted(counts)):
        rows = cut.where(F.col("_bucket") == part).drop("_bucket")
        (rows.repartition(files) if files > 1 else rows.coalesce(1)).write.mode("append").parquet(path)
        for _ in range(files * (i + 1) - len(spark.read.schema(df.schema).parquet(path).inputFiles()) if files > 1 else 0):
            df.limit(0).coalesce(1).write.mode("append").parquet(path)
    cut.unpersist()
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


def drained(stream: DataFrame, name: str, *, runs: int = 1) -> DataFrame:
    """All rows that a stream gives once it has read what there is, as a table in the shared folder; with ``runs`` it is started anew so often, and goes on."""
    spark = stream.sparkSession
    path, progress = shared_folder(spark, name), shared_folder(spark, f"{name}-progress")
    for _ in range(runs):
        query = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", progress).trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def replayed_laps(df: DataFrame, *, order: str, tie: list[str], rows_per_batch: int, readers: int = 1, start_ms: int = 0, ms_per_batch: int = 1000) -> DataFrame:
    """A recorded table replayed for ever, as a load: ``position`` counts on, ``lap`` and ``line`` say where it is in the table, ``reader`` who reads it.

    Positions are Spark's own steady source, so that a restart goes on at the position after the last one that was committed, and a micro-batch that runs
    again has the same positions. The line's row meets its position by a join, in the order of ``order`` and ``tie``. Reader r of ``readers``
    has the lines r, r + readers, ...; ``at`` goes on by ``ms_per_batch`` with each micro-batch of ``rows_per_batch``. A run that takes what is
    available takes one micro-batch. An empty table gives no rows.
    """
    spark = df.sparkSession
    n = df.count()
    steady = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", rows_per_batch).option("numPartitions", readers).option("startTimestamp", start_ms).option("advanceMillisPerBatch", ms_per_batch).load()
    placed = steady.select(F.col("value").alias("position"), F.col("timestamp").alias("at"), F.floor(F.col("value") / max(n, 1)).alias("lap"), (F.col("value") % max(n, 1)).alias("line"))
    lines = numbered(df, [], order, tie, out="_line").withColumn("line", F.col("_line") - 1).drop("_line")
    return placed.withColumn("reader", (F.col("line") % readers).cast("int")).join(lines, "line")
