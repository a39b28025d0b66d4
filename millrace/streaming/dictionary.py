"""A key dictionary that grows with a stream: stored, append-only, dense."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import numbered
from ..sources.storage import shared_folder


class KeyDictionary:
    """Keys with dense ids in order of first appearance, under ``path``, one part for each micro-batch that brought new ones.

    A part is named by its micro-batch and says how many keys came before it, so that a micro-batch that runs again makes the same part in its
    own place: parts of later micro-batches don't exist then. Two streams must not share a path.
    """

    def __init__(self, spark: SparkSession, path: str, *, key: str, kind: str):
        self.spark, self.path, self.key, self.kind = spark, path, key, kind

    def table(self, *, before: int | None = None) -> DataFrame:
        """key and key_id, of the parts of micro-batches before one or of all."""
        schema = f"`{self.key}` {self.kind}, key_id long, batch long"
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], schema).drop("batch")
        rows = self.spark.read.schema(schema).parquet(self.path)
        return (rows if before is None else rows.where(F.col("batch") < before)).drop("batch")

    def add(self, rows: DataFrame, order: str, number: int) -> None:
        """Give the new keys of micro-batch ``number`` the next ids, by their first place in ``order``, ties by key. Null keys are a key."""
        known = self.table(before=number)
        first = rows.groupBy(self.key).agg(F.min(order).alias("_first")).alias("f")
        new = first.join(known.alias("k"), F.col(f"f.{self.key}").eqNullSafe(F.col(f"k.{self.key}")), "left_anti")
        base = known.count()
        ids = numbered(new, [], "_first", [self.key], out="_n").select(self.key, (F.col("_n") - 1 + base).alias("key_id"))
        ids.write.mode("overwrite").parquet(f"{self.path}/batch={number}")


def grown_dictionary(stream: DataFrame, *, key: str, order: str, path: str | None = None, checkpoint: str | None = None):
    """Drain a stream into a key dictionary; the query and the dictionary. With ``path`` and ``checkpoint`` of before it goes on where it stopped."""
    spark = stream.sparkSession
    held = KeyDictionary(spark, path or shared_folder(spark, "keys"), key=key, kind=stream.schema[key].dataType.simpleString())
    query = stream.writeStream.foreachBatch(lambda batch, number: held.add(batch, order, number)).option("checkpointLocation", checkpoint or shared_folder(spark, "keys-progress")).trigger(availableNow=True).start()
    return query, held
