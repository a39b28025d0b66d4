"""Documents to training sequences: classify, drop near-duplicates, cut repeated passages, mix sources, pack.

Each stage takes what its predecessor kept, written as Parquet and read again, and returns a DataFrame with
the columns of ``documents``; the last returns packed pieces with their token ids.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common
from millrace.llm.gbdt import classify_quality
from millrace.llm.minhash import near_duplicate_groups
from millrace.llm.mixing import mix_sources
from millrace.llm.packing import pack_documents
from millrace.llm.queries import vocabulary
from millrace.llm.substring_index import remove_repeated_windows

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _key(id_col: str, text_hash) -> Column:
    """A string for an id and a text, which tells rows with one id or none apart: ordered by id, null ids last."""
    ordered = F.lpad(F.hex(F.col(id_col).cast("long").bitwiseXOR(F.lit(-(1 << 63)).cast("long"))), 16, "0")
    return F.concat(F.coalesce(ordered, F.lit("null")), F.lit(":"), F.lpad(F.hex(text_hash), 16, "0"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS, _key("doc_id", F.xxhash64("text")).alias("_key"))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    return _keyed(docs).join(gone.select("_key").distinct(), "_key", "left_anti").select(COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go, row by row: rows with one id or none are judged by their own texts."""
    scored = classify_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), hash_col="_hash")
    return _without(docs, scored.where("predicted = 0").select(_key("doc_id", F.col("_hash")).alias("_key")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the smallest id, numbered before null ones, then by text hash.

    Rows with one id or none are documents of their own; of equal rows one stays.
    """
    keyed = _keyed(docs)
    rows = near_duplicate_groups(keyed, id_col="_key").groupBy("_key").agg(F.min("kept").alias("kept"), F.count("*").alias("n"), F.max("n_shingles").alias("n_shingles"))
    settled = common.stored(rows.where("not kept or (n > 1 and n_shingles > 0)").select("_key", "kept"), "near-settled")
    out, copies = _without(docs, settled), settled.where("kept")
    if not copies.isEmpty():
        out = out.unionByName(keyed.join(copies, "_key", "left_semi").dropDuplicates(["_key"]).select(COLUMNS))
    return out


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated 13-word windows are cut out; other texts stay as they are, and texts that lose every word go."""
    cut = remove_repeated_windows(docs).where("n_removed = 0 or n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return cut.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are replicated to tempered weights, in a global random order."""
    return mix_sources(docs).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids packed into sequences of 4096."""
    return pack_documents(docs, vocabulary())


STAGES = [("quality_classifier", quality_classifier), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mix_sources", mix), ("packing", pack)]
#: Learnt and tokenised stages: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.

    A stage's scratch tables and its input go once its result is written; the last stage's stay for the result's readers.
    """
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (name, stage) in enumerate(STAGES):
        with common.Scope() as scope:
            docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            before, path = path, f"{common.scratch_root(spark)}/pipeline/{name}-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            scope.drop(spark)
            if before:
                common.drop_path(spark, before)
    return docs
