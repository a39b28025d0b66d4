"""Harmonic packing of token sequences.

A piece of length n belongs to the reciprocal class k = capacity // n; every sequence of a class
holds exactly k pieces. A document's tail that would waste its share of a sequence is cut at a
reciprocal of the capacity, so that shares are nearly full. Classes are filled independently:
a piece's place follows from its rank in its class alone, and ranks follow from the counts that
each task keeps, without shuffling token ids. What is left of each class's last sequence - at
most one sequence's worth a class, however large the input - is laid end to end and cut freely.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .tokens import encoder

SLICE_BYTES = 1 << 20
#: A cut leaves this many tokens at least, or none.
LEAST_TAIL = 32


def cut_lengths(n: int, capacity: int, waste: float) -> list[int]:
    """Lengths of a document's pieces, in order: whole sequences, then shares of one."""
    out = [capacity] * (n // capacity)
    n %= capacity
    while n:
        k = capacity // n
        if capacity - k * n <= waste * capacity:
            out.append(n)
            break
        k += 1
        while (left := n - capacity // k) and left < LEAST_TAIL and capacity // k > LEAST_TAIL:
            k += 1
        out.append(capacity // k)
        n = left
    return out


def _pieces(path: str, end_id: int, capacity: int, waste: float):
    end = np.array([end_id], "<u4").tobytes()
    names = ["id", "start", "length", "doc_tokens", "class", "task", "nth", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen, encode = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), encoder(path).encode
        for batch in batches:
            data, offsets = common.text_buffers(batch.column(1))
            raw = data.tobytes()
            for lo, hi in common.slices(offsets, SLICE_BYTES):
                out: list[list] = [[] for _ in range(7)]
                bounds = offsets[lo : hi + 1].tolist()
                for i, ids in enumerate(encode([raw[a:b] for a, b in zip(bounds, bounds[1:], strict=False)])):
                    ids += end
                    total, at = len(ids) // 4, 0
                    for n in cut_lengths(total, capacity, waste):
                        k = capacity // n
                        for column, v in zip(out, (lo + i, at, n, total, k, int(seen[k]), ids[4 * at : 4 * (at + n)]), strict=True):
                            column.append(v)
                        seen[k] += 1
                        at += n
                columns = [batch.column(0).take(pa.array(out[0], pa.int64())), *(pa.array(c, pa.int64()) for c in out[1:5]), pa.array(np.full(len(out[0]), task)), pa.array(out[5], pa.int64()), pa.array(out[6], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def pack_documents(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, capacity: int = 4096, waste: float = 0.02, with_ids: bool = True) -> DataFrame:
    """Tokenise, cut and pack every document into sequences of at most ``capacity`` tokens.

    Returns one row for each piece: the id, ``start`` (the document's ids before it), ``length``,
    ``ids_crc32`` (of its little-endian unsigned 32-bit ids), ``doc_tokens`` (with the end id), ``sequence_id``,
    ``offset`` in the sequence (gapless from 0), and ``ids`` as bytes with ``with_ids``. Every id of a document
    lies in exactly one piece.

    A null or empty text is its end id alone. Null ids stay null; rows with equal ids are packed each for
    itself. An empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType
    longs = [T.StructField(c, T.LongType()) for c in ("start", "length", "doc_tokens", "class", "task", "nth")]
    schema = T.StructType([T.StructField("id", kind), *longs, T.StructField("ids", T.BinaryType())])
    pieces = common.stored(docs.select(f"`{id_col}`", f"`{text_col}`").mapInArrow(_pieces(vocabulary, end_id, capacity, waste), schema), "pieces")
    counts = common.stored(pieces.groupBy("class", "task").agg((F.max("nth") + 1).alias("n")), "piece-counts")
    w = Window.partitionBy("class").orderBy("task")
    tasks = counts.select("class", "task", (F.sum("n").over(w) - F.col("n")).alias("before"))
    classes = counts.groupBy("class").agg(F.sum("n").alias("n")).withColumn("full", F.floor(F.col("n") / F.col("class")))
    # at most ``capacity`` classes exist, whatever the input
    all_classes = Window.partitionBy(F.lit(0))
    classes = classes.withColumn("first_sequence", F.sum("full").over(all_classes.orderBy("class")) - F.col("full")).withColumn("all_full", F.sum("full").over(all_classes))
    places = tasks.join(F.broadcast(classes.select("class", "full", "first_sequence", "all_full")), "class")
    small = counts.count() <= 200_000  # otherwise the places join by shuffle
    ranked = pieces.join(F.broadcast(places) if small else places, ["class", "task"]).withColumn("rank", F.col("before") + F.col("nth"))
    ranked = ranked.withColumn("bin", F.floor(F.col("rank") / F.col("class")))
    payload = [F.crc32("ids").alias("ids_crc32"), *(["ids"] if with_ids else [])]
    inside = ranked.where("bin < full").select("id", "start", "length", "doc_tokens", (F.col("first_sequence") + F.col("bin")).alias("sequence_id"), "rank", *payload)
    in_sequence = Window.partitionBy("sequence_id").orderBy("rank")
    inside = inside.withColumn("offset", F.sum("length").over(in_sequence) - F.col("length"))
    # the last sequence of each class: a bounded number of tokens, laid end to end in the order of classes
    rest = ranked.where("bin >= full").select("id", "start", "length", "doc_tokens", "class", "rank", "all_full", "ids")
    totals = rest.groupBy("class").agg(F.sum("length").alias("total"))
    totals = totals.select("class", (F.sum("total").over(all_classes.orderBy("class")) - F.col("total")).alias("class_at"))
    along = Window.partitionBy("class").orderBy("rank")
    rest = rest.join(F.broadcast(totals), "class").withColumn("at", F.col("class_at") + F.sum("length").over(along) - F.col("length"))
    rest = rest.withColumn("s", F.explode(F.sequence(F.floor(F.col("at") / capacity), F.floor((F.col("at") + F.col("length") - 1) / capacity))))
    rest = rest.withColumn("skip", F.greatest(F.col("s") * capacity - F.col("at"), F.lit(0)))
    rest = rest.withColumn("n", F.least(F.col("at") + F.col("length"), (F.col("s") + 1) * capacity) - F.col("at") - F.col("skip"))
    rest = rest.withColumn("ids", F.expr("substring(ids, cast(4 * skip + 1 as int), cast(4 * n as int))"))
    rest = rest.select("id", (F.col("start") + F.col("skip")).alias("start"), F.col("n").alias("length"), "doc_tokens", (F.col("all_full") + F.col("s")).alias("sequence_id"), *payload, (F.col("at") + F.col("skip") - F.col("s") * capacity).alias("offset"))
    columns = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]
    return inside.unionByName(rest, allowMissingColumns=True).select(F.col("id").alias(id_col), *columns)
