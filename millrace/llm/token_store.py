"""Token ids in raw shard files with a minimal perfect hash index for keyed access.

A shard is two files. The payload file holds ids end to end, two or four bytes each. The index file
holds a JSON header line, the hash's bits, and by slot a 32-bit key fingerprint, the first id and
the number of ids; then the document ids in file order. A lookup deals the key to its shard by range, hashes the key to its slot,
compares the fingerprint and reads one range of the payload.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .files import new_file, open_input
from .mph import MinimalPerfectHash, mix
from .tokens import encoder

SLICE_BYTES = 1 << 20
#: A task starts a new shard, at the next id, beyond so many documents or ids.
SHARD_DOCS, SHARD_IDS = 1 << 21, 1 << 28
MANIFEST = "shard long, docs long, ids long, nulls long, least long, payload string, index string"


def document_keys(ids: np.ndarray, nulls: int = 0, salt: int = 0) -> np.ndarray:
    """64-bit keys of ascending document ids, the first ``nulls`` of them null; repeats of an id are told apart by their number."""
    if not len(ids):
        return np.zeros(0, np.uint64)
    at = np.arange(len(ids))
    first = np.concatenate([[True], (ids[1:] != ids[:-1]) | (at[1:] == nulls)])
    nth = (at - np.maximum.accumulate(np.where(first, at, 0))).astype(np.uint64)
    keys = mix(ids.view(np.uint64), 1000 + salt)
    keys[:nulls] = mix(np.zeros(nulls, np.uint64), 5000 + salt)
    return keys + mix(nth, 9000 + salt) * (nth > 0)


class Shard:
    """An opened shard."""

    def __init__(self, folder: str, index: str, payload: str):
        with open_input(folder, index) as f:
            raw = f.read()
        line, _, body = raw.partition(b"\n")
        head, at = json.loads(line), 0

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(body, kind, n, at)
            at += out.nbytes
            return out

        self.width, self.salt, self.nulls = head["width"], head["salt"], head["nulls"]
        self.hash = MinimalPerfectHash(head["levels"], take("u1", head["bits"]))
        n = head["docs"]
        self.first, self.count, self.fingerprint, self.doc_ids = take("<u8", n), take("<u4", n), take("<u4", n), take("<i8", n)
        self.payload = open_input(folder, payload)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slots of keys, or -1."""
        slots = self.hash.slots(keys)
        known = slots < len(self.first)
        known[known] = self.fingerprint[slots[known]] == (mix(keys[known], 77) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return np.where(known, slots, -1)

    def find_ids(self, ids: np.ndarray, nulls: int = 0) -> np.ndarray:
        """Slots of ascending document ids, the first ``nulls`` of them null, or -1."""
        return self.find(document_keys(ids, nulls, self.salt))

    def read(self, slot: int) -> np.ndarray:
        return self.read_range(int(self.first[slot]), int(self.count[slot]))

    def read_range(self, first: int, count: int) -> np.ndarray:
        return np.frombuffer(self.payload.read_at(count * self.width, first * self.width), f"<u{self.width}")


class _Writer:
    """A shard that is being written."""

    def __init__(self, folder: str, shard: int, width: int):
        self.folder, self.shard, self.width = folder, shard, width
        self.ids: list[np.ndarray] = []
        self.counts: list[int] = []
        self.nulls = self.total = 0
        self.out, self.name = new_file(folder, f"shard-{shard:012d}", ".ids")

    def close(self) -> pa.RecordBatch:
        """Finish both files; the manifest's row."""
        self.out.close()
        docs, count = np.concatenate(self.ids), np.array(self.counts, np.uint32)
        first = np.cumsum(count, dtype=np.uint64) - count
        for salt in range(16):  # two keys that are equal need another salt
            keys = document_keys(docs, self.nulls, salt)
            if len(np.unique(keys)) == len(keys):
                break
        mph = MinimalPerfectHash.build(keys)
        by_slot = np.full(len(docs), -1, np.int64)
        by_slot[mph.slots(keys)] = np.arange(len(docs))
        if (by_slot < 0).any():
            raise ValueError("the hash doesn't cover its keys")
        head = {"docs": len(docs), "levels": mph.sizes, "bits": len(mph.bits), "width": self.width, "salt": salt, "nulls": self.nulls}
        fingerprint = (mix(keys, 77) & np.uint64(0xFFFFFFFF)).astype("<u4")
        stream, index = new_file(self.folder, f"shard-{self.shard:012d}", ".idx")
        with stream:
            stream.write(json.dumps(head).encode() + b"\n")
            for part in (mph.bits, first[by_slot].astype("<u8"), count[by_slot].astype("<u4"), fingerprint[by_slot], docs.astype("<i8")):
                stream.write(part.tobytes())
        least = int(docs[self.nulls]) if self.nulls < len(docs) else None
        row = {"shard": self.shard, "docs": len(docs), "ids": int(count.sum()), "nulls": self.nulls, "least": least, "payload": self.name, "index": index}
        return pa.RecordBatch.from_arrays([pa.array([v], pa.string() if k in ("payload", "index") else pa.int64()) for k, v in row.items()], list(row))


def _write(folder: str, vocabulary: str, end_id: int, width: int, shard_docs: int, shard_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, encode = TaskContext.get().partitionId(), encoder(vocabulary).encode
        end, open_, number = np.array([end_id], f"<u{width}").tobytes(), None, 0
        for batch in batches:
            data, offsets = common.text_buffers(batch.column(1))
            raw = data.tobytes()
            null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            ids = batch.column(0).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
            for lo, hi in common.slices(offsets, SLICE_BYTES):
                bounds = offsets[lo : hi + 1].tolist()
                encoded = encode([raw[a:b] for a, b in zip(bounds, bounds[1:], strict=False)])
                if width == 2 and any(np.frombuffer(x, "<u4").max(initial=0) > 0xFFFF for x in encoded):
                    raise ValueError("an id needs more than two bytes: give width=4")
                at = 0
                while at < hi - lo:
                    if open_ and (len(open_.counts) >= shard_docs or open_.total >= shard_ids) and (ids[lo + at] != open_.ids[-1][-1] or null[lo + at] != (open_.nulls == len(open_.counts))):
                        yield open_.close()
                        open_, number = None, number + 1
                    open_ = open_ or _Writer(folder, (task << 24) + number, width)
                    full = len(open_.counts) >= shard_docs or open_.total >= shard_ids
                    stop = at + 1 if full else min(hi - lo, at + shard_docs - len(open_.counts))
                    for x in encoded[at:stop]:
                        open_.out.write((x if width == 4 else np.frombuffer(x, "<u4").astype("<u2").tobytes()) + end)
                        open_.counts.append(len(x) // 4 + 1)
                        open_.total += len(x) // 4 + 1
                    open_.ids.append(ids[lo + at : lo + stop])
                    open_.nulls += int(null[lo + at : lo + stop].sum())
                    at = stop
        if open_:
            yield open_.close()

    return run


def write_token_store(docs: DataFrame, vocabulary: str, folder: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, width: int = 2, shard_docs: int = SHARD_DOCS, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode every document and write shards in ascending id order (nulls first); returns the stored manifest.

    ``width`` is the bytes of an id in the payload: 2 suffices below 65,536 ids, and a larger id is an error. A null or empty
    text is its end id alone. Rows with equal ids keep one entry each, in one shard. A shard ends at the first new id beyond
    ``shard_docs`` documents or about ``shard_ids`` ids, so that its index fits in memory. An empty table has an empty manifest.
    """
    spark = docs.sparkSession
    order = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).repartitionByRange(common.shuffle_partitions(spark), "id").sortWithinPartitions("id")
    return common.stored(order.mapInArrow(_write(folder, vocabulary, end_id, width, shard_docs, shard_ids), MANIFEST), "token-manifest")


_FOUND = T.StructType([T.StructField(c, T.LongType()) for c in ("id", "start", "n_tokens", "ids_crc32")])


def _lookup(folder: str):
    def run(wanted: pa.Table, manifest: pa.Table) -> Iterator[pa.RecordBatch]:
        if not wanted.num_rows:
            return
        if not manifest.num_rows:
            raise KeyError("no shard holds these documents")
        row = manifest.slice(0, 1).to_pylist()[0]
        shard = Shard(folder, row["index"], row["payload"])
        ids = wanted.column("id").combine_chunks()
        nulls = ids.null_count
        ids = np.concatenate([np.zeros(nulls, np.int64), np.sort(ids.drop_null().to_numpy())])
        slots = shard.find_ids(ids, nulls)
        if (slots < 0).any():
            raise KeyError(f"{row['index']} misses {int((slots < 0).sum())} documents")
        first, count = shard.first[slots].astype(np.int64), shard.count[slots].astype(np.int64)
        for lo in range(0, len(slots), 2000):
            part = slice(lo, min(lo + 2000, len(slots)))
            begin = int(first[part].min(initial=0)) if (first[part].max(initial=0) - first[part].min(initial=0)) * shard.width < 64 << 20 else None
            if begin is None:  # far apart: one read each
                crc = [zlib.crc32(shard.read(int(s)).astype("<u4").tobytes()) for s in slots[part]]
            else:
                block = shard.read_range(begin, int((first[part] + count[part]).max(initial=begin)) - begin).astype("<u4")
                crc = [zlib.crc32(block[a - begin : a - begin + n].tobytes()) for a, n in zip(first[part].tolist(), count[part].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids[part], mask=np.arange(part.start, part.stop) < nulls), pa.array(first[part] + row["base"]), pa.array(count[part]), pa.array(crc, pa.int64())], _FOUND.names)

    def whole(wanted: pa.Table, manifest: pa.Table) -> pa.Table:
        batches = list(run(wanted, manifest))
        return pa.Table.from_batches(batches) if batches else pa.schema([(n, pa.int64()) for n in _FOUND.names]).empty_table()

    return whole


def read_token_store(manifest: DataFrame, folder: str, wanted: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Look documents up by key: the id, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids_crc32``.

    ``wanted`` has one row for each lookup; its ids are dealt to the shards by range, and found there through the hash alone. The
    n-th row with one id (or none) finds the n-th document of that id. An id that the store doesn't hold is an error.
    """
    before = Window.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = common.stored(manifest.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0))), "token-shards")
    # one number for each shard
    starts = [(r["least"], r["shard"]) for r in placed.where("least is not null").select("least", "shard").orderBy("least").collect()]
    least, shard = np.array([x for x, _ in starts], np.int64), np.array([x for _, x in starts], np.int64)
    none = placed.where("nulls > 0").agg(F.min("shard")).first()[0]

    @F.pandas_udf("long")
    def shard_of(ids: pd.Series) -> pd.Series:
        at = pa.array(ids, pa.int64(), from_pandas=True).fill_null(common.NULL_ID).to_numpy()
        if not len(least):
            return pd.Series(np.full(len(at), -1))
        return pd.Series(shard[np.maximum(np.searchsorted(least, at, "right") - 1, 0)])

    ids = wanted.select(F.col(f"`{id_col}`").cast("long").alias("id"))
    dealt = ids.withColumn("shard", F.when(F.col("id").isNull(), F.lit(none)).otherwise(shard_of("id")))
    found = dealt.groupBy("shard").cogroup(placed.select("shard", "base", "payload", "index").groupBy("shard")).applyInArrow(_lookup(folder), _FOUND)
    return found.withColumnRenamed("id", id_col)


def token_store_digest(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2) -> DataFrame:
    """Write a token store to the shared folder and look every document of ``docs`` up in it by key."""
    spark: SparkSession = docs.sparkSession
    folder = common.scratch(spark, "token-store")
    manifest = write_token_store(docs, vocabulary, folder, id_col=id_col, text_col=text_col, end_id=end_id)
    return read_token_store(manifest, folder, docs, id_col=id_col)
