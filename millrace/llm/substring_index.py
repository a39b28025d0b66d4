"""Incremental removal of repeated word windows by a log-structured fingerprint index.

The index holds a 64-bit fingerprint of every word window of all documents seen so
far, with a 32-bit check hash that doesn't follow from it, as immutable sorted runs split into buckets by
the leading bits. A new batch of documents (all its ids above those already indexed) goes through three steps:

1. each slice of text emits its distinct window fingerprints with their checks, sorted and packed,
   one row for each bucket however many ranges its documents are from;
2. each bucket merge-joins the batch's sorted arrays with the runs of the index and
   with each other by fingerprint, and verifies what meets by the checks: a window that the index or a lower range
   holds is a repeat. Two texts with one fingerprint are told apart here, and both are held.
   What is new becomes the next run, a file for each bucket that later tasks read where it lies; too many
   runs are merged into one (compaction);
3. each range takes its documents and its repeated windows together, settles repeats inside the range
   by document id, and removes the covered words.

Rows that cross a shuffle are packed arrays, at about nine bytes for a window. Every
array of a bucket holds a window once however often it repeats, so that hot passages
weigh no more than rare ones. A manifest names the runs, so that another session can go on with an index.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from xxhash import xxh3_64_intdigest

from . import common
from .files import new_file, open_input

_FACTOR = 0x9E3779B97F4A7C15
#: Text that a worker takes apart at once.
SLICE_BYTES = 8 << 20
#: Text in a range of documents.
GROUP_BYTES = 8 << 20
#: Text of the table for each bucket, where that makes more of them than shuffle partitions do.
BUCKET_BYTES = 128 << 20
_KEYS = "_mr_bucket long, _mr_range long, _mr_keys binary, _mr_checks binary"
#: What a slice emits: the range of all its keys, or -1 and each key's own in ``_mr_ranges``.
_NEW = _KEYS + ", _mr_ranges binary"
_RUN = "_mr_bucket long, _mr_file string"


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """The words of each row; for each word its row and its hash."""
    raw = data.tobytes()
    rows = [raw[a:b].split() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    counts = np.array([len(r) for r in rows], np.int64)
    h = np.empty(int(counts.sum()), np.uint64)
    at = 0
    for r in rows:
        h[at : at + len(r)] = np.fromiter(map(xxh3_64_intdigest, r), np.uint64, len(r))
        at += len(r)
    return rows, np.repeat(np.arange(len(rows)), counts), h


def windows_of(h: np.ndarray, words: int, factor: int = _FACTOR, mask: int | None = None) -> np.ndarray:
    """For each word the hash of the window that starts there, cut to the bits of ``mask``.

    The hash of a window that would leave its row is meaningless; ``starts_ok`` tells which are whole.
    """
    total = len(h)
    w = np.zeros(total, np.uint64)
    if total >= words:
        n = total - words + 1
        for j in range(words):
            w[:n] *= np.uint64(factor)
            w[:n] += h[j : j + n]
        w ^= w >> np.uint64(32)
        w *= np.uint64(0xD6E8FEB86659FD93)
    return w if mask is None else w & np.uint64(mask)


def checks_of(h: np.ndarray, words: int) -> np.ndarray:
    """A 32-bit hash of each window that doesn't follow from its fingerprint: word hashes are mixed anew before they are put together."""
    g = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (windows_of(g ^ (g >> np.uint64(32)), words, 0xC2B2AE3D27D4EB4F) >> np.uint64(32)).astype(np.uint32)


def _in_order(keys: np.ndarray, checks: np.ndarray, third: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The order by key, check and a third value, and where in it a new pair of key and check begins."""
    order = np.argsort(keys) if third is None else np.lexsort((third, keys))
    k, c = keys[order], checks[order]
    same, other = k[1:] == k[:-1], c[1:] != c[:-1]
    if (same & other).any():  # several texts under one fingerprint
        order = np.lexsort((checks, keys) if third is None else (third, checks, keys))
        k, c = keys[order], checks[order]
        same, other = k[1:] == k[:-1], c[1:] != c[:-1]
    return order, np.concatenate([[True], ~same | other]) if len(k) else np.zeros(0, bool)


def _holds(keys: np.ndarray, checks: np.ndarray, k: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Which pairs (k, c) lie among ordered pairs (keys, checks): fingerprints by search, then their checks."""
    out = np.zeros(len(k), bool)
    at = np.searchsorted(keys, k)
    todo = np.arange(len(k))
    while len(todo):
        todo = todo[at[todo] < len(keys)]
        todo = todo[keys[at[todo]] == k[todo]]
        hit = checks[at[todo]] == c[todo]
        out[todo[hit]] = True
        todo = todo[~hit]
        at[todo] += 1
    return out


def starts_ok(counts: np.ndarray, words: int) -> np.ndarray:
    """Which word positions start a whole window."""
    ends = np.repeat(np.cumsum(counts), counts)
    return np.arange(len(ends)) + words <= ends


class FingerprintIndex:
    """Sorted immutable runs of window fingerprints in a shared folder.

    Without ``folder`` the index lives in scratch. With one, ``save`` writes a manifest there, and the next
    ``FingerprintIndex`` on the folder, in whatever session, goes on from it.
    """

    def __init__(self, spark: SparkSession, words: int = 13, buckets: int = 256, most_runs: int = 3, folder: str | None = None, mask: int | None = None):
        self.spark, self.words, self.most_runs, self.folder, self.mask = spark, words, most_runs, folder, mask
        self.bits = max(4, (buckets - 1).bit_length())
        self.runs: list[str] = []  # tables that name the files of a run by bucket
        self.highest: int | None = None
        self.number = 0
        self.store = f"{folder}/runs" if folder else common.scratch(spark, "substring-runs")
        if folder and (saved := self._manifest()) is not None:
            if saved["words"] != words:
                raise ValueError(f"the index is of windows of {saved['words']} words")
            self.bits, self.runs, self.highest, self.mask = saved["bits"], saved["runs"], saved["highest"], saved["mask"]

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _manifest(self) -> dict | None:
        """The newest manifest of the folder: each is a row of its own, and counts once its file is written whole."""
        if not self._exists(f"{self.folder}/manifest"):
            return None
        row = self.spark.read.parquet(f"{self.folder}/manifest").orderBy(F.col("number").desc()).first()
        self.number = row["number"]
        return json.loads(row["json"])

    def save(self) -> None:
        """Write the manifest of what is indexed now."""
        state = {"words": self.words, "bits": self.bits, "runs": self.runs, "highest": self.highest, "mask": self.mask}
        self.number += 1
        self.spark.createDataFrame([(self.number, json.dumps(state))], "number long, json string").coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")

    def _path(self, name: str) -> str:
        return common.scratch(self.spark, name) if self.folder is None else f"{self.folder}/{name}-{uuid.uuid4().hex}"

    def history(self) -> DataFrame:
        """One row for each run and bucket: the file of its pairs."""
        if not self.runs:
            return self.spark.createDataFrame([], _RUN)
        return reduce(DataFrame.unionByName, (self.spark.read.schema(_RUN).parquet(p) for p in self.runs))

    def drop(self) -> None:
        """Delete every run."""
        common.drop_path(self.spark, self.store)
        for path in self.runs:
            common.drop_path(self.spark, path)
        self.runs = []

    def admit(self, docs: DataFrame, id_col: str) -> None:
        """Take documents' ids in: they must lie above those indexed before (null ids above all)."""
        row = docs.agg(F.min(id_col).alias("lo"), F.max(id_col).alias("hi"), F.count_if(F.col(id_col).isNull()).alias("none")).first()
        if self.highest is not None and (self.highest == common.NULL_ID and (row["hi"] is not None or row["none"]) or row["lo"] is not None and row["lo"] <= self.highest):
            raise ValueError(f"id {row['lo']} isn't above {self.highest}, the highest one indexed")
        if row["hi"] is not None or row["none"]:
            self.highest = common.NULL_ID if row["none"] else row["hi"]

    def add(self, docs: DataFrame, id_col: str, text_col: str, bounds: np.ndarray) -> DataFrame:
        """Index admitted documents, or a part of them in id order; returns their repeated windows by range."""
        keys = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(_emit(self.words, self.bits, bounds, self.mask), _NEW)
        out = self._path("substring-batch")
        merged = keys.groupBy("_mr_bucket").cogroup(self.history().groupBy("_mr_bucket")).applyInArrow(_merge(self.store), "_mr_kind string, _mr_file string, " + _KEYS)
        merged.write.partitionBy("_mr_kind").option("compression", "zstd").parquet(out)
        if self._exists(f"{out}/_mr_kind=run"):
            self.runs.append(f"{out}/_mr_kind=run")
        return self.spark.read.schema(_KEYS + ", _mr_kind string").parquet(out).where("_mr_kind = 'hit'").drop("_mr_kind")

    def compact(self) -> None:
        """Merge all runs into one where there are more than ``most_runs``; old ones go unless a saved manifest may name them."""
        if len(self.runs) <= self.most_runs:
            return
        old, store, path = self.runs, self.store, self._path("substring-run")
        if self.folder is None:
            self.store = common.scratch(self.spark, "substring-runs")
        self.history().groupBy("_mr_bucket").applyInArrow(_union_runs(store, self.store), _RUN).write.parquet(path)
        self.runs = [path]
        if self.folder is None:
            for p in (store, *old):
                common.drop_path(self.spark, p)


def write_run(store: str, bucket: int, keys: np.ndarray, checks: np.ndarray) -> str:
    """A bucket's pairs as a new file of this attempt's own; its name, by which alone it is found."""
    stream, name = new_file(store, f"bucket-{bucket:06d}", ".run")
    with stream:
        parts = [common.pack_keys(keys), np.ascontiguousarray(checks.astype("<u4")).tobytes()]
        stream.write(np.array([len(p) for p in parts], "<u8").tobytes())
        stream.write(pa.compress(b"".join(parts), codec="zstd", asbytes=True))
    return name


def read_run(store: str, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys and checks of a run's file, in order."""
    with open_input(store, name) as f:
        raw = f.read()
    n, m = np.frombuffer(raw, "<u8", 2).tolist()
    body = pa.decompress(raw[16:], n + m, codec="zstd", asbytes=True)
    return common.unpack_keys(body[:n]), np.frombuffer(body, "<u4", offset=n)


def _by_bucket(keys: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """The buckets of ascending keys, and where each lies."""
    cut = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    for b in np.flatnonzero(np.diff(cut)).tolist():
        yield b, slice(cut[b], cut[b + 1])


def _emit(words: int, bits: int, bounds: np.ndarray, mask: int | None):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release_caches()
        for batch in batches:
            data, offsets = common.text_buffers(batch.column(1))
            ranges = common.range_of(bounds, common.id_array(batch.column(0)))
            for lo, hi in common.slices(offsets, SLICE_BYTES):
                part = offsets[lo : hi + 1]
                _, row, h = word_hashes(data[part[0] : part[-1]], part - part[0])
                ok = starts_ok(np.bincount(row, minlength=hi - lo), words)
                w, c, of = windows_of(h, words, mask=mask)[ok], checks_of(h, words)[ok], ranges[lo:hi][row[ok]]
                out: tuple[list, ...] = ([], [], [], [], [])
                one = len(of) == 0 or bool((of == of[0]).all())
                order, new = _in_order(w, c, None if one else of)
                w, c, of = w[order], c[order], of[order]
                if not one:  # a window of several ranges stands once for each
                    new[1:] |= of[1:] != of[:-1]
                w, c, of = w[new], c[new], of[new]
                own = of.astype(np.min_scalar_type(int(of.max()))) if not one else None
                for b, at in _by_bucket(w, bits):
                    for column, v in zip(out, (b, int(of[0]) if one else -1, common.pack_keys(w[at]), c[at].astype("<u4").tobytes(), None if one else own[at].tobytes()), strict=True):
                        column.append(v)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64() if i < 2 else pa.binary()) for i, v in enumerate(out)], ["_mr_bucket", "_mr_range", "_mr_keys", "_mr_checks", "_mr_ranges"])

    return emit


def _read_pairs(rows: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The arrays of packed rows, and all keys and checks end to end."""
    arrays = [common.unpack_keys(x.as_py()) for x in rows.column("_mr_keys")]
    checks = [np.frombuffer(x.as_py(), "<u4") for x in rows.column("_mr_checks")]
    return arrays, np.concatenate([np.zeros(0, np.uint64), *arrays]), np.concatenate([np.zeros(0, np.uint32), *checks])


def _ranges_of(one: int, each: bytes | None, n: int) -> np.ndarray:
    """The range of each of a packed row's keys."""
    return np.full(n, one, np.int64) if each is None else np.frombuffer(each, f"<u{len(each) // n}").astype(np.int64)


def _merge(store: str):
    def run(new: pa.Table, history: pa.Table) -> pa.Table:
        """One bucket: the repeated windows of each range, and the run of those that are new."""
        out: tuple[list, ...] = ([], [], [], [], [])
        bucket = (new if new.num_rows else history).column("_mr_bucket")[0].as_py()
        if new.num_rows:
            arrays, keys, checks = _read_pairs(new)
            of = np.concatenate([_ranges_of(g, raw, len(a)) for g, raw, a in zip(new.column("_mr_range").to_pylist(), new.column("_mr_ranges").to_pylist(), arrays, strict=True)])
            order, first = _in_order(keys, checks, of)
            keys, checks, of = keys[order], checks[order], of[order]
            lowest = of[np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0))]
            known = np.zeros(len(keys), bool)
            for name in history.column("_mr_file").to_pylist():
                known |= _holds(*read_run(store, name), keys, checks)
            hit = np.flatnonzero(known | (of > lowest))
            hit = hit[np.argsort(of[hit], kind="stable")]
            for g in np.unique(of[hit]):
                at = hit[np.searchsorted(of[hit], g) : np.searchsorted(of[hit], g, "right")]
                for column, v in zip(out, ("hit", None, int(g), common.pack_keys(keys[at]), checks[at].astype("<u4").tobytes()), strict=True):
                    column.append(v)
            if (fresh := first & ~known).any():
                for column, v in zip(out, ("run", write_run(store, bucket, keys[fresh], checks[fresh]), -1, None, None), strict=True):
                    column.append(v)
        kinds = [pa.string(), pa.string(), pa.int64(), pa.binary(), pa.binary()]
        kind, name, ranges, packs, held = (pa.array(c, t) for c, t in zip(out, kinds, strict=True))
        return pa.table({"_mr_kind": kind, "_mr_file": name, "_mr_bucket": pa.array([bucket] * len(kind), pa.int64()), "_mr_range": ranges, "_mr_keys": packs, "_mr_checks": held})

    return run


def _union_runs(old: str, new: str):
    def run(runs: pa.Table) -> pa.Table:
        parts = [read_run(old, name) for name in runs.column("_mr_file").to_pylist()]
        keys, checks = (np.concatenate(x) for x in zip(*parts, strict=True))
        order, first = _in_order(keys, checks)
        bucket = runs.column("_mr_bucket")[0].as_py()
        return pa.table({"_mr_bucket": pa.array([bucket], pa.int64()), "_mr_file": pa.array([write_run(new, bucket, keys[order][first], checks[order][first])])})

    return run


def _remove(words: int, id_col: str, text_col: str, schema: pa.Schema, mask: int | None):
    def remove(docs: pa.Table, hits: pa.Table) -> pa.Table:
        if docs.num_rows == 0:
            return schema.empty_table()
        _, found, found_checks = _read_pairs(hits)
        order, new = _in_order(found, found_checks)
        found, found_checks = found[order][new], found_checks[order][new]
        data, offsets = common.text_buffers(docs.column(text_col))
        ids = common.id_array(docs.column(id_col))
        rows, row, h = word_hashes(data, offsets)
        counts = np.array([len(r) for r in rows], np.int64)
        at = np.flatnonzero(starts_ok(counts, words))
        w, c, own = windows_of(h, words, mask=mask)[at], checks_of(h, words)[at], ids[row[at]]
        order, first = _in_order(w, c, own)
        lowest = np.empty(len(w), np.int64)
        lowest[order] = own[order][np.maximum.accumulate(np.where(first, np.arange(len(w)), 0))] if len(w) else 0
        del order, first
        starts = at[(lowest < own) | _holds(found, found_checks, w, c)]
        # what the words' lists need from here on is all that stays
        del w, c, own, lowest, at, h, found, found_checks
        cover = np.zeros(len(row) + words + 1, np.int32)
        np.add.at(cover, starts, 1)
        np.add.at(cover, starts + words, -1)
        covered = np.cumsum(cover)[: len(row)] > 0
        del cover, starts
        removed = np.bincount(row, covered, len(rows)).astype(np.int64)
        kept, pos = [], 0
        for r, n in zip(rows, removed.tolist(), strict=True):
            kept.append(b" ".join(x for x, c in zip(r, covered[pos : pos + len(r)].tolist(), strict=True) if not c) if n else b" ".join(r))
            pos += len(r)
        out = {f.name: docs.column(f.name) for f in schema if f.name in docs.column_names}
        out |= {"n_words": pa.array(counts), "n_removed": pa.array(removed), "kept_text": pa.array(kept, pa.binary()).cast(pa.string())}
        return pa.table([out[f.name].cast(f.type) for f in schema], schema=schema)

    return remove


def remove_repeated_windows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 13, batches: int = 4, group_bytes: int = GROUP_BYTES, index: FingerprintIndex | None = None) -> DataFrame:
    """Remove each word that a window of ``words`` words covers whose sequence also starts in a document with a smaller id.

    Windows are judged on the input, not on what is left. The table is indexed in ``batches``
    batches of ascending ids, each merge-joined with the runs before it. Returns the input's
    columns with ``n_words``, ``n_removed`` and ``kept_text`` (kept words joined by one space);
    input columns of these names give way to them.

    With an ``index`` that already holds documents, the ids of ``docs`` must be greater than theirs; windows that those documents
    hold are removed too, and the new documents enter the index, which its ``save`` keeps.

    A null text has no words. A null id counts as larger than every id: such rows lose what
    numbered documents hold and never cost another row a word. Rows with equal ids never cost
    each other words. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = common.pick(docs, id_col, text_col, ["n_words", "n_removed", "kept_text"])
    bounds, size = common.id_ranges(docs, id_col, text_col, group_bytes)
    n = len(bounds) + 1
    ends = sorted({n * (i + 1) // batches for i in range(batches)} - {0})
    index, ours = index or FingerprintIndex(spark, words, buckets=max(64, 4 * common.shuffle_partitions(spark), -(-size // BUCKET_BYTES))), index is None
    if index.words != words:
        raise ValueError(f"the index is of windows of {index.words} words")
    if not ours:
        index.admit(docs, id_col)
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    remove, lo, hits = _remove(words, id_col, text_col, to_arrow_schema(schema), index.mask), 0, []
    for k, hi in enumerate(ends):
        key, last = F.col(f"`{id_col}`"), hi == n
        inside = F.lit(True) if lo == 0 else key >= int(bounds[lo - 1])
        inside = inside if last else inside & (key < int(bounds[hi - 1]))
        inside = inside | key.isNull() if last else inside & key.isNotNull()
        hits.append(index.add(docs.where(inside), id_col, text_col, bounds))
        if k + 1 < len(ends) or not ours:
            index.compact()
        lo = hi
    if ours:
        index.drop()
    left = docs.withColumn("_mr_range", common.range_column(bounds, id_col)).groupBy("_mr_range")
    return left.cogroup(reduce(DataFrame.unionByName, hits).groupBy("_mr_range")).applyInArrow(remove, schema)
