"""Shared pieces: the scratch folder, column hygiene and packed key arrays."""

from __future__ import annotations

import tempfile
import uuid
from contextvars import ContextVar

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null document id inside the workers: it sorts after every real id.
NULL_ID = np.iinfo(np.int64).max
#: Ranges of ids at most (2 MB of bounds): their bounds go to every task. Beyond 3 TB of text, at 12 MB a range, ranges grow with the table.
MOST_RANGES = 1 << 18


# --------------------------------------------------------------------------- scratch

_scopes: ContextVar[tuple[Scope, ...]] = ContextVar("scopes", default=())


class Scope:
    """The scratch paths made while it is open; they stay until ``drop``, for whoever still reads them."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    def __enter__(self) -> Scope:
        self._token = _scopes.set((*_scopes.get(), self))
        return self

    def __exit__(self, *_: object) -> None:
        _scopes.reset(self._token)

    def drop(self, spark: SparkSession, *, but: tuple[DataFrame, ...] = ()) -> None:
        """Delete the paths, but for those that the tables ``but`` were stored in."""
        kept = {getattr(df, "_mr_path", None) for df in but}
        for path in [p for p in self.paths if p not in kept]:
            drop_path(spark, path)
            self.paths.remove(path)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Where that is unset, a local session takes a temporary one; a cluster has none that all see."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, known to the scopes that are open."""
    path = f"{scratch_root(spark)}/millrace/{name}-{uuid.uuid4().hex}"
    for scope in _scopes.get():
        scope.paths.append(path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through Hadoop's file system, wherever it lies."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._mr_path = path
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


# --------------------------------------------------------------------------- worker caches

_caches: list = []


def release_caches() -> None:
    """Empty what earlier tasks left in this Python worker, which Spark uses again for other work."""
    for cache in _caches:
        cache.clear()


# --------------------------------------------------------------------------- columns


def pick(df: DataFrame, id_col: str, text_col: str, reserved: list[str]) -> DataFrame:
    """Id and text first, then the other columns; those in ``reserved`` give way to an operator's own."""
    rest = [c for c in df.columns if c not in (id_col, text_col) and c not in reserved and not c.startswith("_mr_")]
    return df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), *[F.col(f"`{c}`") for c in rest])


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, end to end, and the offsets of its rows (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def id_array(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Ids as int64, null as NULL_ID."""
    return column.cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.cast(pa.int64()).fill_null(NULL_ID).to_numpy()


def slices(offsets: np.ndarray, most: int):
    """Row ranges of about ``most`` bytes; a single longer row is a range of its own."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


# --------------------------------------------------------------------------- packed keys


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending unsigned 64-bit keys as gaps, byte plane by byte plane: zero planes compress away."""
    gaps = np.diff(keys, prepend=keys.dtype.type(0))
    return np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack_keys(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(packed, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def contains(sorted_keys: np.ndarray, probe: np.ndarray) -> np.ndarray:
    """Which of ``probe`` lie in ``sorted_keys``."""
    if len(sorted_keys) == 0:
        return np.zeros(len(probe), bool)
    at = np.searchsorted(sorted_keys, probe)
    at[at == len(sorted_keys)] = 0
    return sorted_keys[at] == probe


# --------------------------------------------------------------------------- document ranges


def id_ranges(df: DataFrame, id_col: str, text_col: str, group_bytes: int) -> tuple[np.ndarray, int]:
    """Ascending id bounds that cut the table into ranges of about ``group_bytes`` of text, at most ``MOST_RANGES`` of them; and the bytes of all text.

    Range g holds the ids in [bounds[g-1], bounds[g]); only bounds and their bytes reach the driver. Ids are first cut
    finely by rows; those pieces are put together by their bytes, so that long texts side by side make no large range.
    """
    size = F.octet_length(F.col(text_col).cast("string"))
    row = df.agg(F.sum(size).alias("b"), F.count(id_col).alias("n")).first()
    total = int(row["b"] or 0)
    n = min(MOST_RANGES, max(1, -(-total // group_bytes)))
    if n == 1 or not row["n"]:
        return np.zeros(0, np.int64), total
    fine = min(8 * n, MOST_RANGES)
    cuts = df.agg(F.percentile_approx(id_col, [i / fine for i in range(1, fine)], max(10_000, 20 * fine)).alias("c")).first()["c"]
    cuts = np.unique(np.array(cuts, np.int64))
    weights = dict(df.where(F.col(f"`{id_col}`").isNotNull()).select(range_column(cuts, id_col).alias("r"), size.alias("s")).groupBy("r").agg(F.sum("s")).collect())
    each, bounds, held = max(group_bytes, total // n), [], 0
    for i, cut in enumerate(cuts.tolist()):
        held += weights.get(i) or 0
        if held + (weights.get(i + 1) or 0) > each and held:
            bounds.append(cut)
            held = 0
    return np.array(bounds, np.int64), total


def range_column(bounds: np.ndarray, id_col: str):
    """The range number of a row as a column; only the id goes through Python."""

    @F.pandas_udf("long")
    def of(ids: pd.Series) -> pd.Series:
        return pd.Series(range_of(bounds, pa.array(ids, pa.int64(), from_pandas=True).fill_null(NULL_ID).to_numpy()))

    return of(F.col(f"`{id_col}`"))


def range_of(bounds: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return np.where(ids == NULL_ID, len(bounds), np.searchsorted(bounds, ids, "right")).astype(np.int64)
