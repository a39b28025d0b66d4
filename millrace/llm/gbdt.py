"""Histogram gradient-boosted trees, flattened into arrays for vectorised traversal."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .stats import RATIOS, document_stats


@dataclass
class Forest:
    """Complete binary trees of one depth: node i has children 2i+1 and 2i+2."""

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # trees x inner nodes; up to it goes left
    value: np.ndarray  # trees x leaves
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of every row of ``x`` (rows x features)."""
        depth = (self.value.shape[1] - 1).bit_length()
        inner = self.feature.shape[1]
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - inner]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -40, 40)))


def cut_points(values: np.ndarray, bins: int) -> np.ndarray:
    """Bounds near the quantiles, each halfway between two neighbouring distinct values."""
    u = np.unique(values)
    if len(u) < 2:
        return np.zeros(0)
    at = np.searchsorted(u, np.quantile(values, np.linspace(0, 1, bins + 1)), "right") - 1
    at = np.unique(np.clip(at, 0, len(u) - 2))
    return (u[at] + u[at + 1]) / 2


def fit_forest(x: np.ndarray, y: np.ndarray, *, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: float = 0.3) -> Forest:
    """Boost logistic loss by trees grown level by level over quantile-bin histograms."""
    n, d = x.shape
    edges = [cut_points(x[:, j], bins) for j in range(d)]
    code = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1) if n else np.zeros((0, d), np.int64)
    p = min(max(float(y.mean()) if n else 0.5, 1e-3), 1 - 1e-3)
    base = float(np.log(p / (1 - p)))
    inner, leaves = (1 << depth) - 1, 1 << depth
    forest = Forest(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)), base)
    margin = np.full(n, base)
    for t in range(trees if n else 0):
        prob = 1 / (1 + np.exp(-margin))
        g, h = prob - y, prob * (1 - prob)
        node = np.zeros(n, np.int64)  # inside the level
        for level in range(depth):
            width, first = 1 << level, (1 << level) - 1
            best, pick = np.full(width, 1e-9), {}
            for j in range(d):
                if not len(edges[j]):
                    continue
                size = len(edges[j]) + 1
                cell = node * size + code[:, j]
                hg = np.bincount(cell, g, width * size).reshape(width, size).cumsum(1)
                hh = np.bincount(cell, h, width * size).reshape(width, size).cumsum(1)
                tg, th = hg[:, -1:], hh[:, -1:]
                gain = hg**2 / (hh + l2) + (tg - hg) ** 2 / (th - hh + l2) - tg**2 / (th + l2)
                gain[(hh < least) | (th - hh < least)] = 0
                gain = gain[:, : len(edges[j])]
                at = gain.argmax(1)
                for k in np.flatnonzero(gain[np.arange(width), at] > best):
                    best[k], pick[int(k)] = gain[k, at[k]], (j, int(at[k]))
            right = np.zeros(n, bool)
            for k, (j, b) in pick.items():
                forest.feature[t, first + k], forest.threshold[t, first + k] = j, edges[j][b]
                mine = node == k
                right[mine] = code[mine, j] > b
            node = 2 * node + right
        sg, sh = np.bincount(node, g, leaves), np.bincount(node, h, leaves)
        forest.value[t] = -rate * sg / (sh + l2)
        margin += forest.value[t][node]
    return forest


def labelled_sample(stats: DataFrame, labels: DataFrame, *, id_col: str, label_col: str, most: int) -> DataFrame:
    """Up to ``most`` labelled rows with their statistics, those with the smallest id hashes.

    A cut on the hash leaves about a quarter more than ``most`` before the sort, so that no task sends a whole sample of its own.
    """
    marked = labels.select(F.col(f"`{id_col}`"), F.col(f"`{label_col}`").cast("int").alias("_mr_label")).where("_mr_label is not null")
    point = F.pmod(F.xxhash64(F.col(f"`{id_col}`")), F.lit(1 << 40))
    joined = stats.join(marked, id_col).withColumn("_mr_point", point)
    n = joined.count()
    near = joined if n <= most else joined.where(F.col("_mr_point") < int((1 << 40) * min(1.0, 1.25 * most / n)))
    return near.orderBy("_mr_point", F.col(f"`{id_col}`"), F.xxhash64(*[F.col(f"`{c}`") for c in stats.columns]), "_mr_label").limit(most).drop("_mr_point")


def is_held_out(id_col: str):
    """Rows that no label is learnt from: crc32 of the id as text leaves 2 when divided by 4 (null id: as an empty text)."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def classify_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.7, train_rows: int = 40_000, hash_col: str | None = None) -> DataFrame:
    """Score every document for quality by boosted trees over its statistics.

    Trees are fitted on at most ``train_rows`` labelled rows that ``is_held_out`` leaves in; every row
    is scored from whole-text statistics only. Returns the id, ``held_out``, ``score`` (0 to 1) and ``predicted``
    (1 from ``threshold`` on), one row for each input row; ``hash_col`` names a further column for ``xxhash64`` of the text,
    which tells rows with one id or none apart.

    Null or empty texts are scored like any other; null ids are scored but never learnt from; labels that
    are null or without a document are left out. Without any label all scores are 0.5.
    """
    stats = common.stored(document_stats(docs, id_col=id_col, text_col=text_col, hash_col=hash_col), "quality-stats")
    hashed = [hash_col] if hash_col else []
    train = labelled_sample(stats.where(~is_held_out(id_col)), labels, id_col=id_col, label_col=label_col, most=train_rows).select(*RATIOS, "_mr_label").toPandas()
    forest = fit_forest(train[RATIOS].to_numpy(np.float64), (train["_mr_label"].to_numpy() > 0).astype(np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(c).to_numpy() for c in RATIOS], 1) if batch.num_rows else np.zeros((0, len(RATIOS)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(batch.column(c) for c in hashed), pa.array(forest.score(x), pa.float64())], ["id", "held_out", *hashed, "score"])

    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("held_out", T.BooleanType()), *(T.StructField(c, T.LongType()) for c in hashed), T.StructField("score", T.DoubleType())])
    scored = stats.select(F.col(f"`{id_col}`").alias("id"), is_held_out(id_col).alias("held_out"), *hashed, *RATIOS).mapInArrow(run, schema)
    return scored.select(F.col("id").alias(id_col), "held_out", *hashed, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
