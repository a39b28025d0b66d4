"""Statistics of whole documents, for quality rules and quality classifiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import common
from .substring_index import starts_ok, windows_of, word_hashes

SLICE_BYTES = 8 << 20
#: Words in a window of which the second is a repeat.
REPEAT_WINDOW = 5
#: The bytes that count as symbols.
SYMBOLS = b"#*$%&|<>"
_BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RATIOS = [
    "log_words", "mean_word_chars", "long_word_share", "symbol_rate", "upper_share", "digit_share", "stop_rate", "bang_rate", "bar_rate", "bracket_rate",
    "wide_share", "dup_line_share", "words_per_line", "repeat_share", "distinct_share", "top_word_share", "same_as_last_share", "url_rate",
]


def _class_table(*groups: bytes) -> list[np.ndarray]:
    out = []
    for g in groups:
        t = np.zeros(256, bool)
        t[list(g)] = True
        out.append(t)
    return out


_TABLES = _class_table(_BLANKS, SYMBOLS, bytes(range(65, 91)), bytes(range(48, 58)), b".?;:,", b"!", b"|", b"<>{}[]()=", bytes(range(0xC0, 0x100)), bytes(range(0x80, 0xC0)), b"/@")


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _in_row(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Keys that are equal where hash and row are."""
    return h * np.uint64(0x9E3779B97F4A7C15) + row.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)


def _distinct_and_top(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words of each row, and how often its most frequent one occurs."""
    if not len(h):
        return np.zeros(n), np.zeros(n)
    key = _in_row(h, row)
    order = np.argsort(key)
    first = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
    of = row[order][first]
    top = np.zeros(n, np.int64)
    np.maximum.at(top, of, np.diff(np.append(first, len(h))))
    return np.bincount(of, minlength=n), top


def _slice_stats(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    n = len(offsets) - 1
    blank, symbol, upper, digit, stop, bang, bar, bracket, lead, tail, url = (_sums(t[data], offsets) for t in _TABLES)
    chars = np.diff(offsets) - tail
    word_chars = chars - blank
    words, row, h = word_hashes(data, offsets)
    counts = np.array([len(r) for r in words], np.int64)
    at = np.flatnonzero(starts_ok(counts, REPEAT_WINDOW))
    key = _in_row(windows_of(h, REPEAT_WINDOW)[at], row[at])
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(row) + REPEAT_WINDOW + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + REPEAT_WINDOW, -1)
    repeat = np.bincount(row, np.cumsum(cover)[: len(row)] > 0, n).astype(np.int64)
    again = np.bincount(row[1:], (h[1:] == h[:-1]) & (row[1:] == row[:-1]), n) if len(row) else np.zeros(n)
    distinct, top = _distinct_and_top(h, row, n)
    long = np.array([sum(map((14).__lt__, map(len, r))) for r in words], np.int64)
    raw = data.tobytes()
    dup, lines = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        full = [x for x in raw[a:b].split(b"\n") if x.strip()]
        lines[i] = len(full)
        dup[i] = len(full) - len(set(full))
    nw, nc, nl = np.maximum(counts, 1), np.maximum(word_chars, 1), np.maximum(lines, 1)
    return {
        "n_words": counts, "word_chars": word_chars, "n_symbols": symbol, "n_dup_lines": dup, "n_repeat_words": repeat,
        "log_words": np.log1p(counts), "mean_word_chars": word_chars / nw, "long_word_share": long / nw, "symbol_rate": symbol / nw, "upper_share": upper / nc, "digit_share": digit / nc,
        "stop_rate": stop / nw, "bang_rate": bang / nw, "bar_rate": bar / nw, "bracket_rate": bracket / nw, "wide_share": lead / nc, "dup_line_share": dup / nl, "words_per_line": counts / nl,
        "repeat_share": repeat / nw, "distinct_share": distinct / nw, "top_word_share": top / nw, "same_as_last_share": again / nw, "url_rate": url / nw,
    }


def document_stats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", hash_col: str | None = None) -> DataFrame:
    """One row for each input row: the id, the text's ``xxhash64`` where ``hash_col`` names a column for it, the counts of ``COUNTS`` and the ratios of ``RATIOS``.

    Words are runs of anything but ASCII blanks; ``word_chars`` are their code points;
    ``n_dup_lines`` counts lines with a word that equal an earlier line; ``n_repeat_words`` counts
    words inside five-word windows found twice or more in the text, first ones included. A null or
    empty text has zero everywhere. Whole texts are read; repeated rows stay repeated.
    """
    hashed = [T.StructField(hash_col, T.LongType())] if hash_col else []
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *hashed, *(T.StructField(c, T.LongType()) for c in COUNTS), *(T.StructField(c, T.DoubleType()) for c in RATIOS)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release_caches()
        for batch in batches:
            data, offsets = common.text_buffers(batch.column(1))
            for lo, hi in common.slices(offsets, SLICE_BYTES):
                part = offsets[lo : hi + 1]
                x = _slice_stats(data[part[0] : part[-1]], part - part[0])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(c.slice(lo, hi - lo) for c in batch.columns[2:]), *(pa.array(x[c], arrow.field(c).type) for c in (*COUNTS, *RATIOS))], schema=arrow)

    return docs.select(f"`{id_col}`", f"`{text_col}`", *(F.xxhash64(F.col(f"`{text_col}`")).alias(f.name) for f in hashed)).mapInArrow(run, schema)
