"""Phrase collocations: counts of all shorter phrases as marginals of the longest windows.

Every word opens one window of ``longest`` words of its piece, padded with nulls behind the piece's last word: lead columns, made by
shifting the words against themselves. Only those windows are counted; ROLLUP then sums them by ever shorter prefixes. A phrase's
windows are the windows that it begins, so that its sum is the number of its occurrences, and phrases of each length needn't be made apart.

Most windows go on beyond what can be a candidate. A first pass counts phrases of two words and more by hash, and those met ``min_count`` times
set bits of a filter of fixed size; in the second a window is padded from the first word on with which it is no phrase of the filter. Such a
phrase is rarer still, so that no count of a frequent one changes; what the filter has wrongly is only kept in vain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pack_keys, slices, stored, text_buffers, unpack_keys

#: Bytes of text whose windows are counted at once in a worker (a longer text is one such part), and rows that are unpacked at once.
PART_BYTES, PART_ROWS = 2 << 20, 1000
#: What ends a piece.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
_CUT = 0xFF  # no byte of UTF-8
_LOWER = bytes.maketrans(bytes(range(65, 91)) + PIECE_ENDS, bytes(range(97, 123)) + bytes([_CUT]) * len(PIECE_ENDS))
_IS_WORD = np.array([b not in (0x20, 0x09, _CUT) for b in range(256)])
#: Bits of the filter of frequent phrases (32 MB, which every worker gets), bits that a phrase sets, and bits of its hash.
FILTER_BITS, SET_BITS, HASH_BITS = 28, 3, 44
#: Least and most blocks that hashes are counted in, as powers of two; eight for a partition of the input.
FEWEST, MOST = 8, 16
#: Odd multipliers, from 2**64 over the golden ratio on.
_ODD = [np.uint64(0x9E3779B97F4A7C15 + 2 * i * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF | 1) for i in range(SET_BITS + 1)]
#: Parts that each language's phrases are dealt to before the best of all are taken.
DEALT = 64


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words of UTF-8 texts laid end to end, each with the number of its text and one of its piece."""
    text = np.frombuffer(data.tobytes().translate(_LOWER), np.uint8)
    word = _IS_WORD[text]
    first = word.copy()
    first[1:] &= ~word[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    first[heads] = word[heads]
    starts = np.flatnonzero(first)
    upto = np.cumsum(word)
    ends = np.append(upto[starts] - 1, upto[-1] if len(upto) else 0).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(text[word])])
    of = np.searchsorted(offsets, starts, "right") - 1
    return words, of, np.cumsum(text == _CUT)[starts] + of


def phrase_hashes(coded: pa.DictionaryArray, langs: np.ndarray, lang_names: pa.Array, pieces: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For 2 words to ``longest``: a hash of ``HASH_BITS`` bits of the phrase that begins at each word, in its language, and whether its piece has it whole."""
    hashed = lambda values: pd.util.hash_array(values.to_numpy(zero_copy_only=False).astype(object), categorize=False)
    word = hashed(coded.dictionary)[coded.indices.to_numpy()]
    phrase = word ^ hashed(lang_names)[langs]
    for k in range(1, longest):
        phrase, whole = phrase.copy(), np.zeros(len(word), bool)
        if len(word) > k:
            mixed = phrase[:-k] * _ODD[0] + word[k:]
            phrase[:-k] = (mixed ^ (mixed >> np.uint64(29))) * _ODD[0]
            whole[:-k] = pieces[:-k] == pieces[k:]
        yield phrase >> np.uint64(64 - HASH_BITS), whole


def _bits_of(hashes: np.ndarray, block_bits: int) -> list[np.ndarray]:
    """The bits that hashes set: all in the part of the filter that belongs to their block, the upper bits of the hash."""
    size = FILTER_BITS - block_bits
    block = (hashes >> np.uint64(HASH_BITS - block_bits)) << np.uint64(size)
    return [(block | ((hashes + np.uint64(1)) * odd >> np.uint64(64 - size))).astype(np.int64) for odd in _ODD[1:]]


def is_frequent(bits: np.ndarray, hashes: np.ndarray, block_bits: int) -> np.ndarray:
    found = np.ones(len(hashes), bool)
    for at in _bits_of(hashes, block_bits):
        found &= (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0
    return found


def count_windows(coded: pa.DictionaryArray, langs: np.ndarray, goes_on: list[np.ndarray]) -> tuple[np.ndarray, list[pa.Array], np.ndarray]:
    """Distinct padded windows: their language numbers, a column of words for each place (null from the first word on that a window doesn't go on to), and their counts."""
    ids, size = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary) + 1
    leads = [ids + 1]
    for k, on in enumerate(goes_on, 1):
        lead = np.zeros(len(ids), np.int64)
        if len(ids) > k:
            lead[:-k] = np.where(on[:-k] & (leads[-1][:-k] > 0), leads[0][k:], 0)
        leads.append(lead)
    key, span = langs.astype(np.int64), int(langs.max(initial=0)) + 1
    for lead in leads:
        if span * size >= 1 << 62:
            kinds, key = np.unique(key, return_inverse=True)
            span = len(kinds)
        key, span = key * size + lead, span * size
    _, at, counts = np.unique(key, return_index=True, return_counts=True)
    columns = [coded.dictionary.take(pa.array(lead[at] - 1, pa.int64(), mask=lead[at] == 0)).cast(pa.string()) for lead in leads]
    return langs[at], columns, counts


def _parts(batches: Iterator[pa.RecordBatch]):
    """Parts of texts: coded words, their language numbers and piece numbers, and the languages."""
    for whole in batches:
        for at in range(0, len(whole), PART_ROWS):
            batch = whole.slice(at, PART_ROWS)
            data, offsets = text_buffers(batch.column(0))
            kinds = batch.column(1).dictionary_encode()
            codes = kinds.indices.to_numpy()
            for lo, hi in slices(offsets, PART_BYTES):
                words, of, pieces = words_of(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                if len(words):
                    yield words.dictionary_encode(), codes[lo:hi][of], pieces, kinds.dictionary
            pa.default_memory_pool().release_unused()


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.col(f"`{text_col}`").cast("string").alias("t"), F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("l"))


def _summed(keys: list[np.ndarray], sums: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys_, sums_ = np.concatenate(keys), np.concatenate(sums)
    order = np.argsort(keys_, kind="stable")
    keys_, sums_ = keys_[order], sums_[order]
    first = np.flatnonzero(np.append(True, keys_[1:] != keys_[:-1])) if len(keys_) else np.zeros(0, np.int64)
    return keys_[first], np.add.reduceat(sums_, first) if len(first) else sums_


def frequent_phrases(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", longest: int = 3, min_count: int = 10) -> tuple[np.ndarray, int]:
    """A filter that has every phrase of 2 to ``longest`` words met ``min_count`` times or more, 32 MB whatever the corpus, and its block bits.

    Parts send sorted hashes with counts, block by block; a task adds up one block at a time while rows stream by.
    """
    texts = _texts(docs, text_col, lang_col)
    block_bits = min(MOST, max(FEWEST, (8 * texts.rdd.getNumPartitions() - 1).bit_length()))
    inside = np.uint64((1 << (HASH_BITS - block_bits)) - 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for coded, langs, pieces, names in _parts(batches):
            hashes, counts = np.unique(np.concatenate([h[w] for h, w in phrase_hashes(coded, langs, names, pieces, longest)]), return_counts=True)
            counts = counts.astype(np.uint32)
            blocks, first = np.unique(hashes >> np.uint64(HASH_BITS - block_bits), return_index=True)
            ends = [*first[1:], len(hashes)][: len(first)]
            cells = [pack_keys(hashes[a:b] & inside) for a, b in zip(first, ends, strict=True)]
            sums = [np.ascontiguousarray(counts[a:b].view(np.uint8).reshape(-1, 4).T).tobytes() for a, b in zip(first, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(blocks.astype(np.int64)), pa.array(cells, pa.binary()), pa.array(sums, pa.binary())], names=["block", "cells", "sums"])

    def whole(block: int, keys: list[np.ndarray], sums: list[np.ndarray]) -> pa.RecordBatch:
        cells, counts = _summed(keys, sums)
        at = np.concatenate(_bits_of(cells[counts >= min_count] | np.uint64(block << (HASH_BITS - block_bits)), block_bits))
        bits = np.zeros(1 << (FILTER_BITS - block_bits), bool)
        bits[at & ((1 << (FILTER_BITS - block_bits)) - 1)] = True
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["block", "bits"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, sums, held = None, [], [], 0
        for batch in batches:
            for block, cells, counts in zip(*batch.columns, strict=True):
                if block.as_py() != now:
                    if keys:
                        yield whole(now, keys, sums)
                    now, keys, sums, held = block.as_py(), [], [], 0
                keys.append(unpack_keys(cells.as_py()))
                sums.append(np.ascontiguousarray(np.frombuffer(counts.as_py(), np.uint8).reshape(4, -1).T).view(np.uint32).ravel().astype(np.int64))
                if sum(map(len, keys[1:])) > max(held, 1 << 20):
                    one, total = _summed(keys, sums)
                    keys, sums, held = [one], [total], len(one)
        if keys:
            yield whole(now, keys, sums)

    sent = texts.mapInArrow(count, "block long, cells binary, sums binary")
    bits, step = np.zeros(1 << (FILTER_BITS - 3), np.uint8), 1 << (FILTER_BITS - 3 - block_bits)
    for row in sent.repartition("block").sortWithinPartitions("block").mapInArrow(add, "block long, bits binary").toLocalIterator():
        bits[row.block * step : (row.block + 1) * step] = np.frombuffer(row.bits, np.uint8)
    return bits, block_bits


def longest_windows(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", longest: int = 3, frequent: tuple[np.ndarray, int] | None = None) -> DataFrame:
    """Padded windows with counts: lang, w1 to w<longest>, c. A window comes once for each part of some megabytes that holds it.

    Given the filter of ``frequent_phrases``, a window is padded from the word on that makes it a rare phrase.
    """
    names = [f"w{i + 1}" for i in range(longest)]
    schema = T.StructType([T.StructField("lang", T.StringType()), *[T.StructField(n, T.StringType()) for n in names], T.StructField("c", T.LongType())])
    sent = docs.sparkSession.sparkContext.broadcast(frequent) if frequent is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for coded, codes, pieces, kinds in _parts(batches):
            goes_on = [whole if sent is None else whole & is_frequent(sent.value[0], hashes, sent.value[1]) for hashes, whole in phrase_hashes(coded, codes, kinds, pieces, longest)]
            langs, columns, counts = count_windows(coded, codes, goes_on)
            yield pa.RecordBatch.from_arrays([kinds.take(pa.array(langs)), *columns, pa.array(counts, pa.int64())], names=["lang", *names, "c"])

    return _texts(docs, text_col, lang_col).mapInArrow(run, schema)


def phrase_counts(windows: DataFrame, *, longest: int = 3, min_count: int = 10) -> DataFrame:
    """lang, phrase (its words with spaces between), n_words and f: every phrase of 1 to ``longest`` words with at least ``min_count`` occurrences, and n_words 0 for all words of a language."""
    names = [f"w{i + 1}" for i in range(longest)]
    rolled = windows.sparkSession.sql(f"SELECT lang, {', '.join(names)}, grouping_id() AS g, sum(c) AS f FROM {{windows}} GROUP BY lang, ROLLUP ({', '.join(names)})", windows=windows)
    # the number of prefix words that a row is grouped by
    held = sum(F.when(F.col("g").bitwiseAND(1 << (longest - 1 - i)) == 0, 1).otherwise(0) for i in range(longest))
    full = sum(F.when(F.col(n).isNotNull(), 1).otherwise(0) for n in names)
    counted = rolled.withColumn("n_words", held).where((full == F.col("n_words")) & ((F.col("n_words") == 0) | (F.col("f") >= min_count)))
    return counted.select("lang", F.concat_ws(" ", *names).alias("phrase"), "n_words", "f")


def mine_collocations(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", longest: int = 3, min_count: int = 10, cover_percent: int = 50, top: int = 2000) -> DataFrame:
    """The ``top`` phrases of each language by cohesion: lang, rank, phrase, a, l, r, n, score.

    A-Z become small; ``.,;:!?`` and line ends cut texts into pieces, spaces and tabs those into words. Candidates are phrases of 2
    to ``longest`` words with a >= ``min_count`` occurrences. Cutting one into two parts of l and r occurrences scores
    floor(1000000 a a / (l r)); the lowest cut counts, ties to the shorter first part. Candidates inside a longer one
    with at least ``cover_percent`` of their occurrences go. Ranks go by score and a, greatest first, then phrase.

    A null text is empty, a null language ``und``; texts without words and empty tables give no rows; repeated rows count each
    time; other columns, whatever their names, aren't read. Counts up to 10**15 are exact.
    """
    frequent = frequent_phrases(docs, text_col=text_col, lang_col=lang_col, longest=longest, min_count=min_count)
    windows = longest_windows(docs, text_col=text_col, lang_col=lang_col, longest=longest, frequent=frequent)
    f = stored(phrase_counts(windows, longest=longest, min_count=min_count), "phrases")
    candidates = f.where("n_words >= 2")
    words, phrase = F.split("phrase", " "), lambda from_, n: F.array_join(F.slice("w", from_, n), " ")
    wide = lambda c, digits: F.col(c).cast(f"decimal({digits},0)")
    cuts = candidates.withColumn("w", words).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)))
    cuts = cuts.select("lang", "phrase", F.col("f").alias("a"), "k", phrase(F.lit(1), F.col("k")).alias("left"), phrase(F.col("k") + 1, F.col("n_words") - F.col("k")).alias("right"))
    of = lambda part, name: f.where(f"n_words between 1 and {longest - 1}").select("lang", F.col("phrase").alias(part), F.col("f").alias(name))
    met = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    met = met.withColumn("_a", wide("a", 15)).withColumn("_l", wide("l", 15)).withColumn("_r", wide("r", 15))
    met = met.withColumn("score", F.expr("(cast(1000000 as decimal(7,0)) * (_a * _a)) div (_l * _r)"))
    best = met.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b")).select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    inner = candidates.where("n_words >= 3").withColumn("w", words).withColumn("n", F.explode(F.sequence(F.lit(2), F.col("n_words") - 1)))
    inner = inner.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n_words") - F.col("n") + 1))).select("lang", phrase(F.col("i"), F.col("n")).alias("phrase"), "f")
    covers = inner.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    left = best.join(covers, ["lang", "phrase"], "left").where(f"longer is null or 100 * longer < {cover_percent} * a")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the best of each part first, so that no task ranks all phrases of a language
    dealt = left.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(DEALT))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(f"rank <= {top}")
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(f"rank <= {top}")
    totals = f.where("n_words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


COLLOCATION_SQL = r"""
WITH p AS (SELECT row_number() OVER () AS piece_no, * FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
w AS (SELECT lang, piece_no, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM (SELECT lang, piece_no, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p)),
t AS (SELECT lang, x, lead(x, 1) OVER o AS y, lead(x, 2) OVER o AS z FROM w WINDOW o AS (PARTITION BY piece_no ORDER BY i)),
g AS (SELECT lang, 1 AS len, x AS phrase FROM t UNION ALL SELECT lang, 2, x || ' ' || y FROM t WHERE y IS NOT NULL UNION ALL SELECT lang, 3, x || ' ' || y || ' ' || z FROM t WHERE z IS NOT NULL),
f AS (SELECT lang, len, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE len = 1 GROUP BY lang),
c AS (SELECT lang, len, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE len >= 2 AND f >= 10),
s AS (SELECT c.lang, c.len, c.phrase, c.a, k, x.f AS l, y.f AS r, (1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f) AS score
      FROM c CROSS JOIN range(1, 3) t(k) JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(ws[1:k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(ws[k + 1:], ' ') WHERE k < c.len),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
v AS (SELECT lang, array_to_string(ws[i:i + 1], ' ') AS phrase, max(a) AS longer FROM c, range(1, 3) t(i) WHERE len = 3 GROUP BY ALL),
k AS (SELECT b.* FROM b LEFT JOIN v USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM k JOIN n USING (lang) QUALIFY rank <= 2000
"""
