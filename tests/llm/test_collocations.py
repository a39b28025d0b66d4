"""Phrase collocations against plain counting."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.llm.collocations import longest_windows, mine_collocations, phrase_counts


def brute(rows, longest=3, least=10, cover=50, top=2000):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            ws = [w for w in re.split("[ \t]+", piece) if w]
            totals[lang] += len(ws)
            for n in range(1, longest + 1):
                counts.update((lang, tuple(ws[i : i + n])) for i in range(len(ws) - n + 1))
    found = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in found.items():
        longer = [b for (other, q), b in found.items() if other == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if any(100 * b >= cover * a for b in longer):
            continue
        score, _, left, right = min((10**6 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k, counts[lang, p[:k]], counts[lang, p[k:]]) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, left, right, totals[lang], score))
    ranked = []
    for lang in totals:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(r[0], i + 1, *r[1:]) for i, r in enumerate(own[:top])]
    return sorted(ranked)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def some_texts(seed, n=60):
    rng = random.Random(seed)
    words = ["The", "cat", "sat", "É", "é", "on", "mat", "\x00", "a b", "x" * 30, " ", "Ünder"]
    ends = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!", "\r\n", "\x0b"]
    texts = ["".join(rng.choice(words[: 3 + i % 9]) + rng.choice(ends) for _ in range(rng.randrange(60))) for i in range(n)]
    rows = [(t, rng.choice(["en", "de", None, ""])) for t in texts]
    return rows + [(None, "en"), ("", None), (" \t\n", "en"), (".", "fr"), rows[0], rows[0]]


@pytest.mark.parametrize("longest,cover,top", [(3, 50, 2000), (4, 80, 7), (2, 50, 3)])
def test_equals_plain_counting(spark, longest, cover, top):
    rows = some_texts(longest)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    got = mine_collocations(docs, longest=longest, min_count=3, cover_percent=cover, top=top)
    assert rows_of(got) == brute(rows, longest, 3, cover, top)
    assert [t for _, t in got.dtypes] == ["string", "bigint", "string", "bigint", "bigint", "bigint", "bigint", "bigint"]


def test_counts_past_64_bits(spark):
    windows = spark.createDataFrame([("en", "a", "b", None, 5 * 10**13), ("en", "b", None, None, 5 * 10**13)], "lang string, w1 string, w2 string, w3 string, c long")
    counts = {r.phrase: r.f for r in phrase_counts(windows).collect()}
    assert counts == {"a b": 5 * 10**13, "a": 5 * 10**13, "b": 5 * 10**13, "": 10**14}
    wide = windows.selectExpr("cast(c as decimal(15,0)) as _a").selectExpr("(cast(1000000 as decimal(7,0)) * (_a * _a)) div (_a * _a) as s").first().s
    assert wide == 10**6


def test_windows_are_padded_and_whole(spark):
    docs = spark.createDataFrame([("a b c. d e", "x", 1), ("f", "x", 2)], "text string, lang string, w1 int")
    got = sorted((tuple(r) for r in longest_windows(docs).collect()), key=str)
    assert got == sorted([("x", "a", "b", "c", 1), ("x", "b", "c", None, 1), ("x", "c", None, None, 1), ("x", "d", "e", None, 1), ("x", "e", None, None, 1), ("x", "f", None, None, 1)], key=str)


def test_empty_tables_and_clashing_names(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert mine_collocations(empty).count() == 0
    rows = [("u v " * 12, "en")] * 2
    docs = spark.createDataFrame(rows, "text string, lang string")
    for name in ("phrase", "rank", "w1", "c", "f", "n", "score", "_part"):
        docs = docs.withColumn(name, F.lit("x"))
    assert rows_of(mine_collocations(docs)) == brute(rows)


def test_a_very_long_text_without_ends(spark):
    rows = [("aa bb cc " * 40_000, None), ("z" * 300_000, None)]
    assert rows_of(mine_collocations(spark.createDataFrame(rows, "text string, lang string"))) == brute(rows)


def test_the_filter_has_every_frequent_phrase(spark, monkeypatch):
    """Phrases that the filter has wrongly are kept in vain, none is lost."""
    import numpy as np

    import millrace.llm.collocations as m

    monkeypatch.setattr(m, "PART_BYTES", 700)
    rows = some_texts(11, 80)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    bits, block_bits = m.frequent_phrases(docs, min_count=3)
    assert 0 < np.unpackbits(bits).sum() < 6000 and len(bits) == 1 << (m.FILTER_BITS - 3)
    every = sorted(map(tuple, phrase_counts(longest_windows(docs), min_count=3).collect()))
    for pairs in ((bits, block_bits), (np.full_like(bits, 255), block_bits)):
        assert sorted(map(tuple, phrase_counts(longest_windows(docs, frequent=pairs), min_count=3).collect())) == every
    fewer = longest_windows(docs, frequent=(bits, block_bits)).where("w2 is not null").count()
    assert 0 < fewer < longest_windows(docs).where("w2 is not null").count()
