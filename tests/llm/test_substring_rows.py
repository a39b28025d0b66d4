"""Rows between substring dedup's passes follow the text, not ranges times slices."""

import random

import numpy as np
import pyarrow as pa

from millrace.llm import substring_index


def documents(n):
    rng = random.Random(5)
    passages = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(50)) for _ in range(18)) for _ in range(12)]
    return [(i, " ".join([f"w{rng.randrange(10**6)}" for _ in range(20)] + [rng.choice(passages)])) for i in range(n)]


def test_a_slice_of_many_ranges_emits_a_row_for_each_bucket():
    rows = documents(400)
    random.Random(6).shuffle(rows)
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows])], ["doc_id", "text"])
    made = list(substring_index._emit(13, 4, np.arange(10, 400, 10), None)([batch]))
    assert 0 < sum(b.num_rows for b in made) <= 16


def test_documents_in_any_order_and_many_ranges(spark):
    rows = documents(300)
    mixed = rows[:]
    random.Random(7).shuffle(mixed)
    found = []
    for given, size in ((rows, 8 << 20), (mixed, 3000)):
        df = spark.createDataFrame(given, "doc_id long, text string").repartition(2)
        found.append(sorted(map(tuple, substring_index.remove_repeated_windows(df, group_bytes=size).select("doc_id", "n_words", "n_removed", "kept_text").collect())))
    assert found[0] == found[1] and sum(r[2] for r in found[0]) > 0
