import hashlib
import random
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from millrace.llm import minhash, substring_index, suffix_dedup
from millrace.llm.components import connected_components


@pytest.mark.parametrize("group,shard", [(12 << 20, 2 << 20), (3000, 500)])
def test_repeated_bytes(docs, rows, group, shard):
    got = suffix_dedup.remove_repeated_bytes(docs, group_bytes=group, shard_bytes=shard, sort_memory=1000).collect()
    want = Counter((i, *x) for (i, _), x in zip(rows, brute.repeated_bytes(rows)))
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept_bytes)) for r in got) == want
    assert got[0].n_words == "clash"


def test_repeated_bytes_inside_one_text_and_periods(spark):
    rows = [(1, "x" * 401), (2, "x" * 399), (3, "ab" * 350), (4, "q" * 400)]
    got = suffix_dedup.remove_repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = {i: x for (i, _), x in zip(rows, brute.repeated_bytes(rows))}
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept_bytes)) for r in got} == want
    assert want[1][1] == 401 and want[4][1] == 0


def test_texts_with_more_places_than_a_hash_can_tell(spark, monkeypatch):
    rng = random.Random(12)
    text = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    again = text(1500)
    rows = [(1, text(3000) + again + text(2000) + again[200:900]), (2, again[100:1400])]
    whole = [x[1:] for x in (np.concatenate([[0], a]) for a in suffix_dedup.anchors(np.frombuffer(rows[0][1].encode(), np.uint8), np.array([0, len(rows[0][1])]), 400)[1:])]
    monkeypatch.setattr(suffix_dedup, "MOST_PLACES", 1000)
    h, anchor, first, last = suffix_dedup.anchors(np.frombuffer(rows[0][1].encode(), np.uint8), np.array([0, len(rows[0][1])]), 400)
    of = lambda a, f, l: {w: x for x, lo, hi in zip(a.tolist(), f.tolist(), l.tolist()) for w in range(lo, hi + 1)}
    assert of(anchor, first, last) == of(*whole)


@pytest.mark.parametrize("group,heavy", [(12 << 20, 2), (3000, 2), (3000, 5)])
def test_repeated_bytes_with_heavy_anchors(docs, rows, group, heavy):
    got = suffix_dedup.remove_repeated_bytes(docs, group_bytes=group, heavy=heavy).collect()
    want = Counter((i, *x) for (i, _), x in zip(rows, brute.repeated_bytes(rows)))
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept_bytes)) for r in got) == want


def test_a_common_passage_stays_out_of_the_sorter(spark):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    passage = text(900)
    rows = [(i, text(250) + passage + text(250)) for i in range(300)] + [(300 + i, t + text(50)) for i, t in enumerate([text(700)] * 2)]
    docs, bounds, filed = pa.table({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows]}), np.array([100, 200]), []
    keys = pa.Table.from_batches(suffix_dedup._file_keys(400, 5, bounds)(docs.to_batches()))
    shared = pa.concat_tables([suffix_dedup._shared_keys(50)(keys.filter(pc.equal(keys["_mr_bucket"], b))) for b in set(keys["_mr_bucket"].to_pylist())])
    for g in range(3):
        part = docs.filter(pa.array([i // 100 == g or g == 2 and i >= 200 for i, _ in rows]))
        filed += suffix_dedup._file_contexts(400, 8, "doc_id", "text")(part, shared.filter(pc.equal(shared["_mr_range"], g))).to_pylist()
    sizes = Counter()
    for r in filed:
        if r["anchors"]:
            for h, n in zip(np.frombuffer(r["anchors"], "<u8").tolist(), np.frombuffer(r["sizes"], "<u4").tolist()):
                sizes[h] += n
    assert sizes and max(sizes.values()) < 50 * 769
    got = suffix_dedup.remove_repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string"), group_bytes=100_000, heavy=50).collect()
    want = {i: x for (i, _), x in zip(rows, brute.repeated_bytes(rows))}
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept_bytes)) for r in got} == want


@pytest.mark.parametrize("group,batches", [(12 << 20, 1), (2500, 4), (800, 7)])
def test_repeated_words(docs, rows, group, batches):
    got = substring_index.remove_repeated_windows(docs, group_bytes=group, batches=batches).collect()
    want = Counter((i, *x) for (i, _), x in zip(rows, brute.repeated_words(rows)))
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == want


def test_index_compacts_to_one_run(spark):
    rows = [(i, " ".join(f"w{i * 7 + j}" for j in range(40))) for i in range(12)]
    index = substring_index.FingerprintIndex(spark, 13, buckets=16, most_runs=2)
    for lo in range(0, 12, 3):
        batch = spark.createDataFrame(rows[lo : lo + 3], "doc_id long, text string")
        index.admit(batch, "doc_id")
        index.add(batch, "doc_id", "text", np.zeros(0, np.int64)).count()
    held = lambda: [int(k) for r in index.history().collect() for k in substring_index.read_run(index.store, r._mr_file)[0]]
    before = set(held())
    assert len(index.runs) > 2
    index.compact()
    after = held()
    assert len(index.runs) == 1 and set(after) == before and len(after) == len(before)


@pytest.mark.parametrize("group,batches", [(12 << 20, 1), (2500, 4)])
def test_colliding_fingerprints_are_told_apart(spark, docs, rows, group, batches):
    index = substring_index.FingerprintIndex(spark, 13, buckets=16, mask=0xFF)
    got = substring_index.remove_repeated_windows(docs, group_bytes=group, batches=batches, index=index).collect()
    want = Counter((i, *x) for (i, _), x in zip(rows, brute.repeated_words(rows)))
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == want


@pytest.mark.parametrize("mask", [None, 0xFF])
def test_an_index_goes_on_in_another_session(spark, rows, tmp_path, mask):
    folder, schema = f"file://{tmp_path}/index", "doc_id long, text string"
    numbered = sorted(((i, t) for i, t in rows if i is not None), key=lambda r: r[0])
    parts = [numbered[:15], numbered[15:30], numbered[30:]]
    parts[2] = [r for r in parts[2] if r[0] > parts[1][-1][0]]
    seen, got = [], Counter()
    for part in parts:
        index = substring_index.FingerprintIndex(spark, 13, buckets=16, most_runs=2, folder=folder, mask=mask)  # nothing but the folder tells it what was
        out = substring_index.remove_repeated_windows(spark.createDataFrame(part, schema), group_bytes=2000, batches=2, index=index)
        got += Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in out.collect())
        index.save()
        seen += part
    assert got == Counter((i, *x) for (i, _), x in zip(seen, brute.repeated_words(seen)))
    with pytest.raises(ValueError, match="above"):
        substring_index.remove_repeated_windows(spark.createDataFrame([(0, "x")], schema), index=substring_index.FingerprintIndex(spark, 13, folder=folder))


def test_near_duplicates(docs, rows):
    got = minhash.near_duplicate_groups(docs).collect()
    want = brute.near_duplicates([(i, t) for i, t in rows if i is not None])
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id)
    assert len(got) == len(rows)


@pytest.mark.parametrize("large", [500, 20])
def test_a_large_family_of_near_copies(spark, monkeypatch, large):
    monkeypatch.setattr(minhash, "LARGE_FAMILY", large)  # 20: the family is dealt into parts
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for j in range(i % 7):  # from linked to the base, through linked to few, to loose
            w[(i * 13 + j * 29) % 120] = f"x{i}_{j}"
        rows.append((i + 1, " ".join(w)))
    for i in range(6):  # a loose variant with copies of its own
        w = [f"y{j}" if j % 9 == 0 else x for j, x in enumerate(base)]
        w[i * 20] = f"z{i}"
        rows.append((500 + i, " ".join(w)))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: c for i, (_, c) in brute.near_duplicates(rows).items()}


def test_pruning_bounds():
    least = minhash.least_matches(128, 0.75, 1e-7)
    assert least[0] == 0 and (np.diff(least[16:]) >= 0).all() and least[128] < 96
    rng = np.random.default_rng(1)  # pairs at the threshold are all but never given up
    assert (rng.binomial(128, 0.75, 100_000) >= least[128]).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 103), (103, 101), (200, 200), (7, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100, 103: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty_tables(nothing):
    assert suffix_dedup.remove_repeated_bytes(nothing).count() == 0
    assert substring_index.remove_repeated_windows(nothing).count() == 0
    assert minhash.near_duplicate_groups(nothing).count() == 0


def test_query_digest(spark):
    from millrace.llm import queries

    got = queries.op1_suffix_array_dedup(spark, "/root/testdata/sf0.001").collect()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    want = {i: (n, m, s, hashlib.sha256(k).hexdigest()) for (i, _), (n, m, s, k) in zip(rows, brute.repeated_bytes(rows))}
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
