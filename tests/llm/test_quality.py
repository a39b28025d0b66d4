from collections import Counter

import brute
import numpy as np
import pytest

from millrace.llm import gbdt, rules, stats


@pytest.fixture(scope="module")
def labels(spark, docs):
    rows = [(i * 3, None if i % 7 == 0 else int(i % 3 > 0), 0) for i in range(50)] + [(9999, 1, 0), (None, 0, 0), (3, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_counts(docs, rows):
    got = Counter((r.doc_id, *(r[c] for c in stats.COUNTS)) for r in stats.document_stats(docs).collect())
    assert got == Counter((i, *brute.stats(t)) for i, t in rows)


def test_forest_learns_and_flattens():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0.6)).astype(float)
    f = gbdt.fit_forest(x[:3000], y[:3000])
    assert ((f.score(x[3000:]) > 0.5) == (y[3000:] > 0.5)).mean() > 0.97
    node = 0
    for _ in range(4):  # one row by hand through the first tree
        node = 2 * node + 1 + int(x[0, f.feature[0, node]] > f.threshold[0, node])
    one = gbdt.Forest(f.feature[:1], f.threshold[:1], f.value[:1], f.base)
    assert one.margin(x[:1])[0] == pytest.approx(f.base + f.value[0, node - 15])
    assert (gbdt.fit_forest(np.zeros((0, 5)), np.zeros(0)).score(x[:3]) == 0.5).all()


def test_classifier_over_odd_rows(docs, rows, labels, nothing):
    got = gbdt.classify_quality(docs, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert gbdt.classify_quality(nothing, labels).count() == 0
    assert {r.score for r in gbdt.classify_quality(docs, labels.where("false")).collect()} == {0.5}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    p = gbdt.classify_quality(read("documents"), read("labels")).join(read("labels"), "doc_id").where("held_out").toPandas()
    assert ((p.predicted == p.quality).mean()) > 0.98
    q = rules.apply_quality_rules(read("documents"), read("labels")).join(read("labels"), "doc_id").toPandas()
    q = q[~q.base_failed]
    assert (q.kept == (q.quality == 1)).mean() > 0.98


def test_rules_are_learnt_and_applied_in_spark(spark):
    rng = np.random.default_rng(1)
    x = {"a": rng.random(3000), "b": rng.random(3000)}
    bad = ((x["a"] > 0.8) & (x["b"] < 0.5)) | (x["b"] > 0.95)
    learnt = rules.learn_list(x, bad)
    assert learnt and len(rules.describe(learnt)) == len(learnt)
    df = spark.createDataFrame([(float(a), float(b), bool(c)) for a, b, c in zip(x["a"], x["b"], bad)], "a double, b double, bad boolean")
    got = df.select("bad", rules.list_column(learnt).alias("kept")).toPandas()
    assert (got.kept != got.bad).mean() > 0.97
    assert rules.learn_list(x, np.zeros(3000, bool)) == []


def test_rules_over_odd_rows(docs, rows, labels, nothing):
    got = Counter((r.doc_id, r.n_words, r.base_failed) for r in rules.apply_quality_rules(docs, labels).collect())
    want = Counter()
    for i, t in rows:
        n, _, _, _, repeat = brute.stats(t)
        want[i, n, n < 10 or 100 * repeat > 20 * n] += 1
    assert got == want
    assert rules.apply_quality_rules(nothing, labels).count() == 0
    assert all(r.kept != r.base_failed for r in rules.apply_quality_rules(docs, labels.where("false")).collect())
