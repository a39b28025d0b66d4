"""Pipeline decisions on tables with null and repeated ids, row by row."""

from collections import Counter

import brute

from millrace.llm.gbdt import classify_quality

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def test_near_dedup_judges_rows(spark, rows):
    import corpus_pipeline as p

    mixed = [*rows, (None, rows[0][1]), *[(7000, t) for _, t in rows[:6]], *[(-5, "a text of some seven words only")] * 3, *[(None, "one more text of seven words here")] * 2, (8000, None), (8000, None)]
    order = sorted(range(len(mixed)), key=lambda k: (mixed[k][0] is None, mixed[k][0] or 0))
    groups = brute.near_duplicates([(n, mixed[k][1]) for n, k in enumerate(order)])
    # which of a group's rows with one least id stays is settled by hash
    want = Counter()
    for n, (_, c) in groups.items():
        if n == c:
            want[mixed[order[n]][0], frozenset(mixed[order[m]][1] for m, (_, d) in groups.items() if d == c and mixed[order[m]][0] == mixed[order[n]][0])] += 1
    got = Counter()
    member = {(mixed[order[n]][0], mixed[order[n]][1]): c for n, (_, c) in groups.items()}
    for r in p.near_dedup(spark, table(spark, mixed).repartition(3), SF).collect():
        c = member[r.doc_id, r.text]
        got[r.doc_id, frozenset(mixed[order[m]][1] for m, (_, d) in groups.items() if d == c and mixed[order[m]][0] == r.doc_id)] += 1
    # texts without a word are linked with nothing
    blank = lambda x: Counter({k: n for k, n in x.items() if any(brute.WORD.search(t or "") for t in k[1])})
    assert blank(got) == blank(want)
    assert sum(got.values()) - sum(blank(got).values()) == sum(not brute.WORD.search(t or "") for _, t in mixed)


def test_classifier_judges_rows(spark):
    import corpus_pipeline as p

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    scores = classify_quality(docs, labels).orderBy("score").collect()
    bad, good = texts[scores[0].doc_id], [r.doc_id for r in scores if r.held_out and r.predicted][-1]
    more = table(spark, [(good, bad), (None, bad), (None, texts[good])])
    kept = Counter((r.doc_id, r.text) for r in p.quality_classifier(spark, docs.select(p.COLUMNS).unionByName(more), SF).collect())
    assert kept[good, texts[good]] == 1 and kept[None, texts[good]] == 1
    assert kept[good, bad] == kept[None, bad] == 0
