"""Registered queries against SQL, and the pipeline stage by stage."""

import hashlib
import zlib
from collections import Counter, defaultdict

import brute
import duckdb
import numpy as np
import pandas as pd
import pytest
from tokenizers import Tokenizer

from millrace.llm import common, gbdt, media, queries, rules

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"  # the smallest has too few labels for rules


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.queries()[name](spark, SF).toPandas(), c.execute(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    text = lambda df: sorted(tuple("" if pd.isna(v) else str(v) for v in r) for r in df[sorted(df.columns)].astype(object).values.tolist())
    assert text(got) == text(want)


def rows_of(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def test_classifier_query_row_by_row(spark, monkeypatch):
    fitted, fit = [], gbdt.fit_forest
    monkeypatch.setattr(gbdt, "fit_forest", lambda *a, **k: fitted.append(fit(*a, **k)) or fitted[-1])
    got = {r.doc_id: r for r in queries.op10_quality_classifier(spark, SF).collect()}
    rows = rows_of(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id", "text")
    assert set(got) == {i for i, _ in rows}
    for i, t in rows:
        x = brute.ratios(t)
        want = brute.forest_score(fitted[0], [x[c] for c in gbdt.RATIOS])
        assert got[i].score == pytest.approx(want, abs=1e-9) and got[i].predicted == int(got[i].score >= 0.7)
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)


def test_rules_query_row_by_row(spark, monkeypatch):
    learnt, learn = [], rules.learn_list
    monkeypatch.setattr(rules, "learn_list", lambda *a, **k: learnt.append(learn(*a, **k)) or learnt[-1])
    got = {r.doc_id: r for r in queries.op5_quality_rules(spark, LARGER).collect()}
    rows = rows_of(spark.read.parquet(f"{LARGER}/documents.parquet"), "doc_id", "text")
    assert set(got) == {i for i, _ in rows} and learnt[0]
    for i, t in rows:
        n, chars, symbols, dup, repeat = brute.stats(t)
        failed = n < 10 or 100 * repeat > 20 * n
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (n, chars, symbols, dup, repeat, failed)
        assert r.kept == (not failed and brute.list_keeps(learnt[0], brute.ratios(t)))


def test_tokenised_queries_row_by_row(spark):
    plain = Tokenizer.from_file(queries.vocabulary())
    rows = sorted(rows_of(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id", "text"))
    ids = {i: np.array(plain.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for i, t in rows}
    start, want = 0, {}
    for i, _ in rows:
        want[i] = (start, len(ids[i]), zlib.crc32(ids[i].tobytes()))
        start += len(ids[i])
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op8_token_store(spark, SF).collect()} == want
    pieces, ends = queries.op4_harmonic_packing(spark, SF).collect(), Counter()
    for r in pieces:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        ends[r.doc_id] += r.length
    assert ends == {i: len(x) for i, x in ids.items()}


def test_media_query_row_by_row(spark):
    rows = rows_of(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id", "text")
    got = {r.doc_id: r for r in queries.op9_telephony_audio(spark, SF).collect()}
    assert set(got) == {i for i, _ in rows}
    for i, t in rows:
        raw = (t or "").encode()
        payload = media.payload_of(raw)
        wav = media.wav(payload, media.codec_of(len(raw)))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(wav), hashlib.sha256(wav).hexdigest())


def test_pipeline_against_brute_force(spark, tmp_path):
    """Every stage over its predecessor's rows, held against a plain version of the stage."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    start, tables = docs.schema, [rows_of(docs, "doc_id", "text", "source")]
    scores = {r.doc_id: r.predicted for r in gbdt.classify_quality(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    for i, (name, stage) in enumerate(p.STAGES):
        docs = stage(spark, docs, SF)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if i + 1 < len(p.STAGES):
            assert [(f.name, f.dataType) for f in docs.schema] == [(f.name, f.dataType) for f in start]
            tables.append(rows_of(docs, "doc_id", "text", "source"))
    given, classified, single, cut, mixed = tables
    assert Counter(classified) == Counter(r for r in given if scores[r[0]] == 1)
    groups = brute.near_duplicates([(i, t) for i, t, _ in classified])
    assert Counter(single) == Counter(r for r in classified if groups[r[0]][1] == r[0])
    want = Counter()
    for (i, t, s), (n, gone, kept) in zip(single, brute.repeated_words([(i, t) for i, t, _ in single])):
        if gone == 0 or gone < n:
            want[i, kept if gone else t, s] += 1
    assert Counter(cut) == want
    assert Counter(mixed) == Counter({r: n for r, n in zip(cut, brute.poisson_copies(cut)) if n})
    plain, found, sequences = Tokenizer.from_file(queries.vocabulary()), Counter(), defaultdict(list)
    texts = {i: np.array(plain.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for i, t, _ in mixed}
    for r in docs.collect():
        assert bytes(r.ids) == texts[r.doc_id][r.start : r.start + r.length].tobytes()
        found.update((r.doc_id, k) for k in range(r.start, r.start + r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    copies = Counter(i for i, _, _ in mixed)
    assert found == Counter({(i, k): n for i, n in copies.items() for k in range(len(texts[i]))})
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 4096


def test_a_result_outlives_the_next_run(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(50)
    a, b = p.pack(spark, docs, SF), p.pack(spark, docs, SF)
    assert a.count() == b.count() > 0
    with common.Scope() as scope:
        first = p.run(spark, SF)
    second = p.run(spark, SF)
    assert first.count() == second.count() > 0
    scope.drop(spark)
    assert not scope.paths


def test_a_cluster_must_name_its_folder(spark):
    class Cluster:
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.scratch_root(Cluster())


def test_packed_sequences_are_gapless(spark):
    """The registered layout: pieces of a sequence lie end to end from 0, 4,096 tokens at most, and a document's pieces cover it."""
    pieces = rows_of(queries.op4_harmonic_packing(spark, SF), "sequence_id", "offset", "length", "doc_id", "start", "doc_tokens")
    sequences, docs = defaultdict(list), defaultdict(list)
    for seq, offset, length, doc, start, tokens in pieces:
        sequences[seq].append((offset, length))
        docs[doc].append((start, length, tokens))
    for laid in sequences.values():
        at = 0
        for offset, length in sorted(laid):
            assert offset == at and length > 0
            at += length
        assert at <= 4096
    for cut in docs.values():
        at = 0
        for start, length, tokens in sorted(cut):
            assert start == at
            at += length
        assert at == cut[0][2]


def test_new_operators_handle_empty_tables(spark, tmp_path):
    """An empty table gives no rows, but for the probe conversation of op12."""
    for t in ("documents", "conversations"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    counts = {name: queries.queries()[name](spark, str(tmp_path)).count() for name in ("op11_conversation_repair", "op12_reply_trees", "op13_phrase_collocations")}
    assert counts == {"op11_conversation_repair": 0, "op12_reply_trees": 1, "op13_phrase_collocations": 0}
