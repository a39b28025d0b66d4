import functools
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import packing, token_store, tokens
from millrace.llm.mph import MinimalPerfectHash
from millrace.llm.queries import vocabulary

ODD = ["", "a<|endoftext|>b <|startoftext|> X.", "don't WE'LL Σς ΑΣ é É á! x\x85y z\x1cw ﬁ 가각 क़.", "  \n\t x  ", "日本語 テスト🙂🙂.", "A.B, c.,d ). e!? 9. x_. é.", "İstanbul ǅ K."]


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(vocabulary())


def test_cached_words_give_the_tokenizers_ids(plain, rows):
    texts = [t or "" for _, t in rows] + ODD
    got = tokens.encoder(vocabulary()).encode([t.encode() for t in texts])
    for t, g in zip(texts, got):
        assert np.frombuffer(g, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, t


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from("HJTWYhjtwyAaSs .!"), st.characters(min_codepoint=0x300, max_codepoint=0x345), st.characters(min_codepoint=0xC0, max_codepoint=0x1FF)), max_size=25))
def test_marks_compose_as_in_the_library(text):
    got = np.frombuffer(tokens.encoder(vocabulary()).encode([text.encode()])[0], "<u4").tolist()
    assert got == _library().encode(text, add_special_tokens=False).ids


@functools.cache
def _library():
    return Tokenizer.from_file(vocabulary())


def test_cut_lengths():
    for n in [*range(1, 9000, 7), 4096, 8192]:
        parts = packing.cut_lengths(n, 4096, 0.02)
        assert sum(parts) == n and max(parts) <= 4096 and len(parts) <= n // 4096 + 8
        for p in parts[:-1]:
            k = 4096 // p
            assert 4096 - k * p <= 0.02 * 4096


def test_packing(docs, rows, plain):
    got = packing.pack_documents(docs, vocabulary()).collect()
    want = defaultdict(list)
    for i, t in rows:
        want[i].append(plain.encode(t or "", add_special_tokens=False).ids + [2])
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        pieces[r.doc_id, r.doc_tokens].append((r.start, ids))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, docs_of in want.items():
        for size, same in Counter(len(d) for d in docs_of).items():
            found = sorted(pieces[i, size])
            assert sum(len(x) for _, x in found) == size * same
            for start, ids in found:
                assert any(d[start : start + len(ids)] == ids for d in docs_of if len(d) == size)
    padding = total = 0
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 4096
        total += at
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding < max(4096, 0.02 * total) and set(sequences) == set(range(len(sequences)))


def test_store_round_trip(docs, rows, plain):
    got = token_store.token_store_digest(docs, vocabulary()).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in got) == sorted((i is not None, i or 0) for i, _ in rows)
    want = Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ((i, plain.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in rows))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    numbered = [r.doc_id for r in sorted(got, key=lambda r: r.start) if r.doc_id is not None]
    assert numbered == sorted(numbered)


def test_keyed_access_and_strangers(spark, docs, rows, plain, tmp_path):
    folder = f"file://{tmp_path}"
    manifest = token_store.write_token_store(docs, vocabulary(), folder, shard_docs=7)
    found, longest = 0, max(Counter(i for i, _ in rows).values())
    for m in manifest.collect():
        shard = token_store.Shard(folder, m["index"], m["payload"])
        assert len(shard.doc_ids) <= 7 + longest
        ids = np.unique(shard.doc_ids[shard.nulls :])
        slots = shard.find_ids(ids)
        assert (slots >= 0).all()
        found += len(ids)
        assert all(shard.read(int(s))[-1] == 2 for s in slots)
        strangers = shard.find_ids(np.arange(10**6, 10**6 + 5000))
        assert (strangers >= 0).mean() < 0.01
    assert found == docs.where("doc_id is not null").select("doc_id").distinct().count()
    some = docs.where("doc_id is not null").dropDuplicates(["doc_id"]).where("doc_id % 2 = 0")
    texts = {i: plain.encode(t or "", add_special_tokens=False).ids + [2] for i, t in rows if i is not None}
    got = token_store.read_token_store(manifest, folder, some).collect()
    assert len(got) == some.count()
    assert all(r.ids_crc32 == zlib.crc32(np.array(texts[r.doc_id], "<u4").tobytes()) for r in got)
    with pytest.raises(Exception, match="misses"):
        token_store.read_token_store(manifest, folder, spark.createDataFrame([(999_999,)], "doc_id long")).collect()


def test_greatest_and_null_ids(spark):
    docs = spark.createDataFrame([(2**63 - 1, "a"), (None, "b"), (-(2**63), "c"), (None, "b c")], "doc_id long, text string")
    got = token_store.token_store_digest(docs, vocabulary()).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, -(2**63), 2**63 - 1]


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_minimal_perfect_hash(n):
    keys = np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64)
    h = MinimalPerfectHash.build(keys)
    assert sorted(h.slots(np.unique(keys)).tolist()) == list(range(len(np.unique(keys))))
    assert n < 1000 or len(h.bits) * 8 < 6 * n


def test_empty_tables(nothing):
    assert packing.pack_documents(nothing, vocabulary()).count() == 0
    assert token_store.token_store_digest(nothing, vocabulary()).count() == 0


def test_word_cache_is_bounded_by_bytes():
    """Long words are encoded and not kept, with or without stops; short ones start anew beyond the bytes."""
    import random

    from millrace.llm import tokens
    from millrace.llm.queries import vocabulary

    rng = random.Random(1)
    enc = tokens.WordEncoder(vocabulary())
    junk = ["".join(rng.choice("abcxyz0189+/") for _ in range(20_000)) + rng.choice(["", ".", "!?"]) for _ in range(300)]
    texts = [f"Short words here. {w} {w}" for w in junk]
    for t in texts:
        (ids,) = enc.encode([t.encode()])
        assert len(ids) > 20_000
    want = enc.tokenizer.encode(texts[0], add_special_tokens=False).ids
    assert list(memoryview(enc.encode([texts[0].encode()])[0]).cast("I")) == want
    assert sum(len(k) + len(v) for k, v in enc.known.items()) < 10_000 and max(map(len, enc.known)) <= tokens.LONGEST
    before, tokens.CACHE_BYTES = tokens.CACHE_BYTES, 2000
    try:
        for i in range(50):
            enc.encode([" ".join(f"w{i}x{j}" for j in range(40)).encode()])
            assert sum(len(k) + len(v) for k, v in enc.known.items()) < 2000 + 40 * 60
    finally:
        tokens.CACHE_BYTES = before
