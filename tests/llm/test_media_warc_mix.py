import hashlib
import zlib
from collections import Counter

import brute
import duckdb
import numpy as np
import pytest

from millrace.llm import media, mixing, warc


def test_companding_tables():
    mu, a = media.mulaw_table().tolist(), media.alaw_table().tolist()
    assert (mu[0], mu[0x7F], mu[0x80], mu[0xFF]) == (-32124, 0, 32124, 0)
    assert (a[0x55], a[0xD5], a[0x2A], a[0xAA]) == (-8, 8, -32256, 32256)


def test_adpcm_against_a_loop():
    rng = np.random.default_rng(4)
    blocks = rng.integers(0, 256, (40, 64), dtype=np.uint8)
    blocks[0] = 0
    assert media.decode_adpcm(blocks).tolist() == [brute.decode_adpcm(bytes(b)) for b in blocks]


def plain_resample(row, rate, to):
    """Sample by sample, over the taps in floating point."""
    from math import gcd

    up, down = to // gcd(rate, to), rate // gcd(rate, to)
    taps = media.low_pass(up, down).tolist()
    reach, out = len(taps[0]) // 2, []
    for m in range(-(-len(row) * to // rate)):
        base, phase = m * down // up, m * down % up
        total = sum(h * row[min(max(base + j + 1 - reach, 0), len(row) - 1)] for j, h in enumerate(taps[phase]))
        out.append(max(-32768, min(32767, (total + 16384) >> 15)))
    return out


@pytest.mark.parametrize("to", [16000, 8000, 6000, 4000, 2000])
def test_resample_against_a_loop(to):
    rng = np.random.default_rng(to)
    rows = [rng.integers(-32768, 32768, n).astype(np.int16) for n in (1, 2, 3, 50, 200)]
    pcm, offsets = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    out, at = media.resample(pcm, offsets, 8000, to)
    for r, a, b in zip(rows, at[:-1], at[1:]):
        assert out[a:b].tolist() == plain_resample(r.tolist(), 8000, to)


def test_resampling_keeps_tones_and_stops_aliases():
    t = np.arange(4000)
    tone = lambda hz, rate: 10000 * np.sin(2 * np.pi * hz * t[: 4000 * rate // 8000] / rate)
    level = lambda hz, to: np.abs(media.resample(tone(hz, 8000).astype(np.int16), np.array([0, 4000]), 8000, to)[0][100:-100]).max()
    assert level(500, 16000) == pytest.approx(10000, rel=0.02) and level(500, 4000) == pytest.approx(10000, rel=0.02)
    assert level(3500, 4000) < 100  # would fold to 500 Hz


def test_media_round_trip(docs, rows, nothing):
    got = media.media_digest(docs).collect()
    want = Counter()
    for i, t in rows:
        p = media.payload_of((t or "").encode())
        want[i, len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    by_payload: dict = {}
    for r in got:
        by_payload.setdefault((r.payload_sha256, r.n_bytes), set()).add((r.media_bytes, r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in by_payload.values())
    assert media.media_digest(nothing).count() == 0


def test_decode_column(spark, docs):
    got = media.decode_audio(media.store_audio(docs.where("doc_id is not null"))).collect()
    for r in got:
        codec, payload = media.parse_wav(bytes(r.media))
        samples = len(payload) if codec != "adpcm" else len(payload) // 64 * 121
        assert r.codec == codec and len(r.pcm) == 2 * 2 * samples


def test_digest_reads_stored_pcm(spark, docs):
    with media.common.Scope() as scope:
        got = media.media_digest(docs.where("doc_id is not null")).collect()
    pcm_path, media_path = (next(p for p in scope.paths if f"/{k}-" in p) for k in ("pcm", "media"))
    stored = {hashlib.sha256(r.media).hexdigest(): bytes(r.media) for r in spark.read.parquet(media_path).collect()}
    want = Counter()
    for r in spark.read.parquet(pcm_path).collect():
        pcm = np.frombuffer(bytes(r.pcm), "<i2").astype(np.int64)
        size, turns = np.abs(pcm), int(((pcm[1:] >= 0) != (pcm[:-1] >= 0)).sum())
        want[r.id, r.media_sha256, f"{r.codec}:{len(pcm)}:{size.sum() // len(pcm)}:{int(np.sqrt((pcm * pcm).sum() // len(pcm)))}:{size.max()}:{turns}"] += 1
        codec, payload = media.parse_wav(stored[r.media_sha256])
        samples, offsets = media.resample(*media.decode([payload], codec), 8000, 16000)
        assert pcm.tolist() == samples.tolist()
    assert Counter((r.doc_id, r.media_sha256, r.feature) for r in got) == want
    scope.drop(spark)


PAGES = [(1, "http://a/1", "<p>x</p>"), (2, "http://a/2", "<p>y</p>"), (9, "u", "<p>x</p>"), (5, "u\r\nX: y", "<p>x</p>"), (3, None, None), (4, "v", ""), (None, "w", "<p>x</p>"), (7, "z", "é\r\n\r\n" * 5000), (2, "http://a/2", "<p>y</p>")]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, 1) for p in PAGES], "page_id long, url string, html string, refers_to int")


def test_warc_round_trip(pages):
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.warc_round_trip(pages).collect())
    want = Counter()
    for i, _, html in PAGES:
        raw = (html or "").encode()
        first = min(j for j, _, h in PAGES if (h or "") == (html or "") and j is not None)
        revisit = i is not None and i != first
        want[i, len(raw), warc.digest(raw), "revisit" if revisit else "response", first if revisit else None] += 1
    assert got == want
    assert warc.warc_round_trip(pages.where("false")).count() == 0


def test_small_payloads_are_all_responses(pages, spark, tmp_path):
    folder = f"file://{tmp_path}"
    read = warc.read_archives(warc.write_archives(pages, folder, least_revisit=100), folder)
    assert {r.record_type for r in read.collect()} == {"response"}
    assert warc.read_warc(spark, f"{folder}/*.warc.gz").count() == len(PAGES)


def test_reader_takes_members_across_chunks_and_verifies():
    one = warc.record_bytes([("WARC-Type", "response"), ("WARC-Payload-Digest", "sha1:" + warc.digest(b"abc"))], b"HTTP/1.1 200 OK\r\n\r\nabc")
    raw = one * 3
    assert len(list(warc.read_records(raw[i : i + 7] for i in range(0, len(raw), 7)))) == 3
    with pytest.raises(ValueError, match="cut off"):
        list(warc.read_records([raw[:-5]]))
    bad = warc.record_bytes([("WARC-Type", "response"), ("WARC-Payload-Digest", "sha1:" + warc.digest(b"abd"))], b"HTTP/1.1 200 OK\r\n\r\nabc")
    with pytest.raises(ValueError, match="digest"):
        list(warc.read_records([bad]))


def test_foreign_archives(spark, tmp_path):
    info = warc.record_bytes([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:uuid:aa>"), ("Content-Type", "application/warc-fields")], b"software: x\r\n")
    asked = warc.record_bytes([("WARC-Type", "request"), ("WARC-Record-ID", "<urn:uuid:bb>")], b"GET / HTTP/1.1\r\n\r\n")
    page = warc.record_bytes([("warc-type", "response"), ("Warc-Record-Id", "<urn:uuid:cc>"), ("WARC-Target-URI", "http://a/"), ("X-Folded", "a\r\n b"), ("warc-block-digest", "xyz:unknown")], b"HTTP/1.1 200 OK\r\n\r\nabc")
    lower = warc.record_bytes([("WARC-Type", "resource"), ("WARC-Record-ID", "<urn:uuid:dd>"), ("WARC-Block-Digest", "sha256:" + hashlib.sha256(b"q").hexdigest())], b"q")
    again = warc.record_bytes([("WARC-Type", "revisit"), ("WARC-Record-ID", "<urn:uuid:ee>"), ("WARC-Refers-To", "<urn:uuid:cc>")], b"HTTP/1.1 200 OK\r\n\r\n")
    (tmp_path / "x.warc.gz").write_bytes(info + asked + page + lower + again)
    got = {r.record_id[-3:-1]: r for r in warc.read_warc(spark, f"file://{tmp_path}/*.warc.gz").collect()}
    assert [got[k].record_type for k in ("aa", "bb", "cc", "dd", "ee")] == ["warcinfo", "request", "response", "resource", "revisit"]
    assert (bytes(got["cc"].payload), got["cc"].payload_digest, got["cc"].page_id, got["cc"].url) == (b"abc", warc.digest(b"abc"), None, "http://a/")
    assert bytes(got["dd"].payload) == b"q" and got["ee"].payload is None and got["ee"].refers_to_id == "<urn:uuid:cc>"


def test_mixing_reaches_targets(spark):
    rows = [(i, "x" * 100, "big" if i % 4 else "small") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("big", 0.4), ("small", 0.6)], "source string, weight double")
    got = Counter(r.source for r in mixing.mix_sources(docs, targets).collect())
    assert abs(sum(got.values()) - 4000) < 300 and abs(got["small"] / sum(got.values()) - 0.6) < 0.04
    counts = Counter(Counter(r.doc_id for r in mixing.mix_sources(docs, targets).where("source = 'small'").collect()).values())
    assert max(counts) >= 5  # whole tails, no cap
    assert {r.source for r in mixing.mix_sources(docs, targets.where("source = 'big'")).collect()} == {"big"}


def test_large_rates_don_t_underflow(spark):
    rates = spark.createDataFrame([("s", 5000.0), ("none", 0.0)], "source string, rate double")
    (row,) = mixing.poisson_tables(rates).collect()
    assert row.source == "s" and row.upto[-1] == pytest.approx(1.0) and row.upto[5000] == pytest.approx(0.5, abs=0.01)


def test_mixing_odd_rows_and_order(docs, rows, nothing):
    got = mixing.mix_sources(docs).collect()
    assert [r.mix_key for r in got] == sorted(r.mix_key for r in got)
    assert {r.doc_id for r in got} <= {i for i, _ in rows} and got[0].n_words == "clash"
    again = mixing.mix_sources(docs.repartition(7)).collect()
    assert Counter((r.doc_id, r.copy_no, r.mix_key) for r in got) == Counter((r.doc_id, r.copy_no, r.mix_key) for r in again)
    assert mixing.mix_sources(nothing).count() == 0
