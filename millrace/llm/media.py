"""Telephony audio columns: mu-law, A-law and IMA ADPCM in WAV form, decoded to PCM.

The stored form is a WAV file whose data chunk is the payload, byte for byte. Mu-law and A-law
codes expand by lookup tables; ADPCM blocks are decoded step by step with numpy across all blocks
of a slice, since steps depend on each other only inside a block. PCM is resampled behind a low-pass filter.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SLICE_BYTES = 4 << 20
UNIT = 64
#: WAV format tags.
FORMATS = {"alaw": 6, "mulaw": 7, "adpcm": 17}
_NAMES = {v: k for k, v in FORMATS.items()}
RATE = 8000


def mulaw_table() -> np.ndarray:
    """ITU-T G.711 mu-law codes to 16-bit samples, by the rule."""
    u = ~np.arange(256) & 0xFF
    magnitude = ((((u & 0x0F) << 3) + 0x84) << ((u >> 4) & 7)) - 0x84
    return np.where(u & 0x80, -magnitude, magnitude).astype(np.int16)


def alaw_table() -> np.ndarray:
    """ITU-T G.711 A-law codes to 16-bit samples, by the rule."""
    a = np.arange(256) ^ 0x55
    segment, low = (a >> 4) & 7, (a & 0x0F) << 4
    magnitude = np.where(segment == 0, low + 8, (low + 0x108) << np.maximum(segment - 1, 0))
    return np.where(a & 0x80, magnitude, -magnitude).astype(np.int16)


#: Index steps of IMA ADPCM by the low three bits of a code.
_INDEX_STEP = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def adpcm_steps() -> np.ndarray:
    """The 89 step sizes of IMA ADPCM: each about a tenth above the last (fixed values)."""
    return np.array(
        [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
        np.int32,
    )


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Blocks x bytes to blocks x samples: a header of sample, step index and filler, then two codes a byte, low one first.

    A step index over 88 reads as 88.
    """
    steps = adpcm_steps()
    n, width = blocks.shape
    sample = np.ascontiguousarray(blocks[:, :2]).view("<i2").ravel().astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    out = np.empty((1 + 2 * (width - 4), n), np.int16)
    out[0] = sample
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    for i in range(width - 4):
        for half, code in ((0, codes[i] & 15), (1, codes[i] >> 4)):
            step = steps[index]
            low = (code & 7).astype(np.int32)
            # step * (low + 0.5) / 4, each part truncated as the format's integer decoder does
            diff = (step >> 3) + np.where(low & 4, step, 0) + np.where(low & 2, step >> 1, 0) + np.where(low & 1, step >> 2, 0)
            sample = np.clip(sample + np.where(code & 8, -diff, diff), -32768, 32767)
            index = np.clip(index + _INDEX_STEP[low], 0, 88)
            out[1 + 2 * i + half] = sample
    return np.ascontiguousarray(out.T)


def wav(payload: bytes, codec: str) -> bytes:
    """A mono 8 kHz WAV file around a payload."""
    tag = FORMATS[codec]
    align, bits = (UNIT, 4) if codec == "adpcm" else (1, 8)
    extra = struct.pack("<HH", 2, 1 + 2 * (UNIT - 4)) if codec == "adpcm" else struct.pack("<H", 0)
    samples = len(payload) // UNIT * (1 + 2 * (UNIT - 4)) if codec == "adpcm" else len(payload)
    byte_rate = RATE * UNIT // (1 + 2 * (UNIT - 4)) if codec == "adpcm" else RATE
    fmt = struct.pack("<HHIIHH", tag, 1, RATE, byte_rate, align, bits) + extra
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(payload)) + payload
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse_wav(media: bytes) -> tuple[str, bytes]:
    """Codec and data chunk of a WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, codec = 12, ""
    while at + 8 <= len(media):
        name, n = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            codec = _NAMES[struct.unpack_from("<H", media, at + 8)[0]]
        if name == b"data":
            return codec, media[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)
    raise ValueError("no data chunk")


def decode(payloads: list[bytes], codec: str) -> tuple[np.ndarray, np.ndarray]:
    """Samples of payloads of one codec end to end, and their offsets."""
    data = np.frombuffer(b"".join(payloads), np.uint8)
    sizes = np.array([len(p) for p in payloads], np.int64)
    if codec == "adpcm":
        pcm, sizes = decode_adpcm(data.reshape(-1, UNIT)).ravel(), sizes // UNIT * (1 + 2 * (UNIT - 4))
    else:
        pcm = (mulaw_table() if codec == "mulaw" else alaw_table())[data]
    return pcm, np.concatenate([[0], np.cumsum(sizes)])


def low_pass(up: int, down: int, half: int = 6) -> np.ndarray:
    """Taps by phase (up x taps, each row adding up to 32768) of a Hann-windowed sinc at the lower of both Nyquist limits."""
    cut = min(1.0, up / down)  # of the input's Nyquist limit
    reach = math.ceil(half / cut)
    at = np.arange(1 - reach, reach + 1) - np.arange(up)[:, None] / up
    taps = np.sinc(at * cut) * np.where(np.abs(at) < reach, np.cos(np.pi * at / (2 * reach)) ** 2, 0)
    whole = np.rint(taps / taps.sum(1, keepdims=True) * 32768).astype(np.int32)
    whole[np.arange(up), reach - 1] += 32768 - whole.sum(1)
    return whole


def resample(pcm: np.ndarray, offsets: np.ndarray, rate: int, to: int) -> tuple[np.ndarray, np.ndarray]:
    """Band-limited resampling of rows end to end, in whole numbers: a row of n samples gets ceil(n * to / rate).

    Sample m lies at m * rate / to. A low-pass filter keeps what the new rate can't hold from folding back; a row's ends go on
    as they are.
    """
    n = np.diff(offsets)
    m = -(-n * to // rate)
    out = np.concatenate([[0], np.cumsum(m)])
    up, down = to // math.gcd(rate, to), rate // math.gcd(rate, to)
    if up == down or not len(pcm):
        return pcm, out
    taps = low_pass(up, down)
    reach = taps.shape[1] // 2
    # every row between copies of its ends, so that taps need no bounds
    first = offsets[:-1] + (2 * np.arange(len(n)) + 1) * reach
    padded = np.zeros(len(pcm) + 2 * reach * len(n), np.int32)
    padded[np.arange(len(pcm)) + np.repeat(first - offsets[:-1], n)] = pcm
    for side in range(reach):
        has = n > 0
        padded[first[has] - side - 1] = pcm[offsets[:-1][has]]
        padded[first[has] + n[has] + side] = pcm[offsets[1:][has] - 1]
    place = (np.arange(out[-1]) - np.repeat(out[:-1], m)) * down
    base, phase = np.repeat(first, m) + place // up, place % up
    total = np.zeros(out[-1], np.int32)
    for p in range(up):
        mine = slice(None) if up == 1 else np.flatnonzero(phase == p)
        at, part = base[mine], np.zeros(len(base[mine]), np.int32)
        for j, h in enumerate(taps[p].tolist()):
            if h:
                part += padded[at + (j + 1 - reach)] * np.int32(h)
        total[mine] = part
    return np.clip((total + 16384) >> 15, -32768, 32767).astype(np.int16), out


def _features(pcm: np.ndarray, offsets: np.ndarray) -> list[str]:
    """Samples, mean absolute level, root mean square, peak and zero crossings, as integers in a string."""
    start, n = offsets[:-1], np.maximum(np.diff(offsets), 1)
    wide = pcm.astype(np.int64)
    level, power, peak = (np.add.reduceat(np.abs(wide), start), np.add.reduceat(wide * wide, start), np.maximum.reduceat(np.abs(wide), start))
    turn = np.concatenate([[0], np.cumsum((pcm[1:] >= 0) != (pcm[:-1] >= 0)), [0]])
    crossings = turn[offsets[1:] - 1] - turn[start]
    return [f"{int(a)}:{int(b)}:{int(c)}:{int(d)}:{int(e)}" for a, b, c, d, e in zip(np.diff(offsets), level // n, np.sqrt(power // n).astype(np.int64), peak, crossings, strict=True)]


def payload_of(raw: bytes) -> bytes:
    """A text's bytes with zeros up to a positive multiple of 64."""
    return raw + bytes(max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def codec_of(n_bytes: int) -> str:
    """The three codecs in turn, by length: equal texts get equal codecs."""
    return ("mulaw", "alaw", "adpcm")[n_bytes % 3]


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = common.text_buffers(batch.column(1))
        for lo, hi in common.slices(offsets, SLICE_BYTES):
            raws = [data[a:b].tobytes() for a, b in zip(offsets[lo:hi].tolist(), offsets[lo + 1 : hi + 1].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([len(r) for r in raws], pa.int64()), pa.array([wav(payload_of(r), codec_of(len(r))) for r in raws], pa.binary())], ["id", "n_bytes", "media"])


def store_audio(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as a WAV column in the shared folder: the id, ``n_bytes`` and ``media``.

    A null or empty text is one unit of zeros. Null and repeated ids are stored as they come.
    """
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
    return common.stored(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(_encode, schema), "media")


def _decoded(rate: int, finish: Callable):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.concatenate([[0], np.cumsum([len(x) for x in batch.column("media").to_pylist()])])
            for lo, hi in common.slices(sizes, SLICE_BYTES):
                part = batch.slice(lo, hi - lo)
                parsed = [parse_wav(x) for x in part.column("media").to_pylist()]
                rows: list = [None] * len(parsed)
                for codec in FORMATS:
                    mine = [i for i, (c, _) in enumerate(parsed) if c == codec]
                    if mine:
                        pcm, offsets = resample(*decode([parsed[i][1] for i in mine], codec), RATE, rate)
                        for i, x in zip(mine, finish(pcm, offsets), strict=True):
                            rows[i] = (codec, x)
                yield part, parsed, rows

    return run


_DIGESTS = [("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType())]


def _digests(media: list[bytes], payloads: list[bytes]) -> list[pa.Array]:
    return [
        pa.array([len(p) for p in payloads], pa.int64()),
        pa.array([hashlib.sha256(p).hexdigest() for p in payloads], pa.string()),
        pa.array([zlib.crc32(p[-UNIT:]) for p in payloads], pa.int64()),
        pa.array([len(m) for m in media], pa.int64()),
        pa.array([hashlib.sha256(m).hexdigest() for m in media], pa.string()),
    ]


def decode_audio(stored: DataFrame, *, rate: int = 16000, keep_media: bool = True) -> DataFrame:
    """Stored media with the digests of payload and stored form, ``codec`` and ``pcm``: 16-bit little-endian samples at ``rate``.

    Without ``keep_media`` the ``media`` column itself is left out.
    """
    kept = [f for f in stored.schema.fields if keep_media or f.name != "media"]

    def run(batches):
        for part, parsed, rows in _decoded(rate, lambda pcm, o: [pcm[a:b].astype("<i2").tobytes() for a, b in zip(o[:-1], o[1:], strict=True)])(batches):
            digests = _digests(part.column("media").to_pylist(), [p for _, p in parsed])
            yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), *digests, pa.array([c for c, _ in rows], pa.string()), pa.array([x for _, x in rows], pa.binary())], [*(f.name for f in kept), *(n for n, _ in _DIGESTS), "codec", "pcm"])

    fields = [T.StructField(n, t) for n, t in (*_DIGESTS, ("codec", T.StringType()), ("pcm", T.BinaryType()))]
    return stored.mapInArrow(run, T.StructType([*kept, *fields]))


def audio_features(decoded: DataFrame) -> DataFrame:
    """Features of the ``pcm`` column beside the other columns, which stay but for ``media`` and ``codec``."""
    kept = [f for f in decoded.schema.fields if f.name not in ("media", "codec", "pcm")]

    def run(batches):
        for batch in batches:
            data, offsets = common.text_buffers(batch.column(batch.schema.get_field_index("pcm")))
            for lo, hi in common.slices(offsets, SLICE_BYTES):
                part = batch.slice(lo, hi - lo)
                pcm = np.frombuffer(data[offsets[lo] : offsets[hi]].tobytes(), "<i2")
                features = [f"{c}:{x}" for c, x in zip(part.column("codec").to_pylist(), _features(pcm, (offsets[lo : hi + 1] - offsets[lo]) // 2), strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), pa.array(features, pa.string())], [*(f.name for f in kept), "feature"])

    return decoded.mapInArrow(run, T.StructType([*kept, T.StructField("feature", T.StringType())]))


def media_digest(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rate: int = 16000) -> DataFrame:
    """Store every text as audio, read that back for its digests and its PCM at ``rate``, store those, and return them with features of the PCM as read back.

    One row for each input row.
    """
    decoded = common.stored(decode_audio(store_audio(docs, id_col=id_col, text_col=text_col), rate=rate, keep_media=False), "pcm")
    return audio_features(decoded).withColumnRenamed("id", id_col)
