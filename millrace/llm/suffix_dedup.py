"""Removal of byte strings that occur again anywhere in the corpus, by induced suffix sorting.

A string of ``span`` bytes that occurs twice has the same smallest hash of its 32-byte pieces
both times. So each window of ``span`` bytes is filed under its anchor, the place of that smallest hash,
and only windows of one anchor hash need comparing:

1. each task finds the anchors of its texts and files two keys for each, hashes of the 216 bytes
   after it and around it: a repeated window repeats one of them. Buckets of keys tell which occur twice;
2. each range of documents files the contexts (a run of windows with one anchor) that hold a repeated key,
   equal contexts of a range once, with their places. Windows of an anchor with ``heavy`` such contexts or
   more are filed singly, as 128-bit digests, each once for a range; their places stay with the range;
3. each bucket counts its digests, or sorts the suffixes of its distinct contexts by external induced sorting with common
   prefixes. Neighbours that share ``span`` bytes are one string; it repeats if its windows lie at two
   places or more;
4. each range removes the bytes that its repeated windows cover.

No window is left out: windows outside step 2 have no second occurrence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from xxhash import xxh3_128_digest

from . import common
from .induced_sort import Arena, sort_suffixes

#: Bytes hashed at an anchor, and for a key.
PIECE, KEY = 32, 216
SLICE_BYTES = 2 << 20
GROUP_BYTES = 12 << 20
#: Memory of a task's sorter; beyond it the queues are files.
SORT_MEMORY = 400 << 20
#: Text sorted at once in a bucket, whole anchor groups.
SHARD_BYTES = 2 << 20
#: Sides of contexts from which an anchor's windows are counted by digest, so that no sorted group is over 1.6 MB.
HEAVY = 2000
#: Text of the table for each pair of buckets, where that makes more of them than shuffle partitions do.
BUCKET_BYTES = 256 << 20
#: Contexts that a bucket takes apart at once.
CLASS_BYTES = 8 << 20
_POS = np.uint64(28)
#: Places that a hash's low bits can tell apart.
MOST_PLACES = 1 << 28
_MULT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xFF51AFD7ED558CCD)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= _MULT[3]
    h ^= h >> np.uint64(29)
    return h


def piece_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the 32 bytes at each place (none if there are fewer)."""
    n = len(data)
    if n < PIECE:
        return np.zeros(0, np.uint64)
    words = np.empty(n - 7, np.uint64)
    for o in range(8):
        m = (n - o) // 8
        words[o::8] = np.frombuffer(data[o : o + 8 * m].tobytes(), "<u8")
    m = n - PIECE + 1
    h = words[:m] * _MULT[0]
    for i in range(1, 4):
        h += words[8 * i : 8 * i + m] * _MULT[i]
    return _mix(h)


def anchors(data: np.ndarray, offsets: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes at each place; anchor, first and last window start of each run of windows with one anchor."""
    h = piece_hashes(data)
    empty = np.zeros(0, np.int64)
    starts = np.diff(offsets) - span + 1
    if not len(h) or (starts <= 0).all():
        return h, empty, empty, empty
    if len(h) > MOST_PLACES:  # a single text, in parts that overlap by a window: runs may end at a part's edge
        parts = []
        for lo in range(0, len(data) - span + 1, MOST_PLACES // 2):
            part = data[lo : lo + MOST_PLACES // 2 + span - 1]
            parts.append([x + lo for x in anchors(part, np.array([0, len(part)]), span)[1:]])
        return h, *(np.concatenate(x) for x in zip(*parts, strict=True))
    w = span - PIECE + 1
    key = ((h >> _POS) << _POS) | np.arange(len(h), dtype=np.uint64)  # ties go to the left
    padded = np.full(-(-len(key) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(key)] = key
    blocks = padded.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(right[: len(key) - w + 1], left[w - 1 : len(key)])
    inside = np.zeros(len(data) + 1, np.int8)
    has = starts > 0
    inside[offsets[:-1][has]] += 1
    inside[(offsets[:-1] + starts)[has]] -= 1
    at = np.flatnonzero(np.cumsum(inside[: len(least)], dtype=np.int8))
    anchor = (least[at] & np.uint64((1 << 28) - 1)).astype(np.int64)
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return h, anchor[first], at[first], at[last]


def _anchor_part(h: np.ndarray) -> np.ndarray:
    """The upper half of an anchor's keys; anchor hashes themselves are all small."""
    return _mix(h * _MULT[0]) >> np.uint64(32)


def _keys(h: np.ndarray, at: np.ndarray, side: int, anchor: np.ndarray) -> np.ndarray:
    """Hashes of the 216 bytes at given places, those of one anchor hash side by side."""
    k = np.zeros(len(at), np.uint64)
    for i, o in enumerate((0, 32, 64, 96, 128, 160, 184)):
        k += h[at + o] * _MULT[i]
    return _anchor_part(h[anchor]) << np.uint64(32) | _mix(k + np.uint64(side)) >> np.uint64(32)


def _sides(anchor: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which runs have windows that hold the 216 bytes after the anchor; and windows that hold those around it."""
    return last >= anchor - (KEY - PIECE), first < anchor - (KEY - PIECE)


def _file_keys(span: int, bits: int, bounds: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release_caches()
        for batch in batches:
            data, offsets = common.text_buffers(batch.column(1))
            ranges = common.range_of(bounds, common.id_array(batch.column(0)))
            found: dict[int, list[np.ndarray]] = {}
            for lo, hi in common.slices(offsets, SLICE_BYTES):
                part = offsets[lo : hi + 1]
                h, anchor, first, last = anchors(data[part[0] : part[-1]], part - part[0], span)
                of = ranges[lo:hi][np.searchsorted(part - part[0], anchor, "right") - 1]
                after, around = _sides(anchor, first, last)
                keys = np.concatenate([_keys(h, anchor[after], 1, anchor[after]), _keys(h, anchor[around] - (KEY - PIECE), 2, anchor[around])])
                of = np.concatenate([of[after], of[around]])
                for g in np.unique(of):
                    found.setdefault(int(g), []).append(keys[of == g])
            out: tuple[list, list, list, list] = ([], [], [], [])
            for g, parts in found.items():
                k, n = np.unique(np.concatenate(parts), return_counts=True)
                cut = np.searchsorted(k >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
                for b in np.flatnonzero(np.diff(cut)):
                    for column, v in zip(out, (int(b), g, common.pack_keys(k[cut[b] : cut[b + 1]]), n[cut[b] : cut[b + 1]].astype("<u4").tobytes()), strict=True):
                        column.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary())], ["_mr_bucket", "_mr_range", "_mr_keys", "_mr_counts"])

    return run


def _shared_keys(heavy: int):
    def run(rows: pa.Table) -> pa.Table:
        """One bucket: for each range its keys that occur twice or more in all, and the heavy ones among their anchors."""
        arrays = [common.unpack_keys(x.as_py()) for x in rows.column("_mr_keys")]
        k, of = np.unique(np.concatenate(arrays), return_inverse=True)
        n = np.bincount(of, np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in rows.column("_mr_counts")]))
        shared, n = k[n > 1], n[n > 1]
        anchor, of = np.unique(shared >> np.uint64(32), return_inverse=True)
        large = anchor[np.bincount(of, n, len(anchor)) >= heavy]
        out: dict[int, list[np.ndarray]] = {}
        for g, a in zip(rows.column("_mr_range").to_pylist(), arrays, strict=True):
            if len(hit := a[common.contains(shared, a)]):
                out.setdefault(g, []).append(hit)
        keys = [np.unique(np.concatenate(v)) for v in out.values()]
        mine = [np.unique(v >> np.uint64(32)) for v in keys]
        packed = ([common.pack_keys(v) for v in keys], [common.pack_keys(v[common.contains(large, v)]) for v in mine])
        return pa.table({"_mr_range": pa.array(list(out), pa.int64()), "_mr_keys": pa.array(packed[0], pa.binary()), "_mr_heavy": pa.array(packed[1], pa.binary())})

    return run


def _ordered(docs: pa.Table, id_col: str, text_col: str) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """A range's rows by id and text, so that both passes over it number its bytes alike."""
    docs = docs.take(pc.sort_indices(docs, sort_keys=[(id_col, "ascending"), (text_col, "ascending")]))
    return docs, *common.text_buffers(docs.column(text_col))


_CONTEXTS = "_mr_bucket long, _mr_range long, anchors binary, sizes binary, texts binary, context binary, place binary"
#: Rows of _CONTEXTS are of three kinds, by bucket: contexts; digests of windows (in ``texts``, their counts in ``sizes``);
#: and for each range the first and last window of its contexts with heavy anchors (in ``place``), which only pass through.
_ARROW_CONTEXTS = pa.schema([(x.split()[0], pa.int64() if x.endswith("long") else pa.binary()) for x in _CONTEXTS.split(", ")])


def _digests(raw: bytes, lo: list[int], hi: list[int], span: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """For contexts of windows ``lo`` to ``hi``: which of the distinct ones each is, their windows' digests, how often each occurs."""
    number: dict[bytes, int] = {}
    of = np.array([number.setdefault(raw[x : y + span], len(number)) for x, y in zip(lo, hi, strict=True)], np.int64)
    found = [np.frombuffer(b"".join([xxh3_128_digest(t[i : i + span]) for i in range(len(t) - span + 1)]), "S16") for t in number]
    return of, found, np.bincount(of, minlength=len(number))


def _file_contexts(span: int, buckets: int, id_col: str, text_col: str):
    schema = _ARROW_CONTEXTS

    def run(docs: pa.Table, keys: pa.Table) -> pa.Table:
        if docs.num_rows == 0 or keys.num_rows == 0:
            return schema.empty_table()
        g = keys.column("_mr_range")[0].as_py()
        docs, data, offsets = _ordered(docs, id_col, text_col)
        shared = np.unique(np.concatenate([common.unpack_keys(x.as_py()) for x in keys.column("_mr_keys")]))
        large = np.unique(np.concatenate([common.unpack_keys(x.as_py()) for x in keys.column("_mr_heavy")]))
        found: list[list[np.ndarray]] = [[], [], []]
        for lo, hi in common.slices(offsets, SLICE_BYTES):
            base = offsets[lo]
            h, anchor, first, last = anchors(data[base : offsets[hi]], offsets[lo : hi + 1] - base, span)
            after, around = _sides(anchor, first, last)
            after[after] = common.contains(shared, _keys(h, anchor[after], 1, anchor[after]))
            around[around] = common.contains(shared, _keys(h, anchor[around] - (KEY - PIECE), 2, anchor[around]))
            # windows of a side whose key occurs once have no second occurrence
            lo_w = np.where(around, first, np.maximum(first, anchor - (KEY - PIECE)))
            hi_w = np.where(after, last, np.minimum(last, anchor - (KEY - PIECE) - 1))
            take = after | around
            for column, v in zip(found, (h[anchor[take]], lo_w[take] + base, hi_w[take] + base), strict=True):
                column.append(v)
        hashes, lo_w, hi_w = (np.concatenate(x) for x in found)
        raw, rows = data.tobytes(), []
        if (hot := common.contains(large, _anchor_part(hashes))).any():
            lo, hi = lo_w[hot], hi_w[hot]
            _, windows, times = _digests(raw, lo.tolist(), hi.tolist(), span)
            d, at = np.unique(np.concatenate(windows), return_inverse=True)
            n = np.minimum(np.bincount(at, np.repeat(times, [len(w) for w in windows])), 2).astype(np.uint8)
            bucket = np.frombuffer(d.tobytes(), "<u8")[::2] % np.uint64(buckets)
            for b in np.unique(bucket):
                rows.append((buckets + int(b), g, None, n[bucket == b].tobytes(), d[bucket == b].tobytes(), None, None))
            rows.append((2 * buckets + g, g, None, None, None, None, np.stack([lo, hi]).astype("<i8").tobytes()))
            hashes, lo_w, hi_w = hashes[~hot], lo_w[~hot], hi_w[~hot]
        bucket = (hashes % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(cut)):
            at = order[cut[b] : cut[b + 1]]
            number: dict[bytes, int] = {}
            of = [number.setdefault(raw[x : y + span], len(number)) for x, y in zip(lo_w[at].tolist(), hi_w[at].tolist(), strict=True)]
            _, one = np.unique(np.array(of), return_index=True)
            texts = list(number)
            rows.append((int(b), g, hashes[at][one].tobytes(), np.array([len(t) for t in texts], "<u4").tobytes(), b"".join(texts), np.array(of, "<u4").tobytes(), lo_w[at].astype("<u8").tobytes()))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema) if rows else schema.empty_table()

    return run


def repeated_windows(texts: list[bytes], anchor: np.ndarray, count: np.ndarray, span: int, memory: int, shard: int) -> list[np.ndarray]:
    """For each distinct context which of its windows occur twice or more, contexts counted ``count`` times.

    Contexts of one anchor hash are compared with each other, by sorting the suffixes of shards of whole anchor groups.
    """
    windows = np.array([len(t) - span + 1 for t in texts], np.int64)
    out = [np.full(n, c > 1) for n, c in zip(windows.tolist(), count.tolist(), strict=True)]
    order = np.argsort(anchor, kind="stable")
    group = np.flatnonzero(np.concatenate([[True], anchor[order][1:] != anchor[order][:-1]]))
    members = [g for g in np.split(order, group[1:]) if len(g) > 1]  # a lone context can only equal its own copies
    lo = 0
    while lo < len(members):
        hi, size = lo, 0
        while hi < len(members) and (hi == lo or size < shard):
            size += sum(len(texts[i]) for i in members[hi])
            hi += 1
        mine = np.concatenate(members[lo:hi])
        lo = hi
        # bytes from 2 on, 1 after each context, 0 at the end
        data = np.frombuffer(b"".join(texts[i] + b"\xff" for i in mine), np.uint8).astype(np.int32)
        data += 2
        sizes = np.array([len(texts[i]) for i in mine], np.int64) + 1
        ends = np.cumsum(sizes)
        data[ends - 1] = 1
        with Arena(memory) as arena:
            place, lcp = sort_suffixes(np.append(data, np.int32(0)), span, arena)
        same = np.cumsum(lcp < span)  # suffixes that share their first span bytes
        begin = ends - sizes
        of = np.searchsorted(ends, place, "right")
        of[of == len(mine)] = 0
        valid = (place - begin[of] < windows[mine][of]) & (place < ends[-1])
        weight = np.bincount(same[valid], count[mine][of[valid]], int(same[-1]) + 1)
        hit = np.flatnonzero(valid)[weight[same[valid]] > 1]
        flags = np.zeros(len(data), bool)
        flags[place[hit]] = True
        for i, b in zip(mine.tolist(), begin.tolist(), strict=True):
            out[i] = out[i] | flags[b : b + windows[i]]
    return out


_FOUND = "_mr_range long, _mr_spans binary, _mr_digests binary, _mr_places binary"


def _found(ranges: list, **columns: list) -> pa.Table:
    names = ("_mr_spans", "_mr_digests", "_mr_places")
    return pa.table({"_mr_range": pa.array(ranges, pa.int64())} | {n: pa.array(columns.get(n, [None] * len(ranges)), pa.binary()) for n in names})


def _count_digests(rows: pa.Table) -> pa.Table:
    """For each range those of its digests that occur twice or more in all."""
    arrays = [np.frombuffer(x, "S16") for x in rows.column("texts").to_pylist()]
    d, at = np.unique(np.concatenate(arrays), return_inverse=True)
    n = np.bincount(at, np.concatenate([np.frombuffer(x, np.uint8) for x in rows.column("sizes").to_pylist()]))
    hits = np.split(n[at] > 1, np.cumsum([len(a) for a in arrays])[:-1])
    return _found(rows.column("_mr_range").to_pylist(), _mr_digests=[a[h].tobytes() for a, h in zip(arrays, hits, strict=True)])


def _sort_bucket(span: int, memory: int, shard: int, buckets: int):
    def run(rows: pa.Table) -> pa.Table:
        kind = rows.column("_mr_bucket")[0].as_py() // buckets
        if kind:
            return _count_digests(rows) if kind == 1 else _found(rows.column("_mr_range").to_pylist(), _mr_places=rows.column("place").to_pylist())
        out: tuple[list, list] = ([], [])
        classes = -(-sum(len(x.as_buffer()) for x in rows.column("texts")) // CLASS_BYTES)
        for c in range(classes):  # by anchor hash, so that a part of the bucket is in memory twice
            for g, spans in _sort_class(rows, c, classes):
                out[0].append(g)
                out[1].append(spans)
        return _found(out[0], _mr_spans=out[1])

    def _sort_class(rows: pa.Table, c: int, classes: int) -> Iterator[tuple[int, bytes]]:
        number: dict[bytes, int] = {}
        anchor, count, inner, places = [], [], [], []
        for hashes, sizes, blob, of, place in zip(*(rows.column(x) for x in ("anchors", "sizes", "texts", "context", "place")), strict=True):
            hashes = np.frombuffer(hashes.as_buffer(), "<u8")
            ends = np.cumsum(np.frombuffer(sizes.as_buffer(), "<u4"), dtype=np.int64)
            begins = np.append(0, ends[:-1])
            blob = memoryview(blob.as_buffer())
            here = np.flatnonzero(_anchor_part(hashes) % np.uint64(classes) == c)
            mine = np.full(len(hashes), -1)
            for k, h, a, b in zip(here.tolist(), hashes[here].tolist(), begins[here].tolist(), ends[here].tolist(), strict=True):
                i = number.setdefault(bytes(blob[a:b]), len(number))
                if i == len(anchor):
                    anchor.append(h)
                    count.append(0)
                mine[k] = i
            of = mine[np.frombuffer(of.as_buffer(), "<u4")]
            places.append(np.frombuffer(place.as_buffer(), "<u8").astype(np.int64)[of >= 0])
            of = of[of >= 0]
            inner.append(of)
            for i, n in zip(*np.unique(of, return_counts=True), strict=True):
                count[i] += int(n)
        flags = repeated_windows(list(number), np.array(anchor, np.uint64), np.array(count, np.int64), span, memory, shard)
        # runs of repeated windows of each context
        edge = [np.diff(np.concatenate([[0], f.view(np.int8), [0]])) for f in flags]
        starts, ends = [np.flatnonzero(e == 1) for e in edge], [np.flatnonzero(e == -1) for e in edge]
        for g, of, place in zip(rows.column("_mr_range").to_pylist(), inner, places, strict=True):
            n = np.array([len(starts[i]) for i in of.tolist()], np.int64)
            if n.sum():
                base = np.repeat(place, n)
                pairs = np.stack([base + np.concatenate([starts[i] for i in of.tolist()]), base + np.concatenate([ends[i] for i in of.tolist()]) + span - 1], 1)
                yield g, pairs.astype("<i8").tobytes()

    return run


def _heavy_spans(data: np.ndarray, spans: pa.Table, span: int) -> np.ndarray:
    """Spans of a range's repeated windows with heavy anchors."""
    places = [np.frombuffer(x, "<i8").reshape(2, -1) for x in spans.column("_mr_places").to_pylist() if x is not None]
    hits = [np.frombuffer(x, "S16") for x in spans.column("_mr_digests").to_pylist() if x]
    if not places or not hits:
        return np.zeros((0, 2), np.int64)
    lo, hi = np.concatenate(places, 1)
    of, windows, _ = _digests(data.tobytes(), lo.tolist(), hi.tolist(), span)
    repeated, out = np.sort(np.concatenate(hits)), []
    at = [np.flatnonzero(common.contains(repeated, w)) for w in windows]
    for i, x in zip(of.tolist(), lo.tolist(), strict=True):
        a = at[i]
        if len(a):
            new = np.flatnonzero(np.diff(a) > 1) + 1
            out.append(np.stack([x + a[np.append(0, new)], x + a[np.append(new, len(a)) - 1] + span], 1))
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def _remove(span: int, id_col: str, text_col: str, schema: pa.Schema):
    def run(docs: pa.Table, spans: pa.Table) -> pa.Table:
        if docs.num_rows == 0:
            return schema.empty_table()
        docs, data, offsets = _ordered(docs, id_col, text_col)
        pairs = np.concatenate([np.zeros((0, 2), np.int64), *(np.frombuffer(x.as_py(), "<i8").reshape(-1, 2) for x in spans.column("_mr_spans") if x.is_valid), _heavy_spans(data, spans, span)])
        kind = np.int32 if max(len(data), len(pairs)) < 1 << 31 else np.int64
        cover = np.zeros(len(data) + 1, kind)
        np.add.at(cover, pairs[:, 0], 1)
        np.add.at(cover, pairs[:, 1], -1)
        gone = np.cumsum(cover, out=cover)[:-1] > 0
        del cover, pairs
        total = np.zeros(len(data) + 1, kind)
        np.cumsum(gone, out=total[1:])
        removed = (total[offsets[1:]] - total[offsets[:-1]]).astype(np.int64)
        del total
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        first = offsets[:-1][np.diff(offsets) > 0]
        begins[first] = gone[first]  # runs end with their document
        runs = np.zeros(len(data) + 1, kind)
        np.cumsum(begins, out=runs[1:])
        n_spans = (runs[offsets[1:]] - runs[offsets[:-1]]).astype(np.int64)
        del runs, begins
        kept = [data[a:b][~gone[a:b]].tobytes() if r else data[a:b].tobytes() for a, b, r in zip(offsets[:-1].tolist(), offsets[1:].tolist(), removed.tolist(), strict=True)]
        out = {f.name: docs.column(f.name) for f in schema if f.name in docs.column_names}
        out |= {"n_bytes": pa.array(np.diff(offsets)), "n_removed": pa.array(removed), "n_spans": pa.array(n_spans), "kept_bytes": pa.array(kept, pa.binary())}
        return pa.table([out[f.name].cast(f.type) for f in schema], schema=schema)

    return run


def remove_repeated_bytes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", span: int = 400, group_bytes: int = GROUP_BYTES, sort_memory: int = SORT_MEMORY, shard_bytes: int = SHARD_BYTES, heavy: int = HEAVY) -> DataFrame:
    """Remove each byte covered by a string of ``span`` bytes that also starts anywhere else, in any document.

    Texts are taken as UTF-8 bytes; strings don't cross documents, may overlap, and are judged on the input.
    ``span`` is 400 or more. Returns the input's columns with ``n_bytes``, ``n_removed``, ``n_spans`` (maximal
    removed runs) and ``kept_bytes``; input columns of these names give way.

    A null or empty text has no bytes. Null ids and repeated rows are documents like any other, so that
    repeated rows of ``span`` bytes or more lose all of them. An empty table gives an empty result.
    """
    if span < 2 * KEY - PIECE:
        raise ValueError(f"span must be at least {2 * KEY - PIECE}")
    spark = docs.sparkSession
    docs = common.pick(docs, id_col, text_col, ["n_bytes", "n_removed", "n_spans", "kept_bytes"])
    bounds, size = common.id_ranges(docs, id_col, text_col, group_bytes)
    parts = max(common.shuffle_partitions(spark), -(-size // BUCKET_BYTES))
    bits = max(5, (2 * parts - 1).bit_length())
    keys = docs.select(f"`{id_col}`", f"`{text_col}`").mapInArrow(_file_keys(span, bits, bounds), "_mr_bucket long, _mr_range long, _mr_keys binary, _mr_counts binary")
    shared = keys.groupBy("_mr_bucket").applyInArrow(_shared_keys(heavy), "_mr_range long, _mr_keys binary, _mr_heavy binary")
    ranged = docs.withColumn("_mr_range", common.range_column(bounds, id_col))
    contexts = ranged.groupBy("_mr_range").cogroup(shared.groupBy("_mr_range")).applyInArrow(_file_contexts(span, 2 * parts, id_col, text_col), _CONTEXTS)
    spans = common.stored(contexts.groupBy("_mr_bucket").applyInArrow(_sort_bucket(span, sort_memory, shard_bytes, 2 * parts), _FOUND), "repeated-spans")
    longs = [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")]
    schema = T.StructType([*docs.schema.fields, *longs, T.StructField("kept_bytes", T.BinaryType())])
    return ranged.groupBy("_mr_range").cogroup(spans.groupBy("_mr_range")).applyInArrow(_remove(span, id_col, text_col, to_arrow_schema(schema)), schema)
