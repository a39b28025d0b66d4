"""External induced suffix sorting with common-prefix values.

Suffixes are sorted by induction from their leftmost smaller ones (S* suffixes), whose order
comes from the same procedure on a shorter string of names. A scan takes tuples (position,
successor's place, common prefix) off a queue in order and pushes the tuples of their predecessors.
The queue is laid out by symbol: each symbol owns a region, filled from the left, so that taking the
longest filled prefix takes the smallest tuples, thousands at a time, with array operations. A common
prefix is one more than the least value between two successors.

All arrays of a level come from an ``Arena``, which keeps them in files beyond its memory: the queue
of a shard far larger than memory lies on disk, and both scans go through it in order.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np

_FINE = 64


class Arena:
    """Arrays in memory up to a limit, beyond it in files of a task's own folder, gone with the arena."""

    def __init__(self, memory: int):
        self.left, self.folder, self.count, self.files = memory, None, 0, []

    def __enter__(self) -> Arena:
        return self

    def __exit__(self, *_: object) -> None:
        if self.folder:
            self.folder.cleanup()

    @contextmanager
    def lent(self) -> Iterator[Arena]:
        """What is taken meanwhile is given back at the end: memory for the next arrays, and files."""
        left, kept = self.left, len(self.files)
        yield self
        self.left = left
        for path in self.files[kept:]:
            path.unlink()
        del self.files[kept:]

    def empty(self, n: int, kind) -> np.ndarray:
        size = n * np.dtype(kind).itemsize
        if size <= self.left or n == 0:
            self.left -= size
            return np.empty(n, kind)
        self.folder = self.folder or tempfile.TemporaryDirectory(prefix="induced-")
        self.count += 1
        self.files.append(Path(self.folder.name) / str(self.count))
        return np.memmap(self.files[-1], kind, "w+", shape=(n,))

    def zeros(self, n: int, kind) -> np.ndarray:
        out = self.empty(n, kind)
        out[:] = 0
        return out

    def keep(self, values: np.ndarray) -> np.ndarray:
        """A copy that counts."""
        out = self.empty(len(values), values.dtype)
        out[:] = values
        return out


def _whole(n: int) -> type:
    """The type of places in a text of ``n`` symbols."""
    return np.int32 if n < 1 << 31 else np.int64


class RunningMin:
    """Least values of ranges of a growing sequence: short ranges by overlapping powers of two, long ones by blocks."""

    def __init__(self, n: int, arena: Arena):
        self.fine = [arena.empty(n, np.uint16) for _ in range(7)]
        blocks = n // _FINE + 1
        self.coarse = [arena.empty(blocks, np.uint16) for _ in range(blocks.bit_length())]
        self.n = self.blocks = 0

    @staticmethod
    def _extend(levels: list[np.ndarray], lo: int, hi: int) -> None:
        for k in range(1, len(levels)):
            half, up, down = 1 << (k - 1), levels[k], levels[k - 1]
            up[lo:hi] = down[lo:hi]
            if hi > half:
                a = max(lo, half)
                np.minimum(up[a:hi], down[a - half : hi - half], out=up[a:hi])

    def append(self, values: np.ndarray) -> None:
        lo, hi = self.n, self.n + len(values)
        self.fine[0][lo:hi] = values
        self._extend(self.fine, lo, hi)
        self.n = hi
        if (blocks := hi // _FINE) > self.blocks:
            self.coarse[0][self.blocks : blocks] = self.fine[6][_FINE * self.blocks + _FINE - 1 : _FINE * blocks : _FINE]
            self._extend(self.coarse, self.blocks, blocks)
            self.blocks = blocks

    @staticmethod
    def _overlap(levels: list[np.ndarray], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        power = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
        out = np.empty(len(lo), np.uint16)
        for k in np.flatnonzero(np.bincount(power)):
            at = np.flatnonzero(power == k)
            out[at] = np.minimum(levels[k][hi[at]], levels[k][lo[at] + (1 << int(k)) - 1])
        return out

    def query(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Least value of each range, both ends included."""
        out = np.empty(len(lo), np.uint16)
        long = hi - lo >= _FINE
        if len(short := np.flatnonzero(~long)):
            out[short] = self._overlap(self.fine, lo[short], hi[short])
        if len(far := np.flatnonzero(long)):
            a, b = lo[far], hi[far]
            v = np.minimum(self.fine[6][b], self.fine[6][a + _FINE - 1])
            first, last = (a + _FINE - 1) // _FINE, (b + 1) // _FINE - 1
            if len(mid := np.flatnonzero(first <= last)):
                v[mid] = np.minimum(v[mid], self._overlap(self.coarse, first[mid], last[mid]))
            out[far] = v
        return out


def _scan(key: np.ndarray, pushed: np.ndarray, run: np.ndarray, fixed: np.ndarray, fixed_lcp: np.ndarray, cap: int, arena: Arena) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One induction scan in ascending order of ``key``.

    ``pushed`` marks the positions that their successors push; within a symbol they precede the ``fixed`` ones,
    which come sorted, each with its common prefix with the one before it. Returns positions in order, the common
    prefix of each with the one before, and which are fixed.
    """
    size = int(key.max()) + 1
    count, fixed_count = np.bincount(key[pushed], minlength=size), np.bincount(key[fixed], minlength=size)
    begin = np.cumsum(count + fixed_count) - count - fixed_count
    total = int(count.sum()) + len(fixed)
    place, after = arena.empty(total, _whole(total)), arena.empty(total, _whole(total))
    ready, is_fixed, known = arena.zeros(total, bool), arena.zeros(total, bool), arena.zeros(total, np.uint16)
    symbol = key[fixed]
    slot = begin[symbol] + count[symbol] + np.arange(len(fixed)) - (np.cumsum(fixed_count) - fixed_count)[symbol]
    place[slot], ready[slot], is_fixed[slot], known[slot] = fixed, True, True, fixed_lcp
    least, at, step = RunningMin(total, arena), 0, 1024
    while at < total:
        end, width = at, step
        while end < total:  # the longest filled prefix
            piece = ready[end : end + width]
            gap = int(piece.argmin())
            if not piece[gap]:
                end += gap
                break
            end += len(piece)
            width *= 2
        step = max(64, end - at)
        p = place[at:end]
        k = key[p]
        before = np.concatenate([place[at - 1 : at] if at else p[:1], p[:-1]])
        f = is_fixed[at:end]
        g = np.concatenate([is_fixed[at - 1 : at] if at else f[:1], f[:-1]])
        same = k == key[before]
        if at == 0:
            same[0] = False
        lcp = np.zeros(end - at, np.uint16)
        if len(x := np.flatnonzero(same & ~f)):
            lcp[x] = np.minimum(least.query(after[at + x - 1].astype(np.int64) + 1, after[at + x].astype(np.int64)), cap - 1) + 1
        if len(x := np.flatnonzero(same & f)):
            # between the two kinds the run of the first symbol decides
            lcp[x] = np.minimum(np.where(g[x], known[at + x], np.minimum(run[p[x]], run[before[x]])), cap)
        least.append(lcp)
        own = np.flatnonzero((p > 0) & pushed[p - 1])
        if len(own):
            q = p[own] - 1
            kq = key[q]
            order = np.argsort(kq, kind="stable")
            kq = kq[order]
            first = np.flatnonzero(np.concatenate([[True], kq[1:] != kq[:-1]]))
            n = np.diff(np.append(first, len(kq)))
            dest = np.repeat(begin[kq[first]] - first, n) + np.arange(len(kq))
            place[dest], after[dest], ready[dest] = q[order], at + own[order], True
            begin[kq[first]] += n
        at = end
    return place, least.fine[0][:total], is_fixed


def _names(text: np.ndarray, star: np.ndarray, length: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Dense order of the S* substrings, and the common prefix of each name with the one below, symbols of different kinds counted as different."""
    bits = int(text.max() + 2).bit_length()
    per, pad, m, n = 62 // bits, int(text.max()) + 2, len(star), len(text)
    rank, edge, todo, off = np.zeros(m, np.int64), np.zeros(m, np.int64), np.arange(m), 0
    while len(todo):
        key = np.zeros(len(todo), np.int64)
        for j in range(off, off + per):
            key = (key << bits) | np.where(j < length[todo], text[np.minimum(star[todo] + j, n - 1)].astype(np.int64) + 1, pad)
        order = np.lexsort((key, rank[todo]))
        a, key = todo[order], key[order]
        r, here = rank[a], np.arange(len(a))
        other = np.concatenate([[True], r[1:] != r[:-1]])
        slot = r + here - np.maximum.accumulate(np.where(other, here, 0))
        split = np.concatenate([[False], key[1:] != key[:-1]]) & ~other
        t = np.flatnonzero(split)
        equal = np.zeros(len(t), np.int64)
        for j in range(per, 0, -1):
            equal = np.where(key[t] >> (bits * j - bits) == key[t - 1] >> (bits * j - bits), per - j + 1, equal)
        lcp, short = off + equal, np.minimum(length[a[t]], length[a[t - 1]])
        # where one ends and the other goes on, the last common symbol is of two kinds
        edge[slot[t]] = np.minimum(np.minimum(lcp, short - 1), cap)
        new = other | split
        rank[a] = slot[np.maximum.accumulate(np.where(new, here, 0))]
        size = np.diff(np.append(np.flatnonzero(new), len(a)))
        todo = a[(np.repeat(size, size) > 1) & (length[a] >= off + per)]
        off += per
    distinct, names = np.unique(rank, return_inverse=True)
    return names.astype(_whole(m)), edge[distinct].astype(np.uint16)


def sort_suffixes(text: np.ndarray, cap: int, arena: Arena) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``text`` in order, and the common prefix of each with the one before, up to ``cap`` (below 65,536).

    ``text`` holds whole numbers and ends with its only 0. Each scan's arrays are given back before the next one's are taken.
    """
    n = len(text)
    if n == 1:
        return np.zeros(1, _whole(n)), np.zeros(1, np.uint16)
    here = np.arange(n - 1, dtype=_whole(n))
    turn = np.minimum.accumulate(np.where(text[1:] != text[:-1], here, here.dtype.type(n - 1))[::-1])[::-1]
    small = np.append(text[turn + 1] > text[turn], True)
    run = arena.keep(np.append(np.minimum(turn - here + 1, cap), 1).astype(np.uint16))
    del here, turn
    star = np.flatnonzero(small[1:] & ~small[:-1]).astype(_whole(n)) + 1
    length = np.append(np.diff(star) + 1, 1)
    names, edge = _names(text, star, length, cap)
    with arena.lent():
        if int(names.max()) + 1 < len(star):
            order, matched = sort_suffixes(names, cap, arena)
        else:
            order, matched = np.argsort(names), np.zeros(len(star), np.uint16)
        star_lcp = np.zeros(len(star), np.uint16)
        if len(star) > 1:
            star_lcp[1:] = cap
            t = np.flatnonzero(matched[1:] < cap) + 1
            i, j, m = order[t - 1], order[t], matched[t].astype(np.int64)
            table = RunningMin(len(edge), arena)
            table.append(edge)
            lcp = star[i + m] - star[i] + table.query(names[i + m].astype(np.int64) + 1, names[j + m].astype(np.int64))
            x, y = star[i] + lcp, star[j] + lcp
            star_lcp[t] = np.minimum(lcp + np.where(text[x] == text[y], np.minimum(run[x], run[y]), 0), cap)
            del table, i, j, m, x, y, lcp
        fixed = star[order]
        del order, matched, names, edge, star, length
    with arena.lent():
        seq, lcp, is_fixed = _scan(text, ~small, run, fixed, star_lcp, cap, arena)
        large, large_lcp = seq[~is_fixed], lcp[~is_fixed]
        del seq, lcp, is_fixed
    down = np.zeros(len(large), np.uint16)
    if len(large):
        down[1:] = large_lcp[1:][::-1]
    last = small.copy()
    last[-1] = False
    with arena.lent():
        seq, lcp, _ = _scan(int(text.max()) - text, last, run, large[::-1], down, cap, arena)
        return np.concatenate([np.array([n - 1], seq.dtype), seq[::-1]]), np.concatenate([[0, 0], lcp[1:][::-1]]).astype(np.uint16)
