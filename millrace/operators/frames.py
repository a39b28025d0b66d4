"""Sums over moving frames, which batch and stream share."""

from __future__ import annotations

import numpy as np

#: Rows of a block, blocks of a block of the next level, and so on.
FAN = 16


def round_of(size: int) -> int:
    """Places after which the blocks that a frame of ``size`` rows can hold lie as before."""
    rounds = FAN
    while rounds <= size:
        rounds *= FAN
    return rounds


def _added(sums: np.ndarray, items: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``sums`` with so many items from each start on, added one after the other."""
    for i in range(counts.max(initial=0)):
        more = counts > i
        sums[more] += items[starts[more] + i]
    return sums


def frame_sums(places: np.ndarray, values: np.ndarray, lengths: np.ndarray, first: int = 0) -> np.ndarray:
    """Sums of the frames of ``lengths`` rows that end with each row from ``first`` on.

    ``places`` count a key's rows from 0, or from any multiple of ``round_of`` the longest; another run of rows begins where they leave off. A frame is
    added up from left to right in the largest aligned blocks that it holds, of 16 rows, 16 times 16 and so on, with single rows at its ends. Rounding
    so grows with the logarithm of the length, nothing is subtracted, and a value touches the frames that hold it and no other.
    """
    ends = places[first:] + 1
    begins, at, items, numbers = ends - lengths, np.arange(first, len(values)), values, places
    sums, is_open, rights = np.zeros(len(ends)), np.ones(len(ends), dtype=bool), []
    with np.errstate(all="ignore"):
        while True:
            shift = at - numbers[at]  # from an item's number to its index
            beyond = is_open & (begins // FAN != ends // FAN)
            left = np.where(beyond, -begins % FAN, np.where(is_open, ends - begins, 0))
            sums, right = _added(sums, items, shift + begins, left), np.where(beyond, ends % FAN, 0)
            rights.append((items, shift + ends - right, right))
            is_open = beyond
            if not is_open.any():
                break
            begins, ends = -(-begins // FAN), ends // FAN
            fresh = np.ones(len(items), dtype=bool)
            fresh[1:] = (numbers[1:] // FAN != numbers[:-1] // FAN) | (numbers[1:] != numbers[:-1] + 1)
            starts = np.flatnonzero(fresh)
            at, numbers = (np.cumsum(fresh) - 1)[at], numbers[starts] // FAN
            items = _added(np.zeros(len(starts)), items, starts, np.diff(starts, append=len(items)))
        for items, starts, counts in reversed(rights):
            sums = _added(sums, items, starts, counts)
    return sums


def frame_means(places: np.ndarray, values: np.ndarray, known: np.ndarray, lengths: np.ndarray, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Means of such frames' known values, and which frames have any; unknown values are to be 0."""
    upto, ends = np.concatenate([[0], np.cumsum(known)]), np.arange(first, len(values)) + 1
    counts = upto[ends] - upto[ends - lengths]
    return frame_sums(places, values, lengths, first) / np.maximum(counts, 1), counts > 0
