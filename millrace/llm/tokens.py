"""Token ids of whole texts by a tokenizer file, with a cache of encoded words.

The vocabulary file composes characters, lower-cases and splits on blanks before anything joins characters, so
that the ids of a text are the ids of its blank-separated words, end to end. Each worker
encodes a word once by the tokenizers library and looks it up afterwards. Words are looked up with ASCII letters in
lower case, but for a letter ahead of another kind of character: that may be a mark which composes with the capital otherwise.
"""

from __future__ import annotations

import os
import re

import numpy as np

from . import common

#: Words a worker keeps and bytes of them and their ids; beyond either the cache starts anew. Longer words than LONGEST aren't kept.
CACHE_WORDS, CACHE_BYTES, LONGEST = 1_000_000, 32 << 20, 256
#: Stops at a word's end never join an ASCII letter or digit before them: such a word is its two parts, end to end.
_STOPS, _LETTERS = b".,;:!?", frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz")
#: A capital that what follows may compose with.
_CAPITAL = re.compile(rb"[A-Z](?=[\x80-\xff])")


def lowered(raw: bytes) -> bytes:
    """ASCII capitals in lower case, but for those that a mark may follow."""
    low = raw.lower()
    if raw.isascii() or not (capitals := [m.start() for m in _CAPITAL.finditer(raw)]):
        return low
    out = bytearray(low)
    for i in capitals:
        out[i] = raw[i]
    return bytes(out)


class WordEncoder:
    """Encodes UTF-8 texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.held = 0
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def encode(self, raws: list[bytes]) -> list[bytes]:
        """Ids of each text; about a megabyte of texts at once is best."""
        # special tokens are matched as they stand, so that texts that may hold one keep their case
        rows = [(r if b"<|" in r else lowered(r)).split() for r in raws]
        if len(self.known) > CACHE_WORDS or self.held > CACHE_BYTES:
            self.known, self.held = {}, 0
        new = self._learn([w for w in set().union(*rows) if w not in self.known])
        get = self.known.__getitem__
        out = [b"".join(map(get, r)) for r in rows]
        for w in new:
            if len(w) > LONGEST:
                del self.known[w]
            else:
                self.held += len(w) + len(self.known[w])
        return out

    def _learn(self, new: list[bytes]) -> set[bytes]:
        """Encode words: those of letters only as one text, cut again at the ids that end a word; the others one by one. Returns what is known since."""
        known, joined, todo = self.known, [], set()
        for w in new:
            base = w.rstrip(_STOPS)
            if len(base) < len(w) and base and base[-1] in _LETTERS:
                stops = w[len(base) :]
                joined.append((w, base, stops))
                todo.update(x for x in (base, stops) if x not in known)
            else:
                todo.add(w)
        self._encode(todo)
        known.update((w, known[a] + known[b]) for w, a, b in joined)
        return todo.union(w for w, _, _ in joined)

    def _encode(self, new: set[bytes]) -> None:
        words, others = [], []
        for w in new:
            (words if (w.isalpha() if w.isascii() else w.decode().isalpha()) else others).append(w)
        for lo in range(0, len(words), 4000):
            some = words[lo : lo + 4000]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, "<u4")
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) != len(some):  # a letter that normalises to a letter and a mark
                others += some
                continue
            raw, begin = ids.tobytes(), [0, *(4 * cut).tolist()]
            self.known.update(zip(some, map(raw.__getitem__, map(slice, begin, begin[1:])), strict=False))
        for w, e in zip(others, self.tokenizer.encode_batch_fast([w.decode() for w in others], add_special_tokens=False), strict=True):
            self.known[w] = np.array(e.ids, "<u4").tobytes()


_encoders: dict[str, WordEncoder] = {}
common._caches.append(_encoders)


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a vocabulary file, loaded once."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core already
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
