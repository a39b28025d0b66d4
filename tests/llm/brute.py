"""Plain versions of the operators, for small tables."""

import hashlib
import math
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def repeated_bytes(rows, span=400):
    """rows: (id, text); a list of (n_bytes, n_removed, n_spans, kept)."""
    raws = [(t or "").encode() for _, t in rows]
    seen = Counter(r[i : i + span] for r in raws for i in range(len(r) - span + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - span + 1):
            if seen[r[i : i + span]] > 1:
                gone[i : i + span] = b"\x01" * span
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(r), sum(gone), spans, bytes(b for b, g in zip(r, gone) if not g)))
    return out


def repeated_words(rows, size=13):
    """(n_words, n_removed, kept) of each row; null ids are larger than all."""
    key = lambda i: (i is None, i or 0)
    words = [WORD.findall(t or "") for _, t in rows]
    first: dict = {}
    for (i, _), w in zip(rows, words):
        for j in range(len(w) - size + 1):
            k = tuple(w[j : j + size])
            first[k] = min(first.get(k, key(i)), key(i))
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for j in range(len(w) - size + 1):
            if first[tuple(w[j : j + size])] < key(i):
                gone |= set(range(j, j + size))
        out.append((len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def near_duplicates(rows):
    """id to (n_shingles, component)."""
    sets = {}
    for i, t in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def stats(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = WORD.findall(text)
    c = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
    inside = {k for j in range(len(w) - 4) if c[tuple(w[j : j + 5])] > 1 for k in range(j, j + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in text), dup, len(inside)


def ratios(text):
    """The shares that rules and classifier read, by name."""
    text = text or ""
    n, chars, symbols, dup, repeat = stats(text)
    w = WORD.findall(text)
    lines = sum(bool(WORD.search(x)) for x in text.split("\n"))
    nw, nc, nl = max(n, 1), max(chars, 1), max(lines, 1)
    of = lambda kinds: sum(ch in kinds for ch in text)
    return {
        "log_words": math.log1p(n), "mean_word_chars": chars / nw, "long_word_share": sum(len(x.encode()) > 14 for x in w) / nw, "symbol_rate": symbols / nw,
        "upper_share": sum("A" <= ch <= "Z" for ch in text) / nc, "digit_share": sum("0" <= ch <= "9" for ch in text) / nc, "stop_rate": of(".?;:,") / nw, "bang_rate": of("!") / nw, "bar_rate": of("|") / nw,
        "bracket_rate": of("<>{}[]()=") / nw, "wide_share": sum(ch > "\x7f" for ch in text) / nc, "dup_line_share": dup / nl, "words_per_line": n / nl, "repeat_share": repeat / nw,
        "distinct_share": len(set(w)) / nw, "top_word_share": max(Counter(w).values(), default=0) / nw, "same_as_last_share": sum(a == b for a, b in zip(w, w[1:])) / nw, "url_rate": of("/@") / nw,
    }


def forest_score(forest, row):
    """One row through every tree, node by node."""
    margin = forest.base
    for feature, threshold, value in zip(forest.feature.tolist(), forest.threshold.tolist(), forest.value.tolist()):
        node = 0
        while node < len(feature):
            node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
        margin += value[node - len(feature)]
    return 1 / (1 + math.exp(-margin))


def list_keeps(rules, row):
    """Whether no rule of a decision list rejects a row."""
    return not any(all(row[c] >= v if up else row[c] <= v for c, up, v in rule) for rule in rules)


def poisson_copies(rows, temper=0.7, seed=17):
    """rows: (id, text, source); copies of each row by inverting its source's Poisson distribution at its own point."""
    size = Counter()
    for _, t, s in rows:
        size[s or ""] += max(len(t or ""), 1)
    weight = {s: n**temper for s, n in size.items()}
    total = sum(size.values()) / sum(weight.values())
    out = []
    for i, _, s in rows:
        rate = weight[s or ""] * total / size[s or ""]
        point = int(hashlib.md5(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:13], 16) / 2**52
        n, p = 0, math.exp(-rate)
        upto = p
        while upto <= point:
            n += 1
            p *= rate / n
            upto += p
        out.append(n)
    return out


def decode_adpcm(block):
    """One IMA ADPCM block, sample by sample."""
    from millrace.llm.media import adpcm_steps

    steps = adpcm_steps().tolist()
    sample = int.from_bytes(block[:2], "little", signed=True)
    index, out = min(block[2], 88), [sample]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = steps[index]
            diff = step >> 3
            for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
                diff += part if code & bit else 0
            sample = max(-32768, min(32767, sample - diff if code & 8 else sample + diff))
            index = max(0, min(88, index + (-1, -1, -1, -1, 2, 4, 6, 8)[code & 7]))
            out.append(sample)
    return out
