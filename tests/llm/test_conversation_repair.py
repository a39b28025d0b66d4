"""Conversation repair against a plain search over whole edit strings."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from millrace.llm.conversation_repair import START, code_of, damaged, edits, repair_conversations

COLUMNS = "conv_id long, turn long, role string, text string"
BLANK = "[\x20\x09-\x0d]"


def plain_edits(rows):
    """(cost, audit, repaired) of rows (role, text, fault): every state keeps its best whole string."""
    best = {"": (0, "", [])}  # by last initial

    def put(table, state, cost, audit, made):
        if state not in table or (cost, audit) < table[state][:2]:
            table[state] = (cost, audit, made)

    follow = lambda s: "a" if s == "u" else "u"
    name = {"u": "user", "a": "assistant"}

    def inserted(table):
        out = dict(table)
        for state, (cost, audit, made) in table.items():
            at = state
            for _ in range(3):
                at = follow(at)
                cost, audit, made = cost + 3, audit + "I", [*made, (name[at], "")]
                put(out, at, cost, audit, made)
        return out

    for role, text, fault in rows:
        after = {}
        ways = [(s, *v) for s, v in best.items()]
        for s, cost, audit, made in ways:
            at, k = s, 0
            while k < 4:
                put(after, at, cost + 4, audit + "D", made)
                if fault not in ("blank", "duplicate"):
                    extra = 3 if fault == "truncated" else 0
                    if role[:1] == follow(at) or (at == "" and role[:1] == "s"):
                        put(after, role[:1], cost + extra, audit + "K", [*made, (role, text)])
                    put(after, follow(at), cost + 3 + extra, audit + "R", [*made, (name[follow(at)], text)])
                at, k = follow(at), k + 1
                cost, audit, made = cost + 3, audit + "I", [*made, (name[at], "")]
        best = after
    ends = inserted(best)
    return min((ends[s] for s in ("", "a") if s in ends), key=lambda x: x[:2])


def brute(rows, damage):
    shown = lambda v: " " if v is None else str(v)
    convs = {}
    for conv, turn, role, text in rows:
        out = convs.setdefault(conv, [])
        hit = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20 if damage else 9
        was, now = shown(role), shown(text)
        text = "" if hit == 1 else re.sub("[.!?]", "", now) if hit == 2 else now
        if hit:
            out += [(turn is not None, turn or 0, was, text, turn, "user" if hit == 4 else was)] * (2 if hit == 3 else 1)
    result = []
    for conv, out in convs.items():
        out.sort(key=lambda r: r[:4])
        seen, lines, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for *_, text, _, role in [(r[2], r[3], r[4], r[5]) for r in out]:
            bare = re.sub(f"{BLANK}+", "", text)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            lines.append((role, text, fault))
            if fault:
                counts[fault] += 1
        turns = {r[4] for r in out if r[4] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(lines, lines[1:]))
        cost, audit, made = plain_edits(lines)
        result.append((conv, gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()))
    return sorted(result, key=str)


def some_rows(seed, n):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "u", "server"]
    texts = ["Yes.", "No!", "", None, " \t", "cut", "Why?  \n", "é. ", "A.", "B.", "C.", "D", "\x0b"]
    return [(rng.choice([1, 2, 3, 4, None]), rng.choice([None, *range(30)]), rng.choice(roles[: rng.choice([3, 10])]), rng.choice(texts) if rng.random() < 0.5 else f"t{i}{rng.choice('.!x')}") for i in range(n)]


def rows_of(df):
    return sorted((tuple(r)[:9] for r in df.collect()), key=str)


def test_edits_equal_a_plain_search():
    rng = random.Random(4)
    for n in [*range(8)] * 40 + [50, 101]:
        rows = [(rng.choice(["system", "user", "assistant", "tool"]), "x", rng.choice(["", "", "", "truncated", "blank"])) for _ in range(n)]
        codes = bytes(code_of(r[:1], f) for r, _, f in rows)
        audit, cost, end = edits(codes)
        closing = {0: "", 1: "II", 2: "I", 3: ""}[end]
        assert (cost + 3 * len(closing), audit + closing) == plain_edits(rows)[:2], rows
    assert edits(b"") == ("", 0, START)


@pytest.mark.parametrize("seed,n,block_rows", [(1, 40, 1 << 14), (2, 300, 1 << 14), (3, 300, 3), (4, 160, 1), (5, 500, 17)])
def test_tables_equal_a_plain_search(spark, seed, n, block_rows):
    rows = some_rows(seed, n)
    df = spark.createDataFrame(rows, COLUMNS).repartition(4)
    for name in ("n", "block", "code", "fault", "audit", "cost", "_c", "_hit"):
        df = df.withColumn(name, F.lit("clash"))
    for damage in (damaged, None):
        assert rows_of(repair_conversations(df, damage=damage, block_rows=block_rows)) == brute(rows, damage)


def test_hot_conversation_over_ordered_blocks(spark, monkeypatch):
    """Numbering splits a hot conversation as well."""
    from millrace.operators import ordered

    monkeypatch.setattr(ordered, "BLOCK_ROWS", 50)
    rows = [(None, i // 2, "user" if i % 3 else "assistant", f"{i}.") for i in range(400)] + some_rows(8, 60)
    df = spark.createDataFrame(rows, COLUMNS).repartition(4)
    assert rows_of(repair_conversations(df, damage=damaged, block_rows=32)) == brute(rows, damaged)


def test_gone_and_empty_conversations(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "Hi."), (-5, None, None, None)]
    df = spark.createDataFrame(rows, COLUMNS)
    got = {r.conv_id: r for r in repair_conversations(df, damage=damaged, with_text=True).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert tuple(got[gone])[:9] == (gone, 0, 0, 0, 0, 0, 0, "", empty) and got[gone].repaired == []
    assert rows_of(repair_conversations(df, damage=damaged)) == brute(rows, damaged)
    assert repair_conversations(df.limit(0), damage=damaged).count() == 0
    (same,) = repair_conversations(spark.createDataFrame([(7, 1, "assistant", "Yes."), (7, 2, "user", "Why?")], COLUMNS), with_text=True).collect()
    assert [tuple(t) for t in same.repaired] == [("user", ""), ("assistant", "Yes."), ("user", "Why?"), ("assistant", "")] and same.audit == "IKKI" and same.cost == 6


def test_long_texts_and_repeated_rows(spark):
    rows = [(1, 0, "user", "x" * 3_000_000 + "."), (1, 1, "assistant", "y." * 500_000), (2, 0, "user", "Hi."), (2, 0, "user", "Hi."), (2, 0, "user", "Hi.")]
    df = spark.createDataFrame(rows, COLUMNS)
    assert rows_of(repair_conversations(df)) == brute(rows, None)
