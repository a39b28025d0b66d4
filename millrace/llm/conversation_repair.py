"""Conversation structure repair: cheapest edits to well-formed turns, found by Hirschberg's division in linear space.

What a conversation may look like is an automaton of four states: nothing yet, after the system turn, after a user turn, after an
assistant turn. Between two rows of a conversation only the state counts, so that the rows up to the middle give four costs forward from one
end, the rest four costs backward from the other, and the cheapest crossing splits the work in two. Of equally cheap
crossings the one whose edits so far sort first is taken: beside its cost each state carries its rank by them, not the edits.

Long conversations are cut into blocks of rows. A block is a table of costs from state to state; a conversation's tables are crossed
in the same way, and each block then works between two known states, wherever it lies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.ordered import numbered
from .common import stored

#: Rows of a block: what a worker holds of a conversation while it looks for edits, a byte each.
BLOCK_ROWS = 1 << 14
#: Costs of the edits: a row dropped, a row's role changed, an empty turn put in, and a truncated row that stays.
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
_NO = 1 << 60
#: The turn that may follow each state, other than the system turn at the start; which roles' initials lead on.
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
INITIALS = "sua"


def code_of(initial: str, fault: str) -> int:
    """A row as the automaton sees it: initial of its role (s, u, a or another) and fault (blank and duplicate rows must go)."""
    return 4 * {"blank": 2, "duplicate": 2, "truncated": 1}.get(fault, 0) + (INITIALS.find(initial) if initial and initial in INITIALS else 3)


def _moves(code: int) -> list[list[tuple[int, str]]]:
    """[state before][state after] of a row: least cost, and the least edits in ASCII order that cost it (inserts come before the row's own edit)."""
    initial, fault = code % 4, code // 4
    table = [[(_NO, "") for _ in STATES] for _ in STATES]
    for before in STATES:
        at = before
        for inserts in range(4):
            ways = [(at, DELETE, "D")]
            if fault < 2:
                extra = TRUNCATED if fault == 1 else 0
                if initial < 3 and (_NEXT[at] == initial + 1 or (at == START and initial == 0)):
                    ways.append((initial + 1, extra, "K"))
                ways.append((_NEXT[at], REROLE + extra, "R"))
            for after, cost, letter in ways:
                table[before][after] = min(table[before][after], (cost + inserts * INSERT, "I" * inserts + letter))
            at = _NEXT[at]
    return table


MOVES = [_moves(code) for code in range(12)]


def _closing(state: int) -> int:
    """Inserts after the last row until the conversation may end."""
    return {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}[state]


# Vectors hold (cost, rank) for each state; ranks order the least edits of equally cheap ways to different states, which
# never are the same nor one the other's beginning: all end with an edit of the same row.


def _ranked(found: list[tuple]) -> list[tuple[int, int]]:
    order = sorted({f[1:] for f in found if f[0] < _NO})
    return [(f[0], order.index(f[1:])) if f[0] < _NO else (_NO, 0) for f in found]


def _step(vector: list[tuple[int, int]], table: list[list[tuple]]) -> list[tuple[int, int]]:
    """One row, or one block, further. A table's entries are (cost, what orders them from one state)."""
    return _ranked([min((vector[p][0] + table[p][q][0], vector[p][1], table[p][q][1]) if vector[p][0] < _NO and table[p][q][0] < _NO else (_NO,) for p in STATES) for q in STATES])


def _forward(items, state: int, table_of: Callable, lo: int, hi: int) -> list[tuple[int, int]]:
    vector = [(0, 0) if p == state else (_NO, 0) for p in STATES]
    for i in range(lo, hi):
        vector = _step(vector, table_of(items[i]))
    return vector


def _backward(items, state: int, table_of: Callable, lo: int, hi: int) -> list[int]:
    costs = [0 if p == state else _NO for p in STATES]
    for i in range(hi - 1, lo - 1, -1):
        table = table_of(items[i])
        costs = [min(min(table[p][q][0] + costs[q] for q in STATES), _NO) for p in STATES]
    return costs


def crossings(items, begin: int, end: int, table_of: Callable) -> Iterator[tuple[int, int]]:
    """(state before, state after) of each row or block on the cheapest way from ``begin`` to ``end``, ties to the least edits.

    Linear space: besides the items, four costs each way and a stack as deep as the logarithm of their number.
    """
    stack = [(0, len(items), begin, end)]
    while stack:
        lo, hi, p, q = stack.pop()
        if hi - lo == 0:
            continue
        if hi - lo == 1:
            yield p, q
            continue
        mid = (lo + hi) // 2
        ahead, back = _forward(items, p, table_of, lo, mid), _backward(items, q, table_of, mid, hi)
        meet = min((ahead[s][0] + back[s], ahead[s][1], s) for s in STATES if ahead[s][0] < _NO)[2]
        stack += [(mid, hi, meet, q), (lo, mid, p, meet)]


def last_state(vector: list[tuple[int, int]]) -> int:
    """The state that the whole conversation best ends in, inserts behind the last row included."""
    return min((vector[s][0] + INSERT * _closing(s), vector[s][1], s) for s in STATES if vector[s][0] < _NO)[2]


def edits(codes: bytes, begin: int = START, end: int | None = None) -> tuple[str, int, int]:
    """Audit of a run of rows between two states, its cost and its last state; without ``end`` the conversation ends there (its closing inserts aren't in the audit)."""
    if end is None:
        end = last_state(_forward(codes, begin, MOVES.__getitem__, 0, len(codes)))
    cost, words = 0, []
    for code, (p, q) in zip(codes, crossings(codes, begin, end, MOVES.__getitem__), strict=True):
        words.append(MOVES[code][p][q][1])
        cost += MOVES[code][p][q][0]
    return "".join(words), cost, end


def block_table(codes: bytes) -> list[list[tuple[int, int]]]:
    """A block as a table: cost from state to state, and the rank of its edits among those that begin in the same state."""
    return [_forward(codes, p, MOVES.__getitem__, 0, len(codes)) for p in STATES]


# --------------------------------------------------------------------------- damage and faults


def _shown(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with ``_hit`` by crc32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties it, 2 takes its ``.!?``, 3 repeats it, 4 makes it a user's. Nulls are one space."""
    hit = F.pmod(F.crc32(F.concat(_shown("conv_id"), F.lit(":"), _shown("turn")).cast("binary")), F.lit(20))
    texts = rows.select("conv_id", "turn", _shown("role").alias("_role"), _shown("text").alias("_text"), hit.alias("_hit"))
    text = F.when(F.col("_hit") == 1, "").when(F.col("_hit") == 2, F.regexp_replace("_text", "[.!?]", "")).otherwise(F.col("_text"))
    copies = F.explode(F.when(F.col("_hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")
    return texts.where("_hit <> 0").select("conv_id", "turn", F.col("_role").alias("_was"), copies, F.when(F.col("_hit") == 4, "user").otherwise(F.col("_role")).alias("role"), text.alias("text"))


def faults(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, ``n`` within it, role, text) with ``fault``: blank, duplicate of an earlier row's role and text, truncated, or none.

    The first of equal rows is found by an aggregate over a digest of 256 bits, and only digests met twice are joined back.
    """
    seen = rows.withColumn("_seen", F.unhex(F.sha2(F.concat_ws(":", F.length("role"), "role", "text").cast("binary"), 256)))
    firsts = seen.groupBy(F.col("conv_id").alias("_c"), F.col("_seen").alias("_s")).agg(F.min("n").alias("_first"), F.count("*").alias("_times")).where("_times > 1").select("_c", "_s", "_first")
    met = seen.join(firsts, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_seen") == F.col("_s")), "left")
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "blank").when(F.col("n") > F.col("_first"), "duplicate").when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated").otherwise("")
    return met.withColumn("fault", fault).select(rows.columns + ["fault"])


# --------------------------------------------------------------------------- over tables


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list]]:
    """Consecutive rows with equal first columns, across batches."""
    now, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[:keys] != now:
                yield now, held
                held = []
            now = row[:keys]
            held.append(row[keys:])
    if held:
        yield now, held


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


def _in_batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 4096) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _mapped(df: DataFrame, by: list[str], order: list[str], run: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]], schema: T.StructType) -> DataFrame:
    """Rows of a key in order through ``run`` as they stream by, never a key's rows at once."""
    arrow = to_arrow_schema(schema)
    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(lambda batches: _in_batches(run(batches), arrow), schema)


def audits(rows: DataFrame, *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """conv_id, block, audit, cost: the cheapest edits of each block of ``block_rows`` rows, from columns conv_id, n and code.

    Blocks of conversations of several go twice: as tables, which meet by conversation, and between the states found there.
    """
    kind = rows.schema["conv_id"].dataType
    blocks = rows.select("conv_id", F.floor((F.col("n") - 1) / block_rows).alias("block"), "n", F.col("code").cast("int").alias("code"))
    long_ones = blocks.where("block > 0").select(F.col("conv_id").alias("_c")).distinct()
    of_long = blocks.join(long_ones, F.col("conv_id").eqNullSafe(F.col("_c")), "left_semi")
    field = lambda name, t: T.StructField(name, t)
    many = T.ArrayType(T.LongType())

    def tables(batches):
        for (conv, block), run in _runs(batches, 2):
            table = block_table(bytes(code for _, code in run))
            yield conv, block, [c for line in table for c, _ in line], [r for line in table for _, r in line]

    def ends(batches):
        for (conv,), run in _runs(batches, 1):
            items = [[[(costs[4 * p + q], ranks[4 * p + q]) for q in STATES] for p in STATES] for _, costs, ranks in run]
            end = last_state(_forward(items, START, lambda x: x, 0, len(items)))
            for (block, _, _), (p, q) in zip(run, crossings(items, START, end, lambda x: x), strict=True):
                yield conv, block, p, q

    def within(batches):
        for (conv, block), run in _runs(batches, 2):
            _, _, begin, end = run[0]
            codes = bytes(code for _, code, _, _ in run)
            audit, cost, _ = edits(codes, START if begin is None else begin, end)
            yield conv, block, audit, cost

    whole = _mapped(of_long, ["conv_id", "block"], ["n"], tables, T.StructType([field("conv_id", kind), field("block", T.LongType()), field("costs", many), field("ranks", many)]))
    # an empty list of tables costs one small job
    states = stored(_mapped(whole, ["conv_id"], ["block"], ends, T.StructType([field("_c", kind), field("_b", T.LongType()), field("begin", T.IntegerType()), field("end", T.IntegerType())])), "block-ends")
    placed = blocks.join(states, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b")), "left").select("conv_id", "block", "n", "code", "begin", "end")
    return _mapped(placed, ["conv_id", "block"], ["n"], within, T.StructType([field("conv_id", kind), field("block", T.LongType()), field("audit", T.StringType()), field("cost", T.LongType())]))


def _turns(role: str, text: str, word: str, state: int) -> Iterator[tuple[str, str, int]]:
    """Turns that a row's edits make, and the state after each."""
    for letter in word:
        if letter == "I" or letter == "R":
            state = _NEXT[state]
            yield ROLE_OF[state], "" if letter == "I" else text, state
        elif letter == "K":
            state = INITIALS.index(role[0]) + 1
            yield role, text, state


def repair_conversations(conversations: DataFrame, *, damage: Callable[[DataFrame], DataFrame] | None = None, block_rows: int = BLOCK_ROWS, with_text: bool = False) -> DataFrame:
    """One row per conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 (and with ``with_text`` ``repaired``, the repaired turns).

    Rows go by turn (nulls first), ties by role, then text. A row's first fault counts: blank (no character but blanks), duplicate (role and
    text seen earlier in its conversation), truncated (its last character that isn't blank is none of ``.!?``). Initials of roles are to read
    as (s?(ua)+)?: rows are kept, given the other role (3), deleted (4; blank and duplicate rows must be) or empty user and assistant turns
    put in (3); a truncated row that stays costs 3 more. The audit has the cheapest edits' initials in order, of several the least in ASCII.
    ``gaps`` are turn numbers missing between the least and the greatest; ``illegal`` are neighbours other than su, ua and au.

    ``damage`` may change rows before (it gets conv_id, turn, role, text). Null roles and texts are one space; a null conv_id is a conversation;
    one whose rows all went has zeros, an empty audit and the hash of nothing; repeated rows are duplicates; an empty table gives no rows;
    other columns aren't read. Rows of a conversation stream through one task at the end, since a digest of its text is a sequence; only its
    audit, which is one value of the result, is held whole.
    """
    given = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    rows = damage(given) if damage else given.select("conv_id", "turn", _shown("role").alias("_was"), F.lit(0).alias("_copy"), _shown("role").alias("role"), _shown("text").alias("text"))
    lines = stored(faults(numbered(rows, ["conv_id"], "turn", ["_was", "text", "_copy"], out="n").select("conv_id", "n", "turn", "role", "text")), "conversation-lines")
    initial = F.substring("role", 1, 1)
    code = F.when(F.col("fault").isin("blank", "duplicate"), 8).when(F.col("fault") == "truncated", 4).otherwise(0) + F.coalesce(F.element_at(F.create_map(*chain(*[(F.lit(c), F.lit(i)) for i, c in enumerate(INITIALS)])), initial), F.lit(3))
    found = audits(lines.select("conv_id", "n", code.alias("code")), block_rows=block_rows)
    # one stream: a conversation's header, and each block's audit ahead of its rows
    nothing = lambda t: F.lit(None).cast(t)
    heads = given.select("conv_id").distinct().select("conv_id", F.lit(-1).cast("long").alias("block"), nothing("long").alias("n"), nothing("long").alias("turn"), nothing("string").alias("role"), nothing("string").alias("text"), nothing("string").alias("fault"), nothing("long").alias("cost"))
    ahead = found.select("conv_id", "block", nothing("long").alias("n"), nothing("long").alias("turn"), nothing("string").alias("role"), F.col("audit").alias("text"), nothing("string").alias("fault"), "cost")
    behind = lines.select("conv_id", F.floor((F.col("n") - 1) / block_rows).alias("block"), "n", "turn", "role", "text", "fault", nothing("long").alias("cost"))

    def run(batches):
        now = None
        for batch in batches:
            for conv, block, n, turn, role, text, fault, cost in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block < 0:
                    if now:
                        yield now.row()
                    now = _Repair(conv, with_text)
                elif n is None:
                    now.block(text, cost)
                else:
                    now.line(turn, role, text, fault)
        if now:
            yield now.row()

    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    schema = T.StructType([T.StructField("conv_id", given.schema["conv_id"].dataType), *[T.StructField(n, T.LongType()) for n in names], T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType()), *([T.StructField("repaired", T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])))] if with_text else [])])
    return _mapped(heads.unionByName(ahead).unionByName(behind), ["conv_id"], ["block", "n"], run, schema)


class _Repair:
    """A conversation while its rows stream by."""

    def __init__(self, conv, with_text: bool):
        self.conv, self.repaired = conv, [] if with_text else None
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.least = self.most = self.last = None
        self.turns = self.illegal = self.cost = 0
        self.initial, self.state, self.made = None, START, 0
        self.audit, self.words, self.sha = [], iter(()), hashlib.sha256()

    def block(self, audit: str, cost: int) -> None:
        self.audit.append(audit)
        self.cost += cost
        self.words = iter(_words(audit))

    def line(self, turn, role: str, text: str, fault: str) -> None:
        if turn is not None and turn != self.last:
            self.least, self.most, self.last = turn if self.least is None else self.least, turn, turn
            self.turns += 1
        if fault:
            self.counts[fault] += 1
        self.illegal += self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au")
        self.initial = role[:1]
        for role_, text_, self.state in _turns(role, text, next(self.words), self.state):
            self.add(role_, text_)

    def add(self, role: str, text: str) -> None:
        self.sha.update((("\n" if self.made else "") + role + ":" + text).encode())
        self.made += 1
        if self.repaired is not None:
            self.repaired.append({"role": role, "text": text})

    def row(self) -> tuple:
        for _ in range(_closing(self.state)):
            self.state = _NEXT[self.state]
            self.add(ROLE_OF[self.state], "")
            self.audit.append("I")
            self.cost += INSERT
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        return self.conv, gaps, *self.counts.values(), self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest(), *([self.repaired] if self.repaired is not None else [])


def _words(audit: str) -> Iterator[str]:
    """A block's audit row by row: the inserts ahead of each row with the row's own edit."""
    at = 0
    for i, letter in enumerate(audit):
        if letter != "I":
            yield audit[at : i + 1]
            at = i + 1


REPAIR_SQL = r"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS was, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
h AS (SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(key, ''), lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 20 AS hit FROM k),
d AS (SELECT conv_id, turn, was, copy, CASE hit WHEN 4 THEN 'user' ELSE was END AS role, text AS original,
      CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM h, range(0, 2) c(copy) WHERE hit <> 0 AND (copy = 0 OR hit = 3)),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, was, text, copy) AS n FROM d),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault, lag(role) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM n),
i(p, st, cost, letters, body) AS (VALUES (0, 0, 0, '', ''), (0, 2, 3, 'I', chr(10) || 'user:'), (0, 3, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
      (1, 1, 0, '', ''), (1, 2, 3, 'I', chr(10) || 'user:'), (1, 3, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (2, 2, 0, '', ''), (2, 3, 3, 'I', chr(10) || 'assistant:'),
      (2, 2, 6, 'II', chr(10) || 'assistant:' || chr(10) || 'user:'), (3, 3, 0, '', ''), (3, 2, 3, 'I', chr(10) || 'user:'), (3, 3, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')),
w AS (SELECT DISTINCT conv_id, 0::BIGINT AS n, 0 AS state, {'c': 0::BIGINT, 'a': '', 'b': ''} AS x FROM conversations
      UNION ALL
      SELECT conv_id, n, state, min(x) FROM (
        SELECT w.conv_id, f.n, CASE e WHEN 'D' THEN st WHEN 'R' THEN CASE st WHEN 2 THEN 3 ELSE 2 END ELSE instr('sua', f.role[1]) END AS state,
               {'c': x.c + i.cost + CASE e WHEN 'D' THEN 4 ELSE CASE e WHEN 'R' THEN 3 ELSE 0 END + CASE fault WHEN 'truncated' THEN 3 ELSE 0 END END, 'a': x.a || letters || e,
                'b': x.b || i.body || CASE e WHEN 'D' THEN '' WHEN 'R' THEN chr(10) || CASE st WHEN 2 THEN 'assistant' ELSE 'user' END || ':' || f.text ELSE chr(10) || f.role || ':' || f.text END} AS x
        FROM w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.n = w.n + 1 JOIN i ON i.p = w.state, (VALUES ('D'), ('K'), ('R')) o(e)
        WHERE e = 'D' OR fault NOT IN ('blank', 'duplicate') AND (e = 'R' OR st = 0 AND f.role[1] = 's' OR st <> 2 AND f.role[1] = 'u' OR st = 2 AND f.role[1] = 'a')) GROUP BY conv_id, n, state),
m AS (SELECT conv_id, max(n) AS n FROM w GROUP BY conv_id),
z AS (SELECT w.conv_id, min({'c': x.c + [0, 6, 3, 0][state + 1], 'a': x.a || ['', 'II', 'I', ''][state + 1], 'b': x.b || ['', chr(10) || 'user:' || chr(10) || 'assistant:', chr(10) || 'assistant:', ''][state + 1]}) AS x
      FROM w JOIN m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.n = w.n GROUP BY w.conv_id),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
      count(*) FILTER (before IS NOT NULL AND before[1] || role[1] NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT z.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, x.c AS cost, x.a AS audit, sha256(x.b[2:]) AS repaired_sha256
FROM z LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM z.conv_id
"""
