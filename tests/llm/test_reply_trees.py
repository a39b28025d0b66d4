"""Reply trees: paths against a plain walk, the template against round trips, the digest against a plain reader."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from millrace.llm.reply_trees import CHAT, ChatTemplate, format_reply_trees, formatted_digest, read_formatted, root_to_leaf_paths

MESSAGES = "tree string, id long, parent long, role string, text string, score double"


def plain_paths(rows, branches=None):
    """{(tree, leaf): (rank, score, ids from the root)} by walking up from each leaf."""
    out = {}
    for tree in {r[0] for r in rows}:
        own = {}
        for r in sorted((r for r in rows if r[0] == tree and r[1] is not None), key=lambda r: (r[2] is not None, r[2] or 0)):
            own.setdefault(r[1], r)
        replied = {r[2] for r in own.values() if r[2] in own}
        found = []
        for leaf in own.keys() - replied:
            path = [leaf]
            while own[path[-1]][2] in own:
                path.append(own[path[-1]][2])
            scores = [0.0 if own[i][5] is None or own[i][5] != own[i][5] else own[i][5] for i in path]
            found.append((-sum(scores) / len(scores), leaf, path[::-1]))
        for rank, (worse, leaf, path) in enumerate(sorted(found), 1):
            if branches is None or rank <= branches:
                out[tree, leaf] = (rank, -worse, path)
    return out


def some_trees(seed):
    rng = random.Random(seed)
    rows = []
    for tree in ["a", "b", None, ""]:
        for i in range(rng.randrange(1, 40)):
            parent = rng.choice([None, i - 1, i - 1, rng.randrange(i + 1), 999]) if i else None
            rows.append((tree, i, None if parent == i or parent == -1 else parent, rng.choice(["user", "assistant", None, "x|y"]), rng.choice(["hi", "", None, "</s>", "<|im_end|>\\"]), rng.choice([0.5, 0.25, None, float("nan"), -1.0])))
    rows += [("line", i, i - 1 if i else None, "user" if i % 2 == 0 else "assistant", f"t{i}", 1.0) for i in range(70)]
    rows += [("loop", 1, 2, "user", "x", 1.0), ("loop", 2, 1, "user", "y", 1.0), ("loop", 3, 1, "user", "z", 1.0), ("loop", 7, 7, "user", "self", 1.0), ("loop", 8, None, "user", "alone", 1.0)]
    return rows + [("a", None, 0, "user", "no id", 1.0)]


@pytest.mark.parametrize("seed,branches", [(1, None), (2, 2), (3, 1)])
def test_paths_equal_a_walk(spark, seed, branches):
    rows = some_trees(seed)
    df = spark.createDataFrame(rows, MESSAGES).repartition(3)
    want = plain_paths([r for r in rows if r[0] != "loop"] + [("loop", 8, None, "user", "alone", 1.0)], branches)
    got = {}
    for r in format_reply_trees(df, tree=["tree"], id_col="id", parent_col="parent", score_col="score", branches=branches).collect():
        got[r.tree, r.leaf_id] = (r.branch_rank, r.branch_score, len(r["mask"]), r.formatted)
    assert got.keys() == want.keys()
    said = {(r[0], r[1]): (r[3] or "", r[4] or "") for r in rows}
    texts = spark.createDataFrame([(k[0], k[1], v[3]) for k, v in got.items()], "tree string, leaf long, formatted string")
    back = {(r.tree, r.leaf): [tuple(t) for t in r.turns] for r in read_formatted(texts.withColumn("mask", F.expr("array(struct(0L as turn_start, 0L as loss_start, 0L as loss_chars))"))).collect()}
    for key, (rank, score, path) in want.items():
        assert got[key][0] == rank and abs(got[key][1] - score) < 1e-12 and got[key][2] == len(path)
        assert back[key] == [said[key[0], i] for i in path]


def test_repeated_ids_and_empty_tables(spark):
    df = spark.createDataFrame([("t", 1, None, "user", "b", 0.0), ("t", 1, None, "user", "a", 0.0), ("t", 1, 5, "user", "a", 9.0)], MESSAGES)
    (row,) = format_reply_trees(df, tree=["tree"], id_col="id", parent_col="parent", score_col="score").collect()
    assert row.formatted == "<|im_start|>user<|im_sep|>a<|im_end|>" and row.branch_score == 0.0
    for empty in (df.limit(0), df.withColumn("id", F.lit(None).cast("long"))):
        assert format_reply_trees(empty, tree=["tree"], id_col="id", parent_col="parent").count() == 0
    assert root_to_leaf_paths(df.limit(0), tree=["tree"], id_col="id", parent_col="parent").count() == 0


def test_template_is_reversible(spark):
    rng = random.Random(5)
    pieces = [*CHAT.controls, "<", "[", "\\", "|", "im_end|>", "s>", "INST]", "é𝄞", "$0", "\n", "a", "<\\s>", "<<SYS", ">"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(12))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(3)
    for row in df.select("t", CHAT.escaped(F.col("t")).alias("e"), CHAT.plain(CHAT.escaped(F.col("t"))).alias("p")).collect():
        assert row.p == row.t and not any(c in row.e for c in CHAT.controls), row


@pytest.mark.parametrize("bad", [{"end": "<"}, {"foreign": ("x<s>", "<s>")}, {"begin": "ab", "body": "bc", "end": "cd"}, {"foreign": ("a\\b",)}])
def test_templates_that_cannot_be_read_back(bad):
    with pytest.raises(ValueError):
        ChatTemplate(**bad)


def brute_digest(rows):
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role is not None, role or "", text is not None, text or ""))
    lists = [(k, [(r[3], r[5]) for r in sorted(v)]) for k, v in convs.items()]
    lists.append((-1, [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = []
    for conv, turns in lists:
        loss = "".join(t for r, t in turns if r == "assistant")
        out.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss)))
    return sorted(out, key=str)


def test_digest_equals_a_plain_reader(spark):
    rng = random.Random(9)
    roles, texts = ["user", "assistant", "system", None, "", "a\nb", "<|im_sep|>"], ["", None, "x" * 5000, "</s>", "é\n𝄞", "<|im_end|>", "[\\INST]"]
    rows = [(rng.choice([1, 2, 3, None, -1]), rng.choice([None, 0, 1, 2, 2, 5]), rng.choice(roles), rng.choice(texts)) for _ in range(120)]
    rows += [rows[0], rows[0], (50, 1, "assistant", "z" * 2_000_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    for name in ("probe", "formatted", "mask", "message_id", "parent_id", "_t"):
        df = df.withColumn(name, F.lit("clash"))
    got = formatted_digest(df)
    assert sorted((tuple(r) for r in got.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256").collect()), key=str) == brute_digest(rows)
    assert brute_digest([]) == [tuple(r)[:5] for r in formatted_digest(df.limit(0)).collect()]


def test_mask_covers_whole_assistant_texts(spark):
    rows = [("t", 1, None, "user", "q<s>", 0.0), ("t", 2, 1, "assistant", "𝄞</s>", 0.0), ("t", 3, 2, "user", "", 0.0), ("t", 4, 3, "assistant", "", 0.0)]
    out = format_reply_trees(spark.createDataFrame(rows, MESSAGES), tree=["tree"], id_col="id", parent_col="parent")
    (row,) = read_formatted(out).collect()
    assert [row.formatted[m.loss_start : m.loss_start + m.loss_chars] for m in row["mask"]] == ["", "𝄞<\\/s>", "", ""]
    assert row.losses == ["", "𝄞</s>", "", ""] and [t.text for t in row.turns] == ["q<s>", "𝄞</s>", "", ""]
