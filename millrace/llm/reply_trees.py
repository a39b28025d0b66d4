"""Chat formatting of reply trees: iterative self-joins enumerate root-to-leaf paths, the best branches become conversations.

All of it is DataFrame functions. Self-joins double the reach of each message's ancestor, so that a thread of n replies takes log2(n)
rounds; the same tables then walk from a leaf to all of its ancestors, each met once. Only ids and scores take part in that; texts
meet the chosen paths afterwards.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordered import numbered
from .common import stored


@dataclass(frozen=True)
class ChatTemplate:
    """A turn is ``begin`` role ``body`` text ``end``.

    Control strings (the marks, and ``foreign`` ones that some tokenizer knows) never stand in a formatted role or text: a
    backslash goes in behind their first character, and one more where backslashes are there already, which ``plain`` takes back.
    """

    begin: str = "<|im_start|>"
    body: str = "<|im_sep|>"
    end: str = "<|im_end|>"
    foreign: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")
    loss_roles: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        marks, all_ = (self.begin, self.body, self.end), self.controls
        if any(len(c) < 2 or "\\" in c for c in all_):
            raise ValueError("control strings have two characters or more and no backslash")
        if any(other in c[1:] for c in all_ for other in all_):
            raise ValueError("a control string can't hold another behind its first character")
        if any(b.startswith(a[i:]) for a in marks for b in marks for i in range(1, len(a))):
            raise ValueError("marks can't overlap")

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.begin, self.body, self.end, *self.foreign)

    def _heads(self) -> dict[str, str]:
        """First characters and a pattern of what makes them a control string."""
        heads: dict[str, list[str]] = {}
        for c in dict.fromkeys(self.controls):
            heads.setdefault(c[0], []).append(re.escape(c[1:]))
        return {re.escape(h): rf"(?=\\*(?:{'|'.join(rests)}))" for h, rests in heads.items()}

    def escaped(self, text: Column) -> Column:
        return F.regexp_replace(text, "|".join(f"{h}{rest}" for h, rest in self._heads().items()), r"$0\\")

    def plain(self, text: Column) -> Column:
        heads = self._heads()
        groups = "".join(f"${i + 1}" for i in range(len(heads)))
        return F.regexp_replace(text, "|".join(rf"({h})\\{rest}" for h, rest in heads.items()), groups)


CHAT = ChatTemplate()


def _tree_key(columns: list[str]) -> Column:
    """One string that never is null for a tree's columns, whatever they hold."""
    part = lambda c: F.coalesce(F.concat(F.length(F.col(f"`{c}`").cast("string")).cast("string"), F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("-"))
    return F.concat_ws(",", *[part(c) for c in columns])


def _reaches(nodes: DataFrame) -> list[DataFrame]:
    """Tables by round k: _t, _id, _up (the ancestor 2**k above, null beyond the root), _d and _s (messages from there down, and their scores).

    A round has the messages that had an ancestor in the round before. Ends when none has one so far up; after as many rounds as the
    number of messages can need, what is left hangs on a cycle.
    """
    now = stored(nodes.select("_t", "_id", "_up", F.lit(1).cast("long").alias("_d"), F.col("_score").alias("_s")), "reach-0")
    tables, most = [now], max(1, now.count()).bit_length()
    while len(tables) <= most and not now.where("_up is not null").isEmpty():
        a, b = now.where("_up is not null").alias("a"), reduce(DataFrame.unionByName, [now, *(t.where("_up is null") for t in tables[:-1])]).alias("b")
        met = a.join(b, (F.col("a._t") == F.col("b._t")) & (F.col("a._up") == F.col("b._id")))
        now = stored(met.select("a._t", "a._id", "b._up", (F.col("a._d") + F.col("b._d")).alias("_d"), (F.col("a._s") + F.col("b._s")).alias("_s")), f"reach-{len(tables)}")
        tables.append(now)
    return tables


def root_to_leaf_paths(messages: DataFrame, *, tree: list[str], id_col: str, parent_col: str, score_col: str | None = None, branches: int | None = None) -> DataFrame:
    """Messages of each chosen root-to-leaf path: _t (key of the tree), _leaf, _id, _above (0 at the leaf), branch_rank, branch_score.

    Branches of a tree rank by their mean score, best first, then by the leaf's id; with ``branches`` only so many of each tree are kept.
    A message without a parent in its tree is a root; without or with a NaN score it scores 0; without an id it has no replies and is left
    out, as are messages on a cycle of replies. Of messages with one id in a tree, the one with the least parent counts.
    """
    score = F.coalesce(F.nanvl(F.col(f"`{score_col}`").cast("double"), F.lit(0.0)), F.lit(0.0)) if score_col else F.lit(0.0)
    given = messages.select(_tree_key(tree).alias("_t"), F.col(f"`{id_col}`").alias("_id"), F.col(f"`{parent_col}`").alias("_parent"), score.alias("_score")).where("_id is not null")
    ids = given.groupBy("_t", "_id").agg(F.min(F.struct("_parent", "_score")).alias("m")).select("_t", "_id", "m._parent", "m._score")
    known = ids.select("_t", F.col("_id").alias("_up"))
    a, b = ids.alias("a"), known.alias("b")
    nodes = a.join(b, (F.col("a._t") == F.col("b._t")) & (F.col("a._parent") == F.col("b._up")), "left").select("a._t", "a._id", "b._up", "a._score")
    reaches = _reaches(nodes)
    whole = reduce(DataFrame.unionByName, [t.where("_up is null") for t in reaches]).select("_t", "_id", (F.col("_s") / F.col("_d")).alias("branch_score"))
    replied = reaches[0].where("_up is not null").select("_t", F.col("_up").alias("_id")).distinct()
    leaves = whole.join(replied, ["_t", "_id"], "left_anti").withColumn("_worse", -F.col("branch_score"))
    ranked = numbered(leaves, ["_t"], "_worse", ["_id"], out="branch_rank").drop("_worse")
    if branches is not None:
        ranked = ranked.where(F.col("branch_rank") <= branches)
    paths = ranked.withColumnRenamed("_id", "_leaf").withColumn("_id", F.col("_leaf")).withColumn("_above", F.lit(0).cast("long"))
    for k in reversed(range(len(reaches))):
        # a message goes on alone and, where it has one, together with its ancestor 2**k above: sums of powers meet each ancestor once
        jump = reaches[k].where("_up is not null").select("_t", "_id", "_up")
        both = F.array(F.struct("_id", "_above"), F.struct(F.col("_up").alias("_id"), (F.col("_above") + (1 << k)).alias("_above")))
        one = F.array(F.struct("_id", "_above"))
        paths = paths.join(jump, ["_t", "_id"], "left").withColumn("_x", F.explode(F.when(F.col("_up").isNull(), one).otherwise(both)))
        paths = paths.select("_t", "_leaf", "branch_rank", "branch_score", "_x._id", "_x._above")
    return paths


def format_reply_trees(messages: DataFrame, *, tree: list[str], id_col: str, parent_col: str, role_col: str = "role", text_col: str = "text", score_col: str | None = None, branches: int | None = None, template: ChatTemplate = CHAT) -> DataFrame:
    """One formatted conversation for each chosen branch of each tree: the columns of ``tree``, leaf_id, branch_rank, branch_score, formatted, mask.

    ``mask`` has for each turn, in order, turn_start, loss_start and loss_chars, in code points of ``formatted``: the text of roles in
    ``loss_roles`` as it stands there, escaped; other turns have loss_chars 0. Branches as ``root_to_leaf_paths`` has them. Null roles and texts
    are empty; of messages with one id in a tree, that with the least role and text is taken; empty tables give no rows. Other columns aren't
    read. A conversation is one row, so that its text has 2 GB at most.
    """
    paths = root_to_leaf_paths(messages, tree=tree, id_col=id_col, parent_col=parent_col, score_col=score_col, branches=branches)
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    said = messages.where(F.col(f"`{id_col}`").isNotNull()).select(_tree_key(tree).alias("_t"), F.struct(*[F.col(f"`{c}`") for c in tree]).alias("_tree"), F.col(f"`{id_col}`").alias("_id"), text(role_col).alias("_role"), text(text_col).alias("_text"))
    turns = paths.join(said, ["_t", "_id"]).groupBy("_t", "_leaf", "_above", "branch_rank", "branch_score", "_tree").agg(F.min(F.struct("_role", "_text")).alias("m"))
    role, body = template.escaped(F.col("m._role")), template.escaped(F.col("m._text"))
    turns = turns.select("*", F.concat(F.lit(template.begin), role, F.lit(template.body)).alias("_head"), F.concat(body, F.lit(template.end)).alias("_rest"), F.col("m._role").isin(*template.loss_roles).alias("_loss")).drop("m")
    head, rest = F.length("_head"), F.length("_rest") - len(template.end)
    turns = turns.select("*", head.alias("_h"), rest.alias("_l"), F.coalesce(F.sum((head + F.length("_rest")).cast("long")).over(Window.partitionBy("_t", "_leaf").orderBy(F.desc("_above")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")).alias("_at"))
    mask = F.struct(F.col("_at").alias("turn_start"), (F.col("_at") + F.col("_h")).alias("loss_start"), F.when(F.col("_loss"), F.col("_l")).otherwise(0).cast("long").alias("loss_chars"))
    whole = turns.groupBy("_t", "_leaf").agg(F.first("_tree").alias("_tree"), F.first("branch_rank").alias("branch_rank"), F.first("branch_score").alias("branch_score"), F.array_sort(F.collect_list(F.struct((-F.col("_above")).alias("o"), F.concat("_head", "_rest").alias("p"), mask.alias("m")))).alias("x"))
    return whole.select(*[F.col("_tree")[c].alias(c) for c in tree], F.col("_leaf").alias("leaf_id"), "branch_rank", "branch_score", F.array_join(F.transform("x", lambda t: t.p), "").alias("formatted"), F.transform("x", lambda t: t.m).alias("mask"))


def read_formatted(formatted: DataFrame, *, template: ChatTemplate = CHAT) -> DataFrame:
    """Formatted conversations read back: ``turns`` (role and text of each) and ``losses`` (what the mask covers in each turn, empty outside it), both unescaped."""
    cut = F.split("formatted", rf"\Q{template.end}\E", -1)
    raw = formatted.withColumn("_cut", F.slice(cut, 1, F.size(cut) - 1))
    role = lambda t: F.substring_index(F.substr(t, F.lit(len(template.begin) + 1)), template.body, 1)
    text = lambda t: F.substr(t, F.length(F.substring_index(t, template.body, 1)) + len(template.body) + 1)
    turns = F.transform("_cut", lambda t: F.struct(template.plain(role(t)).alias("role"), template.plain(text(t)).alias("text")))
    losses = F.transform(F.arrays_zip("_cut", "mask"), lambda x: template.plain(F.substr(x["_cut"], (x["mask"]["loss_start"] - x["mask"]["turn_start"] + 1).cast("int"), x["mask"]["loss_chars"].cast("int"))))
    return raw.withColumn("turns", turns).withColumn("losses", losses).drop("_cut")


def linear_messages(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows of conversations as messages, each the reply to the row before it: ``message_id`` numbers a conversation's rows by turn (nulls first), then role and text."""
    rows = conversations.select(F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"), F.col(f"`{role_col}`").alias("role"), F.col(f"`{text_col}`").alias("text"))
    lines = numbered(rows, ["conv_id"], "turn", ["role", "text"], out="message_id")
    return lines.withColumn("parent_id", F.when(F.col("message_id") > 1, F.col("message_id") - 1))


def probe_conversation(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Conversation -1: a user and an assistant, both of whom say control strings."""
    return spark.range(1, 3).select(F.lit(-1).cast(rows.schema["conv_id"].dataType).alias("conv_id"), F.col("id").cast(rows.schema["turn"].dataType).alias("turn"), F.when(F.col("id") == 1, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"), F.col("id").alias("message_id"), F.when(F.col("id") == 2, F.col("id") - 1).alias("parent_id"))


def formatted_digest(conversations: DataFrame, *, template: ChatTemplate = CHAT) -> DataFrame:
    """All conversations and the probe, formatted, stored and read back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Rows go by turn (nulls first), ties by role and text; null ids make one conversation, null roles and texts are empty, repeated rows are turns of
    their own, and the probe is a conversation of its own beside one of the table with id -1. An empty table gives the probe alone.
    """
    said = linear_messages(conversations)
    both = said.withColumn("probe", F.lit(0)).unionByName(probe_conversation(conversations.sparkSession, said).withColumn("probe", F.lit(1)))
    out = stored(format_reply_trees(stored(both, "messages"), tree=["conv_id", "probe"], id_col="message_id", parent_col="parent_id", template=template), "formatted")
    back = read_formatted(out, template=template)
    said_all = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    loss = F.array_join("losses", "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said_all.cast("binary"), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


FORMAT_SQL = r"""
WITH c AS (SELECT conv_id, 0 AS probe, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 1, t, CASE t WHEN 1 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(1, 3) r(t)),
x AS (SELECT *, len(regexp_extract_all(role || chr(10) || text, '<\\*(?:\|im_start\|>|\|im_sep\|>|\|im_end\|>|s>|/s>|<SYS>>|</SYS>>|\|endoftext\|>)|\[\\*(?:INST\]|/INST\])')) AS escapes FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(role) + length(text) + escapes + 32)::BIGINT AS formatted_chars
FROM x GROUP BY conv_id, probe
"""
