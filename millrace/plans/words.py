"""Queries over lines and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normalize_text
from ..operators import text as ops
from ..sources import derive, feeds
from .registry import LINES, WORDS, query


@query(f"WITH {LINES} SELECT pos, line FROM l")
def src_lines(spark, sf):
    return derive.lines(spark, sf).select("pos", "line")


@query("SELECT doc_id, text FROM documents")
def src_tweets_json(spark, sf):
    return feeds.tweets(derive.tweets(spark, sf), keep=["doc_id"])


@query(f"WITH {WORDS} SELECT pos, word_no, word FROM w")
def split_words(spark, sf):
    return ops.words(derive.lines(spark, sf)).select("pos", F.col("word_no").cast("long").alias("word_no"), "word")


@query(f"WITH {WORDS} SELECT pos, word_no, word, row_number() OVER (PARTITION BY word ORDER BY pos, word_no) AS count FROM w")
def word_count_running(spark, sf):
    return ops.word_count_of_lines(derive.lines(spark, sf), order="pos").select("pos", F.col("word_no").cast("long").alias("word_no"), "word", "count")


@query(f"WITH {WORDS} SELECT word, count(*) AS count FROM w GROUP BY word")
def word_count_total(spark, sf):
    return ops.word_count_total(ops.words(derive.lines(spark, sf)))


@query(f"WITH {LINES} SELECT sum(octet_length(encode(line)))::BIGINT AS bytes, count(line) AS lines, sum(CASE WHEN line <> '' AND rtrim(line, ' ') = '' THEN 0 ELSE len(string_split(rtrim(line, ' '), ' ')) END)::BIGINT AS words FROM l")
def volume_stats(spark, sf):
    return ops.volume_stats(derive.lines(spark, sf))


_TOKENS = """t AS (SELECT doc_id, list_filter(string_split(lower(regexp_replace(text, '[^A-Za-z0-9]', ' ', 'g')), ' '), lambda x: x <> '') AS ws FROM documents)"""
_LEXICON = "(VALUES ('the', 1), ('and', -1), ('that', 2), ('for', -2), ('was', 3), ('with', -3)) x(word, score)"


@query(f"WITH {_TOKENS} SELECT doc_id, array_to_string(ws, ' ') AS words, len(ws)::BIGINT AS n FROM t", name="normalize_text")
def normalize_text_words(spark, sf):
    words = normalize_text(F.col("text"))
    return derive.table(spark, sf, "documents").select("doc_id", F.array_join(words, " ").alias("words"), F.size(words).cast("long").alias("n"))


_SENTIMENT = f"""WITH {_TOKENS}, s AS (SELECT doc_id, sum(score)::BIGINT AS score FROM (SELECT doc_id, unnest(ws) AS word FROM t) JOIN {_LEXICON} USING (word) GROUP BY doc_id)
SELECT doc_id, coalesce(score, 0) AS score, CASE WHEN score > 0 THEN 'Positive' WHEN score < 0 THEN 'Negative' ELSE 'Neutral' END AS label FROM documents LEFT JOIN s USING (doc_id)"""


@query(_SENTIMENT)
def sentiment(spark, sf):
    return ops.sentiment(src_tweets_json(spark, sf), derive.lexicon(spark), key="doc_id")


@query(f"WITH {_TOKENS} SELECT word, coalesce(score, 0)::INTEGER AS score, count(*) AS n FROM (SELECT unnest(ws) AS word FROM t) LEFT JOIN {_LEXICON} USING (word) GROUP BY ALL")
def join_lexicon(spark, sf):
    tokens = derive.table(spark, sf, "documents").select(F.explode(normalize_text(F.col("text"))).alias("word"))
    return tokens.groupBy("word").agg(F.count("*").alias("n")).join(F.broadcast(derive.lexicon(spark)), "word", "left").select("word", F.coalesce("score", F.lit(0)).alias("score"), "n")
