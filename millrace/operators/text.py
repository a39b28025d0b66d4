"""Word counts and lexicon sentiment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalize_text, split_words
from .ads import sized
from .ordered import BLOCK_ROWS, MOST_BUCKETS, bucketed, numbered


def words(lines: DataFrame, *, line: str = "line", keep_empty: bool = True) -> DataFrame:
    """One row for each word of a line, with its place."""
    return lines.select(*[c for c in lines.columns if c != line], F.posexplode(split_words(F.col(line), keep_empty=keep_empty)).alias("word_no", "word"))


def word_count_total(rows: DataFrame) -> DataFrame:
    return rows.groupBy("word").agg(F.count("*").alias("count"))


def word_count_running(rows: DataFrame, *, order: str, tie: list[str]) -> DataFrame:
    """Every word with its count so far; a frequent word's rows are spread over tasks."""
    return numbered(rows, ["word"], order, tie, out="count")


def word_count_of_lines(lines: DataFrame, *, order: str, line: str = "line", rows: int | None = None) -> DataFrame:
    """``word_count_running`` of the lines' words, of which none is shuffled.

    Lines are cut into buckets of about as many words along ``order`` and dealt out by bucket, together with what each of its words counted before it;
    they are split where they arrive. A line is never divided. The same rows come whether there is one bucket or many. Buckets are twice as large as
    blocks elsewhere, since fewer of them repeat fewer words.
    """
    n = F.greatest(F.coalesce(F.size(split_words(F.col(line))), F.lit(0)), F.lit(0))
    blocks = min(MOST_BUCKETS, max(1, -(-(lines.agg(F.sum(n)).first()[0] or 0) // (rows or 2 * BLOCK_ROWS))))
    if blocks == 1:
        return numbered(words(lines, line=line), ["word"], order, ["word_no"], out="count", blocks=1)
    placed = bucketed(lines, order, blocks, weight=F.floor(n / 16).cast("int") + 1)
    totals = words(placed.select("_bucket", line), line=line).groupBy("word", "_bucket").agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(Window.partitionBy("word").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    carries = totals.select("_bucket", F.col("word").alias(line), before.alias("_before")).where("_before is not null")
    dealt = placed.withColumn("_before", F.lit(None).cast("long")).unionByName(carries, allowMissingColumns=True).repartition(2 * blocks, "_bucket")
    spread = dealt.select(*[c for c in dealt.columns if c != line], F.posexplode(F.when(F.col("_before").isNull(), split_words(F.col(line))).otherwise(F.array(line))).alias("word_no", "word"))
    upto = Window.partitionBy("word", "_bucket").orderBy(F.col("_before").isNull(), order, "word_no").rowsBetween(Window.unboundedPreceding, 0)
    found = spread.withColumn("count", F.sum(F.coalesce("_before", F.lit(1).cast("long"))).over(upto)).where("_before is null")
    return found.select(*[c for c in lines.columns if c != line], "word_no", "word", "count")


def volume_stats(lines: DataFrame, *, line: str = "line") -> DataFrame:
    """Bytes, lines and words of all lines."""
    return lines.agg(F.sum(F.octet_length(line)).alias("bytes"), F.count(line).alias("lines"), F.sum(F.size(split_words(F.col(line)))).alias("words"))


def sentiment(texts: DataFrame, lexicon: DataFrame, *, key: str, text: str = "text") -> DataFrame:
    """Sum of lexicon scores of each text's words and its sign as a label; unknown words count 0."""
    tokens = texts.select(key, F.explode(normalize_text(F.col(text))).alias("word"))
    scores = tokens.join(sized(lexicon), "word").groupBy(key).agg(F.sum("score").alias("score"))
    label = F.when(F.col("score") > 0, "Positive").when(F.col("score") < 0, "Negative").otherwise("Neutral")
    return texts.select(key).join(scores, key, "left").na.fill(0, ["score"]).withColumn("label", label)
