"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its target share of the output over its share of the input.
Each document draws its count by inverting the Poisson distribution of its source at a point
that a hash of seed and id gives, is exploded by that count, and the copies are put in a global
order by another hash. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Probabilities, eight bytes each, that are broadcast: 16 MB of tables.
MOST_BROADCAST = 2_000_000
#: Fixed: 13 hex digits of a hash give a point of 52 bits.
_POINTS = float(1 << 52)


def hash_point(*parts) -> F.Column:
    """A point in [0, 1) from an MD5 hash of the parts' text."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / F.lit(_POINTS)


def source_rates(docs: DataFrame, targets: DataFrame | None, *, source_col: str, size, temper: float) -> DataFrame:
    """For each source (null: the empty one) its size, target share ``weight`` and mean repetition ``rate``.

    ``targets`` has columns source and weight; a source that it doesn't name gets none of the output. Without
    it shares follow size to the power ``temper``. The output is as large as the input in the mean.
    """
    sizes = docs.groupBy(F.coalesce(F.col(f"`{source_col}`"), F.lit("")).alias("source")).agg(F.sum(size).cast("double").alias("size")).where("size > 0")
    if targets is None:
        sized = sizes.withColumn("weight", F.pow("size", F.lit(temper)))
    else:
        sized = sizes.join(F.broadcast(targets.select("source", F.col("weight").cast("double").alias("weight"))) if targets.count() <= 100_000 else targets.select("source", F.col("weight").cast("double").alias("weight")), "source", "left").na.fill(0.0, ["weight"])
    total = sized.agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight"))
    return sized.crossJoin(F.broadcast(total)).select("source", "size", (F.col("weight") / F.col("all_weight")).alias("weight"), (F.col("weight") / F.col("all_weight") * F.col("all_size") / F.col("size")).alias("rate"))


def poisson_tables(rates: DataFrame) -> DataFrame:
    """For each source the ascending Poisson probabilities P(count <= k), as far as 52-bit points can tell.

    Probabilities are summed as logarithms, so that large rates don't underflow. A table has about as many entries as the rate, which
    is the copies that each document of the source makes in the mean.
    """
    steps = rates.where("rate > 0").select("source", "rate", F.explode(F.sequence(F.lit(0), F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 40).cast("int"))).alias("k"))
    upto = Window.partitionBy("source").orderBy("k")
    logs = steps.withColumn("log_factorial", F.sum(F.when(F.col("k") > 0, F.log(F.col("k").cast("double"))).otherwise(0.0)).over(upto))
    upto_k = logs.withColumn("upto", F.sum(F.exp(-F.col("rate") + F.col("k") * F.log("rate") - F.col("log_factorial"))).over(upto))
    return upto_k.groupBy("source").agg(F.sort_array(F.collect_list("upto")).alias("upto"))


def mix_sources(docs: DataFrame, targets: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", temper: float = 0.7, seed: int = 17) -> DataFrame:
    """Replicate documents so that sources reach their target shares of characters, in a global random order.

    Returns the input's columns with ``copy_no`` (from 0) and ``mix_key``, by whose order the copies are range
    partitioned and sorted; input columns of these names give way. A count depends on seed, id and the source's
    rate alone, so that retries and other partitionings give the same copies.

    A null source counts as the empty one; a null or empty text weighs one character; a null id draws as an
    empty id; repeated rows draw the same count. An empty table gives an empty result.
    """
    docs = docs.drop("copy_no", "mix_key")
    size = F.greatest(F.coalesce(F.length(F.col(f"`{text_col}`")), F.lit(0)), F.lit(1))
    tables = poisson_tables(source_rates(docs, targets, source_col=source_col, size=size, temper=temper)).select(F.col("source").alias("_mr_source"), F.col("upto").alias("_mr_upto"))
    name = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    keyed = docs.withColumn("_mr_source", F.coalesce(F.col(f"`{source_col}`"), F.lit(""))).withColumn("_mr_point", hash_point(F.lit(seed), name))
    tables = common.stored(tables, "source-tables")
    # few sources are broadcast, so that texts aren't dealt by source; many join by shuffle, where Spark splits a hot one
    few = (tables.agg(F.sum(F.size("_mr_upto") + 8)).first()[0] or 0) <= MOST_BROADCAST
    counted = keyed.join(F.broadcast(tables) if few else tables, "_mr_source").withColumn("_mr_n", F.size(F.filter("_mr_upto", lambda p: p <= F.col("_mr_point"))))
    copies = counted.where("_mr_n > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.col("_mr_n") - 1)))
    out = copies.withColumn("mix_key", F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), name, "copy_no")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], "copy_no", "mix_key").orderBy("mix_key", f"`{id_col}`", "copy_no")


#: DuckDB SQL for ``mix_sources`` with its default parameters over ``documents``.
MIX_SQL = """
WITH d AS (SELECT *, coalesce(source, '') AS s, greatest(coalesce(length(text), 0), 1) AS z,
                  ('0x' || substr(md5('17:' || coalesce(doc_id::varchar, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u FROM documents),
sizes AS (SELECT s, sum(z)::DOUBLE AS size, pow(sum(z)::DOUBLE, 0.7) AS w FROM d GROUP BY s),
rates AS (SELECT s, w / sum(w) OVER () * sum(size) OVER () / size AS rate FROM sizes),
steps AS (SELECT s, rate, unnest(generate_series(0, ceil(rate + 12 * sqrt(rate) + 40)::BIGINT)) AS k FROM rates),
logs AS (SELECT *, sum(CASE WHEN k > 0 THEN ln(k::DOUBLE) ELSE 0.0 END) OVER (PARTITION BY s ORDER BY k) AS lf FROM steps),
upto AS (SELECT s, k, sum(exp(-rate + k * ln(rate) - lf)) OVER (PARTITION BY s ORDER BY k) AS p FROM logs),
lists AS (SELECT s, list(p ORDER BY k) AS ps FROM upto GROUP BY s),
counted AS (SELECT d.*, len(list_filter(ps, lambda p: p <= u)) AS n FROM d JOIN lists USING (s)),
copies AS (SELECT *, unnest(generate_series(0, n - 1)) AS copy_no FROM counted WHERE n > 0)
SELECT doc_id, text, lang, source, n_chars, copy_no::INTEGER AS copy_no, md5('17:order:' || coalesce(doc_id::varchar, '') || ':' || copy_no::varchar) AS mix_key FROM copies
"""
