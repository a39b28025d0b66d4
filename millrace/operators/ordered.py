"""Ordered operators that split a hot key's rows over many tasks.

A window over ``partitionBy(key)`` puts a key into one task. That is what happens here while the whole table has
no more rows than a block. Beyond it the order column is cut into buckets at approximate quantiles, and
each key's rows of a bucket are a piece. Totals of the pieces, a small table, give each piece what its key had before it;
that joins the piece as a row of its own ahead of the others, so that running values come out of
one shuffle by key and bucket. Both ways give the same rows.

In all operators a null key is a key like any other, and rows without an order value come first.
``order`` and ``tie`` together should tell rows apart: what equal rows get among themselves is arbitrary.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import frame_means

#: Rows of a bucket or block where a key's rows come evenly.
BLOCK_ROWS = 250_000
#: Buckets at most, so that their bounds stay a bounded list; beyond it buckets grow, and Spark's windows spill.
MOST_BUCKETS = 4096


def block_count(df: DataFrame, rows: int | None = None) -> int:
    """How many blocks a table has: 1 for one that windows may take as it is. Only a count reaches the driver."""
    return min(MOST_BUCKETS, max(1, -(-df.count() // (rows or BLOCK_ROWS))))


def bucketed(df: DataFrame, order: str, blocks: int, *, weight: Column | None = None) -> DataFrame:
    """``df`` with ``_bucket``, cut at approximate quantiles of a numeric ``order``; rows without an order value are in bucket -1.

    A row counts ``weight`` times, a whole number, once if it isn't given. At most ``MOST_BUCKETS`` bounds reach the driver.
    """
    from pyspark.ml.feature import Bucketizer

    value = F.col(order).cast("double")
    weighed = df if weight is None else df.select(F.explode(F.array_repeat(order, weight)).alias(order))
    cuts = weighed.agg(F.percentile_approx(value, [i / blocks for i in range(1, blocks)], 20 * blocks).alias("c")).first()["c"] if blocks > 1 else None
    inner = sorted({c for c in cuts or [] if math.isfinite(c)})
    if not inner:
        return df.withColumn("_bucket", F.when(F.col(order).isNull(), -1).otherwise(0).cast("long"))
    placed = df.withColumn("_bucket_value", F.coalesce(value, F.lit(math.nan)))
    placed = Bucketizer(splits=[-math.inf, *inner, math.inf], inputCol="_bucket_value", outputCol="_bucket_at", handleInvalid="keep").transform(placed)
    return placed.withColumn("_bucket", F.when(F.col(order).isNull(), -1).otherwise(F.col("_bucket_at")).cast("long")).drop("_bucket_value", "_bucket_at")


def _over(keys: list[str], *more: str) -> Window:
    return Window.partitionBy(*keys, *more) if keys or more else Window.partitionBy(F.lit(0))


def held(df: DataFrame, blocks: int) -> DataFrame:
    """A table that is read more than once: kept in memory and on disk where it is large. Spark makes lost parts again; ``unpersist`` or ``clearCache`` lets go."""
    return df.persist(StorageLevel.MEMORY_AND_DISK) if blocks > 1 else df


def _with_carries(pieces: DataFrame, carries: DataFrame, by: list[str], blocks: int) -> DataFrame:
    """Rows with ``_row`` true, ahead of each piece the row that carries what came before it.

    Pieces, told apart by ``by``, are dealt to two partitions a block, so that a task doesn't grow with the table, however few shuffle partitions a session has.
    """
    both = pieces.withColumn("_row", F.lit(True)).unionByName(carries.withColumn("_row", F.lit(False)), allowMissingColumns=True)
    return both.repartition(2 * blocks, *by)


def running(df: DataFrame, keys: list[str], order: str, tie: list[str], *, count: str | None = None, sums: dict[str, Column] | None = None, tops: dict[str, Column] | None = None, own: bool = True, rows: int | None = None, blocks: int | None = None) -> DataFrame:
    """Running count, sums and greatest values of each key up to each row, or up to the one before it unless ``own``.

    Sums of nothing but nulls are null, as are greatest values. No keys run over the whole table.
    """
    values = {n: ("sum", c) for n, c in (sums or {}).items()} | {n: ("max", c) for n, c in (tops or {}).items()}
    if count:
        values[count] = ("sum", F.lit(1).cast("long"))
    merge = {"sum": F.sum, "max": F.max}
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    blocks = blocks or block_count(df, rows)
    made = lambda kind, c, w: merge[kind](c).over(upto(w))
    # a row before the first has counted none
    full = lambda n, c: F.coalesce(c, F.lit(0).cast("long")).alias(n) if n == count else c.alias(n)
    if blocks == 1:
        w = _over(keys).orderBy(order, *tie)
        return df.select("*", *[full(n, made(kind, c, w)) for n, (kind, c) in values.items()])
    pieces = bucketed(df, order, blocks).select("*", *[c.alias(f"_x_{n}") for n, (_, c) in values.items()])
    totals = pieces.groupBy(*keys, "_bucket").agg(*[merge[kind](f"_x_{n}").alias(f"_x_{n}") for n, (kind, _) in values.items()])
    before = _over(keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carries = totals.select(*keys, "_bucket", *[merge[kind](f"_x_{n}").over(before).alias(f"_x_{n}") for n, (kind, _) in values.items()])
    carries = carries.where(reduce(or_, [F.col(f"_x_{n}").isNotNull() for n in values]))  # most keys of many have nothing before
    w = _over(keys, "_bucket").orderBy("_row", order, *tie)
    both = _with_carries(pieces, carries, [*keys, "_bucket"], blocks).select("*", *[full(n, made(kind, F.col(f"_x_{n}"), w)) for n, (kind, _) in values.items()])
    return both.where("_row").select(*df.columns, *values)


def numbered(df: DataFrame, keys: list[str], order: str, tie: list[str], *, out: str = "n", rows: int | None = None, blocks: int | None = None) -> DataFrame:
    """Number each key's rows from 1 in the order of ``order`` (numeric) and ``tie``; no keys number the whole table."""
    return running(df, keys, order, tie, count=out, rows=rows, blocks=blocks)


def framed(df: DataFrame, keys: list[str], reach: int, *, n: str = "n", rows: int | None = None, blocks: int | None = None) -> tuple[DataFrame, Window]:
    """Blocks of numbered rows with ``reach`` rows of the block before, and the window over them.

    Frames of up to ``reach`` preceding rows see what they would over the whole key. ``only_own`` drops the
    rows that a block borrowed. A table of one block is taken as it is.
    """
    if blocks == 1:
        return df.withColumn("_own", F.lit(0)).withColumn("_block", F.lit(0)), _over(keys).orderBy(n)
    size = max(rows or BLOCK_ROWS, 4 * reach)
    block = F.floor((F.col(n) - 1) / size)
    lent = (F.col(n) - 1) % size >= size - reach if reach else F.lit(False)
    copies = df.withColumn("_own", block).withColumn("_block", F.explode(F.when(lent, F.array(block, block + 1)).otherwise(F.array(block))))
    return copies, _over(keys, "_block").orderBy(n)


def only_own(df: DataFrame) -> DataFrame:
    return df.where("_own = _block").drop("_own", "_block")


def along(df: DataFrame, keys: list[str], order: str, tie: list[str], reach: int, *, rows: int | None = None, blocks: int | None = None) -> tuple[DataFrame, Window]:
    """Rows numbered as ``n`` and framed."""
    blocks = blocks or block_count(df, rows)
    return framed(numbered(df, keys, order, tie, rows=rows, blocks=blocks), keys, reach, rows=rows, blocks=blocks)


def moving_avg(df: DataFrame, *, key: str, order: str, tie: list[str], value: str, size: int = 1000, out: str = "moving_avg", rows: int | None = None) -> DataFrame:
    """Mean of the last ``size`` values of a key, the current one included; nulls among them count nothing.

    A frame is added up in aligned blocks of a key's numbered rows, as ``frames.frame_sums`` says: work hardly grows with the size, nothing is
    subtracted, and NaN, infinity or a large value touches the frames that hold it and no other. Rows go through Python in order, a few batches at a time.
    """
    blocks = block_count(df, rows)
    lines = numbered(df.withColumn("_v", F.col(value).cast("double")), [key], order, tie, out="_n", rows=rows, blocks=blocks)
    framed_, _ = framed(lines, [key], size - 1, n="_n", rows=rows, blocks=blocks)
    if blocks > 1:
        framed_ = framed_.repartition(blocks, key, "_block")
    kept = [c for c in df.columns if c != out]
    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, values, known = np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, dtype=bool)
        for table in gathered(batches, 4 * size):
            n, v = table["_n"].to_numpy(), table["_v"]
            own, first = pc.equal(table["_own"], table["_block"]), len(places)
            places, values, known = (np.concatenate(x) for x in ((places, n - 1), (values, pc.fill_null(v, 0.0).to_numpy()), (known, v.is_valid().to_numpy())))
            means, some = frame_means(places, values, known, np.where(own.to_numpy(), np.minimum(n, size), 0), first)
            yield from table.select(kept).append_column(out, pa.array(means, mask=~some)).filter(own).to_batches()
            places, values, known = (x[max(0, len(x) - size + 1) :] for x in (places, values, known))

    return framed_.sortWithinPartitions(key, "_block", "_n").mapInArrow(run, schema)


def gathered(batches: Iterable[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    """Batches put together to tables of ``least`` rows or more; the last may have fewer."""
    held = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= least:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def filter_spike(df: DataFrame, *, value: str, mean: str = "moving_avg", threshold: float = 0.25) -> DataFrame:
    """Rows that lie off the mean by more than ``threshold`` of it; a negative mean always fires."""
    return df.where(F.abs(F.col(value) - F.col(mean)) > threshold * F.col(mean))


def spike_detect(df: DataFrame, *, key: str, order: str, tie: list[str], value: str, size: int = 1000, threshold: float = 0.25) -> DataFrame:
    return filter_spike(moving_avg(df, key=key, order=order, tie=tie, value=value, size=size), value=value, threshold=threshold)


def decayed_sums(df: DataFrame, *, keys: list[str], time: str, tie: list[str], amounts: dict[str, Column], beta: float, rows: int | None = None, blocks: int | None = None) -> DataFrame:
    """Exponentially decayed sums of a key's amounts after each row: c becomes c * beta^(seconds since) + amount.

    A key's timeline is cut into segments over which weights stay inside a double. In a segment a sum is a running
    sum of amounts grown by their age, decayed back; across segments it is the total of the two segments
    before: what is older has decayed under the least double. Times may be any whole numbers. A null
    amount counts 0; a row without a time takes no part and gets null.
    """
    span = max(1, int(500 / abs(math.log(beta))))
    whole = beta**span
    names, extra = list(amounts), {n: f"_g_{n}" for n in amounts}
    at = F.col(time) - F.col("_seg") * span
    grown = df.select("*", *[a.cast("double").alias(extra[n]) for n, a in amounts.items()]).withColumn("_seg", F.floor(F.col(time) / span))
    grown = grown.select("*", *[(F.coalesce(extra[n], F.lit(0.0)) * F.pow(F.lit(1 / beta), at.cast("double"))).alias(f"_x_{n}") for n in names]).drop(*extra.values())
    blocks = blocks or block_count(df, rows)
    lag = lambda w, n, k, c: F.coalesce(F.sum(c).over(w.orderBy("_seg").rangeBetween(-k, -k)), F.lit(0.0)) * (whole**k)
    back = F.pow(F.lit(beta), at.cast("double"))
    if blocks == 1:
        inside = _over(keys, "_seg").orderBy(time, *tie).rowsBetween(Window.unboundedPreceding, 0)
        sums = [((F.sum(f"_x_{n}").over(inside) + lag(_over(keys), n, 1, F.col(f"_x_{n}")) + lag(_over(keys), n, 2, F.col(f"_x_{n}"))) * back).alias(n) for n in names]
        return grown.select(*df.columns, *sums)
    pieces = bucketed(grown, time, blocks)
    totals = pieces.groupBy(*keys, "_seg", "_bucket").agg(*[F.sum(f"_x_{n}").alias(f"_x_{n}") for n in names])
    earlier = _over(keys, "_seg").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = lambda n: F.coalesce(F.sum(f"_x_{n}").over(earlier), F.lit(0.0)) + lag(_over(keys), n, 1, F.col(f"_x_{n}")) + lag(_over(keys), n, 2, F.col(f"_x_{n}"))
    carries = totals.select(*keys, "_seg", "_bucket", *[carry(n).alias(f"_x_{n}") for n in names])
    carries = carries.where(reduce(or_, [F.col(f"_x_{n}") != 0 for n in names]))
    w = _over(keys, "_seg", "_bucket").orderBy("_row", time, *tie).rowsBetween(Window.unboundedPreceding, 0)
    both = _with_carries(pieces, carries, [*keys, "_seg", "_bucket"], blocks).select("*", *[(F.sum(f"_x_{n}").over(w) * back).alias(f"_y_{n}") for n in names])
    return both.where("_row").select(*df.columns, *[F.col(f"_y_{n}").alias(n) for n in names])


def decayed(df: DataFrame, *, keys: list[str], time: str, tie: list[str], amount: Column, beta: float, out: str, rows: int | None = None, blocks: int | None = None) -> DataFrame:
    """One decayed sum, as ``decayed_sums``."""
    return decayed_sums(df, keys=keys, time=time, tie=tie, amounts={out: amount}, beta=beta, rows=rows, blocks=blocks)


def asof_latest(left: DataFrame, right: DataFrame, *, order: list[str], value: str, key: list[str] | None = None, rows: int | None = None, blocks: int | None = None) -> DataFrame:
    """Each left row with the latest ``value`` of the right rows at or before it in ``order`` (right first on ties); null values are passed over.

    Both sides are one ordered table; each bucket of the first order column starts from the last value of the buckets before it.
    """
    keys = key or []
    both = left.withColumn("_side", F.lit(1)).withColumn(value, F.lit(None).cast(right.schema[value].dataType)).unionByName(right.select(*keys, *order, value).withColumn("_side", F.lit(0)), allowMissingColumns=True)
    blocks = blocks or block_count(both, rows)
    newest = lambda w: F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    if blocks == 1:
        return both.withColumn(value, newest(_over(keys).orderBy(*order, "_side"))).where("_side = 1").select(*left.columns, value)
    pieces = bucketed(both, order[0], blocks)
    known = F.when(F.col(value).isNotNull(), F.struct(*order))
    lasts = pieces.groupBy(*keys, "_bucket").agg(F.max_by(value, known).alias("_last"))
    before = _over(keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carries = lasts.select(*keys, "_bucket", F.last("_last", ignorenulls=True).over(before).alias(value))
    filled = _with_carries(pieces, carries, [*keys, "_bucket"], blocks).withColumn(value, newest(_over(keys, "_bucket").orderBy("_row", *order, "_side")))
    return filled.where("_row and _side = 1").select(*left.columns, value)


def ewma_global(df: DataFrame, *, order: str, tie: list[str], value: str, age: float = 86400.0, warm: float = 10.0, out: str = "average", rows: int | None = None) -> DataFrame:
    """Exponentially weighted mean of a whole stream, row by row, without a one-task window.

    Values add up until their sum passes ``warm``; that sum is the seed, and rows before it read 0. From there each row
    weighs 2 / (age + 1). A mean at or under ``warm`` reads 0. Rows are numbered globally; the mean is a
    sum decayed by row number. A null value counts 0. Only the seed, two numbers, reaches the driver.
    """
    alpha, blocks = 2 / (age + 1), block_count(df, rows)
    lines = held(running(df, [], order, tie, count="_n", sums={"_run": F.coalesce(F.col(value).cast("double"), F.lit(0.0))}, blocks=blocks), blocks)
    seed = lines.where(F.col("_run") > warm).agg(F.min(F.struct("_n", "_run")).alias("s")).first()["s"]
    if seed is None:
        return df.withColumn(out, F.lit(0.0))
    amount = F.when(F.col("_n") == seed["_n"], seed["_run"]).when(F.col("_n") > seed["_n"], alpha * F.col(value)).otherwise(0.0)
    mean = decayed(lines, keys=[], time="_n", tie=[], amount=amount, beta=1 - alpha, out="_mean", blocks=blocks)
    return mean.withColumn(out, F.when(F.col("_mean") > warm, F.col("_mean")).otherwise(0.0)).select(*[c for c in df.columns if c != out], out)


def quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], *, rows: int | None = None) -> DataFrame:
    """Exact quantiles of each key's values, between neighbours linearly; nulls count nothing.

    Distinct values with their counts are numbered along the order, and the two values at each quantile's ranks picked, so
    that no task holds a key's values. Returns the keys, ``n`` (values that count) and a column for each of ``shares``.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    blocks = block_count(counts, rows)
    counts = held(counts, blocks)
    ranked = running(counts, keys, "_v", [], sums={"_upto": F.col("_c")}, blocks=blocks)
    totals = counts.groupBy(*keys).agg(F.sum("_c").alias("n"))
    if blocks == 1:
        ranked = ranked.withColumn("n", F.sum("_c").over(_over(keys)))
    elif keys:
        ranked = ranked.alias("r").join(totals.alias("t"), [F.col(f"r.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys]).select("r.*", "t.n")
    else:
        ranked = ranked.join(F.broadcast(totals))  # one row
    at = lambda rank: F.max(F.when((F.col("_upto") - F.col("_c") <= rank) & (rank < F.col("_upto")), F.col("_v").cast("double")))
    place = lambda p: F.lit(p) * (F.col("n") - 1)
    found = ranked.groupBy(*keys).agg(F.max("n").alias("n"), *[at(f(place(p))).alias(f"_{side}_{name}") for name, p in shares.items() for side, f in (("lo", F.floor), ("hi", F.ceil))])
    return found.select(*keys, "n", *[(F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * (place(p) - F.floor(place(p)))).alias(name) for name, p in shares.items()])


def key_dictionary(df: DataFrame, *, key: str, order: str) -> DataFrame:
    """Dense ids of keys in order of first appearance; ties go by key."""
    firsts = df.groupBy(key).agg(F.min(order).alias("first"))
    return numbered(firsts, [], "first", [key], out="key_id").withColumn("key_id", F.col("key_id") - 1)
