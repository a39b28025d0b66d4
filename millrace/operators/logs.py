"""Web-log counts, address lookup, machine outliers, bandit learning, and metrics over results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ads import BROADCAST_ROWS, sized
from .ordered import along, asof_latest, block_count, held, only_own, quantiles, running

#: Blocks of a level that are broadcast. Of 32 bits, levels with more have at most 18, so that a block there holds 262,144 bounds at most.
FEW_BLOCKS = 10_000


def volume_per_minute(rows: DataFrame, *, time: str = "et") -> DataFrame:
    return rows.groupBy((F.floor(F.col(time) / 60) * 60).alias("minute")).agg(F.count("*").alias("requests"))


def status_count(rows: DataFrame, *, status: str = "status") -> DataFrame:
    return rows.groupBy(status).agg(F.count("*").alias("requests"))


def geo_stats(rows: DataFrame) -> DataFrame:
    """Requests by country and city, with totals of countries and of all."""
    return rows.rollup("country", "city").agg(F.count("*").alias("requests"), F.grouping_id().cast("int").alias("level"))


def aligned_blocks(ranges: DataFrame, *, bits: int = 32) -> DataFrame:
    """Ranges (lo, hi) as the fewest aligned blocks, two at most for each power of two that fits in: ``_level`` and ``_prefix``, the block's number at that level."""
    level = F.col("_level")
    size = F.expr("shiftleft(1L, _level)")
    first, end = F.expr("lo div shiftleft(1L, _level)") + F.when(F.col("lo") % size != 0, 1).otherwise(0), F.expr("(hi + 1) div shiftleft(1L, _level)")
    most = F.least(F.lit(bits), F.expr("length(bin(hi - lo + 1)) - 1"))  # no wider block fits in
    spread = ranges.where("lo <= hi").withColumn("_level", F.explode(F.sequence(F.lit(0), most))).withColumn("_l", first).withColumn("_r", end)
    left = F.when((F.col("_l") < F.col("_r")) & (F.col("_l") % 2 == 1), F.array("_l")).otherwise(F.array().cast("array<bigint>"))
    after = F.col("_l") + F.col("_l") % 2
    right = F.when((after < F.col("_r")) & (F.col("_r") % 2 == 1), F.array(F.col("_r") - 1)).otherwise(F.array().cast("array<bigint>"))
    return spread.withColumn("_prefix", F.explode(F.concat(left, right))).drop("_l", "_r").withColumn("_level", level)


def disjoint_ranges(ranges: DataFrame, *, bits: int = 32) -> DataFrame:
    """Where another range begins to be the narrowest one: ``_from`` and ``_range``, a struct of that range's columns, or null where none holds.

    Of equally narrow ranges that of the greater ``lo`` counts, then that of the least other columns. Only the ranges' own bounds are looked up, each at the
    levels that blocks have, so that a range over everything costs no more than another; a block keeps its narrowest range alone. Levels of few blocks
    are broadcast, since all bounds may meet in one of them.
    """
    narrowest = F.min(F.struct((F.col("hi") - F.col("lo")).alias("w"), (-F.col("lo")).alias("l"), "_all")).alias("_m")
    counts = aligned_blocks(ranges.select("lo", "hi"), bits=bits).groupBy("_level").agg(F.approx_count_distinct("_prefix").alias("n")).collect()  # 63 rows at most
    filed = aligned_blocks(ranges.select("lo", "hi", F.struct(*ranges.columns).alias("_all")), bits=bits).groupBy("_level", "_prefix").agg(narrowest)
    bounds = ranges.where("lo <= hi").select(F.explode(F.array(F.col("lo").cast("long"), (F.col("hi") + 1).cast("long"))).alias("_from")).distinct()

    def looked_up(levels: list[int], met) -> DataFrame:
        asked = bounds.withColumn("_level", F.explode(F.array(*[F.lit(v) for v in levels]) if levels else F.array().cast("array<int>"))).withColumn("_prefix", F.expr("_from div shiftleft(1L, _level)"))
        return asked.join(met(filed.where(F.col("_level").isin(levels))), ["_level", "_prefix"]).select("_from", "_m")

    found = looked_up(sorted(r["_level"] for r in counts if r["n"] > FEW_BLOCKS), lambda b: b).unionByName(looked_up(sorted(r["_level"] for r in counts if r["n"] <= FEW_BLOCKS), F.broadcast))
    # a bound that no range holds keeps its row of nothing
    return found.unionByName(bounds, allowMissingColumns=True).groupBy("_from").agg(F.min("_m").alias("_m")).select("_from", F.col("_m._all").alias("_range"))


def ip_geo_lookup(rows: DataFrame, ranges: DataFrame, *, ip: str = "ip_num", bits: int = 32, block: int | None = None) -> DataFrame:
    """Rows with the columns of the narrowest range (lo, hi, both included) that holds their address; rows without one drop, and so do those without an address.

    Ranges may nest and overlap: they are cut into disjoint ones first. Distinct addresses are looked up as of the last cut before them,
    and rows meet their address by a join, so that neither a frequent address nor a wide range is one task's work. Addresses are whole
    numbers of ``bits`` bits, 62 at most.
    """
    named = [c for c in ranges.columns if c not in ("lo", "hi")]
    # each is read several times
    blocks = block_count(ranges, block)
    ranges = held(ranges, blocks)
    cuts = held(disjoint_ranges(ranges, bits=bits).select(F.col("_from").alias("_ip"), F.coalesce("_range", F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in ranges.schema])).alias("_range")), blocks)
    asked = rows.where(F.col(ip).isNotNull()).select(F.col(ip).cast("long").alias("_ip")).distinct()
    asked = held(asked, block_count(asked, block))
    known = asof_latest(asked, cuts, order=["_ip"], value="_range", rows=block).where("_range.lo is not null")
    few = asked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    met = rows.withColumn("_ip", F.col(ip).cast("long")).join(F.broadcast(known) if few else known, "_ip")
    return met.select(*rows.columns, *[F.col("_range")[c].alias(c) for c in named])


def observation_score(rows: DataFrame, *, slot: str = "slot", machine: str = "machine", value: str = "value", block: int | None = None) -> DataFrame:
    """Mean distance of a machine's values from the median of all values in its slot; rows without a slot take no part."""
    medians = quantiles(rows, [slot], value, {"_median": 0.5}, rows=block).drop("n")
    return rows.join(sized(medians), slot).groupBy(slot, machine).agg(F.avg(F.abs(F.col(value) - F.col("_median"))).alias("score"))


def sliding_score_sum(scores: DataFrame, *, size: int = 5, slot: str = "slot", machine: str = "machine", score: str = "score") -> DataFrame:
    """Sum of a machine's last ``size`` scores."""
    rows, w = along(scores, [machine], slot, [], size - 1)
    return only_own(rows.withColumn("anomaly", F.sum(score).over(w.rowsBetween(1 - size, 0)))).drop("n")


def alert_trigger(scores: DataFrame, *, k: int = 3, slot: str = "slot", machine: str = "machine", score: str = "anomaly") -> DataFrame:
    """The ``k`` highest scores of each slot, ties by machine."""
    w = Window.partitionBy(slot).orderBy(F.col(score).desc(), machine)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def bandit_learner(events: DataFrame, rewards: DataFrame, *, order: list[str], actions: int, bonus: float = 2.0, rows: int | None = None) -> DataFrame:
    """The action that an upper confidence bound picks at each event, from the rewards before it.

    Rewards have the columns of ``order``, ``action`` and ``reward``. Each action's running count and mean come as-of
    each event; an action without a reward is tried first, the lowest first. No randomness. Events without a
    place in the order count as one.
    """
    totals = running(rewards, ["action"], order[0], order[1:], count="pulls", sums={"_total": F.col("reward")}, rows=rows)
    # a reward at the same point in the order is not yet known
    state = totals.select("action", *order, F.struct("pulls", "_total").alias("state")).withColumn(order[-1], F.col(order[-1]) + 1)
    asked = events.select(*order, F.explode(F.sequence(F.lit(0), F.lit(actions - 1))).alias("action"))
    known = asof_latest(asked, state, order=order, value="state", key=["action"], rows=rows)
    # one row for each action: a bounded list
    choices = known.groupBy(*order).agg(F.collect_list(F.struct("action", F.coalesce("state.pulls", F.lit(0)).alias("pulls"), F.coalesce("state._total", F.lit(0.0)).alias("total"))).alias("c"))
    choices = choices.withColumn("_all", F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x["pulls"]))
    reach = lambda x: F.try_divide(x["total"], x["pulls"]) + F.sqrt(F.try_divide(bonus * F.log(F.greatest("_all", F.lit(1)).cast("double")), x["pulls"]))
    bound = lambda x: F.when(x["pulls"] == 0, F.lit(float("inf"))).otherwise(F.round(reach(x), 9))
    return choices.select(*order, (-F.array_max(F.transform("c", lambda x: F.struct(bound(x).alias("bound"), (-x["action"]).alias("a"))))["a"]).alias("action"))


def latency_summary(rows: DataFrame, *, latency: str = "latency", block: int | None = None) -> DataFrame:
    """Count, mean, least, greatest and exact percentiles of a latency column; no task holds all its values."""
    s = rows.agg(F.count(latency).alias("n"), F.avg(latency).alias("mean"), F.min(latency).cast("double").alias("p0"), F.max(latency).cast("double").alias("p100"))
    ranks = quantiles(rows, [], latency, {f"p{p}": p / 100 for p in (5, 25, 50, 75, 95)}, rows=block).drop("n")
    return s.join(F.broadcast(ranks))  # one row each


def latency_sample(rows: DataFrame, *, time: str, order: str, rate: int) -> DataFrame:
    """At most ``rate`` rows of each second, the first ones."""
    w = Window.partitionBy(time).orderBy(order)
    return rows.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= rate).drop("_i")


def throughput(rows: DataFrame, *, time: str) -> DataFrame:
    """Rows, seconds between first and last, and rows a second."""
    s = rows.agg(F.count("*").alias("n"), (F.max(time) - F.min(time)).alias("seconds"))
    return s.withColumn("per_second", F.try_divide(F.col("n"), F.col("seconds")))
