"""Call-record scores: decayed rates per caller, ratios of them, and their weighted sum."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ratio_score, safe_ratio
from .ordered import asof_latest, block_count, decayed, decayed_sums, ewma_global, numbered

#: Decay of a second, for short and day-long rates.
BETA, BETA_DAY = 0.9672, 0.9917
#: Bounds of the ratio scores and weights of the sum.
BOUNDS = {"acd": (5.0, 10.0), "url": (0.5, 1.0), "fofir": (2.0, 10.0)}
WEIGHTS = {"fofir": 2.0, "url": 3.0, "acd": 3.0}
_ORDER = {"time": "answer_ts", "tie": ["call_id"]}


def _unit(beta: float):
    """What one call adds to a decayed count."""
    return -F.log(F.lit(beta))


def dup_by_role(calls: DataFrame) -> DataFrame:
    """Each call twice: under its caller and under its callee."""
    roles = F.array(F.struct(F.lit("caller").alias("role"), F.col("calling").alias("party")), F.struct(F.lit("callee").alias("role"), F.col("called").alias("party")))
    return calls.withColumn("r", F.explode(roles)).select(*calls.columns, "r.role", "r.party")


def new_pair_flag(calls: DataFrame, *, rows: int | None = None) -> DataFrame:
    """Calls with ``new_callee``: the first of their caller and callee by time and id.

    A pair's calls are numbered, so that repeated and null ids keep their own rows; a busy pair is split like any hot key. A null caller
    or callee makes a pair like any other, and calls without a time come first.
    """
    return numbered(calls, ["calling", "called"], "answer_ts", ["call_id"], out="_n", rows=rows).withColumn("new_callee", F.col("_n") == 1).drop("_n")


def decayed_count(calls: DataFrame, *, beta: float = BETA, out: str = "rate", new_only: bool = False) -> DataFrame:
    """Decayed count of a caller's established calls (of those to new callees) after each of them."""
    rows = calls.where("established and new_callee" if new_only else "established")
    return decayed(rows, keys=["calling"], amount=_unit(beta), beta=beta, out=out, **_ORDER)


def decayed_sum(calls: DataFrame, *, beta: float = BETA_DAY, out: str = "talk") -> DataFrame:
    """Decayed talk time of a caller's established calls to new callees, after each of them."""
    return decayed(calls.where("established and new_callee"), keys=["calling"], amount=F.col("duration") * _unit(beta), beta=beta, out=out, **_ORDER)


def reciprocal_rate(calls: DataFrame, *, beta: float = BETA, out: str = "received") -> DataFrame:
    """For each established call the decayed count of calls its caller has received by then; calls to oneself give none."""
    rows = dup_by_role(calls.where("established and calling <> called"))
    both = decayed(rows.withColumn("_q", F.when(F.col("role") == "callee", 1.0).otherwise(0.0)), keys=["party"], amount=F.col("_q") * _unit(beta), beta=beta, out=out, **_ORDER)
    return both.where("role = 'caller'").select(*calls.columns, out)


def global_acd(calls: DataFrame, *, out: str = "global_acd") -> DataFrame:
    """Weighted mean duration of all calls after each call."""
    return ewma_global(calls, order="answer_ts", tie=["call_id"], value="duration", out=out)


def score_join2(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two tagged values of one call."""
    return left.join(right, ["calling", "answer_ts", "call_id"])


def fofir_score(ecr: DataFrame, rcr: DataFrame) -> DataFrame:
    both = score_join2(ecr.select("calling", "answer_ts", "call_id", "ecr"), rcr.select("calling", "answer_ts", "call_id", "rcr"))
    return both.withColumn("fofir", ratio_score(*BOUNDS["fofir"], safe_ratio(F.col("ecr"), F.col("rcr"))))


def url_score(encr: DataFrame, ecr: DataFrame) -> DataFrame:
    both = score_join2(encr.select("calling", "answer_ts", "call_id", "encr"), ecr.select("calling", "answer_ts", "call_id", "ecr"))
    return both.withColumn("url", ratio_score(*BOUNDS["url"], safe_ratio(F.col("encr"), F.col("ecr"))))


def acd_score(ct24: DataFrame, ecr24: DataFrame, calls: DataFrame) -> DataFrame:
    """Decayed talk time over decayed count, over the latest global mean."""
    both = score_join2(ct24.select("calling", "answer_ts", "call_id", "ct24"), ecr24.select("calling", "answer_ts", "call_id", "ecr24"))
    latest = asof_latest(both, global_acd(calls).select("answer_ts", "call_id", "global_acd"), order=["answer_ts", "call_id"], value="global_acd")
    return latest.withColumn("acd", ratio_score(*BOUNDS["acd"], safe_ratio(safe_ratio(F.col("ct24"), F.col("ecr24")), F.col("global_acd"))))


def acd_scores(calls: DataFrame, *, rows: int | None = None) -> DataFrame:
    """``acd_score`` of flagged calls from one pass over each caller's timeline, the global mean standing beside each call."""
    blocks = block_count(calls, rows)
    timed = global_acd(calls).where("established")
    amounts = {"ecr24": _unit(BETA_DAY), "ct24": F.when(F.col("new_callee"), F.col("duration")).otherwise(0) * _unit(BETA_DAY)}
    both = decayed_sums(timed, keys=["calling"], amounts=amounts, beta=BETA_DAY, rows=rows, blocks=blocks, **_ORDER).where("new_callee")
    acd = ratio_score(*BOUNDS["acd"], safe_ratio(safe_ratio(F.col("ct24"), F.col("ecr24")), F.col("global_acd")))
    return both.select("calling", "answer_ts", "call_id", "ct24", "ecr24", "global_acd", acd.alias("acd"))


def score_join3(fofir: DataFrame, url: DataFrame, acd: DataFrame, *, compat_emit_zeros: bool = False) -> DataFrame:
    """Weighted sum of a call's three scores, once all are there.

    With ``compat_emit_zeros`` each of the three arrivals emits a zero instead, as a check before storing does.
    """
    on = ["calling", "answer_ts", "call_id"]
    if compat_emit_zeros:
        zeros = [s.select(*on, F.lit(0.0).alias("score")) for s in (fofir, url, acd)]
        return zeros[0].unionByName(zeros[1]).unionByName(zeros[2])
    all3 = fofir.select(*on, "fofir").join(url.select(*on, "url"), on).join(acd.select(*on, "acd"), on)
    return all3.withColumn("score", sum(F.col(k) * w for k, w in WEIGHTS.items())).select(*on, "fofir", "url", "acd", "score")


def call_rates(calls: DataFrame) -> DataFrame:
    """The five decayed rates of each established call between two parties (columns as in ``call_scores``), from one timeline a party.

    A party's timeline holds its calls in both roles; each rate counts the rows that are its own.
    """
    blocks = 2 * block_count(calls)
    rows = dup_by_role(calls.where("established")).where("role = 'caller' or calling <> called")
    counts = lambda c: F.when(c, 1.0).otherwise(0.0)
    made, fresh = F.col("role") == "caller", (F.col("role") == "caller") & F.col("new_callee")
    by = {"keys": ["party"], "blocks": 1 if blocks == 2 else blocks, **_ORDER}
    short = decayed_sums(rows, amounts={"ecr": counts(made) * _unit(BETA), "encr": counts(fresh) * _unit(BETA), "rcr": counts(~made) * _unit(BETA)}, beta=BETA, **by)
    both = decayed_sums(short, amounts={"ecr24": counts(made) * _unit(BETA_DAY), "ct24": counts(fresh) * F.col("duration") * _unit(BETA_DAY)}, beta=BETA_DAY, **by)
    return both.where("role = 'caller' and calling <> called").drop("role", "party")


def call_scores(calls: DataFrame) -> DataFrame:
    """The whole graph: the variants of operator order are routing only and share this plan.

    A call has all three scores if it is established, to a new callee and not to its own caller. Its rates come from one
    pass over its parties' timelines, and the global mean stands beside each call, so that nothing is joined again.
    """
    flagged = new_pair_flag(global_acd(calls.select("call_id", "calling", "called", "answer_ts", "duration", "established")))
    rates = call_rates(flagged).where("new_callee")
    fofir = ratio_score(*BOUNDS["fofir"], safe_ratio(F.col("ecr"), F.col("rcr")))
    url = ratio_score(*BOUNDS["url"], safe_ratio(F.col("encr"), F.col("ecr")))
    acd = ratio_score(*BOUNDS["acd"], safe_ratio(safe_ratio(F.col("ct24"), F.col("ecr24")), F.col("global_acd")))
    scored = rates.select("calling", "answer_ts", "call_id", fofir.alias("fofir"), url.alias("url"), acd.alias("acd"))
    return scored.withColumn("score", sum(F.col(k) * w for k, w in WEIGHTS.items()))


def first_seen_window(calls: DataFrame) -> DataFrame:
    """``new_pair_flag`` by a window, for checking."""
    w = Window.partitionBy("calling", "called").orderBy("answer_ts", "call_id")
    return calls.withColumn("new_callee", F.row_number().over(w) == 1)
