"""Queries over call records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ordered, voip
from ..sources import derive
from .registry import CALLS, query

_FLAGGED = CALLS + ", f AS (SELECT *, row_number() OVER (PARTITION BY calling, called ORDER BY answer_ts, call_id) = 1 AS new_callee FROM c)"


def _decay(name: str, beta: float, where: str, amount: str) -> str:
    """The closed form: a self-join of a caller's rows."""
    return f"""{name} AS (SELECT b.call_id, b.calling, b.answer_ts, sum({amount} * -ln({beta}) * pow({beta}, (b.answer_ts - a.answer_ts)::DOUBLE)) AS {name}
    FROM (SELECT * FROM f WHERE {where}) b JOIN (SELECT * FROM f WHERE {where}) a ON a.calling = b.calling AND (a.answer_ts, a.call_id) <= (b.answer_ts, b.call_id) GROUP BY ALL)"""


_ECR = _decay("ecr", voip.BETA, "established", "1")
_ECR24 = _decay("ecr24", voip.BETA_DAY, "established", "1")
_ENCR = _decay("encr", voip.BETA, "established AND new_callee", "1")
_CT24 = _decay("ct24", voip.BETA_DAY, "established AND new_callee", "a.duration")
_RCR = f"""rcr AS (SELECT b.call_id, b.calling, b.answer_ts, coalesce(sum(-ln({voip.BETA}) * pow({voip.BETA}, (b.answer_ts - a.answer_ts)::DOUBLE)), 0) AS rcr
    FROM (SELECT * FROM f WHERE established AND calling <> called) b LEFT JOIN (SELECT * FROM f WHERE established AND calling <> called) a ON a.called = b.calling AND (a.answer_ts, a.call_id) <= (b.answer_ts, b.call_id) GROUP BY ALL)"""
_GLOBAL = """n AS (SELECT *, row_number() OVER o AS i, sum(duration) OVER o AS run FROM c WINDOW o AS (ORDER BY answer_ts, call_id)),
    seed AS (SELECT min(i) AS si, min_by(run, i) AS sv FROM n WHERE run > 10),
    g AS (SELECT b.call_id, b.answer_ts, CASE WHEN m > 10 THEN m ELSE 0 END AS global_acd FROM
      (SELECT b.call_id, b.answer_ts, CASE WHEN b.i < si THEN 0 ELSE pow(1 - {a}, (b.i - si)::DOUBLE) * sv + pow(1 - {a}, (b.i)::DOUBLE) * coalesce(sum(CASE WHEN b.i > si THEN {a} * b.duration * pow(1 - {a}, -(b.i)::DOUBLE) END) OVER (ORDER BY b.i), 0) END AS m FROM n b, seed) b)""".replace("{a}", "(2.0 / 86401.0)")


def _six(df, *names):
    return [F.round(n, 6).alias(n) for n in names]


@query(f"WITH {CALLS} SELECT * FROM c")
def cdr_feed(spark, sf):
    return derive.cdr(spark, sf)


@query(f"WITH {CALLS} SELECT call_id, duration FROM c WHERE established")
def filter_established(spark, sf):
    return derive.cdr(spark, sf).where("established").select("call_id", "duration")


@query(f"WITH {CALLS} SELECT call_id, 'caller' AS role, calling AS party FROM c UNION ALL SELECT call_id, 'callee', called FROM c")
def dup_by_role(spark, sf):
    return voip.dup_by_role(derive.cdr(spark, sf)).select("call_id", "role", "party")


@query(f"WITH {_FLAGGED} SELECT call_id, calling, called, new_callee FROM f")
def new_pair_flag(spark, sf):
    return voip.new_pair_flag(derive.cdr(spark, sf)).select("call_id", "calling", "called", "new_callee")


def _rates(spark, sf):
    return voip.new_pair_flag(derive.cdr(spark, sf))


@query(f"WITH {_FLAGGED}, {_ECR} SELECT call_id, calling, round(ecr, 6) AS ecr FROM ecr")
def decayed_count(spark, sf):
    df = voip.decayed_count(_rates(spark, sf), out="ecr")
    return df.select("call_id", "calling", *_six(df, "ecr"))


@query(f"WITH {_FLAGGED}, {_ECR24} SELECT call_id, calling, round(ecr24, 6) AS ecr24 FROM ecr24")
def decayed_count_24h(spark, sf):
    df = voip.decayed_count(_rates(spark, sf), beta=voip.BETA_DAY, out="ecr24")
    return df.select("call_id", "calling", *_six(df, "ecr24"))


@query(f"WITH {_FLAGGED}, {_ENCR} SELECT call_id, calling, round(encr, 6) AS encr FROM encr")
def decayed_count_new(spark, sf):
    df = voip.decayed_count(_rates(spark, sf), out="encr", new_only=True)
    return df.select("call_id", "calling", *_six(df, "encr"))


@query(f"WITH {_FLAGGED}, {_CT24} SELECT call_id, calling, round(ct24, 4) AS ct24 FROM ct24")
def decayed_sum(spark, sf):
    return voip.decayed_sum(_rates(spark, sf), out="ct24").select("call_id", "calling", F.round("ct24", 4).alias("ct24"))


@query(f"WITH {_FLAGGED}, {_RCR} SELECT call_id, calling, round(rcr, 6) AS rcr FROM rcr")
def reciprocal_rate(spark, sf):
    df = voip.reciprocal_rate(derive.cdr(spark, sf), out="rcr")
    return df.select("call_id", "calling", *_six(df, "rcr"))


@query(f"WITH {CALLS}, {_GLOBAL} SELECT call_id, answer_ts, round(global_acd, 3) AS global_acd FROM g")
def ewma_global(spark, sf):
    return voip.global_acd(derive.cdr(spark, sf)).select("call_id", "answer_ts", F.round("global_acd", 3).alias("global_acd"))


_PAIR = "ecr JOIN rcr USING (call_id, calling, answer_ts)"


@query(f"WITH {_FLAGGED}, {_ECR}, {_RCR} SELECT call_id, calling, answer_ts, round(ecr, 6) AS ecr, round(rcr, 6) AS rcr FROM {_PAIR}")
def score_join2(spark, sf):
    calls = _rates(spark, sf)
    both = voip.score_join2(voip.decayed_count(calls, out="ecr").select("call_id", "calling", "answer_ts", "ecr"), voip.reciprocal_rate(calls, out="rcr").select("call_id", "calling", "answer_ts", "rcr"))
    return both.select("call_id", "calling", "answer_ts", *_six(both, "ecr", "rcr"))


_FOFIR = f"fofir AS (SELECT call_id, calling, answer_ts, CASE WHEN rcr <> 0 THEN greatest(0, least(1, ecr / rcr / 10.0)) WHEN ecr > 0 THEN 1 END AS fofir FROM {_PAIR})"
_URL = "url AS (SELECT call_id, calling, answer_ts, CASE WHEN ecr <> 0 THEN greatest(0, least(1, encr / ecr / 1.0)) WHEN encr > 0 THEN 1 END AS url FROM encr JOIN ecr USING (call_id, calling, answer_ts))"
_ACD = "acd AS (SELECT call_id, calling, answer_ts, CASE WHEN global_acd <> 0 THEN greatest(0, least(1, ct24 / ecr24 / global_acd / 10.0)) WHEN ct24 / ecr24 > 0 THEN 1 END AS acd FROM ct24 JOIN ecr24 USING (call_id, calling, answer_ts) JOIN g USING (call_id, answer_ts))"


@query(f"WITH {_FLAGGED}, {_ECR}, {_RCR}, {_FOFIR} SELECT call_id, round(fofir, 6) AS fofir FROM fofir")
def fofir_score(spark, sf):
    calls = _rates(spark, sf)
    df = voip.fofir_score(voip.decayed_count(calls, out="ecr"), voip.reciprocal_rate(calls, out="rcr"))
    return df.select("call_id", *_six(df, "fofir"))


@query(f"WITH {_FLAGGED}, {_ECR}, {_ENCR}, {_URL} SELECT call_id, round(url, 6) AS url FROM url")
def url_score(spark, sf):
    calls = _rates(spark, sf)
    df = voip.url_score(voip.decayed_count(calls, out="encr", new_only=True), voip.decayed_count(calls, out="ecr"))
    return df.select("call_id", *_six(df, "url"))


@query(f"WITH {_FLAGGED}, {_CT24}, {_ECR24}, {_GLOBAL}, {_ACD} SELECT call_id, round(acd, 5) AS acd FROM acd")
def acd_score(spark, sf):
    return voip.acd_scores(_rates(spark, sf)).select("call_id", F.round("acd", 5).alias("acd"))


_ALL = f"WITH {_FLAGGED}, {_ECR}, {_ECR24}, {_ENCR}, {_CT24}, {_RCR}, {_GLOBAL}, {_FOFIR}, {_URL}, {_ACD} SELECT call_id, calling, answer_ts, round(2 * fofir + 3 * url + 3 * acd, 4) AS score FROM fofir JOIN url USING (call_id, calling, answer_ts) JOIN acd USING (call_id, calling, answer_ts)"


@query(_ALL)
def score_join3(spark, sf):
    df = voip.call_scores(derive.cdr(spark, sf))
    return df.select("call_id", "calling", "answer_ts", F.round("score", 4).alias("score"))


@query(_ALL.replace("SELECT call_id, calling, answer_ts, round(", "SELECT calling, count(*) AS calls, round(avg(").replace(", 4) AS score FROM", "), 3) AS mean_score FROM") + " GROUP BY calling")
def vs_pipeline(spark, sf):
    df = voip.call_scores(derive.cdr(spark, sf))
    return df.groupBy("calling").agg(F.count("*").alias("calls"), F.round(F.avg("score"), 3).alias("mean_score"))


@query(f"WITH {CALLS} SELECT call_id, CASE WHEN v >= 0 THEN round(greatest(0, least(1, v / 10.0)), 6) END AS score FROM (SELECT call_id, duration / 600.0 AS v FROM c)")
def ratio_score(spark, sf):
    from ..functions import ratio_score as score

    return derive.cdr(spark, sf).select("call_id", F.round(score(5.0, 10.0, F.col("duration") / 600.0), 6).alias("score"))




@query(f"WITH {CALLS}, o AS (SELECT call_id, established, last_value(CASE WHEN established THEN duration END IGNORE NULLS) OVER (ORDER BY answer_ts, call_id) AS duration FROM c) SELECT call_id, coalesce(duration, -1) AS duration FROM o WHERE NOT established")
def broadcast_latest(spark, sf):
    calls = derive.cdr(spark, sf)
    left = calls.where("not established").select("call_id", "answer_ts")
    return ordered.asof_latest(left, calls.where("established"), order=["answer_ts", "call_id"], value="duration").select("call_id", F.coalesce("duration", F.lit(-1)).alias("duration"))
