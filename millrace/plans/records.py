"""Queries over events: sources, advertising, sensors, Markov scores, logs, outliers, metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ads, logs, markov, ordered, traffic
from ..sources import derive, feeds
from .registry import ADS, EVENTS, query

_SENSOR = {"key": "user_id", "order": "us", "tie": ["event_id"], "value": "value"}
_STATES = {"key": "user_id", "order": "us", "tie": ["event_id"], "state": "event_type"}

# ---- sources


@query(f"WITH {EVENTS} SELECT user_id::VARCHAR AS entity, event_id || ',' || event_type AS record FROM ev")
def src_csv_kv(spark, sf):
    e = derive.events(spark, sf)
    return feeds.csv_kv(e.select(F.concat_ws(",", "user_id", "event_id", "event_type").alias("value")))


@query(f"WITH {EVENTS} SELECT user_id::VARCHAR AS device, k AS epoch, event_id::DOUBLE AS value FROM ev WHERE event_id % 10 <> 0")
def src_sensor(spark, sf):
    e = derive.events(spark, sf)
    full = F.concat_ws(" ", F.lit("2024-01-01  00:00:00"), "k", "user_id", "event_id", F.lit("40.5 100 2.5"))
    lines = e.select(F.when(F.col("event_id") % 10 == 0, F.lit("2024-01-01 00:00:00 1")).otherwise(full).alias("value"))
    return feeds.sensor(lines).select("device", "epoch", "value")


@query(f"WITH {EVENTS} SELECT user_id::VARCHAR AS vehicle, k AS nid, event_id / 8.0::DOUBLE AS lat, (event_id % 90)::DOUBLE AS lon, k::DOUBLE AS speed, k AS bearing FROM ev")
def src_taxi(spark, sf):
    e = derive.events(spark, sf)
    lines = e.select(F.concat_ws(",", "user_id", "k", F.lit("2024-01-01"), F.col("event_id") / 8.0, F.col("event_id") % 90, "k", "k").alias("value"))
    return feeds.taxi(lines).drop("date")


@query(f"WITH {EVENTS} SELECT user_id::VARCHAR AS vehicle, k AS nid, (event_id % 60)::DOUBLE AS lat, (event_id % 90)::DOUBLE AS lon, 0.0::DOUBLE AS speed, 0 AS bearing FROM ev")
def src_bus(spark, sf):
    e = derive.events(spark, sf)
    lines = e.select(F.concat_ws(",", "et", "k", F.lit("1,p,f,j,o,0"), F.col("event_id") % 90, F.col("event_id") % 60, F.lit("0,b"), "user_id", F.lit("s,0")).alias("value"))
    return feeds.bus(lines).drop("date")


@query(f"WITH {EVENTS} SELECT user_id::VARCHAR AS calling, k::VARCHAR AS called, et AS answer_ts, k AS duration, event_type <> 'error' AS established FROM ev")
def src_cdr(spark, sf):
    e = derive.events(spark, sf)
    # ISO times with an offset of two hours, from epoch seconds and whatever the session's zone
    at = F.concat(F.date_format(F.expr("timestampadd(SECOND, et + 7200, TIMESTAMP_NTZ'1970-01-01 00:00:00')"), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("+02:00"))
    return feeds.cdr(e.select(F.concat_ws(",", "user_id", "k", at, "k", (F.col("event_type") != "error").cast("string")).alias("value")))


@query(f"WITH {EVENTS} SELECT k AS time, user_id::INTEGER AS vid, k AS speed, 0 AS xway, k % 5 AS lane, 1 AS direction, k // 10 AS segment, k AS position FROM ev WHERE event_id % 3 = 0")
def src_lr(spark, sf):
    e = derive.events(spark, sf)
    lines = e.select(F.concat_ws(",", F.col("event_id") % 3, "k", "user_id", "k", F.lit(0), F.col("k") % 5, F.lit(1), F.floor(F.col("k") / 10), "k").alias("value"))
    return feeds.road_reports(lines)


@query("SELECT event_id AS n, event_id % 100 AS ad_id, CASE event_id % 3 WHEN 0 THEN 'view' WHEN 1 THEN 'click' ELSE 'purchase' END AS event_type, (event_id % 5)::INTEGER AS ad_type FROM events")
def src_rate(spark, sf):
    return feeds.cyclic_ads(derive.events(spark, sf), F.col("event_id"), ads=100)


@query("SELECT event_id % 4 AS shard, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1")
def src_sharded(spark, sf):
    """Four readers, each with the lines that are its own by offset and stride."""
    e = derive.events(spark, sf)
    parts = [feeds.sharded(e, "event_id", offset=k, stride=4).agg(F.lit(k).cast("long").alias("shard"), F.count("*").alias("n"), F.sum("event_id").alias("ids")) for k in range(4)]
    return reduce(DataFrame.unionByName, parts)


@query("SELECT event_id, ('0x' || substr(md5(event_id::VARCHAR), 1, 8))::BIGINT % 32 AS key FROM events")
def src_rekey(spark, sf):
    return feeds.rekey(derive.events(spark, sf), "event_id", 32).select("event_id", "key")


@query(f"WITH {EVENTS} SELECT user_id, row_number() OVER (ORDER BY first, user_id) - 1 AS key_id FROM (SELECT user_id, min(us) AS first FROM ev GROUP BY user_id)")
def key_dictionary(spark, sf):
    return ordered.key_dictionary(derive.events(spark, sf), key="user_id", order="us").select("user_id", "key_id")


_POINT = "('0x' || substr(md5({c}::VARCHAR), 1, 8))::BIGINT % 16"


@query(
    f"""WITH {EVENTS}, p AS (SELECT 'fields' AS how, {_POINT.format(c="user_id")} AS task, user_id FROM ev UNION ALL SELECT 'shuffle', {_POINT.format(c="event_id")}, user_id FROM ev
    UNION ALL SELECT 'all', unnest(range(0, 16)), user_id FROM ev UNION ALL SELECT 'global', 0, user_id FROM ev)
    SELECT how, task, count(*) AS n, count(DISTINCT user_id) AS users FROM p GROUP BY ALL"""
)
def partition_by(spark, sf):
    """Rows and users that each of sixteen tasks gets by the four groupings."""
    e = derive.events(spark, sf).select("event_id", "user_id")
    parts = [feeds.routed(e, how, 16, by=by).withColumn("how", F.lit(how)) for how, by in (("fields", ["user_id"]), ("shuffle", ["event_id"]), ("all", None), ("global", None))]
    users = reduce(DataFrame.unionByName, parts).groupBy("how", "task", "user_id").agg(F.count("*").alias("n"))
    return users.groupBy("how", "task").agg(F.sum("n").alias("n"), F.count("user_id").alias("users"))


# ---- advertising


@query(f"WITH {EVENTS} SELECT event_id, user_id FROM ev WHERE event_type = 'view'")
def filter_event_type(spark, sf):
    return ads.filter_event_type(derive.events(spark, sf)).select("event_id", "user_id")


@query(f"WITH {ADS} SELECT event_id, campaign_id FROM v")
def join_dim_lookup(spark, sf):
    return ads.campaign_views(*derive.ads(spark, sf)).select("event_id", "campaign_id")


def _windows(length: int, slide: int | None = None) -> str:
    if slide is None:
        return f"WITH {ADS} SELECT campaign_id, et // {length} * {length} AS window_start, count(*) AS count, max(us) AS last_us FROM v GROUP BY ALL"
    return f"WITH {ADS}, s AS (SELECT campaign_id, us, et // {slide} * {slide} - {slide} * unnest(range(0, {length // slide})) AS window_start FROM v) SELECT campaign_id, window_start, count(*) AS count, max(us) AS last_us FROM s GROUP BY ALL"


@query(_windows(10))
def win_campaign_count(spark, sf):
    return ads.window_count(ads.campaign_views(*derive.ads(spark, sf)))


@query(_windows(3600))
def win_campaign_count_hour(spark, sf):
    return ads.window_count(ads.campaign_views(*derive.ads(spark, sf)), length="1 hour")


@query(_windows(7200, 1800))
def win_sliding(spark, sf):
    return ads.window_count(ads.campaign_views(*derive.ads(spark, sf)), length="2 hours", slide="30 minutes")


@query(f"WITH {ADS}, g AS (SELECT *, sum(CASE WHEN us - last < 1800000000 THEN 0 ELSE 1 END) OVER (PARTITION BY campaign_id ORDER BY us, event_id) AS s FROM (SELECT *, lag(us) OVER (PARTITION BY campaign_id ORDER BY us, event_id) AS last FROM v)) SELECT campaign_id, min(us) AS session_start_us, count(*) AS count FROM g GROUP BY campaign_id, s")
def win_session(spark, sf):
    return ads.session_count(ads.campaign_views(*derive.ads(spark, sf)), gap="30 minutes")


_ARRIVAL = "a AS (SELECT event_id, et, (event_id * 7919) % 1000 + event_id * 5 AS arrival FROM ev), m AS (SELECT *, max(et) OVER (ORDER BY arrival, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM (SELECT event_id, et, arrival * 1000000 + event_id AS arrival FROM a))"


def _arrivals(spark, sf):
    e = derive.events(spark, sf).select("event_id", "et")
    return e.withColumn("arrival", ((F.col("event_id") * 7919) % 1000 + F.col("event_id") * 5) * 1_000_000 + F.col("event_id"))


@query(f"WITH {EVENTS}, {_ARRIVAL} SELECT event_id, coalesce((et // 3600 + 1) * 3600 <= mark, false) AS late FROM m")
def late_rows(spark, sf):
    return ads.late_rows(_arrivals(spark, sf), time="et", order="arrival", length=3600).select("event_id", "late")


@query(f"WITH {EVENTS}, {_ARRIVAL} SELECT count(*) FILTER (coalesce((et // 3600 + 1) * 3600 <= mark, false)) AS late, count(*) AS rows FROM m")
def snk_late(spark, sf):
    rows = ads.late_rows(_arrivals(spark, sf), time="et", order="arrival", length=3600)
    return rows.agg(F.count_if("late").alias("late"), F.count("*").alias("rows"))


@query(f"WITH {EVENTS}, {_ARRIVAL} SELECT event_id, mark - 60 AS watermark FROM m WHERE mark IS NOT NULL")
def watermark(spark, sf):
    """The watermark in force at each arrival, with a minute's delay."""
    return ads.watermarks(_arrivals(spark, sf), time="et", order="arrival", delay=60).where("watermark is not null").select("event_id", "watermark")


@query(
    f"""WITH RECURSIVE {ADS}, o AS (SELECT campaign_id, et, row_number() OVER (PARTITION BY campaign_id ORDER BY us, event_id) AS i FROM v),
    s(campaign_id, i, start, count, emit, trigger) AS (SELECT campaign_id, i, et, 1, NULL::BIGINT, NULL::BIGINT FROM o WHERE i = 1
      UNION ALL SELECT o.campaign_id, o.i, CASE WHEN o.et >= start + 36000 THEN o.et ELSE start END, CASE WHEN o.et >= start + 36000 THEN 1 WHEN o.et >= start THEN s.count + 1 ELSE s.count END,
        CASE WHEN o.et >= start + 36000 THEN s.count END, CASE WHEN o.et >= start + 36000 THEN o.et END FROM s JOIN o ON o.campaign_id = s.campaign_id AND o.i = s.i + 1)
    SELECT campaign_id, emit AS count, trigger AS trigger_ts FROM s WHERE emit IS NOT NULL"""
)
def win_anchored_count(spark, sf):
    views = ads.campaign_views(*derive.ads(spark, sf))
    return traffic.win_anchored_count(views, key="campaign_id", time="et", order="us", tie=["event_id"], length=36000)


# ---- sensors and Markov scores

_AVG = "o AS (SELECT *, avg(value) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS {n} PRECEDING) AS mean FROM ev)"


def _sensed(spark, sf):
    return derive.events(spark, sf).select("event_id", "user_id", "us", "value")


@query(f"WITH {EVENTS}, {_AVG.format(n=999)} SELECT event_id, user_id, round(mean + 1e-9, 6) AS moving_avg FROM o")
def moving_avg(spark, sf):
    return ordered.moving_avg(_sensed(spark, sf), **_SENSOR).select("event_id", "user_id", F.round(F.col("moving_avg") + 1e-9, 6).alias("moving_avg"))


@query(f"WITH {EVENTS}, {_AVG.format(n=19)} SELECT event_id, round(mean + 1e-9, 6) AS moving_avg FROM o")
def moving_avg_short(spark, sf):
    return ordered.moving_avg(_sensed(spark, sf), size=20, **_SENSOR).select("event_id", F.round(F.col("moving_avg") + 1e-9, 6).alias("moving_avg"))


@query(f"WITH {EVENTS}, {_AVG.format(n=999)} SELECT event_id, user_id, value, round(mean + 1e-9, 6) AS moving_avg FROM o WHERE abs(value - mean) > 0.25 * mean")
def spike_detect(spark, sf):
    return ordered.spike_detect(_sensed(spark, sf), **_SENSOR).select("event_id", "user_id", "value", F.round(F.col("moving_avg") + 1e-9, 6).alias("moving_avg"))


@query(f"WITH {EVENTS}, {_AVG.format(n=999)} SELECT event_id FROM o WHERE abs(value - mean) > 2.0 * mean")
def filter_spike(spark, sf):
    return ordered.filter_spike(ordered.moving_avg(_sensed(spark, sf), **_SENSOR), value="value", threshold=2.0).select("event_id")


_PAIRS = "o AS (SELECT *, lag(event_type) OVER w AS prev, row_number() OVER w AS n FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id))"
_MODEL = _PAIRS + ", mc AS (SELECT prev, event_type AS cur, count(*) AS c FROM o WHERE prev IS NOT NULL GROUP BY ALL), model AS (SELECT prev, cur, c / sum(c) OVER (PARTITION BY prev) AS p FROM mc), tot AS (SELECT prev, sum(p) AS row_total, max(p) AS top FROM model GROUP BY prev), best AS (SELECT prev, min(cur) AS best FROM model JOIN tot USING (prev) WHERE p = top GROUP BY prev)"
_SCORED = _MODEL + ", j AS (SELECT o.*, row_total, coalesce(model.p, 0) AS p, best FROM o LEFT JOIN tot ON tot.prev = o.prev LEFT JOIN best ON best.prev = o.prev LEFT JOIN model ON model.prev = o.prev AND model.cur = o.event_type)"


def _score(expr: str) -> str:
    return _SCORED + f", z AS (SELECT event_id, user_id, n, sum(CASE WHEN prev IS NOT NULL THEN {expr} END) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS 3 PRECEDING) / 4.0 AS score FROM j)"


_MISS, _RATE = "row_total - p", "CASE WHEN best = event_type THEN 0.0 ELSE 1.0 END"


def _states(spark, sf):
    return derive.events(spark, sf).select("event_id", "user_id", "us", "event_type")


def _fitted(spark, sf):
    """Transitions, and the model fitted on them: both come from one shuffle of the events."""
    pairs = markov.transitions(_states(spark, sf), **_STATES)
    return pairs, markov.model_of(pairs, state="event_type")


@query(f"WITH {EVENTS}, {_MODEL} SELECT prev, cur, round(p, 9) AS p FROM model")
def model_fit(spark, sf):
    return markov.model_fit(derive.events(spark, sf), **_STATES).select("prev", "cur", F.round("p", 9).alias("p"))


@query(f"WITH {EVENTS}, s AS (SELECT event_id, row_number() OVER w AS n, string_agg(event_type, '>') OVER (PARTITION BY user_id ORDER BY us, event_id ROWS 4 PRECEDING) AS sequence FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)) SELECT event_id, sequence FROM s WHERE n >= 5")
def state_sequence(spark, sf):
    return markov.state_sequence(derive.events(spark, sf), **_STATES).select("event_id", F.array_join("sequence", ">").alias("sequence"))


@query(f"WITH {EVENTS}, {_SCORED} SELECT event_id, round(p, 6) AS p, round(row_total, 6) AS row_total, best FROM j WHERE prev IS NOT NULL")
def join_model(spark, sf):
    pairs, model = _fitted(spark, sf)
    return markov.join_model(pairs.where("prev is not null"), model, state="event_type").select("event_id", F.round("p", 6).alias("p"), F.round("row_total", 6).alias("row_total"), "best")


def _scores(spark, sf, predictor):
    return markov.fit_and_score(_states(spark, sf), predictor=predictor, **_STATES).select("event_id", "user_id", F.round("score", 6).alias("score"))


@query(f"WITH {EVENTS}, {_score(_MISS)} SELECT event_id, user_id, round(score, 6) AS score FROM z WHERE n >= 5")
def markov_miss_probability(spark, sf):
    return _scores(spark, sf, "miss_probability")


@query(f"WITH {EVENTS}, {_score(_RATE)} SELECT event_id, user_id, round(score, 6)::DOUBLE AS score FROM z WHERE n >= 5")
def markov_miss_rate(spark, sf):
    return _scores(spark, sf, "miss_rate")


@query(f"WITH {EVENTS}, {_score(_RATE)} SELECT event_id, user_id, round(score, 6)::DOUBLE AS score FROM z WHERE n >= 5")
def markov_entropy_reduction(spark, sf):
    return _scores(spark, sf, "entropy_reduction")


@query(f"WITH {EVENTS}, {_MODEL} SELECT prev, round(-sum(p * ln(p)), 6) AS entropy FROM model GROUP BY prev")
def markov_state_entropy(spark, sf):
    return markov.state_entropy(_fitted(spark, sf)[1]).select("prev", F.round("entropy", 6).alias("entropy"))


@query(f"WITH {EVENTS}, {_SCORED} SELECT event_id, round(sum(row_total - p) OVER w / sum(row_total) OVER w, 6) AS score FROM j WHERE prev IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)")
def markov_global_metric(spark, sf):
    pairs, model = _fitted(spark, sf)
    return markov.metric_of(pairs, model, key="user_id", state="event_type").select("event_id", F.round("score", 6).alias("score"))


@query(f"WITH {EVENTS}, {_score(_MISS)} SELECT event_id, user_id, round(score, 6) AS score FROM z WHERE n >= 5 AND score > 0.8")
def fraud_detect(spark, sf):
    return markov.fraud_detect(_states(spark, sf), threshold=0.8, **_STATES).select("event_id", "user_id", F.round("score", 6).alias("score"))


# ---- logs, outliers, bandit


@query(f"WITH {EVENTS} SELECT et // 60 * 60 AS minute, count(*) AS requests FROM ev GROUP BY 1")
def volume_per_minute(spark, sf):
    return logs.volume_per_minute(derive.events(spark, sf))


@query(f"WITH {EVENTS} SELECT 200 + 100 * (k % 4) AS status, count(*) AS requests FROM ev GROUP BY 1")
def status_count(spark, sf):
    return logs.status_count(derive.events(spark, sf).withColumn("status", 200 + 100 * (F.col("k") % 4)))


_RANGES = "rg AS (SELECT DISTINCT user_id // 3 * 3 * 65536 + 10 AS lo, (user_id // 3 * 3 + 3) * 65536 - 1 AS hi, 'c' || (user_id // 3 % 5) AS country, 't' || (user_id // 3) AS city FROM events)"


def _geo(spark, sf):
    e = derive.events(spark, sf).withColumn("ip_num", F.col("user_id") * 65536 + F.col("k"))
    base = F.floor(F.col("user_id") / 3)
    ranges = derive.table(spark, sf, "events").select((base * 3 * 65536 + 10).alias("lo"), ((base * 3 + 3) * 65536 - 1).alias("hi"), F.concat(F.lit("c"), base % 5).alias("country"), F.concat(F.lit("t"), base).alias("city")).distinct()
    return logs.ip_geo_lookup(e, ranges)


@query(f"WITH {EVENTS}, {_RANGES} SELECT event_id, country, city FROM ev JOIN rg ON user_id * 65536 + k BETWEEN lo AND hi")
def ip_geo_lookup(spark, sf):
    return _geo(spark, sf).select("event_id", "country", "city")


_NESTED = "ng AS (SELECT lo, lo + w AS hi, name FROM (SELECT DISTINCT user_id * 65536 + k % 40 AS lo, k % 7 * 11 AS w, 'n' || (k % 5) AS name FROM ev UNION ALL SELECT 0, 4294967295, 'all' UNION ALL SELECT DISTINCT user_id // 4 * 4 * 65536, 4 * 65536 - 1, 'q' || (user_id // 4) FROM ev))"


@query(f"WITH {EVENTS}, {_NESTED} SELECT event_id, name FROM ev JOIN ng ON user_id * 65536 + k BETWEEN lo AND hi QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY hi - lo, -lo, name) = 1")
def ip_geo_nested(spark, sf):
    """The narrowest of nested and overlapping ranges, one of them over all addresses."""
    e = derive.events(spark, sf).withColumn("ip_num", F.col("user_id") * 65536 + F.col("k"))
    base = F.floor(F.col("user_id") / 4)
    low = e.select((F.col("user_id") * 65536 + F.col("k") % 40).alias("lo"), (F.col("k") % 7 * 11).cast("long").alias("w"), F.concat(F.lit("n"), F.col("k") % 5).alias("name")).distinct()
    quads = e.select((base * 4 * 65536).alias("lo"), F.lit(4 * 65536 - 1).cast("long").alias("w"), F.concat(F.lit("q"), base).alias("name")).distinct()
    whole = spark.range(1).select(F.col("id").alias("lo"), F.lit(4294967295).alias("w"), F.lit("all").alias("name"))
    ranges = low.unionByName(quads).unionByName(whole).select("lo", (F.col("lo") + F.col("w")).alias("hi"), "name")
    return logs.ip_geo_lookup(e, ranges).select("event_id", "name")


@query(f"WITH {EVENTS}, {_RANGES} SELECT country, city, count(*) AS requests, grouping(country, city)::INTEGER AS level FROM ev JOIN rg ON user_id * 65536 + k BETWEEN lo AND hi GROUP BY ROLLUP (country, city)")
def geo_stats(spark, sf):
    return logs.geo_stats(_geo(spark, sf))


_OBS = "x AS (SELECT et // 3600 AS slot, user_id % 20 AS machine, value FROM ev), med AS (SELECT slot, median(value) AS m FROM x GROUP BY slot), ob AS (SELECT slot, machine, avg(abs(value - m)) AS score FROM x JOIN med USING (slot) GROUP BY ALL)"
_SUM = _OBS + ", an AS (SELECT slot, machine, sum(score) OVER (PARTITION BY machine ORDER BY slot ROWS 4 PRECEDING) AS anomaly FROM ob)"


def _observed(spark, sf):
    e = derive.events(spark, sf)
    return logs.observation_score(e.select(F.floor(F.col("et") / 3600).alias("slot"), (F.col("user_id") % 20).alias("machine"), "value"))


@query(f"WITH {EVENTS}, {_OBS} SELECT slot, machine, round(score, 6) AS score FROM ob")
def observation_score(spark, sf):
    return _observed(spark, sf).select("slot", "machine", F.round("score", 6).alias("score"))


@query(f"WITH {EVENTS}, {_SUM} SELECT slot, machine, round(anomaly, 6) AS anomaly FROM an")
def sliding_score_sum(spark, sf):
    return logs.sliding_score_sum(_observed(spark, sf)).select("slot", "machine", F.round("anomaly", 6).alias("anomaly"))


@query(f"WITH {EVENTS}, {_SUM}, rk AS (SELECT slot, machine, row_number() OVER (PARTITION BY slot ORDER BY round(anomaly, 6) DESC, machine) AS rank FROM an) SELECT * FROM rk WHERE rank <= 3")
def alert_trigger(spark, sf):
    scored = logs.sliding_score_sum(_observed(spark, sf)).withColumn("anomaly", F.round("anomaly", 6))
    return logs.alert_trigger(scored).select("slot", "machine", F.col("rank").cast("long").alias("rank"))


_BANDIT = """rw AS (SELECT us, event_id, user_id % 3 AS action, value AS reward FROM ev WHERE k % 2 = 0),
    acts AS (SELECT unnest(range(0, 3)) AS action), al AS (SELECT us, event_id, action, reward FROM ev CROSS JOIN acts LEFT JOIN rw USING (us, event_id, action)),
    st AS (SELECT us, event_id, action, count(reward) OVER w AS pulls, coalesce(sum(reward) OVER w, 0) AS total FROM al WINDOW w AS (PARTITION BY action ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    bd AS (SELECT *, CASE WHEN pulls = 0 THEN 'infinity'::DOUBLE ELSE round(total / pulls + sqrt(2.0 * ln(greatest(sum(pulls) OVER (PARTITION BY event_id), 1)) / pulls), 9) END AS bound FROM st)"""


@query(f"WITH {EVENTS}, {_BANDIT} SELECT event_id, arg_max(action, (bound, -action))::BIGINT AS action FROM bd GROUP BY event_id")
def bandit_learner(spark, sf):
    e = derive.events(spark, sf)
    rewards = e.where("k % 2 = 0").select("us", "event_id", (F.col("user_id") % 3).cast("int").alias("action"), F.col("value").alias("reward"))
    return logs.bandit_learner(e.select("us", "event_id"), rewards, order=["us", "event_id"], actions=3).select("event_id", F.col("action").cast("long").alias("action"))


# ---- metrics

_LAT = "lt AS (SELECT event_id, et, (us % 1000000)::BIGINT AS latency FROM ev)"


def _latencies(spark, sf):
    return derive.events(spark, sf).select("event_id", "et", (F.col("us") % 1_000_000).alias("latency"))


@query(f"WITH {EVENTS}, {_LAT} SELECT count(*) AS n, round(avg(latency), 4) AS mean, min(latency)::DOUBLE AS p0, max(latency)::DOUBLE AS p100, {', '.join(f'round(quantile_cont(latency, {q / 100}), 4) AS p{q}' for q in (5, 25, 50, 75, 95))} FROM lt")
def latency_summary(spark, sf):
    s = logs.latency_summary(_latencies(spark, sf))
    return s.select("n", F.round("mean", 4).alias("mean"), "p0", "p100", *[F.round(f"p{q}", 4).alias(f"p{q}") for q in (5, 25, 50, 75, 95)])


@query(f"WITH {EVENTS}, {_LAT} SELECT event_id, minute, latency FROM (SELECT *, et // 3600 AS minute, row_number() OVER (PARTITION BY et // 3600 ORDER BY event_id) AS i FROM lt) WHERE i <= 5")
def latency_sample(spark, sf):
    rows = _latencies(spark, sf).withColumn("minute", F.floor(F.col("et") / 3600)).drop("et")
    return logs.latency_sample(rows, time="minute", order="event_id", rate=5).select("event_id", "minute", "latency")


@query(f"WITH {EVENTS} SELECT count(*) AS n, max(et) - min(et) AS seconds, round(count(*) / (max(et) - min(et)), 9) AS per_second FROM ev")
def throughput(spark, sf):
    return logs.throughput(derive.events(spark, sf), time="et").withColumn("per_second", F.round("per_second", 9))


@query(f"WITH {EVENTS}, {_LAT} SELECT count(*) AS rows, round(avg(latency), 4) AS mean_latency, max(latency) AS worst FROM lt")
def snk_stats(spark, sf):
    return _latencies(spark, sf).agg(F.count("*").alias("rows"), F.round(F.avg("latency"), 4).alias("mean_latency"), F.max("latency").alias("worst"))


@query(f"WITH {EVENTS} SELECT event_id, et // 60 + 1 AS minute, trunc(value)::INTEGER AS whole, round(sqrt(value), 6) AS root, CASE WHEN k = 0 THEN NULL ELSE round(ln(k), 6) END AS log_k, substr(event_type, 1, 3) AS head, event_type || ':' || user_id AS joined FROM ev")
def scalar_functions(spark, sf):
    from ..functions import minute_number

    e = derive.events(spark, sf)
    return e.select("event_id", minute_number(F.col("et")).alias("minute"), F.col("value").cast("int").alias("whole"), F.round(F.sqrt("value"), 6).alias("root"), F.round(F.when(F.col("k") > 0, F.log(F.col("k").cast("double"))), 6).alias("log_k"), F.substring("event_type", 1, 3).alias("head"), F.concat_ws(":", "event_type", "user_id").alias("joined"))
