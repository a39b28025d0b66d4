"""Operators on small rows by hand, and against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from millrace import functions as fn
from millrace.operators import ads, logs, markov, ordered, road, text, traffic, voip
from millrace.sources import feeds


def lines(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


def test_csv_kv_splits_once(spark):
    got = feeds.csv_kv(lines(spark, "a,1,x", "b", ",z")).collect()
    assert [tuple(r) for r in got] == [("a", "1,x"), ("b", None), ("", "z")]


def test_sensor_drops_short_lines_and_picks_a_field(spark):
    rows = lines(spark, "2004-03-31 03:38:15.757551 2 1 122.153 -3.91901 11.04 2.03397", "2004 x 2 1")
    assert [tuple(r) for r in feeds.sensor(rows, value_field="volt").collect()] == [("2004-03-31", "03:38:15.757551", 2, "1", 2.03397)]


def test_cdr_time_with_zone(spark):
    got = feeds.cdr(lines(spark, "1,2,2014-01-01T01:00:00.500+01:00,30,true", "1,2,2014-01-01T01:00:00.500+0100,30,false", "1,2,bad,3,true", "1,2")).collect()
    assert [(r.answer_ts, r.established) for r in got] == [(1388534400, True), (1388534400, False), (None, True)]


def test_road_reports_keep_type_zero(spark):
    assert feeds.road_reports(lines(spark, "0,1,2,3,4,0,1,5,6", "2,1,2,3,4,0,1,5,6", "0,1")).count() == 1


def test_split_words_blanks(spark):
    df = lines(spark, " a  b ", "", "x", "   ")
    got = [r.w for r in df.select(fn.split_words(F.col("value")).alias("w")).collect()]
    assert got == [["", "a", "", "b"], [""], ["x"], []]
    assert [r.w for r in df.select(fn.split_words(F.col("value"), keep_empty=False).alias("w")).collect()] == [["a", "b"], [], ["x"], []]


def test_word_count_running(spark):
    df = spark.createDataFrame([(0, "a b a"), (1, "b a")], "pos long, line string")
    got = text.word_count_running(text.words(df), order="pos", tie=["word_no"]).orderBy("pos", "word_no").collect()
    assert [(r.word, r["count"]) for r in got] == [("a", 1), ("b", 1), ("a", 2), ("b", 2), ("a", 3)]


def test_numbering_doesnt_depend_on_buckets(spark):
    rng = random.Random(3)
    rows = [(rng.choice("aaaab"), rng.randrange(1000), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, t long, id long").repartition(7)
    one = {(r.id, r.n) for r in ordered.numbered(df, ["k"], "t", ["id"]).collect()}
    many = {(r.id, r.n) for r in ordered.numbered(df, ["k"], "t", ["id"], rows=20).collect()}
    assert one == many and len(one) == 500


@pytest.mark.parametrize("size", [3, 40])
def test_moving_avg_across_blocks(spark, size, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK_ROWS", 50)
    rng = random.Random(5)
    rows = [("a" if rng.random() < 0.8 else "b", i, rng.random()) for i in range(700)]
    got = {r.t: r.moving_avg for r in ordered.moving_avg(spark.createDataFrame(rows, "k string, t long, v double"), key="k", order="t", tie=[], value="v", size=size).collect()}
    last: dict = {}
    for k, t, v in rows:
        h = last.setdefault(k, [])
        h.append(v)
        assert got[t] == pytest.approx(sum(h[-size:]) / len(h[-size:]), abs=1e-9)


def test_negative_mean_always_fires(spark):
    df = spark.createDataFrame([(1.0, 1.0), (-5.0, -5.0)], "v double, moving_avg double")
    assert [r.v for r in ordered.filter_spike(df, value="v").collect()] == [-5.0]


def test_decayed_against_a_loop(spark):
    rng, beta = random.Random(9), 0.9
    rows = [(rng.choice("xxy"), rng.randrange(0, 40_000), i, rng.random()) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, t long, id long, q double")
    got = {r.id: r.c for r in ordered.decayed(df, keys=["k"], time="t", tie=["id"], amount=F.col("q"), beta=beta, out="c").collect()}
    state: dict = {}
    for k, t, i, q in sorted(rows, key=lambda r: (r[1], r[2])):
        c, at = state.get(k, (0.0, t))
        state[k] = (c * beta ** (t - at) + q, t)
        assert got[i] == pytest.approx(state[k][0], rel=1e-9)


def _ewma(values, age, warm=10.0):
    a, mean, run, out = 2 / (age + 1), None, 0.0, []
    for v in values:
        if mean is None:
            run += v
            mean = run if run > warm else None
        else:
            mean = (1 - a) * mean + a * v
        out.append(mean if mean is not None and mean > warm else 0.0)
    return out


@pytest.mark.parametrize("values", [[3, 4, 2, 30, 5, 100], [50, 1, 2, 3], [1, 1], [0, 0, 12]])
def test_ewma_global_warm_up(spark, values):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "t long, v double")
    got = [r.average for r in ordered.ewma_global(df, order="t", tie=[], value="v", age=9.0).orderBy("t").collect()]
    assert got == pytest.approx(_ewma(values, 9.0))


def test_asof_ties_and_misses(spark):
    left = spark.createDataFrame([(1, 0), (5, 0), (9, 0)], "t long, id long")
    right = spark.createDataFrame([(5, 0, "x"), (7, 1, "y")], "t long, id long, v string")
    got = {r.t: r.v for r in ordered.asof_latest(left, right, order=["t", "id"], value="v").collect()}
    assert got == {1: None, 5: "x", 9: "y"}


def test_key_dictionary_first_appearance(spark):
    df = spark.createDataFrame([("b", 2), ("a", 3), ("b", 9), ("c", 1)], "k string, pos long")
    assert {r.k: r.key_id for r in ordered.key_dictionary(df, key="k", order="pos").collect()} == {"c": 0, "b": 1, "a": 2}


MODEL = [("a", "a", 0.2), ("a", "b", 0.8), ("b", "a", 0.5), ("b", "b", 0.5)]


def test_markov_needs_five_states_and_knows_unseen(spark):
    rows = [("x", i, s) for i, s in enumerate("abab")] + [("y", i, s) for i, s in enumerate("ababz")]
    df = spark.createDataFrame(rows, "e string, t long, s string")
    model = spark.createDataFrame(MODEL, "prev string, cur string, p double")
    got = markov.score_sequences(df, model, key="e", order="t", tie=[], state="s").collect()
    assert [(r.e, r.t) for r in got] == [("y", 4)]
    assert got[0].score == pytest.approx((0.2 + 0.5 + 0.2 + 1.0) / 4)
    rate = markov.score_sequences(df, model, key="e", order="t", tie=[], state="s", predictor="miss_rate").collect()
    assert rate[0].score == pytest.approx((0 + 0 + 0 + 1) / 4)


def test_new_pairs_and_windows_agree(spark):
    rows = [(i, i % 3, i % 2, i // 4, 10, True) for i in range(20)]
    df = spark.createDataFrame(rows, "call_id long, calling long, called long, answer_ts long, duration long, established boolean")
    assert {(r.call_id, r.new_callee) for r in voip.new_pair_flag(df).collect()} == {(r.call_id, r.new_callee) for r in voip.first_seen_window(df).collect()}


def test_scores_need_all_three(spark):
    a = spark.createDataFrame([(1, 5, 10, 0.5), (1, 6, 11, 0.5)], "calling long, answer_ts long, call_id long, fofir double")
    b, c = a.where("call_id = 10").withColumnRenamed("fofir", "url"), a.withColumnRenamed("fofir", "acd")
    assert [(r.call_id, r.score) for r in voip.score_join3(a, b, c).collect()] == [(10, 4.0)]
    assert voip.score_join3(a, b, c, compat_emit_zeros=True).count() == 5


def test_ratio_of_zero(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (5.0, 2.0)], "a double, b double")
    got = [r.s for r in df.select(fn.ratio_score(2.0, 10.0, fn.safe_ratio(F.col("a"), F.col("b"))).alias("s")).collect()]
    assert got == [1.0, None, 0.25]


def test_toll_over_fifty(spark):
    crowd = [(i, 0, 1000 + i, 20, 0, 0, 0, 3, 1) for i in range(53)]
    late = [(100, 60, 7, 20, 0, 0, 0, 3, 2), (101, 61, 8, 20, 0, 4, 0, 3, 2)]
    df = spark.createDataFrame(crowd + late, "event_id long, time long, vid long, speed long, xway long, lane long, direction long, segment long, minute long")
    got = {r.event_id: (r.speed, r.toll) for r in road.toll(df).collect()}
    assert got[100] == (20, 2 * 3 * 3) and 101 not in got and got[0] == (0, 0)
    accident = spark.createDataFrame([(0, 0, 7, 1)], "xway long, direction long, segment long, minute long")
    assert {r.event_id: r.toll for r in road.toll(df, accidents=accident).collect()}[100] == 0


def test_last_avg_speed_takes_the_first_eleven(spark):
    rows = [(v, 1, 0, 0, 2, 10 if v < 11 else 90) for v in range(20)]
    df = spark.createDataFrame(rows, "vid long, minute long, xway long, direction long, segment long, avg_speed long")
    assert road.last_avg_speed(df).first().lav == 10
    assert road.last_avg_speed(df, max_values=None).first().lav == (110 + 9 * 90) // 20


@pytest.mark.parametrize("speeds,want", [([50, 52, 51, 200], [(50, 1), (51, 2), (51, 3), (88, 4)]), ([50, 52, 51, 50, 52, 51, 200], [(50, 1), (51, 2), (51, 3), (50, 4), (51, 5), (51, 6), (0, 0)])])
def test_speed_gate(spark, speeds, want):
    df = spark.createDataFrame([(1, s, i) for i, s in enumerate(speeds)], "road_id long, speed int, seq long")
    got = traffic.speed_outlier_gate(df, order="seq").orderBy("seq").collect()
    assert [(r.average_speed, r["count"]) for r in got] == want


def test_speed_gate_against_a_loop(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(3), rng.randrange(20, 60) if rng.random() < 0.9 else 300, i) for i in range(3000)]
    got = {r.seq: (r.average_speed, r["count"]) for r in traffic.speed_outlier_gate(spark.createDataFrame(rows, "road_id long, speed int, seq long").repartition(5), order="seq").collect()}
    ring: dict = {}
    for r, s, i in rows:
        held, mean = ring.setdefault(r, ([], [0]))
        if len(held) < 2:
            held.append(s)
            mean[0] = int(sum(held) / len(held))
            want = (mean[0], len(held))
        else:
            now = int((sum(held) + s) / (len(held) + 1))
            dev = math.sqrt((sum((x - mean[0]) ** 2 for x in held) + (s - mean[0]) ** 2) / len(held))
            want = (0, 0)
            if abs(s - now) <= 2 * dev:
                held.append(s)
                del held[:-30]
                mean[0] = now
                want = (now, len(held))
        assert got[i] == want


def test_nearest_road_rules(spark):
    roads = spark.createDataFrame([(0, 7, None, 0, 116.1, 39.7, 116.19, 39.7, "397_1161"), (1, 8, None, 0, 116.1, 39.70001, 116.19, 39.70001, "397_1161")], "road_no long, road_id long, width int, seg_no int, x1 double, y1 double, x2 double, y2 double, cell string")
    points = spark.createDataFrame([(1, 39.700015, 116.15), (2, 39.70008, 116.15), (3, 39.7005, 116.15), (4, 39.69999, 116.15)], "id long, lat double, lon double")
    got = {r.id: r.road_id for r in traffic.join_nearest_road(points, roads, point_id="id").collect()}
    assert got == {1: 7, 2: 8}  # both near: the first in order; the nearest within reach; too far; another cell


def test_point_in_polygon(spark):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 4), (2, 1), (0, 4))])
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (5.0, 1.0), (3.5, 3.0)], "x double, y double")
    assert [r.i for r in df.select(fn.point_in_polygon(ring, F.col("x"), F.col("y")).alias("i")).collect()] == [True, False, False, True]


def test_anchored_windows(spark):
    rows = [(1, t, i) for i, t in enumerate([5, 9, 14, 15, 3, 24, 26])]
    got = traffic.win_anchored_count(spark.createDataFrame(rows, "k long, t long, seq long"), key="k", time="t", order="seq", length=10).collect()
    assert [(r["count"], r.trigger_ts) for r in got] == [(3, 15), (2, 26)]


def test_late_rows_at_the_border(spark):
    rows = [(0, 9), (1, 10), (2, 9), (3, 25), (4, 19), (5, 20)]
    got = ads.late_rows(spark.createDataFrame(rows, "seq long, t long"), time="t", order="seq", length=10).orderBy("seq").collect()
    assert [r.late for r in got] == [False, False, True, False, True, False]


def test_bandit_tries_all_first(spark):
    events = spark.createDataFrame([(t, t) for t in range(5)], "t long, id long")
    rewards = spark.createDataFrame([(0, 0, 0, 1.0), (1, 1, 1, 5.0)], "t long, id long, action int, reward double")
    got = [r.action for r in logs.bandit_learner(events, rewards, order=["t", "id"], actions=2).orderBy("t").collect()]
    assert got == [0, 1, 1, 1, 1]


def test_shuffled_input_gives_the_same(spark):
    rows = [(i % 4, i, float(i * 7 % 13)) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, t long, v double")
    run = lambda d: sorted((r.t, round(r.moving_avg, 9)) for r in ordered.moving_avg(d, key="k", order="t", tie=[], value="v", size=40).collect())
    assert run(df.repartition(1)) == run(df.orderBy(F.rand(3)).repartition(9))


def test_empty_tables(spark):
    df = spark.createDataFrame([], "k long, t long, v double")
    assert ordered.moving_avg(df, key="k", order="t", tie=[], value="v").count() == 0
    assert ordered.ewma_global(df, order="t", tie=[], value="v").count() == 0
