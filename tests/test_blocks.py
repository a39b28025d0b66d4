"""Ordered operators give the same rows whether a table is one block or many, with nulls and ties in every column."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import ads, logs, markov, ordered, text, traffic

SCHEMA = "k string, t long, id long, v double, s string"


def table(seed):
    """A hot key, null keys, null times, null values, ties and one time far off."""
    rng = random.Random(seed)
    maybe = lambda x, p=0.1: None if rng.random() < p else x
    rows = [(maybe(rng.choice("aaaaab")), maybe(rng.choice([i, i // 3, 7])), i, maybe(rng.randrange(1, 40) / 2, 0.2), maybe(rng.choice("xyz"))) for i in range(60)]
    return [*rows, ("a", 10**12, 60, 5.0, "x")]


def plain(df):
    text = lambda v: round(v, 6) if isinstance(v, float) else tuple(v) if isinstance(v, list) else v
    return sorted((tuple(text(v) for v in r) for r in df.collect()), key=repr)


def late(d, n):
    # null arrivals are ties of one another, so that they carry no time here
    return ads.late_rows(d.withColumn("v", F.when(F.col("t").isNotNull(), F.col("v"))).withColumn("o", F.col("t") * 100 + F.col("id")), time="v", order="o", length=3, block=n)


CASES = {
    "numbered": lambda d, n: ordered.numbered(d, ["k"], "t", ["id"], rows=n),
    "numbered whole": lambda d, n: ordered.numbered(d, [], "t", ["id"], rows=n),
    "running": lambda d, n: ordered.running(d, ["k"], "t", ["id"], count="c", sums={"a": F.col("v")}, tops={"b": F.col("v")}, own=False, rows=n),
    "moving short": lambda d, n: ordered.moving_avg(d, key="k", order="t", tie=["id"], value="v", size=3, rows=n),
    "moving long": lambda d, n: ordered.moving_avg(d, key="k", order="t", tie=["id"], value="v", size=33, rows=n),
    "decayed": lambda d, n: ordered.decayed(d, keys=["k"], time="t", tie=["id"], amount=F.col("v"), beta=0.9, out="c", rows=n),
    "decayed over segments": lambda d, n: ordered.decayed(d, keys=["k"], time="t", tie=["id"], amount=F.col("v"), beta=1e-60, out="c", rows=n),
    "ewma": lambda d, n: ordered.ewma_global(d, order="t", tie=["id"], value="v", age=9.0, warm=40.0, rows=n),
    "as of": lambda d, n: ordered.asof_latest(d.where("id % 3 = 0").drop("v"), d.where("id % 3 <> 0"), order=["t", "id"], value="v", key=["k"], rows=n),
    "late": late,
    "anchored": lambda d, n: traffic.win_anchored_count(d, key="k", time="t", order="id", length=9, block=n),
    "anchored by time": lambda d, n: traffic.win_anchored_count(d, key="k", time="t", order="t", tie=["id"], length=4, block=n),
    "scores": lambda d, n: markov.score_sequences(d, markov.model_fit(d, key="k", order="t", tie=["id"], state="s"), key="k", order="t", tie=["id"], state="s", size=3, rows=n),
    "global metric": lambda d, n: markov.global_metric(d, markov.model_fit(d, key="k", order="t", tie=["id"], state="s"), key="k", order="t", tie=["id"], state="s", rows=n),
    "quantiles": lambda d, n: ordered.quantiles(d, ["k"], "v", {"p0": 0.0, "p30": 0.3, "p50": 0.5, "p100": 1.0}, rows=n),
    "latency": lambda d, n: logs.latency_summary(d, latency="v", block=n),
    "bandit": lambda d, n: logs.bandit_learner(d.select("t", "id"), d.where("v is not null").select("t", "id", (F.col("id") % 2).cast("int").alias("action"), F.col("v").alias("reward")), order=["t", "id"], actions=2, rows=n),
}


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("name", CASES)
def test_blocks_change_nothing(spark, name, seed):
    df = spark.createDataFrame(table(seed), SCHEMA).repartition(3)
    one, many = plain(CASES[name](df, 250_000)), plain(CASES[name](df, 2))
    assert len(one) > 0
    assert one == many


def test_no_row_is_lost(spark):
    rows = table(3)
    df = spark.createDataFrame(rows, SCHEMA)
    for n in (2, 250_000):
        assert ordered.numbered(df, [], "t", ["id"], rows=n).count() == len(rows)
        assert late(df, n).count() == len(rows)
        assert ordered.decayed(df, keys=["k"], time="t", tie=["id"], amount=F.col("v"), beta=0.9, out="c", rows=n).count() == len(rows)


def test_decayed_keeps_null_keys(spark):
    rows = table(4)
    got = {r.id: r.c for r in ordered.decayed(spark.createDataFrame(rows, SCHEMA), keys=["k"], time="t", tie=["id"], amount=F.col("v"), beta=0.9, out="c", rows=3).collect()}
    state = {}
    for k, t, i, v, _ in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[2])):
        c, at = state.get(k, (0.0, t))
        state[k] = (c * 0.9 ** (t - at) + (v or 0.0), t)
        assert got[i] == pytest.approx(state[k][0], rel=1e-9, abs=1e-12)
    assert all(got[i] is None for _, t, i, _, _ in rows if t is None)


def test_asof_passes_over_nulls(spark):
    left = spark.createDataFrame([(9, 0)], "t long, id long")
    right = spark.createDataFrame([(1, 1, "a"), (2, 2, None)], "t long, id long, v string")
    for n in (1, 250_000):
        assert [r.v for r in ordered.asof_latest(left, right, order=["t", "id"], value="v", rows=n).collect()] == ["a"]


def test_quantiles_against_sorting(spark):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), rng.randrange(50) / 2) for _ in range(301)]
    for r in ordered.quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"p": 0.37}, rows=5).collect():
        v = sorted(x for k, x in rows if k == r.k)
        at = 0.37 * (len(v) - 1)
        assert r.n == len(v) and r.p == pytest.approx(v[int(at)] + (v[-int(-at // 1)] - v[int(at)]) * (at - int(at)))


def test_null_keys_hold_state(spark):
    rows = [(None, 5, i) for i in range(4)] + [(2**60 + 1, 7, 9)]
    df = spark.createDataFrame(rows, "road_id long, speed int, seq long")
    got = sorted((r.seq, r.road_id, r["count"]) for r in traffic.speed_outlier_gate(df, order="seq").collect())
    assert got == [(0, None, 1), (1, None, 2), (2, None, 3), (3, None, 4), (9, 2**60 + 1, 1)]


@pytest.mark.parametrize("batch", [3, 10_000])
def test_anchored_windows_against_a_loop(spark, batch):
    rng = random.Random(8)
    rows = [(rng.choice([1, 2, None]), i + rng.randrange(-6, 7) if rng.random() < 0.95 else None, i // 2, i) for i in range(400)]
    want, state = [], {}
    for k, t, *_ in rows:
        if t is None:
            continue
        if k not in state:
            state[k] = [t, 1]
        elif t >= state[k][0] + 10:
            want.append((k, state[k][1], t))
            state[k] = [t, 1]
        elif t >= state[k][0]:
            state[k][1] += 1
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        df = spark.createDataFrame(rows, "k long, t long, o long, i long").repartition(4)
        got = [tuple(r) for r in traffic.win_anchored_count(df, key="k", time="t", order="o", tie=["i"], length=10).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_slanted_and_wide_roads_against_all_pairs(spark):
    rng = random.Random(4)
    at = lambda: (116.1 + rng.random() * 0.08, 39.71 + rng.random() * 0.08)
    roads = []
    for i in range(40):
        (a, b), (c, d) = at(), at()
        c, d = (a, d) if i % 5 == 0 else (c, b) if i % 5 == 1 else (c, d)
        roads.append((i, 100 + i, rng.choice([None, 0, 8, 400]), 0, a, b, c, d, "397_1161"))
    points = [(i, y, x) for i in range(600) for x, y in [at()]] + [(9000, None, 116.15)]
    schema = "road_no long, road_id long, width int, seg_no int, x1 double, y1 double, x2 double, y2 double, cell string"
    r, p = spark.createDataFrame(roads, schema), spark.createDataFrame(points, "id long, lat double, lon double")
    from millrace.functions import DEGREE_METRES, planar_dist

    pairs = p.where("lat is not null").crossJoin(r).withColumn("m", planar_dist(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), F.col("lon"), F.col("lat")) * DEGREE_METRES).collect()
    want, reach = {}, (5**2 + 10**2) ** 0.5 if not roads[-1][2] else (roads[-1][2] ** 2 + 100) ** 0.5
    for i in {x.id for x in pairs}:
        mine = [x for x in pairs if x.id == i]
        on = [x for x in mine if x.m < (x.width or 5) / 2]
        near = min(mine, key=lambda x: (x.m, x.road_no))
        if on:
            want[i] = min(on, key=lambda x: x.road_no).road_id
        elif near.m < reach:
            want[i] = near.road_id
    got = {x.id: x.road_id for x in traffic.join_nearest_road(p, r, point_id="id").collect()}
    assert got == want and 20 < len(got) < 600


def test_anchored_openers_meet_one_jump_in_a_stage(spark, monkeypatch):
    joins, stored = [], traffic.stored

    def seen(df, name):
        joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return stored(df, name)

    monkeypatch.setattr(traffic, "stored", seen)
    df = spark.createDataFrame([(i % 3, i * 7 % 1000 + i, i) for i in range(600)], "k long, t long, o long")
    got = traffic.win_anchored_count(df, key="k", time="t", order="o", length=10, block=200).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, traffic.win_anchored_count(df, key="k", time="t", order="o", length=10).collect()))
    assert got and len(joins) > 6 and max(joins) == 1


def test_tasks_of_blocks_are_as_many_as_the_table_needs(spark):
    """Four shuffle partitions in this session, 40 blocks."""
    df = spark.createDataFrame([(i, i % 3) for i in range(400)], "i long, k long")
    made = {
        "running": ordered.running(df, ["k"], "i", [], count="n", rows=10),
        "decayed": ordered.decayed(df, keys=["k"], time="i", tie=[], amount=F.lit(1.0), beta=0.9, out="x", rows=10),
        "asof": ordered.asof_latest(df, df.withColumn("v", F.col("i")), order=["i"], value="v", key=["k"], rows=20),
    }
    for name, found in made.items():
        assert found.rdd.getNumPartitions() == 80 and found.count() == 400, name


@pytest.mark.parametrize("rows", [1, 7, 40, None])
def test_words_of_lines_are_counted_where_they_are_split(spark, rows):
    rng = random.Random(7)
    texts = [None, "", "  ", *(" ".join(rng.choice(["the", "of", "x", ""]) for _ in range(rng.randrange(1, 60))) for _ in range(40))]
    lines = spark.createDataFrame([(i * 10 if i % 9 else i * 10 + 1, "d", t) for i, t in enumerate(texts)], "pos long, doc string, line string").repartition(5)
    want = text.word_count_running(text.words(lines), order="pos", tie=["word_no"])
    got = text.word_count_of_lines(lines, order="pos", rows=rows)
    assert got.columns == want.columns and plain(got) == plain(want)
    assert text.word_count_of_lines(lines.limit(0), order="pos", rows=rows).count() == 0


def test_words_are_not_shuffled_to_be_counted(spark):
    lines = spark.createDataFrame([(i, f"the w{i} the") for i in range(50)], "pos long, line string")
    plan = text.word_count_of_lines(lines, order="pos", rows=10)._jdf.queryExecution().executedPlan().toString()
    # exchanges: lines with what was counted before, and the counts themselves twice; none above the last split
    assert plan.count("Exchange hashpartitioning") == 3 and "Exchange" not in plan[: plan.index("Generate posexplode")]


def test_pieces_with_nothing_before_them_get_no_carry(spark, monkeypatch):
    sent = []
    with_carries = ordered._with_carries
    monkeypatch.setattr(ordered, "_with_carries", lambda pieces, carries, by, blocks: sent.append(carries.count()) or with_carries(pieces, carries, by, blocks))
    rows = spark.createDataFrame([(f"k{i}", i, i) for i in range(60)] + [("hot", i, 60 + i) for i in range(60)], "k string, t long, id long")
    got = ordered.numbered(rows, ["k"], "t", ["id"], rows=30)
    assert sorted(r.n for r in got.where("k = 'hot'").collect()) == list(range(1, 61)) and got.where("k <> 'hot' and n = 1").count() == 60
    ordered.decayed(rows, keys=["k"], time="t", tie=["id"], amount=F.lit(1.0), beta=0.9, out="c", rows=30)
    assert sent == [3, 3]  # the hot key's, in all buckets but its first
