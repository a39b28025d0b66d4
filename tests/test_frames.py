"""Moving averages against a plain frame, pair flags and keys that equal nothing."""

import math
import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import ordered, traffic, voip


def same(a, b, large):
    """Equal up to the rounding of sums that hold values as ``large``."""
    if a is None or b is None or math.isnan(a) or math.isnan(b) or math.isinf(a) or math.isinf(b):
        return a == b or (a is not None and b is not None and math.isnan(a) and math.isnan(b))
    return abs(a - b) <= 1e-14 * max(1.0, large)


def values(seed, n):
    rng = random.Random(seed)
    odd = [float("nan"), float("inf"), -float("inf"), 1e17, -1e17, None]
    return [rng.choice(odd) if rng.random() < 0.02 else rng.uniform(-5, 5) for _ in range(n)]


@pytest.mark.parametrize("size", [1, 2, 31, 32, 33, 100, 1000, 1100])
@pytest.mark.parametrize("rows", [2, 130, 250_000])
def test_frames_of_every_size_and_block(spark, size, rows):
    data = [("a", i, v) for i, v in enumerate(values(size, 400))] + [("b", i, v) for i, v in enumerate(values(size + 1, 37))] + [(None, 1, 2.0)]
    df = spark.createDataFrame(data, "k string, i long, v double").repartition(3)
    w = Window.partitionBy("k").orderBy("i").rowsBetween(1 - size, 0)
    want = {(r.k, r.i): (r.m, r.large or 0.0) for r in df.select("k", "i", F.avg("v").over(w).alias("m"), F.max(F.abs("v")).over(w).alias("large")).collect()}
    got = {(r.k, r.i): r.moving_avg for r in ordered.moving_avg(df, key="k", order="i", tie=[], value="v", size=size, rows=rows).collect()}
    assert got.keys() == want.keys()
    assert [k for k in want if not same(got[k], *want[k])] == []


def test_one_odd_value_touches_its_frames_only(spark):
    line = [1.0] * 101
    line[40] = float("nan")
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(line)], "k string, i long, v double")
    for size in (32, 33):
        for rows in (40, 250_000):
            made = ordered.moving_avg(df, key="k", order="i", tie=[], value="v", size=size, rows=rows).collect()
            assert sum(math.isnan(r.moving_avg) for r in made) == size
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([1e17] + [1.0] * 99)], "k string, i long, v double")
    assert ordered.moving_avg(df, key="k", order="i", tie=[], value="v", size=33).orderBy(F.desc("i")).first().moving_avg == 1.0


@pytest.mark.parametrize("rows", [2, 250_000])
def test_pair_flag_keeps_rows(spark, rows):
    calls = [(7, 1, 2, 10), (7, 1, 2, 5), (None, 1, 3, 1), (None, 1, 3, 2), (8, None, 2, 3), (9, None, 2, None), (9, None, None, 4)]
    df = spark.createDataFrame(calls, "call_id long, calling long, called long, answer_ts long").repartition(3)
    got = sorted(map(str, ((r.call_id, r.calling, r.called, r.answer_ts, r.new_callee) for r in voip.new_pair_flag(df, rows=rows).collect())))
    new = [False, True, True, False, False, True, True]
    assert got == sorted(str((*c, n)) for c, n in zip(calls, new))


def test_scans_end_on_nan_keys(spark):
    nan = float("nan")
    rows = [(k, i, 50 + i % 3) for i, k in enumerate([nan, 1.0, nan, None, 2.0, nan, None, 1.0] * 5)]
    df = spark.createDataFrame(rows, "road_id double, seq long, speed int").repartition(2)
    got = traffic.speed_outlier_gate(df, order="seq").collect()
    assert len(got) == 40
    assert max(r["count"] for r in got if r.road_id is not None and math.isnan(r.road_id)) == 15
    made = traffic.win_anchored_count(df, key="road_id", time="seq", order="seq", length=10).collect()
    assert sorted(str(r.road_id) for r in made) == sorted(["nan"] * 3 + ["1.0"] * 3 + ["2.0"] * 2 + ["None"] * 3)


@pytest.mark.parametrize("size", [1, 16, 20, 256, 1000])
@pytest.mark.parametrize("rows", [600, 250_000])
def test_means_equal_sql_over_one_key_to_the_bit(spark, size, rows):
    """Over one key alone: where a table has more keys, the SQL's blocks may begin before a key's first row."""
    rng = random.Random(size)
    data = [(k, i, rng.choice([None, *[rng.randrange(1, 50_000) / 100 for _ in range(9)]])) for k, n in ((1, 5000), (2, 300), (None, 17)) for i in range(n)]
    df = spark.createDataFrame(data, "k long, i long, v double").repartition(3)
    got = {(r.k, r.i): r.moving_avg for r in ordered.moving_avg(df, key="k", order="i", tie=[], value="v", size=size, rows=rows).collect()}
    c = duckdb.connect()
    c.register("t", pa.table({n: pa.array(column) for n, column in zip("kiv", zip(*data))}))
    want = [r for k in (1, 2, None) for r in c.execute(f"SELECT k, i, avg(v) OVER (ORDER BY i ROWS {size - 1} PRECEDING) FROM (SELECT * FROM t WHERE k IS NOT DISTINCT FROM ?)", [k]).fetchall()]
    assert got == {(k, i): m for k, i, m in want}


def test_row_on_the_threshold_is_as_in_sql(spark, tmp_path):
    """149.52 is three times the mean of its 255 rows, 49.84, so that it isn't off by more than twice the mean."""
    from millrace import plans

    c = duckdb.connect()
    c.execute("CREATE VIEW once AS SELECT * FROM '/root/testdata/sf0.1/events.parquet' WHERE user_id = 351")
    c.execute(f"COPY (SELECT once.* REPLACE (event_id + 100000 * copy AS event_id) FROM once, (SELECT unnest(range(7)) AS copy)) TO '{tmp_path}/events.parquet'")
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = {r[0] for r in c.execute(plans.oracle_sql()["filter_spike"]).fetchall()}
    got = {r.event_id for r in plans.queries()["filter_spike"](spark, str(tmp_path)).collect()}
    assert got == want and 270120 not in got and len(got) > 5
