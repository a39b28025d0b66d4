"""What streams hold and read grows in parts: files of a replay, states of shards and stretches."""

import datetime
import random

import pytest
from pyspark.sql import functions as F
from test_stream_state import arriving, drained, flat

from millrace import streaming
from millrace.operators import ordered
from millrace.streaming import joins, replay


@pytest.mark.parametrize("nulls", [0, 3])
def test_a_replayed_part_is_many_files_and_one_micro_batch(spark, tmp_path, nulls):
    df = spark.createDataFrame([(i, None if i < nulls else i) for i in range(300)], "id long, o long").repartition(7)
    stream, seen = replay.replayed(df, "o", parts=3, file_rows=20), []
    stream.select("o", F.input_file_name().alias("f")).writeStream.foreachBatch(lambda b, n: seen.append(b.collect())).option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.o for b in seen for r in b if r.o is not None) == list(range(nulls, 300)) and sum(map(len, seen)) == 300
    spans = [[r.o for r in b if r.o is not None] for b in seen]
    assert len(spans) == 3 and all(max(a) < min(b) for a, b in zip(spans, spans[1:], strict=False))
    for b in seen:
        assert max(sum(r.f == f for r in b) for f in {r.f for r in b}) <= 30


def test_a_replay_of_few_rows_and_of_none(spark):
    few = spark.createDataFrame([(i, i // 100) for i in range(101)], "id long, o long")
    assert flat(replay.drained(replay.replayed(few, "o", file_rows=10), "few").collect()) == flat(few.collect())
    assert replay.drained(replay.replayed(few.limit(0), "o", file_rows=10), "none").count() == 0


def test_keys_share_the_states_of_shards(spark, tmp_path):
    rows = [(i, i % 400, i, 1.0) for i in range(1200)]
    stream = arriving(spark, tmp_path / "in", [rows[:700], rows[700:]], "i long, k long, t long, x double")
    got, left = drained(spark, streaming.decayed_counts(stream, key="k", time="t", order=["i"], amount="x", beta=0.5), tmp_path, "shards")
    want = ordered.decayed(spark.createDataFrame(rows, "i long, k long, t long, x double"), keys=["k"], time="t", tie=["i"], amount=F.col("x"), beta=0.5, out="v")
    near = lambda found: sorted((r[0], r[1], round(r[2], 9)) for r in found)
    assert near(got) == near(want.select("k", "i", "v").collect())
    assert left <= streaming.SHARDS


def test_versions_wait_once_and_carry_over_stretches(spark, tmp_path):
    at = lambda s: datetime.datetime.fromtimestamp(1_700_000_000 + s)
    # one early version, rows in stretches without any, and versions that the watermark never passes
    left = [(i, i * 50, at(i * 50)) for i in range(1, 40)]
    right = [(1000, 60, at(60), 1.5)] + [(2000 + i, 9000, at(9000), float(i)) for i in range(150)]
    a = arriving(spark, tmp_path / "l", [left, [(5000, 9000, at(9000))]], "id long, t long, at timestamp")
    b = arriving(spark, tmp_path / "r", [right, [(3000, 9000, at(9000), 9.0)]], "id long, t long, at timestamp, v double")
    got, held = drained(spark, joins.asof_joined(a, b, order=["t", "id"], value="v", at="at", delay="2 minutes", shards=4), tmp_path, "stretches")
    assert flat(got) == flat((i, t, 1.5 if t > 60 else None) for i, t, _ in left)
    assert held < 100


@pytest.mark.parametrize(("size", "ttl"), [(1, None), (7, None), (40, None), (7, 3_600_000)])
def test_means_of_a_stream_are_the_batch_operators_to_the_bit(spark, tmp_path, size, ttl):
    rng = random.Random(5)
    rows = [(i, rng.randrange(2), rng.choice([None, *[rng.randrange(1, 50_000) / 100 for _ in range(9)]])) for i in range(200)]
    schema = "i long, k long, v double"
    stream, batch = arriving(spark, tmp_path / "in", [rows[:61], rows[61:62], rows[62:130], rows[130:]], schema), spark.createDataFrame(rows, schema)
    got, _ = drained(spark, streaming.moving_averages(stream, key="k", value="v", order=["i"], size=size, ttl_ms=ttl), tmp_path, f"means{size}")
    want = ordered.moving_avg(batch, key="k", order="i", tie=[], value="v", size=size).select("k", "i", "moving_avg").collect()
    assert {r[1]: r[2] for r in got} == {r.i: r.moving_avg for r in want} and len(got) == 200
