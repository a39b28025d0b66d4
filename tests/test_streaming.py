"""Stream twins give what the batch operators give, however the files are split."""

import random
import sys
import time

import pytest
from pyspark.sql import functions as F

from millrace import streaming
from millrace.operators import ads, ordered, traffic


def feed(spark, folder, rows, schema, files):
    for i in range(files):
        part = rows[i * len(rows) // files : (i + 1) * len(rows) // files]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def drain(spark, df, folder, name, mode="append", rows=None):
    """All rows; a stream whose state expires by the clock never ends, and is stopped once it has given ``rows``."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(folder / f"cp-{name}")).trigger(availableNow=True).start()
    if rows is None:
        q.awaitTermination(120)
    else:
        wait_for(spark, name, rows)
        q.stop()
    return spark.table(name).collect()


def wait_for(spark, name, rows):
    end = time.time() + 60
    while spark.table(name).count() < rows and time.time() < end:
        time.sleep(0.2)


@pytest.mark.parametrize("files", [1, 3])
def test_campaign_counts(spark, tmp_path, files):
    rows = [(i % 5, "view" if i % 3 else "click", 1_704_067_200 + i) for i in range(200)] + [(0, "view", 1_704_070_000)]
    stream = feed(spark, tmp_path / "in", rows, "ad_id long, event_type string, et long", files).withColumn("at", F.timestamp_seconds("et"))
    dim = spark.createDataFrame([(i, i % 2) for i in range(4)], "ad_id long, campaign_id long")
    batch = spark.createDataFrame(rows, "ad_id long, event_type string, et long").withColumn("at", F.timestamp_seconds("et"))
    want = {tuple(r) for r in ads.window_count(ads.campaign_views(batch, dim)).collect() if r.window_start < 1_704_069_900}
    assert {tuple(r) for r in drain(spark, streaming.campaign_counts(stream, dim), tmp_path, f"campaigns{files}")} == want


@pytest.mark.skipif(sys.platform == "win32", reason="state processors")
@pytest.mark.parametrize("files", [1, 4])
def test_keyed_state(spark, tmp_path, files):
    rng = random.Random(files)
    rows = [(rng.randrange(3), rng.randrange(20, 90), i, i * 3 + rng.randrange(5), 1.5) for i in range(240)]
    schema = "road_id long, speed int, seq long, t long, q double"
    stream, batch = feed(spark, tmp_path / "in", rows, schema, files), spark.createDataFrame(rows, schema)
    got = {tuple(r) for r in drain(spark, streaming.gated_speeds(stream, order=["seq"]), tmp_path, f"gated{files}")}
    assert got == {tuple(r) for r in traffic.speed_outlier_gate(batch, order="seq").collect()}
    got = {tuple(r) for r in drain(spark, streaming.anchored_counts(stream, key="road_id", time="t", order=["seq"], length=50), tmp_path, f"anchored{files}")}
    assert got == {tuple(r) for r in traffic.win_anchored_count(batch, key="road_id", time="t", order="seq", length=50).collect()}
    once = batch.select("road_id", "seq", "q")
    got = {(r.row_id, round(r.value, 9)) for r in drain(spark, streaming.decayed_counts(stream, key="road_id", time="seq", order=["seq"], amount="q", beta=0.97), tmp_path, f"decayed{files}")}
    assert got == {(r.seq, round(r.c, 9)) for r in ordered.decayed(once, keys=["road_id"], time="seq", tie=[], amount=F.col("q"), beta=0.97, out="c").collect()}


def test_late_rows_one_source(spark, tmp_path):
    rows = [(0, i, t) for i, t in enumerate([9, 10, 9, 25, 19, 20])]
    stream = feed(spark, tmp_path / "in", rows, "src long, seq long, t long", 2)
    got = {(r.row_id, r.late) for r in drain(spark, streaming.tagged_late(stream, source="src", time="t", order=["seq"], length=10), tmp_path, "late")}
    batch = ads.late_rows(spark.createDataFrame(rows, "src long, seq long, t long"), time="t", order="seq", length=10)
    assert got == {(r.seq, r.late) for r in batch.collect()}


def test_word_counts_new_pairs_and_sink(spark, tmp_path):
    rows = [("a", 1, 2, 100 + i) for i in range(6)] + [("b", 1, 3, 200)]
    schema = "word string, calling long, called long, et long"
    stream = feed(spark, tmp_path / "in", rows, schema, 2)
    assert {r.word: r["count"] for r in drain(spark, streaming.word_counts(stream), tmp_path, "words", "complete")} == {"a": 6, "b": 1}
    timed = stream.withColumn("at", F.timestamp_seconds("et"))
    assert len(drain(spark, streaming.new_pairs(timed, at="at", keep="1 hour"), tmp_path, "pairs")) == 2
    q, seen = streaming.count_sink(stream, "sink", str(tmp_path / "cp-sink"))
    q.awaitTermination(60)
    assert sum(x["rows"] for x in seen) == 7


def test_score_join(spark, tmp_path):
    left = [(1, 10, 100, 0.5), (1, 11, 160, 0.7)]
    right = [(1, 10, 105, 2.0), (2, 11, 160, 3.0)]
    a = feed(spark, tmp_path / "l", left, "calling long, call_id long, et long, ecr double", 1).withColumn("at", F.timestamp_seconds("et")).drop("et")
    b = feed(spark, tmp_path / "r", right, "calling long, call_id long, et long, rcr double", 1).withColumn("at", F.timestamp_seconds("et")).drop("et")
    got = drain(spark, streaming.score_join(a, b, at="at", within="30 seconds"), tmp_path, "scores")
    assert [(r.call_id, r.ecr, r.rcr) for r in got] == [(10, 0.5, 2.0)]


def test_list_and_map_state_with_expiry(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.randrange(3), rng.randrange(4), i, float(rng.randrange(50))) for i in range(90)]
    schema = "calling long, called long, seq long, v double"
    stream, batch = feed(spark, tmp_path / "in", rows, schema, 3), spark.createDataFrame(rows, schema)
    got = {(r.row_id, round(r.moving_avg, 9)) for r in drain(spark, streaming.moving_averages(stream, key="calling", value="v", order=["seq"], size=7, ttl_ms=3_600_000), tmp_path, "averages", rows=90)}
    assert got == {(r.seq, round(r.moving_avg, 9)) for r in ordered.moving_avg(batch, key="calling", order="seq", tie=[], value="v", size=7).collect()}
    got = {(r.row_id, r.new_callee) for r in drain(spark, streaming.seen_callees(stream, order=["seq"], ttl_ms=3_600_000), tmp_path, "seen", rows=90)}
    first = {}
    for a, b, i, _ in rows:
        first.setdefault((a, b), i)
    assert got == {(i, first[a, b] == i) for a, b, i, _ in rows}


def test_state_expires(spark, tmp_path):
    schema = "calling long, called long, seq long"
    add = lambda i: spark.createDataFrame([(1, 2, i)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    add(0)
    stream = streaming.seen_callees(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), order=["seq"], ttl_ms=500)
    q = stream.writeStream.format("memory").queryName("forget").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        wait_for(spark, "forget", 1)
        time.sleep(1.5)
        add(1)
        wait_for(spark, "forget", 2)
        assert [(r.row_id, r.new_callee) for r in spark.table("forget").orderBy("row_id").collect()] == [(0, True), (1, True)]
    finally:
        q.stop()


def test_time_modes_and_sink_latency(spark, tmp_path):
    rows = [(i, 1_704_067_200 + i) for i in range(5)]
    stream = feed(spark, tmp_path / "in", rows, "id long, et long", 2)
    assert {r.at.year for r in drain(spark, streaming.timed(stream.withColumn("t", F.timestamp_seconds("et")), mode="event", time="t"), tmp_path, "event")} == {2024}
    ingress = streaming.timed(stream, mode="ingress")
    assert min(r.at.year for r in drain(spark, ingress, tmp_path, "ingress")) > 2024
    q, seen = streaming.count_sink(stream.withColumn("at", F.timestamp_seconds("et")), "stamped", str(tmp_path / "cp-stamped"), stamp="at")
    q.awaitTermination(60)
    assert sum(x["rows"] for x in seen) == 5 and all(x["worst_latency"] >= x["mean_latency"] > 0 for x in seen)
    with pytest.raises(ValueError):
        streaming.timed(stream, mode="processing")


def test_global_means_and_segment_changes(spark, tmp_path):
    from millrace.operators import road

    rng = random.Random(7)
    rows = [(rng.randrange(3), i, rng.choice([0, 4, 1]), rng.randrange(3), float(rng.randrange(9))) for i in range(120)]
    schema = "vid long, time long, lane long, segment long, v double"
    stream, batch = feed(spark, tmp_path / "in", rows, schema, 3), spark.createDataFrame(rows, schema)
    got = {(r.row_id, round(r.average, 9)) for r in drain(spark, streaming.global_means(stream, value="v", order=["time"], age=9.0), tmp_path, "means")}
    assert got == {(r.time, round(r.average, 9)) for r in ordered.ewma_global(batch, order="time", tie=[], value="v", age=9.0).collect()}
    got = {tuple(r) for r in drain(spark, streaming.segment_changes(stream, order=["time"]), tmp_path, "changes")}
    assert got == {(r.vid, r.time, r.segment) for r in road.segment_changes(batch, tie="time").collect()}


def test_map_match_by_batch(spark, tmp_path):
    roads = spark.createDataFrame([(0, 7, 9, 0, 116.1, 39.7, 116.19, 39.7, "397_1161")], "road_no long, road_id long, width int, seg_no int, x1 double, y1 double, x2 double, y2 double, cell string")
    points = [(i, 39.7 + i * 2e-5, 116.15) for i in range(20)]
    schema = "id long, lat double, lon double"
    match = lambda p: traffic.join_nearest_road(p, roads, point_id="id")
    q = streaming.by_batch(feed(spark, tmp_path / "in", points, schema, 3), match, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = {(r.id, r.road_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(r.id, r.road_id) for r in match(spark.createDataFrame(points, schema)).collect()} and len(got) > 3


def test_rate_source(spark):
    from millrace.sources import feeds

    q = feeds.rate_ads(spark, rows_per_second=50, ads=7).writeStream.format("memory").queryName("rate").start()
    try:
        wait_for(spark, "rate", 20)
        rows = spark.table("rate").collect()
        assert all(r.ad_id == r.n % 7 and r.ad_type == r.n % 5 for r in rows) and len(rows) >= 20
    finally:
        q.stop()


NULLS = "key string, called long, vid long, lane int, seq long, t long, v double, segment long, road_id long, speed int"


def null_rows(n=60):
    rng = random.Random(3)
    maybe = lambda x: None if rng.random() < 0.15 else x
    big = 2**60 + 1
    return [(maybe(rng.choice("ab")), maybe(big + rng.randrange(3)), maybe(rng.randrange(2)), maybe(rng.randrange(3)), big + i, maybe(i), maybe(rng.randrange(40) / 2), maybe(rng.randrange(3)), maybe(rng.randrange(2)), maybe(50 + rng.randrange(9))) for i in range(n)]


@pytest.mark.parametrize("name", ["decayed", "moving", "late", "means", "changes", "gate", "anchored", "callees"])
def test_twins_equal_batch_under_nulls(spark, tmp_path, name):
    from millrace.operators import road, voip

    rows = null_rows()
    stream, batch = feed(spark, tmp_path / "in", rows, NULLS, 3), spark.createDataFrame(rows, NULLS)
    flat = lambda rs: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rs), key=repr)
    if name == "decayed":
        got = streaming.decayed_counts(stream, key="key", time="t", order=["seq"], amount="v", beta=0.97).select("row_id", "value")
        want = ordered.decayed(batch, keys=["key"], time="t", tie=["seq"], amount=F.col("v"), beta=0.97, out="c").select("seq", "c")
    elif name == "moving":
        got = streaming.moving_averages(stream, key="key", value="v", order=["seq"], size=5).select("row_id", "moving_avg")
        want = ordered.moving_avg(batch, key="key", order="seq", tie=[], value="v", size=5).select("seq", "moving_avg")
    elif name == "late":
        got = streaming.tagged_late(stream.withColumn("src", F.lit("x")), source="src", time="v", order=["seq"], length=3).select("row_id", "late")
        want = ads.late_rows(batch, time="v", order="seq", length=3).select("seq", "late")
    elif name == "means":
        got = streaming.global_means(stream, value="v", order=["seq"], age=9.0, warm=20.0)
        want = ordered.ewma_global(batch, order="seq", tie=[], value="v", age=9.0, warm=20.0).select("seq", "average")
    elif name == "changes":
        got = streaming.segment_changes(stream, order=["seq"]).select("vid", "row_id", "segment")
        want = road.segment_changes(batch, order="seq", tie="seq").select("vid", "seq", "segment")
    elif name == "gate":
        got, want = streaming.gated_speeds(stream, order=["seq"]), traffic.speed_outlier_gate(batch, order="seq")
    elif name == "anchored":
        got = streaming.anchored_counts(stream, key="key", time="t", order=["seq"], length=5)
        want = traffic.win_anchored_count(batch, key="key", time="t", order="seq", length=5)
    else:
        got = streaming.seen_callees(stream.withColumnRenamed("key", "calling"), order=["seq"]).select("row_id", "called", "new_callee")
        want = voip.new_pair_flag(batch.selectExpr("key as calling", "called", "seq as answer_ts", "seq as call_id")).select("call_id", "called", "new_callee")
    assert flat(drain(spark, got, tmp_path, f"nulls_{name}")) == flat(want.collect())
