"""Sketches in fixed space, and streams that gather, look up as of, settle tolls and sketch latencies, against their batch operators."""

import random

import pytest
from pyspark.sql import functions as F

from millrace import streaming
from millrace.operators import ordered, road, sketches, voip
from millrace.streaming import joins, latency, replay, sketched, tolls

CALLS = "call_id long, calling long, called long, answer_ts long, q double"


@pytest.fixture(autouse=True)
def rocksdb(spark):
    streaming.use_rocksdb(spark)


def arriving(spark, folder, parts, schema):
    """Parts arrive one after the other, a micro-batch each."""
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def drained(spark, df, folder, name):
    """All rows, and how many rows of state are left."""
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(folder / f"cp-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    left = sum(o["numRowsTotal"] for o in q.lastProgress["stateOperators"])
    return spark.table(name).collect(), left


def some_calls(seed, n, callers):
    rng = random.Random(seed)
    maybe = lambda x: None if rng.random() < 0.05 else x
    return [(i, maybe(rng.randrange(callers)), maybe(rng.randrange(callers)), i // 3, maybe(rng.choice([0.5, 1.0, 2.0]))) for i in range(n)]


def flat(rows, places=6):
    return sorted((tuple(round(v, places) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("rows", [7, 250_000])
def test_sketch_never_underrates(spark, rows):
    calls = some_calls(1, 400, 40)
    df = spark.createDataFrame(calls, CALLS).repartition(3)
    exact = {r.call_id: r.c for r in ordered.decayed(df, keys=["calling"], time="answer_ts", tie=["call_id"], amount=F.col("q"), beta=0.95, out="c").collect()}
    for shape, most in ((sketches.SketchShape(8, 3, 2), None), (sketches.SketchShape(1 << 14, 3, 4), 1e-9)):
        by = {"keys": ["calling"], "time": "answer_ts", "tie": ["call_id"], "amount": F.col("q"), "beta": 0.95, "out": "c", "shape": shape}
        got = {r.call_id: r.c for r in sketches.decayed_estimates(df, rows=rows, **by).collect()}
        assert got.keys() == exact.keys() and all(got[i] >= exact[i] - 1e-9 for i in exact)
        over = max(got[i] - exact[i] for i in exact)
        assert over <= most if most else over > 0.1
    total = sum(q or 0.0 for *_, q in calls)
    assert total > 0


def test_sketch_error_follows_its_width(spark):
    """With w cells in a row, half of all keys at least are off by at most 2 / w of the weight in a row, here over 2,000 keys."""
    df = spark.range(20_000).select("id", (F.col("id") * 7919 % 2000).alias("k"), F.lit(0).cast("long").alias("t"))
    for width in (64, 256, 1024):
        shape = sketches.SketchShape(width, 3, 1)
        made = sketches.decayed_sketch(df, keys=["k"], time="t", amount=F.lit(1.0), beta=0.9, shape=shape)
        assert made.count() <= 3 * width
        read = sketches.read_sketch(made, df, keys=["k"], time="t", beta=0.9, out="e", shape=shape)
        off = sorted(r.e - 10 for r in read.collect())
        assert len(off) == 2000 and off[0] >= -1e-6
        assert off[len(off) // 2] <= 2 * 20_000 / width


def test_sketches_merge(spark):
    rows = some_calls(2, 300, 25)
    df = spark.createDataFrame(rows, CALLS)
    shape, by = sketches.SketchShape(32, 2, 4), {"keys": ["calling"], "time": "answer_ts", "amount": F.col("q"), "beta": 0.9}
    whole = sketches.decayed_sketch(df, shape=shape, **by)
    parts = [sketches.decayed_sketch(df.where(c), shape=shape, **by) for c in ("call_id < 100", "call_id between 100 and 199", "call_id >= 200")]
    merged = sketches.merged_sketches(parts[2].unionByName(parts[0]).unionByName(parts[1]), beta=0.9)
    assert flat(merged.select("row", "cell", "value", "at").collect()) == flat(whole.select("row", "cell", "value", "at").collect())
    assert sketches.decayed_sketch(df.limit(0), shape=shape, **by).count() == 0
    with pytest.raises(ValueError):
        sketches.SketchShape(10, 3, 4)


@pytest.mark.parametrize("files", [1, 3])
def test_sketch_on_a_stream(spark, tmp_path, files):
    rows = some_calls(3, 240, 30)
    n, shape = len(rows), sketches.SketchShape(32, 2, 4)
    stream = arriving(spark, tmp_path / "in", [rows[i * n // files : (i + 1) * n // files] for i in range(files)], CALLS)
    by = {"keys": ["calling"], "time": "answer_ts", "beta": 0.97, "amount": F.col("q"), "shape": shape}
    got, left = drained(spark, sketched.sketched_counts(stream, order=["answer_ts", "call_id"], row_id="call_id", **by), tmp_path, f"cells{files}")
    want = sketches.decayed_estimates(spark.createDataFrame(rows, CALLS), tie=["call_id"], out="value", **by).select("call_id", "value").collect()
    assert flat(got) == flat(want)
    assert left == 4  # a row of state for each shard, whatever the keys


def test_filters_rotate_within_their_error(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, rng.randrange(3000), 0, i, None) for i in range(4000)]
    shape = sketches.FilterShape(expected=1200, error=0.05, shards=2)
    df = spark.createDataFrame(rows, CALLS).repartition(3)
    by = {"keys": ["calling", "called"], "row_id": "call_id", "shape": shape}
    batch = sketches.seen_filter(df, order="answer_ts", tie=["call_id"], **by).collect()
    stream = arriving(spark, tmp_path / "in", [rows[:1000], rows[1000:3000], rows[3000:]], CALLS)
    got, left = drained(spark, sketched.seen_filters(stream, order=["answer_ts", "call_id"], **by), tmp_path, "filters")
    assert flat(got) == flat(batch) and left == 2
    first = {}
    for i, k, *_ in rows:
        first.setdefault(k, i)
    new = {r.call_id: r.new for r in batch}
    passed = sum(not new[i] for i in first.values())
    assert 0 < passed / len(first) < 0.1  # five per cent on the way to 1,200 keys, more until filters rotate
    again = sum(new[i] for i, k, *_ in rows if first[k] != i)
    assert 0 < again < 1000  # forgotten by a rotation


def test_gathering_from_three_streams(spark, tmp_path):
    schema, key = "k long, at timestamp, {} double", ["k"]
    at = lambda s: __import__("datetime").datetime.fromtimestamp(1_700_000_000 + s)
    a = arriving(spark, tmp_path / "a", [[(1, at(0), 1.0), (2, at(1), 2.0), (None, at(2), None)], [(3, at(5), 3.0), (1, at(30), 7.0), (9, at(90_000), 0.0)]], schema.format("a"))
    b = arriving(spark, tmp_path / "b", [[(1, at(3), 10.0), (None, at(4), 40.0)], [(2, at(6), 20.0), (1, at(31), 70.0), (9, at(90_000), 0.0)]], schema.format("b"))
    c = arriving(spark, tmp_path / "c", [[(1, at(2), 0.1)], [(None, at(7), 0.4), (1, at(32), 0.7), (9, at(90_000), 0.0)]], schema.format("c"))
    got, left = drained(spark, joins.gathered({"a": a, "b": b, "c": c}, keys=key, at="at", within="10 minutes"), tmp_path, "gathered")
    assert flat(got) == flat([(1, 1.0, 10.0, 0.1), (1, 7.0, 70.0, 0.7), (None, None, 40.0, 0.4), (9, 0.0, 0.0, 0.0)])
    assert left == 0  # keys 2 and 3 never had all and expired


@pytest.mark.parametrize("keyed", [False, True])
def test_as_of_under_shuffled_arrival(spark, tmp_path, keyed):
    rng = random.Random(6)
    base = 1_700_000_000
    left = [(i, rng.choice([1, 2, None]), base + rng.randrange(300)) for i in range(90)]
    right = [(1000 + i, rng.choice([1, 2, None]), base + rng.randrange(300), rng.choice([None, i * 1.0, i + 0.5])) for i in range(60)]
    shuffled = lambda rows: split(sorted(rows, key=lambda r: r[2] + rng.randrange(60)), 3)
    ls, rs = "id long, k long, t long", "id long, k long, t long, v double"
    end = [(5000, 1, base + 10_000)]
    a = arriving(spark, tmp_path / "l", [*shuffled(left), end], ls).withColumn("at", F.timestamp_seconds("t"))
    b = arriving(spark, tmp_path / "r", [*shuffled(right), [(*e, 9.0) for e in end]], rs).withColumn("at", F.timestamp_seconds("t"))
    by = {"order": ["t", "id"], "value": "v", "key": ["k"] if keyed else None}
    got, _ = drained(spark, joins.asof_joined(a, b, at="at", delay="2 minutes", **by, **({} if keyed else {"shards": 3})), tmp_path, f"asof{keyed}")
    if not keyed:
        assert {r.id for r in got} == {r[0] for r in left}
    want = ordered.asof_latest(spark.createDataFrame(left, ls), spark.createDataFrame(right, rs), **by).select("id", "k", "t", "v").collect()
    # a null key never sees its timers beyond its own rows, but every row leaves once the watermark has passed it
    assert flat(r for r in got if r.id < 5000) == flat(want)


def split(rows, n):
    return [rows[i * len(rows) // n : (i + 1) * len(rows) // n] for i in range(n)]


REPORTS = "event_id long, vid long, time long, minute long, speed long, lane int, xway long, direction long, segment long"
ZERO = 1_700_000_000 // 60 * 60


@pytest.mark.parametrize("cuts", [[], [80], [50, 51, 120, 260]])
def test_tolls_for_any_cut(spark, tmp_path, cuts):
    rng = random.Random(7)
    rows = [(i, rng.randrange(8), i * 2, i * 2 // 60 + 1, rng.randrange(3) * 30, rng.randrange(5), rng.randrange(2), rng.randrange(2), rng.randrange(4)) for i in range(300)]
    parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])] + [[(999, 99, 5000, 84, 50, 0, 9, 0, 0)]]
    stream = arriving(spark, tmp_path / "in", parts, REPORTS).withColumn("at", F.timestamp_seconds(F.col("time") + ZERO))
    got, left = drained(spark, tolls.tolls(stream, at="at", zero=ZERO, order=["time", "event_id"], min_count=1, accidents=True), tmp_path, f"tolls{len(cuts)}")
    df = spark.createDataFrame(rows, REPORTS)
    stopped = df.where("speed = 0").select("xway", "direction", "segment", "minute").distinct()
    want = road.toll(df, min_count=1, accidents=stopped).select("event_id", "vid", "minute", "xway", "direction", "segment", "speed", "toll").collect()
    assert flat(r for r in got if r.event_id != 999) == flat(want)
    assert sum(r.toll > 0 for r in got) > 10
    assert left <= 9 + 3  # last segments of vehicles, and the closing report's own


def test_latency_sketches_merge(spark, tmp_path):
    rng = random.Random(8)
    values = [None if rng.random() < 0.1 else int(rng.expovariate(0.001)) for _ in range(9000)]
    parts = [[(v,) for v in values[i * 1800 : (i + 1) * 1800]] for i in range(5)] + [[(None,)] * 5]
    stream = arriving(spark, tmp_path / "in", parts, "ms long")
    latency.latency_sink(stream, F.col("ms"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(240)
    stored = latency.stored_sketches(spark, str(tmp_path / "out"))
    assert stored.count() == 5 and stored.agg(F.max(F.length("sketch"))).first()[0] < 20_000
    whole = latency.merged_latency(stored)
    row = whole.first()
    known = sorted(v for v in values if v is not None)
    assert (row.n, row.p0, row.p100) == (len(known), known[0], known[-1]) and abs(row["mean"] - sum(known) / len(known)) < 1e-6
    errors = latency.rank_errors(whole, spark.createDataFrame([(v,) for v in values], "ms long"), "ms").first()
    assert max(errors) <= 0.01
    assert latency.merged_latency(stored.limit(0)).count() == 0


def test_replay_keeps_every_row(spark):
    df = spark.createDataFrame([(i, None if i % 9 == 0 else i % 50) for i in range(200)], "id long, o long")
    out = replay.drained(replay.replayed(df, "o", parts=3), "whole")
    assert flat(out.collect()) == flat(df.collect())


def test_acd_scores_equal_their_join(spark):
    rng = random.Random(9)
    rows = [(i, rng.randrange(6), rng.randrange(6), i // 2, rng.randrange(100), rng.random() < 0.8) for i in range(200)]
    calls = voip.new_pair_flag(spark.createDataFrame(rows, "call_id long, calling long, called long, answer_ts long, duration long, established boolean"))
    want = voip.acd_score(voip.decayed_sum(calls, out="ct24"), voip.decayed_count(calls, beta=voip.BETA_DAY, out="ecr24"), calls)
    columns = ["call_id", "ct24", "ecr24", "global_acd", "acd"]
    for n in (20, 250_000):
        assert flat(voip.acd_scores(calls, rows=n).select(columns).collect()) == flat(want.select(columns).collect())


@pytest.mark.parametrize("cuts", [[], [1, 30, 31]])
def test_dictionary_grows_once(spark, tmp_path, cuts):
    from millrace.streaming.dictionary import KeyDictionary, grown_dictionary

    rng = random.Random(12)
    rows = [(i, rng.choice([*"abcdef", None, f"k{i // 5}"])) for i in range(90)]
    stream = arriving(spark, tmp_path / "in", [rows[a:b] for a, b in zip([0, *cuts], [*cuts, 60])], "i long, k string")
    where = {"path": str(tmp_path / "keys"), "checkpoint": str(tmp_path / "cp")}
    query, held = grown_dictionary(stream, key="k", order="i", **where)
    query.awaitTermination(120)
    whole = lambda n: flat(ordered.key_dictionary(spark.createDataFrame(rows[:n], "i long, k string"), key="k", order="i").select("k", "key_id").collect())
    assert flat(held.table().collect()) == whole(60)
    # a micro-batch that runs again changes nothing, and another run goes on
    last = spark.createDataFrame(rows[(cuts or [0])[-1] : 60], "i long, k string")
    held.add(last, "i", len(cuts))
    assert flat(held.table().collect()) == whole(60)
    again = arriving(spark, tmp_path / "in", [rows[60:]], "i long, k string")
    query, held = grown_dictionary(again, key="k", order="i", **where)
    query.awaitTermination(120)
    assert flat(held.table().collect()) == whole(90)
    assert KeyDictionary(spark, str(tmp_path / "none"), key="k", kind="string").table().count() == 0


@pytest.mark.parametrize("size", [1, 3, 5])
def test_applications_equal_batch_under_nulls(spark, tmp_path, size):
    from millrace.operators import markov
    from millrace.streaming import applications

    rng = random.Random(13)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([None, 1.0, 2.0, -3.0, 9.0]), rng.choice(["x", "y", "z", None])) for i in range(120)]
    schema = "i long, k string, v double, s string"
    stream, batch = arriving(spark, tmp_path / "in", [rows[:50], rows[50:51], rows[51:]], schema), spark.createDataFrame(rows, schema)
    got, _ = drained(spark, applications.spikes(stream, key="k", value="v", order=["i"], size=size), tmp_path, f"spikes{size}")
    want = ordered.spike_detect(batch, key="k", order="i", tie=[], value="v", size=size)
    assert flat(r[:4] for r in got) == flat(want.select("k", "i", "moving_avg", "v").collect()) and (got or size == 1)
    if size > 1:
        model = markov.model_fit(batch, key="k", order="i", tie=[], state="s")
        for predictor in ("miss_probability", "miss_rate"):
            got, _ = drained(spark, applications.frauds(stream, model, key="k", state="s", order=["i"], threshold=0.5, predictor=predictor, size=size), tmp_path, f"frauds{size}{predictor}")
            want = markov.score_sequences(batch, model, key="k", order="i", tie=[], state="s", predictor=predictor, size=size).where("score > 0.5")
            assert flat(got) == flat(want.select("k", "i", "score").collect()) and got
