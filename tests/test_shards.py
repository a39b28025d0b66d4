"""Stream state that is dealt to shards, and filters confirmed by exact rows."""

import random

import pandas as pd

from millrace.operators import sketches, voip
from millrace.streaming import joins, tolls


class Held:
    """A list state and the timers of a handle, as a dict in memory."""

    def __init__(self):
        self.rows, self.timers, self.reads = [], [], 0

    def getListState(self, name, schema, ttl=None):
        return self

    def exists(self):
        return bool(self.rows)

    def get(self):
        self.reads += 1
        return iter(self.rows)

    def put(self, rows):
        self.rows = list(rows)

    def clear(self):
        self.rows = []

    def registerTimer(self, at):
        self.timers.append(at)


class At:
    def __init__(self, mark):
        self.mark = mark

    def getCurrentWatermarkInMs(self):
        return self.mark


def test_a_segment_waits_for_one_timer_however_many_minutes(spark):
    held, minutes = Held(), range(1, 200)
    state = tolls.SegmentMinutes(["event_id", "vid", "minute", "xway", "speed", "toll"], 0, 1, 50, 5, 11)
    state.init(held)
    rows = [(tolls.REPORT, m, v, 10 + v) for m in minutes for v in range(3)] + [(tolls.CHANGE, m, m * 10, 7) for m in minutes]
    first = pd.concat(state.handleInputRows((1,), [pd.DataFrame(rows, columns=["kind", "minute", "id", "a"])], At(0)))
    assert len(first) == 1 and held.timers == [tolls.MINUTE_MS] and held.reads == 0
    last = pd.concat(state.handleExpiredTimer((1,), At(1000 * tolls.MINUTE_MS), None))
    assert len(last) == len(minutes) - 1 and held.reads == 1 and not held.rows
    assert set(zip(last["speed"], last["toll"])) == {(10, 8), (11, 8)}


def test_keys_of_a_shard_are_gathered_and_forgotten_apart(spark):
    held = Held()
    state = joins.Gatherer(["a", "b"], ["k"], ["long"], 100)
    state.init(held)
    step = lambda *rows: pd.concat(state.handleInputRows((0,), [pd.DataFrame(rows, columns=["k", "absent_k", "tag", "value", "absent_value", "at_ms"])], At(0))).values.tolist()
    assert step((1, False, "a", 1.0, False, 10), (2, False, "a", 2.0, False, 50), (0, True, "a", 3.0, False, 20), (0, True, "b", 0.0, True, 20)) == [[None, 3.0, None]]
    list(state.handleExpiredTimer((0,), At(120), None))
    assert held.timers == [110, 150]
    assert step((1, False, "b", 4.0, False, 130), (2, False, "b", 5.0, False, 130)) == [[2, 2.0, 5.0]]


def test_filters_are_confirmed(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, *range(12)]), rng.randrange(5), i // 3) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, a long, b long, t long")
    by = {"keys": ["a", "b"], "order": "t", "tie": ["id"], "row_id": "id"}
    flags = sketches.seen_filter(df, shape=sketches.FilterShape(expected=66, error=0.5, shards=1), **by)
    want = {(i, (a, b) not in {r[1:3] for r in rows[:i]}) for i, a, b, _ in rows}
    assert {tuple(r) for r in flags.collect()} != want
    assert {tuple(r) for r in sketches.confirmed(flags, df, **by).collect()} == want


def test_filter_shapes_grow_with_the_keys(spark):
    few, many = (sketches.filter_shape(spark.range(n), ["id"]) for n in (100, 1_000_000))
    assert few.expected == sketches.FilterShape.expected and many.expected > 1_100_000 and many.bits <= few.bits * 1.01


def test_scores_of_calls_that_have_a_global_mean(spark):
    rng = random.Random(5)
    calls = spark.createDataFrame([(i, rng.randrange(4), rng.randrange(4), i // 2, rng.randrange(60), True) for i in range(200)], "call_id long, calling long, called long, answer_ts long, duration long, established boolean")
    flagged = voip.new_pair_flag(voip.global_acd(calls))
    scores = lambda rows: sorted((r["call_id"], round(r["acd"], 6)) for r in voip.acd_scores(flagged, rows=rows).collect())
    assert flagged.columns.count("global_acd") == voip.global_acd(flagged).columns.count("global_acd") == 1
    assert scores(20) == scores(1000) != []
