"""Roads in grid levels and polygons in cells, against plain loops."""

import math
import random

from pyspark.sql import functions as F

from millrace import functions as fn
from millrace.operators import traffic

ROADS = "road_no long, road_id long, width int, seg_no int, x1 double, y1 double, x2 double, y2 double, cell string"


def off(x1, y1, x2, y2, x, y):
    d = (x2 - x1) ** 2 + (y2 - y1) ** 2
    t = max(0.0, min(1.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / d)) if d else 0.0
    if min(math.hypot(x - x1, y - y1), math.hypot(x - x2, y - y2)) <= 1e-6:
        return 0.0
    return math.hypot(x - x1 - t * (x2 - x1), y - y1 - t * (y2 - y1))


def some_roads(rng, n, wide=None):
    rows = []
    for i in range(n):
        x, y = 116.0 + rng.random() * 0.3, 39.0 + rng.random() * 0.3
        rows.append((i, 100 + i, rng.choice([None, 0, 8, 30, 120]), 0, x, y, x + rng.uniform(-0.01, 0.01), y + rng.choice([0.0, rng.uniform(-0.01, 0.01)]), f"{math.floor(y * 10)}_{math.floor(x * 10)}"))
    if wide:
        rows.append(wide)
    return rows


def test_nearest_roads_equal_a_loop(spark):
    rng = random.Random(1)
    wide = (-1, 999, 20_000, 0, 116.15, 39.15, 116.16, 39.16, "391_1161")
    roads = some_roads(rng, 60, wide)
    points = [(i, 39.0 + rng.random() * 0.3, 116.0 + rng.random() * 0.3) for i in range(400)]
    for r in roads[:60]:  # near and on roads
        points.append((len(points), r[5] + rng.uniform(-3e-4, 3e-4), r[4] + rng.uniform(-3e-4, 3e-4)))
    want = set()
    for i, lat, lon in points:
        own = sorted(r for r in roads if r[8] == f"{math.floor(lat * 10)}_{math.floor(lon * 10)}")
        metres = [(off(*r[4:8], lon, lat) * fn.DEGREE_METRES, r) for r in own]
        width = lambda r: r[2] if r[2] and r[2] > 0 else 5
        on = [r for m, r in metres if m < width(r) / 2]
        near = [(m, r) for m, r in metres if own and m < math.sqrt(width(own[-1]) ** 2 + 100)]
        if on or near:
            want.add((i, on[0][1] if on else min(near, key=lambda x: (x[0], x[1][0], x[1][3]))[1][1]))
    df = spark.createDataFrame(points, "id long, lat double, lon double")
    got = {tuple(r) for r in traffic.join_nearest_road(df, spark.createDataFrame(roads, ROADS), point_id="id").select("id", "road_id").collect()}
    assert got == want and len({r for _, r in want}) > 20


def test_one_wide_road_moves_no_other(spark):
    roads = some_roads(random.Random(2), 40)
    wide = (-1, 999, 20_000, 0, 118.15, 39.15, 118.16, 39.16, "391_1181")
    filed = lambda rows: {tuple(r) for r in traffic.file_roads(spark.createDataFrame(rows, ROADS)).where("road_id <> 999").select("road_id", "_level", "_ix", "_iy").collect()}
    assert filed(roads) == filed([*roads, wide])
    levels = {r[0] for r in traffic.file_roads(spark.createDataFrame([*roads, wide], ROADS)).select("_level").distinct().collect()}
    assert len(levels) > 1
    assert traffic.join_nearest_road(spark.createDataFrame([(1, 39.0, 116.0)], "id long, lat double, lon double"), spark.createDataFrame([], ROADS), point_id="id").count() == 0


def even_odd(ring, x, y):
    inside = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if (ay > y) != (by > y) and x < (bx - ax) * ((y - ay) / (by - ay)) + ax:
            inside = not inside
    return inside


def test_polygons_equal_a_loop(spark):
    rng = random.Random(3)
    rings = []
    for size in (0.0003, 0.002, 0.05, 0.4, 3.0):
        for _ in range(6):
            cx, cy = 10 + rng.random(), -5 + rng.random()
            corners = [(cx + rng.uniform(-size, size), cy + rng.uniform(-size, size)) for _ in range(rng.randrange(3, 9))]
            rings.append(corners)
    rings += [[], [(10.0, -5.0), (11.0, -5.0)], [(10.2, -4.8), (10.2, -4.2), (10.6, -4.2), (10.6, -4.8), (10.2, -4.8)]]
    points = [(i, 9.5 + 2 * rng.random(), -5.5 + 2 * rng.random()) for i in range(500)]
    points += [(1000 + i, r[0][0] + rng.uniform(-1e-3, 1e-3), r[0][1] + rng.uniform(-1e-3, 1e-3)) for i, r in enumerate(rings) if r]
    points += [(5000, None, 1.0)]
    polygons = spark.createDataFrame([(i, [{"x": x, "y": y} for x, y in r]) for i, r in enumerate(rings)], "polygon_id long, ring array<struct<x: double, y: double>>")
    df = spark.createDataFrame(points, "id long, lon double, lat double")
    got = sorted(tuple(r) for r in traffic.join_polygons(df, polygons).select("id", "polygon_id").collect())
    want = sorted((i, j) for i, x, y in points if x is not None for j, r in enumerate(rings) if len(r) > 2 and even_odd(r, x, y))
    assert got == want and len(want) > 500
    filed = traffic.file_polygons(polygons)
    assert filed.groupBy("polygon_id").count().agg(F.max("count")).first()[0] < 2500
    assert filed.where("not _edge").count() > 100
    assert traffic.join_polygons(df, polygons.limit(0)).count() == 0


def test_narrowest_ranges_equal_a_loop(spark):
    from millrace.operators import logs

    rng = random.Random(5)
    ranges = [(0, 2**32 - 1, "all"), (5, 5, "one"), (5, 5, "eins"), (9, 3, "backwards")]
    for i in range(80):
        lo = rng.randrange(2000)
        ranges.append((lo, lo + rng.choice([0, 1, 7, 64, 500, 2**20]), f"r{i}"))
    rows = [(i, rng.choice([None, 5, rng.randrange(3000), 2**32 - 1])) for i in range(300)]
    want = set()
    for i, ip in rows:
        held = [(hi - lo, -lo, lo, hi, name) for lo, hi, name in ranges if ip is not None and lo <= ip <= hi]
        if held:
            want.add((i, min(held)[-1]))
    df, rg = spark.createDataFrame(rows, "id long, ip_num long"), spark.createDataFrame(ranges, "lo long, hi long, name string")
    for block in (20, 250_000):
        got = [tuple(r) for r in logs.ip_geo_lookup(df, rg, block=block).select("id", "name").collect()]
        assert len(got) == len(set(got)) and set(got) == want
    blocks = logs.aligned_blocks(rg).collect()
    assert len(blocks) < 60 * len(ranges) and max(r._level for r in blocks) == 32
    covered = sum(2 ** r._level for r in logs.aligned_blocks(rg.where("name like 'r%'")).collect())
    assert covered == sum(hi - lo + 1 for lo, hi, name in ranges if name[0] == "r")
    assert logs.ip_geo_lookup(df, rg.limit(0)).count() == 0


def test_roads_in_one_place_are_filed_once(spark):
    rng = random.Random(7)
    roads = some_roads(rng, 12)
    copies = [(r[0] + 1000 * c, r[1] + 1000 * c, *r[2:]) for c in range(1, 40) for r in roads]
    points = [(i, r[5] + rng.uniform(-3e-5, 3e-5), r[4] + rng.uniform(-3e-5, 3e-5)) for i, r in enumerate(roads * 4)]
    df = spark.createDataFrame(points, "id long, lat double, lon double")
    found = lambda rows: sorted(tuple(r) for r in traffic.join_nearest_road(df, spark.createDataFrame(rows, ROADS), point_id="id").select("id", "road_id").collect())
    # the last road of a cell, whose width counts, is a copy of the last one before
    assert found(copies + roads) == found(roads) and found(roads)
    filed = lambda rows: traffic.file_roads(spark.createDataFrame(rows, ROADS)).count()
    assert filed(copies + roads) == filed(roads)


def test_polygons_of_one_ring_are_tested_once(spark, monkeypatch):
    ring = lambda x, r: [(x - r, 39.1), (x, 39.1 + r), (x + r, 39.1), (x, 39.1 - r)]
    kind = "polygon_id long, ring array<struct<x: double, y: double>>"
    areas = spark.createDataFrame([(10 * k + i, ring(116.0 + i / 100, 0.02)) for k in range(30) for i in range(3)], kind)
    rng = random.Random(8)
    points = [(i, 39.1 + rng.uniform(-0.03, 0.03), 116.0 + rng.uniform(-0.03, 0.05)) for i in range(300)]
    filed, file = [], traffic.file_polygons
    monkeypatch.setattr(traffic, "file_polygons", lambda polygons, **more: filed.append(polygons.count()) or file(polygons, **more))
    got = {tuple(r) for r in traffic.join_polygons(spark.createDataFrame(points, "id long, lat double, lon double"), areas).select("id", "polygon_id").collect()}
    want = {(i, 10 * k + j) for i, lat, lon in points for j in range(3) if abs(lon - 116.0 - j / 100) + abs(lat - 39.1) < 0.02 for k in range(30)}
    assert got == want and want and filed == [3]


def test_cuts_of_ranges_are_made_once_and_wide_blocks_are_broadcast(spark, monkeypatch):
    from millrace.operators import logs

    rng = random.Random(9)
    ranges = [(0, 2**32 - 1, "all"), (1024, 2047, "far"), (1000, 900, "backwards")] + [(lo, lo + rng.choice([0, 5, 63]), f"r{i}") for i, lo in enumerate(rng.choices(range(3000), k=120))]
    rg, df = spark.createDataFrame(ranges, "lo long, hi long, name string"), spark.createDataFrame([(i, i * 7) for i in range(500)], "id long, ip_num long")
    # a range has no blocks wider than itself
    assert all(2**r._level <= r.hi - r.lo + 1 for r in logs.aligned_blocks(rg).collect())
    many = logs.disjoint_ranges(rg)
    assert "BroadcastHashJoin" in many._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(logs, "FEW_BLOCKS", 0)
    few = logs.disjoint_ranges(rg)
    assert sorted(map(repr, few.collect())) == sorted(map(repr, many.collect())) and many.count() == many.select("_from").distinct().count()
    monkeypatch.undo()
    made = []
    disjoint = logs.disjoint_ranges
    monkeypatch.setattr(logs, "disjoint_ranges", lambda *a, **k: made.append(disjoint(*a, **k)) or made[0])
    found = logs.ip_geo_lookup(df, rg, block=20)
    assert found.count() == 500 and "InMemoryTableScan" in found._jdf.queryExecution().executedPlan().toString()
    spark.catalog.clearCache()


def test_rows_of_a_ring_come_together_and_take_few_bytes(spark, monkeypatch, tmp_path):
    ring = lambda x, r: [(x - r, 39.1), (x, 39.1 + r), (x + r, 39.1), (x, 39.1 - r)]
    kind = "polygon_id long, ring array<struct<x: double, y: double>>"
    # twelve rings, each that of 100 polygons, and a polygon without an id
    areas = spark.createDataFrame([(12 * k + i, ring(116.0 + i / 200, 0.02)) for k in range(100) for i in range(12)] + [(None, ring(116.0, 0.02))], kind)
    rng = random.Random(10)
    points = [(i, 39.1 + rng.uniform(-0.03, 0.03), 116.0 + rng.uniform(-0.03, 0.08)) for i in range(4000)] + [(5000, None, 116.0), (5001, 39.1, float("nan"))]
    want = [(i, j) for i, lat, lon in points if lat is not None for j in range(12) if abs(lon - 116.0 - j / 200) + abs(lat - 39.1) < 0.02]
    monkeypatch.setattr(traffic, "DEALT_POINTS", 1500, raising=False)
    found = traffic.join_polygons(spark.createDataFrame(points, "id long, lat double, lon double"), areas).select("id", "polygon_id")
    found.write.parquet(f"{tmp_path}/rows")
    assert len(want) > 5000 and sum(p.stat().st_size for p in tmp_path.glob("rows/*.parquet")) < 0.5 * 100 * len(want)
    rows = spark.read.parquet(f"{tmp_path}/rows")
    assert rows.count() == 100 * len(want) and {tuple(r) for r in rows.select("id", F.col("polygon_id") % 12).distinct().collect()} == set(want)
    assert rows.groupBy("id", F.col("polygon_id") % 12).agg(F.countDistinct("polygon_id").alias("n")).where("n <> 100").count() == 0
    # in each of three tasks, a point's polygons of one ring follow one another
    parts = found.rdd.glom().map(lambda p: [(r.id, r.polygon_id % 12) for r in p]).collect()
    runs = sum(1 + sum(a != b for a, b in zip(p, p[1:])) for p in parts if p)
    assert sum(map(bool, parts)) == 3 and runs == len(want)
