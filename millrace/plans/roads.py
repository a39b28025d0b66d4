"""Queries over positions and highway reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import road, traffic
from ..sources import derive, feeds
from .registry import EVENTS, REPORTS, query

_MEAN = "m AS (SELECT vid, minute, xway, direction, segment, CAST(floor(sum(speed) / count(*)) AS BIGINT) AS avg_speed FROM r GROUP BY ALL)"
_COUNT = "n AS (SELECT minute, xway, direction, segment, count(*) AS count FROM r GROUP BY ALL HAVING count(*) > {least})"
_LAV = """present AS (SELECT DISTINCT xway, direction, segment, minute AS out FROM m),
    z AS (SELECT p.*, m.avg_speed, row_number() OVER (PARTITION BY p.xway, p.direction, p.segment, p.out ORDER BY m.minute, m.vid) AS i FROM present p JOIN m ON m.xway = p.xway AND m.direction = p.direction AND m.segment = p.segment AND m.minute BETWEEN p.out - 4 AND p.out),
    lav AS (SELECT xway, direction, segment, out + 1 AS minute, CAST(floor(sum(avg_speed) / count(*)) AS BIGINT) AS lav FROM z WHERE i <= 11 GROUP BY ALL)"""
_CHANGE = "ch AS (SELECT * FROM (SELECT *, lag(segment) OVER (PARTITION BY vid ORDER BY time, event_id) AS last FROM r WHERE lane <> 4) WHERE last IS NULL OR last <> segment)"
_STATE = "st AS (SELECT ch.*, lav.lav, n.count AS cars FROM ch LEFT JOIN lav USING (xway, direction, segment, minute) LEFT JOIN n ON n.xway = ch.xway AND n.direction = ch.direction AND n.segment = ch.segment AND n.minute = ch.minute - 1)"


def _tolls(least: int) -> str:
    return f"WITH {REPORTS}, {_MEAN}, {_COUNT.format(least=least)}, {_LAV}, {_CHANGE}, {_STATE} SELECT event_id, vid, minute, xway, direction, segment, coalesce(lav, 0) AS speed, CASE WHEN coalesce(lav, 0) < 50 AND coalesce(cars, 0) > {least} {{clear}} THEN 2 * (cars - {least}) * (cars - {least}) ELSE 0 END AS toll FROM st"


@query(f"WITH {REPORTS} SELECT * FROM r")
def lr_feed(spark, sf):
    return derive.reports(spark, sf)


@query(f"WITH {REPORTS}, {_MEAN} SELECT * FROM m")
def avg_speed_vehicle_minute(spark, sf):
    return road.avg_speed_vehicle_minute(derive.reports(spark, sf))


@query(f"WITH {REPORTS} SELECT event_id, avg_speed FROM (SELECT event_id, lag(speed) OVER (PARTITION BY vid ORDER BY time, event_id) AS avg_speed FROM r) WHERE avg_speed IS NOT NULL")
def avg_speed_literal(spark, sf):
    return road.avg_speed_literal(derive.reports(spark, sf)).select("event_id", "avg_speed")


@query(f"WITH {REPORTS}, {_COUNT.format(least=1)} SELECT * FROM n")
def count_vehicles_minute(spark, sf):
    return road.count_vehicles_minute(derive.reports(spark, sf), min_count=1)


@query(f"WITH {REPORTS}, {_MEAN}, {_LAV} SELECT * FROM lav")
def last_avg_speed(spark, sf):
    return road.last_avg_speed(road.avg_speed_vehicle_minute(derive.reports(spark, sf)))


@query(_tolls(1).format(clear=""))
def toll(spark, sf):
    return road.toll(derive.reports(spark, sf), min_count=1)


@query(f"WITH {REPORTS}, {_MEAN}, {_COUNT.format(least=1)}, {_LAV}, {_CHANGE}, {_STATE} SELECT event_id, minute, coalesce(lav, -1) AS lav, coalesce(cars, -1) AS cars FROM st")
def toll_minute_state(spark, sf):
    r = derive.reports(spark, sf)
    state = road.toll_minute_state(road.segment_changes(r), road.last_avg_speed(road.avg_speed_vehicle_minute(r)), road.count_vehicles_minute(r, min_count=1))
    return state.select("event_id", "minute", F.coalesce("lav", F.lit(-1)).alias("lav"), F.coalesce("cars", F.lit(-1)).alias("cars"))


_BLOCKED = "AND NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT xway, direction, segment, minute FROM r WHERE speed = 0) a WHERE a.xway = st.xway AND a.direction = st.direction AND a.minute = st.minute - 1 AND (a.segment - st.segment) * (CASE WHEN st.direction = 0 THEN 1 ELSE -1 END) BETWEEN 0 AND 4)"


@query(_tolls(1).format(clear=_BLOCKED))
def accident_segments(spark, sf):
    """Tolls where stopped vehicles make accidents."""
    r = derive.reports(spark, sf)
    return road.toll(r, min_count=1, accidents=r.where("speed = 0").select("xway", "direction", "segment", "minute").distinct())


@query(f"WITH {REPORTS} SELECT 'moving' AS branch, count(*) AS n FROM r WHERE speed > 0 UNION ALL SELECT 'exit', count(*) FROM r WHERE lane = 4 UNION ALL SELECT 'all', count(*) FROM r")
def broadcast_split(spark, sf):
    """One stream to three branches, from one scan, and their union."""
    branches = {"moving": F.col("speed") > 0, "exit": F.col("lane") == road.EXIT_LANE, "all": F.lit(True)}
    return feeds.branched(derive.reports(spark, sf), branches).groupBy("branch").agg(F.count("*").alias("n"))


@query(f"WITH {REPORTS} SELECT event_id, speed FROM r WHERE direction = 0 UNION ALL SELECT event_id, speed FROM r WHERE lane = 4")
def union_branches(spark, sf):
    r = derive.reports(spark, sf).select("event_id", "speed", "direction", "lane")
    return r.where("direction = 0").unionByName(r.where("lane = 4")).select("event_id", "speed")


_GPS = EVENTS + ", p AS (SELECT event_id, user_id AS vehicle, 39.7005::DOUBLE + (event_id % 400) / 1000.0::DOUBLE + (k - 50) * 2e-6::DOUBLE AS lat, 116.1005::DOUBLE + (user_id % 80) / 1000.0::DOUBLE AS lon, value AS speed, et FROM ev)"
_BOX = {"lat": (39.75, 40.05), "lon": (116.12, 116.17)}


@query(f"WITH {_GPS} SELECT event_id, round(lat, 6) AS lat, round(lon, 6) AS lon FROM p WHERE trunc(speed) >= 0 AND lat BETWEEN 39.75 AND 40.05 AND lon BETWEEN 116.12 AND 116.17")
def filter_bbox_speed(spark, sf):
    return traffic.filter_bbox_speed(derive.gps(spark, sf), **_BOX).select("event_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


_MATCH = (
    _GPS
    + """, s AS (SELECT s_suppkey AS road_no, 39.7005::DOUBLE + (s_suppkey * 4 % 400) / 1000.0::DOUBLE AS y FROM supplier),
    d0 AS (SELECT event_id, road_no, abs(lat - y) AS h, sqrt(pow(lon - 116.1, 2) + pow(lat - y, 2)) AS b, sqrt(pow(lon - 116.1995, 2) + pow(lat - y, 2)) AS c FROM p JOIN s ON floor(lat * 10) = floor(y * 10) AND floor(lon * 10) = 1161),
    d AS (SELECT event_id, road_no, CASE WHEN b <= 1e-6 OR c <= 1e-6 THEN 0 ELSE h END * 111200 AS m FROM d0),
    f AS (SELECT event_id, min(CASE WHEN m < 2.5 THEN road_no END) AS on_road, min_by(road_no, (m, road_no)) AS near, min(m) AS m FROM d GROUP BY event_id),
    q AS (SELECT event_id, coalesce(on_road, CASE WHEN m < sqrt(125) THEN near END)::BIGINT AS road_id FROM f)"""
)


@query(f"WITH {_MATCH} SELECT event_id, road_id FROM q WHERE road_id IS NOT NULL")
def join_nearest_road(spark, sf):
    return traffic.join_nearest_road(derive.gps(spark, sf), derive.roads(spark, sf), point_id="event_id").select("event_id", "road_id")


@query(f"WITH {_MATCH} SELECT road_id, count(*) AS count, round(100.0 * count(*) / sum(count(*)) OVER (), 5)::DOUBLE AS percent FROM q WHERE road_id IS NOT NULL GROUP BY road_id")
def key_distribution(spark, sf):
    return traffic.key_distribution(join_nearest_road(spark, sf), key="road_id")


_GATE = f"""WITH RECURSIVE {_MATCH}, o AS (SELECT road_id, event_id AS seq, CAST(trunc(speed) AS INTEGER) AS sp, row_number() OVER (PARTITION BY road_id ORDER BY event_id) AS i FROM q JOIN p USING (event_id) WHERE road_id IS NOT NULL),
    gate(road_id, i, seq, held, mean, average_speed, count) AS (SELECT road_id, i, seq, [sp], sp, sp, 1 FROM o WHERE i = 1
      UNION ALL SELECT road_id, i, seq, CASE WHEN take THEN list_append(held, sp)[-30:] ELSE held END, CASE WHEN take THEN now ELSE mean END, CASE WHEN take THEN now ELSE 0 END, CASE WHEN take THEN least(n + 1, 30) ELSE 0 END
      FROM (SELECT *, n < 2 OR abs(sp - now) <= 2 * sqrt(dev / n) AS take FROM
        (SELECT o.road_id, o.i, o.seq, o.sp, held, mean, len(held)::INTEGER AS n, CAST(trunc((list_sum(held) + sp) / (len(held) + 1.0)) AS INTEGER) AS now, list_sum(list_transform(held, lambda h: pow(h - mean, 2))) + pow(sp - mean, 2) AS dev FROM gate JOIN o ON o.road_id = gate.road_id AND o.i = gate.i + 1)))
    SELECT road_id, average_speed, count, seq FROM gate"""


@query(_GATE)
def speed_outlier_gate(spark, sf):
    matched = traffic.join_nearest_road(derive.gps(spark, sf), derive.roads(spark, sf), point_id="event_id")
    return traffic.speed_outlier_gate(matched, order="event_id")


_HAV = "2 * 6378137.0 * asin(least(1.0, sqrt(pow(sin(radians({a} - {c}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({b} - {d}) / 2), 2))))"


@query(f"WITH {_GPS} SELECT event_id, round({_HAV.format(a='lat', b='lon', c='39.9', d='116.4')}, 3) AS metres FROM p")
def haversine_dist(spark, sf):
    return derive.gps(spark, sf).select("event_id", F.round(fn.haversine(F.col("lat"), F.col("lon"), F.lit(39.9), F.lit(116.4)), 3).alias("metres"))


@query(f"WITH {_GPS} SELECT event_id, round(CASE WHEN 116.13 < lon AND lon < 116.16 THEN {_HAV.format(a='39.9', b='lon', c='lat', d='lon')} ELSE least({_HAV.format(a='lat', b='lon', c='39.9', d='116.13')}, {_HAV.format(a='lat', b='lon', c='39.9', d='116.16')}) END, 3) AS metres FROM p")
def point_line_geo_dist(spark, sf):
    line = [F.lit(v) for v in (116.13, 39.9, 116.16, 39.9)]
    return derive.gps(spark, sf).select("event_id", F.round(fn.point_line_geo_dist(*line, F.col("lon"), F.col("lat")), 3).alias("metres"))


@query(f"WITH {_GPS} SELECT event_id, lon > 116.12 AND lat > 39.8 AND (lon - 116.12) / 0.05 + (lat - 39.8) / 0.2 < 1 AS inside FROM p")
def point_in_polygon(spark, sf):
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((116.12, 39.8), (116.17, 39.8), (116.12, 40.0))])
    return derive.gps(spark, sf).select("event_id", fn.point_in_polygon(ring, F.col("lon"), F.col("lat")).alias("inside"))


_RINGS = """rings AS (SELECT s_suppkey AS polygon_id, 116.1005::DOUBLE + (s_suppkey % 80) / 1000.0::DOUBLE AS cx, 39.7005::DOUBLE + (s_suppkey * 7 % 400) / 1000.0::DOUBLE AS cy, 0.001::DOUBLE * (1 + s_suppkey % 60) AS r FROM supplier WHERE s_suppkey % 5 = 0),
    corners AS (SELECT polygon_id, unnest([{'x': cx - r, 'y': cy}, {'x': cx, 'y': cy + r / 2}, {'x': cx + r, 'y': cy}, {'x': cx, 'y': cy + r / 5}, {'x': cx, 'y': cy - r}]) AS p, unnest([{'x': cx, 'y': cy + r / 2}, {'x': cx + r, 'y': cy}, {'x': cx, 'y': cy + r / 5}, {'x': cx, 'y': cy - r}, {'x': cx - r, 'y': cy}]) AS q FROM rings)"""


@query(f"WITH {_GPS}, {_RINGS} SELECT event_id, polygon_id::BIGINT AS polygon_id FROM gp JOIN corners ON (p.y > lat) <> (q.y > lat) AND lon < (q.x - p.x) * ((lat - p.y) / (q.y - p.y)) + p.x GROUP BY ALL HAVING count(*) % 2 = 1".replace(", p AS (SELECT event_id", ", gp AS (SELECT event_id"))
def join_polygons(spark, sf):
    """Positions inside polygons of all sizes, concave ones."""
    return traffic.join_polygons(derive.gps(spark, sf).select("event_id", "lat", "lon"), derive.areas(spark, sf)).select("event_id", "polygon_id")
