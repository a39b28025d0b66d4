"""Positions to roads, and road speeds gated by outliers."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import DEGREE_METRES, odd_crossings, planar_dist, point_in_polygon, ring_sides
from ..sources.storage import stored
from .ads import BROADCAST_ROWS, sized
from .ordered import asof_latest, block_count, running

#: Width of a road that gives none, and how far off the nearest road may lie, in metres.
ROAD_WIDTH, NEAR = 5, 10
RING = 30
#: Points of a task that joins them with polygons.
DEALT_POINTS = 50_000


def filter_bbox_speed(points: DataFrame, *, lat: tuple[float, float], lon: tuple[float, float]) -> DataFrame:
    """Points inside a box, bounds included, whose speed cut to a whole number isn't negative."""
    return points.where((F.col("speed").cast("int") >= 0) & F.col("lat").between(*lat) & F.col("lon").between(*lon))


def segment_cells(segments: DataFrame, reach: Column, size: Column) -> DataFrame:
    """Segments (x1, y1, x2, y2) filed under each square cell (``_ix``, ``_iy``, of ``size``) that lies within ``reach`` of them, all in degrees.

    A segment is cut column by column, so that a slanted one doesn't fill its whole box.
    """
    cell = lambda v: F.floor(v / size)
    left, right = F.least("x1", "x2"), F.greatest("x1", "x2")
    columns = segments.withColumn("_ix", F.explode(F.sequence(cell(left - reach), cell(right + reach))))
    # the part of the segment that points of the column can be near to
    near = lambda x: F.greatest(left, F.least(right, x))
    height = lambda x: F.when(F.col("x1") == F.col("x2"), None).otherwise(F.col("y1") + (F.col("y2") - F.col("y1")) * F.try_divide(near(x) - F.col("x1"), F.col("x2") - F.col("x1")))
    a, b = height(F.col("_ix") * size - reach), height((F.col("_ix") + 1) * size + reach)
    low = F.coalesce(F.least(a, b), F.least("y1", "y2")) - reach
    high = F.coalesce(F.greatest(a, b), F.greatest("y1", "y2")) + reach
    # a sliver more, so that rounding loses no cell
    return columns.withColumn("_iy", F.explode(F.sequence(cell(low - 1e-9), cell(high + 1e-9))))


def level_of(extent: Column, base: float) -> Column:
    """The grid, of cells of ``base`` doubled as often as this says, whose cells are no smaller than an extent."""
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(extent, F.lit(base)) / base))).cast("int")


def at_levels(points: DataFrame, filed: DataFrame, base: float, *, x: str, y: str) -> DataFrame:
    """Points once for each level that ``filed`` (with ``_level``) has, some dozens at most, with their cell there."""
    levels = sorted(r[0] for r in filed.select("_level").distinct().collect())
    size = F.pow(F.lit(2.0), F.col("_level")) * base
    spread = points.withColumn("_level", F.explode(F.array(*[F.lit(v) for v in levels]) if levels else F.array().cast("array<int>")))
    return spread.withColumn("_ix", F.floor(F.col(x) / size)).withColumn("_iy", F.floor(F.col(y) / size))


def file_roads(roads: DataFrame, *, cell_degrees: float = 0.002) -> DataFrame:
    """Road segments under the cells that they can win points of, at the level of their own reach: a wide road makes no other's cells larger.

    A segment reaches half its width, and as far as the width of its 0.1 degree cell's last road lets the nearest road lie off. Of segments
    that lie in one place with one width the first in the roads' order stands for all.
    """
    width = F.when(F.coalesce("width", F.lit(0)) > 0, F.col("width")).otherwise(ROAD_WIDTH)
    roads = roads.withColumn("_width", width)
    lasts = roads.groupBy("cell").agg(F.max_by("_width", F.struct("road_no", "seg_no")).alias("_last_width"))
    reach = F.greatest(F.col("_width") / 2, F.sqrt(F.col("_last_width") * F.col("_last_width") + NEAR * NEAR)) / DEGREE_METRES
    held = roads.join(sized(lasts), "cell").withColumn("_reach", reach).withColumn("_level", level_of(2 * reach, cell_degrees))
    # of segments alike in all that a point is judged by, none but the first can win
    alike = ["_level", "cell", "_last_width", "_width", "_reach", "x1", "y1", "x2", "y2"]
    firsts = held.groupBy(*alike).agg(F.min(F.struct("road_no", "seg_no", "road_id")).alias("_first")).select(*alike, "_first.*")
    filed = segment_cells(firsts, F.col("_reach"), F.pow(F.lit(2.0), F.col("_level")) * cell_degrees)
    return filed.select("_level", "_ix", "_iy", F.col("cell").alias("_cell"), "_last_width", "_width", "_reach", "road_no", "seg_no", "road_id", "x1", "y1", "x2", "y2")


def join_nearest_road(points: DataFrame, roads: DataFrame, *, point_id: str, cell_degrees: float = 0.002) -> DataFrame:
    """Points with ``road_id``: the first road of their 0.1 degree cell closer than half its width, else the nearest within reach; others drop.

    Only roads near enough to win are candidates: segments are filed under fine cells that they come within reach of, in grids of several
    levels, and meet the points by an equi-join on level and cell. The 0.1 degree cell (column ``cell`` of the roads) is a filter,
    and the width of its last road sets how far off its nearest road may lie. Candidates of a point meet in an aggregate, not in a
    list. ``point_id`` tells points apart: rows that share one, or have none, are one point; points without coordinates drop.
    """
    filed = sized(file_roads(roads, cell_degrees=cell_degrees))
    cell = F.concat_ws("_", F.floor(F.col("lat") * 10), F.floor(F.col("lon") * 10))
    placed = at_levels(points.withColumn("cell", cell), filed, cell_degrees, x="lon", y="lat")
    inside = lambda v, p, q: F.col(v).between(F.least(p, q) - 2 * F.col("_reach"), F.greatest(p, q) + 2 * F.col("_reach"))
    pairs = placed.join(filed, ["_level", "_ix", "_iy"]).where((F.col("cell") == F.col("_cell")) & inside("lat", "y1", "y2") & inside("lon", "x1", "x2"))
    pairs = pairs.withColumn("_m", planar_dist(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), F.col("lon"), F.col("lat")) * DEGREE_METRES)
    on = F.col("_m") < F.col("_width") / 2
    near = F.col("_m") < F.sqrt(F.col("_last_width") * F.col("_last_width") + NEAR * NEAR)
    # those on the road come before those near it, in the roads' order; those near by distance
    best = F.min(F.when(on | near, F.struct(F.when(on, 0).otherwise(1).alias("far"), F.when(on, 0.0).otherwise(F.col("_m")).alias("m"), "road_no", "seg_no", "road_id")))
    rest = [c for c in points.columns if c != point_id]
    met = pairs.groupBy(point_id).agg(best.alias("_best"), *([F.any_value(F.struct(*rest)).alias("_point")] if rest else []))
    return met.select(point_id, *[F.col("_point")[c].alias(c) for c in rest], F.col("_best.road_id").alias("road_id")).where("road_id is not null")


def file_polygons(polygons: DataFrame, *, cell_degrees: float = 0.002, across: int = 32) -> DataFrame:
    """Polygons (polygon_id, ring: array of structs x, y) under the cells that they touch: _level, _ix, _iy, polygon_id and ``_edge``.

    Cells that a side comes near are edge cells; of the others those with their centre inside are inner cells, which lie
    inside as a whole. A polygon is filed at the level at which it is at most ``across`` cells wide and high, so that it has some thousand
    cells at most, whatever its size.
    """
    bound = lambda f, c: f(F.transform("ring", lambda p: p[c]))
    boxed = polygons.where(F.size("ring") > 2).select("polygon_id", "ring", *[bound(f, c).alias(n + c) for n, f in (("_lo_", F.array_min), ("_hi_", F.array_max)) for c in ("x", "y")])
    extent = F.greatest(F.col("_hi_x") - F.col("_lo_x"), F.col("_hi_y") - F.col("_lo_y")) / across
    held = boxed.withColumn("_level", level_of(extent, cell_degrees)).withColumn("_size", F.pow(F.lit(2.0), F.col("_level")) * cell_degrees)
    segments = held.select("polygon_id", "_level", "_size", F.explode(ring_sides(F.col("ring"))).alias("s")).select("polygon_id", "_level", "_size", F.col("s.p.x").alias("x1"), F.col("s.p.y").alias("y1"), F.col("s.q.x").alias("x2"), F.col("s.q.y").alias("y2"))
    edges = segment_cells(segments, F.col("_size") * 1e-6, F.col("_size")).select("polygon_id", "_level", "_ix", "_iy").distinct().withColumn("_edge", F.lit(True))
    cells = lambda c: F.explode(F.sequence(F.floor(F.col(f"_lo_{c}") / F.col("_size")), F.floor(F.col(f"_hi_{c}") / F.col("_size"))))
    whole = held.withColumn("_ix", cells("x")).withColumn("_iy", cells("y")).join(edges, ["polygon_id", "_level", "_ix", "_iy"], "left_anti")
    centre = lambda c: (F.col(c) + 0.5) * F.col("_size")
    inner = whole.where(point_in_polygon(F.col("ring"), centre("_ix"), centre("_iy"))).select("polygon_id", "_level", "_ix", "_iy").withColumn("_edge", F.lit(False))
    return edges.unionByName(inner)


def join_polygons(points: DataFrame, polygons: DataFrame, *, x: str = "lon", y: str = "lat", cell_degrees: float = 0.002) -> DataFrame:
    """Points with the ``polygon_id`` of each polygon that holds them (even-odd), a row for each; others drop.

    Points meet cells by an equi-join; only those in edge cells meet the polygon's sides for the test. Polygons of one ring are filed and tested
    once, under the least of their ids, and all of them join what that one holds. ``polygon_id`` tells polygons apart; those without one drop.

    There are as many rows as points times polygons around them. Points are dealt to tasks of some ``DEALT_POINTS`` by their place, and in a task a
    ring's points come one after the other, each with the same list of polygons: files of such rows take a small part of what they take in the points' order.
    """
    polygons = polygons.where((F.size("ring") > 2) & F.col("polygon_id").isNotNull())
    first = polygons.groupBy("ring").agg(F.min("polygon_id").alias("_first"))
    lists = polygons.select("ring", F.col("polygon_id").alias("_member")).join(first, "ring").groupBy(F.col("_first").alias("polygon_id")).agg(F.sort_array(F.collect_list("_member")).alias("_members"))
    rings = first.select(F.col("_first").alias("polygon_id"), "ring")
    filed = sized(file_polygons(rings, cell_degrees=cell_degrees))
    bound = lambda f, c: f(F.transform("ring", lambda p: p[c]))
    tests = rings.select("polygon_id", ring_sides(F.col("ring")).alias("_sides"), *[bound(f, c).alias(n + c) for n, f in (("_lo_", F.array_min), ("_hi_", F.array_max)) for c in ("x", "y")])
    tasks = max(1, -(-points.count() // DEALT_POINTS))
    # a block is a part of what lies in a wide cell, no more than a task's share; maps have no hash
    cell = lambda c: F.floor(F.col(c) / (8 * cell_degrees))
    share = F.pmod(F.xxhash64(*[c for c, kind in points.dtypes if "map<" not in kind]), F.lit(tasks))
    dealt = points.dropna(subset=[x, y]).withColumn("_block", F.struct(cell(y).alias("y"), cell(x).alias("x"), share.alias("share"))).repartitionByRange(tasks, "_block")
    met = at_levels(dealt, filed, cell_degrees, x=x, y=y).join(filed, ["_level", "_ix", "_iy"]).join(sized(tests), "polygon_id")
    in_box = F.col(x).between(F.col("_lo_x"), F.col("_hi_x")) & F.col(y).between(F.col("_lo_y"), F.col("_hi_y"))
    inside = in_box & odd_crossings(F.col("_sides"), F.col(x), F.col(y))
    held = met.where(~F.col("_edge") | inside).groupBy("_block", "polygon_id").agg(F.collect_list(F.struct(*points.columns)).alias("_points"))
    members = F.broadcast(lists) if polygons.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else lists
    each = held.join(members, "polygon_id").select("_members", F.explode("_points").alias("_point"))
    return each.select(*[F.col("_point")[c].alias(c) for c in points.columns], F.explode("_members").alias("polygon_id"))


def key_distribution(rows: DataFrame, *, key: str) -> DataFrame:
    """Count of each key and its per cent of all rows, to five places."""
    counts = rows.groupBy(key).agg(F.count("*").alias("count"))
    total = rows.agg(F.count("*").alias("_all"))
    return counts.join(F.broadcast(total)).select(key, "count", F.round(100.0 * F.col("count") / F.col("_all"), 5).alias("percent"))


class SpeedGate:
    """One road's state: the last speeds accepted and their mean. Batch and stream share it."""

    def __init__(self, speeds: list[int] | None = None, mean: int = 0):
        self.speeds, self.mean = list(speeds or []), mean
        self.total, self.squares = sum(self.speeds), sum(s * s for s in self.speeds)

    def step(self, speed: int) -> tuple[int, int]:
        """Mean and count after a speed, or zeros where it is rejected."""
        n = len(self.speeds)
        if n < 2:
            self._take(speed)
            self.mean = int(self.total / len(self.speeds))
            return self.mean, len(self.speeds)
        now = int((self.total + speed) / (n + 1))
        off = speed - self.mean
        spread = math.sqrt((self.squares - 2 * self.mean * self.total + n * self.mean * self.mean + off * off) / n)
        if abs(speed - now) > 2 * spread:
            return 0, 0
        self._take(speed)
        self.mean = now
        return now, len(self.speeds)

    def _take(self, speed: int) -> None:
        self.speeds.append(speed)
        self.total, self.squares = self.total + speed, self.squares + speed * speed
        if len(self.speeds) > RING:
            gone = self.speeds.pop(0)
            self.total, self.squares = self.total - gone, self.squares - gone * gone


def same_key(a, b) -> bool:
    """Keys as a grouping has them: null is a key, and NaN is one as well."""
    return a == b or (a != a and b != b)


def ordered_scan(df: DataFrame, scan: Callable, *, key: str, order: list[str], schema: T.StructType) -> DataFrame:
    """Run a state machine over each key's rows in order, an Arrow batch at a time; one key's state at a time is held.

    ``scan`` takes the state (None at a key's first rows), the key and a run of its rows as a record batch, and returns the next
    state and the columns of output rows. For state that doesn't compose: a key's rows are in one task, but stream
    through it. A null key is a key like any other.
    """
    arrow = to_arrow_schema(schema)
    place = df.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started, last, state = False, None, None
        for batch in batches:
            keys = batch.column(place).to_pylist()
            bounds = [0, *(i for i in range(1, len(keys)) if not same_key(keys[i - 1], keys[i])), len(keys)]
            for lo, hi in zip(bounds, bounds[1:]):
                if lo == hi:
                    continue
                k = keys[lo]
                if not started or not same_key(k, last):
                    started, last, state = True, k, None
                state, columns = scan(state, k, batch.slice(lo, hi - lo))
                if columns and len(columns[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def speed_outlier_gate(rows: DataFrame, *, road: str = "road_id", speed: str = "speed", order: str) -> DataFrame:
    """Mean road speed after each row; a speed more than two deviations off gives zeros and is left out. Rows without a speed drop."""

    def scan(gate, k, batch):
        gate = gate or SpeedGate()
        made = [gate.step(s) for s in batch.column(1).to_pylist()]
        return gate, [[k] * len(made), [m for m, _ in made], [n for _, n in made], batch.column(2)]

    slim = rows.where(F.col(speed).isNotNull()).select(F.col(road).alias("road_id"), F.col(speed).cast("int").alias("speed"), F.col(order).alias("seq"))
    schema = T.StructType([T.StructField("road_id", slim.schema["road_id"].dataType), T.StructField("average_speed", T.IntegerType()), T.StructField("count", T.IntegerType()), T.StructField("seq", slim.schema["seq"].dataType)])
    return ordered_scan(slim, scan, key="road_id", order=["seq"], schema=schema)


class AnchoredWindow:
    """One key's open window: where it starts and how many rows it has. Batch and stream share it."""

    def __init__(self, length: int, start: int | None = None, count: int = 0):
        self.length, self.start, self.count = length, start, count

    def take(self, times: list[int]) -> tuple[list[int], list[int]]:
        """Counts and trigger times of the windows that the next rows close.

        A window is closed by the first row at or past its end; all rows before that lie under it, so that the next closing
        row is where the running greatest time reaches the end, found by halving.
        """
        counts, triggers, at = [], [], 0
        if self.start is None and times:
            self.start, self.count, at = times[0], 1, 1
        tops, most = [], -math.inf
        for t in times:
            most = t if t > most else most
            tops.append(most)
        while at < len(times):
            end = bisect_left(tops, self.start + self.length, at)
            self.count += sum(t >= self.start for t in times[at:end])
            if end == len(times):
                break
            counts.append(self.count)
            triggers.append(times[end])
            self.start, self.count, at = times[end], 1, end + 1
        return counts, triggers


def win_anchored_count(rows: DataFrame, *, key: str, time: str, order: str, length: int, tie: list[str] | None = None, block: int | None = None) -> DataFrame:
    """Windows that open at a row: a row at or past the end emits (key, count, its time) and opens the next; earlier rows than the start drop; the last window is not emitted.

    ``order`` (numeric) and ``tie`` tell rows apart; rows without a time take no part. A table of one block steps through each key's rows in order. In a
    larger one a hot key's rows are spread: an opening row is later in time than all before it, so that each such row's successor, the
    first one at or past its end, is known without the windows before; which of them are windows, doubling of successors tells.
    """
    ties = [f"_t{i}" for i in range(len(tie or []))]
    slim = rows.where(F.col(time).isNotNull()).select(F.col(key).alias("_k"), F.col(time).cast("long").alias("_at"), F.col(order).alias("_o"), *[F.col(c).alias(t) for c, t in zip(tie or [], ties, strict=True)])
    blocks = block_count(slim, block)
    if blocks > 1:
        return _anchored_by_doubling(slim, key, length, ties, blocks)

    def scan(window, k, batch):
        window = window or AnchoredWindow(length)
        counts, triggers = window.take(batch.column(1).to_pylist())
        return window, [[k] * len(counts), counts, triggers]

    schema = T.StructType([T.StructField(key, slim.schema["_k"].dataType), T.StructField("count", T.LongType()), T.StructField("trigger_ts", T.LongType())])
    return ordered_scan(slim, scan, key="_k", order=["_o", *ties], schema=schema)


def _anchored_by_doubling(slim: DataFrame, key: str, length: int, ties: list[str], blocks: int) -> DataFrame:
    lines = stored(running(slim, ["_k"], "_o", ties, count="_n", tops={"_top": F.col("_at")}, own=False, blocks=blocks), "anchored-lines")
    # rows later in time than all before them: their times are distinct and rise with the order
    tops = lines.where("_top is null or _at > _top").select("_k", "_at", "_n")
    asked = tops.select("_k", "_at", (-(F.col("_at") + length)).alias("_back"))
    jumps = [stored(asof_latest(asked, tops.select("_k", (-F.col("_at")).alias("_back"), F.col("_at").alias("_next")), order=["_back"], value="_next", key=["_k"], blocks=blocks).select("_k", "_at", "_next"), "anchored-next")]
    while not jumps[-1].where("_next is not null").isEmpty():
        a, b = jumps[-1].where("_next is not null").alias("a"), jumps[-1].where("_next is not null").alias("b")
        met = a.join(b, F.col("a._k").eqNullSafe(F.col("b._k")) & (F.col("a._next") == F.col("b._at")))
        jumps.append(stored(met.select("a._k", "a._at", "b._next"), "anchored-jumps"))
    openers = lines.where("_n = 0").select("_k", "_at")
    for jump in reversed(jumps[:-1]):
        # each opener alone, and with the one as many windows on as the jump has
        j = jump.where("_next is not null").select(F.col("_k").alias("_jk"), F.col("_at").alias("_ja"), "_next")
        met = openers.join(j, F.col("_k").eqNullSafe(F.col("_jk")) & (F.col("_at") == F.col("_ja")), "left")
        # stored each time: joins in one stage would hold all jumps' tables in each task
        openers = stored(met.select("_k", F.explode(F.when(F.col("_next").isNull(), F.array("_at")).otherwise(F.array("_at", "_next"))).alias("_at")), "anchored-openers")
    opened = openers.alias("o")
    placed = tops.alias("t").join(opened, F.col("t._k").eqNullSafe(F.col("o._k")) & (F.col("t._at") == F.col("o._at"))).select("t._k", "t._n", F.col("t._at").alias("_open"))
    held = asof_latest(lines.select("_k", "_n", "_at"), placed, order=["_n"], value="_open", key=["_k"], blocks=blocks)
    counts = held.where("_at >= _open").groupBy("_k", "_open").agg(F.count("*").alias("count")).alias("c")
    nexts = jumps[0].where("_next is not null").alias("n")
    closed = counts.join(nexts, F.col("c._k").eqNullSafe(F.col("n._k")) & (F.col("c._open") == F.col("n._at")))
    return closed.select(F.col("c._k").alias(key), "count", F.col("_next").alias("trigger_ts"))
