"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: equatorial radius in metres.
EARTH_RADIUS = 6378137.0
#: Fixed value: metres in a degree, as the map match counts them.
DEGREE_METRES = 111.2 * 1000


def normalize_text(text: Column) -> Column:
    """Words of a text: anything but ASCII letters and digits is a blank; lower case; no empty words."""
    return F.filter(F.split(F.lower(F.regexp_replace(text, "[^A-Za-z0-9]", " ")), " "), lambda w: w != "")


def split_words(line: Column, *, keep_empty: bool = True) -> Column:
    """Words between single spaces: trailing empty ones drop, inner ones stay unless ``keep_empty`` is off.

    An empty line is one empty word; a line of blanks alone has none.
    """
    words = F.split(F.rtrim(line), " ")
    if not keep_empty:
        return F.filter(words, lambda w: w != "")
    return F.when((F.rtrim(line) == "") & (line != ""), F.array().cast("array<string>")).otherwise(words)


def ratio_score(v1: float, v2: float, v: Column) -> Column:
    """v / (v1 + (v2 - v1)) clipped to 0..1; null stays null."""
    return F.when(v.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / F.lit(v1 + (v2 - v1)))))


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b where x / 0 is infinite and 0 / 0 is null."""
    return F.when(b != 0, F.try_divide(a, b)).when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf")))


def minute_number(seconds: Column) -> Column:
    return F.floor(seconds / 60) + 1


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres."""
    a, b = F.radians(lat1 - lat2), F.radians(lon1 - lon2)
    h = F.pow(F.sin(a / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(b / 2), 2)
    return 2 * EARTH_RADIUS * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def _along(x1: Column, y1: Column, x2: Column, y2: Column, x: Column, y: Column) -> Column:
    """Where a point's projection on a segment's line falls, as a share of the segment; null if the segment is a point."""
    dx, dy = x2 - x1, y2 - y1
    return F.try_divide((x - x1) * dx + (y - y1) * dy, dx * dx + dy * dy)


def point_line_geo_dist(x1: Column, y1: Column, x2: Column, y2: Column, x: Column, y: Column) -> Column:
    """Great-circle metres from a point to a segment of longitudes and latitudes: to its projection where that falls inside, else to the nearer end."""

    def of(t: Column) -> Column:
        ends = F.least(haversine(y, x, y1, x1), haversine(y, x, y2, x2))
        return F.when((t > 0) & (t < 1), haversine(y, x, y1 + t * (y2 - y1), x1 + t * (x2 - x1))).otherwise(ends)

    return F.transform(F.array(_along(x1, y1, x2, y2, x, y)), of)[0]


def planar_dist(x1: Column, y1: Column, x2: Column, y2: Column, x: Column, y: Column) -> Column:
    """Distance of a point to a segment in the plane, in the coordinates' unit; within 1e-6 of an end it is 0."""

    def of(t: Column) -> Column:
        # a segment that is a point has no projection: its first end serves
        inside = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)), F.lit(0.0))
        off = lambda px, py: F.sqrt((x - px) * (x - px) + (y - py) * (y - py))
        return F.when(F.least(off(x1, y1), off(x2, y2)) <= 1e-6, 0.0).otherwise(off(x1 + inside * (x2 - x1), y1 + inside * (y2 - y1)))

    # bound once: written out at each use it makes code too long to compile
    return F.transform(F.array(_along(x1, y1, x2, y2, x, y)), of)[0]


def _crosses(a: Column, b: Column, x: Column, y: Column) -> Column:
    """Whether the line from a point to the right meets the side between corners ``a`` and ``b``, structs (x, y)."""
    return ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * F.try_divide(y - a["y"], b["y"] - a["y"]) + a["x"])


def ring_sides(ring: Column) -> Column:
    """Sides of a ring of three corners or more, as structs of corners ``p`` and ``q``."""
    n = F.size(ring)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.element_at(ring, i).alias("p"), F.element_at(ring, i % n + 1).alias("q")))


def odd_crossings(sides: Column, x: Column, y: Column) -> Column:
    """Whether the line from a point to the right meets an odd number of sides: with a box around them, even-odd containment."""
    return F.size(F.filter(sides, lambda s: _crosses(s["p"], s["q"], x, y))) % 2 == 1


def point_in_polygon(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd containment: ``ring`` is an array of structs (x, y), closed or not."""
    n = F.size(ring)
    flips = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + F.when(F.coalesce(_crosses(F.element_at(ring, i), F.element_at(ring, i % n + 1), x, y), F.lit(False)), 1).otherwise(0))
    in_box = x.between(F.array_min(F.transform(ring, lambda p: p["x"])), F.array_max(F.transform(ring, lambda p: p["x"]))) & y.between(F.array_min(F.transform(ring, lambda p: p["y"])), F.array_max(F.transform(ring, lambda p: p["y"])))
    return in_box & (flips % 2 == 1)
