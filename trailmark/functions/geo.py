"""Plane geometry and angles as Column expressions. Lengths are metres, y grows downwards, rings are arrays of [x, y]."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Metres of a degree of latitude, and of longitude at the equator.
LAT_M, LON_M = 110540.0, 111320.0


def wrapped(angle: Column) -> Column:
    """Degrees brought to -180..180; the remainder takes its dividend's sign."""
    return (angle % 360 + 540) % 360 - 180


def length(dx: Column, dy: Column) -> Column:
    """The length of a vector, by squares and root as SQL says it: F.hypot() may differ in the last bit, which counts at a limit."""
    return F.sqrt(dx * dx + dy * dy)


def of_degrees(f: Callable[[float], float], degrees: Column) -> Column:
    """math.sin or math.cos of whole degrees from 0 to 359, by a table: the JVM's sine differs in the last bit for some of them."""
    return F.get(F.array(*[F.lit(f(math.radians(i))) for i in range(360)]), degrees.cast("int"))


def azimuth(dx: Column, dy: Column) -> Column:
    """Degrees from north (up), clockwise."""
    return F.pmod(F.degrees(F.atan2(dx, -dy)) + 360, F.lit(360.0))


def to_metres(x: Column, y: Column, width: Column, height: Column, origin_x: Column, origin_y: Column, rotation: Column) -> tuple[Column, Column]:
    """A place on a plan, in shares of its size, on the ground."""
    px, py, r = x.cast("double") * width, y.cast("double") * height, F.radians(rotation)
    return origin_x + px * F.cos(r) - py * F.sin(r), origin_y + px * F.sin(r) + py * F.cos(r)


def to_plan(mx: Column, my: Column, width: Column, height: Column, origin_x: Column, origin_y: Column, rotation: Column) -> tuple[Column, Column]:
    """The inverse of to_metres()."""
    dx, dy, r = mx - origin_x, my - origin_y, F.radians(rotation)
    return (dx * F.cos(r) + dy * F.sin(r)) / width, (dy * F.cos(r) - dx * F.sin(r)) / height


def project(lat: Column, lon: Column, lat0: float, lon0: float) -> tuple[Column, Column]:
    """Equirectangular metres east and south of a reference."""
    return (lon - lon0) * LON_M * F.cos(F.radians(F.lit(lat0))), (lat0 - lat) * LAT_M


def share_along(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Where on segment a-b, 0 to 1, the point is nearest; 0 for a segment without length."""
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    return F.when(square == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / square)))


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    t = share_along(px, py, ax, ay, bx, by)
    return F.hypot(px - (ax + t * (bx - ax)), py - (ay + t * (by - ay)))


def sides(ring: Column) -> Column:
    """Segments of a ring, the last back to the first point: array of struct(ax, ay, bx, by)."""
    n = F.size(ring)

    def side(p: Column, i: Column) -> Column:
        q = F.get(ring, (i + 1) % n)
        return F.struct(F.get(p, F.lit(0)).alias("ax"), F.get(p, F.lit(1)).alias("ay"), F.get(q, F.lit(0)).alias("bx"), F.get(q, F.lit(1)).alias("by"))

    return F.transform(ring, side)


def in_ring(px: Column, py: Column, ring: Column) -> Column:
    """Even-odd rule."""

    def flips(s: Column) -> Column:
        return ((s.ay > py) != (s.by > py)) & (px < (s.bx - s.ax) * (py - s.ay) / F.nullif(s.by - s.ay, F.lit(0.0)) + s.ax)

    return F.size(F.filter(sides(ring), flips)) % 2 == 1


def in_area(px: Column, py: Column, outline: Column, holes: Column) -> Column:
    """Inside the outline and in none of the holes."""
    return in_ring(px, py, outline) & ~F.exists(F.coalesce(holes, F.array()), lambda h: in_ring(px, py, h))


def ring_distance(px: Column, py: Column, ring: Column) -> Column:
    """Distance to the nearest side; infinite without sides."""
    return F.coalesce(F.array_min(F.transform(sides(ring), lambda s: segment_distance(px, py, s.ax, s.ay, s.bx, s.by))), F.lit(float("inf")))


def nearest_on_ring(px: Column, py: Column, ring: Column) -> Column:
    """struct(distance, x, y) of the nearest boundary point; the first side wins a tie."""

    def near(s: Column, i: Column) -> Column:
        t = share_along(px, py, s.ax, s.ay, s.bx, s.by)
        x, y = s.ax + t * (s.bx - s.ax), s.ay + t * (s.by - s.ay)
        return F.struct(F.hypot(px - x, py - y).alias("distance"), i.alias("side"), x.alias("x"), y.alias("y"))

    return F.array_min(F.transform(sides(ring), near))


def ring_area(ring: Column) -> Column:
    """Signed area by the shoelace formula."""
    return F.aggregate(sides(ring), F.lit(0.0), lambda sum_, s: sum_ + (s.ax * s.by - s.bx * s.ay)) / 2


def ring_centroid(ring: Column) -> tuple[Column, Column]:
    area = ring_area(ring)
    cross = lambda s: s.ax * s.by - s.bx * s.ay
    x = F.aggregate(sides(ring), F.lit(0.0), lambda sum_, s: sum_ + (s.ax + s.bx) * cross(s))
    y = F.aggregate(sides(ring), F.lit(0.0), lambda sum_, s: sum_ + (s.ay + s.by) * cross(s))
    return x / (6 * area), y / (6 * area)


def segments_cross(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column, dx: Column, dy: Column) -> Column:
    """Whether the inner parts of a-b and c-d cross."""
    turn = lambda px, py, qx, qy, rx, ry: (qx - px) * (ry - py) - (qy - py) * (rx - px)
    return (turn(ax, ay, bx, by, cx, cy) * turn(ax, ay, bx, by, dx, dy) < 0) & (turn(cx, cy, dx, dy, ax, ay) * turn(cx, cy, dx, dy, bx, by) < 0)


def along(line: Column, share: Column) -> tuple[Column, Column]:
    """The point at a share, 0 to 1, of the length of a polyline."""
    n = F.size(line)
    parts = F.transform(F.slice(line, 1, F.greatest(n - 1, F.lit(0))), lambda p, i: F.struct(
        F.get(p, F.lit(0)).alias("ax"), F.get(p, F.lit(1)).alias("ay"), F.get(F.get(line, i + 1), F.lit(0)).alias("bx"), F.get(F.get(line, i + 1), F.lit(1)).alias("by")))
    length = lambda s: F.hypot(s.bx - s.ax, s.by - s.ay)
    total = F.aggregate(parts, F.lit(0.0), lambda sum_, s: sum_ + length(s))
    start = F.struct(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)).alias("left"), F.get(F.get(line, F.lit(0)), F.lit(0)).cast("double").alias("x"), F.get(F.get(line, F.lit(0)), F.lit(1)).cast("double").alias("y"))
    goal = start.getField("left") * total

    def step(state: Column, s: Column) -> Column:
        t = F.when(length(s) > 0, F.least(F.lit(1.0), state.left / length(s))).otherwise(0.0)
        here = state.left > 0
        return F.struct((state.left - length(s)).alias("left"), F.when(here, s.ax + t * (s.bx - s.ax)).otherwise(state.x).alias("x"), F.when(here, s.ay + t * (s.by - s.ay)).otherwise(state.y).alias("y"))

    end = F.aggregate(parts, start.withField("left", goal), step)
    return end.getField("x"), end.getField("y")
