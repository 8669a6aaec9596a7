"""Planar geometry as column maths. A disc or point is given by its centre, an edge by its two ends."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def box_min_distance(x: Column, y: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    dx = F.greatest(x0 - x, x - x1, F.lit(0.0))
    dy = F.greatest(y0 - y, y - y1, F.lit(0.0))
    return F.sqrt(dx * dx + dy * dy)


def box_max_distance(x: Column, y: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    dx = F.greatest(x - x0, x1 - x)
    dy = F.greatest(y - y0, y1 - y)
    return F.sqrt(dx * dx + dy * dy)


def nearest_place(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Where along a segment (0 to 1) it is nearest to a point; a zero-length segment counts as its start point."""
    ux, uy = bx - ax, by - ay
    len2 = ux * ux + uy * uy
    t = F.when(len2 > 0, ((x - ax) * ux + (y - ay) * uy) / len2).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))


def segment_distance(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance from a point to a segment."""
    t = nearest_place(x, y, ax, ay, bx, by)
    dx, dy = ax + t * (bx - ax) - x, ay + t * (by - ay) - y
    return F.sqrt(dx * dx + dy * dy)


def ray_crosses(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Whether the ray from (x, y) towards +x meets the edge; an odd total means inside."""
    return ((ay > y) != (by > y)) & (x < F.try_divide((bx - ax) * (y - ay), by - ay) + ax)


def _circle_roots(x, y, r, ax, ay, bx, by):
    px, py, ux, uy = ax - x, ay - y, bx - ax, by - ay
    a = ux * ux + uy * uy
    b = px * ux + py * uy
    c = px * px + py * py - r * r
    disc = b * b - a * c
    root = F.sqrt(F.greatest(disc, F.lit(0.0)))
    t1 = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(-b - root, a)))
    t2 = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(-b + root, a)))
    return a, disc, t1, t2


def length_in_disc(x, y, r, ax, ay, bx, by) -> Column:
    """Length of the segment inside the disc."""
    a, disc, t1, t2 = _circle_roots(x, y, r, ax, ay, bx, by)
    return F.when((a > 0) & (disc > 0), (t2 - t1) * F.sqrt(a)).otherwise(0.0)


def with_disc_area_terms(df: DataFrame, x: Column, y: Column, radii: Mapping[str, float], ax, ay, bx, by) -> DataFrame:
    """Each directed edge's share of polygon-and-disc area, one column per radius; the sum over all
    edges is the signed area.

    The edge is cut where it meets the circle: chord parts add a triangle with the centre, the parts
    outside add the circular sector they subtend. Steps are staged as columns so each is computed once.
    """
    px, py, qx, qy, ux, uy, a, b, c = (F.col(f"_g_{n}") for n in ("px", "py", "qx", "qy", "ux", "uy", "a", "b", "c"))
    df = df.withColumns({"_g_px": ax - x, "_g_py": ay - y, "_g_qx": bx - x, "_g_qy": by - y, "_g_ux": bx - ax, "_g_uy": by - ay})
    df = df.withColumns({"_g_a": ux * ux + uy * uy, "_g_b": px * ux + py * uy, "_g_c": px * px + py * py})

    def sector(r, vx, vy, wx, wy):
        return r * r / 2 * F.atan2(vx * wy - vy * wx, vx * wx + vy * wy)

    for name, r in radii.items():
        disc, root, t1, t2 = (F.col(f"_g_{n}") for n in ("disc", "root", "t1", "t2"))
        df = df.withColumn("_g_disc", b * b - a * (c - float(r) * float(r)))
        df = df.withColumn("_g_root", F.when((disc > 0) & (a > 0), F.sqrt(disc)))
        df = df.withColumns({
            "_g_t1": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(-b - root, a))),
            "_g_t2": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(-b + root, a))),
        })
        sx, sy, ex, ey = (F.col(f"_g_{n}") for n in ("sx", "sy", "ex", "ey"))
        df = df.withColumn("_g_cut", root.isNotNull() & (t2 > t1))
        df = df.withColumns({"_g_sx": px + t1 * ux, "_g_sy": py + t1 * uy, "_g_ex": px + t2 * ux, "_g_ey": py + t2 * uy})
        chord = F.when(t1 > 0, sector(r, px, py, sx, sy)).otherwise(0.0) + (sx * ey - sy * ex) / 2
        chord = chord + F.when(t2 < 1, sector(r, ex, ey, qx, qy)).otherwise(0.0)
        df = df.withColumn(name, F.when(F.col("_g_cut"), chord).otherwise(sector(r, px, py, qx, qy)))
    return df.drop(*[c for c in df.columns if c.startswith("_g_")])


def disc_area(r: float) -> float:
    return math.pi * r * r


def _turn(ax, ay, bx, by, cx, cy) -> Column:
    return F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def segments_meet(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Whether segment ab touches segment cd, collinear overlap included."""
    boxes = (
        (F.greatest(ax, bx) >= F.least(cx, dx))
        & (F.greatest(cx, dx) >= F.least(ax, bx))
        & (F.greatest(ay, by) >= F.least(cy, dy))
        & (F.greatest(cy, dy) >= F.least(ay, by))
    )
    straddle = (_turn(ax, ay, bx, by, cx, cy) * _turn(ax, ay, bx, by, dx, dy) <= 0) & (
        _turn(cx, cy, dx, dy, ax, ay) * _turn(cx, cy, dx, dy, bx, by) <= 0
    )
    return boxes & straddle


def segment_gap(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Distance between two segments, 0 when they meet."""
    gap = F.least(
        segment_distance(ax, ay, cx, cy, dx, dy),
        segment_distance(bx, by, cx, cy, dx, dy),
        segment_distance(cx, cy, ax, ay, bx, by),
        segment_distance(dx, dy, ax, ay, bx, by),
    )
    return F.when(segments_meet(ax, ay, bx, by, cx, cy, dx, dy), 0.0).otherwise(gap)


def shoelace_term(ax, ay, bx, by) -> Column:
    return (ax * by - bx * ay) / 2


def ray_segment_distance(x, y, bearing, ax, ay, bx, by) -> Column:
    """Distance along a ray from (x, y) to a segment, null where it misses; bearings are degrees clockwise from +y.

    A segment along the ray counts from its nearest point ahead.
    """
    dx, dy = F.sin(F.radians(bearing)), F.cos(F.radians(bearing))
    ux, uy, px, py = bx - ax, by - ay, ax - x, ay - y
    turn = dx * uy - dy * ux
    t, s = F.try_divide(px * uy - py * ux, turn), F.try_divide(px * dy - py * dx, turn)
    hit = F.when((t >= 0) & (s >= 0) & (s <= 1), t)
    a, b = px * dx + py * dy, (bx - x) * dx + (by - y) * dy
    along = F.when((px * dy - py * dx == 0) & (F.greatest(a, b) >= 0), F.greatest(F.least(a, b), F.lit(0.0)))
    return F.when(turn == 0, along).otherwise(hit)
