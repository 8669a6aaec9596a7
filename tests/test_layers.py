"""Corridors, crossed polygons, dated agreements and long rings against sampling and brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitegauge.functions import geometry as geo
from sitegauge.operators import corridors, lines, polygons, radius
from sitegauge.operators import pyramid as pyr

EDGES = "id long, edge_no int, ax double, ay double, bx double, by double"


def ring(id, corners):
    return [(id, k, *map(float, a), *map(float, b)) for k, (a, b) in enumerate(zip(corners, corners[1:] + corners[:1], strict=True))]


def inside(x, y, edges):
    odd = np.zeros(np.shape(x), bool)
    for *_, ax, ay, bx, by in edges:
        if ay != by:
            odd ^= ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
    return odd


def gap(x, y, ax, ay, bx, by):
    l2 = (bx - ax) ** 2 + (by - ay) ** 2
    t = np.clip(((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / l2, 0, 1) if l2 else 0.0
    return np.hypot(ax + t * (bx - ax) - x, ay + t * (by - ay) - y)


LAND = [
    ring(1, [(0, 0), (40, 0), (40, 40), (0, 40)]),
    ring(2, [(60, 0), (100, 0), (80, 15), (100, 30), (60, 30)]),  # a notch
    ring(3, [(500, 500), (510, 500), (510, 510), (500, 510)]),  # far from all lines
    ring(4, [(0, 100), (40, 100), (40, 130), (0, 130)]) + [(4, k + 4, *e[2:]) for k, e in enumerate(ring(4, [(10, 110), (10, 120), (30, 120), (30, 110)]))],  # a hole, clockwise
]
WIDTHS = {"a": 3.0, "b": 7.0, "none": 0.0}
LINES = [
    (1, "a", -20.0, 10.0, 70.0, 31.0), (2, "b", 20.0, 20.0, 20.0, 20.0), (3, "a", 20.0, -30.0, 20.0, 15.0), (4, "a", 20.0, 15.0, 20.0, -30.0),  # a disc; the same line both ways
    (5, "a", 50.0, 8.0, 120.0, 8.0), (6, "a", 90.0, 8.0, 65.0, 8.0), (7, "b", 75.0, 25.0, 130.0, 40.0),  # collinear lines that overlap
    (8, "a", 0.0, 3.0, 40.0, 3.0), (9, "b", 5.0, 105.0, 35.0, 125.0), (10, "x", 0.0, 0.0, 40.0, 40.0), (11, "none", 0.0, 40.0, 40.0, 0.0), (12, "a", None, 1.0, 2.0, 3.0),  # a side along a polygon's edge
]


@pytest.mark.parametrize("longest", [corridors.CAPSULE_M, 11.0])
def test_sterilised_area_equals_a_fine_raster(spark, monkeypatch, longest):
    monkeypatch.setattr(corridors, "CAPSULE_M", longest)
    land = spark.createDataFrame([e for r in LAND for e in r], EDGES)
    wires = spark.createDataFrame(LINES, "line long, kind string, ax double, ay double, bx double, by double")
    got = {r["id"]: r for r in corridors.sterilised_area(land, wires, WIDTHS, "id", class_col="kind").collect()}
    step = 0.05
    for edges in LAND:
        xs = np.arange(min(e[2] for e in edges), max(e[2] for e in edges), step) + step / 2
        ys = np.arange(min(e[3] for e in edges), max(e[3] for e in edges), step) + step / 2
        x, y = np.meshgrid(xs, ys)
        covered = np.zeros(x.shape, bool)
        for _, kind, *ends in LINES:
            if WIDTHS.get(kind) and None not in ends:
                covered |= gap(x, y, *ends) <= WIDTHS[kind]
        land_here = inside(x, y, edges)
        want, area = (covered & land_here).sum() * step**2, land_here.sum() * step**2
        row = got[edges[0][0]]
        assert abs(row["area"] - area) < 1.5 and abs(row["sterilised_m2"] - want) < 1.5, (edges[0][0], row, want)
        assert abs(row["sterilised_share"] - row["sterilised_m2"] / row["area"]) < 1e-9
    assert got[3]["sterilised_m2"] == 0


def test_sterilised_area_without_lines(spark):
    land = spark.createDataFrame(LAND[0], EDGES)
    none = spark.createDataFrame([], "line long, kind string, ax double, ay double, bx double, by double")
    assert corridors.sterilised_area(land, none, WIDTHS, "id", class_col="kind").first()["sterilised_m2"] == 0


def test_polygon_crossings_equal_sampling(spark):
    shapes = [*LAND, ring(5, [(0, 0), (90, 0), (90, 90), (0, 90)])]
    rng = random.Random(3)
    paths = [(k, *(rng.uniform(-20, 140) for _ in range(4))) for k in range(60)]
    paths += [(100, 0.0, 0.0, 40.0, 40.0), (101, -10.0, 0.0, 50.0, 0.0), (102, 20.0, 20.0, 20.0, 20.0), (103, 20.0, 115.0, 20.0, 300.0), (104, -5.0, 45.0, -5.0, 45.0), (105, 10.0, 10.0, 30.0, 30.0)]
    edges = spark.createDataFrame([e for r in shapes for e in r], EDGES)
    df = spark.createDataFrame(paths, "path long, px double, py double, qx double, qy double")
    got = {(r["path"], r["id"]): r["share"] for r in lines.polygon_crossings(df, edges, "path", id="id").collect()}
    t = (np.arange(40000) + 0.5) / 40000
    for p, px, py, qx, qy in paths:
        for r in shapes:
            if p == 101:
                continue  # along an edge: only its length is in question
            want = inside(px + t * (qx - px), py + t * (qy - py), r).mean()
            assert abs(got.get((p, r[0][0]), 0.0) - want) < 2e-3, (p, r[0][0], want, got.get((p, r[0][0])))
    assert got[(102, 1)] == 1 and (104, 1) not in got


def test_corridors_met_by_paths(spark):
    rng = random.Random(4)
    wires = [(k, rng.choice("ab"), *(rng.uniform(0, 100) for _ in range(4))) for k in range(80)]
    paths = [(k, *(rng.uniform(0, 100) for _ in range(4))) for k in range(40)]
    segs = spark.createDataFrame(wires, "line long, kind string, ax double, ay double, bx double, by double")
    df = spark.createDataFrame(paths, "site long, px double, py double, qx double, qy double")
    got = {r["site"]: (r["corridors"], r["corridors_a"], r["corridors_b"]) for r in lines.corridor_counts(df, segs, {"a": 2.0, "b": 6.0}, "site", class_col="kind", id="line").collect()}
    t = np.linspace(0, 1, 4001)
    for s, px, py, qx, qy in paths:
        near = [(kind, gap(px + t * (qx - px), py + t * (qy - py), *ends).min() - {"a": 2.0, "b": 6.0}[kind]) for _, kind, *ends in wires]
        sure, maybe = ([k for k, d in near if d < -0.05], [k for k, d in near if d < 0.05])
        for place, kind in enumerate(("ab", "a", "b")):
            assert sum(k in kind for k in sure) <= got[s][place] <= sum(k in kind for k in maybe)


def _wires(long_every):
    rng = random.Random(6)
    out = []
    for k in range(4000):
        x, y, turn = rng.uniform(0, 20000), rng.uniform(0, 20000), rng.uniform(0, 6.28)
        length = 9000.0 if long_every and k % long_every == 0 else 20.0
        out.append((k, x, y, x + length * math.cos(turn), y + length * math.sin(turn)))
    return out


def _met(spark, rows):
    index = radius.index_segments(spark.createDataFrame(rows, "line long, ax double, ay double, bx double, by double"), lines.ENDS, keep=["line"])
    places = spark.createDataFrame([(float(x), float(y)) for x in range(500, 20000, 1500) for y in range(500, 20000, 1500)], "x double, y double")
    frontier = pyr.start(places, "x", "y", ["x", "y"])
    lo, _ = pyr.planar_bounds(F.col("_qx"), F.col("_qy"))
    for level in range(1, index.depth + 1):
        frontier = pyr.step(frontier, index, level).filter(lo <= F.lit(400.0))
    return radius._leaf_join(frontier, index, "inner").count()


def test_one_long_line_in_500_does_not_open_cells(spark):
    assert _met(spark, _wires(500)) < 2 * _met(spark, _wires(0))


@pytest.mark.parametrize("long_every", [0, 500, 7])
def test_lines_of_mixed_lengths_equal_brute_force(spark, long_every):
    from sitegauge.operators import nearest

    rows = [r for r in _wires(long_every) if r[0] % 5 == 0]
    segs = spark.createDataFrame(rows, "line long, ax double, ay double, bx double, by double")
    rng = random.Random(7)
    places = [(k, rng.uniform(0, 20000), rng.uniform(0, 20000)) for k in range(60)]
    sites = spark.createDataFrame(places, "sid long, x double, y double")
    near = {r["sid"]: (r["line"], r["distance"]) for r in nearest.nearest(sites, segs, id="line", ends=lines.ENDS).collect()}
    pairs = {(r["x"], r["line"]) for r in radius.pairs_within(sites, segs, 700.0, keep=["line"], ends=lines.ENDS).collect()}
    n_pairs = radius.pairs_within(sites, segs, 700.0, keep=["line"], ends=lines.ENDS).count()
    length = {r["sid"]: r["length_700"] for r in radius.length_within(sites, segs, [700]).collect()}
    for s, x, y in places:
        d = [(float(gap(x, y, *r[1:])), r[0]) for r in rows]
        assert near[s][0] == min(d)[1] and abs(near[s][1] - min(d)[0]) < 1e-6
        assert {i for px, i in pairs if px == x} == {i for dist, i in d if dist <= 700}
        t = (np.arange(3000) + 0.5) / 3000
        want = sum(math.hypot(bx - ax, by - ay) * (np.hypot(ax + t * (bx - ax) - x, ay + t * (by - ay) - y) <= 700).mean() for _, ax, ay, bx, by in rows)
        assert abs(length[s] - want) < 1 + 0.005 * want
    assert n_pairs == len(pairs)


def test_ring_of_a_million_edges(spark):
    """Discs that touch the ring here and there open a few runs of it, whatever its length."""
    n, r = 1_000_000, 1000.0
    at = lambda k: (F.cos(k * 2 * math.pi / n) * r, F.sin(k * 2 * math.pi / n) * r)
    k = F.col("id")
    (ax, ay), (bx, by) = at(k), at((k + 1) % n)
    edges = spark.range(n, numPartitions=8).select(F.lit(1).cast("long").alias("pid"), k.alias("edge_no"), ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by"))
    places = [(1000.0, 0.0), (0.0, 0.0), (-990.0, 100.0), (0.0, 1003.0)]
    pairs = spark.createDataFrame([(*p, 1) for p in places], "x double, y double, pid long")
    got = {(row["x"], row["y"]): row["clip_5"] for row in polygons.clip_pairs(pairs, edges, [5.0], "pid").collect()}
    for x, y in places:
        d, q = math.hypot(x, y), 5.0
        if d + q <= r:
            want = math.pi * q * q
        else:
            a, b = math.acos((d * d + q * q - r * r) / (2 * d * q)), math.acos((d * d + r * r - q * q) / (2 * d * r))
            want = q * q * (a - math.sin(2 * a) / 2) + r * r * (b - math.sin(2 * b) / 2)
        assert abs(got[(x, y)] - want) < 1e-3
    tree = polygons._run_tree(edges, "pid")
    assert [t.count() for t in tree[1:]] == [15625, 245, 4, 1]


def test_clips_do_not_depend_on_the_tree(spark, monkeypatch):
    rng = random.Random(9)
    corners = [(100 + (60 + 30 * rng.random()) * math.cos(a / 40 * 2 * math.pi), 100 + (60 + 30 * rng.random()) * math.sin(a / 40 * 2 * math.pi)) for a in range(40)]
    hole = [(90, 90), (90, 110), (110, 110), (110, 90)]
    edges = spark.createDataFrame(ring(1, corners) + [(1, k + 40, *e[2:]) for k, e in enumerate(ring(1, hole))], EDGES)
    pairs = spark.createDataFrame([(rng.uniform(0, 200), rng.uniform(0, 200), 1) for _ in range(30)], "x double, y double, id long")
    out = []
    for chain in (2, 64):
        monkeypatch.setattr(polygons, "CHAIN", chain)
        out.append({(r["x"], r["y"]): r["clip_30"] for r in polygons.clip_pairs(pairs, edges, [30.0], "id").collect()})
    assert all(abs(out[0][p] - out[1][p]) < 1e-6 for p in out[1]) and out[0].keys() == out[1].keys()
    xs = np.arange(0, 200, 0.25) + 0.125
    gx, gy = np.meshgrid(xs, xs)
    shape = inside(gx, gy, [tuple(e) for e in ring(1, corners) + ring(1, hole)])
    for (x, y), clip in out[1].items():
        assert abs(clip - (shape & (np.hypot(gx - x, gy - y) <= 30)).sum() / 16) < 12


def test_overlap_with_a_repeated_corner(spark):
    a = spark.createDataFrame(ring(1, [(0, 0), (10, 0), (10, 0), (10, 10), (0, 10)]), EDGES)
    b = spark.createDataFrame(ring(7, [(5, 5), (5, 5), (20, 5), (20, 20), (5, 20)]) + ring(8, [(10, 0), (20, 0), (20, 10), (10, 10)]), EDGES)
    got = {(r["id_a"], r["id_b"]): r["area"] for r in polygons.overlap_areas(a, b, "id", "id").collect()}
    assert abs(got[(1, 7)] - 25) < 1e-9 and abs(got.get((1, 8), 0)) < 1e-9
    assert {(r["id_a"], r["id_b"]) for r in polygons.polygon_intersects(a, b, "id", "id").collect()} == {(1, 7), (1, 8)}
    assert abs(polygons.measures(a, "id").first()["area"] - 100) < 1e-9
    assert polygons.repair_edges(a, "id").count() == 4


def test_agreements_on_dates(spark):
    rng = random.Random(11)
    zones = [ring(k, [(x, y), (x + 8, y), (x + 8, y + 8), (x, y + 8)]) for k, x, y in ((k, rng.uniform(0, 60), rng.uniform(0, 60)) for k in range(12))]
    day = lambda k: f"2020-{1 + k // 28:02d}-{1 + k % 28:02d}"
    held = [(rng.randrange(12), day(a := rng.randrange(200)), day(a + rng.randrange(1, 90)), rng.randrange(1000), rng.choice(["low", "high", None])) for _ in range(60)]
    held += [(3, None, day(5), 5, "low"), (3, day(9), day(9), 5, "high"), (4, day(0), day(300), None, "high")]
    sites = [(k, rng.uniform(0, 70), rng.uniform(0, 70), None if k == 7 else day(rng.randrange(250))) for k in range(40)]
    df = spark.createDataFrame(sites, "sid long, x double, y double, d string").withColumn("d", F.to_date("d"))
    edges = spark.createDataFrame([e for z in zones for e in z], EDGES)
    deals = spark.createDataFrame(held, "id long, a string, b string, v long, tier string").withColumns({"a": F.to_date("a"), "b": F.to_date("b")})
    got = {r["sid"]: r for r in polygons.active_agreements(df, edges, [6, 15], "id", deals, date="d", start="a", end="b", value="v", tier="tier", tiers=("low", "high")).collect()}
    clips = {(r["x"], r["y"], r["id"]): (r["clip_6"], r["clip_15"]) for r in polygons.clipped_areas(df, edges, [6, 15], "id").collect()}
    for s, x, y, d in sites:
        near = {z[0][0]: 0.0 if inside(np.array([x]), np.array([y]), z)[0] else min(float(gap(x, y, *e[2:])) for e in z) for z in zones}
        live = [h for h in held if d and h[1] and h[1] <= d < h[2]]
        row, on = got[s], [h for h in live if near[h[0]] == 0]
        assert row["on_site"] == int(bool(on)) and row["value_on_site"] == sum(h[3] or 0 for h in on)
        assert row["highest_tier"] == ("high" if any(h[4] == "high" for h in on) else "low" if any(h[4] == "low" for h in on) else None)
        for i, r in enumerate((6, 15)):
            mine = [h for h in live if near[h[0]] <= r]
            assert row[f"count_{r}"] == len(mine) and row[f"count_{r}_high"] == sum(h[4] == "high" for h in mine)
            area = sum(clips[(x, y, h[0])][i] for h in mine)
            assert abs(row[f"area_{r}"] - area) < 1e-6 and abs(row[f"density_{r}"] - area / (math.pi * r * r)) < 1e-9
            assert row[f"mean_value_{r}"] is None if not mine else abs(row[f"mean_value_{r}"] - sum(h[3] or 0 for h in mine) / len(mine)) < 1e-9


def test_restrictions_of_the_nearest_polygon(spark):
    access = spark.createDataFrame(ring(1, [(0, 0), (10, 0), (10, 10), (0, 10)]) + ring(2, [(100, 0), (110, 0), (110, 10), (100, 10)]), EDGES)
    layer = spark.createDataFrame(ring(5, [(105, 5), (120, 5), (120, 20), (105, 20)]), EDGES.replace("id ", "part "))
    empty = layer.limit(0)
    sites = spark.createDataFrame([(1, 5.0, 5.0), (2, 90.0, 5.0), (3, 105.0, 300.0)], "sid long, x double, y double")
    got = {r["sid"]: (r["id"], r["hit"], r["none"]) for r in polygons.nearest_with_restrictions(sites, access, "id", {"hit": layer, "none": empty}).collect()}
    assert got == {1: (1, 0, 0), 2: (2, 1, 0), 3: (2, 1, 0)}


def test_ray_meets_segment(spark):
    rows = [(0.0, 0.0, 90.0, 5.0, -1.0, 5.0, 1.0, 5.0), (0.0, 0.0, 270.0, 5.0, -1.0, 5.0, 1.0, None), (0.0, 0.0, 0.0, -1.0, 3.0, 1.0, 3.0, 3.0), (0.0, 0.0, 0.0, 1.0, 3.0, 2.0, 3.0, None), (0.0, 0.0, 0.0, 0.0, 2.0, 0.0, 9.0, 2.0),
            (0.0, 0.0, 0.0, 0.0, -2.0, 0.0, 9.0, 0.0), (0.0, 0.0, 0.0, 0.0, -9.0, 0.0, -2.0, None)]
    df = spark.createDataFrame(rows, "x double, y double, b double, ax double, ay double, bx double, by double, want double")
    got = df.withColumn("got", geo.ray_segment_distance(*[F.col(c) for c in ("x", "y", "b", "ax", "ay", "bx", "by")])).collect()
    for r in got:
        assert (r["got"] is None) == (r["want"] is None) and (r["got"] is None or abs(r["got"] - r["want"]) < 1e-9), r
