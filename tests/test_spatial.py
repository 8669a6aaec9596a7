"""Spatial joins against brute force and closed forms, including hot places."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitegauge.operators import feature_space, lines, nearest, polygons, radius
from sitegauge.operators import pyramid as pyr


def cloud(seed, n, hot=(), spread=1000.0):
    """Random points, a third of them at one place and a third in one tiny cluster when asked."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        if "copies" in hot and i % 3 == 0:
            out.append((i, 500.0, 500.0))
        elif "cluster" in hot and i % 3 == 1:
            out.append((i, 900.0 + rng.random() * 0.5, 100.0 + rng.random() * 0.5))
        else:
            out.append((i, round(rng.random() * spread, 3), round(rng.random() * spread, 3)))
    return out


def frame(spark, rows, id):
    return spark.createDataFrame(rows, f"{id} long, x double, y double")


@pytest.mark.parametrize("k", [1, 3, 40])
@pytest.mark.parametrize("hot", [(), ("copies", "cluster")])
def test_knn_equals_brute_force(spark, k, hot):
    sites, items = cloud(1, 300, hot), cloud(2, 900, hot)
    got = nearest.knn(frame(spark, sites, "sid"), frame(spark, items, "pid"), k, id="pid").select("sid", "rank", "pid").collect()
    want = set()
    for s, x, y in sites:
        order = sorted((math.sqrt((x - a) * (x - a) + (y - b) * (y - b)), p) for p, a, b in items)[:k]
        want |= {(s, i + 1, p) for i, (_, p) in enumerate(order)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_knn_with_fewer_items_than_k_and_none(spark):
    sites = frame(spark, cloud(3, 5), "sid")
    assert nearest.knn(sites, frame(spark, cloud(4, 2), "pid"), 5, id="pid").count() == 10
    assert nearest.knn(sites, frame(spark, cloud(4, 2), "pid").limit(0), 5, id="pid", how="left").filter("pid IS NULL").count() == 5


def test_knn_before_equals_brute_force(spark):
    rng = random.Random(5)
    items = [(i, x, y, rng.randrange(50)) for i, x, y in cloud(6, 700, ("copies",))]
    sites = [(i, x, y, rng.randrange(60)) for i, x, y in cloud(7, 150, ("copies",))]
    q = spark.createDataFrame(sites, "sid long, x double, y double, t int")
    p = spark.createDataFrame(items, "pid long, x double, y double, done int")
    got = {tuple(r) for r in nearest.knn(q, p, 7, id="pid", before=("t", "done")).select("sid", "rank", "pid").collect()}
    want = set()
    for s, x, y, t in sites:
        order = sorted((math.sqrt((x - a) * (x - a) + (y - b) * (y - b)), i) for i, a, b, d in items if d < t)[:7]
        want |= {(s, n + 1, i) for n, (_, i) in enumerate(order)}
    assert got == want


def test_pyramid_leaves_are_small_and_cover_every_item(spark):
    items = frame(spark, cloud(8, 3000, ("cluster",)), "pid")
    index = pyr.build(items, leaf_rows=32)
    assert index.items.count() == 3000
    assert index.items.groupBy("_cell").count().agg(F.max("count")).first()[0] <= 32


@pytest.mark.parametrize("hot", [(), ("copies", "cluster")])
def test_sums_within_equals_brute_force(spark, hot):
    sites, items = cloud(9, 120, hot), cloud(10, 2500, hot)
    got = radius.sums_within(frame(spark, sites, "sid"), frame(spark, items, "pid"), [20, 150, 600], {"n": F.lit(1), "id": F.col("pid")})
    for r in got.collect():
        d = [(math.sqrt((r["x"] - a) ** 2 + (r["y"] - b) ** 2), p) for p, a, b in items]
        for radius_ in (20, 150, 600):
            inside = [p for dist, p in d if dist <= radius_]
            assert r[f"n_{radius_}"] == len(inside) and r[f"id_{radius_}"] == sum(inside)


SQUARE = [(0, 0, 0.0, 0.0, 100.0, 0.0), (0, 1, 100.0, 0.0, 100.0, 100.0), (0, 2, 100.0, 100.0, 0.0, 100.0), (0, 3, 0.0, 100.0, 0.0, 0.0)]
HOLE = [(0, 4, 40.0, 40.0, 40.0, 60.0), (0, 5, 40.0, 60.0, 60.0, 60.0), (0, 6, 60.0, 60.0, 60.0, 40.0), (0, 7, 60.0, 40.0, 40.0, 40.0)]


def edges(spark, rows):
    return spark.createDataFrame(rows, "zid long, edge_no int, ax double, ay double, bx double, by double")


def test_polygon_with_hole(spark):
    zone = edges(spark, SQUARE + HOLE)
    points = spark.createDataFrame([(1, 50.0, 50.0), (2, 10.0, 10.0), (3, 200.0, 50.0)], "sid long, x double, y double")
    assert [r["sid"] for r in polygons.point_in_polygon(points, zone, "zid", how="inner").collect()] == [2]
    got = {r["sid"]: (r["distance"], r["inside"]) for r in polygons.nearest_polygon(points, zone, "zid").collect()}
    assert got == {1: (10.0, 0), 2: (0.0, 1), 3: (100.0, 0)}


def test_disc_area_closed_forms(spark):
    zone = edges(spark, SQUARE + HOLE)
    points = spark.createDataFrame([(1, 50.0, 50.0), (2, 0.0, 50.0)], "sid long, x double, y double")
    got = {(r["x"], r["y"]): r for r in polygons.clipped_areas(points, zone, [5, 30, 500], "zid").collect()}
    mid, side = got[(50.0, 50.0)], got[(0.0, 50.0)]
    assert abs(mid["clip_5"]) < 1e-9
    assert abs(mid["clip_30"] - (math.pi * 900 - 400)) < 1e-6
    assert abs(mid["clip_500"] - 9600) < 1e-6
    assert abs(side["clip_30"] - math.pi * 450) < 1e-6


def test_disc_area_of_a_long_ring_equals_all_edges(spark):
    n = 1500
    ring = [(1000 * math.cos(2 * math.pi * i / n) * (1 if i % 3 else 0.7), 1000 * math.sin(2 * math.pi * i / n) * (1 if i % 3 else 0.7)) for i in range(n)]
    rows = [(7, i, *ring[i], *ring[(i + 1) % n]) for i in range(n)]
    places = [(1, 0.0, 0.0), (2, 900.0, 0.0), (3, 1100.0, 300.0), (4, -700.0, -700.0), (5, 400.0, 200.0)]
    points = spark.createDataFrame(places, "sid long, x double, y double")
    got = {(r["x"], r["y"]): r for r in polygons.clipped_areas(points, edges(spark, rows), [150, 400], "zid").collect()}
    for _, x, y in places:
        for r in (150.0, 400.0):
            total = 0.0
            for _, _, ax, ay, bx, by in rows:
                px, py, qx, qy, ux, uy = ax - x, ay - y, bx - x, by - y, bx - ax, by - ay
                a, b = ux * ux + uy * uy, px * ux + py * uy
                disc = b * b - a * (px * px + py * py - r * r)
                cuts = [0.0, 1.0] if disc <= 0 else sorted({0.0, 1.0, *[min(1.0, max(0.0, (-b + s * math.sqrt(disc)) / a)) for s in (-1, 1)]})
                for t0, t1 in zip(cuts, cuts[1:], strict=False):
                    m = (t0 + t1) / 2
                    sx, sy, ex, ey = px + t0 * ux, py + t0 * uy, px + t1 * ux, py + t1 * uy
                    inside = (px + m * ux) ** 2 + (py + m * uy) ** 2 < r * r
                    total += (sx * ey - sy * ex) / 2 if inside else r * r / 2 * math.atan2(sx * ey - sy * ex, sx * ex + sy * ey)
            assert abs(got[(x, y)][f"clip_{int(r)}"] - abs(total)) < 1e-3


def test_many_edged_polygon_uses_bands(spark):
    n = 2000
    ring = [(1000 * math.cos(2 * math.pi * i / n) * (1 if i % 2 else 0.8), 1000 * math.sin(2 * math.pi * i / n) * (1 if i % 2 else 0.8)) for i in range(n)]
    rows = [(7, i, *ring[i], *ring[(i + 1) % n]) for i in range(n)]
    rng = np.random.default_rng(3)
    pts = rng.uniform(-1100, 1100, (400, 2))
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "sid long, x double, y double")
    got = {r["sid"] for r in polygons.point_in_polygon(points, edges(spark, rows), "zid", how="inner").collect()}
    want = set()
    for i, (x, y) in enumerate(pts):
        odd = False
        for _, _, ax, ay, bx, by in rows:
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                odd = not odd
        if odd:
            want.add(i)
    assert got == want


def square(zid, x, y, side):
    ring = [(x, y), (x + side, y), (x + side, y + side), (x, y + side)]
    return [(zid, i, *map(float, ring[i]), *map(float, ring[(i + 1) % 4])) for i in range(4)]


def test_overlap_areas_with_shared_edges(spark):
    a = edges(spark, square(1, 0, 0, 10) + square(2, 20, 0, 10))
    b = edges(spark, square(11, 5, 5, 10) + square(12, 10, 0, 10) + square(13, 0, 0, 5) + square(14, 22, 2, 3) + square(15, 20, 0, 10))
    got = {(r["id_a"], r["id_b"]): round(r["area"], 6) for r in polygons.overlap_areas(a, b, "zid", "zid").collect() if r["area"] > 1e-9}
    assert got == {(1, 11): 25.0, (1, 13): 25.0, (2, 14): 9.0, (2, 15): 100.0}
    touching = {tuple(r) for r in polygons.polygon_intersects(a, b, "zid", "zid").collect()}
    assert touching == {(1, 11), (1, 12), (1, 13), (2, 12), (2, 14), (2, 15)}


def test_repair_edges_flips_and_drops(spark):
    clockwise = [(5, i, bx, by, ax, ay) for _, i, ax, ay, bx, by in SQUARE]
    open_ring = [(6, *r[1:]) for r in SQUARE[:3]]
    out = polygons.repair_edges(edges(spark, clockwise + open_ring), "zid")
    area = out.groupBy("zid").agg(F.sum((F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")) / 2).alias("a")).collect()
    assert [(r["zid"], r["a"]) for r in area] == [(5, 10000.0)]


def test_crossings_and_corridor(spark):
    lines_df = spark.createDataFrame([(1, "33kv", 5.0, -5.0, 5.0, 5.0), (2, "11kv", 8.0, 1.0, 8.0, 9.0), (3, "33kv", 20.0, -5.0, 20.0, 5.0)], "lid long, v string, ax double, ay double, bx double, by double")
    paths = spark.createDataFrame([(9, 0.0, 0.0, 10.0, 0.0)], "sid long, px double, py double, qx double, qy double")
    assert {r["lid"] for r in lines.crossings(paths, lines_df, "sid", id="lid").collect()} == {1}
    assert {r["lid"] for r in lines.crossings(paths, lines_df, "sid", id="lid", reach_m=1.0).collect()} == {1, 2}
    site = spark.createDataFrame([(9, 0.0, 0.0)], "sid long, x double, y double")
    row = lines.corridor(site, lines_df, {"33kv": 2.0, "11kv": 1.0}, "sid", class_col="v", id="lid").first()
    assert (row["corridor_m"], row["lid"], row["in_corridor"]) == (3.0, 1, 0)


def test_feature_space_knn_equals_brute_force_with_copies(spark):
    rng = np.random.default_rng(4)
    z = rng.normal(size=(300, 6))
    z[::3] = z[0]
    df = spark.createDataFrame([(i, [float(v) for v in row], i % 7) for i, row in enumerate(z)], "vid long, z array<double>, g int")
    got = {(r["vid"], r["rank"]): r["neighbour_id"] for r in feature_space.knn(df, df, 5, query_id="vid", item_id="vid").collect()}
    for i in range(300):
        d = np.sqrt(((z - z[i]) ** 2).sum(axis=1))
        order = sorted((d[j], j) for j in range(300) if j != i)[:5]
        assert [got[(i, n + 1)] for n in range(5)] == [j for _, j in order]


def test_items_never_told_are_dropped_at_hot_places(spark):
    rng = random.Random(8)
    rows = [(k, float(k % 3), None if k % 3 == 2 else 1.0, None if k % 50 == 0 else rng.randrange(500)) for k in range(1500)] + [(7, 0.0, 1.0, 3)] * 2
    df = spark.createDataFrame(rows, "pid long, x double, y double, done int").withColumn("done", F.date_add(F.lit("2000-01-01").cast("date"), "done"))
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        kept = nearest.ever_lowest(df, ["x", "y"], "pid", "done", 4).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    full = df.collect()
    assert len(kept) < 200 and sum(r["done"] is None for r in kept) == 30
    for day in sorted({r["done"] for r in full if r["done"]}):
        for x in (0.0, 1.0, 2.0):
            want, got = (sorted(r["pid"] for r in part if r["x"] == x and r["done"] and r["done"] < day)[:4] for part in (full, kept))
            assert got == want
