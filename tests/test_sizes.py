"""Frames whose files say little about their size: what is broadcast, and what is paired once a place."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitegauge import session
from sitegauge.operators import corridors as co
from sitegauge.operators import feature_space as sp
from sitegauge.operators import joins as jn
from sitegauge.operators import lines as ln
from sitegauge.operators import models
from sitegauge.operators import polygons as pg
from sitegauge.operators.nearest import knn_in_years, nearest
from sitegauge.operators.radius import length_within, pairs_within
from sitegauge.plans.bindings import explode_ring

N = 120_000


def plan_of(df) -> list[str]:
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


@pytest.fixture(scope="module")
def packed(spark, tmp_path_factory):
    """More lines than may be broadcast, from a file of a few kilobytes."""
    path = str(tmp_path_factory.mktemp("sizes") / "seed.parquet")
    spark.range(N // 1000).coalesce(1).write.parquet(path)
    seed = spark.read.parquet(path).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(999))))
    line = (F.col("id") * 1000 + F.col("k")).alias("line_id")
    x, y = (F.col("k") % 300) * 100.0, (F.col("id") * 4 + F.floor(F.col("k") / 300)) * 100.0
    return seed.select(line, x.alias("ax"), y.alias("ay"), (x + 50).alias("bx"), (y + 20).alias("by"))


@pytest.fixture(scope="module")
def places(spark):
    return spark.createDataFrame([(i, 37.0 * i, 41.0 * i) for i in range(50)], "site_id long, x double, y double")


@pytest.mark.parametrize("search", [
    lambda p, s: nearest(p, s, id="line_id", ends=ln.ENDS),
    lambda p, s: pairs_within(p, s, 150.0, keep=["line_id"], ends=ln.ENDS),
    lambda p, s: length_within(p, s, [150.0]),
])
def test_many_items_are_not_broadcast(packed, places, search):
    joins = [line for line in plan_of(search(places, packed)) if "BroadcastHashJoin" in line]
    assert not [line for line in joins if "_i__cell" in line]


def test_many_boxes_and_capsules_are_not_broadcast(packed):
    cx, cy = F.col("ax") + 20, F.col("ay") + 5
    land = explode_ring(packed, [(cx, cy), (cx + 9, cy), (cx + 9, cy + 9), (cx, cy + 9)], ["line_id"])
    met = pg.box_pairs(pg.boxes(land, "line_id"), pg.boxes(land, "line_id").withColumnRenamed("line_id", "other"), ["line_id"], ["other"])
    assert not [line for line in plan_of(met) if "BroadcastHashJoin" in line]
    assert met.count() == N


def test_small_side_only_is_broadcast(spark):
    a, b = spark.range(10), spark.range(20)
    out = jn.join_sized(a, b, ["id"], 10, jn.BROADCAST_ROWS + 1)
    assert any("BroadcastHashJoin" in line and "BuildLeft" in line for line in plan_of(out))
    assert out.count() == 10


def test_short_and_long_rings_hold_the_same_places(spark):
    """A ring of 4 edges, the same ring cut into 400, a ring with a hole and one without id or with null ends."""
    square = [(0.0, 0.0), (100.0, 0.0), (100.0, 100.0), (0.0, 100.0)]
    rows = []

    def ring(id, corners, parts=1):
        for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1], strict=True):
            for k in range(parts):
                s, e = k / parts, (k + 1) / parts
                rows.append((id, len(rows), ax + (bx - ax) * s, ay + (by - ay) * s, ax + (bx - ax) * e, ay + (by - ay) * e))

    ring(1, square)
    ring(2, square, 100)
    ring(3, square)
    ring(3, [(40.0, 40.0), (40.0, 60.0), (60.0, 60.0), (60.0, 40.0)])
    ring(None, square)
    rows.append((1, 99, None, 5.0, 3.0, None))
    edges = spark.createDataFrame(rows, "id int, edge_no int, ax double, ay double, bx double, by double")
    points = spark.createDataFrame([(50.0, 50.0), (10.5, 20.5), (10.5, 20.5), (150.0, 50.0), (None, 1.0)], "x double, y double")
    got = sorted(tuple(r) for r in pg.inside_pairs(points, edges, "id").collect())
    assert got == [(10.5, 20.5, 1), (10.5, 20.5, 2), (10.5, 20.5, 3), (50.0, 50.0, 1), (50.0, 50.0, 2)]


def test_short_rings_are_not_shuffled_with_their_pairs(spark):
    """Pairs of a place and a short ring are judged where they are found."""
    edges = explode_ring(spark.createDataFrame([(i, 10.0 * i) for i in range(20)], "id int, c double"),
                         [(F.col("c"), F.lit(0.0)), (F.col("c") + 500, F.lit(0.0)), (F.col("c") + 500, F.lit(500.0))], ["id"])
    plan = plan_of(pg.inside_pairs(spark.createDataFrame([(300.0, 20.0)], "x double, y double"), edges, "id"))
    above = plan[: next(i for i, line in enumerate(plan) if "Join" in line)]
    assert not any("Exchange" in line for line in above)


def test_paths_that_share_their_ends_meet_sums(spark):
    """Polygons are summed up once a path; every site on it has the sums, in all and per class."""
    shapes = spark.createDataFrame([(i, i % 2, 10.0 * i) for i in range(5)], "id int, kind int, c double")
    c = F.col("c")
    edges = explode_ring(shapes, [(c, F.lit(-5.0)), (c + 4, F.lit(-5.0)), (c + 4, F.lit(5.0)), (c, F.lit(5.0))], ["id", "kind"])
    paths = spark.createDataFrame([(s, 0.0, 0.0, 100.0, 0.0, 100.0) for s in range(6)] + [(9, 0.0, 50.0, 1.0, 50.0, 1.0)],
                                  "site int, px double, py double, qx double, qy double, path_m double")
    out = ln.crossed_polygons(paths, edges, "site", id="id", class_col="kind", classes=[0, 1])
    rows = {r["site"]: r for r in out.collect()}
    assert all((rows[s]["polygons"], rows[s]["polygons_0"], rows[s]["polygons_1"]) == (5, 3, 2) for s in range(6))
    assert all(rows[s]["inside_m"] == pytest.approx(20.0) and rows[s]["inside_m_1"] == pytest.approx(8.0) for s in range(6))
    assert (rows[9]["polygons"], rows[9]["inside_m"]) == (0, 0.0)
    joins = [line for line in plan_of(out) if "Join" in line and "site" in line]
    assert not any("share" in line or "kind" in line for line in joins)


def test_corridor_of_sites_in_one_place(spark):
    sites = spark.createDataFrame([(1, 0.0, 8.0), (2, 0.0, 8.0), (2, 0.0, 30.0), (3, None, 1.0)], "site int, x double, y double")
    lines = spark.createDataFrame([(7, "a", -50.0, 0.0, 50.0, 0.0), (8, "b", -50.0, 20.0, 50.0, 20.0)], "line int, kind string, ax double, ay double, bx double, by double")
    out = ln.corridor(sites, lines, {"a": 5.0, "b": 1.0}, "site", class_col="kind", id="line")
    got = sorted((r["site"], r["y"], r["corridor_m"], r["line"], r["in_corridor"]) for r in out.collect())
    assert got == [(1, 8.0, 3.0, 7, 0), (2, 8.0, 3.0, 7, 0), (2, 30.0, 3.0, 7, 0), (3, 1.0, None, None, None)]


def shuffled(node, column: str) -> int:
    """Shuffles of a plan that carry a column."""
    if node.nodeName() == "AdaptiveSparkPlan":
        node = node.initialPlan()
    names = [node.output().apply(i).name() for i in range(node.output().size())]
    kids = [node.children().apply(i) for i in range(node.children().size())]
    return int(node.nodeName() == "Exchange" and column in names) + sum(shuffled(k, column) for k in kids)


def test_states_are_shuffled_once_a_cell(spark):
    """What a ring carries is sent to its cells once, not also to find out which cells have places."""
    sites = spark.createDataFrame([(i, 100.0 * i, 50.0, datetime.date(2020, 1, 1 + i)) for i in range(20)], "site_id int, x double, y double, day date")
    corner = spark.createDataFrame([(i, 300.0 * i) for i in range(7)], "zone_id int, c double")
    c = F.col("c")
    land = explode_ring(corner, [(c, c * 0), (c + 250, c * 0), (c + 250, c * 0 + 90), (c, c * 0 + 90)], ["zone_id"])
    states = spark.createDataFrame([(i, datetime.date(2020, 1, d), 10 * i + d) for i in range(7) for d in (3, 9, 15)] + [(2, None, 5)], "zone_id int, since date, value long")
    out = pg.active_polygons(sites, land, [120.0], "zone_id", states, "day", "since", ["value"])
    assert shuffled(out._jdf.queryExecution().executedPlan(), "_state_values") == 1

    def value(zone, day):
        past = [(d or datetime.date.min, v) for z, d, v in states.collect() if z == zone and (d is None or d <= day)]
        return max(past)[1] if past else 0

    got = {r["site_id"]: (r["value_on_site"], r["value_120"]) for r in out.collect()}
    for i in range(20):
        x, day = 100.0 * i, datetime.date(2020, 1, 1 + i)
        gap = [max(300.0 * z - x, x - 300.0 * z - 250, 0.0) for z in range(7)]
        assert got[i] == tuple(sum(value(z, day) for z in range(7) if gap[z] <= r) for r in (0.0, 120.0)), i


def test_capsules_are_cut_near_polygons_only(spark, monkeypatch):
    """A capsule that a hundred others cross is cut where a polygon lies, not at each crossing."""
    written = []
    monkeypatch.setattr(co, "cut_lineage", lambda df: written.append(df) or df)
    sites = spark.createDataFrame([(0, 5.0, -3.0)] + [(i, 10.0 * i + 95, 490.0) for i in range(1, 101)], "id int, x double, y double")
    x, y = F.col("x"), F.col("y")
    land = explode_ring(sites, [(x, y), (x + 6, y), (x + 6, y + 6), (x, y + 6)], ["id"])
    crossing = [("a", 10.0 * i + 98, -500.0, 10.0 * i + 98, 500.0) for i in range(1, 101)]
    lines = spark.createDataFrame([("a", 0.0, 0.0, 1500.0, 0.0), *crossing], "kind string, ax double, ay double, bx double, by double")
    got = {r["id"]: r["sterilised_m2"] for r in co.sterilised_area(land, lines, {"a": 2.0}, "id", class_col="kind").collect()}
    assert got == pytest.approx({i: 24.0 for i in range(101)})
    parts = [df for df in written if {"cap", "s", "e"} <= set(df.columns)]
    assert sum(df.count() for df in parts) <= 12 * 101


@pytest.mark.parametrize("pieces", [1, 40])
def test_sterilised_area_over_many_cells(spark, pieces):
    """A polygon of many cells, of few edges or of many: a cross of two lines, counted once where they meet; a hole is left out."""
    def ring(lo, hi, turn):
        corners = [(lo, lo), (hi, lo), (hi, hi), (lo, hi)][::turn]
        ends = [(a[0] + (b[0] - a[0]) * k / pieces, a[1] + (b[1] - a[1]) * k / pieces) for a, b in zip(corners, corners[1:] + corners[:1]) for k in range(pieces)]
        return list(zip(ends, ends[1:] + ends[:1]))

    edges = [(7, no, *a, *b) for no, (a, b) in enumerate(ring(-640.0, 768.0, 1) + ring(100.0, 200.0, -1))]
    land = spark.createDataFrame(edges, "id int, edge_no int, ax double, ay double, bx double, by double")
    lines = spark.createDataFrame([("a", -2000.0, 150.0, 2000.0, 150.0), ("a", 256.0, -2000.0, 256.0, 2000.0)], "kind string, ax double, ay double, bx double, by double")
    got = co.sterilised_area(land, lines, {"a": 10.0}, "id", class_col="kind").first()
    assert got["area"] == pytest.approx(1408.0**2 - 100.0**2)
    assert got["sterilised_m2"] == pytest.approx(2 * 1408.0 * 20 - 20 * 20 - 100 * 20)


def test_capsule_pieces_are_cut_once(spark, monkeypatch):
    """Cut pieces are written before they are met with the capsules, so they are not cut again for each action."""
    written = []
    monkeypatch.setattr(co, "cut_lineage", lambda df: written.append(set(df.columns)) or df)
    land = explode_ring(spark.createDataFrame([(1, 0.0)], "id int, c double"), [(F.col("c"), F.col("c")), (F.col("c") + 9, F.col("c")), (F.col("c") + 9, F.col("c") + 9), (F.col("c"), F.col("c") + 9)], ["id"])
    lines = spark.createDataFrame([("a", -5.0, 4.0, 20.0, 4.0)], "kind string, ax double, ay double, bx double, by double")
    out = co.sterilised_area(land, lines, {"a": 2.0}, "id", class_col="kind").first()
    assert out["sterilised_m2"] == pytest.approx(36.0)
    assert sum({"cap", "s", "e"} <= c for c in written) == 2


def test_queries_are_sent_to_blocks_in_bounded_batches(monkeypatch):
    """Every (row, part) goes once to each block of the part, few at a time."""
    monkeypatch.setattr(sp, "SENT_ROWS", 7)
    blocks = np.array([3, 1, 2])
    row, part = np.array([0, 0, 0, 1, 2, 2]), np.array([0, 1, 2, 2, 0, 2])
    sent = list(sp._sent(row, part, blocks))
    assert max(len(r) for r, _, _ in sent) <= 7
    got = [t for r, p, b in sent for t in zip(r.tolist(), p.tolist(), b.tolist(), strict=True)]
    assert got == [(r, p, b) for r, p in zip(row.tolist(), part.tolist(), strict=True) for b in range(blocks[p])]
    assert not list(sp._sent(row[:0], part[:0], blocks))


def test_feature_space_search_over_many_groups(spark, monkeypatch):
    """Blocks and groups of a few rows only, queries crowded in one part: still the exact neighbours."""
    for name, value in (("BLOCK", 16), ("PART_ROWS", 32), ("SENT_ROWS", 50)):
        monkeypatch.setattr(sp, name, value)
    rng = np.random.default_rng(3)
    z = np.concatenate([rng.normal(size=(200, 4)) * 0.05, rng.normal(size=(100, 4)) * 3])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(z)], "id long, z array<double>")
    found = sp.knn(df, df, 5, query_id="id", item_id="id").collect()
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    want = np.argsort(d, axis=1, kind="stable")[:, :5]
    got = {}
    for r in sorted(found, key=lambda r: (r["id"], r["rank"])):
        got.setdefault(r["id"], []).append(r["neighbour_id"])
    assert got == {i: w.tolist() for i, w in enumerate(want)}


def test_years_are_merged_before_the_sites_are_met(spark, monkeypatch):
    """Sites of one place and year meet k items; a site that is there twice ranks the items of both rows."""
    from sitegauge.operators import nearest as nr

    asked = []
    search = nr.knn
    monkeypatch.setattr(nr, "knn", lambda q, *a, **o: asked.append(q.count()) or search(q, *a, **o))
    rows = [(s, 0.0, 0.0, "2000-05-01") for s in range(5)] + [(7, 0.0, 0.0, "2001-01-01")] * 2 + [(8, 0.0, 0.0, None)]
    sites = spark.createDataFrame(rows, "site int, x double, y double, day string").withColumn("day", F.to_date("day"))
    items = spark.createDataFrame([(i, float(i), 0.0, 2000 + i % 3) for i in range(1, 13)], "id int, x double, y double, yr int")
    found = knn_in_years(sites, items, 4, years=range(2), date="day", item_year="yr", site="site", id="id")
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r["site"], r["rank"])):
        got.setdefault(r["site"], []).append((r["id"], r["yr"]))
    early = [(1, 2001), (3, 2000), (4, 2001), (6, 2000)]
    assert got == {**{s: early for s in range(5)}, 7: [(1, 2001), (1, 2001), (2, 2002), (2, 2002)]}
    assert asked[0] <= 2 * 3


def _dated_layer(spark):
    """Places in a row of overlapping squares, a ring too long for blocks, and states on two days."""
    square = lambda c, h: [(c - h, -h), (c + h, -h), (c + h, h), (c - h, h)]
    rows = [(k, n, *map(float, p), *map(float, q)) for k in range(30) for n, (p, q) in enumerate(zip(square(k, 20), square(k, 20)[1:] + square(k, 20)[:1], strict=True))]
    for n, (p, q) in enumerate(zip(square(200, 10), square(200, 10)[1:] + square(200, 10)[:1], strict=True)):
        for k in range(10):
            at = lambda t: (p[0] + (q[0] - p[0]) * t / 10, p[1] + (q[1] - p[1]) * t / 10)  # noqa: B023, E731
            rows.append((99, 10 * n + k, *map(float, at(k)), *map(float, at(k + 1))))
    edges = spark.createDataFrame(rows, "id long, edge_no int, ax double, ay double, bx double, by double")
    points = spark.createDataFrame([(k, float(x), 0.0, d) for k, (x, d) in enumerate([(10, "2020-01-05"), (10, "2020-02-05"), (45, "2020-02-05"), (200, "2020-02-05"), (212, "2019-01-01"), (500, None)])],
                                   "sid long, x double, y double, d string").withColumn("d", F.to_date("d"))
    return points, edges


def test_rings_near_a_place_form_no_rows(spark, monkeypatch):
    """Sums within radii come without the pairs of places and polygons, which only rings of many edges may form."""
    points, edges = _dated_layer(spark)
    short = edges.filter("id < 99")
    attributes = short.select("id").distinct().withColumns({"area": F.lit(1600.0), "kind": F.col("id") % 2, "v": F.col("id").cast("double")})
    states = attributes.select("id", F.explode(F.array(F.lit("2020-01-01").cast("date"), F.lit("2020-02-01").cast("date"))).alias("day")).withColumn("n", (F.col("id") + F.month("day")).cast("long"))
    with monkeypatch.context() as m:
        m.setattr(pg, "polygons_within", lambda *a: pytest.fail("pairs of short rings are formed"))
        m.setattr(pg, "clip_pairs", lambda *a: pytest.fail("pairs of short rings are formed"))
        counts = {r["sid"]: r for r in pg.counts_within(points, short, [5, 30], "id", attributes, "kind", [0, 1]).collect()}
        means = {r["sid"]: r["v_weighted"] for r in pg.area_weighted_mean(points, short, 30, "id", attributes, ["v"]).collect()}
        active = {r["sid"]: r for r in pg.active_polygons(points, short, [5], "id", states, "d", "day", ["n"]).collect()}
    assert [counts[k]["count_5"] for k in range(6)] == [30, 30, 10, 0, 0, 0] and counts[2]["count_30"] == 30
    assert counts[2]["count_5_0"] == 5 and counts[2]["area_5"] == 16000.0
    assert abs(means[0] - means[1]) < 1e-9 and means[2] > 14.5 and means[3] is None
    assert (active[0]["n_on_site"], active[1]["n_on_site"], active[3]["n_on_site"]) == (sum(range(30)) + 30, sum(range(30)) + 60, 0)
    assert active[2]["n_on_site"] == sum(k + 2 for k in range(25, 30)) and active[2]["n_5"] == sum(k + 2 for k in range(20, 30))


def test_blocks_and_long_rings_add_up(spark, monkeypatch):
    """A long ring counts beside short ones; cells dealt out in parts and small batches give the same sums."""
    points, edges = _dated_layer(spark)
    attributes = edges.select("id").distinct().withColumns({"area": F.lit(1.0), "kind": F.lit(0)})
    states = attributes.select("id", F.lit("2020-01-01").cast("date").alias("day"), F.lit(1 << 52).alias("n"))

    def run():
        counts = pg.counts_within(points, edges, [5, 30], "id", attributes).collect()
        clips = pg.clipped_area_by_class(points, edges.withColumn("kind", F.lit(0)), [30], "id", "kind", [0]).collect()
        active = pg.active_polygons(points, edges, [5], "id", states, "d", "day", ["n"]).collect()
        return [[tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in sorted(rows, key=lambda r: r["sid"])] for rows in (counts, clips, active)]

    whole = run()
    assert [r[4] for r in whole[0]] == [30, 30, 10, 1, 1, 0] and whole[2][0][4] == 30 << 52 and whole[2][3][4] == 1 << 52
    for name, n in (("PART_ROWS", 1), ("PART_PAIRS", 20), ("TRIED", 3), ("HELD", 2)):
        monkeypatch.setattr(pg.blocks, name, n)
    assert run() == whole


def test_touching_rings_are_tried_once(spark):
    """Short rings touch without a row per pair of edges; a long ring, one without id and one with a gap go edge by edge."""
    _, edges = _dated_layer(spark)
    odd = spark.createDataFrame([(None, 0, 0.0, 0.0, 50.0, 50.0), (98, 0, 190.0, 0.0, 215.0, 0.0), (98, 1, None, 0.0, 0.0, 0.0)], edges.schema)
    every = edges.unionByName(odd)
    got = sorted(map(tuple, pg.polygon_intersects(every, every, "id", "id", ascending=True).collect()))
    assert got == sorted([(a, b) for a in range(30) for b in range(a + 1, 30)] + [(98, 99)])
    assert sorted(map(tuple, pg._touching_by_edges(every, every, "id", "id").filter("id_a < id_b").collect())) == got
    both = lambda f: sorted(map(tuple, f(every, every, "id", "id").collect()), key=str)
    assert both(pg.polygon_intersects) == both(pg._touching_by_edges)
    short = edges.filter("id < 99")
    assert not [line for line in plan_of(pg.polygon_intersects(short, short, "id", "id")) if "no_a" in line]


class _Watched:
    """A regressor that notes the parts of the frames it is fitted on."""

    def __init__(self, inner, parts):
        self.inner, self.parts = inner, parts

    def setMaxDepth(self, depth):
        self.inner.setMaxDepth(depth)
        return self

    def fit(self, df):
        self.parts.append(df.rdd.getNumPartitions())
        return self.inner.fit(df)


def _watched(monkeypatch):
    parts, plain = [], models.regressor
    monkeypatch.setattr(session, "SPREAD_ROWS", (20, 100))
    monkeypatch.setattr(models, "regressor", lambda *a, **k: _Watched(plain(*a, **k), parts))
    return parts


def _measured(spark, n=160):
    rows = [(k, k % 5, float(k % 13), float(k * 7 % 11)) for k in range(n)]
    return spark.createDataFrame(rows, "id long, fold int, a double, b double").withColumn("days", F.col("a") * 3 + F.col("b")).coalesce(1)


def test_tuning_fits_each_depth_and_fold_once_on_spread_rows(spark, monkeypatch):
    parts, plain = _watched(monkeypatch), models.regressor
    df = _measured(spark)
    got = {r["depth"]: r["rmse"] for r in models.tune(df, ["a", "b"], "days", "fold", [1, 2]).collect()}
    assert len(parts) == 10 and set(parts) == {8}
    x = models.assembler(["a", "b"]).transform(df)
    for depth in (1, 2):
        errors = []
        for i in range(5):
            model = plain("days", "prediction").setMaxDepth(depth).fit(x.filter(F.col("fold") != i))
            errors.append(model.transform(x.filter(F.col("fold") == i)).agg(F.sqrt(F.avg((F.col("prediction") - F.col("days")) ** 2))).first()[0])
        assert abs(got[depth] - sum(errors) / 5) < 1e-9


@pytest.mark.parametrize("fold", ["fold + 1", "0", "CASE WHEN id > 3 THEN fold END"])
def test_tuning_refuses_folds_outside_or_empty(spark, fold):
    with pytest.raises(Exception, match="fold|Fold"):
        models.tune(_measured(spark).withColumn("fold", F.expr(fold).cast("int")), ["a", "b"], "days", "fold", [1])


def test_stack_learns_from_spread_rows(spark, monkeypatch):
    parts = _watched(monkeypatch)
    df = _measured(spark)
    out = models.residual_stack(df, df, ["a", "b"], "days", {"one": "a > 6", "none": "a > 99", "two": "b < 5"}).collect()
    assert len(parts) == 3 and set(parts) == {8} and len(out) == 160 and "head_none" not in out[0].asDict()
    for r in out:
        assert abs(r["base"] + r["head_one"] + r["head_two"] + r["corrector"] - r["prediction"]) < 1e-9
        assert (r["a"] > 6 or r["head_one"] == 0) and (r["b"] < 5 or r["head_two"] == 0)


def test_spread_parts_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(session, "SPREAD_ROWS", (20, 100))
    parts = lambda n: session.spread(spark.range(n).coalesce(1)).rdd.glom().map(len).collect()
    assert [len(parts(n)) for n in (5, 19, 20, 800, 801)] == [1, 1, 8, 8, 16]
    assert max(parts(801)) <= 100 and sum(parts(801)) == 801


def test_feature_space_search_takes_turns(spark, monkeypatch):
    """Groups of queries that are sent much take turns; each is written, so its shuffle files can go."""
    rng = np.random.default_rng(8)
    z = rng.normal(size=(150, 3)).round(3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(z)], "id long, z array<double>")
    for name, value in (("BLOCK", 16), ("PART_ROWS", 32), ("ROUND_CELLS", 1500)):
        monkeypatch.setattr(sp, name, value)
    turns, write = [], sp.written
    monkeypatch.setattr(sp, "written", lambda t: turns.append(t) or write(t))
    got = {(r["id"], r["rank"]): r["neighbour_id"] for r in sp.knn(df, df, 4, query_id="id", item_id="id").collect()}
    assert len(turns) > 2
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(axis=2))
    want = {(i, k + 1): j for i in range(150) for k, j in enumerate([j for j in np.lexsort((np.arange(150), d[i])) if j != i][:4])}
    assert got == want
    assert sp._turns([(3, 5), (1, 4), (2, 9), (0, 2)], 10) == [[0, 1], [2], [3]]
