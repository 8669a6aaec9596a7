"""Polygon joins over directed ring edges (JN-5, 6, 10, 11, 15..18).

A polygon layer is a frame of edges (id, ax, ay, bx, by); outer rings run counter-clockwise, holes
clockwise. Polygons and points meet on grid cells at least half as large as the polygon, each polygon
then on at most nine cells. A ring of up to ``EDGES_PER_BAND`` edges goes along as an array, so its pairs
are not shuffled again; a longer ring is tested only against the edges in the point's horizontal band.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitegauge.functions import geometry as geo
from sitegauge.operators import blocks
from sitegauge.operators.joins import BROADCAST_ROWS, join_sized, sized
from sitegauge.operators.nearest import nearest
from sitegauge.operators.radius import pairs_within
from sitegauge.session import cut_lineage

EDGE = ("ax", "ay", "bx", "by")
EDGES_PER_BAND = 32
COVER = 9
CHAIN = 64


def repair_edges(edges: DataFrame, id: str) -> DataFrame:
    """Drop null and zero-length edges, then polygons whose ring does not close or has no area."""
    good = edges.dropna(subset=list(EDGE)).filter((F.col("ax") != F.col("bx")) | (F.col("ay") != F.col("by")))
    checks = good.groupBy(id).agg(
        F.sum(F.col("bx") - F.col("ax")).alias("_dx"), F.sum(F.col("by") - F.col("ay")).alias("_dy"),
        F.sum(geo.shoelace_term(*(F.col(c) for c in EDGE))).alias("_area"), F.count(F.lit(1)).alias("_n"),
    )
    valid = checks.filter((F.abs("_dx") < 1e-6) & (F.abs("_dy") < 1e-6) & (F.abs("_area") > 0) & (F.col("_n") >= 3))
    out = good.join(valid.select(id, (F.col("_area") < 0).alias("_flip")), id)
    flipped = {c: F.when(F.col("_flip"), F.col(o)).otherwise(F.col(c)) for c, o in zip(EDGE, ("bx", "by", "ax", "ay"), strict=True)}
    return out.withColumns(flipped).drop("_flip")


def measures(edges: DataFrame, id: str) -> DataFrame:
    """Area, perimeter and centroid per polygon; no centroid where there is no area."""
    e = [F.col(c) for c in EDGE]
    cross = geo.shoelace_term(*e) * 2
    sums = edges.groupBy(id).agg(
        F.sum(cross).alias("_c"), F.sum(geo.distance(*e)).alias("perimeter"),
        F.sum((e[0] + e[2]) * cross).alias("_cx"), F.sum((e[1] + e[3]) * cross).alias("_cy"),
    )
    return sums.select(id, F.abs(F.col("_c") / 2).alias("area"), "perimeter",
                       F.try_divide(F.col("_cx"), 3 * F.col("_c")).alias("centroid_x"), F.try_divide(F.col("_cy"), 3 * F.col("_c")).alias("centroid_y"))


def boxes(edges: DataFrame, id: str) -> DataFrame:
    xs, ys = [F.col("ax"), F.col("bx")], [F.col("ay"), F.col("by")]
    out = edges.groupBy(id).agg(
        F.min(F.least(*xs)).alias("_minx"), F.min(F.least(*ys)).alias("_miny"),
        F.max(F.greatest(*xs)).alias("_maxx"), F.max(F.greatest(*ys)).alias("_maxy"), F.count(F.lit(1)).alias("_n"),
    )
    return out.withColumns({
        "_scale": box_scale(F.col("_maxx") - F.col("_minx"), F.col("_maxy") - F.col("_miny")),
        "_bands": F.greatest(F.lit(1), F.ceil(F.col("_n") / EDGES_PER_BAND)).cast("long"),
    })


def box_scale(w: Column, h: Column) -> Column:
    """Power of two whose cells are no smaller than the box."""
    return F.ceil(F.log2(F.greatest(w, h, F.lit(1e-3)))).cast("int")


def _cells(lo: Column, hi: Column, scale: Column) -> Column:
    size = F.pow(F.lit(2.0), scale)
    return F.sequence(F.floor(lo / size), F.floor(hi / size))


def _cover(boxed: DataFrame) -> DataFrame:
    out = boxed.withColumn("_gx", F.explode(_cells(F.col("_minx"), F.col("_maxx"), F.col("_scale"))))
    return out.withColumn("_gy", F.explode(_cells(F.col("_miny"), F.col("_maxy"), F.col("_scale"))))


def _band(y: Column) -> Column:
    height = (F.col("_maxy") - F.col("_miny")) / F.col("_bands")
    raw = F.when(height > 0, F.floor((y - F.col("_miny")) / height)).otherwise(0)
    return F.greatest(F.lit(0), F.least(raw, F.col("_bands") - 1)).cast("long")


def _banded(edges: DataFrame, boxed: DataFrame, id: str) -> DataFrame:
    """Edges on every band they cross; a band is met by few edges however long the ring is."""
    e = edges.select(id, *EDGE).join(boxed.select(id, "_miny", "_maxy", "_bands"), id)
    bands = F.sequence(_band(F.least("ay", "by")), _band(F.greatest("ay", "by")))
    return e.withColumn("_band", F.explode(bands)).select(id, "_band", *[F.col(c).alias(f"_{c}") for c in EDGE])


def ring_odd(ring: Column, x: Column, y: Column) -> Column:
    """Whether the ray from (x, y) meets an odd number of the ring's edges."""
    met = F.filter(ring, lambda e: geo.ray_crosses(x, y, *[e[c] for c in EDGE]))
    return F.size(met) % 2 == 1


def inside_pairs(points: DataFrame, edges: DataFrame, id: str, x: str = "x", y: str = "y") -> DataFrame:
    """(x, y, id) for every distinct place and polygon containing it."""
    boxed = boxes(edges, id).filter(F.col(id).isNotNull() & F.col("_scale").isNotNull()).withColumn("_scale", F.col("_scale") - 1)
    short = F.col("_bands") == 1
    sizes = boxed.groupBy("_scale", short.alias("short")).agg(F.count(F.lit(1)).alias("n"), F.sum("_n").alias("edges")).collect()
    places = points.select(x, y).dropna().distinct()
    if not sizes:
        return places.join(boxed.select(id), F.lit(False))

    def held(mine: bool, covers: DataFrame, rows: int, keep: Sequence) -> DataFrame:
        scales = sorted(r["_scale"] for r in sizes if r["short"] == mine)
        on_grid = places.withColumn("_scale", F.explode(F.array(*[F.lit(s) for s in scales])))
        size = F.pow(F.lit(2.0), F.col("_scale"))
        on_grid = on_grid.withColumns({"_gx": F.floor(F.col(x) / size), "_gy": F.floor(F.col(y) / size)})
        covers = F.broadcast(covers) if rows <= BROADCAST_ROWS else sized(covers, rows)
        hits = on_grid.join(covers, ["_scale", "_gx", "_gy"])
        hits = hits.filter(F.col(x).between(F.col("_minx"), F.col("_maxx")) & F.col(y).between(F.col("_miny"), F.col("_maxy")))
        return hits.select(x, y, id, *keep)

    polygons, lines = ({k: sum(r[c] for r in sizes if r["short"] == k) for k in (True, False)} for c in ("n", "edges"))
    found = []
    if polygons[True]:
        mine = boxed.filter(short)
        rings = edges.select(id, *EDGE)
        if polygons[False]:
            rings = rings.join(sized(mine.select(id), polygons[True]), id, "left_semi")
        rings = rings.groupBy(id).agg(F.collect_list(F.struct(*EDGE)).alias("_ring"))
        covers = _cover(join_sized(rings, mine, [id], polygons[True], polygons[True]))
        met = held(True, covers, COVER * max(polygons[True], lines[True] // 4), ["_ring"])
        found.append(met.filter(ring_odd(F.col("_ring"), F.col(x), F.col(y))).select(x, y, id))
    if polygons[False]:
        mine = boxed.filter(~short)
        hits = held(False, _cover(mine), COVER * polygons[False], [_band(F.col(y)).alias("_band")])
        met = hits.join(sized(_banded(edges, mine, id), lines[False]), [id, "_band"])
        crosses = geo.ray_crosses(F.col(x), F.col(y), *[F.col(f"_{c}") for c in EDGE])
        odd = met.groupBy(x, y, id).agg(F.sum(F.when(crosses, 1).otherwise(0)).alias("_k"))
        found.append(odd.filter(F.col("_k") % 2 == 1).select(x, y, id))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def point_in_polygon(points: DataFrame, edges: DataFrame, id: str, how: str = "left", first: bool = False) -> DataFrame:
    """Points with the polygons containing them; ``first`` keeps the lowest id per place."""
    pairs = inside_pairs(points, edges, id)
    if first:
        pairs = pairs.groupBy("x", "y").agg(F.min(id).alias(id))
    return points.join(pairs, ["x", "y"], how)


def nearest_polygon(points: DataFrame, edges: DataFrame, id: str, distance: str = "distance") -> DataFrame:
    """Nearest polygon per point: 0 when inside (lowest id), else the distance to its nearest edge."""
    lines = edges.select(id, *EDGE)
    near = nearest(points, lines, id=id, ends=EDGE, distance="_d", how="left").withColumnRenamed(id, "_near")
    inside = inside_pairs(points, lines, id).groupBy("x", "y").agg(F.min(id).alias("_in"))
    out = near.join(inside, ["x", "y"], "left")
    is_in = F.col("_in").isNotNull()
    return out.withColumns({
        id: F.coalesce(F.col("_in"), F.col("_near")), distance: F.when(is_in, 0.0).otherwise(F.col("_d")),
        "inside": is_in.cast("int"),
    }).drop("_in", "_near", "_d")


def within_else_nearest(points: DataFrame, edges: DataFrame, id: str) -> DataFrame:
    """Containing polygon, else the nearest, with the method that found it."""
    out = nearest_polygon(points, edges, id)
    method = F.when(F.col("inside") == 1, "within").when(F.col(id).isNotNull(), "nearest")
    return out.withColumn("method", method).drop("inside")


def polygons_within(points: DataFrame, edges: DataFrame, r: float, id: str) -> DataFrame:
    """(x, y, id, distance) of every polygon no further than r from each distinct place."""
    edge_pairs = pairs_within(points, edges, r, keep=[id], ends=EDGE).select("x", "y", id, "distance")
    inside = inside_pairs(points, edges, id).withColumn("distance", F.lit(0.0))
    return edge_pairs.unionByName(inside).groupBy("x", "y", id).agg(F.min("distance").alias("distance"))


def _rings_near(edges: DataFrame, id: str, reach: float) -> tuple[DataFrame | None, list[int], DataFrame | None]:
    """Short rings packed for blocks, the cell sizes they lie on, and the edges of longer rings; null where there are none."""
    boxed = blocks.with_reach(boxes(edges.filter(F.col(id).isNotNull()), id), reach)
    short = F.col("_bands") == 1
    sizes = boxed.groupBy("_scale", short.alias("short")).agg(F.count(F.lit(1)).alias("n")).collect()
    scales = sorted(r["_scale"] for r in sizes if r["short"])
    rings = blocks.packed(edges, boxed.filter(short), id) if scales else None
    many = sum(r["n"] for r in sizes if not r["short"])
    lines = edges.join(sized(boxed.filter(~short).select(id), many), id, "left_semi") if many else None
    return rings, scales, lines


def _sums_near(points: DataFrame, edges: DataFrame, radii: Sequence[float], id: str, attributes: DataFrame,
               weights: Mapping[str, Column], clip: bool) -> DataFrame:
    """(x, y) and per radius ``name_r``: each weight summed over polygons within it, or with ``clip`` over the areas inside
    it, then with the count of areas above 0 as ``_n_r``. Weights are columns of ``attributes``; null counts as 0."""
    names = [f"{n}_{int(r)}" for r in radii for n in [*weights, *(["_n"] if clip else [])]]
    rings, scales, lines = _rings_near(edges, id, max(radii))
    found = []
    if rings is not None:
        found.append(blocks.sums_near(points, rings, attributes, id, scales, radii, list(weights.values()), clip).toDF("x", "y", *names))
    if lines is not None:
        pairs = polygons_within(points, lines, max(radii), id)
        pairs = (clip_pairs(pairs, lines, radii, id) if clip else pairs).join(attributes, id)
        sums = []
        for r in radii:
            part = F.col(f"clip_{int(r)}") if clip else (F.col("distance") <= float(r)).cast("double")
            sums += [F.coalesce(w.cast("double"), F.lit(0.0)) * part for w in weights.values()] + ([(part > 0).cast("double")] if clip else [])
        found.append(pairs.select("x", "y", *[s.alias(n) for s, n in zip(sums, names, strict=True)]))
    if not found:
        return points.select("x", "y").limit(0).withColumns({n: F.lit(0.0) for n in names})
    both = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    return both.groupBy("x", "y").agg(*[F.sum(n).alias(n) for n in names])


def counts_within(points: DataFrame, edges: DataFrame, radii: Sequence[float], id: str, attributes: DataFrame,
                  class_col: str | None = None, classes: Sequence = ()) -> DataFrame:
    """Count and full (unclipped) area of polygons within each radius, with ``class_col`` also per class.

    ``attributes`` carries (id, area) and the class, if asked for. A null or unlisted class counts in the totals only.
    """
    weights = {"count": F.lit(1), "area": F.col("area")}
    for k in classes:
        mine = F.col(class_col) == k
        weights |= {f"count#{k}": mine.cast("int"), f"area#{k}": F.when(mine, F.col("area"))}
    sums = _sums_near(points, edges, radii, id, attributes.select(id, "area", *([class_col] if class_col else [])), weights, False)
    outs = []
    for r in radii:
        for k in ["", *[f"#{k}" for k in classes]]:
            label = f"_{int(r)}" + k.replace("#", "_")
            outs += [F.col(f"`count{k}_{int(r)}`").cast("long").alias(f"count{label}"), F.col(f"`area{k}_{int(r)}`").alias(f"area{label}")]
    totals = sums.select("x", "y", *outs)
    out = points.join(totals, ["x", "y"], "left")
    return out.na.fill(0, [c for c in totals.columns if c not in ("x", "y")])


def _run_tree(edges: DataFrame, id: str) -> list[DataFrame]:
    """Edges, runs of ``CHAIN`` consecutive edges, runs of as many runs, and so on up to one run a polygon.

    Each node has its number, its parent's, its box and its two ends. Seen from outside its box, an unbroken
    run turns through the same angle as the straight line between its ends, so far runs stand for their
    edges exactly.
    """
    xs, ys = [F.col("ax"), F.col("bx")], [F.col("ay"), F.col("by")]
    no = F.col("edge_no").cast("long")
    level = edges.select(
        id, no.alias("_no"), F.struct("ax", "ay").alias("_a"), F.struct(F.col("bx").alias("ax"), F.col("by").alias("ay")).alias("_b"),
        F.least(*xs).alias("_x0"), F.least(*ys).alias("_y0"), F.greatest(*xs).alias("_x1"), F.greatest(*ys).alias("_y1"), F.lit(True).alias("_whole"))
    most, out = edges.agg(F.max(no)).first()[0] or 0, []
    while True:
        level = level.withColumn("_parent", F.floor(F.col("_no") / CHAIN))
        out.append(level)
        if len(out) > 1 and most < CHAIN ** (len(out) - 1):
            return out
        order = Window.partitionBy(id, "_parent").orderBy("_no")
        linked = level.withColumn("_link", F.col("_whole") & F.coalesce(F.lag("_b").over(order) == F.col("_a"), F.lit(True)))
        level = linked.groupBy(id, F.col("_parent").alias("_no")).agg(
            F.min_by("_a", F.col("_no")).alias("_a"), F.max_by("_b", F.col("_no")).alias("_b"), F.min("_x0").alias("_x0"), F.min("_y0").alias("_y0"),
            F.max("_x1").alias("_x1"), F.max("_y1").alias("_y1"), F.bool_and("_link").alias("_whole"))


def clip_pairs(pairs: DataFrame, edges: DataFrame, radii: Sequence[float], id: str) -> DataFrame:
    """(x, y, id, clip_r...) area of the pair's polygon inside each disc around its place.

    The tree of runs is descended from each polygon's one uppermost run: only runs whose box meets the largest
    disc are taken apart, so the rows formed follow the edges that the disc cuts, not the ring's length.
    """
    tree = _run_tree(edges, id)

    def judged(level: DataFrame) -> DataFrame:
        return level.select(F.col(id).alias("_poly"), "_parent", *[F.col(c).alias(f"_k{c}") for c in ("_no", "_a", "_b", "_x0", "_y0", "_x1", "_y1", "_whole")])

    met = pairs.select("x", "y", id).withColumns({"_no": F.lit(0).cast("long"), "_done": F.lit(False)})
    met = met.withColumns({"_a": F.lit(None).cast("struct<ax:double,ay:double>"), "_b": F.lit(None).cast("struct<ax:double,ay:double>")})
    for level in reversed(tree):
        kids = judged(level)
        # Settled runs pass on spread keys that match nothing.
        probe = F.when(F.col("_done"), -1 - F.pmod(F.xxhash64("x", "y", "_no"), F.lit(1 << 20))).otherwise(F.col("_no"))
        met = met.withColumn("_probe", probe).join(kids, (F.col(id) == F.col("_poly")) & (F.col("_probe") == F.col("_parent")), "left")
        gap = geo.box_min_distance(F.col("x"), F.col("y"), *[F.col(f"_k_{c}") for c in ("x0", "y0", "x1", "y1")])
        far = F.col("_k_whole") & (gap > float(max(radii)) * (1 + 1e-9))
        opened = F.col("_poly").isNotNull()
        met = met.select("x", "y", id, F.when(opened, F.col("_k_no")).otherwise(F.col("_no")).alias("_no"), F.when(opened, F.col("_k_a")).otherwise(F.col("_a")).alias("_a"),
                         F.when(opened, F.col("_k_b")).otherwise(F.col("_b")).alias("_b"), (F.col("_done") | F.coalesce(far, F.lit(False))).alias("_done"))
    met = met.select("x", "y", id, F.col("_a.ax").alias("ax"), F.col("_a.ay").alias("ay"), F.col("_b.ax").alias("bx"), F.col("_b.ay").alias("by"))
    terms = geo.with_disc_area_terms(
        met, F.col("x"), F.col("y"), {f"clip_{int(r)}": float(r) for r in radii}, *[F.col(c) for c in EDGE]
    )
    return terms.groupBy("x", "y", id).agg(*[F.abs(F.sum(f"clip_{int(r)}")).alias(f"clip_{int(r)}") for r in radii])


def clipped_areas(points: DataFrame, edges: DataFrame, radii: Sequence[float], id: str) -> DataFrame:
    """(x, y, id, clip_r...) area of each polygon inside each disc around each distinct place."""
    return clip_pairs(polygons_within(points, edges, max(radii), id), edges, radii, id)


def clipped_area_by_class(points: DataFrame, edges: DataFrame, radii: Sequence[float], id: str,
                          class_col: str, classes: Sequence) -> DataFrame:
    """Clipped area, count and share of the disc per radius, and clipped area per class."""
    kinds = edges.select(id, class_col).distinct()
    weights = {"area": F.lit(1), **{f"area#{k}": (F.col(class_col) == k).cast("int") for k in classes}}
    sums = _sums_near(points, edges.drop(class_col), radii, id, kinds, weights, True)
    outs = []
    for r in radii:
        area = F.col(f"area_{int(r)}")
        outs += [area, F.col(f"_n_{int(r)}").cast("long").alias(f"count_{int(r)}"), (area / geo.disc_area(float(r))).alias(f"share_{int(r)}"),
                 *[F.col(f"`area#{k}_{int(r)}`").alias(f"area_{int(r)}_{k}") for k in classes]]
    totals = sums.select("x", "y", *outs)
    return points.join(totals, ["x", "y"], "left").na.fill(0, [c for c in totals.columns if c not in ("x", "y")])


def area_weighted_mean(points: DataFrame, edges: DataFrame, r: float, id: str, attributes: DataFrame,
                       values: Sequence[str]) -> DataFrame:
    """Polygon measures averaged over the disc, weighted by the area of each fragment."""
    weights = {n: w for v in values for n, w in ((f"_sum_{v}", F.col(v)), (f"_known_{v}", F.col(v).isNotNull().cast("int")))}
    sums = _sums_near(points, edges.select(id, "edge_no", *EDGE), [r], id, attributes.select(id, *values), weights, True)
    means = sums.select("x", "y", *[F.try_divide(F.col(f"_sum_{v}_{int(r)}"), F.col(f"_known_{v}_{int(r)}")).alias(f"{v}_weighted") for v in values])
    return points.join(means, ["x", "y"], "left")


# --- polygon against polygon ---------------------------------------------------------------------

def box_pairs(a: DataFrame, b: DataFrame, keep_a: Sequence[str], keep_b: Sequence[str]) -> DataFrame:
    """Pairs of boxes that meet. Each box lies on cells of its own size and of every larger size in
    use; a pair is found on the larger of its two sizes, so of two boxes in a cell one is of its size."""
    both = a.select("_scale", F.lit(True).alias("a")).unionByName(b.select("_scale", F.lit(False).alias("a")))
    sizes = both.filter("_scale IS NOT NULL").groupBy("_scale", "a").agg(F.count(F.lit(1)).alias("n")).collect()
    scales = sorted({r["_scale"] for r in sizes})
    rows_a, rows_b = (4 * sum(r["n"] * sum(s >= r["_scale"] for s in scales) for r in sizes if r["a"] == side) for side in (True, False))

    def spread(df: DataFrame, tag: str) -> DataFrame:
        wider = F.filter(F.array(*[F.lit(s) for s in scales]), lambda s: s >= F.col("_scale"))
        out = df.withColumn("_own", F.col("_scale")).withColumn("_scale", F.explode(wider))
        out = _cover(out)
        return out.select("_scale", "_gx", "_gy", F.col("_own").alias(f"_own_{tag}"),
                          *[F.col(c).alias(f"{c}_{tag}") for c in ("_minx", "_miny", "_maxx", "_maxy")],
                          *(keep_a if tag == "a" else keep_b))

    wide_a, wide_b, cell = spread(a, "a"), spread(b, "b"), ["_scale", "_gx", "_gy"]
    met = join_sized(wide_a.filter("_own_a = _scale"), wide_b, cell, rows_a, rows_b)
    met = met.unionByName(join_sized(wide_a.filter("_own_a < _scale"), wide_b.filter("_own_b = _scale"), cell, rows_a, rows_b))
    met = met.filter(
        (F.col("_minx_a") <= F.col("_maxx_b")) & (F.col("_minx_b") <= F.col("_maxx_a"))
        & (F.col("_miny_a") <= F.col("_maxy_b")) & (F.col("_miny_b") <= F.col("_maxy_a"))
    )
    # The pair is reported by the one shared cell holding the lower corner of the common box.
    size = F.pow(F.lit(2.0), F.col("_scale"))
    corner = (F.col("_gx") == F.floor(F.greatest("_minx_a", "_minx_b") / size)) & (
        F.col("_gy") == F.floor(F.greatest("_miny_a", "_miny_b") / size)
    )
    return met.filter(corner).select(*keep_a, *keep_b)


def _edge_boxes(edges: DataFrame, id: str, tag: str) -> DataFrame:
    out = edges.select(F.col(id).alias(f"id_{tag}"), F.col("edge_no").alias(f"no_{tag}"), *[F.col(c).alias(f"{c}_{tag}") for c in EDGE])
    ax, ay, bx, by = (F.col(f"{c}_{tag}") for c in EDGE)
    out = out.withColumns({"_minx": F.least(ax, bx), "_miny": F.least(ay, by), "_maxx": F.greatest(ax, bx), "_maxy": F.greatest(ay, by)})
    return out.withColumn("_scale", box_scale(F.col("_maxx") - F.col("_minx"), F.col("_maxy") - F.col("_miny")))


def _edge_pairs(a: DataFrame, b: DataFrame, a_id: str, b_id: str) -> DataFrame:
    keep_a = ["id_a", "no_a", *[f"{c}_a" for c in EDGE]]
    keep_b = ["id_b", "no_b", *[f"{c}_b" for c in EDGE]]
    return box_pairs(_edge_boxes(a, a_id, "a"), _edge_boxes(b, b_id, "b"), keep_a, keep_b)


def _cut_points(pairs: DataFrame, tag: str, other: str) -> DataFrame:
    """Parameters in (0, 1) where the tagged edge is met by the other polygon's edges."""
    px, py, qx, qy = (F.col(f"{c}_{tag}") for c in EDGE)
    cx, cy, dx, dy = (F.col(f"{c}_{other}") for c in EDGE)
    ux, uy, vx, vy = qx - px, qy - py, dx - cx, dy - cy
    det = ux * vy - uy * vx
    t = ((cx - px) * vy - (cy - py) * vx) / F.when(det != 0, det)
    s = ((cx - px) * uy - (cy - py) * ux) / F.when(det != 0, det)
    len2 = ux * ux + uy * uy
    collinear = (det == 0) & ((cx - px) * uy - (cy - py) * ux == 0)
    meets = F.when(det != 0, F.array(F.when(s.between(-1e-12, 1 + 1e-12), t))).when(
        collinear, F.array(F.try_divide((cx - px) * ux + (cy - py) * uy, len2), F.try_divide((dx - px) * ux + (dy - py) * uy, len2))
    )
    inner = F.filter(meets, lambda v: v.isNotNull() & (v > 1e-12) & (v < 1 - 1e-12))
    return pairs.select(f"id_{tag}", f"no_{tag}", f"id_{other}", F.explode(inner).alias("_t")).distinct()


def _kept_terms(near: DataFrame, cuts: DataFrame, tag: str, other_edges: DataFrame, other_id: str, other: str, keep_shared: bool) -> DataFrame:
    """Shoelace terms of the tagged polygon's sub-edges lying inside the other polygon.

    ``near`` holds edges with the polygons whose box they meet: no other edge can lie inside.
    """
    mine = near.withColumnsRenamed({f"no_{tag}": "no", **{f"{c}_{tag}": c for c in EDGE}})
    grouped = cuts.groupBy(f"id_{tag}", f"no_{tag}", f"id_{other}").agg(F.collect_list("_t").alias("_ts"))
    mine = mine.join(grouped.withColumnRenamed(f"no_{tag}", "no"), [f"id_{tag}", "no", f"id_{other}"], "left")
    stops = F.array_sort(F.concat(F.array(F.lit(0.0), F.lit(1.0)), F.coalesce("_ts", F.array().cast("array<double>"))))
    pieces = F.arrays_zip(F.slice(stops, 1, F.size(stops) - 1).alias("s"), F.slice(stops, 2, F.size(stops) - 1).alias("e"))
    mine = mine.select(f"id_{tag}", f"id_{other}", "no", *EDGE, F.explode(pieces).alias("p")).filter(F.col("p.e") > F.col("p.s"))
    ux, uy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    mine = mine.withColumns({
        "_sx": F.col("ax") + ux * F.col("p.s"), "_sy": F.col("ay") + uy * F.col("p.s"),
        "_ex": F.col("ax") + ux * F.col("p.e"), "_ey": F.col("ay") + uy * F.col("p.e"), "_ps": F.col("p.s"),
    }).drop("p", *EDGE)
    mine = mine.withColumns({"_x": (F.col("_sx") + F.col("_ex")) / 2, "_y": (F.col("_sy") + F.col("_ey")) / 2})
    boxed = boxes(other_edges, other_id)
    mine = mine.join(boxed.select(F.col(other_id).alias(f"id_{other}"), "_miny", "_maxy", "_bands"), f"id_{other}")
    mine = mine.withColumn("_band", _band(F.col("_y"))).drop("_miny", "_maxy", "_bands")
    rings = _banded(other_edges, boxed, other_id).withColumnRenamed(other_id, f"id_{other}")
    met = mine.join(rings, [f"id_{other}", "_band"])
    ring = [F.col(f"_{c}") for c in EDGE]
    on = geo.segment_distance(F.col("_x"), F.col("_y"), *ring) < 1e-6
    along = (ring[2] - ring[0]) * (F.col("_ex") - F.col("_sx")) + (ring[3] - ring[1]) * (F.col("_ey") - F.col("_sy")) > 0
    judged = met.groupBy(f"id_{tag}", f"id_{other}", "no", "_ps").agg(
        *[F.first(c).alias(c) for c in ("_sx", "_sy", "_ex", "_ey")],
        F.sum(F.when(geo.ray_crosses(F.col("_x"), F.col("_y"), *ring), 1).otherwise(0)).alias("_k"),
        F.max(F.when(on, F.when(along, 2).otherwise(1)).otherwise(0)).alias("_on"),
    )
    keep = F.when(F.col("_on") > 0, F.lit(keep_shared) & (F.col("_on") == 2)).otherwise(F.col("_k") % 2 == 1)
    term = geo.shoelace_term(F.col("_sx"), F.col("_sy"), F.col("_ex"), F.col("_ey"))
    return judged.filter(keep).select("id_a", "id_b", term.alias("_term"))


def overlap_areas(a: DataFrame, b: DataFrame, a_id: str, b_id: str) -> DataFrame:
    """(id_a, id_b, area) of every pair of overlapping polygons, by the boundary of the overlap.

    Edges are cut where the other ring meets them; pieces inside the other polygon bound the overlap.
    A stretch both rings share counts once, and only where they run the same way.
    """
    edge_pairs = _edge_pairs(a, b, a_id, b_id)
    edge = lambda tag: [f"id_{tag}", f"no_{tag}", *[f"{c}_{tag}" for c in EDGE]]
    near_a = box_pairs(_edge_boxes(a, a_id, "a"), boxes(b, b_id).withColumnRenamed(b_id, "id_b"), edge("a"), ["id_b"])
    near_b = box_pairs(_edge_boxes(b, b_id, "b"), boxes(a, a_id).withColumnRenamed(a_id, "id_a"), edge("b"), ["id_a"])
    terms = _kept_terms(near_a, _cut_points(edge_pairs, "a", "b"), "a", b, b_id, "b", True).unionByName(
        _kept_terms(near_b, _cut_points(edge_pairs, "b", "a"), "b", a, a_id, "a", False)
    )
    return terms.groupBy("id_a", "id_b").agg(F.abs(F.sum("_term")).alias("area"))


def polygon_coverage(a: DataFrame, b: DataFrame, a_id: str, b_id: str) -> DataFrame:
    """Per polygon of a: its area, the share covered by layer b, and the count of b within it, also per 100 km2.

    A polygon of b is within when all of its area is. Polygons of b that overlap each other count twice in the share.
    """
    overlaps = overlap_areas(a, b, a_id, b_id).filter(F.col("area") > 1e-6)
    whole = measures(b, b_id).select(F.col(b_id).alias("id_b"), F.col("area").alias("_whole"))
    overlaps = overlaps.join(whole, "id_b").withColumn("_within", F.col("area") >= F.col("_whole") * (1 - 1e-9) - 1e-6)
    covered = overlaps.groupBy("id_a").agg(F.sum("area").alias("_covered"), F.count(F.when(F.col("_within"), 1)).alias("n_b"))
    out = measures(a, a_id).select(a_id, "area").join(covered.withColumnRenamed("id_a", a_id), a_id, "left")
    return out.select(a_id, "area", F.try_divide(F.coalesce("_covered", F.lit(0.0)), F.col("area")).alias("covered_share"),
                      F.coalesce("n_b", F.lit(0)).alias("n_b"), F.try_divide(F.coalesce("n_b", F.lit(0)), F.col("area") / 1e8).alias("n_per_100km2"))


def _touching_by_edges(a: DataFrame, b: DataFrame, a_id: str, b_id: str) -> DataFrame:
    """``polygon_intersects`` edge by edge, for rings of any length."""
    e = _edge_pairs(a, b, a_id, b_id)
    meets = geo.segments_meet(*[F.col(f"{c}_a") for c in EDGE], *[F.col(f"{c}_b") for c in EDGE])
    crossing = e.filter(meets).select("id_a", "id_b")

    def corners(edges: DataFrame, id: str, tag: str) -> DataFrame:
        start = F.min(F.struct("edge_no", "ax", "ay")).alias("s")
        return edges.groupBy(F.col(id).alias(f"id_{tag}")).agg(start).select(f"id_{tag}", F.col("s.ax").alias("x"), F.col("s.ay").alias("y"))

    ca, cb = corners(a, a_id, "a"), corners(b, b_id, "b")
    a_in_b = ca.join(inside_pairs(ca, b, b_id).withColumnRenamed(b_id, "id_b"), ["x", "y"]).select("id_a", "id_b")
    b_in_a = cb.join(inside_pairs(cb, a, a_id).withColumnRenamed(a_id, "id_a"), ["x", "y"]).select("id_a", "id_b")
    return crossing.unionByName(a_in_b).unionByName(b_in_a).distinct()


def _short_rings(edges: DataFrame, id: str) -> tuple[DataFrame, DataFrame, int]:
    """Packed rings of at most ``EDGES_PER_BAND`` whole edges, the edges of all other polygons, and how many those are."""
    whole = F.count(F.when(reduce(and_, [F.col(c).isNotNull() for c in EDGE]), 1)).alias("_whole")
    boxed = boxes(edges, id).join(edges.groupBy(F.col(id).alias("_of")).agg(whole), F.col(id).eqNullSafe(F.col("_of"))).drop("_of")
    short = F.col(id).isNotNull() & (F.col("_bands") == 1) & (F.col("_whole") == F.col("_n"))
    mine, other = boxed.filter(short), boxed.filter(~short).select(F.col(id).alias("_of"))
    n = other.count()
    rest = edges.join(sized(other, n), F.col(id).eqNullSafe(F.col("_of")), "left_semi")
    return blocks.packed(edges, mine, id).withColumnRenamed(id, "_id"), rest, n


def polygon_intersects(a: DataFrame, b: DataFrame, a_id: str, b_id: str, ascending: bool = False) -> DataFrame:
    """Distinct (id_a, id_b) that touch: an edge of each meets, or one holds a corner of the other.

    ``ascending`` gives only pairs with id_a below id_b, for a layer met with itself. Short rings are met as arrays, once
    a pair; polygons with more edges, without an id or with missing corners go edge by edge.
    """
    types = dict(a.dtypes)[a_id], dict(b.dtypes)[b_id]
    rings_a, rest_a, more_a = _short_rings(a, a_id)
    rings_b, rest_b, more_b = (rings_a, rest_a, more_a) if a is b and a_id == b_id else _short_rings(b, b_id)
    found = [blocks.touching(rings_a, rings_b, types, ascending)]
    if more_a:
        found.append(_touching_by_edges(rest_a, b, a_id, b_id))
    if more_b:
        short_a = a.join(rings_a.select(F.col("_id").alias(a_id)), a_id, "left_semi") if more_a else a
        found.append(_touching_by_edges(short_a, rest_b, a_id, b_id))
    out = reduce(DataFrame.unionByName, found)
    return out.filter("id_a < id_b") if ascending and len(found) > 1 else out


def nearest_with_restrictions(points: DataFrame, edges: DataFrame, id: str, layers: Mapping[str, DataFrame]) -> DataFrame:
    """Nearest polygon per point, and for each restriction layer whether that polygon touches any of the layer's polygons.

    ``layers`` are directed edges with a ``part`` id and ``edge_no``. Flags are found once a polygon, not once a point.
    """
    out = nearest_polygon(points, edges, id)
    for name, layer in layers.items():
        hit = polygon_intersects(edges, layer, id, "part").select(F.col("id_a").alias(id), F.lit(1).alias(name)).distinct()
        out = out.join(hit, id, "left").withColumn(name, F.when(F.col(id).isNotNull(), F.coalesce(name, F.lit(0))))
    return out


def hex_grid(edges: DataFrame, id: str, size: float) -> DataFrame:
    """Cells of a pointy-top hexagon grid that meet the zones: cell id, q, r, centre x, y and the lowest zone id.

    Axial rows are spread as tasks over each zone's own box, so no list of cells is built on the driver.
    """
    w, h = size * math.sqrt(3), size * 1.5
    boxed = boxes(edges, id).select(id, "_minx", "_miny", "_maxx", "_maxy")
    rows = boxed.withColumn("r", F.explode(F.sequence(F.floor((F.col("_miny") - size) / h), F.ceil((F.col("_maxy") + size) / h))))
    shift = F.pmod(F.col("r"), F.lit(2)) * (w / 2)
    cells = rows.withColumn("q", F.explode(F.sequence(F.floor((F.col("_minx") - shift - w / 2) / w), F.ceil((F.col("_maxx") - shift + w / 2) / w))))
    cells = cells.select("q", "r").distinct().withColumns({
        "x": F.col("q") * w + F.pmod(F.col("r"), F.lit(2)) * (w / 2), "y": F.col("r") * h,
        "cell_id": F.concat_ws("_", F.lit("h"), F.col("q").cast("string"), F.col("r").cast("string")),
    })
    x, y = F.col("x"), F.col("y")
    ring = [(x, y + size), (x - w / 2, y + size / 2), (x - w / 2, y - size / 2), (x, y - size), (x + w / 2, y - size / 2), (x + w / 2, y + size / 2)]
    sides = [F.struct(F.lit(i).alias("edge_no"), *(c.alias(n) for n, c in zip(EDGE, (*p, *q), strict=True))) for i, (p, q) in enumerate(zip(ring, ring[1:] + ring[:1], strict=True))]
    outline = cells.select("cell_id", F.explode(F.array(*sides)).alias("e")).select("cell_id", "e.*")
    met = polygon_intersects(outline, edges, "cell_id", id).groupBy(F.col("id_a").alias("cell_id")).agg(F.min("id_b").alias(id))
    return cells.join(met, "cell_id")


def _dated_sums(points: DataFrame, edges: DataFrame, radii: Sequence[float], id: str, states: DataFrame, date: str, day: str,
                values: Sequence[str], clip: bool) -> DataFrame:
    """(x, y, date) with running totals at the date as ``value_on_site`` and ``value_r`` over polygons the place is in and
    within each radius, and with ``clip`` the first value times the clip as ``_clip_r``.

    A polygon's states go along with its ring as arrays, and dates are looked up where places and rings meet, so no row is
    formed for a place, date and polygon.
    """
    from sitegauge.operators.temporal import asof_values

    labels = ["on_site", *[str(int(r)) for r in radii]]
    names = [f"{v}_{n}" for v in values for n in labels]
    clips = [f"_clip_{n}" for n in labels[1:]] if clip else []
    rings, scales, lines = _rings_near(edges, id, max(radii))
    found = []
    if rings is not None:
        # A state without a day is older than all others.
        at = F.coalesce(F.datediff(day, F.lit(blocks.EPOCH)), F.lit(-(1 << 31)))
        rows = F.array_sort(F.collect_list(F.struct(at.cast("long").alias("_at"), *[F.coalesce(F.col(v), F.lit(0)).cast("long").alias(v) for v in values])))
        held = states.filter(F.col(id).isNotNull()).groupBy(id).agg(rows.alias("_s"))
        held = held.select(id, *[F.col(f"_s.{c}").alias(c) for c in ("_at", *values)])
        held = held.select(id, blocks.differences(F.col("_at")).alias("_state_days"), F.concat(*[blocks.differences(F.col(v)) for v in values]).alias("_state_values"))
        found.append(blocks.dated_sums_near(points, date, rings, held, id, scales, radii, len(values), clip).toDF("x", "y", date, *names, *clips))
    if lines is not None:
        dated = points.select("x", "y", date).distinct().join(polygons_within(points, lines, max(radii), id), ["x", "y"])
        probes = cut_lineage(dated.withColumnRenamed(date, day))
        met = probes.join(asof_values(probes, states, [id], day, values), [id, day])
        if clip:
            met = met.join(clip_pairs(met.select("x", "y", id).distinct(), lines, radii, id), ["x", "y", id])
        near = {"on_site": F.col("distance") == 0, **{str(int(r)): F.col("distance") <= float(r) for r in radii}}
        sums = [F.when(near[n], F.col(v)).alias(f"{v}_{n}") for v in values for n in labels]
        sums += [F.when(near[n], F.col(f"clip_{n}") * F.col(values[0])).alias(f"_clip_{n}") for n in labels[1:]] if clip else []
        found.append(met.withColumnRenamed(day, date).select("x", "y", date, *sums))
    if not found:
        none = points.select("x", "y", date).limit(0)
        return none.withColumns({**{n: F.lit(0).cast("long") for n in names}, **{n: F.lit(0.0) for n in clips}})
    both = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    return both.groupBy("x", "y", date).agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in [*names, *clips]])


def active_polygons(points: DataFrame, edges: DataFrame, radii: Sequence[float], id: str, states: DataFrame,
                    date: str, day: str, values: Sequence[str]) -> DataFrame:
    """What dated agreements held on polygons near a site were active on the site's own date.

    ``states`` has running totals, whole numbers, per (id, day) of change; sums per site, on the site itself and
    within each radius, weight each polygon's running totals at the site's date.
    """
    sums = _dated_sums(points, edges, radii, id, states, date, day, values, False)
    totals = sums.select("x", "y", date, *[f"{v}_{n}" for n in ["on_site", *[str(int(r)) for r in radii]] for v in values])
    out = points.join(totals, ["x", "y", date], "left")
    return out.na.fill(0, [c for c in totals.columns if c not in ("x", "y", date)])


def active_agreements(points: DataFrame, edges: DataFrame, radii: Sequence[float], id: str, agreements: DataFrame, *, date: str,
                      start: str, end: str, value: str, tier: str, tiers: Sequence[str]) -> DataFrame:
    """Agreements active on a site's own date: on the site itself and within each radius.

    On site: flag, total value and the highest tier (``tiers`` lists them from the lowest; none: null). Per radius:
    count, clipped area, its density over the disc, mean value and counts per tier. Several agreements on one
    polygon count each. Each polygon's agreements are first swept into running totals by day; each polygon is clipped
    once a place, however many agreements and dates meet it.
    ``value`` is a whole number (pence), so sums don't depend on their order; null counts as 0 in the mean. A null
    date, or no active agreement near, gives 0 and null.
    """
    from sitegauge.operators.temporal import active_states

    one = F.lit(1).cast("long")
    measures_ = {"_n": one, "_value": F.coalesce(F.col(value), F.lit(0)).cast("long"), **{f"_tier_{t}": F.coalesce((F.col(tier) == t).cast("long"), F.lit(0)) for t in tiers}}
    spans = agreements.where(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(start) < F.col(end)))
    states = active_states(spans, [id], start, end, "_day", measures_)
    sums = _dated_sums(points, edges, radii, id, states, date, "_day", list(measures_), True)
    highest = F.greatest(*[F.when(F.col(f"_tier_{t}_on_site") > 0, k) for k, t in enumerate(tiers)], F.lit(None).cast("int"))
    outs = [(F.col("_n_on_site") > 0).cast("int").alias("on_site"), F.col("_value_on_site").alias("value_on_site"), highest.alias("_highest")]
    for r in radii:
        n = str(int(r))
        clip = F.col(f"_clip_{n}")
        outs += [
            F.col(f"_n_{n}").alias(f"count_{n}"), clip.alias(f"area_{n}"), (clip / geo.disc_area(float(r))).alias(f"density_{n}"),
            F.try_divide(F.col(f"_value_{n}"), F.col(f"_n_{n}")).alias(f"mean_value_{n}"), *[F.col(f"_tier_{t}_{n}").alias(f"count_{n}_{t}") for t in tiers],
        ]
    totals = sums.select("x", "y", date, *outs)
    names = F.array(*[F.lit(t) for t in tiers])
    totals = totals.withColumn("highest_tier", F.get(names, F.col("_highest"))).drop("_highest")
    out = points.join(totals, ["x", "y", date], "left")
    return out.na.fill(0, [c for c in totals.columns if c not in ("x", "y", date, "highest_tier") and not c.startswith("mean_value")])
