"""Queries over spatial joins (JN-5..18, 22..25, 28, 29, 31)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitegauge.functions import geometry as geo
from sitegauge.operators import corridors as co
from sitegauge.operators import lines as ln
from sitegauge.operators import nearest as nr
from sitegauge.operators import polygons as pg
from sitegauge.operators import radius as rd
from sitegauge.operators import temporal as tm
from sitegauge.plans.bindings import num, rnd, rounded, sql_crosses, sql_distance, sql_meeting, sql_segment_distance, sql_turn, with_ctes
from sitegauge.plans.registry import query
from sitegauge.session import cut_lineage

VOLTAGES = ("11kv", "33kv", "66kv", "132kv")
WIDTHS = {"11kv": 5.0, "33kv": 20.0, "66kv": 25.0, "132kv": 30.0}


@query(
    "jn08_knn_headroom",
    f"""{with_ctes('sites', 'subs')}, r AS (SELECT site_id, sub_id, headroom, {sql_distance('s', 'b')} AS d, row_number() OVER (PARTITION BY site_id ORDER BY {sql_distance('s', 'b')}, sub_id) AS rn FROM sites s, subs b)
SELECT site_id, min(sub_id) FILTER (rn=1) AS nearest_sub, {rnd('min(d)')} AS nearest_m, min(headroom) FILTER (rn=1) AS nearest_headroom, {rnd('avg(headroom)', 3)} AS headroom_mean,
 {rnd('stddev_samp(headroom)', 3)} AS headroom_std, min(headroom) AS headroom_min, max(headroom) AS headroom_max, count(*) AS headroom_n FROM r WHERE rn<=5 GROUP BY site_id""",
)
def _(t):
    near = nr.knn(t.places.select("site_id", "x", "y"), t.substations, 5, id="sub_id", attrs=["headroom"])
    first = F.col("rank") == 1
    out = near.groupBy("site_id").agg(
        F.max(F.when(first, F.col("sub_id"))).alias("nearest_sub"), F.min("distance").alias("nearest_m"),
        F.max(F.when(first, F.col("headroom"))).alias("nearest_headroom"), F.avg("headroom").alias("headroom_mean"),
        F.stddev_samp("headroom").alias("headroom_std"), F.min("headroom").alias("headroom_min"),
        F.max("headroom").alias("headroom_max"), F.count("headroom").alias("headroom_n"),
    )
    return rounded(out, {"nearest_m": 4, "headroom_mean": 3, "headroom_std": 3})


def _knn_sql(k: int) -> str:
    return f"""{with_ctes('sites', 'assets')}, c AS (SELECT site_id, asset_id, rating, {sql_distance('s', 'a')} AS d FROM sites s, assets a),
r AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY d, asset_id) AS rn FROM c QUALIFY rn<={k})"""


@query(
    "ag13_knn_cohort_stats",
    f"""{_knn_sql(10)} SELECT site_id, {rnd('avg(rating)', 3)} AS rating_mean, {rnd('stddev_pop(rating)', 3)} AS rating_std_pop, {rnd('stddev_samp(rating)', 3)} AS rating_std, min(rating) AS rating_min,
 max(rating) AS rating_max, {rnd('var_pop(rating)', 2)} AS rating_var, count(rating) AS rating_n, CAST(sum((rating>1000)::INT) AS BIGINT) AS rating_n_over, {rnd('avg((rating>1000)::INT)', 6)} AS rating_share_over FROM r GROUP BY site_id""",
)
def _(t):
    near = nr.knn(t.places.select("site_id", "x", "y"), t.assets, 10, id="asset_id", attrs=["rating"])
    out = nr.cohort_stats(near, ["site_id"], "rating", "rating", threshold=1000)
    return rounded(out, {"rating_mean": 3, "rating_std_pop": 3, "rating_std": 3, "rating_var": 2, "rating_share_over": 6})


@query(
    "ag14_idw",
    f"""{_knn_sql(5)} SELECT site_id, {rnd('sum(rating/pow(greatest(d,1e-6),2))/sum(1/pow(greatest(d,1e-6),2))', 3)} AS idw2, {rnd('sum(rating/greatest(d,1e-6))/sum(1/greatest(d,1e-6))', 3)} AS idw1 FROM r GROUP BY site_id""",
)
def _(t):
    near = nr.knn(t.places.select("site_id", "x", "y"), t.assets, 5, id="asset_id", attrs=["rating"])
    out = near.groupBy("site_id").agg(
        nr.inverse_distance(F.col("rating"), F.col("distance")).alias("idw2"),
        nr.inverse_distance(F.col("rating"), F.col("distance"), power=1).alias("idw1"),
    )
    return rounded(out, {"idw2": 3, "idw1": 3})


@query(
    "jn06_nearest_point",
    f"""{with_ctes('sites', 'assets')}, c AS (SELECT site_id, min({{'d': {sql_distance('s', 'a')}, 'id': asset_id}}) AS m FROM sites s, assets a GROUP BY site_id)
SELECT site_id, m.id AS asset_id, {rnd('m.d')} AS distance FROM c""",
)
def _(t):
    out = nr.nearest(t.places.select("site_id", "x", "y"), t.assets, id="asset_id")
    return rounded(out.select("site_id", "asset_id", "distance"), ["distance"])


@query(
    "jn06_nearest_line",
    f"""{with_ctes('sites', 'segs')}, c AS (SELECT site_id, line_id, {sql_segment_distance('s.x', 's.y', 'g')} AS d FROM sites s, segs g QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY d, line_id)=1)
SELECT site_id, line_id, {rnd('d')} AS distance FROM c""",
)
def _(t):
    out = nr.nearest(t.places.select("site_id", "x", "y"), t.segments, id="line_id", ends=ln.ENDS)
    return rounded(out.select("site_id", "line_id", "distance"), ["distance"])


_PIP = f"""hit AS (SELECT s.site_id, e.zone_id, sum({sql_crosses('s.x', 's.y', 'e')})%2 AS odd FROM sites s JOIN shapes h ON s.x BETWEEN h.cx-h.w AND h.cx+h.w AND s.y BETWEEN h.cy-h.w AND h.cy+h.w
 JOIN edges e ON e.zone_id=h.zone_id GROUP BY 1,2 HAVING sum({sql_crosses('s.x', 's.y', 'e')})%2=1)"""


@query("jn05_point_in_polygon", f"{with_ctes('sites', 'edges')}, {_PIP} SELECT site_id, zone_id FROM hit")
def _(t):
    return pg.point_in_polygon(t.places.select("site_id", "x", "y"), t.zone_edges, "zone_id", how="inner").select("site_id", "zone_id")


@query(
    "jn05_authority_of_site",
    f"{with_ctes('sites')} SELECT site_id, CAST(floor(x/20000)+5*floor(y/20000) AS INTEGER) AS authority FROM sites",
)
def _(t):
    sites = t.places.select("site_id", "x", "y")
    out = pg.point_in_polygon(sites, t.authority_edges.withColumnRenamed("lpa", "authority"), "authority")
    return out.select("site_id", "authority")


_EDGE_D = f"near AS (SELECT s.site_id, e.zone_id, min({sql_segment_distance('s.x', 's.y', 'e')}) AS d FROM sites s, edges e GROUP BY 1,2)"
_POLY_D = f"{_PIP}, {_EDGE_D}, dist AS (SELECT n.site_id, n.zone_id, CASE WHEN h.zone_id IS NOT NULL THEN 0e0 ELSE n.d END AS d, h.zone_id IS NOT NULL AS inside FROM near n LEFT JOIN hit h ON h.site_id=n.site_id AND h.zone_id=n.zone_id)"


@query(
    "jn06_nearest_polygon",
    f"""{with_ctes('sites', 'edges')}, {_POLY_D}, b AS (SELECT site_id, min({{'d': d, 'id': zone_id}}) AS m, bool_or(inside) AS i FROM dist GROUP BY 1)
SELECT site_id, m.id AS zone_id, {rnd('m.d', 3)} AS distance, CASE WHEN i THEN 1 ELSE 0 END AS inside FROM b""",
)
def _(t):
    out = pg.nearest_polygon(t.places.select("site_id", "x", "y"), t.zone_edges, "zone_id")
    return rounded(out.select("site_id", "zone_id", "distance", "inside"), ["distance"], 3)


@query(
    "jn15_within_else_nearest",
    f"""{with_ctes('sites', 'edges')}, {_POLY_D}, b AS (SELECT site_id, min({{'d': d, 'id': zone_id}}) AS m, bool_or(inside) AS i FROM dist GROUP BY 1) SELECT site_id, m.id AS zone_id, {rnd('m.d', 3)} AS distance, CASE WHEN i THEN 'within' ELSE 'nearest' END AS method FROM b""",
)
def _(t):
    out = pg.within_else_nearest(t.places.select("site_id", "x", "y"), t.zone_edges, "zone_id")
    return rounded(out.select("site_id", "zone_id", "distance", "method"), ["distance"], 3)


@query(
    "jn07_nearest_per_class",
    f"{with_ctes('sites', 'assets')} SELECT site_id, " + ", ".join(f"{rnd(f'min({sql_distance(chr(115), chr(97))}) FILTER (voltage={chr(39)}{v}{chr(39)})')} AS \"{v}_m\"" for v in VOLTAGES)
    + " FROM sites s, assets a GROUP BY site_id",
)
def _(t):
    out = nr.nearest_per_class(t.places.select("site_id", "x", "y"), t.assets, VOLTAGES, "site_id", class_col="voltage", id="asset_id")
    return rounded(out.drop("x", "y"), [f"{v}_m" for v in VOLTAGES])


RADII = (2000, 5000, 10000)


@query(
    "jn09_within_radius",
    f"{with_ctes('sites', 'assets')}, c AS (SELECT site_id, rating, {sql_distance('s', 'a')} AS d FROM sites s JOIN assets a ON abs(s.x-a.x)<=10000 AND abs(s.y-a.y)<=10000) SELECT s.site_id, "
    + ", ".join(f"coalesce(n_{r},0) AS n_{r}, coalesce(mw_{r},0) AS mw_{r}" for r in RADII)
    + " FROM sites s LEFT JOIN (SELECT site_id, " + ", ".join(f"count(*) FILTER (d<={r}) AS n_{r}, {rnd(f'sum(rating) FILTER (d<={r})', 2)} AS mw_{r}" for r in RADII)
    + " FROM c GROUP BY 1) g ON g.site_id=s.site_id",
)
def _(t):
    out = rd.sums_within(t.places.select("site_id", "x", "y"), t.assets, RADII, {"n": F.lit(1), "mw": F.col("rating")})
    return rounded(out.drop("x", "y"), [f"mw_{r}" for r in RADII], 2)


@query(
    "jn10_features_within_radius",
    f"""{with_ctes('sites', 'edges')}, {_POLY_D}, area AS (SELECT zone_id, w*w*3 AS area FROM shapes), z AS (SELECT site_id, d, area FROM dist JOIN area USING (zone_id))
SELECT site_id, count(*) FILTER (d<=1000) AS count_1000, {rnd('coalesce(sum(area) FILTER (d<=1000),0)', 2)} AS area_1000, count(*) FILTER (d<=5000) AS count_5000, {rnd('coalesce(sum(area) FILTER (d<=5000),0)', 2)} AS area_5000 FROM z GROUP BY 1""",
)
def _(t):
    areas = pg.measures(t.zone_edges, "zone_id")
    out = pg.counts_within(t.places.select("site_id", "x", "y"), t.zone_edges, [1000, 5000], "zone_id", areas)
    return rounded(out.drop("x", "y"), ["area_1000", "area_5000"], 2)


@query(
    "jn10_counts_per_subtype",
    f"""{with_ctes('sites', 'edges')}, {_POLY_D}, z AS (SELECT site_id, d, w*w*3 AS area, zone_class FROM dist JOIN shapes USING (zone_id))
SELECT site_id, {', '.join(f"count(*) FILTER (d<={r} AND zone_class={k}) AS count_{r}_{k}, {rnd(f'coalesce(sum(area) FILTER (d<={r} AND zone_class={k}),0)', 2)} AS area_{r}_{k}" for r in (1000, 5000) for k in range(4))} FROM z GROUP BY 1""",
)
def _(t):
    areas = t.zone_shapes.select("zone_id", "zone_class").join(pg.measures(t.zone_edges, "zone_id"), "zone_id")
    out = pg.counts_within(t.places.select("site_id", "x", "y"), t.zone_edges, [1000, 5000], "zone_id", areas, "zone_class", range(4))
    out = out.drop("x", "y", *[f"{c}_{r}" for c in ("count", "area") for r in (1000, 5000)])
    return rounded(out, [c for c in out.columns if c.startswith("area")], 2)


def _clip_sql(r: float) -> str:
    """Disc-and-edge area by the chord parameters, for edges moved to the disc's centre."""
    return f"""m{r} AS (SELECT *, bx-ax AS ux, b_y-ay AS uy, (bx-ax)*(bx-ax)+(b_y-ay)*(b_y-ay) AS qa, ax*(bx-ax)+ay*(b_y-ay) AS qb, ax*ax+ay*ay-{r}e0*{r}e0 AS qc FROM local),
k{r} AS (SELECT *, qb*qb-qa*qc AS disc, greatest(0e0,least(1e0,(-qb-sqrt(greatest(qb*qb-qa*qc,0e0)))/qa)) AS t1, greatest(0e0,least(1e0,(-qb+sqrt(greatest(qb*qb-qa*qc,0e0)))/qa)) AS t2 FROM m{r}),
p{r} AS (SELECT *, ax+t1*ux AS sx, ay+t1*uy AS sy, ax+t2*ux AS ex, ay+t2*uy AS ey FROM k{r}),
a{r} AS (SELECT site_id, zone_id, zone_class, abs(sum(CASE WHEN disc>0 AND t2>t1 THEN {r}e0*{r}e0/2*atan2(ax*sy-ay*sx, ax*sx+ay*sy)*(t1>0)::INT+(sx*ey-sy*ex)/2+{r}e0*{r}e0/2*atan2(ex*b_y-ey*bx, ex*bx+ey*b_y)*(t2<1)::INT
 ELSE {r}e0*{r}e0/2*atan2(ax*b_y-ay*bx, ax*bx+ay*b_y) END)) AS clip FROM p{r} GROUP BY 1,2,3)"""


_LOCAL = f"""{_POLY_D}, local AS (SELECT s.site_id, e.zone_id, e.zone_class, e.ax-s.x AS ax, e.ay-s.y AS ay, e.bx-s.x AS bx, e."by"-s.y AS b_y FROM dist d JOIN sites s ON s.site_id=d.site_id JOIN edges e ON e.zone_id=d.zone_id WHERE d.d<=5000)"""


@query(
    "jn11_clipped_area_in_radius",
    f"""{with_ctes('sites', 'edges')}, {_LOCAL}, {_clip_sql(5000)} SELECT s.site_id, coalesce(area_5000,0) AS area_5000, coalesce(count_5000,0) AS count_5000, coalesce(share_5000,0) AS share_5000, {', '.join(f'coalesce(area_5000_{k},0) AS area_5000_{k}' for k in range(4))}
FROM sites s LEFT JOIN (SELECT site_id, {rnd('sum(clip)', 0)} AS area_5000, count(*) FILTER (clip>0) AS count_5000, {rnd('sum(clip)/(pi()*5000*5000)', 6)} AS share_5000, {', '.join(f"{rnd(f'sum(CASE WHEN zone_class={k} THEN clip ELSE 0 END)', 0)} AS area_5000_{k}" for k in range(4))} FROM a5000 GROUP BY 1) c ON c.site_id=s.site_id""",
)
def _(t):
    out = pg.clipped_area_by_class(t.places.select("site_id", "x", "y"), t.zone_edges, [5000], "zone_id", "zone_class", range(4))
    return rounded(out.drop("x", "y"), {"area_5000": 0, "share_5000": 6, **{f"area_5000_{k}": 0 for k in range(4)}})


@query(
    "jn18_area_weighted_mean",
    f"""{with_ctes('sites', 'edges')}, {_LOCAL}, {_clip_sql(5000)}, w AS (SELECT site_id, sum(value*clip)/nullif(sum(clip),0) AS v FROM a5000 JOIN shapes USING (zone_id) GROUP BY 1)
SELECT s.site_id, {rnd('v', 2)} AS value_weighted FROM sites s LEFT JOIN w ON w.site_id=s.site_id""",
)
def _(t):
    out = pg.area_weighted_mean(t.places.select("site_id", "x", "y"), t.zone_edges, 5000, "zone_id", t.zone_shapes, ["value"])
    return rounded(out.select("site_id", "value_weighted"), ["value_weighted"], 2)


def _length_sql(r: float) -> str:
    return f"""c AS (SELECT s.site_id, g.line_id, g.voltage, g.ax-s.x AS px, g.ay-s.y AS py, g.bx-g.ax AS ux, g."by"-g.ay AS uy FROM sites s JOIN segs g ON abs((g.ax+g.bx)/2-s.x)<={r}+4000 AND abs((g.ay+g."by")/2-s.y)<={r}+4000),
q AS (SELECT *, ux*ux+uy*uy AS a, px*ux+py*uy AS b, px*px+py*py-{r}e0*{r}e0 AS c0 FROM c WHERE ux<>0 OR uy<>0),
l AS (SELECT *, CASE WHEN b*b-a*c0>0 THEN (greatest(0e0,least(1e0,(-b+sqrt(b*b-a*c0))/a))-greatest(0e0,least(1e0,(-b-sqrt(b*b-a*c0))/a)))*sqrt(a) ELSE 0 END AS len FROM q)"""


@query(
    "jn12_clipped_length_in_radius",
    f"""{with_ctes('sites', 'segs')}, {_length_sql(5000)}, t AS (SELECT site_id, sum(len) AS len FROM l GROUP BY 1)
SELECT s.site_id, {rnd('coalesce(len,0)', 2)} AS line_m_5000, {rnd('coalesce(len,0)/1000/(pi()*25)', 6)} AS density FROM sites s LEFT JOIN t ON t.site_id=s.site_id""",
)
def _(t):
    out = rd.length_within(t.places.select("site_id", "x", "y"), t.segments, [5000], name="line_m")
    out = out.withColumn("density", F.col("line_m_5000") / 1000 / (F.lit(25) * F.pi()))
    return rounded(out.drop("x", "y"), {"line_m_5000": 2, "density": 6})


@query(
    "ag19_distinct_by_site",
    f"""{with_ctes('sites', 'segs')}, d AS (SELECT s.site_id, count(DISTINCT g.asset_tag) AS n FROM sites s JOIN segs g ON abs((g.ax+g.bx)/2-s.x)<=6000 AND abs((g.ay+g."by")/2-s.y)<=6000 AND {sql_segment_distance('s.x', 's.y', 'g')}<=2000 GROUP BY 1)
SELECT s.site_id, coalesce(n,0) AS tags FROM sites s LEFT JOIN d ON d.site_id=s.site_id""",
)
def _(t):
    sites = t.places.select("site_id", "x", "y")
    near = rd.pairs_within(sites, t.segments, 2000, keep=["asset_tag"], ends=ln.ENDS, distinct=True)
    counts = near.groupBy("x", "y").agg(F.count_distinct("asset_tag").alias("tags"))
    return sites.join(counts, ["x", "y"], "left").na.fill(0, ["tags"]).select("site_id", "tags")


@query(
    "jn13_corridor",
    f"""{with_ctes('sites', 'segs')}, w AS (SELECT s.site_id, min(greatest({sql_segment_distance('s.x', 's.y', 'g')}-CASE g.voltage WHEN '11kv' THEN 5 WHEN '33kv' THEN 20 WHEN '66kv' THEN 25 ELSE 30 END, 0e0)) AS d FROM sites s, segs g GROUP BY 1)
SELECT site_id, {rnd('d', 3)} AS corridor_m, CASE WHEN d<=0 THEN 1 ELSE 0 END AS in_corridor FROM w""",
)
def _(t):
    out = ln.corridor(t.places.select("site_id", "x", "y"), t.segments, WIDTHS, "site_id", class_col="voltage", id="line_id")
    return rounded(out.select("site_id", "corridor_m", "in_corridor"), ["corridor_m"], 3)


_STRIPS = """lines AS (SELECT asset_id, CASE voltage WHEN '11kv' THEN 5e0 WHEN '33kv' THEN 20e0 WHEN '66kv' THEN 25e0 ELSE 30e0 END AS w, asset_id%2=1 AS up, x, y,
 floor(x/100)*100 AS x0, floor(y/100)*100 AS y0, ((asset_id*31)%40+1)*100 AS len FROM assets),
rects AS (SELECT site_id, floor(x/100)*100+50 AS cx, floor(y/100)*100+50 AS cy, 5e0+site_id%16 AS hx, 5e0+(site_id*7)%16 AS hy FROM sites),
runs AS (SELECT site_id, up, greatest(cx-hx, x-w) AS a, least(cx+hx, x+w) AS b FROM rects JOIN lines ON up AND x+w>cx-hx AND x-w<cx+hx AND y0<cy AND y0+len>cy
 UNION ALL SELECT site_id, up, greatest(cy-hy, y-w), least(cy+hy, y+w) FROM rects JOIN lines ON NOT up AND y+w>cy-hy AND y-w<cy+hy AND x0<cx AND x0+len>cx),
joined AS (SELECT site_id, up, b-greatest(a, coalesce(max(b) OVER (PARTITION BY site_id, up ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a)) AS gain FROM runs),
bands AS (SELECT site_id, coalesce(sum(greatest(0, gain)) FILTER (up), 0) AS across, coalesce(sum(greatest(0, gain)) FILTER (NOT up), 0) AS along FROM joined GROUP BY 1)"""


@query(
    "jn13_sterilised_area",
    f"""{with_ctes('sites', 'assets')}, {_STRIPS} SELECT r.site_id, {rnd('4*hx*hy', 3)} AS area, {rnd('4*hx*hy-(2*hx-coalesce(across,0))*(2*hy-coalesce(along,0))', 3)} AS sterilised_m2,
 {rnd('1-(1-coalesce(across,0)/(2*hx))*(1-coalesce(along,0)/(2*hy))', 6)} AS sterilised_share FROM rects r LEFT JOIN bands b ON b.site_id=r.site_id""",
)
def _(t):
    """Rectangles of site land in the middle of 100 m tiles; lines run along one axis and end on tile borders, out of reach."""
    from sitegauge.plans.bindings import explode_ring

    tile = lambda c: F.floor(F.col(c) / 100) * 100.0
    rects = t.places.select("site_id", (tile("x") + 50).alias("cx"), (tile("y") + 50).alias("cy"), (5.0 + F.col("site_id") % 16).alias("hx"), (5.0 + (F.col("site_id") * 7) % 16).alias("hy"))
    cx, cy, hx, hy = (F.col(c) for c in ("cx", "cy", "hx", "hy"))
    land = explode_ring(rects, [(cx - hx, cy - hy), (cx + hx, cy - hy), (cx + hx, cy + hy), (cx - hx, cy + hy)], ["site_id"])
    up, length = F.col("asset_id") % 2 == 1, ((F.col("asset_id") * 31) % 40 + 1) * 100.0
    axis = t.assets.select(
        "voltage", F.when(up, F.col("x")).otherwise(tile("x")).alias("ax"), F.when(up, tile("y")).otherwise(F.col("y")).alias("ay"),
        F.when(up, F.col("x")).otherwise(tile("x") + length).alias("bx"), F.when(up, tile("y") + length).otherwise(F.col("y")).alias("by"))
    out = co.sterilised_area(land, axis, WIDTHS, "site_id", class_col="voltage")
    return rounded(out, {"area": 3, "sterilised_m2": 3, "sterilised_share": 6})


_P, _Q, _A, _B = ("px", "py"), ("qx", "qy"), ("ax", "ay"), ("bx", '"by"')
_MEET = f"{sql_turn(_P, _Q, _A)}*{sql_turn(_P, _Q, _B)}<=0 AND {sql_turn(_A, _B, _P)}*{sql_turn(_A, _B, _Q)}<=0"


@query(
    "jn14_connection_path_crossings",
    f"""{with_ctes('sites', 'subs', 'segs')}, n AS (SELECT site_id, s.x AS px, s.y AS py, sub_id, b.x AS qx, b.y AS qy, {sql_distance('s', 'b')} AS d FROM sites s, subs b QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY {sql_distance('s', 'b')}, sub_id)=1),
m AS (SELECT site_id, voltage FROM n JOIN segs g ON greatest(ax,bx)>=least(px,qx) AND least(ax,bx)<=greatest(px,qx) AND greatest(ay,"by")>=least(py,qy) AND least(ay,"by")<=greatest(py,qy) WHERE {_MEET})
SELECT n.site_id, any_value(sub_id) AS sub_id, {rnd('any_value(d)')} AS path_m, count(voltage) AS crossings, """ + ", ".join(f"count(*) FILTER (voltage='{v}') AS crossings_{v}" for v in VOLTAGES)
    + " FROM n LEFT JOIN m ON m.site_id=n.site_id GROUP BY n.site_id",
)
def _(t):
    out = ln.crossing_counts(t.places, t.substations, t.segments, "site_id", sub_id="sub_id", line_id="line_id", class_col="voltage", classes=VOLTAGES)
    return rounded(out, ["path_m"])


_PATHS = f"""n AS (SELECT site_id, s.x AS px, s.y AS py, sub_id, b.x AS qx, b.y AS qy, {sql_distance('s', 'b')} AS d FROM sites s, subs b QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY {sql_distance('s', 'b')}, sub_id)=1)"""


def _gap_sql() -> str:
    """Distance of path (px, py)-(qx, qy) and line g: 0 where they meet, else the least of the four ends'."""
    line = [sql_segment_distance(x, y, "g") for x, y in (_P, _Q)]
    path = [sql_segment_distance(x, y, "w") for x, y in (("g.ax", "g.ay"), ("g.bx", 'g."by"'))]
    return f"CASE WHEN greatest(g.ax,g.bx)>=least(px,qx) AND least(g.ax,g.bx)<=greatest(px,qx) AND greatest(g.ay,g.\"by\")>=least(py,qy) AND least(g.ay,g.\"by\")<=greatest(py,qy) AND {_MEET.replace('ax', 'g.ax').replace('ay', 'g.ay').replace('bx', 'g.bx').replace(chr(34) + 'by' + chr(34), 'g.' + chr(34) + 'by' + chr(34))} THEN 0e0 ELSE least({', '.join([*line, *path])}) END"


@query(
    "jn14_path_corridors",
    f"""{with_ctes('sites', 'subs', 'segs')}, {_PATHS}, w AS (SELECT site_id, px, py, qx, qy, px AS ax, py AS ay, qx AS bx, qy AS "by" FROM n),
m AS (SELECT site_id, voltage FROM w JOIN segs g ON greatest(g.ax,g.bx)+30>=least(px,qx) AND least(g.ax,g.bx)-30<=greatest(px,qx) AND greatest(g.ay,g."by")+30>=least(py,qy) AND least(g.ay,g."by")-30<=greatest(py,qy)
 WHERE {_gap_sql()}<=CASE voltage WHEN '11kv' THEN 5 WHEN '33kv' THEN 20 WHEN '66kv' THEN 25 ELSE 30 END)
SELECT n.site_id, count(voltage) AS corridors, """ + ", ".join(f"count(*) FILTER (voltage='{v}') AS corridors_{v}" for v in VOLTAGES) + " FROM n LEFT JOIN m ON m.site_id=n.site_id GROUP BY 1",
)
def _(t):
    paths = cut_lineage(ln.connection_paths(t.places, t.substations, "site_id", id="sub_id"))
    return ln.corridor_counts(paths, t.segments, WIDTHS, "site_id", class_col="voltage", id="line_id")


@query(
    "jn14_path_polygons",
    f"""{with_ctes('sites', 'subs', 'edges')}, {_PATHS}, h AS (SELECT site_id, zone_id, zone_class, d, (bx-ax)*(py-ay)-("by"-ay)*(px-ax) AS c0, (bx-ax)*(qy-py)-("by"-ay)*(qx-px) AS c1 FROM n, edges),
k AS (SELECT site_id, zone_id, zone_class, any_value(d) AS d, least(1e0, min(-c0/c1) FILTER (c1<0)) AS t1, greatest(0e0, max(-c0/c1) FILTER (c1>0)) AS t0, bool_or(c1=0 AND c0<0) AS out_ FROM h GROUP BY 1,2,3),
m AS (SELECT site_id, zone_class, coalesce(t1,1)-coalesce(t0,0) AS share, d FROM k WHERE NOT out_ AND coalesce(t1,1)-coalesce(t0,0)>1e-9)
SELECT n.site_id, count(m.share) AS polygons, {rnd('coalesce(sum(m.share*m.d),0)', 3)} AS inside_m, """
    + ", ".join(f"count(m.share) FILTER (zone_class={k}) AS polygons_{k}, {rnd(f'coalesce(sum(m.share*m.d) FILTER (zone_class={k}),0)', 3)} AS inside_m_{k}" for k in range(4))
    + " FROM n LEFT JOIN m ON m.site_id=n.site_id GROUP BY 1",
)
def _(t):
    paths = cut_lineage(ln.connection_paths(t.places, t.substations, "site_id", id="sub_id"))
    out = ln.crossed_polygons(paths, t.zone_edges, "site_id", id="zone_id", class_col="zone_class", classes=range(4))
    return rounded(out, [c for c in out.columns if c.startswith("inside")], 3)


@query(
    "jn16_polygon_coverage",
    """WITH z AS (SELECT CAST((s_suppkey*7919)%100000 AS DOUBLE) AS cx, CAST((s_suppkey*104729)%100000 AS DOUBLE) AS cy, CAST(1500+(s_suppkey*37)%4000 AS DOUBLE) AS w, s_suppkey AS zone_id FROM supplier),
a AS (SELECT n_nationkey AS lpa, CAST(n_nationkey%5*20000 AS DOUBLE) AS x0, floor(n_nationkey/5)*20000e0 AS y0 FROM nation),
o AS (SELECT lpa, zone_id, greatest(0,least(cx+w,x0+20000)-greatest(cx-w,x0))*greatest(0,least(cy+w,y0+20000)-greatest(cy-w,y0)) AS area,
 cx-w>=x0 AND cx+w<=x0+20000 AND cy-w>=y0 AND cy+w<=y0+20000 AS inside FROM a, z)
SELECT lpa, 4e8 AS area, """ + rnd("sum(area)/4e8", 6) + " AS covered_share, count(*) FILTER (inside) AS n_b, " + rnd("count(*) FILTER (inside)/4e0", 6) + " AS n_per_100km2 FROM o GROUP BY lpa",
)
def _(t):
    from sitegauge.plans.bindings import explode_ring

    shapes = t.zone_shapes.withColumn("w", (1500 + (F.col("zone_id") * 37) % 4000).cast("double"))
    cx, cy, w = F.col("cx"), F.col("cy"), F.col("w")
    squares = explode_ring(shapes, [(cx - w, cy - w), (cx + w, cy - w), (cx + w, cy + w), (cx - w, cy + w)], ["zone_id"])
    out = pg.polygon_coverage(t.authority_edges, squares, "lpa", "zone_id")
    return rounded(out, {"area": 2, "covered_share": 6, "n_per_100km2": 6})


@query(
    "jn17_polygon_intersects",
    f"""{with_ctes('edges')}, a AS (SELECT a.zone_id AS id_a, b.zone_id AS id_b FROM edges a JOIN edges b ON a.zone_id<b.zone_id AND greatest(a.ax,a.bx)>=least(b.ax,b.bx) AND least(a.ax,a.bx)<=greatest(b.ax,b.bx) AND greatest(a.ay,a."by")>=least(b.ay,b."by") AND least(a.ay,a."by")<=greatest(b.ay,b."by")
 WHERE """ + f"{sql_turn(('a.ax', 'a.ay'), ('a.bx', 'a.\"by\"'), ('b.ax', 'b.ay'))}*{sql_turn(('a.ax', 'a.ay'), ('a.bx', 'a.\"by\"'), ('b.bx', 'b.\"by\"'))}<=0 AND {sql_turn(('b.ax', 'b.ay'), ('b.bx', 'b.\"by\"'), ('a.ax', 'a.ay'))}*{sql_turn(('b.ax', 'b.ay'), ('b.bx', 'b.\"by\"'), ('a.bx', 'a.\"by\"'))}<=0"
    + f"""), v AS (SELECT p.zone_id AS pid, e.zone_id AS eid FROM edges p JOIN edges e ON p.zone_id<>e.zone_id WHERE p.edge_no=0 GROUP BY p.zone_id, p.ax, p.ay, e.zone_id HAVING sum({sql_crosses('p.ax', 'p.ay', 'e')})%2=1)
SELECT id_a, id_b FROM a UNION SELECT least(pid,eid), greatest(pid,eid) FROM v""",
)
def _(t):
    z = t.zone_edges
    return pg.polygon_intersects(z, z, "zone_id", "zone_id", ascending=True)


@query(
    "jn22_active_interval_join",
    f"""{with_ctes('sites', 'edges')}, {_POLY_D}, ag AS (SELECT l_suppkey AS zone_id, CAST(l_shipdate AS DATE) AS s, CAST(l_shipdate AS DATE)+90 AS e, CAST(round(l_extendedprice*100) AS BIGINT) AS v, l_returnflag AS tier FROM lineitem),
j AS (SELECT d.site_id, d.d, a.v, a.tier FROM dist d JOIN sites t ON t.site_id=d.site_id JOIN ag a ON a.zone_id=d.zone_id AND a.s<=t.submission_date AND a.e>t.submission_date WHERE d.d<=2000)
SELECT s.site_id, count(j.d) FILTER (d=0) AS active_on_site, count(j.d) FILTER (d<=2000) AS active_2000, CAST(coalesce(sum(v) FILTER (d=0),0) AS BIGINT) AS pence_on_site, CAST(coalesce(sum(v) FILTER (d<=2000),0) AS BIGINT) AS pence_2000,
 count(j.d) FILTER (d=0 AND tier='R') AS tier_r_on_site, count(j.d) FILTER (d<=2000 AND tier='R') AS tier_r_2000 FROM sites s LEFT JOIN j ON j.site_id=s.site_id GROUP BY s.site_id""",
)
def _(t):
    pence = F.round(F.col("value") * 100).cast("long")
    states = tm.active_states(t.agreements, ["zone_id"], "start_date", "end_date", "day", {
        "active": F.lit(1).cast("long"), "pence": pence, "tier_r": (F.col("tier") == "R").cast("long"),
    })
    out = pg.active_polygons(t.places.select("site_id", "x", "y", "submission_date"), t.zone_edges, [2000], "zone_id", states,
                             "submission_date", "day", ["active", "pence", "tier_r"])
    return out.drop("x", "y", "submission_date")


_LAYERS = "l{k} AS (SELECT zone_id AS part, edge_no, ax, ay, bx, \"by\" FROM edges WHERE zone_id%7={k})"


@query(
    "jn17_nearest_restrictions",
    f"""{with_ctes('sites', 'edges')}, access AS (SELECT * FROM edges WHERE zone_id%7 NOT IN (2,3)), {_LAYERS.format(k=2)}, {_LAYERS.format(k=3)},
hit AS (SELECT s.site_id, e.zone_id FROM sites s JOIN access e ON true GROUP BY 1,2,s.x,s.y HAVING sum({sql_crosses('s.x', 's.y', 'e')})%2=1),
near AS (SELECT s.site_id, e.zone_id, min({sql_segment_distance('s.x', 's.y', 'e')}) AS d FROM sites s, access e GROUP BY 1,2),
best AS (SELECT n.site_id, min({{'d': CASE WHEN h.zone_id IS NOT NULL THEN 0e0 ELSE d END, 'id': n.zone_id}}) AS m FROM near n LEFT JOIN hit h ON h.site_id=n.site_id AND h.zone_id=n.zone_id GROUP BY 1),
f2 AS (SELECT DISTINCT zone_id FROM ({sql_meeting('access', 'l2', 'true', 'p.zone_id, e.part')})), f3 AS (SELECT DISTINCT zone_id FROM ({sql_meeting('access', 'l3', 'true', 'p.zone_id, e.part')}))
SELECT site_id, m.id AS zone_id, {rnd('m.d', 3)} AS distance, (f2.zone_id IS NOT NULL)::INT AS restricted, (f3.zone_id IS NOT NULL)::INT AS reserved FROM best LEFT JOIN f2 ON f2.zone_id=m.id LEFT JOIN f3 ON f3.zone_id=m.id""",
)
def _(t):
    layer = lambda k: t.zone_edges.filter(F.col("zone_id") % 7 == k).withColumnRenamed("zone_id", "part")
    access = t.zone_edges.filter(~(F.col("zone_id") % 7).isin(2, 3))
    out = pg.nearest_with_restrictions(t.places.select("site_id", "x", "y"), access, "zone_id", {"restricted": layer(2), "reserved": layer(3)})
    return rounded(out.select("site_id", "zone_id", "distance", "restricted", "reserved"), ["distance"], 3)


@query(
    "jn22_agreements_clipped",
    f"""{with_ctes('sites', 'edges')}, {_LOCAL}, {_clip_sql(2000)}, {_clip_sql(5000)}, ag AS (SELECT l_suppkey AS zone_id, CAST(l_shipdate AS DATE) AS s, CAST(l_shipdate AS DATE)+90 AS e, CAST(round(l_extendedprice*100) AS BIGINT) AS v, l_returnflag AS tier FROM lineitem),
j AS (SELECT d.site_id, d.d, a.v, a.tier, c.clip AS clip_2000, b.clip AS clip_5000 FROM dist d JOIN sites t ON t.site_id=d.site_id JOIN ag a ON a.zone_id=d.zone_id AND a.s<=t.submission_date AND a.e>t.submission_date
 JOIN a2000 c ON c.site_id=d.site_id AND c.zone_id=d.zone_id JOIN a5000 b ON b.site_id=d.site_id AND b.zone_id=d.zone_id WHERE d.d<=5000)
SELECT s.site_id, coalesce(max((d=0)::INT),0) AS on_site, CAST(coalesce(sum(v) FILTER (d=0),0) AS BIGINT) AS value_on_site, max(tier) FILTER (d=0) AS highest_tier, """
    + ", ".join(f"count(j.d) FILTER (d<={r}) AS count_{r}, {rnd(f'coalesce(sum(clip_{r}) FILTER (d<={r}),0)', 0)} AS area_{r}, {rnd(f'coalesce(sum(clip_{r}) FILTER (d<={r}),0)/(pi()*{r}*{r})', 6)} AS density_{r}, {rnd(f'avg(v) FILTER (d<={r})', 3)} AS mean_value_{r}, "
                + ", ".join(f"count(j.d) FILTER (d<={r} AND tier='{k}') AS count_{r}_{k}" for k in "ANR") for r in (2000, 5000))
    + " FROM sites s LEFT JOIN j ON j.site_id=s.site_id GROUP BY s.site_id",
)
def _(t):
    pence = t.agreements.withColumn("value", F.round(F.col("value") * 100).cast("long"))
    out = pg.active_agreements(t.places.select("site_id", "x", "y", "submission_date"), t.zone_edges, [2000, 5000], "zone_id", pence,
                               date="submission_date", start="start_date", end="end_date", value="value", tier="tier", tiers=("A", "N", "R"))
    out = out.drop("x", "y", "submission_date")
    return rounded(out, {c: 0 if c.startswith("area") else 6 if c.startswith("density") else 3 for c in out.columns if c.startswith(("area", "density", "mean"))})


@query(
    "jn23_year_window_knn",
    f"""{with_ctes('sites', 'assets')}, c AS (SELECT site_id, rating, {sql_distance('s', 'a')} AS d, asset_id FROM sites s JOIN assets a ON a.publication_year BETWEEN year(s.submission_date) AND year(s.submission_date)+3),
r AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY d, asset_id)<=20) SELECT site_id, count(*) AS n, {rnd('avg(rating)', 3)} AS rating_mean, {rnd('max(d)')} AS furthest_m FROM r GROUP BY 1""",
)
def _(t):
    out = nr.knn_in_years(t.places, t.assets, 20, years=range(0, 4), date="submission_date", item_year="publication_year", site="site_id", id="asset_id", attrs=["rating"])
    out = out.groupBy("site_id").agg(F.count(F.lit(1)).alias("n"), F.avg("rating").alias("rating_mean"), F.max("distance").alias("furthest_m"))
    return rounded(out, {"rating_mean": 3, "furthest_m": 4})


@query(
    "jn23_count_among_nearest",
    f"""{with_ctes('sites', 'assets')}, r AS (SELECT site_id, submission_date, publication_year FROM sites s, assets a QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY {sql_distance('s', 'a')}, asset_id)<=50)
SELECT site_id, count(*) AS n, count(*) FILTER (publication_year>=year(submission_date) AND publication_year<year(submission_date)+5) AS n_in_years FROM r GROUP BY 1""",
)
def _(t):
    return nr.count_in_years(t.places, t.assets, 50, 5, date="submission_date", item_year="publication_year", site="site_id", id="asset_id")


@query(
    "jn24_knn_before",
    f"""{with_ctes('sites')}, d AS (SELECT a.site_id, b.granted, b.tech, b.site_id AS pid, {sql_distance('a', 'b')} AS d FROM sites a JOIN sites b ON b.submission_date+CAST(b.duration_days AS INTEGER)<a.submission_date),
g AS (SELECT site_id, count(*) AS n, arg_min({{'granted': granted, 'tech': tech, 'km': d/1000}}, d+pid*1e-10, 10) AS best FROM d GROUP BY 1), r AS (SELECT site_id, unnest(best) AS b FROM g WHERE n>=10),
st AS (SELECT site_id, avg(b.km) AS mean_km, stddev_pop(b.km) AS std_km, min(b.km) AS nearest_km, avg(b.granted) AS ar, sum(b.granted/(b.km+1e-6))/sum(1/(b.km+1e-6)) AS wa, count(*) FILTER (b.tech='1-URGENT') AS n_special,
 coalesce(min(b.km) FILTER (b.tech='1-URGENT'),999) AS sp, coalesce(min(b.km) FILTER (b.granted=0),999) AS rf FROM r GROUP BY 1)
SELECT s.site_id, {rnd('mean_km')} AS mean_km, {rnd('std_km')} AS std_km, {rnd('nearest_km')} AS nearest_km, {rnd('ar')} AS approval_rate, {rnd('wa')} AS weighted_approval, n_special,
 {rnd('sp')} AS nearest_special_km, {rnd('rf')} AS nearest_refused_km FROM sites s LEFT JOIN st ON st.site_id=s.site_id""",
)
def _(t):
    sites = t.sites.select("site_id", "x", "y", "submission_date", "granted", "tech", "duration_days")
    out = nr.precedents(sites, sites, site="site_id", k=10, submitted="submission_date", special=("tech", "1-URGENT"))
    return rounded(out, [c for c in out.columns if c.startswith(("mean_km", "std_km", "nearest", "approval", "weighted"))])


@query(
    "jn25_point_in_time_sum",
    f"""{with_ctes('sites', 'subs')}, m AS (SELECT l_suppkey AS sub_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS mth, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q FROM lineitem GROUP BY 1,2),
r AS (SELECT site_id, submission_date, sub_id, {sql_distance('s', 'b')} AS d, row_number() OVER (PARTITION BY site_id ORDER BY {sql_distance('s', 'b')}, sub_id) AS rn FROM sites s, subs b QUALIFY rn<=5),
v AS (SELECT r.site_id, r.rn, any_value(submission_date) AS sd, coalesce(sum(q),0) AS total, max(mth) AS latest FROM r LEFT JOIN m ON m.sub_id=r.sub_id AND m.mth<=r.submission_date GROUP BY 1,2)
SELECT site_id, CAST(max(total) FILTER (rn=1) AS BIGINT) AS nearest_total, {rnd('avg(total)')} AS total_mean, {rnd('stddev_pop(total)')} AS total_std, {rnd("max(date_diff('day', latest, sd)) FILTER (rn=1)/30.44e0")} AS age_months FROM v GROUP BY 1""",
)
def _(t):
    additions = t.read("lineitem").select(F.col("l_suppkey").alias("sub_id"), F.to_date(F.trunc("l_shipdate", "month")).alias("day"), F.col("l_quantity").cast("long").alias("total"))
    states = tm.cumulative_by_month(additions, "sub_id", "day", ["total"]).withColumn("latest", F.col("day"))
    near = nr.knn(t.places.select("site_id", "x", "y", F.col("submission_date").alias("day")), t.substations, 5, id="sub_id")
    known = tm.asof_values(near, states, ["sub_id"], "day", ["total", "latest"])
    met = near.join(known, ["sub_id", "day"], "left").withColumn("total", F.coalesce("total", F.lit(0)))
    first = F.col("rank") == 1
    out = met.groupBy("site_id").agg(
        F.max(F.when(first, F.col("total"))).alias("nearest_total"), F.avg("total").alias("total_mean"), F.stddev_pop("total").alias("total_std"),
        (F.max(F.when(first, F.datediff("day", "latest"))) / F.lit(30.44)).alias("age_months"),
    )
    return rounded(out, ["total_mean", "total_std", "age_months"])


@query(
    "jn28_structure_to_line_gap",
    f"""{with_ctes('sites', 'segs')}, sd AS (SELECT a.asset_id, a.x, a.y, min({sql_segment_distance('a.x', 'a.y', 'g')}) AS gap FROM assets a, segs g GROUP BY 1,2,3),
r AS (SELECT site_id, gap, {sql_distance('s', 'b')} AS d, asset_id FROM sites s, sd b QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY {sql_distance('s', 'b')}, asset_id)<=10)
SELECT site_id, {rnd('avg(gap)', 3)} AS mean_gap_m, count(*) AS structures FROM r GROUP BY 1""",
)
def _(t):
    out = ln.structure_line_gap(t.places, t.assets.select("asset_id", "x", "y"), t.segments, "site_id", structure_id="asset_id", line_id="line_id")
    return rounded(out, ["mean_gap_m"], 3)


_LL = "-6+x/100000*8 AS lon, 50+y/100000*8 AS lat"
_HAV = "2*6371*asin(least(1e0,sqrt(pow(sin((radians(b.lat)-radians(a.lat))/2),2)+cos(radians(a.lat))*cos(radians(b.lat))*pow(sin(radians(b.lon-a.lon)/2),2))))"


@query(
    "jn29_haversine_knn",
    f"""{with_ctes('sites', 'assets')}, a AS (SELECT site_id, {_LL}, CASE WHEN capacity_mw<10 THEN 0 WHEN capacity_mw<25 THEN 1 ELSE 2 END AS band FROM sites),
b AS (SELECT asset_id, {_LL}, rating, CASE WHEN asset_id%10=0 THEN 0 WHEN asset_id%997=1 THEN 1 ELSE 2 END AS band FROM assets), sz AS (SELECT band, count(*) AS n FROM b GROUP BY 1),
c AS (SELECT a.site_id, asset_id, rating, {_HAV} AS km FROM a LEFT JOIN sz ON sz.band=a.band JOIN b ON b.band=a.band OR coalesce(sz.n,0)<20),
r AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY km, asset_id)<=20) SELECT site_id, count(*) AS n, {rnd('avg(rating)', 2)} AS rating_mean, {rnd('max(km)', 3)} AS furthest_km FROM r GROUP BY 1""",
)
def _(t):
    def geographic(df):
        return df.withColumns({"lon": -6 + F.col("x") / 100000 * 8, "lat": 50 + F.col("y") / 100000 * 8})

    cap, key = F.col("capacity_mw"), F.col("asset_id")
    sites = geographic(t.places).select("site_id", "lon", "lat", F.when(cap < 10, 0).when(cap < 25, 1).otherwise(2).alias("band"))
    items = geographic(t.assets).select("asset_id", "lon", "lat", "rating", F.when(key % 10 == 0, 0).when(key % 997 == 1, 1).otherwise(2).alias("band"))
    near = nr.banded_haversine_knn(sites, items, 20, site="site_id", id="asset_id", band="band", attrs=["rating"])
    out = near.groupBy("site_id").agg(F.count(F.lit(1)).alias("n"), F.avg("rating").alias("rating_mean"), F.max("distance").alias("furthest_km"))
    return rounded(out, {"rating_mean": 2, "furthest_km": 3})


@query(
    "jn31_legacy_precedent",
    f"""{with_ctes('sites')}, old AS (SELECT * FROM sites WHERE year(submission_date)<1998), new AS (SELECT * FROM sites WHERE year(submission_date)>=1998),
c AS (SELECT n.site_id, o.granted, {sql_distance('n', 'o')} AS d FROM new n JOIN old o ON abs(n.x-o.x)<=10000 AND abs(n.y-o.y)<=10000), g AS (SELECT site_id, count(*) AS n, sum(granted) AS ok FROM c WHERE d<=10000 GROUP BY 1),
h AS (SELECT lpa, {rnd('avg(granted)', 6)} AS lpa_rate, count(*) AS lpa_n FROM old GROUP BY 1),
f AS (SELECT n.site_id, min({sql_distance('n', 'o')}) AS any_d, min({sql_distance('n', 'o')}) FILTER (o.granted=1) AS yes_d, min({sql_distance('n', 'o')}) FILTER (o.granted=0) AS no_d FROM new n, old o GROUP BY 1)
SELECT n.site_id, coalesce(g.n,0) AS n_10km, {rnd('g.ok*1e0/g.n', 6)} AS rate_10km, lpa_rate, lpa_n, {rnd('any_d/1000')} AS nearest_km, {rnd('yes_d/1000')} AS nearest_granted_km, {rnd('no_d/1000')} AS nearest_refused_km
FROM new n LEFT JOIN g ON g.site_id=n.site_id LEFT JOIN h ON h.lpa=n.lpa JOIN f ON f.site_id=n.site_id""",
)
def _(t):
    out = nr.legacy_precedent(t.sites.select("site_id", "lpa", "x", "y", "submission_date", "granted"), cutoff=1998, site="site_id")
    return rounded(out, {"rate_10km": 6, "lpa_rate": 6, "nearest_km": 4, "nearest_granted_km": 4, "nearest_refused_km": 4})


@query(
    "sc14_polygon_measures",
    f"{with_ctes('shapes')} SELECT zone_id, {rnd('w*w*3', 2)} AS area, {rnd('w*2+4*sqrt(w*w/4+w*w)', 3)} AS perimeter, {rnd('cx', 3)} AS centroid_x, {rnd('cy', 3)} AS centroid_y FROM shapes",
)
def _(t):
    return pg.measures(t.zone_edges, "zone_id").select("zone_id", num("area", 2), num("perimeter", 3), num("centroid_x", 3), num("centroid_y", 3))


@query(
    "sc13_ray_to_edge",
    f"""{with_ctes('edges')}, e AS (SELECT e.zone_id, cx AS x, cy AS y, sin(radians((e.zone_id*37)%360+0.5)) AS dx, cos(radians((e.zone_id*37)%360+0.5)) AS dy, ax, ay, bx, "by" AS b_y FROM edges e JOIN shapes s ON s.zone_id=e.zone_id),
r AS (SELECT zone_id, ((ax-x)*(b_y-ay)-(ay-y)*(bx-ax))/(dx*(b_y-ay)-dy*(bx-ax)) AS t, ((ax-x)*dy-(ay-y)*dx)/(dx*(b_y-ay)-dy*(bx-ax)) AS s FROM e)
SELECT zone_id, {rnd('min(t)')} AS exit_m FROM r WHERE t>=0 AND s BETWEEN 0 AND 1 GROUP BY 1""",
)
def _(t):
    """How far a ray from each zone's centre runs inside the zone."""
    e = t.zone_edges.join(t.zone_shapes.select("zone_id", "cx", "cy"), "zone_id")
    reach = geo.ray_segment_distance(F.col("cx"), F.col("cy"), (F.col("zone_id") * 37) % 360 + 0.5, *[F.col(c) for c in ln.ENDS])
    return rounded(e.groupBy("zone_id").agg(F.min(reach).alias("exit_m")), ["exit_m"])


@query(
    "prj16_repair_geometry",
    f"""{with_ctes('edges')} SELECT zone_id, count(*) AS edges FROM edges WHERE zone_id%5<>1 GROUP BY 1""",
)
def _(t):
    z = t.zone_edges
    broken = z.filter("NOT (zone_id % 5 = 1 AND edge_no = 2)")
    point = z.filter("zone_id % 3 = 0 AND edge_no = 0").select("zone_id", "zone_class", F.lit(9).alias("edge_no"), "ax", "ay", F.col("ax").alias("bx"), F.col("ay").alias("by"))
    return pg.repair_edges(broken.unionByName(point), "zone_id").groupBy("zone_id").agg(F.count(F.lit(1)).alias("edges"))


@query(
    "src06_read_bbox",
    f"{with_ctes('segs')} SELECT line_id FROM segs WHERE greatest(ax,bx)>=40000 AND least(ax,bx)<=60000 AND greatest(ay,\"by\")>=40000 AND least(ay,\"by\")<=60000",
)
def _(t):
    from sitegauge.sources.readers import read_bbox

    return read_bbox(t.segments, 50000, 50000, 10000).select("line_id")


_HEX = "1220e0*sqrt(3e0)"


@query(
    "ml23_hex_grid",
    f"""{with_ctes('edges')}, rows_ AS (SELECT zone_id, cx, w, unnest(range(CAST(floor((cy-w)/1830) AS BIGINT)-2, CAST((cy+w)/1830 AS BIGINT)+4)) AS r FROM shapes),
cells AS (SELECT zone_id, r, unnest(range(CAST(floor((cx-w)/({_HEX})) AS BIGINT)-3, CAST((cx+w)/({_HEX}) AS BIGINT)+4)) AS q FROM rows_),
placed AS (SELECT zone_id, q, r, q*{_HEX}+(abs(r)%2)*({_HEX}/2) AS x, r*1830e0 AS y FROM cells),
corner(edge_no, fx, fy) AS (VALUES (0,0e0,1e0),(1,-1e0,0.5e0),(2,-1e0,-0.5e0),(3,0e0,-1e0),(4,1e0,-0.5e0),(5,1e0,0.5e0)),
hexes AS (SELECT zone_id, q, r, x, y, a.edge_no, x+a.fx*{_HEX}/2 AS ax, y+a.fy*1220 AS ay, x+b.fx*{_HEX}/2 AS bx, y+b.fy*1220 AS "by" FROM placed, corner a JOIN corner b ON b.edge_no=(a.edge_no+1)%6)
SELECT 'h_'||q||'_'||r AS cell_id, q, r, {rnd('any_value(x)', 3)} AS x, {rnd('any_value(y)', 3)} AS y, min(zone_id) AS zone_id FROM ({sql_meeting('hexes', 'edges', 'p.zone_id=e.zone_id', 'p.zone_id, p.q, p.r, p.x, p.y')}) GROUP BY q, r""",
)
def _(t):
    return rounded(pg.hex_grid(t.zone_edges, "zone_id", 1220.0), ["x", "y"], 3)
