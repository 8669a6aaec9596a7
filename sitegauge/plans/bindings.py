"""The test tables read as sites, assets, zones and so on, in Spark and in SQL.

Coordinates come from keys by integer arithmetic, so both engines see the same numbers.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegauge.functions.scalar import fixed

# Reference forecast scenarios in MW.
CAPACITIES = (1, 2.5, 5, 7.5, 10, 12.5, 15, 20, 25, 30, 35, 40, 45, 50)


def _coordinate(key: str, factor: int) -> Column:
    return ((F.col(key) * factor) % 100000).cast("double")


class Tables:
    """Lazy readers over one scale folder; every frame selects only the columns it needs."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def sites(self) -> DataFrame:
        """One application per order."""
        orders = self.read("orders").select(
            F.col("o_orderkey").alias("site_id"), F.col("o_custkey").alias("c_custkey"),
            _coordinate("o_orderkey", 7919).alias("x"), _coordinate("o_orderkey", 104729).alias("y"),
            F.to_date("o_orderdate").alias("submission_date"),
            (F.col("o_totalprice") / 10000).alias("capacity_mw"),
            (20 + (F.col("o_orderkey") * 31) % 400).alias("duration_days"),
            (F.col("o_orderstatus") == "F").cast("int").alias("granted"),
            F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("tech"),
        )
        customers = self.read("customer").select("c_custkey", F.col("c_nationkey").alias("lpa"))
        return orders.join(customers, "c_custkey").drop("c_custkey")

    @cached_property
    def places(self) -> DataFrame:
        """Sites without their authority, so no join is paid for."""
        return self.read("orders").select(
            F.col("o_orderkey").alias("site_id"),
            _coordinate("o_orderkey", 7919).alias("x"), _coordinate("o_orderkey", 104729).alias("y"),
            F.to_date("o_orderdate").alias("submission_date"),
            (F.col("o_totalprice") / 10000).alias("capacity_mw"),
            (20 + (F.col("o_orderkey") * 31) % 400).alias("duration_days"),
            (F.col("o_orderstatus") == "F").cast("int").alias("granted"),
        )

    @cached_property
    def substations(self) -> DataFrame:
        return self.read("supplier").select(
            F.col("s_suppkey").alias("sub_id"), _coordinate("s_suppkey", 7919).alias("x"),
            _coordinate("s_suppkey", 104729).alias("y"), F.col("s_acctbal").alias("headroom"),
            F.col("s_nationkey").alias("zone_class"),
        )

    @cached_property
    def assets(self) -> DataFrame:
        size = F.col("p_size")
        return self.read("part").select(
            F.col("p_partkey").alias("asset_id"), ((F.col("p_partkey") * 7919 + 13) % 100000).cast("double").alias("x"),
            ((F.col("p_partkey") * 104729 + 7) % 100000).cast("double").alias("y"),
            F.when(size <= 12, "11kv").when(size <= 25, "33kv").when(size <= 38, "66kv").otherwise("132kv").alias("voltage"),
            F.col("p_type").alias("asset_tag"), F.col("p_retailprice").alias("rating"),
            (1995 + F.col("p_partkey") % 7).cast("int").alias("publication_year"),
        )

    @cached_property
    def segments(self) -> DataFrame:
        """One overhead-line span per asset, from its place to a key-derived offset."""
        a = self.assets
        return a.select(
            F.col("asset_id").alias("line_id"), "voltage", "asset_tag",
            F.col("x").alias("ax"), F.col("y").alias("ay"),
            (F.col("x") + (F.col("asset_id") * 31) % 8001 - 4000).alias("bx"),
            (F.col("y") + (F.col("asset_id") * 53) % 8001 - 4000).alias("by"),
        )

    @cached_property
    def zone_shapes(self) -> DataFrame:
        """Hexagonal protected areas around substations: centre, half-width and attributes."""
        return self.read("supplier").select(
            F.col("s_suppkey").alias("zone_id"), _coordinate("s_suppkey", 7919).alias("cx"),
            _coordinate("s_suppkey", 104729).alias("cy"),
            (2000 + (F.col("s_suppkey") * 37) % 8000).cast("double").alias("w"),
            (F.col("s_nationkey") % 4).alias("zone_class"), F.col("s_acctbal").alias("value"),
        )

    @cached_property
    def zone_edges(self) -> DataFrame:
        cx, cy, w = F.col("cx"), F.col("cy"), F.col("w")
        ring = [(cx + w, cy), (cx + w / 2, cy + w), (cx - w / 2, cy + w), (cx - w, cy), (cx - w / 2, cy - w), (cx + w / 2, cy - w)]
        return explode_ring(self.zone_shapes, ring, ["zone_id", "zone_class"])

    @cached_property
    def authority_edges(self) -> DataFrame:
        """Authorities as 20 km squares tiling the plane, one per nation."""
        x0 = (F.col("lpa") % 5 * 20000).cast("double")
        y0 = (F.floor(F.col("lpa") / 5) * 20000).cast("double")
        side = 20000.0
        ring = [(x0, y0), (x0 + side, y0), (x0 + side, y0 + side), (x0, y0 + side)]
        return explode_ring(self.read("nation").withColumnRenamed("n_nationkey", "lpa"), ring, ["lpa"])

    @cached_property
    def agreements(self) -> DataFrame:
        return self.read("lineitem").select(
            F.col("l_suppkey").alias("zone_id"), F.to_date("l_shipdate").alias("start_date"),
            F.date_add(F.to_date("l_shipdate"), 90).alias("end_date"), F.col("l_extendedprice").alias("value"),
            F.col("l_returnflag").alias("tier"),
        )


def explode_ring(df: DataFrame, ring: list[tuple[Column, Column]], keep: list[str]) -> DataFrame:
    """Directed edges of one closed ring per row."""
    pairs = list(zip(ring, ring[1:] + ring[:1], strict=True))
    edges = F.array(*[
        F.struct(F.lit(i).alias("edge_no"), a[0].alias("ax"), a[1].alias("ay"), b[0].alias("bx"), b[1].alias("by"))
        for i, (a, b) in enumerate(pairs)
    ])
    return df.select(*keep, F.explode(edges).alias("e")).select(*keep, "e.*")


def num(c: str, digits: int = 4) -> Column:
    """Alias-preserving ``fixed`` rounding for results compared with SQL."""
    return fixed(c, digits).alias(c)


def rounded(df: DataFrame, columns: dict[str, int] | list[str], digits: int = 4) -> DataFrame:
    spec = columns if isinstance(columns, dict) else {c: digits for c in columns}
    return df.withColumns({c: fixed(F.col(c).cast("double"), d) for c, d in spec.items()})


# --- the same bindings in SQL -------------------------------------------------------------------

def rnd(expression: str, digits: int = 4) -> str:
    return f"floor(CAST({expression} AS DOUBLE)*1e{digits}+0.5000001e0)/1e{digits}"


_XY = "CAST(({k}*7919)%100000 AS DOUBLE) AS x, CAST(({k}*104729)%100000 AS DOUBLE) AS y"

CTES = {
    "sites": f"""sites AS (SELECT o_orderkey AS site_id, c_nationkey AS lpa, {_XY.format(k='o_orderkey')},
 CAST(o_orderdate AS DATE) AS submission_date, o_totalprice/10000 AS capacity_mw,
 20+(o_orderkey*31)%400 AS duration_days, CASE WHEN o_orderstatus='F' THEN 1 ELSE 0 END AS granted,
 o_orderstatus AS status, o_orderpriority AS tech FROM orders JOIN customer ON o_custkey=c_custkey)""",
    "subs": f"""subs AS (SELECT s_suppkey AS sub_id, {_XY.format(k='s_suppkey')}, s_acctbal AS headroom, s_nationkey AS zone_class FROM supplier)""",
    "assets": """assets AS (SELECT p_partkey AS asset_id, CAST((p_partkey*7919+13)%100000 AS DOUBLE) AS x,
 CAST((p_partkey*104729+7)%100000 AS DOUBLE) AS y,
 CASE WHEN p_size<=12 THEN '11kv' WHEN p_size<=25 THEN '33kv' WHEN p_size<=38 THEN '66kv' ELSE '132kv' END AS voltage,
 p_type AS asset_tag, p_retailprice AS rating, CAST(1995+p_partkey%7 AS INTEGER) AS publication_year FROM part)""",
    "segs": """segs AS (SELECT asset_id AS line_id, voltage, asset_tag, x AS ax, y AS ay,
 x+(asset_id*31)%8001-4000 AS bx, y+(asset_id*53)%8001-4000 AS "by" FROM assets)""",
    "shapes": """shapes AS (SELECT s_suppkey AS zone_id, CAST((s_suppkey*7919)%100000 AS DOUBLE) AS cx,
 CAST((s_suppkey*104729)%100000 AS DOUBLE) AS cy, CAST(2000+(s_suppkey*37)%8000 AS DOUBLE) AS w,
 s_nationkey%4 AS zone_class, s_acctbal AS value FROM supplier)""",
    "edges": """ring(edge_no, fx, fy) AS (VALUES (0,1.0e0,0.0e0),(1,0.5e0,1.0e0),(2,-0.5e0,1.0e0),(3,-1.0e0,0.0e0),(4,-0.5e0,-1.0e0),(5,0.5e0,-1.0e0)),
edges AS (SELECT zone_id, zone_class, a.edge_no, cx+a.fx*w AS ax, cy+a.fy*w AS ay, cx+b.fx*w AS bx, cy+b.fy*w AS "by"
 FROM shapes, ring a JOIN ring b ON b.edge_no=(a.edge_no+1)%6)""",
}
NEEDS = {"segs": ["assets"], "edges": ["shapes"]}


def with_ctes(*names: str) -> str:
    out: list[str] = []
    for name in names:
        for need in [*NEEDS.get(name, []), name]:
            if need not in out:
                out.append(need)
    return "WITH " + ",\n".join(CTES[n] for n in out)


def sql_turn(a, b, c) -> str:
    return f"sign(({b[0]}-{a[0]})*({c[1]}-{a[1]})-({b[1]}-{a[1]})*({c[0]}-{a[0]}))"


def sql_meeting(a: str, b: str, on: str, keys: str) -> str:
    """SQL for the ``keys`` of polygons of edge tables a and b that touch: edges that meet, or a corner inside."""
    p, q, c, d = (("p.ax", "p.ay"), ("p.bx", 'p."by"'), ("e.ax", "e.ay"), ("e.bx", 'e."by"'))
    near = " AND ".join(f"greatest({x[0]},{x[1]})>=least({y[0]},{y[1]})" for u, v in (((p, q), (c, d)), ((c, d), (p, q))) for i in (0, 1) for x, y in [((u[0][i], u[1][i]), (v[0][i], v[1][i]))])
    straddle = f"{sql_turn(p, q, c)}*{sql_turn(p, q, d)}<=0 AND {sql_turn(c, d, p)}*{sql_turn(c, d, q)}<=0"
    return f"""SELECT DISTINCT {keys} FROM {a} p JOIN {b} e ON {on} WHERE {near} AND {straddle}
UNION SELECT {keys} FROM {a} p JOIN {b} e ON {on} WHERE p.edge_no=0 GROUP BY {keys}, p.ax, p.ay HAVING sum({sql_crosses('p.ax', 'p.ay', 'e')})%2=1
UNION SELECT {keys} FROM {a} p JOIN {b} e ON {on} WHERE e.edge_no=0 GROUP BY {keys}, e.ax, e.ay HAVING sum({sql_crosses('e.ax', 'e.ay', 'p')})%2=1"""


def sql_distance(a: str, b: str) -> str:
    return f"sqrt(({a}.x-{b}.x)*({a}.x-{b}.x)+({a}.y-{b}.y)*({a}.y-{b}.y))"


def sql_segment_distance(x: str, y: str, s: str) -> str:
    """SQL twin of the point-segment distance, for a segment alias."""
    ux, uy = f"({s}.bx-{s}.ax)", f'({s}."by"-{s}.ay)'
    l2 = f"({ux}*{ux}+{uy}*{uy})"
    t = f"greatest(0e0,least(1e0,CASE WHEN {l2}>0 THEN (({x}-{s}.ax)*{ux}+({y}-{s}.ay)*{uy})/{l2} ELSE 0e0 END))"
    dx, dy = f"({s}.ax+{t}*{ux}-{x})", f"({s}.ay+{t}*{uy}-{y})"
    return f"sqrt({dx}*{dx}+{dy}*{dy})"


def sql_crosses(x: str, y: str, e: str) -> str:
    return (f'CASE WHEN ({e}.ay>{y})<>({e}."by">{y}) AND {x}<({e}.bx-{e}.ax)*({y}-{e}.ay)/({e}."by"-{e}.ay)+{e}.ax '
            "THEN 1 ELSE 0 END")
