"""Queries that write artifacts to the shared folder and read them back (SRC-*, SNK-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitegauge.operators import clean
from sitegauge.plans.bindings import with_ctes
from sitegauge.plans.registry import query
from sitegauge.session import shared_scratch
from sitegauge.sources import readers, writers


@query(
    "src01_read_register",
    "SELECT o_orderkey AS ref, o_orderpriority AS technology, o_totalprice AS capacity, CAST(o_orderdate AS DATE) AS received, CAST(NULL AS VARCHAR) AS storage_type FROM orders",
)
def _(t):
    path = shared_scratch(t.spark)
    raw = t.read("orders").select(
        F.col("o_orderkey").cast("string").alias("Ref ID"), F.col("o_orderpriority").alias("Technology Type"),
        F.format_string("%.2f", "o_totalprice").alias("Capacity (MW)"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("Received"), F.lit("x").alias("Unused"),
    )
    raw.write.option("header", True).csv(path)
    mapping = {"Ref ID": "ref", "Technology Type": "technology", "Capacity (MW)": "capacity", "Received": "received", "Storage Type": "storage_type"}
    out = clean.coerce(readers.read_register(t.spark, path, mapping), ["capacity"], ["received"])
    return out.withColumn("ref", F.col("ref").cast("long"))


@query("src02_read_stats", "SELECT c_nationkey AS lpa_nm, CASE WHEN c_custkey%3<>0 THEN c_acctbal END AS c_2020_total, c_custkey AS row_id FROM customer")
def _(t):
    path = shared_scratch(t.spark)
    t.read("customer").select(
        F.col("c_nationkey").alias("LPA-Nm"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal").cast("string")).otherwise("..").alias("2020 Total"), F.col("c_custkey").alias("Row ID")
    ).write.option("header", True).csv(path)
    out = readers.read_stats(t.spark, path)
    return out.select(F.col("lpa_nm").cast("int").alias("lpa_nm"), F.col("c_2020_total").cast("double").alias("c_2020_total"), F.col("row_id").cast("long").alias("row_id"))


@query("src03_read_geojson", f"{with_ctes('sites')} SELECT site_id, x, y, CAST(5*(site_id%3)+5 AS INTEGER) AS capacity_mw FROM sites")
def _(t):
    path = shared_scratch(t.spark)
    s = t.places.withColumn("cap", (5 * (F.col("site_id") % 3) + 5).cast("int"))
    writers.write_geojson_by_capacity(writers.theme_features(s, "cap", writers.point_geometry(F.col("x"), F.col("y")), {"prediction": ["site_id"]}), path)
    features = readers.read_geojson_lines(t.spark, path)
    points = readers.geojson_points(features).join(features.select("feature_id", "capacity_mw"), "feature_id")
    return points.select(F.col("properties")["site_id"].cast("long").alias("site_id"), "x", "y", F.col("capacity_mw").cast("int").alias("capacity_mw"))


@query(
    "src03_read_collections",
    f"""{with_ctes('segs', 'edges')} SELECT 'line' AS kind, line_id AS id, 0 AS edge_no, ax, ay, bx, "by" FROM segs UNION ALL SELECT 'zone', zone_id, edge_no, ax, ay, bx, "by" FROM edges""",
)
def _(t):
    """Whole feature collections of lines and polygons, written and read back as edges."""
    base = shared_scratch(t.spark)
    point = lambda x, y: F.array(F.col(x), F.col(y))
    line = F.struct(F.lit("LineString").alias("type"), F.array(point("ax", "ay"), point("bx", "by")).alias("coordinates"))
    writers.write_collections(t.segments, f"{base}/lines", "line_id", line, ["line_id"])
    corners = F.transform(F.array_sort(F.collect_list(F.struct("edge_no", "ax", "ay"))), lambda e: F.array(e["ax"], e["ay"]))
    rings = t.zone_edges.groupBy("zone_id").agg(corners.alias("ring")).withColumn("ring", F.concat("ring", F.array(F.col("ring")[0])))
    writers.write_collections(rings, f"{base}/zones", "zone_id", F.struct(F.lit("Polygon").alias("type"), F.array("ring").alias("coordinates")), ["zone_id"])

    def back(name, id, parse, no):
        features = readers.read_geojson(t.spark, f"{base}/{name}")
        keys = features.select("feature_id", F.col("properties")[id].cast("long").alias("id"))
        return parse(features).join(keys, "feature_id").select(F.lit(name[:-1]).alias("kind"), "id", F.col(no).cast("int").alias("edge_no"), "ax", "ay", "bx", "by")

    return back("lines", "line_id", readers.geojson_segments, "segment_no").unionByName(back("zones", "zone_id", readers.geojson_edges, "edge_no"))


@query(
    "src04_union_shards",
    f"{with_ctes('assets')} SELECT asset_id, voltage, rating, CASE WHEN voltage='33kv' THEN asset_tag END AS asset_tag FROM assets",
)
def _(t):
    paths = []
    for voltage in ("11kv", "33kv", "66kv", "132kv"):
        shard = t.assets.filter(F.col("voltage") == voltage).select(F.col("asset_id").alias("AssetId"), "voltage", F.col("rating").alias("Rating"), F.col("asset_tag").alias("AssetTag"))
        paths.append(shared_scratch(t.spark))
        writers.write_table(shard if voltage == "33kv" else shard.drop("AssetTag"), paths[-1])
    return readers.union_shards(t.spark, paths)


@query("src08_materialise", f"{with_ctes('sites')} SELECT lpa, count(*) AS n FROM sites GROUP BY lpa")
def _(t):
    path = shared_scratch(t.spark)
    readers.materialise(t.spark, path, lambda: t.sites.groupBy("lpa").agg(F.count(F.lit(1)).alias("n")))
    return readers.materialise(t.spark, path, lambda: t.sites.limit(0))


@query("src10_read_registry", "SELECT c_name AS name, CASE WHEN c_custkey%2=0 THEN 'https://'||lower(c_mktsegment) END AS portal_url FROM customer")
def _(t):
    path = shared_scratch(t.spark)
    url = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("https://"), F.lower("c_mktsegment")))
    t.read("customer").select(F.col("c_name").alias("name"), url.alias("portal_url")).write.json(path)
    return readers.read_registry(t.spark, path, lines=True).select("name", "portal_url")


@query("snk01_write_table", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem GROUP BY 1,2")
def _(t):
    path = shared_scratch(t.spark)
    writers.write_table(t.read("lineitem").select("l_returnflag", "l_linestatus", "l_linenumber"), path, partition_by=["l_returnflag"])
    back = t.spark.read.parquet(path)
    return back.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("lines"))
