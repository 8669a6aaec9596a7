"""Queries over page, registry and sink operators (WB-*, SRC-*, SNK-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitegauge.functions import projection
from sitegauge.operators import clean, pages as pg
from sitegauge.operators import nearest as nr
from sitegauge.operators import polygons as poly
from sitegauge.plans.bindings import rnd, rounded, sql_distance, sql_meeting, with_ctes
from sitegauge.plans.registry import query
from sitegauge.sources import readers, writers

_COUNT = "len(regexp_extract_all(html, '(?i)<({t})[\\s/>]', 1))"


@query(
    "wb01_page_metadata",
    "SELECT page_id, nullif(trim(regexp_extract(html,'(?is)<title[^>]*>(.*?)</title>',1)),'') AS title, nullif(trim(regexp_extract(html,'(?is)<meta[^>]*name=[\"'']description[\"''][^>]*content=[\"'']([^\"'']*)[\"'']',1)),'') AS description, "
    + ", ".join(f"CAST({_COUNT.format(t=t)} AS INTEGER) AS n_{t}" for t in pg.COUNTED_TAGS) + " FROM pages",
)
def _(t):
    return pg.page_metadata(t.read("pages").select("page_id", "html")).drop("html")


_CATEGORY = "CASE page_id%5 WHEN 0 THEN 'SEARCH_PAGE' WHEN 1 THEN 'HOMEPAGE' WHEN 2 THEN 'LANDING_PAGE' WHEN 3 THEN 'IRRELEVANT' ELSE 'DISCLAIMER_PAGE' END"


@query(
    "wb02_select_candidates",
    f"""WITH p AS (SELECT page_id, regexp_replace(url,'[?#].*$','') AS url, lower(split_part(url,'/',3)) AS site, {_CATEGORY} AS category FROM pages),
u AS (SELECT *, CASE category WHEN 'SEARCH_PAGE' THEN 1 WHEN 'DISCLAIMER_PAGE' THEN 2 WHEN 'LANDING_PAGE' THEN 3 ELSE 4 END AS pr FROM p WHERE category<>'IRRELEVANT'),
d AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY site, url ORDER BY pr, page_id)=1)
SELECT page_id, url, site, category, CAST(row_number() OVER (PARTITION BY site ORDER BY pr, page_id) AS INTEGER) AS rank FROM d QUALIFY row_number() OVER (PARTITION BY site ORDER BY pr, page_id)<=3""",
)
def _(t):
    k = F.col("page_id") % 5
    category = F.when(k == 0, "SEARCH_PAGE").when(k == 1, "HOMEPAGE").when(k == 2, "LANDING_PAGE").when(k == 3, "IRRELEVANT").otherwise("DISCLAIMER_PAGE")
    p = t.read("pages").select("page_id", F.regexp_replace("url", r"[?#].*$", "").alias("url"), pg.host("url").alias("site"), category.alias("category"))
    return pg.select_candidates(p, "site", "url", "category", "page_id", 3)


@query(
    "wb03_classify_vendor",
    """SELECT page_id, CASE WHEN regexp_matches(url,'(?i)/publicaccess/') THEN 'IDOX' WHEN regexp_matches(url,'(?i)utm_source=feed') THEN 'FEED' WHEN regexp_matches(url,'(?i)^https?://blog[.]') THEN 'BLOG'
 WHEN regexp_matches(url,'(?i)[.]html$') THEN 'STATIC' ELSE 'UNKNOWN' END AS vendor FROM pages""",
)
def _(t):
    rules = [*pg.VENDOR_PATTERNS, ("FEED", "utm_source=feed"), ("BLOG", r"^https?://blog[.]"), ("STATIC", r"[.]html$")]
    return t.read("pages").select("page_id", pg.classify_vendor("url", rules).alias("vendor"))


@query(
    "wb04_valid_domain",
    """WITH h AS (SELECT page_id, lower(split_part(url,'/',3)) AS host FROM pages) SELECT page_id, host, NOT (contains(host,'cheap-pills') OR contains(host,'spam-farm')) AND (contains(host,'.example.com') OR contains(host,'.example.org')) AS valid FROM h""",
)
def _(t):
    ok = pg.valid_domain("url", (".example.com", ".example.org"), ("cheap-pills", "spam-farm"))
    return t.read("pages").select("page_id", pg.host("url").alias("host"), ok.alias("valid"))


_NAME = "CASE page_id%3 WHEN 0 THEN 'Borough of '||split_part(host,'.',2)||' Council' WHEN 1 THEN 'City of Blog Yorkshire' ELSE 'The Council of' END"


@query(
    "wb05_domain_matches_name",
    f"""WITH h AS (SELECT page_id, url, lower(split_part(url,'/',3)) AS host FROM pages), n AS (SELECT *, {_NAME} AS name FROM h),
t AS (SELECT *, CASE page_id%3 WHEN 0 THEN list_filter([split_part(host,'.',2)], lambda x: x NOT IN ('city','town')) WHEN 1 THEN ['blog','yorkshire','yorks'] ELSE ['the','council','of'] END AS tok,
 CASE page_id%3 WHEN 0 THEN substr(split_part(host,'.',2),1,1) WHEN 1 THEN 'by' ELSE 'tco' END AS acr FROM n)
SELECT page_id, name, (len(list_filter(tok, lambda x: length(x)>=3 AND contains(host,x)))>0 OR (length(acr)>=2 AND starts_with(host,acr))) AS matches FROM t""",
)
def _(t):
    h = t.read("pages").select("page_id", "url", pg.host("url").alias("host"))
    middle = F.split_part("host", F.lit("."), F.lit(2))
    name = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("Borough of "), middle, F.lit(" Council"))).when(F.col("page_id") % 3 == 1, "City of Blog Yorkshire").otherwise("The Council of")
    n = h.withColumn("name", name)
    return n.select("page_id", "name", pg.domain_matches_name("url", "name").alias("matches"))


@query(
    "wb06_candidate_urls",
    """WITH n AS (SELECT n_nationkey, 'North '||replace(n_name,'_','-')||' Yorkshire' AS name FROM nation), v AS (SELECT n_nationkey, unnest(list_distinct([regexp_replace(lower(name),'[ .-]','','g'), regexp_replace(lower(name),' ','-','g'),
 regexp_replace(replace(lower(name),'yorkshire','yorks'),'[ .-]','','g')])) AS v FROM n) SELECT n_nationkey, 'https://www.'||v||s||p AS url FROM v, (SELECT unnest(['.gov.uk','.gov.wales']) AS s), (SELECT unnest(['','/planning']) AS p)""",
)
def _(t):
    names = t.read("nation").select("n_nationkey", F.concat(F.lit("North "), F.regexp_replace("n_name", "_", "-"), F.lit(" Yorkshire")).alias("name"))
    return pg.candidate_urls(names, "name", (".gov.uk", ".gov.wales"), ("", "/planning")).drop("name")


@query(
    "wb07_apply_blueprints",
    """SELECT page_id, 'language' AS field, nullif(regexp_extract(html,'<html[^>]*lang="([^"]*)"',1),'') AS value FROM pages UNION ALL
 SELECT page_id, 'heading', nullif(regexp_extract(html,'(?s)<h1>(.*?)</h1>',1),'') FROM pages UNION ALL
 SELECT page_id, 'reference', nullif(regexp_extract(html,'Ref: ([A-Z0-9/]+)',1),'') FROM pages""",
)
def _(t):
    rules = {"language": r'<html[^>]*lang="([^"]*)"', "heading": r"(?s)<h1>(.*?)</h1>", "reference": r"Ref: ([A-Z0-9/]+)"}
    return pg.apply_blueprints(t.read("pages"), "page_id", "html", rules)


def _registry(t):
    known = t.read("customer").filter("c_acctbal >= 2000").select(
        F.concat(F.lit("City of "), "c_name", F.lit(" Borough Council")).alias("name"), F.col("c_name").alias("clean_name"),
        F.when(F.col("c_nationkey") >= 5, F.concat(F.lit("https://"), F.lower("c_mktsegment"))).alias("portal_url"), F.lit("IDOX").alias("vendor"), F.lit("VERIFIED").alias("status"),
    )
    names = t.read("customer").select(F.concat(F.lit("City of "), "c_name", F.lit(" Borough Council")).alias("name"))
    return pg.upsert_registry(known, names)


_REGISTRY = """SELECT 'City of '||c_name||' Borough Council' AS name, c_name AS clean_name, CASE WHEN c_acctbal>=2000 AND c_nationkey>=5 THEN 'https://'||lower(c_mktsegment) END AS portal_url,
 CASE WHEN c_acctbal>=2000 THEN 'IDOX' ELSE 'UNKNOWN' END AS vendor, CASE WHEN c_acctbal>=2000 THEN 'VERIFIED' ELSE 'AUTO_GENERATED' END AS status FROM customer"""


@query("wb08_upsert_registry", _REGISTRY)
def _(t):
    return _registry(t)


@query("wb09_missing_urls", f"SELECT * FROM ({_REGISTRY}) WHERE portal_url IS NULL")
def _(t):
    return pg.missing_urls(_registry(t))


@query(
    "wb10_keyword_flags",
    """SELECT doc_id, CASE WHEN contains(lower(text),'the ') OR contains(lower(text),' and ') THEN 1 ELSE 0 END AS english, CASE WHEN contains(lower(text),'licen') THEN 1 ELSE 0 END AS licence, CASE WHEN contains(lower(text),'@') THEN 1 ELSE 0 END AS contact FROM documents""",
)
def _(t):
    flags = pg.keyword_flags("text", {"english": ["the ", " and "], "licence": ["licen"], "contact": ["@"]})
    return t.read("documents").select("doc_id", *[c.alias(n) for n, c in flags.items()])


_MASK = "regexp_replace(regexp_replace(text,'[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}','[EMAIL]','g'),'\\+?\\d[\\d ()-]{8,}\\d','[PHONE]','g')"


@query("wb11_mask_contacts", f"SELECT doc_id, {_MASK} AS masked FROM documents")
def _(t):
    return t.read("documents").select("doc_id", pg.mask_contacts("text").alias("masked"))


@query(
    "wb11_phrase_matrix",
    f"SELECT doc_id, contains(lower({_MASK}),'copyright')::INT AS copyright, contains(lower({_MASK}),'[email]')::INT AS had_email, contains(lower({_MASK}),'that the')::INT AS that_the FROM documents",
)
def _(t):
    return pg.phrase_matrix(t.read("documents"), "doc_id", "text", {"copyright": "copyright", "had_email": "[email]", "that_the": "that the"})


@query(
    "ag20_worst_condition",
    f"""{with_ctes('sites', 'subs')}, u AS (SELECT *, CAST(sub_id%6 AS INTEGER) AS condition, DATE '1994-06-30'+CAST(sub_id*13%900 AS INTEGER) AS assessed, 'area '||CAST(sub_id%7 AS VARCHAR) AS parent FROM subs),
c AS (SELECT site_id, submission_date, sub_id, condition, assessed, parent, {sql_distance('s', 'u')} AS d FROM sites s, u), n AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY d, sub_id)=1),
w AS (SELECT site_id, max(condition) AS worst FROM c WHERE d<=5000 GROUP BY 1)
SELECT n.site_id, coalesce(worst,-1) AS worst, date_diff('day', assessed, make_date(year(submission_date),6,30)) AS recency_days, CASE WHEN parent<>'area '||CAST(n.site_id%7 AS VARCHAR) THEN 1 ELSE 0 END AS name_mismatch FROM n LEFT JOIN w ON w.site_id=n.site_id""",
)
def _(t):
    from sitegauge.operators.radius import pairs_within

    key = F.col("sub_id")
    units = t.substations.select("sub_id", "x", "y", (key % 6).cast("int").alias("condition"), F.date_add(F.lit("1994-06-30").cast("date"), (key * 13 % 900).cast("int")).alias("assessed"),
                                 F.concat(F.lit("Area "), (key % 7).cast("string")).alias("parent"))
    sites = t.places.select("site_id", "x", "y", "submission_date")
    near = nr.nearest(sites, units, id="sub_id", attrs=["assessed", "parent"])
    worst = pairs_within(sites, units, 5000, keep=["condition"], distinct=True).groupBy("x", "y").agg(F.max("condition").alias("worst"))
    own = F.concat(F.lit("area "), (F.col("site_id") % 7).cast("string"))
    midyear = F.make_date(F.year("submission_date"), F.lit(6), F.lit(30))
    return near.join(worst, ["x", "y"], "left").select(
        "site_id", F.coalesce("worst", F.lit(-1)).alias("worst"), F.datediff(midyear, "assessed").cast("long").alias("recency_days"),
        (~F.lower("parent").eqNullSafe(own)).cast("int").alias("name_mismatch"),
    )


@query("prj18_reproject", None)
def _(t):
    """Grid metres to degrees and back; the difference shows the round trip."""
    s = t.places.select("site_id", (F.col("x") + 400000).alias("x"), (F.col("y") + 200000).alias("y"))
    there = projection.grid_to_lonlat(s, "x", "y")
    back = projection.lonlat_to_grid(there, "lon", "lat", "x2", "y2")
    return back.withColumn("drift_m", F.sqrt(F.pow(F.col("x2") - F.col("x"), 2) + F.pow(F.col("y2") - F.col("y"), 2)))


@query(
    "src05_tag_and_unify",
    f"""{with_ctes('assets')} SELECT asset_id, '11kv' AS voltage, 'pole' AS asset_tag, 5e0 AS buffer_m FROM assets WHERE voltage='11kv' UNION ALL SELECT asset_id, '33kv', 'tower', 20e0 FROM assets WHERE voltage='33kv'
 UNION ALL SELECT asset_id, '66kv', 'tower', 25e0 FROM assets WHERE voltage='66kv' UNION ALL SELECT asset_id, '132kv', 'tower', 30e0 FROM assets WHERE voltage='132kv'""",
)
def _(t):
    a = t.assets.select("asset_id", F.col("voltage").alias("v"))
    layers = (("11kv", "pole", 5), ("33kv", "tower", 20), ("66kv", "tower", 25), ("132kv", "tower", 30))
    return readers.tag_and_unify({layer: a.filter(F.col("v") == layer[0]).drop("v") for layer in layers})


@query(
    "src09_points_from_text",
    f"{with_ctes('sites')} SELECT site_id, x, y, y/1e3 AS lat, x/1e3 AS lon FROM sites",
)
def _(t):
    s = t.places.select("site_id", F.format_string("POINT (%.0f %.0f)", "x", "y").alias("wkt"), F.format_string("%.3f, %.3f", F.col("y") / 1000, F.col("x") / 1000).alias("pair"))
    (x, y), (lon, lat) = readers.points_from_wkt(F.col("wkt")), readers.points_from_latlon_text(F.col("pair"))
    return s.select("site_id", x.alias("x"), y.alias("y"), lat.alias("lat"), lon.alias("lon"))


@query("src11_parse_stats_text", f"SELECT 'nation '||CAST(c_nationkey AS VARCHAR) AS section, c_mktsegment AS item, CAST(count(*) AS VARCHAR) AS n, CAST(max(c_custkey) AS VARCHAR) AS top FROM customer GROUP BY c_nationkey, c_mktsegment")
def _(t):
    lines = t.read("customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.max("c_custkey").alias("top"))
    lines = lines.select("c_nationkey", F.concat("c_mktsegment", F.lit(": n="), F.col("n").cast("string"), F.lit(", top="), F.col("top").cast("string")).alias("line"))
    reports = lines.groupBy("c_nationkey").agg(F.concat(F.lit("== nation "), F.first("c_nationkey").cast("string"), F.lit(" ==\n"), F.array_join(F.collect_list("line"), "\n")).alias("text"))
    return readers.parse_stats_text(reports).select("section", "item", F.col("metrics")["n"].alias("n"), F.col("metrics")["top"].alias("top"))


@query("src12_sample_features", "SELECT 10 AS n")
def _(t):
    return readers.sample_features(t.assets, 10).agg(F.count(F.lit(1)).cast("int").alias("n"))


@query(
    "snk02_geojson_features",
    f"""{with_ctes('sites')} SELECT CAST(5*(site_id%3)+5 AS INTEGER) AS capacity_mw, 'prediction' AS theme, '{{"type":"Feature","geometry":{{"type":"Point","coordinates":['||CAST(x AS VARCHAR)||','||CAST(y AS VARCHAR)||']}},"properties":{{"site_id":'||site_id||',"duration_days":'||duration_days||'}}}}' AS feature FROM sites
UNION ALL SELECT CAST(5*(site_id%3)+5 AS INTEGER), 'outcome', '{{"type":"Feature","geometry":{{"type":"Point","coordinates":['||CAST(x AS VARCHAR)||','||CAST(y AS VARCHAR)||']}},"properties":{{"site_id":'||site_id||',"granted":'||granted||'}}}}' FROM sites""",
)
def _(t):
    s = t.places.withColumn("cap", (5 * (F.col("site_id") % 3) + 5).cast("int"))
    return writers.theme_features(s, "cap", writers.point_geometry(F.col("x"), F.col("y")), {"prediction": ["site_id", "duration_days"], "outcome": ["site_id", "granted"]})


@query(
    "snk02_styled_features",
    f"""{with_ctes('sites')}, r AS (SELECT CAST(5*(site_id%3)+5 AS INTEGER) AS cap, site_id, x, y, duration_days, granted, (row_number() OVER (PARTITION BY site_id%3 ORDER BY duration_days, site_id)-1)*100e0/count(*) OVER (PARTITION BY site_id%3) AS pct FROM sites),
q AS (SELECT *, CASE WHEN pct<25 THEN '#2ecc71' WHEN pct<50 THEN '#f1c40f' WHEN pct<75 THEN '#e67e22' ELSE '#e74c3c' END AS c, CASE WHEN pct<25 THEN 'Q1 (Best)' WHEN pct<50 THEN 'Q2' WHEN pct<75 THEN 'Q3' ELSE 'Q4 (Worst)' END AS l, CAST({rnd('pct', 1)} AS VARCHAR) AS p FROM r),
f AS (SELECT *, '{{"type":"Feature","geometry":{{"type":"Point","coordinates":['||CAST(x AS VARCHAR)||','||CAST(y AS VARCHAR)||']}},"properties":{{"site_id":'||site_id||',' AS a,
 ',"fill":"'||c||'","marker-color":"'||c||'","stroke":"#ffffff","stroke-width":1,"fill-opacity":0.8,"rank_label":"'||l||'","rank_percentile":'||p||'}}}}' AS z FROM q)
SELECT cap AS capacity_mw, 'prediction' AS theme, a||'"duration_days":'||duration_days||z AS feature FROM f UNION ALL SELECT cap, 'outcome', a||'"granted":'||granted||z FROM f""",
)
def _(t):
    s = t.places.withColumn("cap", (5 * (F.col("site_id") % 3) + 5).cast("int"))
    return writers.styled_features(s, "cap", "site_id", "duration_days", writers.point_geometry(F.col("x"), F.col("y")), {"prediction": ["site_id", "duration_days"], "outcome": ["site_id", "granted"]})


@query(
    "snk03_write_code_maps",
    """SELECT 'p_type' AS "column", p_type AS value, CAST(dense_rank() OVER (ORDER BY p_type)-1 AS INTEGER) AS code FROM (SELECT DISTINCT p_type FROM part)
UNION ALL SELECT 'p_brand', p_brand, CAST(dense_rank() OVER (ORDER BY p_brand)-1 AS INTEGER) FROM (SELECT DISTINCT p_brand FROM part)""",
)
def _(t):
    return clean.code_map(t.read("part"), ["p_type", "p_brand"])


@query("snk04_skip_completed", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag='R')")
def _(t):
    done = t.read("lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return writers.skip_completed(t.read("orders").select("o_orderkey", "o_totalprice"), done, "o_orderkey")


@query(
    "jn17_boundary_vertices",
    f"""{with_ctes('edges')}, side(edge_no, fx, fy) AS (VALUES (0,0e0,0e0),(1,1e0,0e0),(2,1e0,1e0),(3,0e0,1e0)),
tiles AS (SELECT n_nationkey AS lpa, a.edge_no, 20000*(n_nationkey%5+a.fx) AS ax, 20000*(n_nationkey//5+a.fy) AS ay, 20000*(n_nationkey%5+b.fx) AS bx, 20000*(n_nationkey//5+b.fy) AS "by" FROM nation, side a JOIN side b ON b.edge_no=(a.edge_no+1)%4)
SELECT lpa AS id_a, zone_id AS id_b FROM ({sql_meeting('tiles', 'edges', 'true', 'p.lpa, e.zone_id')})""",
)
def _(t):
    """Authorities meeting each protected area."""
    return poly.polygon_intersects(t.authority_edges, t.zone_edges, "lpa", "zone_id")


@query("src06_asset_windows", f"{with_ctes('sites', 'subs')} SELECT sub_id, {rnd('avg(s.duration_days)')} AS mean_days, count(*) AS n FROM subs b JOIN sites s ON {sql_distance('s', 'b')}<=2000 GROUP BY 1")
def _(t):
    from sitegauge.operators.radius import sums_within

    out = sums_within(t.substations.select("sub_id", "x", "y"), t.places, [2000], {"n": F.lit(1), "days": F.col("duration_days")})
    out = out.filter("n_2000 > 0").select("sub_id", (F.col("days_2000") / F.col("n_2000")).alias("mean_days"), F.col("n_2000").alias("n"))
    return rounded(out, ["mean_days"])
