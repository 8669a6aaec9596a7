"""Queries over cleaning and encoding operators (PRJ-*, SC-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitegauge.functions import scalar as sc
from sitegauge.operators import clean, shape
from sitegauge.operators.joins import first_per_key
from sitegauge.plans.bindings import CAPACITIES, rnd, rounded, with_ctes
from sitegauge.plans.registry import query


@query("prj01_normalise_columns", "SELECT p_partkey AS part_key, p_type AS type, p_size AS c_2nd_size_mm FROM part")
def _(t):
    raw = t.read("part").select(
        F.col("p_partkey").alias("PartKey"), F.col("p_type").alias(" Type "), F.col("p_size").alias("2nd-Size (mm)")
    )
    return shape.normalise_columns(raw, camel=True)


@query("prj02_find_column", "SELECT max(l_extendedprice) AS top FROM lineitem")
def _(t):
    items = t.read("lineitem")
    return items.agg(F.max(shape.find_column(items, r"extended_?price")).alias("top"))


@query("prj03_rename_by_prefix", "SELECT n_nationkey AS area_nationkey, n_name AS area_name, n_regionkey AS area_regionkey FROM nation")
def _(t):
    return shape.drop_duplicate_columns(shape.rename_by_prefix(t.read("nation"), {"n_": "area_"}))


_RAW = """raw AS (SELECT o_orderkey, CASE WHEN o_orderkey%7=0 THEN 'n/a' ELSE CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR) END AS mw,
 CASE WHEN o_orderkey%5=0 THEN '31/02/1999' ELSE strftime(o_orderdate,'%d/%m/%Y') END AS received FROM orders)"""


def _raw(t):
    key = F.col("o_orderkey")
    return t.read("orders").select(
        key,
        F.when(key % 7 == 0, "n/a").otherwise(F.format_string("%.0f", F.bround("o_totalprice"))).alias("mw"),
        F.when(key % 5 == 0, "31/02/1999").otherwise(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("received"),
    )


@query(
    "prj04_coerce",
    f"""WITH {_RAW} SELECT o_orderkey, TRY_CAST(mw AS DOUBLE) AS mw,
 CAST(try_strptime(received,'%d/%m/%Y') AS DATE) AS received FROM raw""",
)
def _(t):
    return clean.coerce(_raw(t), ["mw"], ["received"])


@query(
    "prj04_coercion_report",
    f"""WITH {_RAW}, c AS (SELECT count(mw) a, count(TRY_CAST(mw AS DOUBLE)) b, count(received) c,
 count(try_strptime(received,'%d/%m/%Y')) d FROM raw)
SELECT 'mw' AS "column", a AS present, b AS parsed, a-b AS newly_null FROM c
UNION ALL SELECT 'received', c, d, c-d FROM c""",
)
def _(t):
    return clean.coercion_report(_raw(t), clean.coerce(_raw(t), ["mw"], ["received"]), ["mw", "received"])


@query(
    "prj05_clean_text",
    """SELECT doc_id, lower(trim(regexp_replace(text,'[\\r\\n]+',' ','g'))) AS body, length(regexp_replace(text,'[()]','','g')) AS plain_length
FROM documents""",
)
def _(t):
    return t.read("documents").select(
        "doc_id", clean.clean_text("text", "lower").alias("body"),
        F.length(clean.strip_parentheses("text")).alias("plain_length"),
    )


@query(
    "prj06_extract_number",
    f"""WITH {{base}} SELECT asset_id, CAST(greatest(volts, low) AS DOUBLE) AS max_kv, pct/100e0 AS ratio, (a+b)/2e0 AS midpoint, grade, code FROM
(SELECT p_partkey AS asset_id, p_size AS volts, 11 AS low, CAST(p_size AS DOUBLE) AS pct, CAST(p_size AS DOUBLE) AS a,
 CAST(p_size+20 AS DOUBLE) AS b, CAST(p_partkey%6 AS INTEGER) AS grade, 'E'||lpad(CAST(p_partkey AS VARCHAR),8,'0') AS code FROM part)""".replace("WITH {base} ", ""),
)
def _(t):
    size, key = F.col("p_size").cast("string"), F.col("p_partkey")
    return t.read("part").select(
        key.alias("asset_id"),
        clean.max_number(F.concat(size, F.lit("/11kV"))).alias("max_kv"),
        clean.percent_ratio(F.concat(F.lit("headroom "), size, F.lit(" %"))).alias("ratio"),
        clean.band_midpoint(F.concat(size, F.lit("-"), (F.col("p_size") + 20).cast("string"), F.lit("%"))).alias("midpoint"),
        clean.grade_digit(F.concat(F.lit("Grade "), (key % 6).cast("string"))).alias("grade"),
        clean.area_code(F.concat(F.lit("area E"), F.lpad(key.cast("string"), 8, "0"))).alias("code"),
    )


@query("prj07_reconcile_name", "SELECT n_nationkey, 'nation'||CAST(n_nationkey AS VARCHAR) AS key FROM nation")
def _(t):
    name = F.concat(F.lit("London Borough of "), F.regexp_replace("n_name", "_", " "), F.lit(" City Council"))
    return t.read("nation").select("n_nationkey", clean.reconcile_name(name).alias("key"))


@query(
    "prj08_fill_sentinels",
    """SELECT s_suppkey, CASE WHEN s_acctbal<=0 THEN -1e0 ELSE s_acctbal END AS headroom,
 CASE WHEN s_suppkey%3=0 THEN 999e0 ELSE CAST(s_suppkey AS DOUBLE) END AS km FROM supplier""",
)
def _(t):
    key = F.col("s_suppkey")
    raw = t.read("supplier").select(
        "s_suppkey", F.when(F.col("s_acctbal") <= 0, float("inf")).otherwise(F.col("s_acctbal")).alias("headroom"),
        F.when(key % 3 != 0, key.cast("double")).alias("km"),
    )
    return clean.fill_sentinels(raw, {"headroom": -1.0, "km": 999.0})


def _gappy(t):
    key = F.col("o_orderkey")
    return t.read("orders").select(
        key, F.when(key % 10 < 2, F.col("o_totalprice")).alias("a"), F.when(key % 10 < 6, F.col("o_totalprice")).alias("b"),
        F.when(key % 4 == 0, F.lit(1.0)).alias("c"), F.when(key % 10 < 9, F.lit(2.0)).alias("d"),
    )


_GAPPY = """gappy AS (SELECT o_orderkey, CASE WHEN o_orderkey%10<2 THEN o_totalprice END AS a, CASE WHEN o_orderkey%10<6 THEN o_totalprice END AS b,
 CASE WHEN o_orderkey%4=0 THEN 1e0 END AS c, CASE WHEN o_orderkey%10<9 THEN 2e0 END AS d FROM orders)"""


@query("prj09_drop_sparse_columns", f"WITH {_GAPPY} SELECT o_orderkey, b, c, d FROM gappy")
def _(t):
    return shape.drop_sparse_columns(_gappy(t), 0.5, keep=["o_orderkey", "c"])


@query(
    "prj10_drop_sparse_rows",
    f"""WITH {_GAPPY} SELECT * FROM gappy WHERE (a IS NULL)::INT+(b IS NULL)::INT+(c IS NULL)::INT+(d IS NULL)::INT <= 1""",
)
def _(t):
    return shape.drop_sparse_rows(_gappy(t), 0.4, ["a", "b", "c", "d"])


@query("prj11_purge_columns", "SELECT o_orderkey, o_orderdate FROM orders")
def _(t):
    return shape.purge_columns(t.read("orders"), ["o_totalprice", "o_orderstatus", "o_orderpriority", "o_custkey"])


@query("prj12_align_schema", "SELECT s_name, CAST(s_suppkey AS BIGINT) AS s_suppkey, CAST(-1 AS DOUBLE) AS operator_b_mw, CAST(NULL AS VARCHAR) AS note FROM supplier")
def _(t):
    header = {"s_name": "string", "s_suppkey": "bigint", "operator_b_mw": "double", "note": "string"}
    return shape.align_schema(t.read("supplier"), header, {"operator_b_mw": -1.0})


@query(
    "prj13_filter_status",
    """SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus IN ('F','P') AND o_orderdate IS NOT NULL
 AND 20+(o_orderkey*31)%400>25 AND 20+(o_orderkey*31)%400<400 AND o_totalprice<=300000""",
)
def _(t):
    days = 20 + (F.col("o_orderkey") * 31) % 400
    return t.read("orders").filter(
        F.col("o_orderstatus").isin("F", "P") & F.col("o_orderdate").isNotNull() & (days > 25) & (days < 400)
        & (F.col("o_totalprice") <= 300000)
    ).select("o_orderkey", "o_totalprice")


@query(
    "prj14_named_cohorts",
    f"""{with_ctes('sites')}, c AS (SELECT 'small' AS cohort, * FROM sites WHERE capacity_mw<5 UNION ALL
 SELECT 'slow_refused', * FROM sites WHERE granted=0 AND duration_days>300 UNION ALL SELECT 'large_urgent', * FROM sites WHERE capacity_mw>=30 AND tech='1-URGENT')
SELECT cohort, count(*) AS n, {rnd('avg(duration_days)')} AS mean_days FROM c GROUP BY 1""",
)
def _(t):
    out = clean.named_cohorts(
        t.sites,
        {"small": "capacity_mw < 5", "slow_refused": "granted = 0 AND duration_days > 300", "large_urgent": "capacity_mw >= 30 AND tech = '1-URGENT'"},
        {"n": "count_if($cohort)", "mean_days": "avg(CASE WHEN $cohort THEN duration_days END)"},
    )
    return rounded(out, ["mean_days"])


@query(
    "prj15_golden_cohort",
    f"""{with_ctes('sites')}, r AS (
 SELECT 'fast_small' AS rule, site_id, row_number() OVER (ORDER BY duration_days, site_id) rn FROM sites WHERE granted=1 AND capacity_mw<5 UNION ALL
 SELECT 'slow_mid_refusal', site_id, row_number() OVER (ORDER BY duration_days DESC, site_id) FROM sites WHERE granted=0 AND capacity_mw>=5 AND capacity_mw<20 UNION ALL
 SELECT 'slow_large', site_id, row_number() OVER (ORDER BY duration_days DESC, site_id) FROM sites WHERE granted=1 AND capacity_mw>=20 UNION ALL
 SELECT 'authority_refusal', site_id, row_number() OVER (ORDER BY submission_date, site_id) FROM sites WHERE granted=0 AND lpa=3)
SELECT rule, site_id FROM r WHERE rn=1""",
)
def _(t):
    days = F.col("duration_days")
    return clean.golden_cohort(
        t.sites,
        {
            "fast_small": ("granted = 1 AND capacity_mw < 5", [days.asc()]),
            "slow_mid_refusal": ("granted = 0 AND capacity_mw >= 5 AND capacity_mw < 20", [days.desc()]),
            "slow_large": ("granted = 1 AND capacity_mw >= 20", [days.desc()]),
            "authority_refusal": ("granted = 0 AND lpa = 3", [F.col("submission_date").asc()]),
        },
        "site_id",
    ).select("rule", "site_id")


@query("prj17_plausible_coordinates", f"{with_ctes('sites')} SELECT site_id FROM sites WHERE x>1000 AND y>1000")
def _(t):
    return clean.plausible_coordinates(t.places).select("site_id")


@query(
    "prj19_reclassify",
    """SELECT p_partkey, coalesce(CASE p_type WHEN 'ECONOMY' THEN 'minor' WHEN 'PROMO' THEN 'trunk' END,
 CASE p_brand WHEN 'Brand#1' THEN 'trunk' WHEN 'Brand#2' THEN 'minor' END, 'other') AS road_class FROM part""",
)
def _(t):
    mapping = {"ECONOMY": "minor", "PROMO": "trunk", "Brand#1": "trunk", "Brand#2": "minor"}
    return t.read("part").select(
        "p_partkey", clean.reclassify([F.col("p_type"), F.col("p_brand")], mapping, "other").alias("road_class")
    )


@query(
    "prj20_row_hash_id",
    """SELECT o_orderkey, sha256('v1|'||o_orderstatus||'|'||printf('%.2f', o_totalprice)||'|'||printf('%.2f', CAST(o_custkey AS DOUBLE))) AS uid FROM orders""",
)
def _(t):
    return t.read("orders").select(
        "o_orderkey",
        clean.row_hash_id([F.col("o_orderstatus"), clean.fixed_text(F.col("o_totalprice")), clean.fixed_text(F.col("o_custkey"))], "v1").alias("uid"),
    )


@query(
    "prj21_expand_scenarios",
    f"""SELECT s_suppkey, CAST(mw AS DOUBLE) AS scenario_mw FROM supplier, (SELECT unnest([{','.join(str(float(c)) for c in CAPACITIES)}]) AS mw)""",
)
def _(t):
    return clean.expand_scenarios(t.read("supplier").select("s_suppkey"), CAPACITIES)


@query(
    "prj22_encode_ordinal",
    """WITH a AS (SELECT c_custkey, coalesce(CASE WHEN c_custkey%11=0 THEN NULL ELSE c_mktsegment END,'missing') AS v FROM customer)
SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY v)-1 AS INTEGER) AS seg_code FROM a""",
)
def _(t):
    seg = F.when(F.col("c_custkey") % 11 != 0, F.col("c_mktsegment")).alias("seg")
    return clean.encode_ordinal(t.read("customer").select("c_custkey", seg), ["seg"]).select("c_custkey", "seg_code")


@query(
    "prj23_one_hot",
    """SELECT p_partkey, (p_type='ECONOMY')::INT AS p_type_economy, (p_type IN ('PROMO','STANDARD'))::INT AS p_type_standard, 0 AS p_type_rural FROM part""",
)
def _(t):
    return clean.one_hot(t.read("part").select("p_partkey", "p_type"), "p_type", ["ECONOMY", "STANDARD", "RURAL"], synonyms={"PROMO": "STANDARD"})


@query("prj24_decode_one_hot", "SELECT p_partkey, CASE WHEN p_type IN ('ECONOMY','PROMO') THEN lower(p_type) ELSE 'Unknown' END AS kind FROM part")
def _(t):
    hot = clean.one_hot(t.read("part").select("p_partkey", "p_type"), "p_type", ["ECONOMY", "PROMO"])
    return shape.decode_one_hot(hot, "p_type_", "kind").select("p_partkey", "kind")


@query(
    "prj25_select_by_nearest_source",
    """WITH a AS (SELECT o_orderkey AS site_id, CAST((o_orderkey*13)%9000-500 AS DOUBLE) AS da, CAST((o_orderkey*29)%9000-500 AS DOUBLE) AS db FROM orders),
b AS (SELECT *, CASE WHEN da BETWEEN 0 AND 5000 THEN da END AS va, CASE WHEN db BETWEEN 0 AND 5000 THEN db END AS vb FROM a)
SELECT site_id, CASE WHEN va IS NULL AND vb IS NULL THEN NULL WHEN vb IS NULL OR va<=vb THEN 'a' ELSE 'b' END AS source,
 CASE WHEN va IS NULL AND vb IS NULL THEN NULL WHEN vb IS NULL OR va<=vb THEN da+1 ELSE db+2 END AS kv FROM b""",
)
def _(t):
    key = F.col("o_orderkey")
    both = t.read("orders").select(
        key.alias("site_id"), ((key * 13) % 9000 - 500).cast("double").alias("da"), ((key * 29) % 9000 - 500).cast("double").alias("db")
    ).withColumns({"kv_a": F.col("da") + 1, "kv_b": F.col("db") + 2})
    out = clean.select_by_nearest_source(both, {"a": "da", "b": "db"}, {"kv": {"a": "kv_a", "b": "kv_b"}})
    return out.select("site_id", "source", "kv")


@query(
    "prj26_coalesce_by_flag",
    """SELECT s_suppkey, CASE WHEN s_nationkey%2=0 THEN s_acctbal ELSE CAST(s_suppkey AS DOUBLE) END AS value,
 CASE WHEN s_suppkey%3=0 THEN s_acctbal ELSE (s_acctbal+s_suppkey)/2e0 END AS mean_value FROM supplier""",
)
def _(t):
    a, b = F.col("s_acctbal"), F.col("s_suppkey").cast("double")
    return t.read("supplier").select(
        "s_suppkey", shape.coalesce_by_flag(F.col("s_nationkey") % 2 == 0, a, b).alias("value"),
        sc.null_safe_mean([a, F.when(F.col("s_suppkey") % 3 != 0, b)]).alias("mean_value"),
    )


@query("prj27_contributing_mean", f"SELECT l_orderkey, l_linenumber, l_shipdate, {rnd('(l_discount+l_tax)/2e0', 6)} AS rate_mean FROM lineitem")
def _(t):
    items = t.read("lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", F.col("l_discount").alias("rate_a"), F.col("l_tax").alias("rate_b"))
    return rounded(shape.contributing_mean(items, "^rate_", "rate_mean").drop("rate_a", "rate_b"), ["rate_mean"], 6)


@query(
    "sc03_split_and_text",
    """SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS f_year, 'Q'||CAST(quarter(o_orderdate) AS VARCHAR) AS f_quarter, contains(lower(o_orderpriority),'urgent') AS urgent FROM orders""",
)
def _(t):
    quarter = F.concat_ws(" ", F.year("o_orderdate").cast("string"), F.concat(F.lit("Q"), F.quarter("o_orderdate").cast("string")))
    return t.read("orders").select(
        "o_orderkey", F.split_part(quarter, F.lit(" "), F.lit(1)).cast("int").alias("f_year"),
        F.element_at(F.split(quarter, " "), 2).alias("f_quarter"), F.lower("o_orderpriority").contains("urgent").alias("urgent"),
    )


@query(
    "sc05_date_parts",
    """SELECT o_orderkey, CAST(make_date(year(o_orderdate), coalesce(CASE WHEN o_orderkey%2=0 THEN month(o_orderdate) END,6), 15) AS DATE) AS rebuilt,
 date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-12-31') AS age_days, """
    + rnd("date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-12-31')/30.44e0")
    + " AS age_months, CAST(o_orderdate AS DATE)+90 AS due FROM orders",
)
def _(t):
    day, end = F.to_date("o_orderdate"), F.to_date(F.lit("2001-12-31"))
    out = t.read("orders").select(
        "o_orderkey",
        sc.date_from_parts(F.year(day), F.when(F.col("o_orderkey") % 2 == 0, F.month(day)), F.lit(None).cast("int")).alias("rebuilt"),
        F.datediff(end, day).cast("long").alias("age_days"), sc.months_between_days(end, day).alias("age_months"), F.date_add(day, 90).alias("due"),
    )
    return rounded(out, ["age_months"])


@query(
    "sc07_cyclic_month",
    f"""SELECT o_orderkey, {rnd('sin(month(o_orderdate)*2*pi()/12)', 6)} AS month_sin, {rnd('cos(month(o_orderdate)*2*pi()/12)', 6)} AS month_cos,
 CAST(month(o_orderdate) AS INTEGER) AS month_back FROM orders""",
)
def _(t):
    m = F.month("o_orderdate")
    out = t.read("orders").select("o_orderkey", sc.month_sin(m).alias("month_sin"), sc.month_cos(m).alias("month_cos"))
    out = out.withColumn("month_back", sc.month_from_cycle(F.col("month_sin"), F.col("month_cos")).cast("int"))
    return rounded(out, ["month_sin", "month_cos"], 6)


@query(
    "sc09_guarded_maths",
    f"""SELECT s_suppkey, {rnd('CASE WHEN s_nationkey<>0 THEN s_acctbal/s_nationkey END')} AS safe, {rnd('s_acctbal/(s_nationkey+1)')} AS plus_one,
 {rnd('ln(1+abs(s_acctbal))', 6)} AS log_scale, {rnd('pow(abs(s_acctbal),1.5e0)', 2)} AS power, least(greatest(s_acctbal,0e0),5000e0) AS clipped,
 {rnd('least(greatest((s_nationkey-3)/10e0,0e0),1e0)', 6)} AS ramp, {rnd('greatest((2000-abs(s_acctbal))/2000e0,0e0)', 6)} AS decay,
 CASE WHEN s_nationkey<5 THEN 'low' WHEN s_nationkey<15 THEN 'mid' ELSE 'high' END AS label FROM supplier""",
)
def _(t):
    a, n = F.col("s_acctbal"), F.col("s_nationkey")
    out = t.read("supplier").select(
        "s_suppkey", sc.safe_divide(a, n).alias("safe"), sc.guarded_divide(a, n, 1.0).alias("plus_one"), F.log1p(F.abs(a)).alias("log_scale"),
        F.pow(F.abs(a), F.lit(1.5)).alias("power"), sc.clip(a, 0, 5000).alias("clipped"), sc.linear_ramp(n, 3, 10).alias("ramp"),
        sc.distance_decay(F.abs(a)).alias("decay"), F.when(n < 5, "low").when(n < 15, "mid").otherwise("high").alias("label"),
    )
    return rounded(out, {"safe": 4, "plus_one": 4, "log_scale": 6, "power": 2, "ramp": 6, "decay": 6})


_LL = "-6+x/100000*8 AS lon, 50+y/100000*8 AS lat"


@query(
    "sc13_bearing_haversine",
    f"""{with_ctes('subs')}, p AS (SELECT sub_id, {_LL} FROM subs), q AS (SELECT *, radians(lat) r1, radians(53.0e0) r2, radians(-2.0e0-lon) dl FROM p)
SELECT sub_id, {rnd('2*6371*asin(least(1e0,sqrt(pow(sin((r2-r1)/2),2)+cos(r1)*cos(r2)*pow(sin(dl/2),2))))')} AS km,
 {rnd('(degrees(atan2(sin(dl)*cos(r2), cos(r1)*sin(r2)-sin(r1)*cos(r2)*cos(dl)))+360) - 360*floor((degrees(atan2(sin(dl)*cos(r2), cos(r1)*sin(r2)-sin(r1)*cos(r2)*cos(dl)))+360)/360)')} AS bearing FROM q""",
)
def _(t):
    p = t.substations.select("sub_id", (-6 + F.col("x") / 100000 * 8).alias("lon"), (50 + F.col("y") / 100000 * 8).alias("lat"))
    args = (F.col("lat"), F.col("lon"), F.lit(53.0), F.lit(-2.0))
    return rounded(p.select("sub_id", sc.haversine_km(*args).alias("km"), sc.bearing_deg(*args).alias("bearing")), ["km", "bearing"])


@query(
    "sc15_json_nested",
    """SELECT event_id, CAST(json_extract(props,'$.k') AS INTEGER) AS k, '{"id":'||event_id||',"type":"'||event_type||'"}' AS payload FROM events""",
)
def _(t):
    return t.read("events").select(
        "event_id", F.from_json("props", "k int")["k"].alias("k"),
        F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("payload"),
    )


@query("sc16_lookup", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 3 WHEN '3-MEDIUM' THEN 2 ELSE 0 END AS rating FROM orders")
def _(t):
    ratings = {"1-URGENT": 4, "2-HIGH": 3, "3-MEDIUM": 2}
    return t.read("orders").select("o_orderkey", sc.lookup(F.col("o_orderpriority"), ratings, 0).alias("rating"))


@query(
    "sc17_bin_softmax",
    f"""{with_ctes('sites')}, w AS (SELECT site_id, exp(-abs(100-duration_days)/50e0) a, exp(-abs(200-duration_days)/50e0) b, exp(-abs(350-duration_days)/50e0) c FROM sites)
SELECT site_id, {rnd('a/(a+b+c)', 6)} AS p_fast, {rnd('b/(a+b+c)', 6)} AS p_mid, {rnd('c/(a+b+c)', 6)} AS p_slow FROM w""",
)
def _(t):
    p = t.places.select("site_id", sc.softmax_over_bins(F.col("duration_days"), [100, 200, 350]).alias("p"))
    out = p.select("site_id", *[F.col("p")[i].alias(n) for i, n in enumerate(("p_fast", "p_mid", "p_slow"))])
    return rounded(out, ["p_fast", "p_mid", "p_slow"], 6)


@query(
    "wn08_dedupe",
    """SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
 ORDER BY l_shipdate DESC, l_partkey, l_suppkey, l_extendedprice) rn FROM lineitem) WHERE rn=1""",
)
def _(t):
    order = [F.desc("l_shipdate"), "l_partkey", "l_suppkey", "l_extendedprice"]
    return first_per_key(t.read("lineitem"), ["l_orderkey", "l_linenumber"], order).select("l_orderkey", "l_linenumber", "l_partkey")
