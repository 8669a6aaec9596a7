"""Queries over key joins, dated joins and trailing windows (JN-1..4, 19..26, 30, 32, WN-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitegauge.operators import joins as jn
from sitegauge.operators import temporal as tm
from sitegauge.operators import windows as wn
from sitegauge.plans.bindings import CAPACITIES, rnd, rounded, with_ctes
from sitegauge.plans.profiles import scored
from sitegauge.plans.registry import query

S = with_ctes("sites")


@query(
    "jn01_merge_profiles",
    f"""{S}, a AS (SELECT lpa, {rnd('avg(granted)', 6)} AS approval FROM sites GROUP BY lpa), b AS (SELECT s_nationkey AS lpa, count(*) AS subs FROM supplier GROUP BY 1)
SELECT n_nationkey AS lpa, approval, subs FROM nation LEFT JOIN a ON a.lpa=n_nationkey LEFT JOIN b ON b.lpa=n_nationkey""",
)
def _(t):
    approval = rounded(t.sites.groupBy("lpa").agg(F.avg("granted").alias("approval")), ["approval"], 6)
    subs = t.read("supplier").groupBy(F.col("s_nationkey").alias("lpa")).agg(F.count(F.lit(1)).alias("subs"))
    return jn.merge_profiles(t.read("nation").select(F.col("n_nationkey").alias("lpa")), [approval, subs], "lpa")


@query("jn02_join_one_to_one", "SELECT c_custkey, c_mktsegment, n FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey=c_custkey")
def _(t):
    counts = t.read("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return jn.join_one_to_one(t.read("customer").select("c_custkey", "c_mktsegment"), counts, "c_custkey")


@query(
    "jn03_bridge_geometry",
    f"""{with_ctes('subs')} SELECT l_orderkey, l_linenumber, l_partkey, sub_id, x, y FROM lineitem JOIN subs ON sub_id=l_suppkey WHERE headroom>1000""",
)
def _(t):
    table = t.read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.concat(F.lit("site-"), F.col("l_suppkey").cast("string")).alias("ref"))
    lookup = t.substations.filter("headroom > 1000").select("sub_id", "x", "y", F.concat(F.col("sub_id").cast("string"), F.lit(" ")).alias("code"))
    return jn.bridge_geometry(table, lookup, "ref", "code", ["sub_id"]).select("l_orderkey", "l_linenumber", "l_partkey", "sub_id", "x", "y")


@query(
    "jn30_lookup_with_default",
    f"""SELECT c_custkey, coalesce(n,0) AS n, coalesce(total,-1e0) AS total FROM customer LEFT JOIN
 (SELECT o_custkey, count(*) AS n, {rnd('sum(o_totalprice)', 2)} AS total FROM orders WHERE o_orderstatus='F' GROUP BY 1) ON o_custkey=c_custkey""",
)
def _(t):
    stats = t.read("orders").filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))
    return jn.lookup_with_default(t.read("customer").select("c_custkey"), rounded(stats, ["total"], 2), "c_custkey", {"n": 0, "total": -1.0})


@query(
    "jn32_coordinate_backfill",
    f"""{S}, l AS (SELECT x%50 AS gx, tech, lpa, row_number() OVER (PARTITION BY x%50, tech ORDER BY site_id) rn FROM sites WHERE lpa>=5)
SELECT site_id, CASE WHEN s.lpa>=5 THEN s.lpa ELSE l.lpa END AS lpa FROM sites s LEFT JOIN l ON s.x%50=l.gx AND s.tech=l.tech AND l.rn=1""",
)
def _(t):
    s = t.sites.select("site_id", (F.col("x") % 50).alias("gx"), "tech", F.when(F.col("lpa") >= 5, F.col("lpa")).alias("lpa"))
    return jn.coordinate_backfill(s, s, ["gx", "tech"], "lpa", ["site_id"]).select("site_id", "lpa")


@query(
    "jn19_asof_latest",
    f"""{S}, {with_ctes('assets')[5:]}, p AS (SELECT DISTINCT make_date(publication_year,1,1) AS published FROM assets)
SELECT site_id, (SELECT max(published) FROM p WHERE published<=submission_date) AS published FROM sites""",
)
def _(t):
    publications = t.assets.select(F.make_date("publication_year", F.lit(1), F.lit(1)).alias("published"))
    return tm.latest_snapshot(t.places, publications, "submission_date", "published").select("site_id", "published")


_FORECAST = f"forecast AS (SELECT c_nationkey AS lpa, CAST(1994+o_orderkey%14 AS INTEGER) AS fy, {rnd('sum(o_totalprice)/1e6', 6)} AS twh FROM orders JOIN customer ON o_custkey=c_custkey GROUP BY 1,2)"


def _forecast(t):
    s = t.sites.groupBy("lpa", (1994 + F.col("site_id") % 14).cast("int").alias("fy"))
    return rounded(s.agg((F.sum(F.col("capacity_mw") * 10000) / 1e6).alias("twh")), ["twh"], 6)


@query(
    "jn20_asof_pair",
    f"""{S}, {_FORECAST}, k AS (SELECT DISTINCT lpa, CAST(year(submission_date) AS INTEGER) AS yr FROM sites),
p AS (SELECT k.lpa, k.yr, arg_max(twh, fy) FILTER (fy<=yr) AS a, arg_min(twh, fy) FILTER (fy>=yr+5) AS b FROM k JOIN forecast f ON f.lpa=k.lpa GROUP BY 1,2)
SELECT site_id, a AS twh_now, b AS twh_later, {rnd('(b-a)/a*100')} AS twh_growth_pct, {rnd('b/a', 6)} AS twh_growth_ratio FROM sites s LEFT JOIN p ON p.lpa=s.lpa AND p.yr=year(s.submission_date)""",
)
def _(t):
    s = t.sites.select("site_id", "lpa", F.year("submission_date").alias("yr"))
    out = tm.asof_pair(s, _forecast(t), "lpa", "yr", "fy", ["twh"]).drop("lpa", "yr")
    return rounded(out, {"twh_growth_pct": 4, "twh_growth_ratio": 6})


@query(
    "jn21_first_forecast_after",
    f"""{S}, {_FORECAST}, k AS (SELECT DISTINCT lpa, CAST(year(submission_date) AS INTEGER)+6 AS yr FROM sites),
p AS (SELECT k.lpa, k.yr, coalesce(min(fy) FILTER (fy>yr), max(fy)) AS used_year, coalesce(arg_min(twh, fy) FILTER (fy>yr), arg_max(twh, fy)) AS twh FROM k JOIN forecast f ON f.lpa=k.lpa GROUP BY 1,2)
SELECT site_id, used_year, twh FROM sites s LEFT JOIN p ON p.lpa=s.lpa AND p.yr=year(s.submission_date)+6""",
)
def _(t):
    s = t.sites.select("site_id", "lpa", (F.year("submission_date") + 6).alias("yr"))
    return tm.first_forecast_after(s, _forecast(t), "lpa", "yr", "fy", "twh").drop("lpa", "yr")


EVENTS = ("1997-05-01", "1999-05-06", "2001-06-07")


@query(
    "jn26_next_event",
    f"""{S}, e AS (SELECT unnest([{','.join(f"DATE '{d}'" for d in EVENTS)}]) AS d), n AS (SELECT site_id, submission_date AS sd, (SELECT min(d) FROM e WHERE d>submission_date) AS nx,
 (SELECT count(*) FROM e WHERE d>=submission_date AND d<=submission_date+250) AS hits FROM sites)
SELECT site_id, CAST(coalesce(date_diff('day',sd,nx),1500) AS INTEGER) AS days_to_event, CASE WHEN hits>0 THEN 1 ELSE 0 END AS crosses, coalesce(date_diff('day',sd,nx),1500)<45 AS purdah,
 coalesce(date_diff('day',sd,nx),1500)<180 AS pre_election,
 CASE WHEN year(sd)+18<2015 THEN 0 WHEN year(sd)+18<2020 THEN 1 WHEN year(sd)+18<2022 THEN 2 WHEN year(sd)+18<2024 THEN 3 ELSE 4 END AS era FROM n""",
)
def _(t):
    day = F.col("submission_date")
    out = t.places.select("site_id", tm.next_event_days(day, EVENTS).alias("days_to_event"), tm.crosses_event(day, EVENTS).alias("crosses"),
                          tm.policy_era(F.year(day) + 18).alias("era"))
    return out.withColumns({"purdah": F.col("days_to_event") < 45, "pre_election": F.col("days_to_event") < 180})


_D = "date_diff('day', DATE '1970-01-01', submission_date)"


@query(
    "wn01_queue_depth",
    f"""{S}, d AS (SELECT site_id, lpa, {_D} AS dn FROM sites) SELECT site_id, count(*) OVER (PARTITION BY lpa ORDER BY dn RANGE BETWEEN 180 PRECEDING AND 1 PRECEDING) AS queue_depth FROM d""",
)
def _(t):
    return wn.queue_depth(t.sites).select("site_id", "queue_depth")


@query(
    "wn02_relative_scale",
    f"""{S}, d AS (SELECT site_id, lpa, capacity_mw, {_D} AS dn FROM sites), w AS (SELECT *, avg(capacity_mw) OVER (PARTITION BY lpa ORDER BY dn RANGE BETWEEN 180 PRECEDING AND 1 PRECEDING) AS m FROM d)
SELECT site_id, {rnd('capacity_mw/coalesce(m,(SELECT avg(capacity_mw) FROM sites))')} AS relative_scale FROM w""",
)
def _(t):
    return rounded(wn.relative_scale(t.sites, "capacity_mw").select("site_id", "relative_scale"), ["relative_scale"])


@query(
    "wn03_national_velocity",
    f"""{S}, d AS (SELECT site_id, submission_date, count(*) OVER (ORDER BY {_D} RANGE BETWEEN 90 PRECEDING AND 1 PRECEDING) AS c FROM sites)
SELECT site_id, c AS national_count, {rnd('c/(SELECT avg(c) FROM d)', 6)} AS national_velocity, CASE WHEN month(submission_date) IN (11,12,1,2) THEN 1 ELSE 0 END AS is_winter FROM d""",
)
def _(t):
    out = wn.national_velocity(t.places).select("site_id", "national_count", "national_velocity", "is_winter")
    return rounded(out, ["national_velocity"], 6)


@query(
    "wn04_national_queue",
    f"""{S} SELECT site_id, {rnd('coalesce(sum(capacity_mw) OVER w,0)', 3)} AS national_mw, {rnd('coalesce(sum(capacity_mw) OVER w,0)*capacity_mw', 2)} AS queue_times_mw FROM sites
WINDOW w AS (ORDER BY {_D} RANGE BETWEEN 365 PRECEDING AND 1 PRECEDING)""",
)
def _(t):
    out = wn.national_queue(t.places, "capacity_mw").select("site_id", "national_mw", "queue_times_mw")
    return rounded(out, {"national_mw": 3, "queue_times_mw": 2})


_GRID = f"""grid AS (SELECT site_id, mw AS scenario_mw, duration_days*(1+mw/(capacity_mw+10)) AS days FROM sites, (SELECT unnest([{','.join(f'{float(c)}e0' for c in CAPACITIES)}]) AS mw))"""


def _grid(t):
    from sitegauge.operators.clean import expand_scenarios

    s = expand_scenarios(t.places.select("site_id", "capacity_mw", "duration_days"), CAPACITIES)
    return s.select("site_id", "scenario_mw", (F.col("duration_days") * (1 + F.col("scenario_mw") / (F.col("capacity_mw") + 10))).alias("days"))


@query(
    "wn05_rank_style",
    f"""{S}, {_GRID}, r AS (SELECT site_id, scenario_mw, (row_number() OVER (PARTITION BY scenario_mw ORDER BY days, site_id)-1)*100e0/count(*) OVER (PARTITION BY scenario_mw) AS p FROM grid)
SELECT site_id, scenario_mw, {rnd('p', 6)} AS rank_pct, CASE WHEN p<25 THEN 'Q1 (Best)' WHEN p<50 THEN 'Q2' WHEN p<75 THEN 'Q3' ELSE 'Q4 (Worst)' END AS quartile,
 CASE WHEN p<25 THEN '#2ecc71' WHEN p<50 THEN '#f1c40f' WHEN p<75 THEN '#e67e22' ELSE '#e74c3c' END AS colour FROM r""",
)
def _(t):
    return rounded(wn.rank_style(_grid(t), ["scenario_mw"], "days", "site_id").drop("days"), ["rank_pct"], 6)


@query(
    "wn06_percentile_vs_scenarios",
    f"""{S}, {_GRID} SELECT site_id, scenario_mw, {rnd('(rank() OVER (PARTITION BY site_id ORDER BY days)-1)*1e0/count(*) OVER (PARTITION BY site_id)', 6)} AS shorter_share FROM grid""",
)
def _(t):
    return rounded(wn.percentile_vs_scenarios(_grid(t), "site_id", "days").drop("days"), ["shorter_share"], 6)


@query(
    "wn07_pick_optimal",
    f"""{S}, {_GRID}, p AS (SELECT site_id, coalesce(max(scenario_mw) FILTER (days<=300), arg_min(scenario_mw, days)) AS optimal_mw FROM grid GROUP BY 1)
SELECT p.site_id, optimal_mw, {rnd('days')} AS optimal_days FROM p JOIN grid g ON g.site_id=p.site_id AND g.scenario_mw=optimal_mw""",
)
def _(t):
    return rounded(wn.pick_optimal(_grid(t), "site_id", "scenario_mw", "days"), ["optimal_days"])


@query(
    "wn09_band",
    f"""{S}, q AS (SELECT quantile_cont(capacity_mw,0.25) a, quantile_cont(capacity_mw,0.5) b, quantile_cont(capacity_mw,0.75) c FROM sites)
SELECT site_id, CAST(CASE WHEN capacity_mw<1 THEN 0 WHEN capacity_mw<5 THEN 1 WHEN capacity_mw<10 THEN 2 WHEN capacity_mw<25 THEN 3 ELSE 4 END AS INTEGER) AS band,
 CAST(1+(capacity_mw>a)::INT+(capacity_mw>b)::INT+(capacity_mw>c)::INT AS INTEGER) AS quartile FROM sites, q""",
)
def _(t):
    s = t.places.select("site_id", "capacity_mw", wn.band(F.col("capacity_mw"), [0, 1, 5, 10, 25]).cast("int").alias("band"))
    return wn.quartile_band(s, "capacity_mw").drop("capacity_mw")


@query(
    "wn10_trim_by_group",
    f"""{S}, q AS (SELECT lpa, count(*) n, quantile_cont(capacity_mw,0.02) lo, quantile_cont(capacity_mw,0.98) hi FROM sites GROUP BY lpa)
SELECT site_id, s.lpa FROM sites s JOIN q ON q.lpa=s.lpa WHERE n<10 OR capacity_mw BETWEEN lo AND hi""",
)
def _(t):
    return wn.trim_by_group(t.sites.select("site_id", "lpa", "capacity_mw"), "lpa", "capacity_mw").drop("capacity_mw")


@query(
    "wn11_top_drivers",
    f"""{S}, d AS (SELECT site_id, 'grid' AS feature, CAST(site_id%41-20 AS DOUBLE) AS days FROM sites UNION ALL SELECT site_id, 'habitat', CAST(site_id%59-30 AS DOUBLE) FROM sites UNION ALL
 SELECT site_id, 'policy', CAST(site_id%73-35 AS DOUBLE) FROM sites UNION ALL SELECT site_id, 'road', CAST(site_id%7-3 AS DOUBLE) FROM sites),
r AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY abs(days) DESC, feature) AS driver_rank FROM d)
SELECT site_id, CAST(driver_rank AS INTEGER) AS driver_rank, feature, days, CASE WHEN days>=0 THEN '+' ELSE '-' END||CAST(CAST(abs(days) AS INTEGER) AS VARCHAR)||' days' AS text FROM r WHERE driver_rank<=3""",
)
def _(t):
    k = F.col("site_id")
    parts = {n: (k % m - o).cast("double") for n, m, o in (("grid", 41, 20), ("habitat", 59, 30), ("policy", 73, 35), ("road", 7, 3))}
    return wn.top_drivers(t.places, "site_id", parts)


@query(
    "wn12_months_to_window",
    f"""{S}, m AS (SELECT site_id, CAST(month(submission_date) AS INTEGER) AS m FROM sites), w AS (SELECT site_id, CASE WHEN m BETWEEN 4 AND 9 THEN 0 ELSE (4-m+12)%12 END AS summer, CASE WHEN m>=10 OR m<=3 THEN 0 ELSE (10-m+12)%12 END AS winter FROM m)
SELECT site_id, CAST(summer AS INTEGER) AS summer, CAST(winter AS INTEGER) AS winter, CAST(greatest(summer,winter) AS INTEGER) AS longest FROM w""",
)
def _(t):
    m = F.month("submission_date")
    out = t.places.select("site_id", wn.months_to_window(m, 4, 9).cast("int").alias("summer"), wn.months_to_window(m, 10, 3).cast("int").alias("winter"))
    return out.withColumn("longest", F.greatest("summer", "winter"))


@query(
    "wn09_error_quartiles",
    f"""{S}, e AS (SELECT abs((site_id*17)%101-45) AS error FROM sites), q AS (SELECT quantile_cont(error,0.25) AS a, quantile_cont(error,0.5) AS b, quantile_cont(error,0.75) AS c FROM e)
SELECT (error>a)::INT+(error>b)::INT+(error>c)::INT+1 AS error_quartile, count(*) AS n, {rnd('avg(error)', 6)} AS mean_error FROM e, q GROUP BY 1""",
)
def _(t):
    s = scored(t).withColumn("error", F.abs(F.col("predicted") - F.col("duration_days")))
    out = wn.quartile_band(s.select("site_id", "error"), "error", "error_quartile")
    return rounded(out.groupBy("error_quartile").agg(F.count(F.lit(1)).alias("n"), F.avg("error").alias("mean_error")), ["mean_error"], 6)
