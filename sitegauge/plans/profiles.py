"""Queries over aggregations, rankings and set operations (AG-*, TK-*, SET-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitegauge.operators import profiles as pf
from sitegauge.operators import shape
from sitegauge.operators import windows as wn
from sitegauge.operators.joins import match_report
from sitegauge.plans.bindings import rnd, rounded, with_ctes
from sitegauge.plans.registry import query

S = with_ctes("sites")


@query(
    "ag01_rates_by_group",
    f"""{S} SELECT lpa, {rnd('sum(granted)*1e0/count(*)', 6)} AS approval, {rnd("sum((status='P')::INT)*1e0/count(*)", 6)} AS withdrawal,
 {rnd('sum((duration_days<=91)::INT)*1e0/sum(granted)', 6)} AS compliance FROM sites GROUP BY lpa""",
)
def _(t):
    one = F.lit(1)
    out = pf.rates_by_group(t.sites, ["lpa"], {
        "approval": (F.col("granted"), one), "withdrawal": ((F.col("status") == "P").cast("int"), one),
        "compliance": ((F.col("duration_days") <= 91).cast("int"), F.col("granted")),
    })
    return rounded(out, ["approval", "withdrawal", "compliance"], 6)


@query(
    "ag02_conditional_sums",
    f"""SELECT user_id, {rnd('sum(value)', 3)} AS mw_total, {rnd("sum(CASE WHEN event_type='click' THEN value ELSE 0 END)", 3)} AS mw_click,
 {rnd("sum(CASE WHEN event_type='error' THEN value ELSE 0 END)", 3)} AS mw_error,
 {rnd("sum(CASE WHEN event_type='click' THEN value ELSE 0 END)/(sum(CASE WHEN event_type='error' THEN value ELSE 0 END)+1)")} AS gen_over_demand
FROM events GROUP BY user_id""",
)
def _(t):
    out = pf.conditional_sums(t.read("events"), ["user_id"], "event_type", ["click", "error"], "value", "mw")
    out = out.withColumn("gen_over_demand", F.col("mw_click") / (F.col("mw_error") + 1))
    return rounded(out, {"mw_total": 3, "mw_click": 3, "mw_error": 3, "gen_over_demand": 4})


@query(
    "ag03_duration_profile",
    f"""{S} SELECT lpa, count(*) AS n, {rnd('avg(duration_days)')} AS days_mean, {rnd('stddev_samp(duration_days)')} AS days_std,
 {rnd('quantile_cont(duration_days, 0.9)')} AS days_p90 FROM sites GROUP BY lpa""",
)
def _(t):
    return rounded(pf.duration_profile(t.sites, ["lpa"], "duration_days"), ["days_mean", "days_std", "days_p90"])


_YEARLY = "yearly AS (SELECT lpa, CAST(year(submission_date) AS INTEGER) AS yr, count(*) AS load FROM sites GROUP BY 1,2)"


def _yearly(t):
    return t.sites.groupBy("lpa", F.year("submission_date").alias("yr")).agg(F.count(F.lit(1)).alias("load"))


@query("ag04_volatility", f"{S}, {_YEARLY} SELECT lpa, {rnd('stddev_pop(load)/avg(load)', 6)} AS volatility FROM yearly GROUP BY lpa")
def _(t):
    return rounded(pf.volatility(_yearly(t), ["lpa"], "load"), ["volatility"], 6)


@query("ag05_trend_by_group", f"{S}, {_YEARLY} SELECT lpa, {rnd('regr_slope(load, yr)')} AS trend FROM yearly GROUP BY lpa HAVING count(*)>=3")
def _(t):
    return rounded(pf.trend_by_group(_yearly(t), ["lpa"], "yr", "load"), ["trend"])


@query(
    "ag06_trend_across_columns",
    f"""WITH a AS (SELECT p_partkey, unnest([1,2,3,4,5]) AS x, unnest([p_size*1e0, p_partkey%50-5e0, 10e0, p_size+p_partkey%9, p_size*2e0]) AS y FROM part)
SELECT p_partkey, {rnd('CASE WHEN count(*) FILTER (y>0)>=2 THEN regr_slope(y,x) FILTER (y>0) ELSE 0 END', 6)} AS trend FROM a GROUP BY p_partkey""",
)
def _(t):
    size, key = F.col("p_size"), F.col("p_partkey")
    wide = t.read("part").select(key, size.alias("pop_2018"), (key % 50 - 5).alias("pop_2019"), F.lit(10).alias("pop_2020"),
                                 (size + key % 9).alias("pop_2021"), (size * 2).alias("pop_2022"))
    years = {f"pop_{2017 + i}": i for i in range(1, 6)}
    return rounded(pf.trend_across_columns(wide, years).select("p_partkey", "trend"), ["trend"], 6)


@query("ag07_ratio_by_outcome", f"{S} SELECT lpa, {rnd('avg(duration_days) FILTER (granted=1)/avg(duration_days) FILTER (granted=0)', 6)} AS days_ratio FROM sites GROUP BY lpa")
def _(t):
    return rounded(pf.ratio_by_outcome(t.sites, ["lpa"], F.col("granted") == 1, "duration_days"), ["days_ratio"], 6)


@query(
    "ag08_pivot_wide",
    "SELECT user_id, " + ", ".join(f"{rnd(f'sum(value) FILTER (event_type={chr(39)}{e}{chr(39)})', 3)} AS sum_{e}" for e in ("click", "view", "purchase", "error", "signup")) + " FROM events GROUP BY user_id",
)
def _(t):
    kinds = ["click", "view", "purchase", "error", "signup"]
    out = pf.pivot_wide(t.read("events"), ["user_id"], "event_type", kinds, F.sum("value"), "sum_")
    return rounded(out, [f"sum_{k}" for k in kinds], 3)


@query(
    "ag09_dominant_value",
    f"""WITH h AS (SELECT user_id, CAST(json_extract(props,'$.k') AS INTEGER) AS ord, value FROM events)
SELECT user_id, max(value) AS highest, (arg_max(ord, value*1e6-ord)) AS dominant_order, {rnd('avg(value) FILTER (ord%2=1)')} AS odd_mean FROM h GROUP BY user_id""",
)
def _(t):
    h = t.read("events").select("user_id", F.get_json_object("props", "$.k").cast("int").alias("ord"), "value")
    return rounded(pf.dominant_value(h, ["user_id"], "ord", "value"), ["odd_mean"])


@query(
    "ag10_rating_profile",
    f"""SELECT l_suppkey, {rnd('sum(l_quantity)')} AS rating_sum, count(l_quantity) AS rating_n, {rnd('avg(l_quantity)')} AS rating_mean, max(l_quantity) AS rating_max,
 min(l_quantity) AS rating_min, {rnd('coalesce(var_samp(l_quantity),0)', 3)} AS rating_var FROM lineitem GROUP BY l_suppkey""",
)
def _(t):
    return rounded(pf.rating_profile(t.read("lineitem"), ["l_suppkey"], "l_quantity"), {"rating_sum": 4, "rating_mean": 4, "rating_var": 3})


@query(
    "ag11_downstream_rollup",
    f"""SELECT l_suppkey AS primary_id, count(*) AS children, CAST(sum(l_linenumber) AS BIGINT) AS customers, {rnd('sum(l_extendedprice)', 2)} AS rating,
 {rnd('avg(l_discount)', 6)} AS mean_utilisation, {rnd("avg((l_returnflag='R')::INT)", 6)} AS share_r, CAST(min(year(l_shipdate)) AS INTEGER) AS earliest_year FROM lineitem GROUP BY 1""",
)
def _(t):
    out = t.read("lineitem").groupBy(F.col("l_suppkey").alias("primary_id")).agg(
        F.count(F.lit(1)).alias("children"), F.sum("l_linenumber").alias("customers"), F.sum("l_extendedprice").alias("rating"),
        F.avg("l_discount").alias("mean_utilisation"), F.avg((F.col("l_returnflag") == "R").cast("int")).alias("share_r"),
        F.min(F.year("l_shipdate")).alias("earliest_year"),
    )
    return rounded(out, {"rating": 2, "mean_utilisation": 6, "share_r": 6})


@query("ag12_hotspot_concentration", f"SELECT l_suppkey, {rnd('max(l_quantity)/(sum(l_quantity)+1)', 6)} AS concentration FROM lineitem GROUP BY l_suppkey")
def _(t):
    return rounded(pf.hotspot_concentration(t.read("lineitem"), ["l_suppkey"], "l_quantity"), ["concentration"], 6)


@query(
    "ag12_reconciliation_deltas",
    f"""WITH a AS (SELECT l_suppkey, sum(CAST(l_quantity AS BIGINT)) AS v FROM lineitem WHERE l_returnflag='R' AND l_suppkey%7<>3 GROUP BY 1), b AS (SELECT l_suppkey, sum(CAST(l_quantity AS BIGINT)) AS v FROM lineitem WHERE l_returnflag='N' AND l_suppkey%5<>2 GROUP BY 1)
SELECT l_suppkey, CAST(coalesce(a.v,0) AS BIGINT) AS value_a, CAST(coalesce(b.v,0) AS BIGINT) AS value_b, CAST(coalesce(a.v,0)-coalesce(b.v,0) AS BIGINT) AS delta, {rnd('(coalesce(a.v,0)-coalesce(b.v,0))/nullif(coalesce(b.v,0),0)', 6)} AS delta_share FROM a FULL JOIN b USING (l_suppkey)""",
)
def _(t):
    line = t.read("lineitem").select("l_suppkey", "l_returnflag", F.col("l_quantity").cast("long").alias("quantity"))
    a, b = line.filter("l_returnflag = 'R' AND l_suppkey % 7 <> 3"), line.filter("l_returnflag = 'N' AND l_suppkey % 5 <> 2")
    return rounded(pf.reconciliation_deltas(a, b, ["l_suppkey"], "quantity"), ["delta_share"], 6)


@query(
    "ag15_shrunk_stats",
    f"""{S}, g AS (SELECT avg(duration_days) gm, quantile_cont(duration_days,0.9) gq FROM sites),
s AS (SELECT lpa, count(*) n, avg(duration_days) m, stddev_samp(duration_days) sd, avg((duration_days>180)::INT) slow, quantile_cont(duration_days,0.25) q25,
 quantile_cont(duration_days,0.75) q75, quantile_cont(duration_days,0.9) q90 FROM sites GROUP BY lpa)
SELECT lpa, n, {rnd('(n*m+10*gm)/(n+10)')} AS shrunk_mean, {rnd('(n*q90+10*gq)/(n+10)')} AS shrunk_p90, {rnd('sd/m', 6)} AS spread_index, {rnd('q75-q25')} AS iqr, {rnd('slow', 6)} AS slow_share FROM s, g""",
)
def _(t):
    out = pf.shrunk_stats(t.sites, "lpa", "duration_days")
    return rounded(out, {"shrunk_mean": 4, "shrunk_p90": 4, "spread_index": 6, "iqr": 4, "slow_share": 6})


@query(
    "ag16_rollup_small_areas",
    f"""SELECT c_nationkey AS lpa, {rnd('avg(c_acctbal)', 3)} AS index_mean, {rnd('stddev_samp(c_acctbal)', 3)} AS index_std,
 {rnd("avg((c_mktsegment='BUILDING')::INT)", 6)} AS share_building, {rnd("avg((c_mktsegment='MACHINERY')::INT)", 6)} AS share_machinery FROM customer GROUP BY 1""",
)
def _(t):
    def share(v):
        return F.avg((F.col("c_mktsegment") == v).cast("int"))

    out = t.read("customer").groupBy(F.col("c_nationkey").alias("lpa")).agg(
        F.avg("c_acctbal").alias("index_mean"), F.stddev_samp("c_acctbal").alias("index_std"),
        share("BUILDING").alias("share_building"), share("MACHINERY").alias("share_machinery"),
    )
    return rounded(out, {"index_mean": 3, "index_std": 3, "share_building": 6, "share_machinery": 6})


@query(
    "ag17_weighted_band_index",
    f"SELECT p_partkey, {rnd('(p_size+2*(p_partkey%7)+3*(p_partkey%11))*1e0/(p_size+p_partkey%7+p_partkey%11)', 6)} AS band_index FROM part",
)
def _(t):
    key = F.col("p_partkey")
    return rounded(t.read("part").select(key, pf.weighted_band_index([F.col("p_size"), key % 7, key % 11]).alias("band_index")), ["band_index"], 6)


@query(
    "ag18_rowwise",
    f"""WITH a AS (SELECT p_partkey, CASE WHEN p_partkey%5<>0 THEN p_size*1e0 END AS sssi, CAST(p_partkey%40 AS DOUBLE) AS sac, p_retailprice/50 AS spa FROM part)
SELECT p_partkey, least(sssi,sac,spa) AS env_min, greatest(sssi,sac,spa) AS env_max, {rnd('coalesce(sssi,0)+sac+spa')} AS env_sum,
 {rnd('(coalesce(sssi,0)+sac+spa)/CASE WHEN sssi IS NULL THEN 2 ELSE 3 END')} AS env_mean,
 CASE least(sssi,sac,spa) WHEN sac THEN 'sac' WHEN spa THEN 'spa' ELSE 'sssi' END AS env_min_name,
 CASE greatest(sssi,sac,spa) WHEN sac THEN 'sac' WHEN spa THEN 'spa' ELSE 'sssi' END AS env_max_name FROM a""",
)
def _(t):
    key = F.col("p_partkey")
    a = t.read("part").select(key, F.when(key % 5 != 0, F.col("p_size").cast("double")).alias("sssi"), (key % 40).cast("double").alias("sac"), (F.col("p_retailprice") / 50).alias("spa"))
    out = shape.rowwise(a, ["sssi", "sac", "spa"], "env").drop("sssi", "sac", "spa")
    return rounded(out, ["env_sum", "env_mean"])


_SCORED = "scored AS (SELECT *, CAST(duration_days+(site_id*17)%101-45 AS DOUBLE) AS predicted, CASE WHEN capacity_mw<10 THEN 'small' WHEN capacity_mw<25 THEN 'mid' ELSE 'large' END AS band FROM sites)"


def scored(t):
    cap = F.col("capacity_mw")
    return t.sites.withColumns({
        "predicted": (F.col("duration_days") + (F.col("site_id") * 17) % 101 - 45).cast("double"),
        "band": F.when(cap < 10, "small").when(cap < 25, "mid").otherwise("large"),
    })


_E = "(predicted-duration_days)"


@query(
    "ag21_error_metrics",
    f"""{S}, {_SCORED} SELECT band, count(*) AS n, {rnd(f'sqrt(avg({_E}*{_E}))')} AS rmse, {rnd(f'avg(abs({_E}))')} AS mae,
 {rnd(f'1-sum({_E}*{_E})/(var_pop(duration_days)*count(*))', 6)} AS r2, {rnd(f'avg(abs({_E}/duration_days))*100')} AS mape, {rnd(f'avg({_E})')} AS bias FROM scored GROUP BY band""",
)
def _(t):
    out = pf.metrics_by(scored(t), ["band"], "duration_days", "predicted")
    return rounded(out, {"rmse": 4, "mae": 4, "r2": 6, "mape": 4, "bias": 4})


@query(
    "ag22_interval_calibration",
    f"""{S}, {_SCORED}, c AS (SELECT count(*) n, avg((duration_days BETWEEN predicted-40 AND predicted+30+capacity_mw)::INT) coverage,
 avg((duration_days<predicted-40)::INT) below_low, avg((duration_days<predicted+30+capacity_mw)::INT) below_high, avg(70+capacity_mw) w FROM scored)
SELECT n, {rnd('coverage', 6)} AS coverage, {rnd('below_low', 6)} AS below_low, {rnd('below_high', 6)} AS below_high, {rnd('w')} AS mean_width, coverage BETWEEN 0.7 AND 0.9 AS passes FROM c""",
)
def _(t):
    s = scored(t).withColumns({"lo": F.col("predicted") - 40, "hi": F.col("predicted") + 30 + F.col("capacity_mw")})
    return rounded(pf.interval_calibration(s, "duration_days", "lo", "hi"), {"coverage": 6, "below_low": 6, "below_high": 6, "mean_width": 4})


def _describe_sql(column: str, where: str) -> str:
    parts = {"n": f"count({column})", "mean": f"avg({column})", "std": f"stddev_samp({column})", "min": f"min({column})", "max": f"max({column})"}
    return " UNION ALL ".join(f"SELECT '{column}' AS col, '{s}' AS stat, CAST({e} AS DOUBLE) AS v FROM sites WHERE {where}" for s, e in parts.items())


@query(
    "ag23_compare_profiles",
    f"""{S}, a AS ({_describe_sql('capacity_mw', 'granted=1')} UNION ALL {_describe_sql('duration_days', 'granted=1')}),
b AS ({_describe_sql('capacity_mw', 'granted=0')} UNION ALL {_describe_sql('duration_days', 'granted=0')})
SELECT a.col AS "column", a.stat, {rnd('a.v')} AS value_a, {rnd('b.v')} AS value_b, {rnd('abs(a.v-b.v)')} AS difference, abs(a.v-b.v)>1 AS flagged FROM a JOIN b ON a.col=b.col AND a.stat=b.stat""",
)
def _(t):
    s = t.sites
    out = pf.compare_profiles(s.filter("granted = 1"), s.filter("granted = 0"), ["capacity_mw", "duration_days"])
    return rounded(out, ["value_a", "value_b", "difference"])


@query(
    "ag24_column_profile",
    f"""WITH p AS (SELECT CASE WHEN o_orderkey%9=0 THEN -1 ELSE o_orderkey%5 END AS km, CASE WHEN o_orderkey%4=0 THEN NULL ELSE o_totalprice END AS mw, 0 AS empty FROM orders)
SELECT 'km' AS "column", {rnd('avg((km IS NULL OR km IN (-1,999,9999))::INT)*100')} AS missing_pct, count(*) FILTER (km=0) AS zeros, count(*) FILTER (km=0)=count(*) AS all_zero FROM p
UNION ALL SELECT 'mw', {rnd('avg((mw IS NULL OR mw IN (-1,999,9999))::INT)*100')}, count(*) FILTER (mw=0), count(*) FILTER (mw=0)=count(*) FROM p
UNION ALL SELECT 'empty', {rnd('avg((empty IS NULL OR empty IN (-1,999,9999))::INT)*100')}, count(*) FILTER (empty=0), count(*) FILTER (empty=0)=count(*) FROM p""",
)
def _(t):
    key = F.col("o_orderkey")
    p = t.read("orders").select(F.when(key % 9 == 0, -1).otherwise(key % 5).alias("km"), F.when(key % 4 != 0, F.col("o_totalprice")).alias("mw"), F.lit(0).alias("empty"))
    return rounded(pf.column_profile(p, ["km", "mw", "empty"]), ["missing_pct"])


@query(
    "ag25_frequency_table",
    f"""SELECT p_type, count(*) AS n, {rnd('count(*)*100e0/(SELECT count(*) FROM part)')} AS pct FROM part GROUP BY p_type""",
)
def _(t):
    return rounded(pf.frequency_table(t.read("part"), ["p_type"]), ["pct"])


@query(
    "ag25_counts_by_year_band",
    f"{S} SELECT CAST(year(submission_date) AS INTEGER) AS yr, CASE WHEN capacity_mw>=25 THEN 'large' WHEN capacity_mw>=5 THEN 'mid' ELSE 'small' END AS size_band, count(*) AS n FROM sites GROUP BY 1,2",
)
def _(t):
    size = wn.band(F.col("capacity_mw"), [0, 5, 25], ["small", "mid", "large"])
    return t.places.groupBy(F.year("submission_date").alias("yr"), size.alias("size_band")).agg(F.count(F.lit(1)).alias("n"))


def _band_sql(level: str, group: str) -> str:
    return f"""SELECT lpa, {level} AS level, count(*) AS n, {rnd('avg(duration_days)')} AS mean, {rnd('stddev_samp(duration_days)')} AS std,
 {rnd('median(duration_days)')} AS median, min(duration_days) AS min, max(duration_days) AS max FROM scored GROUP BY {group}"""


@query(
    "ag26_group_band_stats",
    f"""{S}, {_SCORED} {_band_sql("'all'", 'lpa')} UNION ALL SELECT * FROM ({_band_sql('band', 'lpa, band')}) WHERE n>=5""",
)
def _(t):
    return rounded(pf.group_band_stats(scored(t), "lpa", "band", "duration_days"), ["mean", "std", "median"])


_CORRS = {"capacity_mw": "capacity_mw", "granted": "granted", "x": "x", "y": "y", "lpa": "lpa"}


@query(
    "ag27_top_correlations",
    f"{S}, c AS (" + " UNION ALL ".join(f"SELECT '{n}' AS feature, corr({e}, duration_days) AS corr FROM sites" for n, e in _CORRS.items())
    + f") SELECT feature, {rnd('corr', 6)} AS corr, {rnd('abs(corr)', 6)} AS abs_corr FROM c ORDER BY abs(corr) DESC LIMIT 3",
)
def _(t):
    s = t.sites.withColumn("constant", F.lit(1.0))
    return rounded(pf.top_correlations(s, "duration_days", [*_CORRS, "constant"], 3), ["corr", "abs_corr"], 6)


@query(
    "ag27_ordered_group_medians",
    f"""{S}, g AS (SELECT lpa, quantile_cont(duration_days,0.5) AS median, avg(duration_days) AS mean, count(duration_days) AS n FROM sites GROUP BY lpa)
SELECT lpa, {rnd('median')} AS median, {rnd('mean')} AS mean, n, row_number() OVER (ORDER BY median, lpa) AS place FROM g""",
)
def _(t):
    return rounded(pf.ordered_group_medians(t.sites.select("lpa", "duration_days"), "lpa", "duration_days"), ["median", "mean"])


@query(
    "ag28_expert_spread",
    f"""{S}, e AS (SELECT site_id, CAST(site_id%41-20 AS DOUBLE) a, CAST(site_id%59-30 AS DOUBLE) b, CAST(site_id%73-35 AS DOUBLE) c FROM sites), m AS (SELECT *, (a+b+c)/3 mu, greatest(abs(a),abs(b),abs(c)) mx FROM e)
SELECT site_id, {rnd('mu', 6)} AS experts_mean, {rnd('sqrt(((a-mu)*(a-mu)+(b-mu)*(b-mu)+(c-mu)*(c-mu))/3)', 6)} AS experts_std, mx AS experts_max_abs,
 CASE mx WHEN abs(a) THEN 'a' WHEN abs(b) THEN 'b' ELSE 'c' END AS top_expert FROM m""",
)
def _(t):
    k = F.col("site_id")
    e = t.places.select("site_id", *[(k % m - o).cast("double").alias(n) for n, m, o in (("a", 41, 20), ("b", 59, 30), ("c", 73, 35))])
    return rounded(pf.expert_spread(e, ["a", "b", "c"]).drop("a", "b", "c"), ["experts_mean", "experts_std"], 6)


def _stratum_sql(column: str) -> str:
    return f"SELECT '{column}' AS stratum, CAST({column} AS VARCHAR) AS value, count(*) AS n, {rnd(f'sqrt(avg({_E}*{_E}))')} AS rmse FROM scored GROUP BY {column}"


@query("ag29_multi_stratum_metrics", f"{S}, {_SCORED} " + " UNION ALL ".join(_stratum_sql(c) for c in ("band", "lpa", "granted", "tech")))
def _(t):
    return rounded(pf.metrics_by_strata(scored(t), ["band", "lpa", "granted", "tech"], "duration_days", "predicted"), ["rmse"])


@query(
    "tk01_worst_errors",
    f"""{S}, {_SCORED} SELECT site_id, abs({_E}) AS abs_error, CASE WHEN {_E}>0 THEN 'over' ELSE 'under' END AS direction FROM scored ORDER BY abs({_E}) DESC, site_id LIMIT 5""",
)
def _(t):
    error = F.col("predicted") - F.col("duration_days")
    s = scored(t).select("site_id", F.abs(error).alias("abs_error"), F.when(error > 0, "over").otherwise("under").alias("direction"))
    return wn.top_k(s, [F.desc("abs_error"), "site_id"], 5)


@query(
    "tk02_recent_open_references",
    f"""{S}, r AS (SELECT lpa, site_id, submission_date, row_number() OVER (PARTITION BY lpa ORDER BY submission_date DESC, site_id) AS rank
 FROM sites WHERE status='O' AND submission_date>=DATE '2000-01-01') SELECT lpa, site_id, submission_date, CAST(rank AS INTEGER) AS rank FROM r WHERE rank<=15""",
)
def _(t):
    open_sites = t.sites.filter("status = 'O' AND submission_date >= DATE'2000-01-01'").select("lpa", "site_id", "submission_date")
    return wn.top_k_per_key(open_sites, ["lpa"], [F.desc("submission_date"), "site_id"], 15)


@query(
    "tk04_sorted_metrics",
    f"""{S}, {_SCORED}, m AS (SELECT lpa, 1-sum({_E}*{_E})/(var_pop(duration_days)*count(*)) r2 FROM scored GROUP BY lpa)
SELECT lpa, {rnd('r2', 6)} AS r2, CAST(row_number() OVER (ORDER BY {rnd('r2', 6)} DESC, lpa) AS INTEGER) AS position FROM m""",
)
def _(t):
    m = rounded(pf.metrics_by(scored(t), ["lpa"], "duration_days", "predicted").select("lpa", "r2"), ["r2"], 6)
    best_first = m.withColumn("_neg", -F.col("r2"))
    return wn.ordered_position(best_first, [], "_neg", "lpa").select("lpa", "r2", F.col("position").cast("int").alias("position"))


@query(
    "set01_union_workload",
    f"""{S}, {_YEARLY}, u AS (SELECT lpa, yr, load, NULL AS pending FROM yearly UNION ALL SELECT lpa, 2002, count(*), sum((status='P')::INT) FROM sites WHERE submission_date>=DATE '2001-01-01' GROUP BY lpa)
SELECT lpa, count(*) AS periods, CAST(sum(load) AS BIGINT) AS total, {rnd('avg(load)')} AS mean_load, CAST(sum(pending) AS BIGINT) AS pending FROM u GROUP BY lpa""",
)
def _(t):
    quarterly = t.sites.filter("submission_date >= DATE'2001-01-01'").groupBy("lpa").agg(
        F.count(F.lit(1)).alias("load"), F.sum((F.col("status") == "P").cast("int")).alias("pending")
    ).withColumn("yr", F.lit(2002))
    both = _yearly(t).unionByName(quarterly, allowMissingColumns=True)
    out = both.groupBy("lpa").agg(F.count(F.lit(1)).alias("periods"), F.sum("load").alias("total"), F.avg("load").alias("mean_load"), F.sum("pending").alias("pending"))
    return rounded(out, ["mean_load"])


@query("set02_id_difference", "SELECT o_custkey AS c_custkey FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_mktsegment='BUILDING'")
def _(t):
    ordering = t.read("orders").select(F.col("o_custkey").alias("c_custkey"))
    return ordering.subtract(t.read("customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey"))


@query(
    "jn04_match_report",
    f"""WITH a AS (SELECT DISTINCT o_custkey k FROM orders), b AS (SELECT c_custkey k FROM customer WHERE c_acctbal>0), f AS (SELECT a.k ak, b.k bk FROM a FULL JOIN b ON a.k=b.k)
SELECT count(ak) AS ids_a, count(bk) AS ids_b, count(*) FILTER (ak IS NOT NULL AND bk IS NOT NULL) AS shared, count(*) FILTER (bk IS NULL) AS only_a, count(*) FILTER (ak IS NULL) AS only_b,
 {rnd('count(*) FILTER (ak IS NOT NULL AND bk IS NOT NULL)*100e0/count(ak)')} AS match_pct, count(*) FILTER (ak IS NOT NULL AND bk IS NOT NULL)*100e0/count(ak)>=75 AS passes FROM f""",
)
def _(t):
    a = t.read("orders").select(F.col("o_custkey").alias("k"))
    b = t.read("customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    return rounded(match_report(a, b, "k"), ["match_pct"])


@query(
    "set03_combine_regions",
    """SELECT CAST(s_suppkey AS BIGINT) AS id, s_acctbal AS mw, CAST(s_nationkey AS DOUBLE) AS a_km, -1e0 AS b_km FROM supplier
UNION ALL SELECT c_custkey, c_acctbal, -1e0, CAST(c_nationkey AS DOUBLE) FROM customer""",
)
def _(t):
    a = t.read("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("mw"), F.col("s_nationkey").cast("double").alias("a_km"))
    b = t.read("customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("mw"), F.col("c_nationkey").cast("double").alias("b_km"))
    return shape.combine_regions(a, b)
