"""Queries over model and scoring operators (ML-*, JN-27)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitegauge.operators import chain as ch
from sitegauge.operators import dossier as ds
from sitegauge.operators import feature_space as sp
from sitegauge.operators import models as ml
from sitegauge.operators import nearest as nr
from sitegauge.operators import profiles as pf
from sitegauge.operators import windows as wn
from sitegauge.operators.clean import expand_scenarios
from sitegauge.plans.bindings import CAPACITIES, rnd, rounded, with_ctes
from sitegauge.plans.profiles import scored
from sitegauge.plans.registry import query
from sitegauge.sources import writers

S = with_ctes("sites")
FEATURES = ["capacity_mw", "month", "lpa", "grid_km", "slope", "tech_code"]


def matrix(t):
    """Model matrix with a learnable duration: a known function of the measures plus a key-derived spread."""
    key = F.col("site_id")
    s = t.sites.select(
        "site_id", "lpa", "capacity_mw", F.month("submission_date").alias("month"), "submission_date", "granted",
        (key % 89 / 10.0).alias("grid_km"), (key % 31 / 2.0).alias("slope"), F.substring("tech", 1, 1).cast("int").alias("tech_code"),
    )
    days = 90 + 4 * F.col("capacity_mw") + 12 * F.col("grid_km") + F.when(F.col("lpa") % 5 == 0, 60).otherwise(0) + F.col("slope") * 2 + key * 31 % 61
    return s.withColumns({
        "days": days.cast("double"), "band": F.when(F.col("capacity_mw") < 10, "small").when(F.col("capacity_mw") < 25, "mid").otherwise("large"),
    })


def split(df):
    share = ml.hash_share("site_id")
    return df.filter(share < 0.7), df.filter((share >= 0.7) & (share < 0.85)), df.filter(share >= 0.85)


@query("ml01_impute_columns", None)
def _(t):
    gappy = matrix(t).withColumns({"grid_km": F.when(F.col("site_id") % 4 != 0, F.col("grid_km")), "slope": F.when(F.col("site_id") % 997 == 0, F.col("slope"))})
    filled, _report = ml.impute_columns(gappy, ["grid_km", "slope"], ["capacity_mw", "days", "lpa"], "site_id")
    return filled.select("site_id", "grid_km", "slope")


@query("ml01_imputation_report", None)
def _(t):
    gappy = matrix(t).withColumn("grid_km", F.when(F.col("site_id") % 4 != 0, F.col("grid_km")))
    return ml.impute_columns(gappy, ["grid_km"], ["capacity_mw", "days", "lpa"], "site_id")[1]


def _hash(text, digits):
    return f"CAST('0x'||substr(md5({text}),1,{digits}) AS BIGINT)"


_ML02 = {"capacity_mw": "capacity_mw", "grid_km": "site_id%89/10e0", "slope": "site_id%31/2e0"}


@query(
    "ml02_fit_on_train_transform_all",
    f"""{S}, m AS (SELECT site_id, {', '.join(f'{e} AS {n}' for n, e in _ML02.items())}, {_hash("'split|'||site_id", 8)}/4294967296e0 AS share FROM sites),
f AS (SELECT {', '.join(f'avg({n}) AS m_{n}, stddev_samp({n}) AS s_{n}' for n in _ML02)} FROM m WHERE share<0.7) SELECT site_id, {', '.join(f'{rnd(f"({n}-m_{n})/s_{n}", 6)} AS {n}' for n in _ML02)} FROM m, f""",
)
def _(t):
    from pyspark.ml.functions import vector_to_array

    m = matrix(t)
    out = ml.fit_on_train_transform_all(split(m)[0], m, list(_ML02))
    return rounded(out.select("site_id", *[vector_to_array("features")[i].alias(n) for i, n in enumerate(_ML02)]), list(_ML02), 6)


@query("ml03_compress_tail", None)
def _(t):
    key = F.col("site_id")
    wide = {f"measure_{i}": (key * (31 + 6 * i) % (97 + 10 * i) / 7.0 + F.col(FEATURES[i % len(FEATURES)])) for i in range(30)}
    m = matrix(t).select("site_id", "days", *[F.col(c).cast("double").alias(c) for c in FEATURES], *[c.cast("double").alias(n) for n, c in wide.items()])
    train, names = split(m)[0], [*FEATURES, *wide]
    ranked = [r["feature"] for r in ml.rank_features(train, names, "days").collect()]
    return ml.compress_tail(train, m, ranked, 6, 20)


@query("ml04_project_regimes", None)
def _(t):
    m = matrix(t)
    return ml.project_regimes(split(m)[0], m, ["capacity_mw", "grid_km", "slope", "month", "tech_code"]).select("site_id", "regime")


def _oof(t):
    m = ml.assembler(FEATURES).transform(matrix(t))
    return ml.group_oof(m, "lpa", 5, ml.regressor("days", "prediction").fit, "prediction", "oof").drop("features")


@query("ml05_group_oof", None)
def _(t):
    return _oof(t).select("site_id", "lpa", "days", "oof")


@query("ml06_flag_unlearnable", None)
def _(t):
    return ml.flag_unlearnable(_oof(t), "days", "oof", 45.0).groupBy("unlearnable").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("oof") - F.col("days"))).alias("mean_error"))


COHORTS = {"north": "lpa % 5 = 0", "large": "capacity_mw >= 25"}


@query("ml07_residual_stack", None)
def _(t):
    m = matrix(t)
    train, _, test = split(m)
    out = ml.residual_stack(train, test, FEATURES, "days", COHORTS)
    return out.select("site_id", "days", "base", "head_north", "head_large", "corrector", "prediction")


#: What the chain's stages learn from, beside the cohorts above.
CASCADE = {"cohorts": COHORTS, "band": "band", "bands": ["small", "mid", "large"], "scale": "capacity_mw", "regime_features": ["capacity_mw", "grid_km", "slope"]}


def cascade(t):
    train, validation, test = split(matrix(t).withColumn("family", F.col("site_id") % 60))
    return ch.cascade(train.unionByName(validation), test, FEATURES, "days", "family", **CASCADE)


@query("ml07_gated_cascade", None)
def _(t):
    return cascade(t).select("site_id", "lpa", "family", "fold", "days", "base", "head_north", "head_large", "risk", "expert", "arbiter", "stratified", "corrector", "prediction")


@query("ml08_stratified_models", None)
def _(t):
    m = matrix(t)
    train, _, test = split(m)
    return ml.stratified_models(train, test, FEATURES, "days", "band", ["small", "mid", "large"]).select("site_id", "band", "days", "stratum_prediction")


@query("ml09_catastrophe_classifier", None)
def _(t):
    m = matrix(t).withColumn("error", F.abs(F.col("grid_km") * 12 - 50) + F.col("site_id") % 13)
    train, _, test = split(m)
    return ml.catastrophe_classifier(train, test, FEATURES, "error").select("site_id", "error", "catastrophe_probability")


def _predicted(t):
    s = scored(t)
    return s.withColumn("predicted", F.col("predicted") * 1.0)


@query(
    "ml10_interval_p10_p90",
    f"""{S}, p AS (SELECT site_id, duration_days+(site_id*17)%101-45 AS predicted, duration_days-(duration_days+(site_id*17)%101-45) AS res, CASE WHEN capacity_mw<10 THEN 'small' WHEN capacity_mw<25 THEN 'mid' ELSE 'large' END AS band FROM sites),
q AS (SELECT band, quantile_cont(res,0.1) lo, quantile_cont(res,0.9) hi FROM p GROUP BY band) SELECT site_id, p.band, {rnd('predicted+lo')} AS p10, {rnd('predicted+hi')} AS p90 FROM p JOIN q ON q.band=p.band""",
)
def _(t):
    s = _predicted(t)
    out = ml.interval_by_band(s, s, "duration_days", "predicted", "band")
    return rounded(out.select("site_id", "band", "p10", "p90"), ["p10", "p90"])


@query(
    "ml11_clamp_interval",
    f"""{S}, p AS (SELECT site_id, duration_days*1e0 AS d, duration_days-site_id%40 AS a, duration_days+site_id%90-20 AS b, (site_id%160)*1e0 AS r FROM sites)
SELECT site_id, {rnd('greatest(d-greatest(d-a,greatest(d*0.1,r*0.5)),0)')} AS p10, {rnd('d+greatest(b-d,greatest(d*0.1,r*0.5))')} AS p90 FROM p""",
)
def _(t):
    k, d = F.col("site_id"), F.col("duration_days")
    lo, hi = ds.clamp_interval(d, d - k % 40, d + k % 90 - 20, (k % 160).cast("double"))
    return rounded(t.places.select("site_id", lo.alias("p10"), hi.alias("p90")), ["p10", "p90"])


@query("ml12_terminal_calibrator", None)
def _(t):
    m = matrix(t).withColumn("guess", F.col("days") + F.col("slope") * 14 - 105)
    _, validation, test = split(m)
    return ml.terminal_calibrator(validation, test, FEATURES, "days", "guess").select("site_id", "p_over", "p_accurate", "p_under")


@query(
    "ml13_sample_weights",
    f"""{S}, e AS (SELECT site_id, CASE WHEN site_id%137>=100 THEN 4 WHEN site_id%137>=60 THEN 3 WHEN site_id%137>=30 THEN 2 WHEN site_id%137>=10 THEN 1 ELSE 0 END AS error_bin, greatest(0.1,least(1.0,date_diff('day',submission_date,DATE '2001-12-31')/365e0)) AS m FROM sites),
c AS (SELECT error_bin, count(*) n FROM e GROUP BY 1) SELECT site_id, CAST(e.error_bin AS INTEGER) AS error_bin, {rnd('(SELECT count(*) FROM e)/(5e0*n)', 6)} AS frequency_weight, {rnd('m', 6)} AS maturity_weight, {rnd('(SELECT count(*) FROM e)/(5e0*n)*m', 6)} AS weight FROM e JOIN c ON c.error_bin=e.error_bin""",
)
def _(t):
    s = t.places.select("site_id", (F.col("site_id") % 137).alias("error"), F.datediff(F.lit("2001-12-31").cast("date"), "submission_date").alias("age"))
    out = ml.sample_weights(s, "error", "age", [10, 30, 60, 100]).drop("error", "age")
    return rounded(out, ["frequency_weight", "maturity_weight", "weight"], 6)


@query(
    "ml14_stratified_split",
    f"""{S}, m AS (SELECT site_id, CAST(90+4*capacity_mw+12*(site_id%89/10e0)+CASE WHEN lpa%5=0 THEN 60 ELSE 0 END+site_id%31/2e0*2+site_id*31%61 AS DOUBLE) AS days FROM sites),
q AS (SELECT quantile_cont(days,0.25) AS a, quantile_cont(days,0.5) AS b, quantile_cont(days,0.75) AS c FROM m),
p AS (SELECT site_id, days, (days>a)::INT+(days>b)::INT+(days>c)::INT AS band FROM m, q),
r AS (SELECT site_id, days, row_number() OVER (PARTITION BY band ORDER BY {_hash('CAST(site_id AS VARCHAR)', 15)}, site_id)/CAST(count(*) OVER (PARTITION BY band) AS DOUBLE) AS share FROM p)
SELECT site_id, {rnd('days')} AS days, CASE WHEN share<=0.7e0 THEN 'train' WHEN share<=0.85e0 THEN 'validation' ELSE 'test' END AS split FROM r""",
)
def _(t):
    return rounded(ml.stratified_split(matrix(t).select("site_id", "days"), "site_id", "days"), ["days"])


@query("ml15_tune", None)
def _(t):
    m = matrix(t).withColumn("fold", (F.col("lpa") % 5).cast("int"))
    return ml.tune(m, FEATURES, "days", "fold", [2, 3, 4])


@query("ml15_halving_search", None)
def _(t):
    m = matrix(t).withColumn("fold", (F.col("lpa") % 3).cast("int"))
    return ch.halving_search(m, FEATURES, "days", "fold", depths=[2, 3, 4], steps=[0.1, 0.3], folds=3)


@query("ml16_rank_features", None)
def _(t):
    return ml.rank_features(split(matrix(t))[0], FEATURES, "days")


COEFFICIENTS = {"capacity_mw": 4.0, "grid_km": 12.0, "slope": 2.0, "month": -1.0}
MEANS = {"capacity_mw": 25.0, "grid_km": 4.4, "slope": 7.5, "month": 6.5}


@query(
    "ml17_explain_row",
    f"""{S}, m AS (SELECT site_id, 4*(capacity_mw-25) AS a, 12*(site_id%89/10e0-4.4) AS b, 2*(site_id%31/2e0-7.5) AS c, -1*(month(submission_date)-6.5) AS d FROM sites),
u AS (SELECT site_id, 'capacity_mw' AS feature, a AS days FROM m UNION ALL SELECT site_id, 'grid_km', b FROM m UNION ALL SELECT site_id, 'slope', c FROM m UNION ALL SELECT site_id, 'month', d FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY {rnd('abs(days)')} DESC, feature) AS driver_rank FROM u) SELECT site_id, CAST(driver_rank AS INTEGER) AS driver_rank, feature, {rnd('days')} AS days FROM r WHERE driver_rank<=2""",
)
def _(t):
    parts = {n: F.floor(c * 10000 + 0.5000001) / 10000 for n, c in ds.linear_contributions(COEFFICIENTS, MEANS).items()}
    return wn.top_drivers(matrix(t), "site_id", parts, 2).drop("text")


@query("ml17_local_surrogate", None)
def _(t):
    m = matrix(t).select("site_id", "days", *[F.col(c).cast("double").alias(c) for c in FEATURES])
    train, _, test = split(m)
    model = ml.regressor("days", "prediction", "_x").fit(ml.assembler(FEATURES, "_x").transform(train))
    out = ch.local_surrogate(model, train, test, FEATURES, "site_id")
    return out.select("site_id", "prediction", "mean_prediction", F.inline("contributions"))


@query(
    "ml18_local_benchmark",
    f"""{with_ctes('sites', 'subs')}, e AS (SELECT site_id AS pid, x, y, (site_id*17)%101-45 AS err FROM sites), c AS (SELECT sub_id, err, pid, sqrt((e.x-b.x)*(e.x-b.x)+(e.y-b.y)*(e.y-b.y)) AS d FROM subs b, e QUALIFY row_number() OVER (PARTITION BY sub_id ORDER BY sqrt((e.x-b.x)*(e.x-b.x)+(e.y-b.y)*(e.y-b.y)), pid)<=25)
SELECT sub_id, count(*) AS n, {rnd('sqrt(avg(err*err))')} AS rmse, {rnd('avg(abs(err))')} AS mae FROM c GROUP BY 1""",
)
def _(t):
    errors = t.places.select(F.col("site_id").alias("pid"), "x", "y", ((F.col("site_id") * 17) % 101 - 45).alias("err"), F.lit(0).alias("zero"))
    near = nr.knn(t.substations.select("sub_id", "x", "y"), errors, 25, id="pid", attrs=["err", "zero"])
    out = pf.metrics_by(near, ["sub_id"], "zero", "err").select("sub_id", "n", "rmse", "mae")
    return rounded(out, ["rmse", "mae"])


_BAND = "CASE WHEN capacity_mw<10 THEN 'small' WHEN capacity_mw<40 THEN 'mid' ELSE 'large' END"


@query(
    "ml18_fitted_benchmark",
    f"""{S}, m AS (SELECT site_id, capacity_mw, -6+x/100000*8 AS lon, 50+y/100000*8 AS lat, {_BAND} AS band, CAST(90+4*capacity_mw+12*(site_id%89/10e0)+CASE WHEN lpa%5=0 THEN 60 ELSE 0 END+site_id%31/2e0*2+site_id*31%61 AS DOUBLE) AS days, {_hash("'split|'||site_id", 8)}/4294967296e0 AS share FROM sites),
fit AS (SELECT regr_slope(days, capacity_mw) AS b1, regr_intercept(days, capacity_mw) AS b0 FROM m WHERE share<0.7),
b AS (SELECT site_id AS pid, lon, lat, band, b0+b1*capacity_mw-days AS err FROM m, fit WHERE share>=0.7 AND share<0.85 AND capacity_mw<45), a AS (SELECT site_id, lon, lat, band FROM m WHERE share>=0.85),
sz AS (SELECT band, count(*) AS size FROM b GROUP BY 1),
c AS (SELECT a.site_id, a.band, b.pid, b.err, size, 2*6371*asin(least(1e0,sqrt(pow(sin((radians(b.lat)-radians(a.lat))/2),2)+cos(radians(a.lat))*cos(radians(b.lat))*pow(sin(radians(b.lon-a.lon)/2),2)))) AS km
 FROM a LEFT JOIN sz ON sz.band=a.band JOIN b ON b.band=a.band OR coalesce(size,0)<20 QUALIFY row_number() OVER (PARTITION BY a.site_id ORDER BY km, b.pid)<=20)
SELECT site_id, count(*) AS n, {rnd('sqrt(avg(err*err))')} AS rmse, {rnd('avg(abs(err))')} AS mae, {rnd('avg(km)', 3)} AS mean_km, CASE WHEN coalesce(any_value(size),0)>=20 THEN 'band' ELSE 'all' END AS rule FROM c GROUP BY 1""",
)
def _(t):
    from pyspark.ml.regression import LinearRegression

    m = matrix(t).withColumns({
        "lon": -6 + F.col("site_id") * 7919 % 100000 / 100000 * 8, "lat": 50 + F.col("site_id") * 104729 % 100000 / 100000 * 8,
        "band": F.when(F.col("capacity_mw") < 10, "small").when(F.col("capacity_mw") < 40, "mid").otherwise("large"),
    })
    m = ml.assembler(["capacity_mw"], "_x").transform(m)
    train, validation, test = split(m)
    line = LinearRegression(featuresCol="_x", labelCol="days", predictionCol="predicted", solver="normal").fit(train)
    history = line.transform(validation.filter("capacity_mw < 45")).withColumnRenamed("site_id", "pid")
    out = ch.local_benchmark(test, history, "days", "predicted", site="site_id", id="pid", band="band")
    return rounded(out.select("site_id", "n", "rmse", "mae", "mean_km", "rule"), {"rmse": 4, "mae": 4, "mean_km": 3})


@query("ml19_typological_benchmark", None)
def _(t):
    s = t.sites.select("site_id", "duration_days", "capacity_mw", (F.col("site_id") % 89 / 10.0).alias("grid_km"), ((F.col("site_id") * 17) % 101 - 45 + F.col("duration_days")).alias("predicted"))
    regimes = ml.project_regimes(s, s, ["capacity_mw", "grid_km"], 4)
    return pf.metrics_by(regimes, ["regime"], "duration_days", "predicted")


def simulate(t):
    """Every site under every capacity: features, a linear score, its interval and regimes."""
    base = t.places.select("site_id", "x", "y", F.month("submission_date").alias("month"), (F.col("site_id") % 89 / 10.0).alias("grid_km"), (F.col("site_id") % 31 / 2.0).alias("slope"))
    grid = expand_scenarios(base, CAPACITIES, "capacity_mw")
    parts = ds.linear_contributions(COEFFICIENTS, MEANS)
    days = F.lit(230.0) + parts["capacity_mw"] + parts["grid_km"] + parts["slope"] + parts["month"]
    s = grid.withColumns({"days": F.greatest(days, F.lit(20.0)), "drivers": ds.driver_array(parts, 3)})
    lo, hi = ds.clamp_interval(F.col("days"), F.col("days") - 30, F.col("days") + 45, F.lit(80.0))
    over = F.least(F.lit(0.5), F.col("grid_km") / 20)
    return s.withColumns({"p10": lo, "p90": hi, "p_over": over, "p_accurate": 0.8 - over, "p_under": F.lit(0.2), "lon": F.col("x") / 1000, "lat": F.col("y") / 1000})


def dossiers(t):
    return ds.assemble(simulate(t), "site_id", "capacity_mw", "days", lon="lon", lat="lat", p10="p10", p90="p90", regimes=["p_under", "p_accurate", "p_over"], drivers="drivers")


_SIM = f"""sim AS (SELECT site_id, mw, greatest(230+4*(mw-25)+12*(site_id%89/10e0-4.4)+2*(site_id%31/2e0-7.5)-(month(submission_date)-6.5),20) AS days FROM sites, (SELECT unnest([{','.join(f'{float(c)}e0' for c in CAPACITIES)}]) AS mw))"""


@query(
    "ml20_simulate_grid",
    f"""{S}, {_SIM}, b AS (SELECT site_id, coalesce(max(mw) FILTER (days<=300), arg_min(mw, days)) AS mw FROM sim GROUP BY 1), h AS (SELECT b.site_id, b.mw, s.days FROM b JOIN sim s ON s.site_id=b.site_id AND s.mw=b.mw)
SELECT site_id, mw AS optimal_capacity_mw, {rnd('days', 3)} AS predicted_days, CASE WHEN days<250 THEN 'Green' WHEN days<350 THEN 'Amber' ELSE 'Red' END AS risk_category,
 {rnd('(SELECT count(*) FROM sim s WHERE s.site_id=h.site_id AND s.days<h.days)/14e0', 6)} AS shorter_share, {rnd('greatest(days-greatest(30,greatest(days*0.1,40)),0)', 3)} AS p10, {rnd('days+greatest(45,greatest(days*0.1,40))', 3)} AS p90 FROM h""",
)
def _(t):
    out = dossiers(t).select("site_id", "headline.*", F.col("uncertainty.interval")[0].alias("p10"), F.col("uncertainty.interval")[1].alias("p90"))
    return rounded(out, {"predicted_days": 3, "shorter_share": 6, "p10": 3, "p90": 3})


_DRIVERS = {"capacity_mw": "4*(mw-25)", "grid_km": "12*(site_id%89/10e0-4.4)", "slope": "2*(site_id%31/2e0-7.5)", "month": "-(m-6.5)"}
_R1 = lambda e, d=1: f"round({e}, {d})"


@query(
    "snk05_flatten_dossier",
    f"""{S}, {_SIM}, b AS (SELECT site_id, coalesce(max(mw) FILTER (days<=300), arg_min(mw, days)) AS mw FROM sim GROUP BY 1),
h AS (SELECT b.site_id, b.mw, s.days, x/1000 AS lon, y/1000 AS lat, month(submission_date) AS m, least(0.5,b.site_id%89/10e0/20) AS o FROM b JOIN sim s ON s.site_id=b.site_id AND s.mw=b.mw JOIN sites t ON t.site_id=b.site_id),
p AS (SELECT site_id, list_sort([{', '.join(f"{{'o': -abs({e}), 'f': '{n}', 'd': {e}}}" for n, e in _DRIVERS.items())}]) AS d FROM h)
SELECT h.site_id, lon AS centroid_lon, lat AS centroid_lat, h.mw AS optimal_capacity_mw, {_R1('days')} AS predicted_days, CASE WHEN days<250 THEN 'Green' WHEN days<350 THEN 'Amber' ELSE 'Red' END AS risk_category,
 {_R1('(SELECT count(*) FROM sim s WHERE s.site_id=h.site_id AND s.days<h.days)/14e0')} AS shorter_share, {_R1('greatest(days-greatest(30,greatest(days*0.1,40)),0)')} AS p10_days, {_R1('days+greatest(45,greatest(days*0.1,40))')} AS p90_days,
 {_R1('0.2e0', 3)} AS error_prob_under, {_R1('0.8e0-o', 3)} AS error_prob_accurate, {_R1('o', 3)} AS error_prob_over,
 {', '.join(f"d[{i}].f AS driver_{i}_feature, CASE WHEN d[{i}].d>=0 THEN '+' ELSE '-' END||CAST(round(abs(d[{i}].d)) AS INTEGER)||' days' AS driver_{i}_impact" for i in (1, 2, 3))},
 {', '.join(f"(SELECT {_R1('s.days')} FROM sim s WHERE s.site_id=h.site_id AND s.mw={float(c)}e0) AS sim_{str(c).replace('.', '_')}mw_days" for c in CAPACITIES)}
FROM h JOIN p ON p.site_id=h.site_id""",
)
def _(t):
    return writers.flatten_dossier(dossiers(t), CAPACITIES)


@query("ml21_risk_category", f"{S} SELECT site_id, CASE WHEN duration_days<250 THEN 'Green' WHEN duration_days<350 THEN 'Amber' ELSE 'Red' END AS category FROM sites")
def _(t):
    return t.places.select("site_id", ds.risk_category(F.col("duration_days")).alias("category"))


@query("ml22_variance_filter", "SELECT s_suppkey, s_acctbal FROM supplier")
def _(t):
    s = t.read("supplier").select("s_suppkey", "s_acctbal", F.lit(3.0).alias("constant"))
    return ml.variance_filter(s, ["s_acctbal", "constant"])


_POWER = """CASE WHEN x>=0 THEN CASE WHEN abs(lam)<1e-9 THEN ln(1+abs(x)) ELSE (pow(abs(x)+1,lam)-1)/lam END
 ELSE CASE WHEN abs(lam-2)<1e-9 THEN -ln(1+abs(x)) ELSE -(pow(abs(x)+1,2-lam)-1)/(2-lam) END END"""


@query(
    "ml22_yeo_johnson",
    f"""WITH v AS (SELECT c_custkey, c_acctbal AS x FROM customer), g AS (SELECT i/10e0 AS lam FROM range(-20,41,2) r(i)),
s AS (SELECT lam, -count(*)/2e0*ln(var_pop({_POWER}))+(lam-1)*sum(sign(x)*ln(1+abs(x))) AS likelihood FROM v, g GROUP BY lam),
b AS (SELECT arg_max(lam, likelihood) AS lam FROM s) SELECT c_custkey, x AS c_acctbal, {rnd(_POWER)} AS transformed, lam AS exponent FROM v, b""",
)
def _(t):
    out, lam = ml.yeo_johnson(t.read("customer").select("c_custkey", "c_acctbal"), "c_acctbal", "transformed")
    return rounded(out.withColumn("exponent", F.lit(lam)), ["transformed"])


@query("ml24_ridge_arbiter", None)
def _(t):
    m = matrix(t).withColumns({"expert_a": F.col("days") + F.col("slope") * 3 - 20, "expert_b": F.col("days") * 0.9 + F.col("month"), "expert_c": F.col("capacity_mw") * 5})
    train, validation, test = split(m)
    return ml.ridge_arbiter(train, validation, test, ["expert_a", "expert_b", "expert_c"], "days", [0.01, 1.0, 100.0]).select("site_id", "days", "arbiter")


_GRID1, _GRID2 = [0, 10, 20, 30, 40], [0, 5, 10, 15, 20, 25]


@query(
    "ml25_two_factor_calibrator",
    f"""{S}, p AS (SELECT site_id, (site_id*17)%101-45 AS e, (site_id%20)/20e0 AS po, (site_id*7%20)/20e0 AS pu FROM sites), g AS (SELECT a AS f1, b AS f2 FROM (SELECT unnest([{','.join(f'{v}e0' for v in _GRID1)}]) AS a), (SELECT unnest([{','.join(f'{v}e0' for v in _GRID2)}]) AS b))
SELECT f1, f2, {rnd('sqrt(avg((e+po*f1-pu*f2)*(e+po*f1-pu*f2)))')} AS rmse FROM p, g GROUP BY 1,2""",
)
def _(t):
    k = F.col("site_id")
    s = t.places.select("duration_days", (F.col("duration_days") + (k * 17) % 101 - 45).alias("predicted"), (k % 20 / 20.0).alias("po"), (k * 7 % 20 / 20.0).alias("pu"))
    return rounded(ml.two_factor_grid(s, "duration_days", "predicted", "po", "pu", _GRID1, _GRID2), ["rmse"])


@query(
    "ml25_calibrated_rows",
    f"""{S}, p AS (SELECT site_id, (site_id*17)%101-45 AS e, duration_days+(site_id*17)%101-45 AS predicted, (site_id%20)/20e0 AS po, (site_id*7%20)/20e0 AS pu, {_hash("'split|'||site_id", 8)}/4294967296e0 AS share FROM sites),
g AS (SELECT a AS f1, b AS f2 FROM (SELECT unnest([{','.join(f'{v}e0' for v in _GRID1)}]) AS a), (SELECT unnest([{','.join(f'{v}e0' for v in _GRID2)}]) AS b)),
best AS (SELECT f1, f2 FROM p, g WHERE share>=0.7 AND share<0.85 GROUP BY 1,2 ORDER BY sqrt(avg((e+po*f1-pu*f2)*(e+po*f1-pu*f2))), f1, f2 LIMIT 1)
SELECT site_id, f1 AS factor_over, f2 AS factor_under, {rnd('predicted+po*f1-pu*f2')} AS calibrated FROM p, best WHERE share>=0.85""",
)
def _(t):
    k = F.col("site_id")
    s = t.places.select("site_id", "duration_days", (F.col("duration_days") + (k * 17) % 101 - 45).alias("predicted"), (k % 20 / 20.0).alias("po"), (k * 7 % 20 / 20.0).alias("pu"))
    _, validation, test = split(s)
    out = ml.two_factor_calibrator(validation, test, "duration_days", "predicted", "po", "pu", _GRID1, _GRID2)
    return rounded(out.select("site_id", "factor_over", "factor_under", "calibrated"), ["calibrated"])


@query(
    "ml26_leak_checks",
    """SELECT (SELECT count(*) FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate<TIMESTAMP '2000-01-01' INTERSECT SELECT o_custkey FROM orders WHERE o_orderdate>=TIMESTAMP '2000-01-01')) AS shared""",
)
def _(t):
    o = t.read("orders")
    return ml.shared_keys(o.filter("o_orderdate < DATE'2000-01-01'"), o.filter("o_orderdate >= DATE'2000-01-01'"), "o_custkey")


_ROW = "'='||o_orderkey||'|='||o_totalprice||'|='||o_orderstatus"


@query(
    "ml26_fingerprint",
    f"""WITH h AS (SELECT {_hash(_ROW, 15)} AS a, {_hash(_ROW + "||'|'", 15)} AS b FROM orders WHERE o_orderdate>=TIMESTAMP '2000-01-01')
SELECT count(*) AS n, sha256(count(*)||'|'||sum(CAST(a AS HUGEINT))||'|'||sum(CAST(b AS HUGEINT))) AS fingerprint FROM h""",
)
def _(t):
    return ml.fingerprint(t.read("orders").filter("o_orderdate >= DATE'2000-01-01'"), ["o_orderkey", "o_totalprice", "o_orderstatus"])


@query(
    "ml26_correlation_flags",
    f"""{S}, c AS (SELECT 'copy' AS feature, corr(duration_days*2+x/1000, duration_days) AS r FROM sites UNION ALL SELECT 'capacity_mw', corr(capacity_mw, duration_days) FROM sites UNION ALL SELECT 'half', corr(duration_days+site_id%311, duration_days) FROM sites)
SELECT feature, {rnd('r', 6)} AS corr, {rnd('abs(r)', 6)} AS abs_corr, CASE WHEN abs(r)>0.9 THEN 'fail' WHEN abs(r)>0.7 THEN 'warn' ELSE 'ok' END AS leak FROM c""",
)
def _(t):
    s = t.places.withColumns({"copy": F.col("duration_days") * 2 + F.col("x") / 1000, "half": F.col("duration_days") + F.col("site_id") % 311})
    return rounded(ml.correlation_flags(s, "duration_days", ["copy", "capacity_mw", "half"]), ["corr", "abs_corr"], 6)


@query(
    "ml27_compare_models",
    f"""{S}, g AS (SELECT site_id, abs((site_id*17)%101-45)-abs((site_id*13)%67-30) AS gain FROM sites) SELECT count(*) AS n, {rnd('avg(gain)', 6)} AS mean_gain, {rnd('avg((gain>0)::INT)', 6)} AS improved_share, max(gain) AS best_gain, (SELECT site_id FROM g ORDER BY gain DESC, site_id LIMIT 1) AS best_id FROM g""",
)
def _(t):
    k, d = F.col("site_id"), F.col("duration_days")
    s = t.places.select("site_id", "duration_days", (d + (k * 17) % 101 - 45).alias("old"), (d + (k * 13) % 67 - 30).alias("new"))
    return rounded(ml.compare_models(s, "site_id", "duration_days", "old", "new"), ["mean_gain", "improved_share"], 6)


_RISERS = {"capacity_mw": "capacity_mw", "month": "month(submission_date)", "grid_km": "site_id%89/10e0", "slope": "site_id%31/2e0", "lpa": "lpa", "granted": "granted", "x": "x"}


@query(
    "ml27_importance_risers",
    f"{S}, r AS (" + " UNION ALL ".join(f"SELECT '{n}' AS feature, abs(corr({e}, duration_days) FILTER (year(submission_date)<1998)) AS old, abs(corr({e}, duration_days) FILTER (year(submission_date)>=1998)) AS new FROM sites" for n, e in _RISERS.items())
    + f") SELECT feature, {rnd('old', 6)} AS old, {rnd('new', 6)} AS new, {rnd('new-old', 6)} AS change FROM r ORDER BY new-old DESC, feature LIMIT 5",
)
def _(t):
    key = F.col("site_id")
    s = t.sites.select("lpa", "capacity_mw", "granted", "x", "duration_days", F.month("submission_date").alias("month"), (key % 89 / 10.0).alias("grid_km"), (key % 31 / 2.0).alias("slope"), F.year("submission_date").alias("year"))
    old, new = (pf.top_correlations(d, "duration_days", list(_RISERS), len(_RISERS)).select("feature", F.col("abs_corr").alias("importance")) for d in (s.filter("year < 1998"), s.filter("year >= 1998")))
    return rounded(ml.importance_risers(old, new), ["old", "new", "change"], 6)


@query("ml28_conditional_expert", None)
def _(t):
    m = matrix(t)
    train, _, test = split(m)
    return ml.conditional_expert(train, test, FEATURES, "days", "lpa % 5 = 0").select("site_id", "lpa", "expert")


@query(
    "jn27_feature_space_knn",
    f"""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), c AS (SELECT vec_id, unnest(e) AS x, unnest(range(len(e))) AS i FROM v), st AS (SELECT i, avg(x) AS m, stddev_pop(x) AS s FROM c GROUP BY 1),
z AS (SELECT vec_id, list((x-m)/s ORDER BY c.i) AS z FROM c JOIN st ON st.i=c.i GROUP BY 1), d AS (SELECT a.vec_id, b.vec_id AS nb, list_distance(a.z, b.z) AS d FROM z a, z b WHERE a.vec_id<>b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.z, b.z), b.vec_id)<=15)
SELECT d.vec_id, {rnd('avg(d)')} AS knn_distance, {rnd('avg((nb*31)%400)')} AS knn_target_mean, {rnd('var_samp((nb*31)%400)', 2)} AS knn_target_var, count(DISTINCT v.label) AS knn_groups FROM d JOIN v ON v.vec_id=nb GROUP BY 1""",
)
def _(t):
    e = t.read("embeddings").select("vec_id", "embedding", "label", ((F.col("vec_id") * 31) % 400).alias("target"))
    z = sp.standardise_vectors(e, e, "embedding")
    found = sp.knn(z, z, 15, query_id="vec_id", item_id="vec_id", attrs=["target", "label"])
    return rounded(sp.neighbour_features(found, "vec_id", "target", "label"), {"knn_distance": 4, "knn_target_mean": 4, "knn_target_var": 2})
