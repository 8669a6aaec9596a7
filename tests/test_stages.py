"""Positions, quantiles, model stages, explanations and file layers on small and awkward tables."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from sitegauge.operators import chain, clean, feature_space, models, nearest, profiles, quantiles, windows
from sitegauge.operators.ranges import numbered
from sitegauge.session import shared_scratch
from sitegauge.sources import readers, writers


@pytest.mark.parametrize("broadcast", [0, 20_000])
def test_positions_in_groups(spark, monkeypatch, broadcast):
    from sitegauge.operators import ranges

    monkeypatch.setattr(ranges, "BROADCAST_RANGES", broadcast)
    rng = random.Random(1)
    rows = [(k, "hot" if k % 3 else rng.choice(["a", "b", None, ""]), rng.choice([None, 1.0, 2.0, float(k)])) for k in range(900)]
    df = spark.createDataFrame(rows, "id long, g string, v double").repartition(7)
    got = numbered(df, ["g"], ["v", "id"], "at", "n").collect()
    for g in {r[1] for r in rows}:
        mine = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
        assert sorted((r["at"], r["id"], r["n"]) for r in got if r["g"] == g) == [(k, r[0], len(mine)) for k, r in enumerate(mine)]
    assert numbered(df.limit(0), ["g"], ["v"]).count() == 0


def test_ranks_are_joined_by_range(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("g"), (F.col("id") % 50).alias("v"))
    plan = windows.rank_style(df, ["g"], "v", "id")._jdf.queryExecution().executedPlan().toString()
    assert "__task" in plan and "Window" not in plan


def test_quantiles_keep_null_groups(spark):
    rows = [(None if k % 4 == 0 else f"g{k % 4}", float(k)) for k in range(400)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r["p50"] for r in quantiles.group_quantiles(df, ["g"], "v", [0.5]).collect()}
    assert got == {g: float(np.quantile([v for h, v in rows if h == g], 0.5)) for g in {g for g, _ in rows}}
    assert {r["g"] for r in profiles.shrunk_stats(df, "g", "v").collect()} == {None, "g1", "g2", "g3"}
    oof = df.withColumns({"actual": F.col("v"), "guess": F.col("v") - 1})
    assert models.interval_by_band(oof, oof, "actual", "guess", "g").filter("p10 IS NULL").count() == 0


def test_codes_and_one_hot(spark):
    df = spark.createDataFrame([("b", None), ("a", "x"), (None, "x"), ("b", "y")], "p string, q string")
    assert {tuple(r) for r in clean.code_map(df, ["p", "q"]).collect()} == {("p", "a", 0), ("p", "b", 1), ("p", "missing", 2), ("q", "missing", 0), ("q", "x", 1), ("q", "y", 2)}
    with pytest.raises(ValueError):
        clean.one_hot(df, "p")
    assert clean.one_hot(df, "p", max_cardinality=1).columns == ["q"]
    assert clean.one_hot(df, "p", max_cardinality=2).columns == ["q", "p_a", "p_b"]


def test_nearest_rows_are_exact():
    rng = np.random.default_rng(3)
    b = np.concatenate([rng.normal(size=(300, 9)), np.repeat(rng.normal(size=(1, 9)), 20, axis=0) + rng.normal(size=(20, 9)) * 1e-9, np.full((5, 9), 1e6)])
    a = np.concatenate([b[::7], rng.normal(size=(30, 9)), np.full((1, 9), 1e6)])
    for k in (1, 4, 50, 1000):
        row, other, distance = feature_space._nearest_rows(a, b, k)
        d = np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2))
        want = np.argsort(d, axis=1, kind="stable")[:, : min(k, len(b))]
        assert other.reshape(len(a), -1).tolist() == want.tolist() and np.array_equal(distance.reshape(len(a), -1), np.take_along_axis(d, want, axis=1))
        assert row.tolist() == np.repeat(np.arange(len(a)), min(k, len(b))).tolist()


def test_vectors_are_filled_with_exact_medians(spark):
    rows = [(k, [float(k % 7), None if k % 3 == 0 else float(k)]) for k in range(40)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {r["id"]: r["z"] for r in feature_space.standardise_vectors(df, df, "v").collect()}
    known = [v[1] for _, v in rows if v[1] is not None]
    filled = np.array([np.median(known) if v[1] is None else v[1] for _, v in rows])
    assert all(abs(got[k][1] - (filled[k] - filled.mean()) / filled.std()) < 1e-9 for k in range(40))


def _line(spark, n=120):
    rng = random.Random(5)
    rows = [(k, k % 11, rng.uniform(0, 10), rng.uniform(-5, 5), None if k % 17 == 0 else rng.uniform(0, 1)) for k in range(n)]
    df = spark.createDataFrame(rows, "id long, g int, a double, b double, c double")
    return df.withColumn("days", 3 * F.col("a") - 2 * F.col("b") * F.col("a") + F.coalesce("c", F.lit(0.5)) + 20)


@pytest.mark.parametrize("masks", [chain.MASKS, 2])
def test_surrogate_sums_to_the_prediction(spark, monkeypatch, masks):
    monkeypatch.setattr(chain, "MASKS", masks)
    df, names = _line(spark).fillna({"c": 0.5}), ["a", "b", "c"]
    model = LinearRegression(featuresCol="_x", labelCol="days", predictionCol="prediction").fit(models.assembler(names, "_x").transform(df))
    out = chain.local_surrogate(model, df, df, names, "id").collect()
    stats = df.agg(*[F.avg(c).alias(c) for c in names]).first()
    values = {r["id"]: r for r in df.collect()}
    assert len(out) == 120
    for r in out:
        days = {c["feature"]: c["days"] for c in r["contributions"]}
        assert abs(sum(days.values()) - (r["prediction"] - r["mean_prediction"])) < 1e-8
        if masks > 2:  # of a linear model each contribution is coefficient times distance from the mean
            for k, c in enumerate(names):
                assert abs(days[c] - model.coefficients[k] * (values[r["id"]][c] - stats[c])) < 1e-6


def test_surrogate_with_one_feature_and_gaps(spark):
    df = _line(spark)
    model = LinearRegression(featuresCol="_x", labelCol="days", predictionCol="prediction").fit(models.assembler(["a"], "_x").transform(df))
    for r in chain.local_surrogate(model, df, df.filter("id < 9").withColumn("a", F.when(F.col("id") != 3, F.col("a"))), ["a"], "id").collect():
        assert abs(r["contributions"][0]["days"] - (r["prediction"] - r["mean_prediction"])) < 1e-8 and (r["id"] != 3 or abs(r["contributions"][0]["days"]) < 1e-6)


def test_benchmark_widens_and_falls_back(spark):
    past = spark.createDataFrame([(k, float(k % 9), 50.0 + k % 5, "many" if k < 30 else "few", 100.0, 100.0 + k) for k in range(33)], "pid long, lon double, lat double, band string, days double, guess double")
    sites = spark.createDataFrame([(1, 0.0, 50.0, "many"), (2, 0.0, 50.0, "few"), (3, 1.0, 51.0, "new"), (4, 1.0, 51.0, None)], "sid long, lon double, lat double, band string")
    options = {"site": "sid", "id": "pid", "band": "band", "k": 5}
    got = {r["sid"]: r for r in chain.local_benchmark(sites, past, "days", "guess", **options).collect()}
    assert {s: r["rule"] for s, r in got.items()} == {1: "band", 2: "all", 3: "all", 4: "all"} and all(r["n"] == 5 for r in got.values())
    for s, r in got.items():
        x, y, band = next((a.lon, a.lat, a.band) for a in sites.collect() if a.sid == s)
        pool = [p for p in past.collect() if p.band == band or got[s]["rule"] == "all"]
        arc = lambda p, x=x, y=y: 2 * 6371 * math.asin(math.sqrt(math.sin(math.radians(p.lat - y) / 2) ** 2 + math.cos(math.radians(y)) * math.cos(math.radians(p.lat)) * math.sin(math.radians(p.lon - x) / 2) ** 2))
        best = sorted(pool, key=lambda p: (round(arc(p), 6), p.pid))[:5]
        assert abs(r["mae"] - sum(p.guess - p.days for p in best) / 5) < 1e-6
    none = chain.local_benchmark(sites, past.withColumn("guess", F.lit(None).cast("double")), "days", "guess", **options).collect()
    assert all((r["n"], r["rmse"], r["mae"], r["rule"]) == (0, 45.0, 35.0, "none") for r in none)


def test_stage_never_sees_its_own_fold(spark):
    df = models.assembler(["a", "b"], "_x").transform(_line(spark))
    fit = LinearRegression(featuresCol="_x", labelCol="days", predictionCol="_said").fit
    both = chain.folded(df.filter("id < 100"), df.filter("id >= 100").withColumn("days", F.lit(None).cast("double")), "g", 3)
    plain = {r["id"]: (r["fold"], r["out"]) for r in chain.stage(both, fit, F.col("_said"), "out", 3).collect()}
    shifted = both.withColumn("days", F.when(F.col("fold") == 1, F.col("days") * 50 - 9).otherwise(F.col("days")))
    other = {r["id"]: r["out"] for r in chain.stage(shifted, fit, F.col("_said"), "out", 3).collect()}
    assert all((abs(plain[i][1] - other[i]) < 1e-9) == (plain[i][0] == 1) for i in plain)
    assert all(plain[i][0] == -1 for i in range(100, 120))
    gated = {r["id"]: (r["a"], r["out"]) for r in chain.stage(both, fit, F.col("_said"), "out", 3, learn="a > 99", gate="a > 5").collect()}
    assert all(v == 0 for _, v in gated.values())  # nothing to learn from
    gated = {r["id"]: (r["a"], r["out"]) for r in chain.stage(both, fit, F.col("_said"), "out", 3, learn="a > 5", gate="a > 5").collect()}
    assert all((v != 0) == (a > 5) for a, v in gated.values())


def test_search_reports_every_trial(spark):
    df = _line(spark).withColumn("fold", (F.col("id") % 3).cast("int"))
    out = chain.halving_search(df, ["a", "b", "c"], "days", "fold", depths=[1, 3], steps=[0.1, 0.3], folds=3, rounds=4).collect()
    seen = {r["trial"]: r["folds_seen"] for r in out}
    assert sorted(seen.values()) == [1, 1, 2, 3] and len(out) == 16 and sum(r["chosen"] for r in out) == 1
    assert all(r["best_round"] == min((x["rmse"], x["round"]) for x in out if x["trial"] == r["trial"])[1] for r in out)


def test_reconciliation_and_medians(spark):
    a = spark.createDataFrame([("x", 5), ("x", 1), (None, 2), ("z", 3)], "k string, v long")
    b = spark.createDataFrame([("x", 4), ("y", 2), (None, 0)], "k string, v long")
    got = {tuple(r) for r in profiles.reconciliation_deltas(a, b, ["k"], "v").collect()}
    assert got == {("x", 6, 4, 2, 0.5), (None, 2, 0, 2, None), ("z", 3, 0, 3, None), ("y", 0, 2, -2, -1.0)}
    df = spark.createDataFrame([("a", 5.0), ("a", 7.0), ("b", 1.0), (None, 2.0), ("c", None)], "g string, v double")
    assert [(r["g"], r["median"], r["place"]) for r in profiles.ordered_group_medians(df, "g", "v").orderBy("place").collect()] == [("b", 1.0, 1), (None, 2.0, 2), ("a", 6.0, 3), ("c", None, 4)]


def test_importance_risers_and_fingerprints(spark):
    old = spark.createDataFrame([("a", 0.5), ("b", 0.3)], "feature string, importance double")
    new = spark.createDataFrame([("b", 0.4), ("c", 0.3)], "feature string, importance double")
    assert [(r["feature"], round(r["change"], 6)) for r in models.importance_risers(old, new, 2).collect()] == [("c", 0.3), ("b", 0.1)]
    df = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "id long, t string")
    whole = models.fingerprint(df, ["id", "t"]).first()
    assert whole == models.fingerprint(df.orderBy(F.desc("id")), ["id", "t"]).first()
    assert whole != models.fingerprint(df.fillna("-"), ["id", "t"]).first() and models.fingerprint(df.limit(0), ["id", "t"]).first()["n"] == 0


def test_count_among_nearest(spark):
    sites = spark.createDataFrame([(1, 0.0, 0.0, "2000-06-01")], "sid long, x double, y double, d string").withColumn("d", F.to_date("d"))
    items = spark.createDataFrame([(k, float(k), 0.0, 1998 + k) for k in range(10)], "pid long, x double, y double, year int")
    assert tuple(nearest.count_in_years(sites, items, 6, 3, date="d", item_year="year", site="sid", id="pid").first()) == (1, 6, 3)


def test_styles_and_collections(spark):
    df = spark.createDataFrame([(k, 5, None if k == 4 else float(k)) for k in range(5)], "id long, cap int, days double")
    out = writers.styled_features(df, "cap", "id", "days", writers.point_geometry(F.lit(1.0), F.lit(2.0)), {"t": ["id", "days"]}).collect()
    found = {(f := json.loads(r["feature"]))["properties"]["id"]: f["properties"] for r in out}
    assert [found[k].get("rank_percentile") for k in range(5)] == [0.0, 25.0, 50.0, 75.0, None]
    assert found[0]["fill"] == "#2ecc71" and found[0]["stroke-width"] == 1 and "fill" not in found[4]
    path = f"{shared_scratch(spark)}/collections"
    many = spark.range(25).select("id", F.lit("a\"b").alias("name"))
    line = F.struct(F.lit("LineString").alias("type"), F.array(F.array(F.col("id") * 1.0, F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)), F.array(F.lit(2.0), F.lit(0.0))).alias("coordinates"))
    writers.write_collections(many, path, "id", line, ["id", "name"], per_file=6)
    back = readers.read_geojson(spark, path)
    assert back.count() == 25 and back.filter("properties['name'] = 'a\"b'").count() == 25 and readers.geojson_segments(back).count() == 50


def test_equal_scenarios_beyond_the_threshold(spark):
    """Of equally long scenarios the largest is told, whichever way the rows come, and its own drivers with it."""
    from sitegauge.operators import dossier as ds

    rows = [(1, float(c), 400.0, f"d{c}") for c in (5, 50, 20, 1)] + [(2, 5.0, 200.0, "d5"), (2, 50.0, 400.0, "d50"), (3, 5.0, 310.0, "d5"), (3, 50.0, 400.0, "d50")]
    for some in (rows, rows[::-1]):
        df = spark.createDataFrame(some, "site_id long, cap double, days double, why string").repartition(3)
        df = df.selectExpr("*", "0D AS lon", "0D AS lat", "days - 1 AS p10", "days + 1 AS p90", "0.2D AS p_over")
        told = ds.assemble(df, "site_id", "cap", "days", lon="lon", lat="lat", p10="p10", p90="p90", regimes=["p_over"], drivers="why")
        got = {r["site_id"]: (r["headline"]["optimal_capacity_mw"], r["drivers"]) for r in told.collect()}
        assert got == {1: (50.0, "d50"), 2: (5.0, "d5"), 3: (5.0, "d5")}
        assert df.groupBy("site_id").agg(F.max_by("why", ds.preference("cap", "days"))).count() == 3
