"""Authority profiles on small hand-made tables with known answers."""

from pyspark.sql import functions as F

from sitegauge.operators import nearest, profiles, quantiles, windows


def test_yearly_load(spark):
    loads = spark.createDataFrame([("LPA1", 2020, 100), ("LPA1", 2021, 120)], "lpa string, yr int, load int")
    quarters = spark.createDataFrame([("LPA1", "2022 Q1", 30), ("LPA1", "2022 Q2", 40)], "lpa string, quarter string, load int")
    late = quarters.groupBy("lpa", F.split_part("quarter", F.lit(" "), F.lit(1)).cast("int").alias("yr")).agg(F.sum("load").cast("int").alias("load"))
    both = loads.unionByName(late)
    row = both.groupBy("lpa").agg(F.avg("load").alias("mean"), F.sum("load").alias("total")).first()
    assert round(row["mean"], 2) == 96.67 and row["total"] == 290


def test_approval_rate_null_on_zero(spark):
    df = spark.createDataFrame([("LPA1", 2, 3), ("LPA1", 1, 2), ("LPA2", 0, 0)], "lpa string, ok int, n int")
    got = {r["lpa"]: r["rate"] for r in profiles.rates_by_group(df, ["lpa"], {"rate": (F.col("ok"), F.col("n"))}).collect()}
    assert got == {"LPA1": 0.6, "LPA2": None}


def test_duration_profile(spark):
    df = spark.createDataFrame([("LPA1", d, g) for d, g in ((10, 1), (20, 0), (30, 1), (14, 1))], "lpa string, days int, granted int")
    assert abs(profiles.duration_profile(df, ["lpa"], "days").first()["days_p90"] - 27.0) < 1e-9
    ratio = profiles.ratio_by_outcome(df, ["lpa"], F.col("granted") == 1, "days").first()["days_ratio"]
    assert abs(ratio - 0.9) < 1e-9


def test_precedents_within_radius(spark):
    past = spark.createDataFrame([(1, 500000, 100000, 1), (2, 505000, 100000, 0), (3, 510000, 100000, 1)], "pid long, x long, y long, granted int")
    site = spark.createDataFrame([(9, 500000, 100000)], "site_id long, x long, y long")
    near = nearest.knn(site, past, 3, id="pid", attrs=["granted"])
    assert near.filter("distance <= 10000").count() == 3
    rate = near.agg(nearest.inverse_distance(F.col("granted"), F.col("distance"), 1)).first()[0]
    assert abs(rate - 1.0) < 1e-6


def test_exact_quantiles_of_a_hot_skewed_group(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    values = np.concatenate([rng.lognormal(3, 2, 30000), np.full(10000, 7.0), [1e12]])
    df = spark.createDataFrame([(int(i % 3 == 0), float(v)) for i, v in enumerate(values)], "g int, v double")
    got = {r["g"]: (r["p2"], r["p50"], r["p98"]) for r in quantiles.group_quantiles(df, ["g"], "v", [0.02, 0.5, 0.98]).collect()}
    for g in (0, 1):
        part = [v for i, v in enumerate(values) if int(i % 3 == 0) == g]
        assert np.allclose(got[g], np.quantile(part, [0.02, 0.5, 0.98]))


def test_ordered_position_with_ties_filling_a_third(spark):
    rows = [(i, 5.0 if i % 3 == 0 else float(i * 7919 % 1013)) for i in range(6000)]
    got = windows.ordered_position(spark.createDataFrame(rows, "id long, s double"), [], "s", "id").collect()
    want = {i: n + 1 for n, (i, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    assert {r["id"]: r["position"] for r in got} == want
    assert {r["group_size"] for r in got} == {6000}


def test_pick_optimal(spark):
    rows = [(1, 5.0, 200.0), (1, 10.0, 290.0), (1, 15.0, 310.0), (2, 5.0, 400.0), (2, 10.0, 350.0)]
    got = windows.pick_optimal(spark.createDataFrame(rows, "id int, mw double, days double"), "id", "mw", "days").collect()
    assert {tuple(r) for r in got} == {(1, 10.0, 290.0), (2, 10.0, 350.0)}


def test_trailing_window_excludes_today(spark):
    rows = [(1, "2020-01-01"), (2, "2020-01-01"), (3, "2020-06-29"), (4, "2020-06-30")]
    df = spark.createDataFrame(rows, "id int, d string").select("id", F.lit("A").alias("lpa"), F.to_date("d").alias("submission_date"))
    got = {r["id"]: r["queue_depth"] for r in windows.queue_depth(df).collect()}
    assert got == {1: 0, 2: 0, 3: 2, 4: 1}


def test_quantiles_of_a_whole_column(spark):
    df = spark.range(20000).select(((F.col("id") * 7919) % 10007).cast("double").alias("v"))
    out = quantiles.group_quantiles(df, [], "v", [0.25, 0.9])
    assert "Cartesian" not in out._jdf.queryExecution().toString()
    want = df.agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.9)))).first()[0]
    assert all(abs(a - b) < 1e-9 for a, b in zip(out.first(), want, strict=True))


def test_quantiles_without_values_and_of_nan(spark):
    df = spark.createDataFrame([("a", None), ("b", float("nan")), ("b", float("nan"))], "g string, v double")
    assert quantiles.group_quantiles(df.filter("v is null"), [], "v", [0.5]).first()["p50"] is None
    rows = quantiles.group_quantiles(df, ["g"], "v", [0.5]).collect()
    assert [r["g"] for r in rows] == ["b"] and rows[0]["p50"] != rows[0]["p50"]


def test_rows_of_null_groups_stay(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else "g", float(i)) for i in range(30)], "id long, g string, v double")
    ranked = windows.ordered_position(df, ["g"], "v", "id").collect()
    assert len(ranked) == 30 and sorted(r["position"] for r in ranked if r["g"] is None) == list(range(1, 11))
    kept = windows.trim_by_group(df, "g", "v").filter("g is null").count()
    assert kept == 10
