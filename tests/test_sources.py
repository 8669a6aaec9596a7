"""Readers and writers on files made for the test."""

import json

import pytest
from pyspark.sql import functions as F

from sitegauge.functions.projection import grid_to_lonlat, lonlat_to_grid
from sitegauge.operators import clean, joins, shape
from sitegauge.sources import readers, writers


def test_register_and_stats(spark, tmp_path):
    (tmp_path / "r.csv").write_bytes("Planning Authority,Capacity\nConwy \xe9,5\n".encode("latin-1"))
    got = readers.read_register(spark, str(tmp_path / "r.csv"), {"Planning Authority": "lpa", "Capacity": "mw", "Absent": "gone"}).first()
    assert (got["lpa"], got["mw"], got["gone"]) == ("Conwy é", "5", None)
    (tmp_path / "s.csv").write_text("LPA Name,In-time\nA,..\n")
    row = readers.read_stats(spark, str(tmp_path / "s.csv")).first()
    assert row.asDict() == {"lpa_name": "A", "in_time": None}


def test_geojson(spark, tmp_path):
    outer, hole = [[0, 0], [0, 10], [10, 10], [10, 0], [0, 0]], [[4, 4], [6, 4], [6, 6], [4, 6], [4, 4]]
    features = [
        {"type": "Feature", "properties": {"name": "p"}, "geometry": {"type": "Point", "coordinates": [1, 2]}},
        {"type": "Feature", "properties": {"name": "l"}, "geometry": {"type": "LineString", "coordinates": [[0, 0], [3, 4], [3, 9]]}},
        {"type": "Feature", "properties": {"name": "z"}, "geometry": {"type": "Polygon", "coordinates": [outer, hole]}},
    ]
    (tmp_path / "f.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    f = readers.read_geojson(spark, str(tmp_path / "f.geojson"))
    assert f.count() == 3
    assert [(r["x"], r["y"]) for r in readers.geojson_points(f).collect()] == [(1.0, 2.0)]
    assert readers.geojson_segments(f).agg(F.sum(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")))).first()[0] == 10.0
    e = readers.geojson_edges(f)
    assert e.agg(F.sum((F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")) / 2)).first()[0] == 96.0


def test_shards_and_audit(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    spark.range(2).select(F.col("id").alias("assetId")).write.parquet(a)
    spark.range(3).select(F.col("id").cast("int").alias("assetId"), F.lit(1).alias("Note")).write.parquet(b)
    assert readers.union_shards(spark, [a, b]).columns == ["asset_id", "note"]
    audit = {r["column"]: r["consistent"] for r in readers.schema_audit(spark, [a, b]).collect()}
    assert audit == {"assetId": False, "Note": False}


def test_materialise_builds_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(4)

    path = str(tmp_path / "artifact")
    assert [readers.materialise(spark, path, build).count() for _ in range(2)] == [4, 4]
    assert len(calls) == 1


def test_geojson_by_capacity(spark, tmp_path):
    df = spark.createDataFrame([(1, 5, 0.5, 51.0)], "site_id long, cap int, lon double, lat double")
    features = writers.theme_features(df, "cap", writers.point_geometry(F.col("lon"), F.col("lat")), {"prediction": ["site_id"], "drivers": ["cap"]})
    writers.write_geojson_by_capacity(features, str(tmp_path / "out"))
    text = spark.read.text(str(tmp_path / "out" / "capacity_mw=5" / "theme=prediction")).first()[0]
    assert json.loads(text) == {"type": "Feature", "geometry": {"type": "Point", "coordinates": [0.5, 51.0]}, "properties": {"site_id": 1}}


def test_registry_and_write_table(spark, tmp_path):
    (tmp_path / "reg.json").write_text(json.dumps([{"name": "A", "portal_url": None}, {"name": "B", "portal_url": "https://b"}]))
    assert readers.read_registry(spark, str(tmp_path / "reg.json")).count() == 2
    writers.write_table(spark.range(3), str(tmp_path / "csv"), "csv")
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 3


def test_projection_known_point(spark):
    """A published check point of the national grid, good to a few metres without a shift file."""
    df = spark.createDataFrame([(651409.903, 313177.270)], "e double, n double")
    row = lonlat_to_grid(grid_to_lonlat(df, "e", "n"), "lon", "lat", "x", "y").first()
    assert abs(row["lat"] - 52.657977) < 1e-4 and abs(row["lon"] - 1.716052) < 1e-4
    assert abs(row["x"] - 651409.903) < 0.05 and abs(row["y"] - 313177.270) < 0.05


def test_checks_raise(spark):
    df = spark.createDataFrame([(1, None), (1, 2)], "k int, v int")
    with pytest.raises(ValueError):
        joins.join_one_to_one(df, df, "k")
    with pytest.raises(ValueError):
        joins.expect_no_nulls(df, ["v"])
    with pytest.raises(ValueError):
        joins.expect_row_count(df, 3)
    with pytest.raises(ValueError):
        shape.find_column(df, "nothing")


def test_number_rules(spark):
    df = spark.createDataFrame([("132/33kV", "65%", "40-60%", "Grade 3a", "E01000001x")], "a string, p string, b string, g string, c string")
    row = df.select(clean.max_number("a"), clean.percent_ratio("p"), clean.band_midpoint("b"), clean.grade_digit("g"), clean.area_code("c")).first()
    assert tuple(row) == (132.0, 0.65, 50.0, 3, "E01000001")


def test_reconcile_name(spark):
    df = spark.createDataFrame([("London Borough of Barnet",), ("Barnet Council",), ("City of Barnet",)], "n string")
    assert {r[0] for r in df.select(clean.reconcile_name("n")).collect()} == {"barnet"}
