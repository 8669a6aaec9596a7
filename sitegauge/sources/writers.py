"""Writers: tables, code maps, GeoJSON themes and resumable output (SNK-*)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.functions.scalar import fixed


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite").partitionBy(*partition_by)
    writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path)


def skip_completed(todo: DataFrame, done: DataFrame, id: str) -> DataFrame:
    """Rows whose id has not been written yet."""
    return todo.join(done.select(id).distinct(), id, "left_anti")


def geojson_feature(geometry: Column, properties: Sequence[str | Column]) -> Column:
    """One GeoJSON feature as text."""
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties")))


def point_geometry(lon: Column, lat: Column) -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))


def theme_features(df: DataFrame, capacity: str, geometry: Column, themes: Mapping[str, Sequence[str]]) -> DataFrame:
    """(capacity_mw, theme, feature): one feature per row and theme, with that theme's properties."""
    texts = F.array(*[
        F.struct(F.lit(name).alias("theme"), geojson_feature(geometry, columns).alias("feature")) for name, columns in themes.items()
    ])
    return df.select(F.col(capacity).alias("capacity_mw"), F.explode(texts).alias("t")).select("capacity_mw", "t.theme", "t.feature")


# What every styled feature carries beside its rank's colour.
STYLE = {"stroke": "#ffffff", "stroke-width": 1, "fill-opacity": 0.8}


def styled_features(df: DataFrame, capacity: str, id: str, metric: str, geometry: Column, themes: Mapping[str, Sequence[str]]) -> DataFrame:
    """(capacity_mw, theme, feature) with the style of the row's rank in its capacity: fill and marker-colour by quartile,
    stroke, opacity, the quartile's label and rank_percentile to one decimal.

    Lower ``metric`` is better; ties go by id. Rows without the metric have no style, only their theme's properties.
    """
    from sitegauge.operators.windows import rank_style

    known = rank_style(df.filter(F.col(metric).isNotNull()), [capacity], metric, id)
    style = [F.col("colour").alias("fill"), F.col("colour").alias("marker-color"), *[F.lit(v).alias(n) for n, v in STYLE.items()],
             F.col("quartile").alias("rank_label"), fixed("rank_pct", 1).alias("rank_percentile")]

    def texts(extra: Sequence[Column]) -> Column:
        return F.array(*[F.struct(F.lit(name).alias("theme"), geojson_feature(geometry, [*columns, *extra]).alias("feature")) for name, columns in themes.items()])

    parts = [d.select(F.col(capacity).alias("capacity_mw"), F.explode(texts(extra)).alias("t")) for d, extra in ((known, style), (df.filter(F.col(metric).isNull()), []))]
    return parts[0].unionByName(parts[1]).select("capacity_mw", "t.theme", "t.feature")


def write_collections(df: DataFrame, path: str, id: str, geometry: Column, properties: Sequence[str], per_file: int = 1000) -> None:
    """Whole feature collections of about ``per_file`` features a file, dealt by a hash of the id and written by many tasks."""
    files = max(1, -(-df.count() // per_file))
    dealt = df.select(F.pmod(F.xxhash64(id), F.lit(files)).alias("part"), geojson_feature(geometry, properties).alias("feature"))
    texts = dealt.groupBy("part").agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.array_sort(F.collect_list("feature")), ","), F.lit("]}")).alias("value"))
    texts.write.mode("overwrite").partitionBy("part").text(path)


def write_geojson_by_capacity(features: DataFrame, path: str) -> None:
    """Newline-delimited GeoJSON features in a folder per capacity and theme, written by many tasks."""
    features.select("capacity_mw", "theme", F.col("feature").alias("value")).write.mode("overwrite").partitionBy("capacity_mw", "theme").text(path)


def flatten_dossier(df: DataFrame, capacities: Sequence[float], drivers: int = 3, allow: Sequence[str] | None = None) -> DataFrame:
    """Nested dossier to flat properties: days to one decimal, probabilities to three."""
    def days_at(c: float) -> Column:
        return F.get(F.filter("simulations", lambda s: s["capacity_mw"] == float(c)), F.lit(0))["days"]

    flat = df.select(
        "identity.*", "headline.*",
        F.col("uncertainty.interval")[0].alias("p10_days"), F.col("uncertainty.interval")[1].alias("p90_days"),
        *[F.col("uncertainty.regimes")[r].alias(f"error_prob_{r}") for r in ("under", "accurate", "over")],
        *[
            F.get(F.col("drivers"), F.lit(i))[part].alias(f"driver_{i + 1}_{part}")
            for i in range(drivers) for part in ("feature", "impact")
        ],
        *[
            days_at(c).alias(f"sim_{str(c).replace('.', '_')}mw_days") for c in capacities
        ],
    )
    digits = {c: 3 if "prob" in c else 1 for c, t in flat.dtypes if t == "double" and not c.endswith(("lon", "lat", "_mw"))}
    flat = flat.withColumns({c: F.round(c, d) for c, d in digits.items()})
    return flat.select(*[c for c in flat.columns if c in allow]) if allow else flat
