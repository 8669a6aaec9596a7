"""Readers for registers, statistics, layers and text reports (SRC-*)."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegauge.operators.shape import normalise_columns


def read_register(spark: SparkSession, path: str, mapping: Mapping[str, str], encoding: str = "ISO-8859-1") -> DataFrame:
    """Chosen columns of a register file, all text, under their new names; absent ones null."""
    raw = spark.read.csv(path, header=True, encoding=encoding, multiLine=True, quote='"', escape='"')
    return raw.select([
        (F.col(f"`{old}`") if old in raw.columns else F.lit(None)).cast("string").alias(new) for old, new in mapping.items()
    ])


def read_stats(spark: SparkSession, path: str, null_token: str = "..") -> DataFrame:
    return normalise_columns(spark.read.csv(path, header=True, nullValue=null_token))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """One row per feature: running number, properties map and the geometry as text parts."""
    schema = (
        "features array<struct<properties: map<string,string>, "
        "geometry: struct<type: string, coordinates: string>>>"
    )
    raw = spark.read.schema(schema).json(path, multiLine=True)
    out = raw.select(F.input_file_name().alias("file"), F.posexplode("features").alias("feature_no", "f"))
    return out.select(
        F.xxhash64("file", "feature_no").alias("feature_id"), F.col("f.properties").alias("properties"),
        F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"),
    )


def read_geojson_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same from files with one feature per line, which many tasks can read; partition folders add columns."""
    schema = "properties map<string,string>, geometry struct<type: string, coordinates: string>"
    raw = spark.read.schema(schema).json(path)
    partitions = [c for c in raw.columns if c not in ("properties", "geometry")]
    text = F.to_json(F.struct("properties", "geometry"))
    return raw.select(
        F.xxhash64(text, *partitions).alias("feature_id"), "properties", F.col("geometry.type").alias("kind"),
        F.col("geometry.coordinates").alias("coordinates"), *partitions,
    )


def geojson_points(features: DataFrame) -> DataFrame:
    c = F.from_json("coordinates", "array<double>")
    return features.filter("kind = 'Point'").select("feature_id", "properties", c[0].alias("x"), c[1].alias("y"))


def _ring_edges(df: DataFrame, name: str, keep: Sequence[str]) -> DataFrame:
    """Consecutive coordinate pairs as edges."""
    n = F.size("ring")
    pairs = F.arrays_zip(F.slice("ring", 1, n - 1).alias("a"), F.slice("ring", 2, n - 1).alias("b"))
    out = df.filter(n > 1).select(*keep, F.posexplode(pairs).alias(name, "p"))
    return out.select(*keep, name, F.col("p.a")[0].alias("ax"), F.col("p.a")[1].alias("ay"), F.col("p.b")[0].alias("bx"), F.col("p.b")[1].alias("by"))


def geojson_segments(features: DataFrame) -> DataFrame:
    line = F.from_json("coordinates", "array<array<double>>")
    many = F.from_json("coordinates", "array<array<array<double>>>")
    rings = F.when(F.col("kind") == "LineString", F.array(line)).otherwise(many)
    lines = features.filter("kind IN ('LineString', 'MultiLineString')").select("feature_id", F.posexplode(rings).alias("part_no", "ring"))
    return _ring_edges(lines, "segment_no", ["feature_id", "part_no"])


def geojson_edges(features: DataFrame) -> DataFrame:
    """Ring edges of polygons, outer rings turned counter-clockwise and holes clockwise."""
    one = F.from_json("coordinates", "array<array<array<double>>>")
    many = F.from_json("coordinates", "array<array<array<array<double>>>>")
    polygons = F.when(F.col("kind") == "Polygon", F.array(one)).otherwise(many)
    parts = features.filter("kind IN ('Polygon', 'MultiPolygon')").select("feature_id", F.posexplode(polygons).alias("part_no", "poly"))
    rings = parts.select("feature_id", "part_no", F.posexplode("poly").alias("ring_no", "ring"))
    edges = _ring_edges(rings, "edge_no", ["feature_id", "part_no", "ring_no"])
    area = edges.groupBy("feature_id", "part_no", "ring_no").agg(F.sum((F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")) / 2).alias("_area"))
    edges = edges.join(area, ["feature_id", "part_no", "ring_no"])
    flip = (F.col("_area") < 0) == (F.col("ring_no") == 0)
    ends = {"ax": "bx", "ay": "by", "bx": "ax", "by": "ay"}
    return edges.withColumns({c: F.when(flip, F.col(o)).otherwise(F.col(c)) for c, o in ends.items()}).drop("_area")


def union_shards(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Parquet shards of one asset family, whatever columns each has."""
    out = None
    for path in paths:
        part = normalise_columns(spark.read.parquet(path), camel=True)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def schema_audit(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, column, type) of every shard, with whether all shards agree."""
    rows = [(p, c, t) for p in paths for c, t in spark.read.parquet(p).dtypes]
    out = spark.createDataFrame(rows, "path string, column string, type string")
    per = out.groupBy("column").agg(F.count_distinct("type").alias("types"), F.count_distinct("path").alias("shards"))
    return out.join(per, "column").withColumn("consistent", (F.col("types") == 1) & (F.col("shards") == len(paths)))


def tag_and_unify(layers: Mapping[tuple[str, str, float], DataFrame]) -> DataFrame:
    """Union of layers keyed by (voltage, asset tag, buffer in metres), with those as columns."""
    out = None
    for (voltage, tag, buffer_m), df in layers.items():
        part = df.withColumns({"voltage": F.lit(voltage), "asset_tag": F.lit(tag), "buffer_m": F.lit(float(buffer_m))})
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def read_bbox(segments: DataFrame, x: float, y: float, r: float) -> DataFrame:
    """Segments whose own box meets the window; plain comparisons, so parquet can skip row groups."""
    return segments.filter(
        (F.greatest("ax", "bx") >= x - r) & (F.least("ax", "bx") <= x + r)
        & (F.greatest("ay", "by") >= y - r) & (F.least("ay", "by") <= y + r)
    )


def materialise(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Reuse the finished artifact at ``path``, else build and write it. ``_SUCCESS`` marks it finished."""
    done = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def points_from_wkt(wkt: Column) -> tuple[Column, Column]:
    pattern = r"POINT\s*Z?\s*\(\s*(-?[0-9.eE+]+)\s+(-?[0-9.eE+]+)"
    return tuple(F.regexp_extract(wkt, pattern, i).try_cast("double") for i in (1, 2))


def points_from_latlon_text(text: Column) -> tuple[Column, Column]:
    """('lon', 'lat') from 'lat,lon' text."""
    parts = F.split(text, r"\s*,\s*")
    return F.get(parts, 1).try_cast("double"), F.get(parts, 0).try_cast("double")


def read_registry(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Registry entries from a JSON array, or from one entry per line."""
    return spark.read.json(path, multiLine=not lines)


def parse_stats_text(reports: DataFrame, text: str = "text") -> DataFrame:
    """Sectioned report text to (section, item, metrics) rows.

    A section starts with '== name =='; a line 'item: key=value, key=value' is one row.
    """
    sections = reports.select(F.explode(F.split(text, r"(?m)^== ")).alias("s")).filter(F.col("s").rlike(r"^[^\n]* =="))
    rows = sections.select(
        F.regexp_extract("s", r"^([^\n]*?) ==", 1).alias("section"), F.explode(F.split("s", r"\n")).alias("line")
    ).filter(F.col("line").rlike(r"^[^:=]+: .*="))
    metrics = F.str_to_map(F.regexp_replace(F.regexp_extract("line", r"^[^:]+: (.*)$", 1), r"\s*,\s*", ","), F.lit(","), F.lit("="))
    return rows.select("section", F.regexp_extract("line", r"^([^:]+):", 1).alias("item"), metrics.alias("metrics"))


def sample_features(df: DataFrame, n: int) -> DataFrame:
    return df.limit(n)
