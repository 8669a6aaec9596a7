"""Schema-level cleaning: names, column selection, alignment and checks (PRJ-1..3, 9..12, 26, 27)."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.functions.scalar import null_safe_mean


def snake(name: str, camel: bool = False) -> str:
    """Lower-case, runs of other characters to one underscore, a prefix for a leading digit."""
    if camel:
        name = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name)
    name = re.sub(r"[^0-9a-z]+", "_", name.strip().lower()).strip("_")
    return f"c_{name}" if name[:1].isdigit() else name


def normalise_columns(df: DataFrame, camel: bool = False) -> DataFrame:
    return df.toDF(*[snake(c, camel) for c in df.columns])


def find_column(df: DataFrame, pattern: str, strict: bool = True) -> str | None:
    """The one column whose normalised name matches; strict raises on none or several."""
    hits = [c for c in df.columns if re.search(pattern, snake(c))]
    if strict and len(hits) != 1:
        raise ValueError(f"{pattern!r} matches {hits or 'no column'}")
    return hits[0] if hits else None


def rename_by_prefix(df: DataFrame, prefixes: Mapping[str, str]) -> DataFrame:
    renames = {}
    for c in df.columns:
        for old, new in prefixes.items():
            if c.startswith(old):
                renames[c] = new + c[len(old):]
                break
    return df.withColumnsRenamed(renames)


def drop_duplicate_columns(df: DataFrame) -> DataFrame:
    """Keep the first of columns sharing a name."""
    names, seen, keep = [], set(), []
    for i, c in enumerate(df.columns):
        names.append(f"{c}__{i}")
        if c not in seen:
            seen.add(c)
            keep.append((f"{c}__{i}", c))
    return df.toDF(*names).select([F.col(unique).alias(c) for unique, c in keep])


def drop_sparse_columns(df: DataFrame, threshold: float, keep: Iterable[str] = ()) -> DataFrame:
    """Drop columns whose null share exceeds the threshold; one pass measures them all."""
    tested = [c for c in df.columns if c not in set(keep)]
    shares = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in tested]).first().asDict()
    return df.drop(*[c for c in tested if (shares[c] or 0) > threshold])


def drop_sparse_rows(df: DataFrame, threshold: float, features: Sequence[str]) -> DataFrame:
    missing = sum((F.col(c).isNull().cast("int") for c in features), F.lit(0))
    return df.filter(missing <= threshold * len(features))


def purge_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    out = df.drop(*names)
    left = set(out.columns) & set(names)
    if left:
        raise ValueError(f"columns not removed: {sorted(left)}")
    return out


def align_schema(df: DataFrame, header: Mapping[str, str], sentinels: Mapping[str, object] | None = None) -> DataFrame:
    """Exactly the columns of ``header`` (name -> type), in its order; absent ones null or a sentinel."""
    sentinels = sentinels or {}
    out = df.select([
        (F.col(c) if c in df.columns else F.lit(sentinels.get(c))).cast(t).alias(c) for c, t in header.items()
    ])
    if out.columns != list(header):
        raise ValueError("header mismatch")
    return out


def combine_regions(a: DataFrame, b: DataFrame, sentinel: float = -1.0) -> DataFrame:
    """Union of two region tables; numeric columns only one of them has carry the sentinel in the other."""
    numeric = {"int", "bigint", "double", "float", "smallint", "tinyint"}

    def complete(df: DataFrame, other: DataFrame) -> DataFrame:
        absent = [(c, t) for c, t in other.dtypes if c not in df.columns]
        return df.withColumns({c: F.lit(sentinel if t in numeric else None).cast(t) for c, t in absent})

    return complete(a, b).unionByName(complete(b, a))


def coalesce_by_flag(flag: Column, when_true: Column, when_false: Column) -> Column:
    return F.when(flag, when_true).otherwise(when_false)


def contributing_mean(df: DataFrame, token: str, out: str) -> DataFrame:
    """Null-safe mean of every column whose name holds the token."""
    hits = [F.col(c) for c in df.columns if re.search(token, c)]
    return df.withColumn(out, null_safe_mean(hits))


def rowwise(df: DataFrame, columns: Sequence[str], prefix: str) -> DataFrame:
    """Min, max, sum, mean across columns ignoring nulls, and the names of the smallest and largest."""
    cols = [F.col(c) for c in columns]
    named = F.filter(
        F.array(*[F.struct(F.col(c).cast("double").alias("v"), F.lit(c).alias("name")) for c in columns]),
        lambda s: s["v"].isNotNull(),
    )
    low, high = (F.least, F.greatest) if len(cols) > 1 else (lambda c: c, lambda c: c)
    first_of_max = F.array_min(F.transform(named, lambda s: F.struct((-s["v"]).alias("v"), s["name"].alias("name"))))
    return df.withColumns({
        f"{prefix}_min": low(*cols), f"{prefix}_max": high(*cols),
        f"{prefix}_sum": sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0)),
        f"{prefix}_mean": null_safe_mean(cols),
        f"{prefix}_min_name": F.array_min(named)["name"],
        f"{prefix}_max_name": first_of_max["name"],
    })


def decode_one_hot(df: DataFrame, prefix: str, out: str, unknown: str = "Unknown") -> DataFrame:
    """Name of the hottest column with the prefix; ``unknown`` when none is set."""
    hot = [c for c in df.columns if c.startswith(prefix)]
    ranked = F.array_min(F.array(*[
        F.struct((-F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias("v"), F.lit(c[len(prefix):]).alias("name"))
        for c in hot
    ]))
    return df.withColumn(out, F.when(ranked["v"] < 0, ranked["name"]).otherwise(unknown))
