"""Key joins and set checks (JN-1..4, 30, 32, SET-1..3)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000


def sized(df: DataFrame, rows: int) -> DataFrame:
    """``df`` for a join, not to be broadcast where it has many rows.

    Spark takes a frame's size from its compressed files and counts neither what an explode adds nor what a
    column holds once it is unpacked, so frames far larger than its limit pass as small and fill the driver.
    """
    return df.hint("merge") if rows > BROADCAST_ROWS else df


def join_sized(left: DataFrame, right: DataFrame, on: Sequence[str], left_rows: int, right_rows: int) -> DataFrame:
    """Inner join of frames whose rows were counted: the small one of the two is broadcast, or neither."""
    if right_rows <= BROADCAST_ROWS < left_rows:
        right = F.broadcast(right)
    elif left_rows <= BROADCAST_ROWS < right_rows:
        left = F.broadcast(left)
    else:
        right = sized(right, right_rows)
    return left.join(right, list(on))


def merge_profiles(base: DataFrame, profiles: Sequence[DataFrame], key: str, how: str = "left") -> DataFrame:
    """Profile tables joined onto one key, one after another."""
    return reduce(lambda left, right: left.join(right, key, how), profiles, base)


def expect_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    twice = df.groupBy(*keys).count().filter(F.col("count") > 1).take(1)
    if twice:
        raise ValueError(f"duplicate key {twice[0].asDict()}")
    return df


def join_one_to_one(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join that fails when either side repeats a key."""
    return expect_unique(left, [key]).join(expect_unique(right, [key]), key, how)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """One row per key, the first by ``order``; every task keeps one row per key before the shuffle."""
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_rn") == 1).drop("_rn")


def bridge_geometry(table: DataFrame, lookup: DataFrame, key: str, lookup_key: str, order: Sequence) -> DataFrame:
    """Give a non-spatial table its location through a key read as a whole number; orphans drop out."""
    number = "try_cast(regexp_extract(cast({} AS STRING), '([0-9]+)', 1) AS BIGINT)"
    places = lookup.withColumn("_key", F.expr(number.format(lookup_key))).filter(F.col("_key").isNotNull())
    places = first_per_key(places, ["_key"], order).drop(lookup_key)
    return table.withColumn("_key", F.expr(number.format(key))).join(places, "_key").drop("_key")


def match_report(a: DataFrame, b: DataFrame, key: str, gate: float = 75.0) -> DataFrame:
    """How many ids of each side the other has, as one row."""
    flags = a.select(key).distinct().withColumn("_a", F.lit(1)).join(
        b.select(key).distinct().withColumn("_b", F.lit(1)), key, "full"
    )
    both = F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1))
    row = flags.agg(
        F.count("_a").alias("ids_a"), F.count("_b").alias("ids_b"), both.alias("shared"),
        F.count(F.when(F.col("_b").isNull(), 1)).alias("only_a"),
        F.count(F.when(F.col("_a").isNull(), 1)).alias("only_b"),
    )
    share = F.when(F.col("ids_a") > 0, F.col("shared") * 100 / F.col("ids_a"))
    return row.withColumn("match_pct", share).withColumn("passes", F.col("match_pct") >= gate)


def lookup_with_default(df: DataFrame, stats: DataFrame, key: str, defaults: Mapping[str, object]) -> DataFrame:
    out = df.join(stats.select(key, *defaults), key, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def coordinate_backfill(df: DataFrame, lookup: DataFrame, on: Sequence[str], column: str, order: Sequence) -> DataFrame:
    """Fill a missing column from the first lookup row at the same coordinates and type."""
    known = first_per_key(lookup.filter(F.col(column).isNotNull()), on, order).select(*on, F.col(column).alias("_fill"))
    return df.join(known, list(on), "left").withColumn(column, F.coalesce(F.col(column), F.col("_fill"))).drop("_fill")


def expect_row_count(df: DataFrame, n: int) -> DataFrame:
    got = df.count()
    if got != n:
        raise ValueError(f"{got} rows where {n} were expected")
    return df


def expect_no_nulls(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    bad = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in columns]).first().asDict()
    if any(bad.values()):
        raise ValueError(f"nulls: { {c: n for c, n in bad.items() if n} }")
    return df
