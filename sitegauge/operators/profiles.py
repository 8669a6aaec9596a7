"""Group profiles, error metrics and table profiles (AG-*)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.functions.scalar import safe_divide
from sitegauge.operators.quantiles import group_quantiles


def rates_by_group(df: DataFrame, keys: Sequence[str], rates: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """Sums first, then their ratio; null on a zero denominator."""
    aggs = [F.sum(c).alias(f"_{n}_{i}") for n, pair in rates.items() for i, c in enumerate(pair)]
    out = df.groupBy(*keys).agg(*aggs)
    return out.select(*keys, *[safe_divide(F.col(f"_{n}_0"), F.col(f"_{n}_1")).alias(n) for n in rates])


def conditional_sums(df: DataFrame, keys: Sequence[str], category: str, values: Sequence[str], measure: str,
                     prefix: str = "sum") -> DataFrame:
    cases = [F.sum(F.when(F.col(category) == v, F.col(measure)).otherwise(0.0)).alias(f"{prefix}_{v}") for v in values]
    return df.groupBy(*keys).agg(F.sum(measure).alias(f"{prefix}_total"), *cases)


def duration_profile(df: DataFrame, keys: Sequence[str], days: str, p: float = 0.9) -> DataFrame:
    """Mean, sample deviation and exact upper quantile of whole-day durations, from counts per value."""
    counts = df.filter(F.col(days).isNotNull()).groupBy(*keys, days).agg(F.count(F.lit(1)).alias("_c"))
    n, total = F.sum("_c"), F.sum(F.col(days) * F.col("_c"))
    square = F.sum(F.col(days).cast("double") * F.col(days) * F.col("_c"))
    out = counts.groupBy(*keys).agg(
        n.alias("n"), (total / n).alias("days_mean"),
        F.when(n > 1, F.sqrt((square - total * total / n) / (n - 1))).alias("days_std"),
        F.percentile(days, p, F.col("_c")).alias(f"days_p{round(p * 100)}"),
    )
    return out


def volatility(df: DataFrame, keys: Sequence[str], load: str) -> DataFrame:
    """Population deviation over the mean of a periodic load."""
    mean = F.avg(load)
    return df.groupBy(*keys).agg(F.when(mean != 0, F.stddev_pop(load) / mean).alias("volatility"))


def trend_by_group(df: DataFrame, keys: Sequence[str], x: str, y: str, min_points: int = 3) -> DataFrame:
    slope = F.regr_slope(F.col(y).cast("double"), F.col(x).cast("double"))
    return df.groupBy(*keys).agg(F.when(F.count(F.lit(1)) >= min_points, slope).alias("trend"))


def trend_across_columns(df: DataFrame, columns: Mapping[str, float], out: str = "trend") -> DataFrame:
    """Least-squares slope over columns holding successive years; positive values only, 0 below two."""
    xs = [(F.lit(float(x)), F.when(F.col(c) > 0, F.col(c).cast("double"))) for c, x in columns.items()]
    n = sum(y.isNotNull().cast("double") for _, y in xs)
    sx = sum(F.when(y.isNotNull(), x).otherwise(0.0) for x, y in xs)
    sy = sum(F.coalesce(y, F.lit(0.0)) for _, y in xs)
    sxy = sum(F.coalesce(x * y, F.lit(0.0)) for x, y in xs)
    sxx = sum(F.when(y.isNotNull(), x * x).otherwise(0.0) for x, y in xs)
    return df.withColumn(out, F.when(n >= 2, (n * sxy - sx * sy) / (n * sxx - sx * sx)).otherwise(0.0))


def ratio_by_outcome(df: DataFrame, keys: Sequence[str], outcome: Column, days: str) -> DataFrame:
    yes, no = F.avg(F.when(outcome, F.col(days))), F.avg(F.when(~outcome, F.col(days)))
    return df.groupBy(*keys).agg(F.when(no != 0, yes / no).alias("days_ratio"))


def pivot_wide(df: DataFrame, keys: Sequence[str], column: str, values: Sequence, agg: Column, prefix: str = "") -> DataFrame:
    wide = df.groupBy(*keys).pivot(column, list(values)).agg(agg)
    return wide.withColumnsRenamed({str(v): f"{prefix}{v}" for v in values})


def dominant_value(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Highest value, the lowest order where it occurs, and the mean over odd orders."""
    return df.groupBy(*keys).agg(
        F.max(value).alias("highest"),
        F.max_by(order, F.struct(F.col(value), -F.col(order))).alias("dominant_order"),
        F.avg(F.when(F.col(order) % 2 == 1, F.col(value))).alias("odd_mean"),
    )


def rating_profile(df: DataFrame, keys: Sequence[str], rating: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.sum(rating).alias("rating_sum"), F.count(rating).alias("rating_n"), F.avg(rating).alias("rating_mean"),
        F.max(rating).alias("rating_max"), F.min(rating).alias("rating_min"),
        F.coalesce(F.var_samp(rating), F.lit(0.0)).alias("rating_var"),
    )


def hotspot_concentration(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Largest child over the total plus one."""
    return df.groupBy(*keys).agg((F.max(value) / (F.sum(value) + 1)).alias("concentration"))


def reconciliation_deltas(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Totals of one measure in two sources, side by side: value_a, value_b, delta (a less b) and its share of b.

    Keys of either source are kept, null keys too; a source without the key counts 0, and a share of nothing is null.
    """
    totals = [df.groupBy(*keys).agg(F.sum(value).alias(f"value_{n}")).select(F.struct(*keys).alias("_key"), f"value_{n}") for n, df in (("a", a), ("b", b))]
    both = totals[0].join(totals[1], "_key", "full").select("_key.*", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("value_a", "value_b")])
    delta = F.col("value_a") - F.col("value_b")
    return both.withColumns({"delta": delta, "delta_share": safe_divide(delta, F.col("value_b"))})


def shrunk_stats(df: DataFrame, key: str, days: str, m: float = 10.0) -> DataFrame:
    """Mean and 90 % quantile pulled to the overall ones by m pseudo-rows; spread, IQR and slow share."""
    n = F.count(days)
    edges = group_quantiles(df, [key], days, [0.25, 0.75, 0.9], ["q25", "q75", "q90"]).withColumnRenamed(key, "_key")
    stats = df.groupBy(key).agg(
        n.alias("n"), F.avg(days).alias("mean"), F.stddev_samp(days).alias("std"),
        F.avg((F.col(days) > 180).cast("int")).alias("slow_share"),
    )
    stats = stats.join(edges, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
    mean, q90 = df.agg(F.avg(days)).scalar(), group_quantiles(df, [], days, [0.9]).scalar()
    w = F.col("n") + m
    return stats.select(
        key, "n",
        ((F.col("n") * F.col("mean") + m * mean) / w).alias("shrunk_mean"),
        ((F.col("n") * F.col("q90") + m * q90) / w).alias("shrunk_p90"),
        F.when(F.col("mean") != 0, F.col("std") / F.col("mean")).alias("spread_index"),
        (F.col("q75") - F.col("q25")).alias("iqr"), "slow_share",
    )


def weighted_band_index(counts: Sequence[Column]) -> Column:
    """Mean band number (1, 2, ...) weighted by the band counts."""
    total = sum(F.coalesce(c, F.lit(0)) for c in counts)
    weighted = sum(F.coalesce(c, F.lit(0)) * (i + 1) for i, c in enumerate(counts))
    return safe_divide(weighted, total)


def error_metrics(actual: str, predicted: str) -> dict[str, Column]:
    """Aggregates: RMSE, MAE, R2, MAPE (non-zero actuals) and bias."""
    a, e = F.col(actual), F.col(predicted) - F.col(actual)
    return {
        "n": F.count(e), "rmse": F.sqrt(F.avg(e * e)), "mae": F.avg(F.abs(e)),
        "r2": 1 - F.try_divide(F.sum(e * e), F.var_pop(F.when(e.isNotNull(), a)) * F.count(e)),  # null where all are equal
        "mape": F.avg(F.when(a != 0, F.abs(e / a))) * 100, "bias": F.avg(e),
    }


def metrics_by(df: DataFrame, keys: Sequence[str], actual: str, predicted: str) -> DataFrame:
    metrics = [c.alias(n) for n, c in error_metrics(actual, predicted).items()]
    return df.groupBy(*keys).agg(*metrics) if keys else df.agg(*metrics)


def metrics_by_strata(df: DataFrame, strata: Sequence[str], actual: str, predicted: str) -> DataFrame:
    """Count and RMSE for every value of every stratum column, stacked, from one read of the rows."""
    rows = df.select(
        (F.col(predicted) - F.col(actual)).alias("_e"),
        F.explode(F.array(*[
            F.struct(F.lit(s).alias("stratum"), F.col(s).cast("string").alias("value")) for s in strata
        ])).alias("s"),
    )
    return rows.groupBy("s.stratum", "s.value").agg(
        F.count("_e").alias("n"), F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse")
    )


def interval_calibration(df: DataFrame, actual: str, low: str, high: str) -> DataFrame:
    a = F.col(actual)
    out = df.agg(
        F.count(a).alias("n"), F.avg(a.between(F.col(low), F.col(high)).cast("int")).alias("coverage"),
        F.avg((a < F.col(low)).cast("int")).alias("below_low"), F.avg((a < F.col(high)).cast("int")).alias("below_high"),
        F.avg(F.col(high) - F.col(low)).alias("mean_width"),
    )
    return out.withColumn("passes", F.col("coverage").between(0.7, 0.9))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n, mean, std, min, max) from one pass."""
    aggs = [f(c).alias(f"{c}__{n}") for c in columns for n, f in (
        ("n", F.count), ("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))]
    names = ("n", "mean", "std", "min", "max")
    rows = F.array(*[
        F.struct(F.lit(c).alias("column"), *[F.col(f"{c}__{n}").cast("double").alias(n) for n in names]) for c in columns
    ])
    return df.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*")


def compare_profiles(a: DataFrame, b: DataFrame, columns: Sequence[str], limit: float = 1.0) -> DataFrame:
    """Both describes side by side, long form, with the absolute difference and a flag above the limit."""
    stats = ("n", "mean", "std", "min", "max")
    stack = ", ".join(f"'{s}', {s}" for s in stats)

    def long(df: DataFrame, out: str) -> DataFrame:
        return describe(df, columns).select("column", F.expr(f"stack({len(stats)}, {stack}) AS (stat, {out})"))

    both = long(a, "value_a").join(long(b, "value_b"), ["column", "stat"])
    return both.withColumn("difference", F.abs(F.col("value_a") - F.col("value_b"))).withColumn(
        "flagged", F.col("difference") > limit
    )


def column_profile(df: DataFrame, columns: Sequence[str], sentinels: Sequence[float] = (-1.0, 999.0, 9999.0)) -> DataFrame:
    """Per column: missing share (null or sentinel), zero count, and whether every value is zero."""
    aggs = []
    for c in columns:
        missing = F.col(c).isNull() | F.col(c).isin(list(sentinels))
        aggs += [
            (F.avg(F.coalesce(missing, F.lit(True)).cast("int")) * 100).alias(f"{c}__missing"),
            F.count(F.when(F.col(c) == 0, 1)).alias(f"{c}__zeros"), F.count(F.lit(1)).alias(f"{c}__rows"),
        ]
    rows = F.array(*[
        F.struct(
            F.lit(c).alias("column"), F.col(f"{c}__missing").alias("missing_pct"), F.col(f"{c}__zeros").alias("zeros"),
            (F.col(f"{c}__zeros") == F.col(f"{c}__rows")).alias("all_zero"),
        )
        for c in columns
    ])
    return df.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*")


def frequency_table(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("pct", F.col("n") * 100.0 / total)


def group_band_stats(df: DataFrame, key: str, band: str, days: str, min_rows: int = 5) -> DataFrame:
    """n, mean, deviation, median, min and max per key, and per key and band with enough rows."""
    counts = df.groupBy(key, band, days).agg(F.count(F.lit(1)).alias("_c"))
    levels = counts.select(
        key, F.explode(F.array(F.lit("all"), F.col(band).cast("string"))).alias("level"), days, "_c"
    )
    levels = levels.groupBy(key, "level", days).agg(F.sum("_c").alias("_c"))
    n, total = F.sum("_c"), F.sum(F.col(days) * F.col("_c"))
    square = F.sum(F.col(days).cast("double") * F.col(days) * F.col("_c"))
    out = levels.groupBy(key, "level").agg(
        n.alias("n"), (total / n).alias("mean"),
        F.when(n > 1, F.sqrt((square - total * total / n) / (n - 1))).alias("std"),
        F.percentile(days, 0.5, F.col("_c")).alias("median"), F.min(days).alias("min"), F.max(days).alias("max"),
    )
    return out.filter((F.col("level") == "all") | (F.col("n") >= min_rows))


def top_correlations(df: DataFrame, target: str, columns: Sequence[str], k: int = 15) -> DataFrame:
    """Columns by absolute correlation with the target; constant columns drop out."""
    t = F.col(target)
    pairs = df.agg(*[
        F.try_divide(F.covar_pop(c, t), F.stddev_pop(c) * F.stddev_pop(t)).alias(c) for c in columns
    ], *[F.var_pop(c).alias(f"{c}__v") for c in columns])
    rows = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("corr"), F.col(f"{c}__v").alias("v")) for c in columns
    ])
    out = pairs.select(F.explode(rows).alias("r")).select("r.*").filter(F.col("v") > 0).drop("v")
    return out.withColumn("abs_corr", F.abs("corr")).orderBy(F.desc("abs_corr"), "feature").limit(k)


def ordered_group_medians(df: DataFrame, group: str, value: str) -> DataFrame:
    """Exact median, mean and count of a value by group, and the group's place: lowest median first, then by group.

    Null groups are one; values that are null don't count, and a group without any has no median and comes last.
    """
    from sitegauge.operators.ranges import numbered

    medians = group_quantiles(df, [group], value, [0.5], ["median"]).withColumnRenamed(group, "_group")
    stats = df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    stats = stats.join(medians, F.col(group).eqNullSafe(F.col("_group")), "left").drop("_group")
    return numbered(stats, [], [F.col("median").asc_nulls_last(), group], "_at").withColumn("place", F.col("_at") + 1).drop("_at")


def expert_spread(df: DataFrame, experts: Sequence[str]) -> DataFrame:
    """Mean, population deviation, largest absolute output and its expert, per row."""
    outputs = F.array(*[F.col(e).cast("double") for e in experts])
    mean = F.aggregate(outputs, F.lit(0.0), lambda a, v: a + v) / len(experts)
    df = df.withColumn("experts_mean", mean)
    square = F.aggregate(
        F.transform(outputs, lambda v: (v - F.col("experts_mean")) * (v - F.col("experts_mean"))), F.lit(0.0), lambda a, v: a + v
    )
    top = F.array_min(F.array(*[F.struct((-F.abs(F.col(e))).alias("v"), F.lit(e).alias("name")) for e in experts]))
    return df.withColumns({"experts_std": F.sqrt(square / len(experts)), "experts_max_abs": -top["v"], "top_expert": top["name"]})
