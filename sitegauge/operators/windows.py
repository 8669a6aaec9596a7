"""Trailing queues, ranks, bands and picks (WN-*, TK-*).

Trailing windows run over one row per key and day, so a busy authority, or the whole country, costs
one row per calendar day inside the window; results are joined back on the day.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitegauge.functions.scalar import only_row
from sitegauge.operators.quantiles import group_quantiles
from sitegauge.operators.ranges import numbered


def trailing(df: DataFrame, keys: Sequence[str], date: str, days: int, aggs: Mapping[str, Column],
             count: str | None = None) -> DataFrame:
    """Sums over rows of the same key in [t - days, t), by day; 0 when there are none, null for a null key or date."""
    keys = list(keys)
    daily = df.filter(F.col(date).isNotNull()).groupBy(*keys, date).agg(
        *[F.sum(c).alias(n) for n, c in aggs.items()], *([F.count(F.lit(1)).alias(count)] if count else [])
    )
    names = [*aggs, *([count] if count else [])]
    daily = daily.withColumn("_day", F.unix_date(date))
    window = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_day").rangeBetween(-days, -1)
    daily = daily.withColumns({n: F.coalesce(F.sum(n).over(window), F.lit(0)) for n in names}).drop("_day")
    return df.join(daily, [*keys, date], "left")


def queue_depth(df: DataFrame, key: str = "lpa", date: str = "submission_date", days: int = 180) -> DataFrame:
    return trailing(df, [key], date, days, {}, count="queue_depth")


def relative_scale(df: DataFrame, capacity: str, key: str = "lpa", date: str = "submission_date", days: int = 180) -> DataFrame:
    """Own capacity over the mean of the authority's recent ones, the overall mean if there are none."""
    out = trailing(df, [key], date, days, {"_mw": F.col(capacity)}, count="_n")
    overall = df.agg(F.avg(capacity)).scalar()
    out = out.withColumn("_mean", F.when(F.col("_n") > 0, F.col("_mw") / F.col("_n")).otherwise(overall))
    mean = F.col("_mean")
    return out.withColumn("relative_scale", F.when(mean != 0, F.col(capacity) / mean)).drop("_mw", "_n", "_mean")


def national_velocity(df: DataFrame, date: str = "submission_date", days: int = 90) -> DataFrame:
    """Trailing national count over its mean, and a winter flag."""
    out = trailing(df, [], date, days, {}, count="national_count")
    overall = out.agg(F.avg("national_count")).scalar()
    return out.withColumns({
        "national_velocity": F.try_divide(F.col("national_count"), overall),
        "is_winter": F.month(date).isin(11, 12, 1, 2).cast("int"),
    })


def national_queue(df: DataFrame, capacity: str, date: str = "submission_date", days: int = 365) -> DataFrame:
    out = trailing(df, [], date, days, {"national_mw": F.col(capacity)})
    return out.withColumn("queue_times_mw", F.col("national_mw") * F.col(capacity))


def ordered_position(df: DataFrame, keys: Sequence[str], score: str, id: str, out: str = "position") -> DataFrame:
    """1-based rank by (score, id) within each key, for groups of any size; ``id`` is a whole number.

    Rows whose key is null are a group of their own. Also adds ``group_size``.
    """
    ranked = numbered(df, keys, [score, id], "_at", "group_size")
    return ranked.withColumn(out, F.col("_at") + 1).drop("_at")


# Quartile labels and colours, best first.
QUARTILE_STYLE = (("Q1 (Best)", "#2ecc71"), ("Q2", "#f1c40f"), ("Q3", "#e67e22"), ("Q4 (Worst)", "#e74c3c"))


def rank_style(df: DataFrame, keys: Sequence[str], score: str, id: str) -> DataFrame:
    """0-based position over group size as a percentage, with its quartile label and colour."""
    out = ordered_position(df, keys, score, id)
    pct = (F.col("position") - 1) * 100.0 / F.col("group_size")
    out = out.withColumn("rank_pct", pct)
    label, colour = F.lit(QUARTILE_STYLE[3][0]), F.lit(QUARTILE_STYLE[3][1])
    for edge, (name, hexcode) in zip((75, 50, 25), reversed(QUARTILE_STYLE[:3]), strict=True):
        label = F.when(F.col("rank_pct") < edge, name).otherwise(label)
        colour = F.when(F.col("rank_pct") < edge, hexcode).otherwise(colour)
    return out.withColumns({"quartile": label, "colour": colour}).drop("position", "group_size")


def percentile_vs_scenarios(df: DataFrame, key: str, score: str) -> DataFrame:
    """Share of the key's scenarios that are strictly shorter."""
    by_score = Window.partitionBy(key).orderBy(score)
    everything = Window.partitionBy(key)
    return df.withColumn("shorter_share", (F.rank().over(by_score) - 1) / F.count(F.lit(1)).over(everything))


def pick_optimal(df: DataFrame, key: str, capacity: str, days: str, threshold: float = 300.0) -> DataFrame:
    """Largest capacity within the threshold, else the capacity with the fewest days."""
    ok = F.col(days) <= threshold
    return df.groupBy(key).agg(
        F.coalesce(F.max(F.when(ok, F.col(capacity))),
                   F.min_by(capacity, F.struct(F.col(days), -F.col(capacity)))).alias("optimal_mw"),
        F.coalesce(F.min_by(F.when(ok, F.col(days)), F.when(ok, F.struct(-F.col(capacity), F.col(days)))),
                   F.min(days)).alias("optimal_days"),
    )


def band(value: Column, edges: Sequence[float], labels: Sequence[str] | None = None) -> Column:
    """Left-closed bins: index (or label) of the bin, null below the first edge or when null."""
    labels = labels or list(range(len(edges)))
    out = F.lit(None)
    for edge, label in zip(edges, labels, strict=True):
        out = F.when(value >= edge, F.lit(label)).otherwise(out)
    return out


def quartile_band(df: DataFrame, value: str, out: str = "quartile") -> DataFrame:
    """1-4 against the exact 25/50/75 % quantiles of the whole column."""
    edges = group_quantiles(df, [], value, [0.25, 0.5, 0.75], ["_q1", "_q2", "_q3"])
    row = only_row(edges)
    return df.withColumn(out, sum((F.col(value) > row[q]).cast("int") for q in ("_q1", "_q2", "_q3")) + 1)


def trim_by_group(df: DataFrame, key: str, value: str, low: float = 0.02, high: float = 0.98, min_rows: int = 10) -> DataFrame:
    """Drop each group's tails; groups below ``min_rows`` stay whole, as do rows whose group or value is null."""
    edges = group_quantiles(df, [key], value, [low, high], ["_lo", "_hi"])
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    marked = df.join(edges, key, "left").join(sizes, key, "left")
    unknown = F.col(key).isNull() | F.col(value).isNull()
    return marked.filter(unknown | (F.col("_n") < min_rows) | F.col(value).between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi", "_n")


def top_drivers(df: DataFrame, id: str, contributions: Mapping[str, Column], n: int = 3) -> DataFrame:
    """The n largest absolute contributions per row, with signed text."""
    parts = F.array(*[
        F.struct((-F.abs(c)).alias("o"), F.lit(name).alias("feature"), c.alias("days")) for name, c in contributions.items()
    ])
    ranked = F.slice(F.array_sort(F.filter(parts, lambda p: p["days"].isNotNull())), 1, n)
    out = df.select(id, F.posexplode(ranked).alias("driver_rank", "d"))
    sign = F.when(F.col("d.days") >= 0, "+").otherwise("-")
    return out.select(
        id, (F.col("driver_rank") + 1).alias("driver_rank"), F.col("d.feature").alias("feature"),
        F.col("d.days").alias("days"),
        F.concat(sign, F.round(F.abs(F.col("d.days"))).cast("int").cast("string"), F.lit(" days")).alias("text"),
    )


def months_to_window(month: Column, start: int, end: int) -> Column:
    """Months until a survey window opens; 0 inside it. A window may run over the year end."""
    inside = month.between(start, end) if start <= end else ((month >= start) | (month <= end))
    return F.when(inside, 0).otherwise(F.pmod(F.lit(start) - month, F.lit(12)))


def top_k(df: DataFrame, order: Sequence, k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def top_k_per_key(df: DataFrame, keys: Sequence[str], order: Sequence, k: int, rank: str = "rank") -> DataFrame:
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(rank) <= k)
