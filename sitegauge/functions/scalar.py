"""Scalar expressions shared by the operators."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def only_row(df: DataFrame) -> Column:
    """The single row of ``df`` as a struct column, read as a scalar subquery."""
    return df.select(F.struct("*").alias("_row")).scalar()


def fixed(c: str | Column, digits: int = 6) -> Column:
    """Half-up rounding whose threshold sits just off exact ties, so summation order cannot flip it."""
    scale = float(10**digits)
    return F.floor(col(c) * F.lit(scale) + F.lit(0.5000001)) / F.lit(scale)


def safe_divide(a: Column, b: Column) -> Column:
    """a/b, null when the denominator is zero or null."""
    return F.when(b != 0, a / b)


def guarded_divide(a: Column, b: Column, eps: float = 1e-6) -> Column:
    return a / (b + F.lit(eps))


def clip(c: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Bound a value; null stays null."""
    out = c
    if lo is not None:
        out = F.when(out < lo, F.lit(float(lo))).otherwise(out)
    if hi is not None:
        out = F.when(out > hi, F.lit(float(hi))).otherwise(out)
    return out


def linear_ramp(c: Column, start: float, width: float) -> Column:
    return clip((c - start) / width, 0.0, 1.0)


def distance_decay(d: Column, reach: float = 2000.0) -> Column:
    return clip((F.lit(reach) - d) / reach, 0.0)


def month_sin(month: Column) -> Column:
    return F.sin(month * F.lit(2 * math.pi / 12))


def month_cos(month: Column) -> Column:
    return F.cos(month * F.lit(2 * math.pi / 12))


def month_from_cycle(sin: Column, cos: Column) -> Column:
    """Inverse of the cyclic encoding; December encodes to a full turn and comes back as 12."""
    m = F.pmod(F.round(F.atan2(sin, cos) * F.lit(12 / (2 * math.pi))).cast("int"), F.lit(12))
    return F.when(m == 0, 12).otherwise(m)


def date_from_parts(year: Column, month: Column, day: Column, month_default: int = 6, day_default: int = 15) -> Column:
    return F.make_date(year, F.coalesce(month, F.lit(month_default)), F.coalesce(day, F.lit(day_default)))


def months_between_days(later: Column, earlier: Column) -> Column:
    """Age in months, counting 30.44 days to the month."""
    return F.datediff(later, earlier) / F.lit(30.44)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    sp, sl = F.sin((p2 - p1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(sp * sp + F.cos(p1) * F.cos(p2) * sl * sl)))


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    theta = F.atan2(F.sin(dl) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl))
    return F.pmod(F.degrees(theta) + 360.0, F.lit(360.0))


def null_safe_mean(cols: Sequence[Column]) -> Column:
    """Mean of the non-null columns; null when all are null."""
    n = sum((c.isNotNull().cast("int") for c in cols), F.lit(0))
    total = sum((F.coalesce(c.cast("double"), F.lit(0.0)) for c in cols), F.lit(0.0))
    return F.when(n > 0, total / n)


def softmax_over_bins(value: Column, centres: Sequence[float], temperature: float = 50.0) -> Column:
    """Probability per bin from the distance to each bin centre."""
    bins = F.array(*[F.lit(float(c)) for c in centres])
    nearest = F.array_min(F.transform(bins, lambda c: F.abs(c - value)))
    weights = F.transform(bins, lambda c: F.exp(-(F.abs(c - value) - nearest) / F.lit(float(temperature))))
    total = F.aggregate(weights, F.lit(0.0), lambda acc, w: acc + w)
    return F.transform(weights, lambda w: w / total)


def lookup(c: Column, table: dict, default=None) -> Column:
    """Fixed dictionary lookup."""
    pairs = [F.lit(v) for kv in table.items() for v in kv]
    found = F.element_at(F.create_map(*pairs), c)
    return found if default is None else F.coalesce(found, F.lit(default))
