"""Nearest and k-nearest joins over points, segments and polygon edges.

Answers are exact and ties go to the lower id. Queries are reduced to distinct places first and the
items to the k lowest ids per place, so any number of copies of one place costs one search.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegralType, TimestampNTZType, TimestampType

from sitegauge.functions import geometry as geo
from sitegauge.functions.scalar import EARTH_KM, haversine_km
from sitegauge.operators import pyramid as pyr
from sitegauge.operators.joins import sized


@dataclass(frozen=True)
class Metric:
    """Distance from a query to an item, and its bounds over a cell."""

    bounds: Callable[[Column, Column], tuple[Column, Column]]
    exact: Callable[[Column, Column], Column]


PLANAR = Metric(pyr.planar_bounds, lambda x, y: geo.distance(x, y, F.col("_px"), F.col("_py")))
SEGMENT = Metric(
    pyr.planar_bounds,
    lambda x, y: geo.segment_distance(x, y, F.col("_ax"), F.col("_ay"), F.col("_bx"), F.col("_by")),
)


def _haversine_bounds(lon: Column, lat: Column) -> tuple[Column, Column]:
    x0, y0, x1, y1 = pyr.box()
    c0, c1 = F.cos(F.radians(y0)), F.cos(F.radians(y1))
    widest = F.when((y0 <= 0) & (y1 >= 0), F.lit(1.0)).otherwise(F.greatest(c0, c1))

    def arc(dlat: Column, dlon: Column, cosine: Column) -> Column:
        a, b = F.sin(F.radians(dlat) / 2), F.sin(F.radians(dlon) / 2)
        return F.lit(2 * EARTH_KM) * F.asin(
            F.least(F.lit(1.0), F.sqrt(a * a + F.cos(F.radians(lat)) * cosine * b * b))
        )

    near = arc(F.greatest(y0 - lat, lat - y1, F.lit(0.0)), F.greatest(x0 - lon, lon - x1, F.lit(0.0)), F.least(c0, c1))
    far = arc(F.greatest(lat - y0, y1 - lat), F.greatest(lon - x0, x1 - lon), widest)
    return near, far


HAVERSINE = Metric(_haversine_bounds, lambda lon, lat: haversine_km(lat, lon, F.col("_py"), F.col("_px")))


def _slack(r: Column) -> Column:
    return r * (1 + 1e-9) + 1e-6


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before; null equals null."""
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    return pc.coalesce(pc.not_equal(a, b), pc.xor(a.is_null(), b.is_null())).to_numpy(zero_copy_only=False)


def ever_lowest(items: DataFrame, place: Sequence[str], id: str, when: str, k: int) -> DataFrame:
    """Items that are among the k lowest ids of their place at some time, counting those of earlier ``when`` only.

    An item that k others of its place precede by id, none of them later, is never told. A place's rows are read once in
    order of their ids, with the k earliest times so far at hand; of n items in no order about k * (1 + ln(n / k)) stay.
    Times that aren't dates, timestamps or whole numbers are left alone, and so are items without one.
    """
    if not isinstance(items.schema[when].dataType, DateType | TimestampType | TimestampNTZType | IntegralType):
        return items
    place = list(place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, earliest = None, []
        for b in batches:
            if not b.num_rows:
                continue
            new = np.zeros(b.num_rows, bool)
            for c in place:
                new[1:] |= _changes(b.column(c))
            new[0] = [b.column(c)[0].as_py() for c in place] != last
            times = b.column(when)
            times = times.cast(pa.int32()).to_pylist() if pa.types.is_date32(times.type) else times.cast(pa.int64()).to_pylist()
            keep = np.ones(b.num_rows, bool)
            for i, (starts, t) in enumerate(zip(new.tolist(), times, strict=True)):
                if starts:
                    earliest = []
                if t is None:
                    continue
                if len(earliest) == k and t >= earliest[-1]:
                    keep[i] = False
                    continue
                insort(earliest, t)
                del earliest[k:]
            last = [b.column(c)[b.num_rows - 1].as_py() for c in place]
            yield b.filter(pa.array(keep))

    return items.repartition(*place).sortWithinPartitions(*place, id).mapInArrow(run, items.schema)


def knn(
    queries: DataFrame,
    items: DataFrame,
    k: int,
    *,
    id: str,
    attrs: Sequence[str] = (),
    qx: str = "x",
    qy: str = "y",
    x: str = "x",
    y: str = "y",
    by: Sequence[str] = (),
    ends: Sequence[str] | None = None,
    before: tuple[str, str] | None = None,
    exclude_self: str | None = None,
    metric: Metric | None = None,
    distance: str = "distance",
    rank: str = "rank",
    how: str = "inner",
) -> DataFrame:
    """Each query row with its k nearest items: ``id``, ``attrs``, distance and rank.

    by            equal-valued columns on both sides (search within a class, operator or snapshot)
    ends          (ax, ay, bx, by) item columns, for items that are segments or polygon edges
    before        (query column, item column): only items with item < query count
    exclude_self  query column holding an item id that may not be its own neighbour
    """
    by = list(by)
    want = k + 1 if exclude_self else k
    out_cols = [id, *attrs, distance, rank]
    if ends:
        ax, ay, bx, by_ = (F.col(c).cast("double") for c in ends)
        items = items.withColumns({"_ax": ax, "_ay": ay, "_bx": bx, "_by": by_})
        x, y, reach = "_mx", "_my", F.col("_half")
        metric = metric or SEGMENT
        place = ["_ax", "_ay", "_bx", "_by"]
    else:
        metric, reach, place = metric or PLANAR, None, [x, y]
    keep = list(dict.fromkeys([*by, *place, *([] if ends else [x, y]), id, *attrs, *([before[1]] if before else [])]))
    items = items.select(*keep)
    if before:
        place = [*place, before[1]]
    copies = Window.partitionBy(*by, *place).orderBy(id)
    items = items.withColumn("_copy", F.row_number().over(copies)).filter(F.col("_copy") <= want).drop("_copy")
    if before:
        items = ever_lowest(items, [*by, *place[:-1]], id, before[1], want)
    if ends:
        # A piece's distance is its whole line's, so pieces tie with themselves only; k of them may be one line.
        items = pyr.filed_pieces(items, ("_ax", "_ay", "_bx", "_by"), split=want == 1)

    index = pyr.build(items, x, y, reach=reach, by=by, leaf_rows=max(32, 2 * want),
                      nth_key=(before[1], want) if before else None)
    if index is None:
        empty = items.limit(0).select(id, *attrs)
        wide = queries.join(empty.withColumns({distance: F.lit(0.0), rank: F.lit(0)}), F.lit(False), how)
        return wide
    places = [*by, qx, qy, *([before[0]] if before else [])]
    found = _descend(pyr.start(queries, qx, qy, places), index, places, want, metric, before)
    found = found.select(*[F.col(c).alias(f"_q_{c}") for c in places], "_qx", "_qy", "_cell", "_r")
    hits = index.items.withColumnsRenamed({c: f"_i_{c}" for c in {*by, id, *attrs, "_cell", *([before[1]] if before else [])}})
    hits = hits.select(*[c for c in hits.columns if c.startswith("_")])
    found = (
        found.join(sized(hits, index.rows), _all([found["_cell"] == hits["_i__cell"], *[found[f"_q_{c}"] == hits[f"_i_{c}"] for c in by]]))
        .withColumn("_d", metric.exact(F.col("_qx"), F.col("_qy")))
        .filter(F.col("_d") <= _slack(F.col("_r")))
    )
    if before:
        found = found.filter(F.col(f"_i_{before[1]}") < F.col(f"_q_{before[0]}"))
    best = Window.partitionBy(*[f"_q_{c}" for c in places]).orderBy("_d", f"_i_{id}")
    found = found.withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= want)
    found = found.select(*[f"_q_{c}" for c in places], F.col("_d").alias(distance),
                         F.col("_rank").alias(rank), F.col(f"_i_{id}").alias(id),
                         *[F.col(f"_i_{c}").alias(c) for c in attrs])
    # ``found`` lies by place already; the queries, of any number, are brought to it and not broadcast.
    joined = queries.join(found.hint("merge"), _all([queries[c] == found[f"_q_{c}"] for c in places]), how)
    joined = joined.drop(*[f"_q_{c}" for c in places])
    if not exclude_self:
        return joined
    others = joined.filter(F.col(id) != F.col(exclude_self))
    place_rank = Window.partitionBy(exclude_self).orderBy(distance, id)
    return others.withColumn(rank, F.row_number().over(place_rank)).filter(F.col(rank) <= k)


def _all(conditions: Sequence[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _descend(frontier: DataFrame, index: pyr.Pyramid, places: Sequence[str], k: int, metric: Metric,
             before: tuple[str, str] | None) -> DataFrame:
    """Leaves that can hold one of the k nearest, with a proven radius ``_r`` per query."""
    group = Window.partitionBy(*places)
    nearest_first = group.orderBy("_hi", "_cell").rowsBetween(Window.unboundedPreceding, 0)
    frontier = frontier.withColumn("_r", F.lit(float("inf")))
    for level in range(1, index.depth + 1):
        frontier = pyr.step(frontier, index, level)
        lo, hi = metric.bounds(F.col("_qx"), F.col("_qy"))
        frontier = frontier.withColumn("_lo", lo).filter(F.col("_lo") <= _slack(F.col("_r"))).withColumn("_hi", hi)
        if before:
            frontier = frontier.filter(F.col("_key_min") < F.col(before[0]))
            enough = F.col("_key_nth") < F.col(before[0])
        elif k == 1:
            enough = F.lit(True)
        else:
            frontier = frontier.withColumn("_cum", F.sum("_n").over(nearest_first))
            enough = F.col("_cum") >= k
        reached = F.min(F.when(enough, F.col("_hi"))).over(group)
        frontier = frontier.withColumn("_r", F.least(F.col("_r"), F.coalesce(reached, F.lit(float("inf")))))
        frontier = frontier.filter(F.col("_lo") <= _slack(F.col("_r"))).drop("_cum", "_lo", "_hi")
    return frontier


def nearest(queries: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The one nearest item per query."""
    return knn(queries, items, 1, rank="_one", **options).drop("_one")


def nearest_per_class(
    queries: DataFrame, items: DataFrame, classes: Sequence[str], site: str, *, class_col: str, id: str, **options
) -> DataFrame:
    """Distance to the nearest item of each listed class, one column per class."""
    asked = queries.select(site, "x", "y").withColumn(
        class_col, F.explode(F.array(*[F.lit(c) for c in classes]))
    )
    found = nearest(asked, items.filter(F.col(class_col).isin(list(classes))), id=id, by=[class_col], **options)
    wide = found.groupBy(site).pivot(class_col, list(classes)).agg(F.min("distance"))
    wide = wide.withColumnsRenamed({str(c): f"{c}_m" for c in classes})
    return queries.join(wide, site, "left")


def cohort_stats(neighbours: DataFrame, keys: Sequence[str], value: str, prefix: str,
                 threshold: float | None = None) -> DataFrame:
    """Mean, both deviations, min, max and variance of a neighbour measure per query."""
    v = F.col(value)
    aggs = [
        F.avg(v).alias(f"{prefix}_mean"), F.stddev_pop(v).alias(f"{prefix}_std_pop"),
        F.stddev_samp(v).alias(f"{prefix}_std"), F.min(v).alias(f"{prefix}_min"),
        F.max(v).alias(f"{prefix}_max"), F.var_pop(v).alias(f"{prefix}_var"),
        F.count(v).alias(f"{prefix}_n"),
    ]
    if threshold is not None:
        over = (v > threshold).cast("int")
        aggs += [F.sum(over).cast("long").alias(f"{prefix}_n_over"), F.avg(over).alias(f"{prefix}_share_over")]
    return neighbours.groupBy(*keys).agg(*aggs)


def inverse_distance(value: Column, distance: Column, power: int = 2, floor: float = 1e-6) -> Column:
    """Aggregate: mean of ``value`` weighted by distance to the minus ``power``."""
    w = 1 / F.pow(F.greatest(distance, F.lit(floor)), F.lit(power))
    return F.sum(value * w) / F.sum(F.when(value.isNotNull(), w))


def knn_in_years(sites: DataFrame, items: DataFrame, k: int, *, years: Sequence[int], date: str, item_year: str,
                 site: str, id: str, attrs: Sequence[str] = ()) -> DataFrame:
    """k nearest among items dated year(date) + one of ``years``: searched per year, then merged.

    Years are merged once a place and year; the sites that share them meet k items, not k a year.
    """
    dated = sites.select(site, "x", "y", F.year(date).alias("_year"))
    asked = dated.select("x", "y", "_year").distinct().withColumn(item_year, F.explode(F.array(*[F.col("_year") + y for y in years])))
    items = items.withColumn(item_year, F.col(item_year).cast("int"))
    found = knn(asked, items, k, id=id, attrs=attrs, by=[item_year])
    merged = Window.partitionBy("x", "y", "_year").orderBy("distance", id)
    found = found.withColumn("rank", F.row_number().over(merged)).filter(F.col("rank") <= k)
    found = dated.join(found.hint("merge"), ["x", "y", "_year"]).select(site, "x", "y", item_year, id, *attrs, "distance")
    best = Window.partitionBy(site).orderBy("distance", id)
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def count_in_years(sites: DataFrame, items: DataFrame, k: int, span: int, *, date: str, item_year: str, site: str, id: str) -> DataFrame:
    """Of the k items nearest to each site, how many have a year in [year(date), year(date) + span)."""
    found = knn(sites.select(site, "x", "y", date), items, k, id=id, attrs=[item_year])
    soon = (F.col(item_year) >= F.year(date)) & (F.col(item_year) < F.year(date) + span)
    return found.groupBy(site).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(soon, 1)).alias("n_in_years"))


def precedents(sites: DataFrame, history: DataFrame, *, site: str, k: int, submitted: str, special: tuple[str, str],
               missing_km: float = 999.0) -> DataFrame:
    """Statistics of the k nearest applications decided before each submission; null below k of them.

    The decision date is the history's submission plus its duration.
    """
    column, value = special
    decided = history.select(
        F.col(site).alias("_pid"), "x", "y", "granted", F.col(column).alias("_kind"),
        F.date_add(submitted, F.col("duration_days").cast("int")).alias("_decided"),
    )
    found = knn(sites.select(site, "x", "y", submitted), decided, k, id="_pid", attrs=["granted", "_kind"],
                before=(submitted, "_decided"))
    km = F.col("distance") / 1000
    w = 1 / (km + 1e-6)
    is_special, refused = F.col("_kind") == value, F.col("granted") == 0
    stats = found.groupBy(site).agg(
        F.count(F.lit(1)).alias("_n"), F.avg(km).alias("mean_km"), F.stddev_pop(km).alias("std_km"),
        F.min(km).alias("nearest_km"), F.avg("granted").alias("approval_rate"),
        (F.sum(F.col("granted") * w) / F.sum(w)).alias("weighted_approval"),
        F.count(F.when(is_special, 1)).alias("n_special"),
        F.coalesce(F.min(F.when(is_special, km)), F.lit(missing_km)).alias("nearest_special_km"),
        F.coalesce(F.min(F.when(refused, km)), F.lit(missing_km)).alias("nearest_refused_km"),
    )
    return sites.select(site).join(stats.filter(F.col("_n") == k).drop("_n"), site, "left")


def banded_haversine_knn(sites: DataFrame, items: DataFrame, k: int, *, site: str, id: str, band: str,
                         attrs: Sequence[str] = (), min_band: int = 20) -> DataFrame:
    """Geographic neighbours from the site's own band, or from all items when the band has too few."""
    sizes = items.groupBy(band).agg(F.count(F.lit(1)).alias("_n"))
    sized = sites.join(sizes, band, "left").withColumn("_own", F.coalesce(F.col("_n"), F.lit(0)) >= min_band)
    options = {"id": id, "attrs": attrs, "qx": "lon", "qy": "lat", "x": "lon", "y": "lat", "metric": HAVERSINE}
    cols = [site, "lon", "lat"]
    own = knn(sized.filter("_own").select(*cols, band), items, k, by=[band], **options).drop(band)
    return own.unionByName(knn(sized.filter("NOT _own").select(*cols), items, k, **options))


def legacy_precedent(sites: DataFrame, *, cutoff: int, site: str, r: float = 10000.0) -> DataFrame:
    """History from before the cutoff year described for every later application."""
    from sitegauge.operators.radius import sums_within

    old = sites.filter(F.year("submission_date") < cutoff)
    new = sites.filter(F.year("submission_date") >= cutoff).select(site, "lpa", "x", "y")
    label = str(int(r))
    out = sums_within(new, old, [r], {"n": F.lit(1), "ok": F.col("granted")})
    out = out.withColumns({
        "n_10km": F.col(f"n_{label}"), "rate_10km": F.when(F.col(f"n_{label}") > 0, F.col(f"ok_{label}") / F.col(f"n_{label}")),
    }).drop(f"n_{label}", f"ok_{label}")
    authority = old.groupBy("lpa").agg(F.avg("granted").alias("lpa_rate"), F.count(F.lit(1)).alias("lpa_n"))
    out = out.join(authority, "lpa", "left")
    past = old.select(F.col(site).alias("_pid"), "x", "y", "granted")
    for name, part in (("nearest_km", past), ("nearest_granted_km", past.filter("granted = 1")), ("nearest_refused_km", past.filter("granted = 0"))):
        found = nearest(new.select(site, "x", "y"), part, id="_pid", distance="_m")
        out = out.join(found.select(site, (F.col("_m") / 1000).alias(name)), site, "left")
    return out.drop("x", "y", "lpa")
