"""Counts, sums and clipped lengths within one or more radii of each point.

Cells lying wholly inside or outside every radius are settled from their stored sums; single items
are met only in the leaves a circle cuts.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.functions import geometry as geo
from sitegauge.operators import pyramid as pyr
from sitegauge.operators.joins import sized

Total = Callable[[str, float], Column]


def _label(r: float) -> str:
    return str(int(r)) if float(r).is_integer() else str(r).replace(".", "_")


def _walk(frontier: DataFrame, index: pyr.Pyramid, radii: Sequence[float]) -> DataFrame:
    """Cells meeting the largest circle, each settled or a leaf that some circle cuts."""
    x, y, h = F.col("_qx"), F.col("_qy"), F.col("_h")
    clear = F.lit(True)
    for r in radii:
        clear = clear & ((F.col("_hi") < float(r) * (1 - 1e-12)) | (F.col("_lo") > float(r) * (1 + 1e-12)))
    for level in range(1, index.depth + 1):
        frontier = pyr.step(frontier, index, level, drop=("_hi", "_settled"))
        frontier = frontier.withColumn("_lo", geo.box_min_distance(x, y, *pyr.box()) - h)
        frontier = frontier.filter(F.col("_lo") <= F.lit(float(max(radii)) * (1 + 1e-9)))
        frontier = frontier.withColumn("_hi", geo.box_max_distance(x, y, *pyr.box()) + h)
        frontier = frontier.withColumn("_settled", clear).drop("_lo")
        if level < index.depth:
            whole = F.col("_settled") & ~F.col("_leaf") & (F.col("_cell") > 0)
            frontier = frontier.withColumn("_cell", F.when(whole, -F.col("_cell")).otherwise(F.col("_cell")))
    return frontier


def _leaf_join(frontier: DataFrame, index: pyr.Pyramid, how: str) -> DataFrame:
    """Items of the unsettled leaves; settled rows pass a left join on spread keys that match nothing."""
    items = index.items.withColumnsRenamed({c: f"_i_{c}" for c in index.items.columns})
    if how == "left":
        spread = -1 - F.pmod(F.xxhash64("_qx", "_qy", "_cell"), F.lit(pyr.SPREAD))
        frontier = frontier.withColumn("_probe", F.when(F.col("_settled"), spread).otherwise(F.col("_cell")))
    else:
        frontier = frontier.withColumn("_probe", F.col("_cell"))
    frontier = frontier.drop("_n", "_h", "_x0", "_y0", "_x1", "_y1", "_leaf")
    condition = frontier["_probe"] == items["_i__cell"]
    for c in index.by:
        condition = condition & (frontier[c] == items[f"_i_{c}"])
    return frontier.join(sized(items, index.rows), condition, how)


def sums_within(
    points: DataFrame,
    items: DataFrame,
    radii: Sequence[float],
    measures: Mapping[str, Column],
    *,
    x: str = "x",
    y: str = "y",
    ix: str = "x",
    iy: str = "y",
    by: Sequence[str] = (),
) -> DataFrame:
    """``points`` plus, per radius r, the sum of each measure over items within r (0 when none).

    A count is the measure ``F.lit(1)``.
    """
    items = items.select(*dict.fromkeys([*by, ix, iy]), *[m.alias(f"m_{n}") for n, m in measures.items()])
    items = items.groupBy(*by, ix, iy).agg(*[F.sum(f"m_{n}").alias(f"m_{n}") for n in measures])
    index = pyr.build(items, ix, iy, by=by, sums={n: F.col(f"m_{n}") for n in measures})
    d = geo.distance(F.col("_qx"), F.col("_qy"), F.col("_i__px"), F.col("_i__py"))

    def stage(rows: DataFrame) -> DataFrame:
        settled = F.col("_settled")
        return rows.select(
            *by, x, y, F.when(settled, F.col("_hi")).otherwise(d).alias("_d"),
            *[F.when(settled, F.col(f"_sum_{n}")).otherwise(F.col(f"_i_m_{n}")).alias(f"_m_{n}") for n in measures],
        )

    def total(name: str, r: float) -> Column:
        return F.sum(F.when(F.col("_d") <= r, F.col(f"_m_{name}")))

    return _aggregate(points, index, radii, list(measures), stage, total, x, y, by)


def length_within(
    points: DataFrame,
    segments: DataFrame,
    radii: Sequence[float],
    *,
    x: str = "x",
    y: str = "y",
    by: Sequence[str] = (),
    ends: Sequence[str] = ("ax", "ay", "bx", "by"),
    name: str = "length",
) -> DataFrame:
    """``points`` plus the line length clipped to each radius."""
    index = index_segments(segments, ends, by, with_length=True)
    e = [F.col(f"_i__{c}") for c in ("ax", "ay", "bx", "by")]

    def total(_: str, r: float) -> Column:
        whole = F.when(F.col("_hi") <= r, F.col("_sum_length"))
        return F.sum(F.when(F.col("_settled"), whole).otherwise(geo.length_in_disc(F.col("_qx"), F.col("_qy"), F.lit(float(r)), *e)))

    return _aggregate(points, index, radii, ["length"], lambda rows: rows, total, x, y, by, {"length": name})


def index_segments(segments: DataFrame, ends: Sequence[str], by: Sequence[str] = (), keep: Sequence[str] = (),
                   with_length: bool = False, width: str | None = None) -> pyr.Pyramid | None:
    """Lines filed by their pieces; ``width`` names a column by which each line reaches further."""
    named = dict(zip(("_ax", "_ay", "_bx", "_by"), ends, strict=True))
    lines = segments.select(*dict.fromkeys([*by, *keep, *([width] if width else [])]), *[F.col(c).cast("double").alias(n) for n, c in named.items()])
    pieces = pyr.filed_pieces(lines.dropna(subset=list(named)), list(named))
    if with_length:
        s, e = F.col("_piece") / F.col("_pieces"), (F.col("_piece") + 1) / F.col("_pieces")
        dx, dy = F.col("_bx") - F.col("_ax"), F.col("_by") - F.col("_ay")
        pieces = pieces.withColumns({"_ax": F.col("_ax") + dx * s, "_ay": F.col("_ay") + dy * s, "_bx": F.col("_ax") + dx * e, "_by": F.col("_ay") + dy * e, "_len": F.col("_half") * 2})
    reach = F.col("_half") + F.col(width) if width else F.col("_half")
    return pyr.build(pieces, "_mx", "_my", reach=reach, by=by, sums={"length": F.col("_len")} if with_length else None)


def _aggregate(points, index, radii, names, stage, total: Total, x, y, by, labels=None) -> DataFrame:
    labels = labels or {}
    outs = [(n, float(r), f"{labels.get(n, n)}_{_label(r)}") for n in names for r in radii]
    if index is None:
        return points.withColumns({o: F.lit(0.0) for _, _, o in outs})
    places = [*by, x, y]
    rows = stage(_leaf_join(_walk(pyr.start(points, x, y, places), index, radii), index, "left"))
    totals = rows.groupBy(*places).agg(*[total(n, r).alias(o) for n, r, o in outs])
    out = points.join(totals, places, "left")
    return out.withColumns({o: F.coalesce(F.col(o), F.lit(0)) for _, _, o in outs})


def pairs_within(
    points: DataFrame,
    items: DataFrame,
    r: float,
    *,
    keep: Sequence[str],
    ends: Sequence[str] | None = None,
    x: str = "x",
    y: str = "y",
    ix: str = "x",
    iy: str = "y",
    distinct: bool = False,
) -> DataFrame:
    """Distinct places of ``points`` paired with the items within r: x, y, ``keep``, distance.

    ``distinct`` reduces items alike in place and ``keep`` to one, for callers that only ask whether.
    """
    if distinct:
        items = items.select(*dict.fromkeys([*keep, *(ends or (ix, iy))])).distinct()
    if ends:
        index = index_segments(items, ends, keep=keep)
        e = [F.col(f"_i__{c}") for c in ("ax", "ay", "bx", "by")]
        d = geo.segment_distance(F.col("_qx"), F.col("_qy"), *e)
        # Of a line's pieces only the one with the place nearest to the point forms the pair.
        own = F.col("_i__piece") == pyr.piece_at(geo.nearest_place(F.col("_qx"), F.col("_qy"), *e), F.col("_i__pieces"))
    else:
        index = pyr.build(items.select(*dict.fromkeys([*keep, ix, iy])), ix, iy)
        d, own = geo.distance(F.col("_qx"), F.col("_qy"), F.col("_i__px"), F.col("_i__py")), F.lit(True)
    if index is None:
        return points.select(x, y).join(items.select(*keep), F.lit(False)).withColumn("distance", F.lit(0.0))
    frontier = pyr.start(points, x, y, [x, y])
    lo, _ = pyr.planar_bounds(F.col("_qx"), F.col("_qy"))
    for level in range(1, index.depth + 1):
        frontier = pyr.step(frontier, index, level).filter(lo <= F.lit(float(r) * (1 + 1e-9)))
    rows = _leaf_join(frontier, index, "inner")
    rows = rows.filter(own).withColumn("_d", d).filter(F.col("_d") <= float(r))
    return rows.select(x, y, *[F.col(f"_i_{c}").alias(c) for c in keep], F.col("_d").alias("distance"))
