"""Spatial pyramid: per-cell counts and bounds at several grid levels, used to prune candidates.

Each level splits a cell into 4 x 4. A cell stops splitting once it holds at most ``leaf_rows`` items,
so a dense place becomes many small cells and every leaf stays small. Queries walk down from the
root by inner equi-joins on the parent cell, keeping only cells that can still matter; items are
touched only in the leaves that survive. Cells carry the tight bounds of their items, the largest
reach of an item around its centre (0 for points) and sums of any measures asked for.

Finished cells repeat as their own child on the levels below, so every step is the same plain join:
leaves under their own number, whole cells taken as settled under the negated number.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitegauge.functions import geometry as geo
from sitegauge.operators.joins import join_sized, sized

FAN_BITS = 2
MAX_DEPTH = 12
REFINE_LEVELS = 2
LEVEL_BITS, ROW_BITS = 54, 27
BROADCAST_CELLS = 4096
SPREAD = 1 << 20
STATS = ("_n", "_h", "_x0", "_y0", "_x1", "_y1")


@dataclass
class Pyramid:
    """``items`` carry their leaf in ``_cell``; ``cells`` has one row per (level, cell).

    ``rows`` items were filed, and no level has more than ``occupied`` cells.
    """

    items: DataFrame
    cells: DataFrame
    depth: int
    by: tuple[str, ...]
    stats: tuple[str, ...]
    rows: int
    occupied: int


def _cell_at(level: Column) -> Column:
    """Cell number at ``level`` of the finest cell (_ix, _iy): level, row and column packed in a long."""
    shift = (F.lit(MAX_DEPTH) - level) * FAN_BITS
    row = F.call_function("shiftright", F.col("_ix"), shift)
    column = F.call_function("shiftright", F.col("_iy"), shift)
    tag = F.call_function("shiftleft", level.cast("long"), F.lit(LEVEL_BITS))
    return tag + F.call_function("shiftleft", row, F.lit(ROW_BITS)) + column


def _level_cells(items: DataFrame, first: int, last: int, by: Sequence[str], sums: Mapping[str, Column],
                 nth_key: tuple[str, int] | None, rows: int) -> DataFrame:
    """Statistics of every occupied cell on the levels first..last, combined before the shuffle."""
    levels = items.withColumn("_lvl", F.explode(F.sequence(F.lit(first), F.lit(last))))
    parent = F.when(F.col("_lvl") > 1, _cell_at(F.col("_lvl") - 1)).otherwise(F.lit(0).cast("long"))
    levels = levels.withColumns({"_cell": _cell_at(F.col("_lvl")), "_parent": parent})
    key = [*by, "_cell"]
    cells = levels.groupBy(*key).agg(
        F.first("_lvl").alias("_lvl"), F.first("_parent").alias("_parent"),
        F.count(F.lit(1)).alias("_n"), F.max("_reach").alias("_h"),
        F.min("_px").alias("_x0"), F.min("_py").alias("_y0"),
        F.max("_px").alias("_x1"), F.max("_py").alias("_y1"),
        *[F.sum(c).alias(f"_sum_{name}") for name, c in sums.items()],
        *([F.min(nth_key[0]).alias("_key_min")] if nth_key else []),
    )
    if not nth_key:
        return cells
    column, k = nth_key
    nth = (
        levels.select(*key, F.col(column).alias("_key_nth"))
        .withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy("_key_nth")))
        .filter(F.col("_rn") <= k)
        .groupBy(*key).agg(F.max("_key_nth").alias("_key_nth"), F.count(F.lit(1)).alias("_have"))
        .filter(F.col("_have") == k).drop("_have")
    )
    return cells.join(sized(nth, rows), key, "left")


def build(
    items: DataFrame,
    x: str = "x",
    y: str = "y",
    *,
    reach: Column | None = None,
    by: Sequence[str] = (),
    sums: Mapping[str, Column] | None = None,
    leaf_rows: int = 64,
    nth_key: tuple[str, int] | None = None,
) -> Pyramid | None:
    """Index ``items`` by their centre; None when there are none.

    ``nth_key=(column, k)`` also keeps each cell's smallest and k-th smallest value of that column,
    so a query can tell whether a cell holds k items below its own threshold.
    """
    sums, by = dict(sums or {}), tuple(by)
    items = items.withColumns({"_px": F.col(x).cast("double"), "_py": F.col(y).cast("double"),
                               "_reach": reach if reach is not None else F.lit(0.0)})
    items = items.filter(F.col("_px").isNotNull() & F.col("_py").isNotNull())
    n, x0, y0, x1, y1 = items.agg(
        F.count(F.lit(1)), F.min("_px"), F.min("_py"), F.max("_px"), F.max("_py")
    ).first()
    if not n:
        return None
    span = max(x1 - x0, y1 - y0, 1e-6) * (1 + 1e-9)
    side = 4**MAX_DEPTH

    def index(c: str, origin: float) -> Column:
        return F.least(F.floor((F.col(c) - origin) / span * side), F.lit(side - 1)).cast("long")

    items = items.withColumns({"_ix": index("_px", x0), "_iy": index("_py", y0)})
    stats = [*STATS, *[f"_sum_{name}" for name in sums], *(["_key_min", "_key_nth"] if nth_key else [])]
    bottom = min(MAX_DEPTH, max(1, math.ceil(math.log(max(n / leaf_rows, 1), 16))) + 1)
    cells = _level_cells(items, 1, bottom, by, sums, nth_key, n).persist()
    whole = (F.col("_n") <= leaf_rows) | ((F.col("_x0") == F.col("_x1")) & (F.col("_y0") == F.col("_y1")))
    while True:
        crowded = ~whole & (F.col("_lvl") == bottom)
        top_open, left, occupied = cells.agg(F.max(F.when(~whole, F.col("_lvl"))), F.count(F.when(crowded, 1)), F.count(F.lit(1))).first()
        if not left or bottom == MAX_DEPTH:
            break
        # Only items of cells still crowded at the bottom are counted on finer levels.
        lower = min(bottom + REFINE_LEVELS, MAX_DEPTH)
        again = items.withColumn("_cell", _cell_at(F.lit(bottom))).join(sized(cells.filter(crowded).select(*by, "_cell"), left), [*by, "_cell"], "left_semi")
        cells = cells.unionByName(_level_cells(again.drop("_cell"), bottom + 1, lower, by, sums, nth_key, n).persist())
        bottom = lower
    cells = cells.withColumn("_leaf", whole | (F.col("_lvl") == MAX_DEPTH))
    deepest = min((top_open or 0) + 1, MAX_DEPTH)

    parents = cells.select(*by, F.col("_cell").alias("_parent"), F.col("_leaf").alias("_covered"))
    live = (
        cells.filter(F.col("_lvl") <= deepest).join(sized(parents, occupied), [*by, "_parent"], "left")
        .filter(~F.coalesce(F.col("_covered"), F.lit(False))).drop("_covered")
    )
    live = live.withColumn("_at", F.explode(F.sequence(F.col("_lvl"), F.lit(deepest))))
    repeat = F.col("_at") > F.col("_lvl")
    number = F.when(F.col("_leaf"), F.col("_cell")).otherwise(-F.col("_cell"))
    steps = live.select(
        *by, "_at",
        F.when(repeat, number).otherwise(F.col("_parent")).alias("_parent"),
        F.when(repeat, number).otherwise(F.col("_cell")).alias("_cell"),
        "_leaf", *stats,
    ).persist()

    leaves = steps.filter((F.col("_at") == deepest) & F.col("_leaf")).select(*by, "_cell")
    filed = items.withColumn("_lvl", F.explode(F.sequence(F.lit(1), F.lit(deepest)))).withColumn("_cell", _cell_at(F.col("_lvl")))
    placed = join_sized(filed, leaves, [*by, "_cell"], n, occupied).drop("_ix", "_iy", "_lvl", "_reach", "_half")
    return Pyramid(placed, steps, deepest, by, tuple(stats), n, occupied)


def filed_pieces(lines: DataFrame, ends: Sequence[str], split: bool = True) -> DataFrame:
    """Lines cut into pieces no longer than the mean length, to be filed one by one.

    A cell reaches as far as half its longest item, so one long line in a cell would open it to queries far
    away. Pieces are at most twice as many as lines, whatever the lengths. ``_mx``, ``_my`` is a piece's middle,
    ``_half`` half its length, ``_piece`` its number of ``_pieces``; the line's own columns stay.
    """
    ax, ay, bx, by = (F.col(c) for c in ends)
    length = geo.distance(ax, ay, bx, by)
    mean = lines.agg(F.avg(length)).first()[0] if split else None
    n = F.greatest(F.lit(1), F.ceil(length / mean)).cast("int") if mean else F.lit(1)
    out = lines.withColumn("_pieces", F.coalesce(n, F.lit(1)))
    out = out.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1)))
    middle = (F.col("_piece") + 0.5) / F.col("_pieces")
    return out.withColumns({"_mx": ax + (bx - ax) * middle, "_my": ay + (by - ay) * middle, "_half": length / 2 / F.col("_pieces")})


def piece_at(t: Column, pieces: Column) -> Column:
    """Number of the piece that holds the line's place at ``t`` (0 to 1)."""
    return F.greatest(F.lit(0), F.least(F.floor(t * pieces), pieces - 1))


def start(points: DataFrame, x: str, y: str, places: Sequence[str]) -> DataFrame:
    """Distinct places to search, at the root.

    The spread over partitions is fixed here because the walk multiplies rows far beyond what the
    size of this small input would suggest.
    """
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    searched = points.select(*places).dropna(subset=[x, y]).distinct().repartition(tasks, *places)
    return searched.withColumns({
        "_qx": F.col(x).cast("double"), "_qy": F.col(y).cast("double"), "_cell": F.lit(0).cast("long"),
    })


def step(frontier: DataFrame, pyramid: Pyramid, level: int, drop: Sequence[str] = ()) -> DataFrame:
    """Replace every cell of the frontier by its children at ``level``, with their statistics."""
    kids = pyramid.cells.filter(F.col("_at") == level).select(
        *[F.col(c).alias(f"_k_{c}") for c in pyramid.by],
        F.col("_parent").alias("_open"), F.col("_cell").alias("_kid"), "_leaf", *pyramid.stats,
    )
    if not pyramid.by and 16**level <= BROADCAST_CELLS:
        kids = F.broadcast(kids)
    else:
        kids = sized(kids, pyramid.occupied)
    frontier = frontier.drop("_leaf", *pyramid.stats, *drop)
    condition = frontier["_cell"] == kids["_open"]
    for c in pyramid.by:
        condition = condition & (frontier[c] == kids[f"_k_{c}"])
    joined = frontier.join(kids, condition).drop("_cell", "_open", *[f"_k_{c}" for c in pyramid.by])
    return joined.withColumnRenamed("_kid", "_cell")


def box() -> list[Column]:
    return [F.col(c) for c in ("_x0", "_y0", "_x1", "_y1")]


def planar_bounds(x: Column, y: Column) -> tuple[Column, Column]:
    """Bounds on the distance from (x, y) to any item of the cell; an item's centre lies on it."""
    near = geo.box_min_distance(x, y, *box()) - F.col("_h")
    return F.greatest(near, F.lit(0.0)), geo.box_max_distance(x, y, *box())
