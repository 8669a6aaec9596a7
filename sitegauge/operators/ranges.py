"""Positions in sorted groups of any size: range partitions and prefix sums of their sizes.

Rows are dealt to sorted ranges of all groups together, so a group that holds most rows is spread over many
tasks. Inside a range a row's number is known; the sizes of the ranges before it, one row a range and group,
are summed and added. No group is ever gathered, and no join is made on the group alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitegauge.session import cut_lineage

#: Rows of a range lie in one task; monotonically_increasing_id puts the task above this bit.
_TASK_BITS = 33
#: Up to so many ranges and groups their sizes are sent to all tasks.
BROADCAST_RANGES = 20_000


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], at: str = "at", size: str | None = None) -> DataFrame:
    """``at``: 0-based position of each row in its group by ``order``; ``size``: rows of the group.

    Null group keys are groups of their own. Rows that tie on all of ``order`` get positions in any order, but
    each once. The sorted rows are written to the checkpoint folder first, so positions don't change when a
    task is run again. An empty table stays empty.
    """
    keys, names = [F.col(k) for k in group], list(df.columns)
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = df.repartitionByRange(*keys, *by).sortWithinPartitions(*keys, *by)
    ranged = cut_lineage(ranged.withColumn("__row", F.monotonically_increasing_id()))
    ranged = ranged.withColumns({"__task": F.shiftright("__row", _TASK_BITS), "__group": F.struct(*keys) if keys else F.struct(F.lit(0))})
    sizes = ranged.groupBy("__task", "__group").agg(F.count(F.lit(1)).alias("__n"), F.min("__row").alias("__first"))
    before = Window.partitionBy("__group").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    if size:
        sizes = sizes.withColumn(size, F.sum("__n").over(Window.partitionBy("__group")))
    sizes = cut_lineage(sizes.drop("__n"))
    out = ranged.join(F.broadcast(sizes) if sizes.count() <= BROADCAST_RANGES else sizes, ["__task", "__group"])
    out = out.withColumn(at, F.col("__before") + F.col("__row") - F.col("__first"))
    return out.select(*[f"`{n}`" for n in names], at, *([size] if size else []))
