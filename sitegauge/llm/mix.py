"""Mixing sources to target weights by subset-sum fitting of lengths.

Sizes are words between ASCII white space. Each source gets a budget of words; the budgets are weights by the
source's place in code-point order, shared out of ``SHARE`` of all sizes, and held to twice the source's size,
the excess going to the other sources by weight until no source is above.

Every document of a source is taken ``budget // size of source`` times. For what is left, documents are
counted by exact length. Of a large budget the proportional number of each length is taken, ``HELD`` windows
of words short of it; what then still is above ``MOST_WINDOWS`` windows is filled from the longest length down.
The rest is fitted by a bounded-knapsack dynamic program over (length, count): reachable sums are kept
exactly, one a cell of ``rest // WINDOW + 1`` words, the greatest where several fall into one. Below ``WINDOW``
words every sum has its own cell, and the budget is hit exactly wherever a subset of documents does; above,
a better sum is missed only where it shares its cell. Of the documents of one length, the first by a seeded
hash of the id are taken, so reruns agree.

Sizes of work: a source's task sees one row per distinct length. Documents of one length are cut by hash
into buckets of about ``BUCKET`` rows; only counts of buckets are ordered per length, and only rows within a
bucket are ranked, so copies of one text in any number don't meet in one task.

Defined results. Null or blank text: size 0, never more words, taken 0. A null source is a source, the last.
Rows repeated are documents of their own; which of equal rows is taken doesn't show. An empty table gives
no rows; a source of size 0 has target 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitegauge.llm.common import stored

WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
WINDOW, BUCKET, SEED = 1 << 16, 1024, 20240607
HELD, MOST_WINDOWS, PARTS = 4, 16, 4096


def targets(sizes: list[int], weights: list[float], share: float = SHARE, most: float = MOST) -> list[float]:
    """Budgets by weight, none above ``most`` times its source's size; the excess is shared anew by weight."""
    total, out, open_ = share * sum(sizes), [0.0] * len(sizes), list(range(len(sizes)))
    while open_:
        unit = total / sum(weights[k] for k in open_)
        above = [k for k in open_ if unit * weights[k] > most * sizes[k]]
        if not above:
            for k in open_:
                out[k] = unit * weights[k]
            break
        for k in above:
            out[k] = most * sizes[k]
            total -= out[k]
        open_ = [k for k in open_ if k not in set(above)]
    return out


def subset(words: list[int], budget: int, window: int = WINDOW) -> list[int]:
    """Which of the items (by their words) sum up to the most that ``budget`` allows, as far as cells tell sums apart."""
    unit = budget // window + 1
    best = np.full(budget // unit + 1, -1, np.int64)
    best[0], past = 0, []
    for w in words:
        held = np.flatnonzero(best >= 0)
        sums = best[held] + w
        held, sums = held[sums <= budget], sums[sums <= budget]
        cells = sums // unit
        # Sums ascend, so of those in one cell the last is the greatest.
        better = np.append(cells[1:] != cells[:-1], np.ones(min(1, len(cells)), bool)) & (sums > best[cells])
        cells, sums, held = cells[better], sums[better], held[better]
        past.append((cells, best[cells], held))
        best[cells] = sums
        if best[-1] == budget:
            break
    cell, chosen = int(best.argmax()), []
    for k in range(len(past) - 1, -1, -1):
        cells, before, held = past[k]
        at = int(np.searchsorted(cells, cell))
        best[cells] = before
        if at < len(cells) and cells[at] == cell:
            chosen.append(k)
            cell = int(held[at])
    return chosen


def fitted(lengths: np.ndarray, counts: np.ndarray, budget: int, window: int = WINDOW, parts: int = PARTS) -> np.ndarray:
    """How many documents of each length to take so that their words come as near to ``budget`` from below as can be.

    Lengths are distinct and positive. Each count is cut into powers of two; where these are more than ``parts``,
    half of the program's items are the shortest ones that are left and half the longest.
    """
    taken = np.zeros(len(lengths), np.int64)
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    taken += (counts * (max(0, budget - HELD * window) / max(total, 1))).astype(np.int64)
    rest = budget - int((taken * lengths).sum())
    for k in np.argsort(-lengths, kind="stable"):
        if rest <= MOST_WINDOWS * window:
            break
        more = min(int(counts[k] - taken[k]), (rest - MOST_WINDOWS * window // 2) // int(lengths[k]))
        taken[k] += more
        rest -= more * int(lengths[k])
    items = []
    for k in np.argsort(lengths, kind="stable"):
        left, part = min(int(counts[k] - taken[k]), rest // int(lengths[k])), 1
        while left > 0:
            part = min(part, left)
            items.append((k, part))
            left, part = left - part, part * 2
    items = items if len(items) <= parts else [*items[: parts // 2], *items[-(parts // 2) :]]
    items.reverse()  # long ones first: the short ones fill what they leave
    for i in subset([part * int(lengths[k]) for k, part in items], rest, window):
        taken[items[i][0]] += items[i][1]
    return taken


def plan(docs: DataFrame, seed: int = SEED, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken (words of the mix, repeats counted), copies."""
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    slim = stored(docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64(F.lit(seed), "doc_id").alias("place")), "sizes")
    lengths = stored(slim.groupBy("source", "size").agg(F.count("*").alias("n")), "lengths")
    found = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")).collect()  # a row per source
    found = sorted(found, key=lambda r: (r.source is None, r.source or ""))
    budget = targets([r.source_size for r in found], [weights[k % len(weights)] for k in range(len(found))])
    sources = spark.createDataFrame([(r.source, r.source_size, b) for r, b in zip(found, budget, strict=True)], "name string, source_size long, target double")

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        whole, target = int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
        group = group.sort_values("size", ignore_index=True)
        copies = int(target // whole) if whole else 0
        positive = (group["size"] > 0).to_numpy()
        extra = np.zeros(len(group), np.int64)
        if copies < MOST and positive.any():
            extra[positive] = fitted(group["size"].to_numpy()[positive], group["n"].to_numpy()[positive], int(round(target)) - copies * whole)
        return group.assign(copies=copies, extra=extra)

    known = lengths.join(sources, F.col("source").eqNullSafe(F.col("name"))).drop("name")
    # applyInPandas turns a null key into None or NaN; the name is carried as given.
    plans = known.withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    fits = plans.groupBy("key").applyInPandas(lambda g: fit(g)[["key", "size", "n", "source_size", "target", "copies", "extra"]], "key string, size long, n long, source_size long, target double, copies long, extra long")
    fits = stored(fits.withColumn("buckets", F.ceil(F.col("n") / BUCKET).cast("long")), "fits")
    keyed = slim.withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source")
    rows = stored(keyed.join(fits, ["key", "size"]).withColumn("bucket", F.pmod(F.shiftright("place", 8), F.col("buckets"))), "planned")
    partial = (F.col("extra") > 0) & (F.col("extra") < F.col("n"))
    sure = rows.where(~partial).withColumn("more", (F.col("extra") > 0).cast("long"))
    open_ = rows.where(partial)
    bucket_counts = open_.groupBy("key", "size", "bucket").agg(F.count("*").alias("held"))
    ahead = F.coalesce(F.sum("held").over(Window.partitionBy("key", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = bucket_counts.withColumn("ahead", ahead).drop("held")
    ranked = open_.withColumn("rank", F.row_number().over(Window.partitionBy("key", "size", "bucket").orderBy("place", "doc_id")))
    chosen = ranked.join(ahead, ["key", "size", "bucket"]).withColumn("more", (F.col("ahead") + F.col("rank") <= F.col("extra")).cast("long"))
    columns = ["doc_id", "key", "size", "source_size", "target", "copies", "more"]
    out = sure.select(*columns).unionByName(chosen.select(*columns)).withColumn("copies", F.col("copies") + F.col("more"))
    source = F.when(F.col("key") != "", F.substring("key", 2, 2**31 - 1)).alias("source")
    return out.select("doc_id", source, "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken; same columns.

    Rows equal in id, source and size are planned together: they share what the plan takes of them.
    """
    plans = plan(docs, seed)
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    keys = plans.groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("__sum"), F.count("*").alias("__n"))
    keys = stored(keys.withColumnsRenamed({"doc_id": "__id", "source": "__source", "size": "__size"}), "copies")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").cast("string").eqNullSafe(F.col("__source")) & (F.col("__words") == F.col("__size"))
    rows = docs.withColumn("__words", size).join(keys, same)
    # Equal keys: the k-th row takes the whole share and one more while there is a rest.
    if keys.where("__n > 1").isEmpty():
        share = F.col("__sum")
    else:
        nth = F.row_number().over(Window.partitionBy("__id", "__source", "__size").orderBy(F.xxhash64("text")))
        share = F.floor(F.col("__sum") / F.col("__n")) + (nth <= F.col("__sum") % F.col("__n")).cast("long")
    rows = rows.withColumn("__share", share).where("__share > 0")
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__share").cast("long")))).select(*docs.columns)
