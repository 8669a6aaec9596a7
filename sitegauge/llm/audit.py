"""How filters interact: sorted posting lists of failing ids, merged by galloping.

For each part of a table and each filter, the ids that fail are kept as sorted lists, one a range of ids. A
range's lists are merged once, all together: where one list alone is ahead, its run up to the next head of
any other list is found by doubling steps and counted whole; where several lists meet, they advance together.
The merge gives the number of ids for each set of lists that hold them, and from it the sizes of all unions
and differences. Sizes of ranges are summed; what any order of the filters removes follows from 2 ** k unions.

Rows are dealt to sorted ranges of (part, id), so a large part is many ranges, and a list holds at most
``RANGE_ROWS`` ids. Lists hold positions: the row's range in the upper bits, its number in the range below,
ascending with the id, so that rows repeated with one id are entries of their own.

Defined results. A null or empty text has no words and no characters: it fails "short" only, and "copy" where a
smaller id has such a text too. A null part and the empty part are one, the empty text. A null id comes first
in its range; it is never smaller than another id, and it is a copy where any other id has its text. Rows that
repeat an id and its text are no copies of each other. Labels of a null id count for nothing; an id with
several labels has each mark that any of them gives. An empty table has no parts. Columns beyond those named
are never read.
"""

from __future__ import annotations

import itertools
from bisect import bisect_left
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitegauge.llm.common import batch, stored

RANGE_ROWS = 1 << 13
FILTERS = "ABCDE"
MARKS = ("good", "toxic")


def text_filters(text: Column) -> dict[str, Column]:
    """Failure of a text by itself: too short, repetitive, shouting, markup."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    distinct, upper = F.size(F.array_distinct(words)), F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 100,
        "B": distinct * 100 < F.size(words) * 80,
        "C": upper * 100 > F.length(text) * 10,
        "D": text.rlike("[#$%&*|]"),
    }


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, part, a flag a filter, and the marks of its labels."""
    text = F.coalesce("text", F.lit(""))
    facts = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), *[c.alias(f) for f, c in text_filters(F.col("text")).items()])
    facts = stored(facts, "facts")
    # Only texts that occur with several ids are joined back; a text in a third of all rows is one row here.
    known = facts.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.max(F.col("doc_id").isNull()).alias("unknown"))
    known = known.where("least < most OR (unknown AND least IS NOT NULL)").select("digest", "least")
    copy = F.col("least").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("least")))
    facts = facts.join(known, "digest", "left").withColumn("E", copy).drop("digest", "least")
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    facts = facts.join(marks, "doc_id", "left")
    return facts.withColumns({m: F.coalesce(m, F.lit(False)) for m in MARKS})


def postings(rows: DataFrame, flags: Sequence[str], id: str = "doc_id", part: str = "part") -> DataFrame:
    """Sorted posting lists: part, range, n (rows in the range) and for each flag the ascending positions of rows that have it.

    ``first_id`` and ``last_id`` bound the ids of a range.
    """
    fields = [("part", pa.string()), ("range", pa.int64()), ("n", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64())]
    schema = pa.schema([*fields, *((f, pa.list_(pa.int64())) for f in flags)])

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, 0

        def close() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            ids = t.column("id").drop_null()
            place = t.column("row").to_numpy()
            columns = {f: [place[np.asarray(t.column(f).combine_chunks())]] for f in flags}
            ends = {"first_id": [ids[0].as_py() if len(ids) else None], "last_id": [ids[-1].as_py() if len(ids) else None]}
            return batch(schema, part=[t.column("part")[0].as_py()], range=[int(place[0])], n=[len(t)], **ends, **columns)

        for b in batches:
            names = b.column("part").to_pylist()
            cuts = [0, *(k for k in range(1, len(names)) if names[k] != names[k - 1]), len(names)]
            for lo, hi in itertools.pairwise(cuts):
                while lo < hi:
                    if held and (held[0].column("part")[0].as_py() != names[lo] or size >= RANGE_ROWS):
                        yield close()
                        held, size = [], 0
                    take = min(hi - lo, RANGE_ROWS - size)
                    held.append(b.slice(lo, take))
                    lo, size, number = lo + take, size + take, number + take
        if held:
            yield close()

    ranged = rows.repartitionByRange(part, id).sortWithinPartitions(part, id)
    ranged = ranged.select(F.col(part).alias("part"), F.col(id).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), *flags)
    sql = "part string, range long, n long, first_id long, last_id long, " + ", ".join(f"{f} array<long>" for f in flags)
    return ranged.mapInArrow(lists, sql)


def gallop(ids: Sequence[int], start: int, limit: int) -> int:
    """First place from ``start`` on whose id is at least ``limit``, by doubling steps and then halving."""
    step, low = 1, start
    while low + step < len(ids) and ids[low + step] < limit:
        low += step
        step *= 2
    return bisect_left(ids, limit, low, min(low + step + 1, len(ids)))


def merged(lists: Sequence[Sequence[int]]) -> np.ndarray:
    """Ids by the set of lists that hold them: one merge of all sorted lists; place m counts those in exactly the lists of mask m."""
    counts, places = np.zeros(1 << len(lists), np.int64), [0] * len(lists)
    open_lists = [k for k, ids in enumerate(lists) if len(ids)]
    while open_lists:
        heads = [(lists[k][places[k]], k) for k in open_lists]
        least = min(heads)[0]
        here = [k for head, k in heads if head == least]
        if len(here) == 1:
            k, rest = here[0], [head for head, _ in heads if head != least]
            end = gallop(lists[k], places[k], min(rest)) if rest else len(lists[k])
            counts[1 << k] += end - places[k]
            places[k] = end
        else:
            counts[sum(1 << k for k in here)] += 1
            for k in here:
                places[k] += 1
        if any(places[k] == len(lists[k]) for k in here):
            open_lists = [k for k in open_lists if places[k] < len(lists[k])]
    return counts


def unions(lists: DataFrame, filters: Sequence[str], marks: Sequence[str]) -> DataFrame:
    """Per part and set of filters (bits in their order): n (rows of the part), gone (rows failing any filter of the set), and gone of each mark."""
    names = [*filters, *marks]
    schema = pa.schema([(c, pa.string() if c == "part" else pa.int64()) for c in ("part", "filters", "n", "gone", *(f"gone_{m}" for m in marks))])
    sets = np.arange(1 << len(filters))
    masks = np.arange(1 << len(names))
    hit = (sets[:, None] & masks[None, :]) != 0
    wanted = [hit, *(hit & ((masks >> (len(filters) + k)) & 1 == 1)[None, :] for k in range(len(marks)))]

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                counts = merged([b.column(f)[k].values.to_pylist() for f in names])
                own = dict(zip(schema.names[3:], (w @ counts for w in wanted), strict=True))
                yield batch(schema, part=[b.column("part")[k].as_py()] * len(sets), filters=sets, n=[b.column("n")[k].as_py()] * len(sets), **own)

    sql = ", ".join(f"{f.name} {'string' if f.name == 'part' else 'long'}" for f in schema)
    found = lists.select("part", "n", *names).mapInArrow(sizes, sql)
    return found.groupBy("part", "filters").agg(*[F.sum(c).alias(c) for c in schema.names[2:]])


def orders(sizes: DataFrame, filters: Sequence[str], marks: Mapping[str, str]) -> DataFrame:
    """Per part, order of all filters and step: kept, removed, redundant, unique_fails, what marked rows it costs (``marks``: name of the mark to name of the column), and the filter's Shapley share summed over all orders."""
    every = (1 << len(filters)) - 1
    known = sizes.groupBy("part").agg(F.max("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("filters", F.struct("gone", *(f"gone_{m}" for m in marks))))).alias("by"))
    all_orders = F.array(*[F.lit("".join(p)) for p in itertools.permutations(filters)])
    steps = known.withColumn("filter_order", F.explode(all_orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))))
    bits = lambda text: sum((F.when(F.contains(text, F.lit(f)), 1 << k).otherwise(0) for k, f in enumerate(filters)), F.lit(0)).cast("long")
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    steps = steps.withColumns({"letter": letter, "own": bits(letter), "after": bits(F.substring("filter_order", F.lit(1), F.col("step")))})
    steps = steps.withColumn("before", F.col("after") - F.col("own"))
    gone = lambda key, what="gone": F.col("by")[key][what]
    removed = gone(F.col("after")) - gone(F.col("before"))
    out = steps.select(
        "part", "filter_order", "step", "letter", (F.col("n") - gone(F.col("after"))).alias("kept"), removed.alias("removed"),
        (gone(F.col("own")) - removed).alias("redundant"), (gone(F.lit(every).cast("long")) - gone(F.lit(every).cast("long") - F.col("own"))).alias("unique_fails"),
        *[(gone(F.col("after"), f"gone_{m}") - gone(F.col("before"), f"gone_{m}")).alias(name) for m, name in marks.items()],
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter"))).drop("letter")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All orders of the five filters on each part of ``docs``; the posting lists are written on the way."""
    lists = stored(postings(judged(docs, labels), [*FILTERS, *MARKS]), "postings")
    return orders(unions(lists, FILTERS, MARKS), FILTERS, {"good": "good_lost", "toxic": "toxic_lost"})
