"""Repeated passages by compaction of a De Bruijn graph of words.

A window of ``WINDOW`` words is an edge from its first words (a node) to its last ones (the next node), so two
64-bit node keys name an edge. A window that starts in several documents is a repeated edge. Where exactly one
repeated edge enters a node and one leaves it, the two are on one path; paths are compacted by joins: first
edges that follow each other in their first document (a piece), then, by pointer jumping, pieces that follow
each other. The place where an edge's words stand first is its source coordinate.

Not every window becomes a row. The smallest hash of ``SEED`` words inside a window is its seed; runs of windows
with one seed are units. Equal windows have equal seeds, so only units whose seed is in several documents go
on. Where all units of a seed are equal, none of their windows is anywhere else: the unit is one segment of the
graph. Only the distinct units of the other seeds are opened into single edges. A unit's words are digested at
its source coordinates, and what stands elsewhere is removed only where its words give that digest.

Texts are never gathered by key; a window in a third of all documents is one row a task in partial sums, and
joins on seeds and units can be split where they are skewed, as one side has one row a key.

Defined results. Null, empty or shorter texts than a window: no window, nothing removed. Windows repeated
inside one document, or in rows with the same doc_id, are not repeats. A null doc_id counts as the greatest:
its windows never remove others'. Words are compared as they are, case and signs included; they are split at
ASCII white space only. Columns beyond doc_id and text are not read. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitegauge.llm.common import batch, discard, pieces, small_batches, stored, utf8
from sitegauge.llm.words import SPACED, exact_hashes, mixed, window_hashes, word_bounds

WINDOW, SEED = 13, 4
BYTES_PER_STEP = 1 << 19
LAST = 2**63 - 1
_ODD, _INVERSE = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.cumprod(steps, dtype=np.uint64)


def _words(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, start and end of each word, first word of each text, word hashes."""
    data, offsets = utf8(b.column("text"))
    starts, ends, first = word_bounds(data, offsets, SPACED)
    return data, starts, ends, first, exact_hashes(data, starts, ends)


def units(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of one text with one seed: text, first word, number of windows, seed and key of the words."""
    n = len(hashes) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    low, width = window_hashes(hashes, SEED), 1
    wanted = WINDOW - SEED + 1
    while width < wanted:  # smallest of runs of seeds, twice as long each time
        step = min(width, wanted - width)
        low = np.minimum(low[: len(low) - step], low[step:])
        width += step
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    whole = owner[:n] == owner[WINDOW - 1 :]
    begins = whole.copy()
    begins[1:] &= ~whole[:-1] | (low[1:n] != low[: n - 1]) | (owner[1:n] != owner[: n - 1])
    at = np.flatnonzero(begins)
    after = np.flatnonzero(whole & np.concatenate([begins[1:] | ~whole[1:], [True]])) + 1
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * _powers(_ODD, len(hashes)), dtype=np.uint64)])
    keys = mixed((total[after + WINDOW - 1] - total[at]) * _powers(_INVERSE, len(hashes))[at] + (after - at).astype(np.uint64))
    return owner[at], at - first[owner[at]], after - at, low[at], keys


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc", pa.int64()), ("seed", pa.int64())])
    for b in pieces(batches, "text", BYTES_PER_STEP):
        *_, first, hashes = _words(b)
        text, _, _, seeds, _ = units(hashes, first)
        yield batch(schema, doc=b.column("doc").to_numpy()[text], seed=seeds.view(np.int64))


_UNIT = pa.schema([(c, pa.int64()) for c in ("doc", "copy", "start", "windows", "seed", "unit")])


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, "text", BYTES_PER_STEP):
        *_, first, hashes = _words(b)
        text, start, windows, seeds, keys = units(hashes, first)
        own = {c: b.column(c).to_numpy()[text] for c in ("doc", "copy")}
        yield batch(_UNIT, start=start, windows=windows, seed=seeds.view(np.int64), unit=keys.view(np.int64), **own)


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First and last node and digest of each wanted unit, and all its nodes where it is not whole."""
    schema = pa.schema([("id", pa.int64()), ("whole", pa.bool_()), ("node", pa.int64()), ("next", pa.int64()), ("nodes", pa.list_(pa.int64())), ("digest", pa.binary())])
    for b in pieces(batches, "text", BYTES_PER_STEP):
        data, starts, ends, first, hashes = _words(b)
        nodes = window_hashes(hashes, WINDOW - 1).view(np.int64)
        wanted = b.column("wanted")
        flat, text = wanted.flatten(), np.repeat(np.arange(b.num_rows), np.diff(wanted.offsets.to_numpy()))
        at = first[text] + flat.field("start").to_numpy()
        windows, whole = flat.field("windows").to_numpy(), np.asarray(flat.field("whole").to_numpy(zero_copy_only=False), bool)
        n = np.where(whole, 0, windows + 1)
        stops = np.cumsum(n)
        places = np.repeat(at - (stops - n), n) + np.arange(int(n.sum()))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stops]), pa.int32()), pa.array(nodes[places]))
        digest = _digests(data, starts, ends, at, at + windows + WINDOW - 1)
        yield batch(schema, id=flat.field("id"), whole=whole, node=nodes[at], next=nodes[at + windows], nodes=lists, digest=digest)


def _spelled(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kept: np.ndarray | None = None) -> tuple[bytes, np.ndarray]:
    """All (kept) words, each with a space behind it, and the place of each word in them."""
    kept = np.ones(len(starts), bool) if kept is None else kept
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts[kept]] += 1
    inside[ends[kept]] -= 1
    places = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.where(kept, ends - starts + 1, 0))])
    out, letter = np.full(places[-1], 32, np.uint8), np.ones(places[-1], bool)
    letter[places[1:][kept] - 1] = False
    out[letter] = data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
    return out.tobytes(), places


def _digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> list[bytes]:
    """A digest of the words begin..stop of the batch for each span."""
    spelled, places = _spelled(data, starts, ends)
    return [hashlib.blake2b(spelled[a:b], digest_size=8).digest() for a, b in zip(places[begin].tolist(), (places[stop] - 1).tolist(), strict=True)]


def _stripped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.large_string()), ("n_paths", pa.int64()), ("n_refused", pa.int64())])
    for b in pieces(batches, "text", BYTES_PER_STEP):
        data, offsets = utf8(b.column("text"))
        starts, ends, first = word_bounds(data, offsets, SPACED)
        units_ = b.column("units")
        flat, text = units_.flatten(), np.repeat(np.arange(b.num_rows), np.diff(units_.offsets.to_numpy()))
        unit = first[text] + flat.field("start").to_numpy()
        digests = _digests(data, starts, ends, unit, unit + flat.field("windows").to_numpy() + WINDOW - 1)
        right = np.array([x == y for x, y in zip(digests, flat.field("digest").to_pylist(), strict=True)], bool)
        found = flat.field("found")
        of_unit, found = np.repeat(np.arange(len(unit)), np.diff(found.offsets.to_numpy())), found.flatten()
        begin = (unit[of_unit] + found.field("k").to_numpy())[right[of_unit]]
        stop = begin + found.field("n").to_numpy()[right[of_unit]] + WINDOW - 1
        change = np.bincount(begin, minlength=len(starts) + 1) - np.bincount(stop, minlength=len(starts) + 1)
        kept = np.cumsum(change[:-1]) == 0
        spelled, places = _spelled(data, starts, ends, kept)
        bounds = places[first]
        removed = np.concatenate([np.zeros(1, np.int64), np.cumsum(~kept)])
        texts = [spelled[a : max(a, e - 1)] for a, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        yield batch(
            schema, doc_id=b.column("doc_id"), n_words=np.diff(first), n_removed=np.diff(removed[first]), kept_text=pa.array(texts, pa.large_binary()).cast(pa.large_string()),
            n_paths=b.column("n_paths"), n_refused=np.bincount(text[~right], minlength=b.num_rows).astype(np.int64),
        )


_PLACE = ("doc", "copy")


def _prepared(docs: DataFrame) -> tuple[DataFrame, bool]:
    """doc_id, text, doc (null as the greatest) and copy, which tells rows of one doc_id apart (0 where ids are unique); whether they are."""
    small_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"))
    unique = own.groupBy("doc").count().where("count > 1").isEmpty()
    return own.withColumn("copy", F.lit(0).cast("long") if unique else F.xxhash64("text")), unique


def _asked(rows: DataFrame, requests: DataFrame, name: str, how: str = "inner") -> DataFrame:
    """Texts with what is asked of them, as one list a document."""
    lists = requests.groupBy(*_PLACE).agg(F.collect_list(F.struct(*[c for c in requests.columns if c not in _PLACE])).alias(name))
    return rows.join(lists, [*_PLACE], how)


def _first_seen(unique: bool, pos: str) -> list[Column]:
    """Smallest document, its place and the greatest document. Of several places in one document any will do."""
    if unique:
        return [F.min("doc").alias("lo"), F.lit(0).cast("long").alias("copy"), F.min_by(pos, "doc").alias(pos), F.max("last").alias("hi")]
    least = F.min(F.struct(*_PLACE, pos))
    return [F.min("doc").alias("lo"), least["copy"].alias("copy"), least[pos].alias(pos), F.max("last").alias("hi")]


def repeated(rows: DataFrame, unique: bool) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What the graph is made of, for rows of doc, copy and text (``unique``: no two rows share a doc).

    every: units of all documents whose seed repeats; distinct: each unit once, with its id, source coordinates, first and
    last node and digest, whole where all units of its seed are equal; parts: windows of the others; edges: the
    repeated ones among these, with source coordinates.
    """
    seeds = rows.select("doc", "text").mapInArrow(_seeds, "doc long, seed long").groupBy("seed").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"))
    seeds = stored(seeds.where("lo < hi").select("seed"), "seeds")
    every = rows.select(*_PLACE, "text").mapInArrow(_units, ", ".join(f"{f.name} long" for f in _UNIT))
    every = stored(every.join(seeds.hint("shuffle_hash"), "seed"), "units")
    own = every.withColumn("last", F.col("doc")).groupBy("seed", "unit").agg(F.min("windows").alias("windows"), *_first_seen(unique, "start"))
    by_unit = stored(own.withColumnsRenamed({"lo": "doc", "hi": "last"}), "by-unit")
    mixed = by_unit.groupBy("seed").agg((F.min("unit") == F.max("unit")).alias("whole"))
    # A seed has many units only where its words stand in many contexts; one row a seed on the other side.
    own = stored(by_unit.join(mixed.hint("shuffle_hash"), "seed").withColumn("id", F.monotonically_increasing_id()), "distinct")
    discard(by_unit, seeds)
    opened = _asked(rows.select(*_PLACE, "text"), own.select(*_PLACE, "start", "windows", "id", "whole"), "wanted").select("text", "wanted")
    opened = stored(opened.mapInArrow(_opened, "id long, whole boolean, node long, next long, nodes array<long>, digest binary"), "opened")
    steps = F.transform(F.sequence(F.lit(0), F.size("nodes") - 2), lambda k: F.struct(k.alias("k"), F.get("nodes", k).alias("node"), F.get("nodes", k + 1).alias("next")))
    parts = opened.where("NOT whole").select("id", F.inline(steps))
    placed = opened.where("NOT whole").select("id", "nodes").join(own.select("id", *_PLACE, "start", "last"), "id")
    placed = placed.select(*_PLACE, "start", "last", F.inline(steps)).select(*_PLACE, (F.col("start") + F.col("k")).alias("pos"), "last", "node", "next")
    edges = placed.groupBy("node", "next").agg(*_first_seen(unique, "pos")).where("lo < hi").drop("hi").withColumnRenamed("lo", "doc")
    edges = stored(edges, "edges")
    distinct = stored(own.join(opened.select("id", "node", "next", "digest"), "id").drop("last"), "digested")
    discard(own)
    return every, distinct, parts, edges


def segments_of(distinct: DataFrame, edges: DataFrame) -> DataFrame:
    """Whole units and single repeated edges: node, next, windows; doc, copy, pos of the source."""
    whole = distinct.where("whole").select("node", "next", "windows", *_PLACE, F.col("start").alias("pos"))
    return whole.unionByName(edges.select("node", "next", F.lit(1).cast("long").alias("windows"), *_PLACE, "pos"))


def compacted(segments: DataFrame) -> DataFrame:
    """Each repeated segment with its place on a compacted path.

    A segment (node, next, windows; doc, copy, pos: its source) is an edge, or a run of edges that stand nowhere else.
    Two belong together where they are the only ones into and out of a node. Segments that follow each other in
    their source are a piece; pieces are chained by pointer jumping to path_doc, path_copy, path_pos (the source of
    the path's first edge) and path_at (windows before this one). A path never goes back to an earlier source, so
    a ring is cut at its first place.
    """
    place, none = [*_PLACE, "pos"], F.lit(None).cast("long")
    end = F.col("pos") + F.col("windows")
    into = segments.select(F.col("next").alias("at"), F.lit(1).alias("n_in"), F.lit(0).alias("n_out"), *[F.col(c).alias(f"in_{c}") for c in place], end.alias("in_end"), *[none.alias(f"out_{c}") for c in place])
    out = segments.select(F.col("node").alias("at"), F.lit(0).alias("n_in"), F.lit(1).alias("n_out"), *[none.alias(f"in_{c}") for c in place], none.alias("in_end"), *[F.col(c).alias(f"out_{c}") for c in place])
    ends = [*[f"{s}_{c}" for s in ("in", "out") for c in place], "in_end"]
    nodes = into.unionByName(out).groupBy("at").agg(F.sum("n_in").alias("n_in"), F.sum("n_out").alias("n_out"), *[F.max(c).alias(c) for c in ends])
    # Source coordinates ascend along a link: no rings are left.
    links = nodes.where("n_in = 1 AND n_out = 1").where(F.struct(*[f"in_{c}" for c in place]) < F.struct(*[f"out_{c}" for c in place]))
    links = stored(links.withColumn("steady", F.expr("in_doc = out_doc AND in_copy = out_copy AND out_pos = in_end")).drop("n_in", "n_out"), "links")
    # A linked node has one segment out of it: the key is unique on both sides.
    marked = segments.join(links.where("steady").select(F.col("at").alias("node"), F.lit(True).alias("follows")), "node", "left")
    run = Window.partitionBy(*_PLACE).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = stored(marked.withColumn("piece", F.max(F.when(F.col("follows").isNull(), F.col("pos"))).over(run)).drop("follows"), "pieces")
    whole = marked.groupBy(*_PLACE, "piece").agg(F.max(end).alias("tail"))
    ahead = links.where("NOT steady").select(F.col("in_doc").alias("doc"), F.col("in_copy").alias("copy"), F.col("in_end").alias("tail"), *[F.col(f"out_{c}").alias(f"to_{c}") for c in place])
    before = whole.join(ahead, [*_PLACE, "tail"]).select(
        F.struct("to_doc", "to_copy", F.col("to_pos").alias("to_piece")).alias("to"), F.struct(*_PLACE, "piece").alias("up"), (F.col("tail") - F.col("piece")).alias("ahead"))
    before = stored(before.withColumn("moved", F.lit(True)), "chain")
    while not before.where("moved").isEmpty():
        over = before.select(F.col("to").alias("up"), F.col("up").alias("beyond"), F.col("ahead").alias("more"))
        before = before.join(over, "up", "left").select("to", F.coalesce("beyond", "up").alias("up"), (F.col("ahead") + F.coalesce("more", F.lit(0))).alias("ahead"), F.col("beyond").isNotNull().alias("moved"))
        before = stored(before, "jumped")
    chained = before.select(F.col("to.to_doc").alias("doc"), F.col("to.to_copy").alias("copy"), F.col("to.to_piece").alias("piece"), "up", "ahead")
    out = marked.join(chained, [*_PLACE, "piece"], "left")
    out = stored(out.select(
        "node", "next", "windows", *place, F.coalesce("up.doc", "doc").alias("path_doc"), F.coalesce("up.copy", "copy").alias("path_copy"),
        F.coalesce("up.piece", "piece").alias("path_pos"), (F.col("pos") - F.col("piece") + F.coalesce("ahead", F.lit(0))).alias("path_at"),
    ), "paths")
    discard(links, marked, before)
    return out


_ALONG = ("source_doc", "source_copy", "source_start", "path_doc", "path_copy", "path_pos", "path_at")


def runs(rows: DataFrame, unique: bool) -> DataFrame:
    """Units that hold windows of an earlier document: doc, copy, start, windows, digest and ``found``, for each such run of
    windows k (in the unit), n, and where it stands first and on which path (``source_`` and ``path_`` columns)."""
    every, distinct, parts, edges = repeated(rows, unique)
    paths = compacted(segments_of(distinct, edges))
    named = F.struct(*[F.col(c).alias(n) for c, n in zip((*_PLACE, "pos", *_ALONG[3:]), _ALONG, strict=True)])
    one = paths.select("node", "next", F.struct(F.lit(0).alias("k"), F.col("windows").alias("n"), named.alias("at")).alias("run"))
    per_part = parts.join(one, ["node", "next"]).select("id", F.struct("k", "run.n", "run.at").alias("run")).groupBy("id").agg(F.collect_list("run").alias("found"))
    per_whole = distinct.where("whole").select("id", "node", "next").join(one, ["node", "next"]).select("id", F.array("run").alias("found"))
    known = distinct.select("id", "seed", "unit", "digest").join(per_whole.unionByName(per_part), "id")
    known = stored(known.drop("id"), "unit-runs")
    discard(distinct, parts, edges, paths)
    met = every.join(known.hint("shuffle_hash"), ["seed", "unit"])
    met = met.withColumn("found", F.filter("found", lambda r: r["at"]["source_doc"] < F.col("doc")))
    return met.where(F.size("found") > 0).select(*_PLACE, "start", "windows", "digest", "found")


def spans(docs: DataFrame) -> DataFrame:
    """Repeated spans of all documents: doc, copy, start, words, the source's doc, copy and start, and the path (by the source of its first edge) with the span's place on it.

    A null doc_id shows as 2**63 - 1; ``copy`` is 0 where ids are unique. Runs that touch and follow one source along one
    path are one span.
    """
    rows, unique = _prepared(docs)
    found = runs(rows, unique).select(*_PLACE, F.col("start").alias("unit"), F.explode("found").alias("r"))
    found = found.select(*_PLACE, (F.col("unit") + F.col("r.k")).alias("start"), F.col("r.n").alias("n"), "r.at.*")
    along = Window.partitionBy(*_PLACE).orderBy("start")
    line = F.struct("source_doc", "source_copy", (F.col("source_start") - F.col("start")).alias("a"), "path_doc", "path_copy", "path_pos")
    cut = ~(F.coalesce(F.lag(line).over(along) == line, F.lit(False)) & (F.lag(F.col("start") + F.col("n")).over(along) == F.col("start")))
    found = found.withColumn("run", F.sum(cut.cast("long")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return found.groupBy(*_PLACE, "run").agg(F.min("start").alias("start"), (F.sum("n") + WINDOW - 1).alias("words"), *[F.min_by(c, "start").alias(c) for c in _ALONG]).drop("run")


def deduplicated(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_text (kept words joined by one space), n_paths (compacted paths that its
    removed words lie on) and n_refused (units whose words differ from their source's: their words stay)."""
    rows, unique = _prepared(docs)
    path = lambda r: F.struct(*[r["at"][c] for c in ("path_doc", "path_copy", "path_pos")])
    slim = F.transform("found", lambda r: F.struct(r["k"].cast("int").alias("k"), r["n"].cast("int").alias("n")))
    asked = runs(rows, unique).select(*_PLACE, "start", "windows", "digest", slim.alias("found"), F.array_distinct(F.transform("found", path)).alias("paths"))
    lists = asked.groupBy(*_PLACE).agg(F.collect_list(F.struct("start", "windows", "digest", "found")).alias("units"), F.size(F.array_distinct(F.flatten(F.collect_list("paths")))).cast("long").alias("n_paths"))
    none = F.array().cast("array<struct<start:bigint,windows:bigint,digest:binary,found:array<struct<k:int,n:int>>>>")
    texts = rows.join(lists, [*_PLACE], "left").select("doc_id", "text", F.coalesce("units", none).alias("units"), F.coalesce("n_paths", F.lit(0)).cast("long").alias("n_paths"))
    return texts.mapInArrow(_stripped, "doc_id long, n_words long, n_removed long, kept_text string, n_paths long, n_refused long")
