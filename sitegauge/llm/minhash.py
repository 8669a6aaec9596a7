"""Near-duplicate classes by b-bit MinHash.

A document's set holds its distinct runs of five words (64-bit hashes; a shorter text is one run). For each
set, ``BANDS * ROWS`` minima are taken. Bands of full minima propose candidates; of every minimum only the
``BITS`` lowest bits are kept, packed into long columns, and the number of equal fields, corrected for
chance, estimates the similarity. Candidates far below the limit by that estimate go; the rest are
confirmed on the full sets. Links are joined to classes by contracting the graph of links.

Sizes. Equal sets are one node from the start, so exact copies cost one row each in a partial aggregation.
Inside a band bucket no all-pairs join is made: in a round each bucket compares its members with one leader;
afterwards, buckets whose members are all of one class are done. What is left after ``ROUNDS`` (members of
one bucket in different classes) is compared in blocks of bounded size, so no partner is dropped and only
pairs that can be links become rows.

A pair at exactly 0.75 is proposed with probability 1 - (1 - 0.75**5)**40 > 0.99998 per pair, and the
estimate rejects it with a probability below 1e-6 (``SLACK`` standard errors).

Defined results. Null, empty or blank text: an empty set, linked with nothing, its own class. A null doc_id
is never a class id unless the whole class has none. Rows repeated with one doc_id are documents of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitegauge.llm.common import batch, pieces, small_batches, stored, utf8
from sitegauge.llm.words import SPACED, mixed, window_hashes, word_bounds, word_hashes

WORDS = 5
BANDS, ROWS, BITS = 40, 5, 2
FIELDS = 64 // BITS  # minima kept in one long
LONGS = -(-BANDS * ROWS // FIELDS)
ROUNDS = 2
PART, PART_BYTES = 1024, 1 << 26
SLACK = 5.5
BYTES_PER_STEP = 1 << 19

_random = np.random.default_rng(77)
_FACTORS = (_random.integers(1, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2)) + np.uint32(1)
_ADD = _random.integers(1, 2**32, BANDS * ROWS, dtype=np.uint32)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of five words of each text (with repeats) and the first run of each text."""
    starts, ends, first = word_bounds(data, offsets, SPACED)
    hashes = word_hashes(data, starts, ends)
    n_words = np.diff(first)
    runs = window_hashes(hashes, WORDS)
    at = np.flatnonzero(np.arange(len(runs)) + WORDS <= np.repeat(first[1:], n_words)[: len(runs)])
    runs, owner = runs[at], np.repeat(np.arange(len(n_words)), n_words)[at] if len(at) else np.zeros(0, np.int64)
    short = np.flatnonzero((n_words > 0) & (n_words < WORDS))
    whole = np.array([mixed(window_hashes(hashes[first[k] : first[k + 1]], int(n_words[k])) + np.uint64(n_words[k]))[0] for k in short], np.uint64)
    owner, runs = np.concatenate([owner, short]), np.concatenate([runs, whole])
    order = np.argsort(owner, kind="stable")
    return runs[order], np.searchsorted(owner[order], np.arange(len(n_words) + 1))


def _sets(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The sorted set of each text and a 64-bit key of it (0: empty)."""
    runs, first = shingles(data, offsets)
    sets = [np.unique(runs[a:b]) for a, b in zip(first, first[1:], strict=False)]
    weight = np.uint64(0x2545F4914F6CDD1D)
    keys = np.array([mixed(np.array([np.sum(mixed(s * weight), dtype=np.uint64) + np.uint64(len(s))]))[0] | np.uint64(1) if len(s) else 0 for s in sets], np.uint64)
    return sets, keys


def _minima(sets: list[np.ndarray]) -> np.ndarray:
    """For each set that isn't empty a row of minima (32 bits each)."""
    values = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32) if sets else np.zeros(0, np.uint32)
    at = np.cumsum([0, *map(len, sets[:-1])]) if sets else np.zeros(0, np.int64)
    out = np.empty((len(sets), BANDS * ROWS), np.uint32)
    for k in range(BANDS * ROWS if sets else 0):
        v = values * _FACTORS[k]
        v ^= v >> np.uint32(15)
        v += _ADD[k]
        v *= np.uint32(0x85EBCA6B)
        out[:, k] = np.minimum.reduceat(v, at)
    return out


_NODE = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), ("n_shingles", pa.int64()), ("bands", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64()))])
_NODE_SQL = "doc_id bigint, node bigint, n_shingles bigint, bands array<bigint>, bits array<bigint>"


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, "text", BYTES_PER_STEP):
        sets, keys = _sets(*utf8(b.column("text")))
        full = [k for k, s in enumerate(sets) if len(s)]
        minima = _minima([sets[k] for k in full])
        weights = mixed(np.arange(1, ROWS + 1, dtype=np.uint64))
        bands = mixed((minima.astype(np.uint64).reshape(len(full), BANDS, ROWS) * weights).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
        low = np.zeros((len(full), LONGS * FIELDS), np.uint64)
        low[:, : BANDS * ROWS] = mixed(minima.astype(np.uint64)) & np.uint64(2**BITS - 1)
        bits = (low.reshape(len(full), LONGS, FIELDS) << (np.arange(FIELDS, dtype=np.uint64) * np.uint64(BITS))).sum(axis=2, dtype=np.uint64)
        row = dict(zip(full, range(len(full)), strict=True))
        yield batch(
            _NODE, doc_id=b.column("doc_id").cast(pa.int64()), node=keys.view(np.int64), n_shingles=np.array([len(s) for s in sets], np.int64),
            bands=[bands[row[k]].view(np.int64) if k in row else [] for k in range(len(sets))], bits=[bits[row[k]].view(np.int64) if k in row else [] for k in range(len(sets))],
        )


def described(docs: DataFrame) -> DataFrame:
    """doc_id, node (key of the document's set, 0: empty), size of the set, band keys and packed low bits."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_describe, _NODE_SQL)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("node", pa.int64()), ("members", pa.binary())])
    for b in pieces(batches, "text", BYTES_PER_STEP):
        sets, keys = _sets(*utf8(b.column("text")))
        yield batch(schema, node=keys.view(np.int64), members=[s.tobytes() for s in sets])


def similarity(a: str, b: str) -> Column:
    """Similarity of two packed signatures: equal fields, corrected for fields that are equal by chance."""
    differ = F.lit(0)
    low = F.lit(0x5555555555555555)
    for k in range(LONGS):
        x = F.col(a)[k].bitwiseXOR(F.col(b)[k])
        differ = differ + F.bit_count(x.bitwiseOR(F.shiftright(x, 1)).bitwiseAND(low))
    chance = 1 / 2**BITS
    return (1 - differ / (BANDS * ROWS) - chance) / (1 - chance)


def _least_estimate(limit: float) -> float:
    equal = limit + (1 - limit) / 2**BITS
    return limit - SLACK * (equal * (1 - equal) / (BANDS * ROWS)) ** 0.5 / (1 - 1 / 2**BITS)


def _confirm(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for t in batches:
        keep = []
        for k, (x, y) in enumerate(zip(t.column("set_a"), t.column("set_b"), strict=True)):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = np.sort(np.concatenate([x, y]), kind="stable")
            shared = int(np.count_nonzero(both[1:] == both[:-1]))
            if 100 * shared >= percent * (len(x) + len(y) - shared):
                keep.append(k)
        t = t.take(pa.array(keep, pa.int64()))
        yield batch(schema, a=t.column("a"), b=t.column("b"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose full sets reach the limit."""
    both = pairs.join(sets.withColumnsRenamed({"node": "b", "members": "set_b"}), "b").join(sets.withColumnsRenamed({"node": "a", "members": "set_a"}), "a")
    return both.select("a", "b", "set_a", "set_b").mapInArrow(lambda batches: _confirm(batches, percent), "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame | None:
    """Class of each linked node (``node``, ``root``: the smallest node of the class); None without links.

    In each pass every node points at its smallest neighbour if that is smaller; pointers are followed to
    their ends by pointer jumping, and the links between the ends are what the next pass works on.
    """
    found = None
    while True:
        links = stored(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
        if links.isEmpty():
            return found
        ends = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(links.select("b", "a"))
        up = ends.groupBy("node").agg(F.min("other").alias("root")).select("node", F.least("root", "node").alias("root"))
        moved = True
        while moved:
            over = up.select(F.col("node").alias("root"), F.col("root").alias("beyond"))
            jumped = up.join(over, "root").select("node", F.col("beyond").alias("root"), (F.col("beyond") != F.col("root")).alias("moved"))
            jumped = stored(jumped, "jumped")
            moved, up = not jumped.where("moved").isEmpty(), jumped.drop("moved")
        if found is None:
            found = up
        else:
            beyond = up.select(F.col("node").alias("root"), F.col("root").alias("beyond"))
            found = stored(found.join(beyond, "root", "left").select("node", F.coalesce("beyond", "root").alias("root")), "classes")
        a, b = (up.withColumnsRenamed({"node": x, "root": f"root_{x}"}) for x in "ab")
        links = links.join(a, "a").join(b, "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))


def _rooted(post: DataFrame, found: DataFrame | None) -> DataFrame:
    """Postings with the class that their node has so far."""
    if found is None:
        return post.withColumn("root", F.col("node"))
    return post.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _open(post: DataFrame, found: DataFrame | None) -> DataFrame:
    """Postings of the buckets that hold more than one class."""
    rooted = _rooted(post, found)
    split = rooted.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("band")
    return stored(rooted.join(split, "band"), "open")


def _block_pairs(t: pa.Table, percent: int) -> pa.Table:
    """Pairs of a block (two parts of one bucket, or one part with itself) that can reach the limit.

    Estimated first on the packed bits; then counted on the low halves of the set's hashes, which can only
    count too much. A pair is taken up in the first band that it shares.
    """
    column = lambda n: t.column(n).combine_chunks()
    n = t.num_rows
    node, root, size, part = (column(c).to_numpy() for c in ("node", "root", "size", "part"))
    bits = column("bits").flatten().to_numpy().view(np.uint64).reshape(n, LONGS)
    bands = column("bands").flatten().to_numpy().reshape(n, BANDS)
    sets = [np.frombuffer(x.as_buffer(), np.uint32) for x in column("low")]
    lo, hi, band = part.min(), part.max(), t.column("band")[0].as_py()
    rows, others = np.flatnonzero(part == lo), np.flatnonzero(part == hi)
    least = _least_estimate(percent / 100)
    field, chance = np.uint64(0x5555555555555555), 1 / 2**BITS
    out_a, out_b = [], []
    if t.column("i")[0].as_py() != t.column("j")[0].as_py() and lo == hi:
        rows = rows[:0]
    for a in rows.tolist():
        other = others[others > a] if lo == hi else others
        other = other[root[other] != root[a]]
        x = bits[other] ^ bits[a]
        differ = np.bitwise_count((x | (x >> np.uint64(1))) & field).sum(axis=1)
        other = other[(1 - differ / (BANDS * ROWS) - chance) / (1 - chance) >= least]
        if not len(other):
            continue
        other = other[bands[a][np.argmax(bands[other] == bands[a], axis=1)] == band]
        if not len(other) or not len(sets[a]):
            continue
        many = np.concatenate([sets[b] for b in other])
        same = sets[a][np.minimum(np.searchsorted(sets[a], many), len(sets[a]) - 1)] == many
        shared = np.add.reduceat(same.astype(np.int64), np.cumsum([0, *(len(sets[b]) for b in other[:-1])]))
        other = other[100 * shared >= percent * (size[a] + size[other] - shared)]
        out_a.extend(np.minimum(node[a], node[other]).tolist())
        out_b.extend(np.maximum(node[a], node[other]).tolist())
    return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})


def _low(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("node", pa.int64()), ("size", pa.int64()), ("low", pa.binary())])
    for t in batches:
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("members")]
        yield batch(schema, node=t.column("node"), size=[len(s) for s in sets], low=[np.sort(s.astype(np.uint32)).tobytes() for s in sets])


def _between_classes(rooted: DataFrame, signatures: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs of all members of a bucket that are in different classes.

    A bucket is dealt to parts of about ``PART`` members (fewer, if their sets are large); each two parts meet
    in a block of their own, so a large bucket becomes many tasks of bounded size.
    """
    wide = sets.join(rooted.select("node").distinct(), "node", "left_semi").mapInArrow(_low, "node bigint, size bigint, low binary")
    wide = stored(wide.join(signatures, "node"), "wide")
    sized = rooted.join(wide.select("node", "size"), "node")
    parts = sized.groupBy("band").agg(F.greatest(F.ceil(F.count("*") / PART), F.ceil(F.sum("size") * 4 / PART_BYTES)).cast("int").alias("parts"))
    dealt = rooted.join(parts, "band").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    blocks = dealt.select("band", "node", "root", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("with"))
    blocks = blocks.select("band", "node", "root", "part", F.least("part", "with").alias("i"), F.greatest("part", "with").alias("j"))
    return blocks.join(wide, "node").groupBy("band", "i", "j").applyInArrow(lambda t: _block_pairs(t, percent), "a bigint, b bigint").distinct()


def _linked(post: DataFrame, signatures: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """Classes of the nodes of band buckets: rounds of leaders, then all that is left between classes."""
    least, links, found = _least_estimate(percent / 100), None, None
    bits = signatures.select("node", "bits")
    for flip in np.random.default_rng(5).integers(-(2**62), 2**62, ROUNDS).tolist():
        rooted = _rooted(post, found) if found is None else _open(post, found)
        post = rooted.select("node", "band")
        lead = rooted.groupBy("band").agg(F.min(F.col("node").bitwiseXOR(F.lit(flip))).bitwiseXOR(F.lit(flip)).alias("a"))
        lead = _rooted(lead.withColumnRenamed("a", "node"), found).withColumnsRenamed({"node": "a", "root": "root_a"})
        pairs = rooted.withColumnRenamed("node", "b").join(lead, "band").where("root <> root_a")
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        signed = pairs.join(bits.withColumnsRenamed({"node": "a", "bits": "bits_a"}), "a").join(bits.withColumnsRenamed({"node": "b", "bits": "bits_b"}), "b")
        new = confirmed(signed.where(similarity("bits_a", "bits_b") >= least).select("a", "b"), sets, percent)
        links = stored(new if links is None else links.unionAll(new), "confirmed")
        found = components(links)
    rooted = _open(post, found)
    if rooted.isEmpty():
        return found
    new = confirmed(_between_classes(rooted, signatures, sets, percent), sets, percent)
    return components(links.unionAll(new))


def labelled(docs: DataFrame, percent: int = 75) -> DataFrame:
    """Per document: doc_id, node of its set (0: empty), n_shingles, root (node of its class), component_id."""
    docs = docs.select("doc_id", "text")
    own = stored(described(docs), "nodes")
    nodes = stored(own.where("node <> 0").groupBy("node").agg(F.min("doc_id").alias("least")), "least")
    # One row per node: that of the smallest id, or one of several equal rows.
    one = own.join(nodes.withColumnRenamed("node", "n"), (F.col("node") == F.col("n")) & F.col("doc_id").eqNullSafe(F.col("least")))
    signatures = stored(one.select("node", "least", "bits", "bands").dropDuplicates(["node"]), "signatures")
    post = signatures.select("node", F.explode("bands").alias("band"))
    crowded = post.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    post = stored(post.join(crowded, "band"), "postings")
    wanted = stored(post.select("node").distinct().join(signatures.select("node", "least"), "node"), "wanted")
    texts = docs.join(wanted.select("least").distinct(), F.col("doc_id").eqNullSafe(F.col("least")), "left_semi")
    sets = texts.mapInArrow(_members, "node bigint, members binary").join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])
    found = _linked(post, signatures.select("node", "bits", "bands"), stored(sets, "sets"), percent)
    rooted = nodes.withColumn("root", F.col("node")) if found is None else nodes.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = stored(rooted, "rooted")
    named = rooted.select("node", "root").join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root")
    slim = own.select("doc_id", "node", "n_shingles")
    alone = slim.where("node = 0").select("doc_id", "node", "n_shingles", F.col("node").alias("root"), F.col("doc_id").alias("component_id"))
    return slim.where("node <> 0").join(named, "node").select("doc_id", "node", "n_shingles", "root", "component_id").unionByName(alone)


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id that links reach), kept (it is that one)."""
    return labelled(docs, percent).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One document of each class, the one with the smallest id; all columns. Documents without words stay.

    Of rows that are equal in id and set one stays, so a class never keeps two.
    """
    flags = stored(labelled(docs, percent), "flags")
    kept = flags.where((F.col("node") != 0) & F.col("doc_id").eqNullSafe(F.col("component_id")))
    keys = kept.groupBy("root", "node", "doc_id").agg(F.count("*").alias("n"))
    best = keys.groupBy("root").agg(F.min("node").alias("node"))
    keys = stored(keys.join(best, ["root", "node"]).select(F.col("node").alias("__key_node"), F.col("doc_id").alias("__key_id"), "n"), "keys")
    schema = T.StructType([*docs.schema.fields, T.StructField("__node", T.LongType())])

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", BYTES_PER_STEP):
            _, node = _sets(*utf8(b.column("text")))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(node.view(np.int64))], names=schema.names)

    tagged = docs.mapInArrow(tag, schema)
    same = (F.col("__node") == F.col("__key_node")) & F.col("doc_id").eqNullSafe(F.col("__key_id"))
    once = tagged.join(keys.where("n = 1").drop("n"), same, "left_semi")
    out = once.unionByName(tagged.where("__node = 0"))
    if not keys.where("n > 1").isEmpty():
        out = out.unionByName(tagged.join(keys.where("n > 1").drop("n"), same, "left_semi").dropDuplicates(["doc_id", "__node"]))
    return out.select(*docs.columns)
