"""Merkle manifest of a dataset: trees of row digests, and proofs gathered by pointer jumping.

Every row is a leaf: the sha256 of its fields, each as ``bytes:value``, null as ``-``. The leaves of a group,
sorted, are joined two by two (a last one alone is hashed alone) until one node is left; the groups' nodes,
sorted by group, are joined the same way to the root.

Levels are built in blocks of ``2 ** BLOCK_LEVELS`` neighbours, one shuffle a block level, so a group with
most of the rows is spread over many tasks. Each node is then stored with its sibling as a segment of length
one and a pointer to its parent. Repeated self-joins double the distance: a node at a level divisible by
``2 ** k`` takes over the pointer and the segment of the node it points at. After about log2(height) joins
each leaf points at the root and holds all siblings on its way. A proof is folded with the row's digest.

Ancestors above a level are few and exact in number (a group's size halved at each level); only where their
segments stay below ``BROADCAST_BYTES`` they are broadcast.

Defined results. A null group comes first and is a group of its own; the empty text is another. A null in a
field counts as ``-``, the empty text as ``0:``. Rows with equal sort keys are ordered by their leaf, so
repeated rows are leaves of their own with equal digests; null keys come first. An empty table
has no nodes and no proofs; a single row is its own root, with an empty proof. Columns other than the fields
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.llm.common import stored
from sitegauge.operators.ranges import numbered

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
BLOCK_LEVELS = 9
BROADCAST_BYTES = 8 << 20
TOP = "^"


def leaf(fields: Sequence[Column]) -> Column:
    """Digest of a row's fields, in lower-case hex."""
    written = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.sha2(F.concat(*written), 256)


def _levels(digests: Column, levels: Column) -> Column:
    """The digests and all levels above them, ``levels`` in number."""

    def above(below: Column) -> Column:
        pairs = F.sequence(F.lit(0), F.floor((F.size(below) - 1) / 2).cast("int"))
        return F.transform(pairs, lambda k: F.sha2(F.concat(F.get(below, k * 2), F.coalesce(F.get(below, k * 2 + 1), F.lit(""))), 256))

    steps = F.when(levels > 0, F.sequence(F.lit(1), levels)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.array(digests), lambda done, _: F.concat(done, F.array(above(F.get(done, F.size(done) - 1)))))


def _height(size: Column) -> Column:
    """Levels above the leaves of a tree with ``size`` leaves."""
    return F.when(size > 1, F.length(F.bin(size - 1))).otherwise(0)


def forest(leaves: DataFrame, height: int) -> DataFrame:
    """All nodes of all trees.

    ``leaves`` has tree, at (0-based), n (leaves of the tree), digest and keep (carried by leaves only);
    ``height`` is the height of the highest tree. Per node: tree, level, at, digest, sibling (null: it has
    none), top (it is its tree's last) and keep.
    """
    base, level, parts = leaves.select("tree", "at", "n", "digest", "keep"), 0, []
    while True:
        rise = F.least(F.lit(BLOCK_LEVELS), _height(F.col("n")) - level)
        own = F.struct("at", "digest", "keep")
        blocks = base.groupBy("tree", F.shiftright("at", BLOCK_LEVELS).alias("block"), "n").agg(F.array_sort(F.collect_list(own)).alias("leaves"))
        blocks = blocks.withColumn("rows", _levels(F.transform("leaves", lambda x: x["digest"]), rise.cast("int")))
        rows = blocks.select("tree", "block", "n", "leaves", F.posexplode("rows").alias("up", "digests"))
        rows = rows.select("tree", "block", "n", "up", "digests", F.when(F.col("up") == 0, F.col("leaves")).alias("leaves"), F.posexplode("digests").alias("k", "digest"))
        at = F.call_function("shiftright", F.shiftleft("block", BLOCK_LEVELS), F.col("up")) + F.col("k")
        rows = rows.select(
            "tree", (F.col("up") + level).alias("level"), at.alias("at"), "n", "digest",
            F.get("digests", F.col("k").bitwiseXOR(F.lit(1))).alias("sibling"),
            (F.col("up") + level == _height(F.col("n"))).alias("top"), F.get("leaves", F.col("k"))["keep"].alias("keep"),
        )
        rows = stored(rows, f"levels-{level}")
        last = level + BLOCK_LEVELS >= height
        # The uppermost nodes of a block are the leaves of the next one, where their siblings are.
        parts.append(rows if last else rows.where(F.col("top") | (F.col("level") < level + BLOCK_LEVELS)))
        if last:
            break
        base = rows.where(~F.col("top") & (F.col("level") == level + BLOCK_LEVELS)).drop("level", "sibling", "top")
        level += BLOCK_LEVELS
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.drop("n")


def _jump(nodes: DataFrame, ancestors: DataFrame, few: bool) -> DataFrame:
    """Nodes that point beyond the ancestors they pointed at, with both segments one after the other."""
    beyond = ancestors.select(
        F.col("tree").alias("up_tree"), F.col("level").alias("up_level"), F.col("at").alias("up_at"),
        F.col("up_tree").alias("next_tree"), F.col("up_level").alias("next_level"), F.col("up_at").alias("next_at"), F.col("segment").alias("more"),
    )
    joined = nodes.join(F.broadcast(beyond) if few else beyond, ["up_tree", "up_level", "up_at"], "left")
    found = F.col("more").isNotNull()
    step = lambda a, b: F.when(found, F.col(a)).otherwise(F.col(b)).alias(b)
    return joined.select(
        "tree", "level", "at", "keep", step("next_tree", "up_tree"), step("next_level", "up_level"), step("next_at", "up_at"),
        F.concat("segment", F.coalesce("more", F.array().cast("array<string>"))).alias("segment"),
    )


def proofs(docs: DataFrame, group: str, order: Sequence[str], fields: Sequence[str], keep: Column) -> DataFrame:
    """Per row: group, at (position of its leaf), leaf, subroot, root, proof, bits and the kept value.

    The proof is an array with an item a level from leaf to root: the sibling's digest, the empty text where a
    node was hashed alone, null where a low tree waits for the highest one. ``bits`` tells the side: where the
    bit of a level is set, the sibling stands left. ``keep`` is an expression over the row's columns.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    own = docs.select(tree.alias("tree"), F.struct(*order).alias("by"), leaf([F.col(f) for f in fields]).alias("digest"), keep.alias("keep"))
    leaves = numbered(stored(own, "leaves"), ["tree"], ["by", "digest"], "at", "n")
    leaves = stored(leaves.select("tree", "at", "n", "digest", F.struct(F.col("digest").alias("leaf"), "keep").alias("keep")), "numbered")
    trees = leaves.groupBy("tree").agg(F.first("n").alias("n"))
    trees = stored(numbered(trees, [], ["tree"], "rank", "trees"), "trees")
    heights = trees.agg(F.max(_height(F.col("n"))).alias("groups"), F.max(_height(F.col("trees"))).alias("top")).first()
    low, high = max(heights["groups"] or 0, 1), heights["top"] or 0
    nodes = forest(leaves, heights["groups"] or 0)
    tops = stored(nodes.where("top").select("tree", "digest").join(trees, "tree"), "subroots")
    upper = forest(tops.select(F.lit(TOP).alias("tree"), F.col("rank").alias("at"), F.col("trees").alias("n"), "digest", F.col("tree").alias("keep")), high)
    root = upper.where("top").select("digest").first()
    linked = stored(_linked(nodes, upper, low), "linked")

    # Ancestors at a level: every group's leaves halved as often.
    few = [F.sum(F.ceil(F.col("n") / F.lit(2.0**k))).alias(f"level_{k}") for k in range(low + high + 1)]
    few, distance = trees.agg(*few).first(), 1
    at_leaf, rest = linked.where("level = 0"), linked.where("level > 0")
    while distance < low + high:
        small = (few[f"level_{distance}"] or 0) * 80 * distance <= BROADCAST_BYTES
        at_leaf = _jump(at_leaf, rest.where(F.col("level") == distance), small)
        even, odd = rest.where(F.col("level") % (2 * distance) == 0), rest.where(F.col("level") % (2 * distance) == distance)
        rest = stored(_jump(even, odd, False), f"distance-{2 * distance}")
        distance *= 2
    heads = tops.select("tree", F.col("digest").alias("subroot"), "rank")
    out = at_leaf.join(F.broadcast(heads) if (few["level_0"] or 0) * 100 <= BROADCAST_BYTES or tops.count() * 200 <= BROADCAST_BYTES else heads, "tree")
    return out.select(
        F.when(F.col("tree") != "", F.expr("substring(tree, 2)")).alias(group), "at", "keep.leaf", "subroot",
        F.lit(root["digest"] if root else None).cast("string").alias("root"), F.col("segment").alias("proof"),
        (F.col("at") + F.shiftleft("rank", low)).alias("bits"), "keep.keep",
    )


def _linked(nodes: DataFrame, upper: DataFrame, low: int) -> DataFrame:
    """Every node but the root with a pointer to its parent and its own segment; the groups' roots are at level ``low``."""
    alone = F.array(F.coalesce("sibling", F.lit("")))
    inner = nodes.where("NOT top").select(
        "tree", "level", "at", "keep", F.col("tree").alias("up_tree"), (F.col("level") + 1).alias("up_level"), F.shiftright("at", 1).alias("up_at"), alone.alias("segment"))
    # The last node of a low tree waits, without a sibling, up to the level at which the highest tree ends.
    waits = nodes.where("top").withColumn("level", F.explode(F.sequence(F.col("level"), F.lit(low)))).where(F.col("level") < low)
    zero = F.lit(0).cast("long")
    waits = waits.select(
        "tree", "level", zero.alias("at"), F.when(F.col("level") == 0, F.col("keep")).alias("keep"), F.col("tree").alias("up_tree"),
        (F.col("level") + 1).alias("up_level"), zero.alias("up_at"), F.array(F.lit(None).cast("string")).alias("segment"))
    first = F.col("level") == 0
    above = upper.where("NOT top").select(
        F.when(first, F.col("keep")).otherwise(F.col("tree")).alias("tree"), (F.col("level") + low).alias("level"), F.when(first, zero).otherwise(F.col("at")).alias("at"),
        F.lit(None).cast(nodes.schema["keep"].dataType).alias("keep"), F.lit(TOP).alias("up_tree"), (F.col("level") + low + 1).alias("up_level"),
        F.shiftright("at", 1).alias("up_at"), alone.alias("segment"))
    return inner.unionByName(waits).unionByName(above)


def folded(digest: Column, proof: Column, bits: Column) -> Column:
    """The root that a leaf's digest and its proof lead to."""
    steps = F.transform(proof, lambda s, k: F.struct(s.alias("with"), (F.call_function("shiftright", bits, k) % 2 == 1).alias("left")))

    def join(node: Column, step: Column) -> Column:
        pair = F.when(step["left"], F.concat(step["with"], node)).otherwise(F.concat(node, step["with"]))
        return F.when(step["with"].isNull(), node).otherwise(F.sha2(pair, 256))

    return F.aggregate(steps, digest, join)
