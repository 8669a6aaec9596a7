"""Context-tree weighting over bytes.

A text (A-Z lower-cased) is its UTF-8 bytes and an end byte 0, after ``DEPTH`` bytes 0 of context. Each byte is
eight binary decisions, and each decision has a context tree of its own over the preceding bytes. A node's
Krichevsky-Trofimov estimate is mixed half and half with the product of its children's mixtures, down to
``DEPTH`` bytes; what the mixture has learned from the training documents gives the weight of each depth
when a byte is predicted. The score is the log10 probability of all bytes; divided by their number it is the
code length.

How it is spread out. Documents are packed into chunks of about ``CHUNK_BYTES`` of text. Each chunk lists its
distinct grams (a byte with its context) and words with their training counts; counts are summed over the
corpus by Spark. Nodes of two context bytes or more are worked off by the last two context bytes: a task reads
its grams in their order and holds the trees of about ``TREE_ROWS`` grams at once, whole suffixes each time; what is above (255 decisions of at most 257 contexts) is collected, being
bounded by its definition. Each chunk then gets the values of its own grams and words by a join and scores
its documents. Nothing is pruned or hashed away, and no table of the corpus is broadcast.

Defined results. Null text is empty: the end byte, one token. Words are told apart by 64-bit hashes. Rows with
equal ids are documents of their own. Without training documents every bit has probability 1/2.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegauge.llm.common import pieces, small_batches, stored, utf8
from sitegauge.llm.words import SPACED, word_bounds, word_hashes

DEPTH = 4
CHUNK_BYTES, BYTES_PER_STEP = 32 << 20, 1 << 20
TREE_ROWS = 1 << 18
IS_WORD = 1 << 62  # set in the codes of words, never in those of grams
END_WORD = IS_WORD  # the end token


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each text, end byte included: context and byte as one number; and the first of each text."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    lower = np.where((data >= 65) & (data <= 90), data + 32, data)
    line = np.zeros(len(data) + n * (DEPTH + 1), np.int64)
    line[np.arange(len(data)) + np.repeat(np.arange(n) * (DEPTH + 1) + DEPTH, sizes)] = lower
    first = offsets + np.arange(n + 1)
    at = np.arange(len(data) + n) + np.repeat(np.arange(n) * DEPTH, sizes + 1)
    code = np.zeros(len(at), np.int64)
    for k in range(DEPTH + 1):
        code = (code << 8) | line[at + k]
    return code, first


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word and the first word of each text; the end token isn't among them."""
    starts, ends, first = word_bounds(data, offsets, SPACED)
    return (word_hashes(data, starts, ends) >> np.uint64(2) | np.uint64(IS_WORD)).view(np.int64), first


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a task as chunks: one row each, with lists of ids, texts and whether they are learned."""
    held: list[pa.RecordBatch] = []
    size, number = 0, 0

    def chunk() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        one = lambda c, kind: pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), rows.column(c).combine_chunks().cast(kind))
        name = (TaskContext.get().partitionId() << 32) | number
        return pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), one("doc_id", pa.int64()), one("text", pa.string()), one("train", pa.bool_())], names=["chunk", "doc_id", "text", "train"])

    for b in pieces(batches, "text", BYTES_PER_STEP):
        held.append(b)
        size += b.nbytes
        if size >= CHUNK_BYTES:
            yield chunk()
            held, size, number = [], 0, number + 1
    if held:
        yield chunk()


def _steps(row: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, bytes, offsets and training flags of a chunk's documents, in steps of bounded size."""
    rows = pa.RecordBatch.from_arrays([row.column(c).flatten() for c in ("doc_id", "text", "train")], names=["doc_id", "text", "train"])
    for b in pieces(iter([rows]), "text", BYTES_PER_STEP):
        yield b.column("doc_id"), *utf8(b.column("text")), b.column("train").to_numpy(zero_copy_only=False)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.concatenate([c for c, _ in parts])
    code, inverse = np.unique(codes, return_inverse=True)
    return code, np.bincount(inverse, np.concatenate([n for _, n in parts]), minlength=len(code)).astype(np.int64)


def _counted(codes: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    code, inverse = np.unique(codes, return_inverse=True)
    return code, np.bincount(inverse, train, minlength=len(code)).astype(np.int64)


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct grams and words of each chunk, with their numbers in its training documents."""
    for b in batches:
        for k in range(b.num_rows):
            grams_, words_ = [], []
            for _, data, offsets, train in _steps(b.slice(k, 1)):
                code, first = grams(data, offsets)
                grams_.append(_counted(code, np.repeat(train, np.diff(first))))
                words, first = _words(data, offsets)
                words_.append(_counted(words, np.repeat(train, np.diff(first))))
                words_.append((np.array([END_WORD]), np.array([np.count_nonzero(train)])))
            for code, n in map(_merged, (grams_, words_)):
                name = np.full(len(code), b.column("chunk")[k].as_py())
                for x in range(0, len(code), 1 << 16):
                    yield pa.RecordBatch.from_pydict({"chunk": name[x : x + (1 << 16)], "code": code[x : x + (1 << 16)], "n": n[x : x + (1 << 16)]})


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x >= 1/2, by Stirling's series eight steps above."""
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) + 1 / (1188 * y**9) - sum(np.log(x + k) for k in range(8))


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability that a Krichevsky-Trofimov estimator gives to this many zeros and ones."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - np.log(np.pi) - _log_gamma(zeros + ones + 1.0)


def _with_children(log_kt: np.ndarray, children: np.ndarray) -> np.ndarray:
    return np.logaddexp(log_kt, children) - np.log(2)


class _Level:
    """Distinct (context of ``depth`` bytes, byte) of a task, and their decision nodes."""

    def __init__(self, key: np.ndarray, n: np.ndarray):
        self.key = key  # context (nearest byte first) and byte, ascending
        self.n = n
        self.byte = key & 255

    def nodes(self, bit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Node of each row for a decision, and of each node the first row, zeros and ones."""
        prefix = self.key >> (8 - bit)
        new = np.concatenate([[True], prefix[1:] != prefix[:-1]])
        first = np.flatnonzero(new)
        one = (self.byte >> (7 - bit)) & 1
        total, ones = np.add.reduceat(self.n, first), np.add.reduceat(self.n * one, first)
        return np.cumsum(new) - 1, first, (total - ones).astype(float), ones.astype(float)

    def above(self) -> tuple[_Level, np.ndarray]:
        """The level with one context byte less, and the row there of each row here."""
        context = self.key >> 8
        key = ((context >> 8) << 8) | self.byte
        short, inverse = np.unique(key, return_inverse=True)
        return _Level(short, np.bincount(inverse, self.n, minlength=len(short)).astype(np.int64)), inverse


def _whole_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Grams that come by suffix and their counts, in blocks of ``TREE_ROWS`` or somewhat more: a suffix is never parted."""
    held, size = [], 0

    def joined() -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.concatenate([h[k] for h in held]) for k in range(2))

    for b in batches:
        code, n = b.column("code").to_numpy(), b.column("n").to_numpy()
        if not len(code):
            continue
        if size >= TREE_ROWS:
            ended = np.flatnonzero(((code ^ held[-1][0][-1]) >> 8) & 0xFFFF)
            if len(ended):
                cut = ended[0]
                held.append((code[:cut], n[:cut]))
                yield joined()
                held, size, code, n = [], 0, code[cut:], n[cut:]
        held.append((code, n))
        size += len(code)
    if held:
        yield joined()


def _suffix_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of two context bytes or more, for all suffixes of the task; grams come by suffix.

    Gives each gram the probabilities of its eight decisions from there down, and each node of two context
    bytes its counts and log mixture, summed by the nearest context byte.
    """
    for code, n in _whole_suffixes(batches):
        yield from _trees(code, n)


def _trees(code: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``_suffix_trees`` of a block of whole suffixes."""
    names = ["code", "below", "nearest", "node", "zeros", "ones", "log_mix"]
    types = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64()]
    key = code & 255
    for k in range(1, DEPTH + 1):  # nearest context byte first
        key |= ((code >> (8 * k)) & 255) << (8 * (DEPTH + 1 - k))
    order = np.argsort(key, kind="stable")
    code = code[order]
    levels, ups = [_Level(key[order], n[order])], []
    while len(ups) < DEPTH - 2:
        level, up = levels[-1].above()
        levels.append(level)
        ups.append(up)
    below = np.empty((len(code), 8))
    summary = []
    for bit in range(8):
        found, log_mix = [], None
        for depth, level in enumerate(levels):  # deepest first
            node, first, zeros, ones = level.nodes(bit)
            log_kt = _log_kt(zeros, ones)
            if depth:
                parent = node[ups[depth - 1][found[-1][1]]]
                log_mix = _with_children(log_kt, np.bincount(parent, log_mix, minlength=len(first)))
                stop = np.exp(log_kt - np.log(2) - log_mix)
            else:
                log_mix, stop = log_kt, np.ones(len(first))
            found.append((node, first, zeros, ones, stop))
        top, (_, first, zeros, ones, _) = levels[-1], found[-1]
        nearest, prefix = top.key[first] >> 16, (top.byte[first] | 256) >> (8 - bit)
        slot, inverse = np.unique(nearest * 256 + prefix, return_inverse=True)
        summary.append((slot, *(np.bincount(inverse, v, minlength=len(slot)) for v in (zeros, ones, log_mix))))
        rows = [np.arange(len(code))]
        for up in ups:
            rows.append(up[rows[-1]])
        one = (levels[0].byte >> (7 - bit)) & 1
        p = None
        for (node, _, zeros, ones, stop), row in zip(found, rows, strict=True):
            at = node[row]
            kt = (np.where(one, ones[at], zeros[at]) + 0.5) / (zeros[at] + ones[at] + 1)
            p = kt if p is None else stop[at] * kt + (1 - stop[at]) * p
        below[:, bit] = p
    for x in range(0, len(code), 1 << 14):
        part = below[x : x + (1 << 14)]
        flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(64), len(part), [None, pa.py_buffer(np.ascontiguousarray(part).tobytes())]).cast(pa.binary())
        none = [pa.nulls(len(part), t) for t in types[2:]]
        yield pa.RecordBatch.from_arrays([pa.array(code[x : x + (1 << 14)]), flat, *none], names=names)
    slot, zeros, ones, log_mix = (np.concatenate([s[k] for s in summary]) for k in range(4))
    yield pa.RecordBatch.from_arrays([pa.nulls(len(slot), types[0]), pa.nulls(len(slot), types[1]), pa.array(slot >> 8, pa.int32()), pa.array(slot & 255, pa.int32()), pa.array(zeros), pa.array(ones), pa.array(log_mix)], names=names)


def _top(rows: list) -> tuple[np.ndarray, ...]:
    """Stop weight and probability of a one, for decisions with one context byte (256 x 256) and with none (256)."""
    zeros, ones, mix = (np.zeros((256, 256)) for _ in range(3))
    for r in rows:
        zeros[r.nearest, r.node], ones[r.nearest, r.node], mix[r.nearest, r.node] = r.zeros, r.ones, r.log_mix
    log_kt = _log_kt(zeros, ones)
    mixed_1 = _with_children(log_kt, mix)
    stop_1, one_1 = np.exp(log_kt - np.log(2) - mixed_1), (ones + 0.5) / (zeros + ones + 1)
    zeros, ones = zeros.sum(axis=0), ones.sum(axis=0)
    log_kt = _log_kt(zeros, ones)
    stop_0 = np.exp(log_kt - np.log(2) - _with_children(log_kt, mixed_1.sum(axis=0)))
    return stop_1, one_1, stop_0, (ones + 0.5) / (zeros + ones + 1)


def _values(top) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stop_1, one_1, stop_0, one_0 = top.value
        for b in batches:
            code = b.column("code").to_numpy()
            below = np.frombuffer(b"".join(b.column("below").to_pylist()), float).reshape(-1, 8)
            byte, nearest, total = code & 255, (code >> 8) & 255, np.zeros(len(code))
            for bit in range(8):
                node, one = (byte | 256) >> (8 - bit), (byte >> (7 - bit)) & 1
                p1, p0 = one_1[nearest, node], one_0[node]
                p = stop_1[nearest, node] * np.where(one, p1, 1 - p1) + (1 - stop_1[nearest, node]) * below[:, bit]
                total += np.log10(stop_0[node] * np.where(one, p0, 1 - p0) + (1 - stop_0[node]) * p)
            yield pa.RecordBatch.from_pydict({"code": code, "value": total})

    return run


_SCORES = "doc_id bigint, n_tokens bigint, n_known bigint, n_bytes bigint, base_score double, score double"


def _scores(chunk: pa.Table, answers: pa.Table, n_train: int, n_distinct: int) -> pa.Table:
    """Scores of a chunk's documents from the values of its grams and words."""
    code, value = (answers.column(c).to_numpy() for c in ("code", "value"))
    order = np.argsort(code, kind="stable")
    code_known, value_known = code[order], value[order]
    out = []
    for row in chunk.to_batches():
        for k in range(row.num_rows):
            for ids, data, offsets, _ in _steps(row.slice(k, 1)):
                code, first = grams(data, offsets)
                score = np.add.reduceat(value_known[np.searchsorted(code_known, code)], first[:-1])
                n_bytes = np.diff(first)
                words, first = _words(data, offsets)
                owner = np.concatenate([np.repeat(np.arange(len(ids)), np.diff(first)), np.arange(len(ids))])
                words = np.concatenate([words, np.full(len(ids), END_WORD)])
                c = value_known[np.searchsorted(code_known, words)]
                base = np.bincount(owner, np.log10((c + 1) / (n_train + 1.0 * (n_distinct + 1))), minlength=len(ids))
                n_known = np.bincount(owner, c > 0, minlength=len(ids)).astype(np.int64)
                out.append(pa.table({"doc_id": ids, "n_tokens": np.diff(first) + 1, "n_known": n_known, "n_bytes": n_bytes, "base_score": base, "score": score}))
    return pa.concat_tables(out)


def scored(docs: DataFrame, train) -> DataFrame:
    """Per document: doc_id, n_tokens, n_known, n_bytes, train_tokens, base_score, score.

    ``train`` is a boolean column: the documents to learn from. ``base_score`` is the unigram score of its words.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), train.alias("train"))
    chunks = stored(rows.mapInArrow(_packed, "chunk bigint, doc_id array<bigint>, text array<string>, train array<boolean>"), "chunks")
    asked = stored(chunks.mapInArrow(_asked, "chunk bigint, code bigint, n bigint"), "asked")
    totals = stored(asked.groupBy("code").agg(F.sum("n").alias("n")), "totals")
    words = totals.where(F.col("code") >= IS_WORD)
    sums = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.when(F.col("n") > 0, 1)).alias("distinct")).first()
    last_two = F.shiftright("code", 8).bitwiseAND(F.lit(0xFFFF))
    suffix = totals.where(F.col("code") < IS_WORD).repartition(last_two).sortWithinPartitions(last_two)
    trees = stored(suffix.mapInArrow(_suffix_trees, "code bigint, below binary, nearest int, node int, zeros double, ones double, log_mix double"), "trees")
    top = trees.where("node IS NOT NULL").groupBy("nearest", "node").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "log_mix"))).collect()
    values = trees.where("node IS NULL").select("code", "below").mapInArrow(_values(spark.sparkContext.broadcast(_top(top))), "code bigint, value double")
    values = values.unionByName(words.select("code", F.col("n").cast("double").alias("value")))
    answers = asked.select("chunk", "code").join(values, "code").select("chunk", "code", "value")
    n_train, n_distinct = sums["n"], sums["distinct"]
    out = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(lambda x, y: _scores(x, y, n_train, n_distinct), _SCORES)
    return out.withColumn("train_tokens", F.lit(n_train).cast("long"))
