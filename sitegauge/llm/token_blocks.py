"""Token ids in binary files of patched frame-of-reference blocks.

A file is a run of sections, each closed by one byte 10, as Spark's text writer leaves it. All numbers are
little-endian. A section holds whole documents:

    magic "PFOR1", u8 flags (0), u32 documents, u64 ids, u32 blocks, u64 body bytes
    documents: i64 doc_id each, u8 id-is-null each, u64 number of ids each
    index: u32 start of each block within the body
    body: blocks one after the other

A block packs up to 128 ids: u16 block minimum, u8 width, u8 exceptions, the ids less the minimum in ``width``
bits each (low bits first; the last block of a section is filled up with its minimum), then the exceptions'
places (u8 each) and their bits above the width (u16 each). The width is the least that holds the
``PERCENTILE`` of the block's values; values beyond it are the exceptions.

Documents are written in ascending order of doc_id (null first, equal ids by text), one file per range of
ids, so a document's start is the ids in files before plus those before it in its file. The number of ranges
follows the bytes of all texts, ``FILE_BYTES`` of text a file, so files stay small whatever the input.

Defined results. A null or empty text has the end id alone. Rows repeated are written as often as they come.
An empty table gives no rows. Special tokens' strings in a text become the special tokens, as the library reads
them with add_special_tokens=False.
"""

from __future__ import annotations

import os
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitegauge.llm.common import batch, pieces, small_batches, stored, texts
from sitegauge.session import shared_scratch

BLOCK, PERCENTILE = 128, 90
END = 0
SECTION_IDS = 1 << 17
FILE_BYTES = 1 << 24
MEMO, MEMO_CHARS = 1_600_000, 32
BYTES_PER_STEP = 1 << 18
_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~"
_HEAD = struct.Struct("<5sBIQIQ")


class Encoder:
    """A byte-level tokenizer with a memo of short pieces.

    Byte-level BPE never merges across a space that a visible character follows, so a text may be cut there.
    The memo takes pieces as they come until it holds ``size``, and starts anew once it has then missed as many.
    """

    def __init__(self, path: str, size: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this tokenizer don't fit into 16 bits")
        #: Strings that the library reads as one token wherever they stand: such a text is encoded whole.
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memo: dict[str, bytes] = {}  # of pieces that stand behind a space, without it
        self.size, self.missed = size, 0  # missed since it is full
        self.unsafe, self.cut = re.compile(r" (?=\s)"), re.compile(r"(?= \S)")

    def ids(self, many: list[str]) -> list[bytes]:
        """The ids of each text as little-endian u16."""
        if self.missed > self.size:
            self.memo.clear()
            self.missed = 0
        heads, out, open_, missing = [], [], [], {}
        for text in many:
            head, *rest = self._pieces(text)
            found = list(map(self.memo.get, rest))
            heads.append(head)
            try:
                out.append(b"".join(found))
            except TypeError:  # some aren't in the memo
                missing.update((p, None) for p, ids in zip(rest, found, strict=True) if ids is None)
                open_.append((len(out), rest, found))
                out.append(b"")
        new = self._new(missing)
        for k, rest, found in open_:
            out[k] = b"".join([new[p] if ids is None else ids for p, ids in zip(rest, found, strict=True)])
        if len(self.memo) < self.size:
            self.memo.update((p, ids) for p, ids in new.items() if p in missing and len(p) <= MEMO_CHARS)
        else:
            self.missed += len(missing)
        return [head + tail for head, tail in zip(self._encoded(heads), out, strict=True)]

    def _new(self, missing: dict[str, None]) -> dict[str, bytes]:
        """The ids of pieces that the memo lacks; signs at the end are never merged with a letter or digit before."""
        split = {p: (core, p[len(core) :]) for p in missing if (core := p.rstrip(_SIGNS)) != p and core and core[-1].isalnum()}
        parts = dict.fromkeys(core for core, _ in split.values())
        whole = [p for p in {**missing, **parts} if p not in split and p not in self.memo]
        known = dict(zip(whole, self._encoded([" " + p for p in whole]), strict=True))
        ends = list(dict.fromkeys(end for _, end in split.values()))
        ends = dict(zip(ends, self._encoded(ends), strict=True))
        return known | {p: (self.memo.get(core) or known[core]) + ends[end] for p, (core, end) in split.items()}

    def _encoded(self, pieces_: list[str]) -> list[bytes]:
        out = []
        for k in range(0, len(pieces_), 4096):
            out += [array("H", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(pieces_[k : k + 4096], add_special_tokens=False)]
        return out

    def _pieces(self, text: str) -> list[str]:
        """The text up to its first cut, then what stands behind the space of each cut."""
        if any(t in text for t in self.special):
            return [text]
        if self.unsafe.search(text):
            head, *rest = self.cut.split(text)
            return [head, *(p[1:] for p in rest)]
        return text.split(" ")


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, memo: int = MEMO) -> Encoder:
    """The task process's encoder for a vocabulary file; kept while the process lives."""
    if (path, memo) not in _encoders:
        _encoders[path, memo] = Encoder(path, memo)
    return _encoders[path, memo]


def pack(ids: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Block starts and body of the blocks that hold ``ids``."""
    if not len(ids):
        return np.zeros(0, np.uint32), b""
    full = -(-len(ids) // BLOCK) * BLOCK
    grid = np.concatenate([ids, np.full(full - len(ids), ids[len(ids) // BLOCK * BLOCK :].min() if full > len(ids) else 0, ids.dtype)]).reshape(-1, BLOCK).astype(np.uint32)
    low = grid.min(axis=1)
    value = grid - low[:, None]
    edge = np.partition(value, BLOCK * PERCENTILE // 100, axis=1)[:, BLOCK * PERCENTILE // 100]
    width = np.ceil(np.log2(edge + 1.0)).astype(np.int64)
    over = value >> width[:, None].astype(np.uint32)
    misses = np.count_nonzero(over, axis=1)
    sizes = 4 + width * BLOCK // 8 + misses * 3
    starts = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
    body = np.zeros(starts[-1], np.uint8)
    at = starts[:-1]
    body[at], body[at + 1], body[at + 2], body[at + 3] = low & 255, low >> 8, width, misses
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        if w:
            bits = np.unpackbits(value[rows].astype("<u2").view(np.uint8).reshape(len(rows), BLOCK, 2), axis=2, count=int(w), bitorder="little")
            packed = np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little")
            body[at[rows][:, None] + 4 + np.arange(w * BLOCK // 8)] = packed
    row, place = np.nonzero(over)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(misses) - misses, misses)
    base = at[row] + 4 + width[row] * BLOCK // 8
    body[base + nth] = place
    rest = over[row, place]
    body[base + misses[row] + 2 * nth], body[base + misses[row] + 2 * nth + 1] = rest & 255, rest >> 8
    return at.astype(np.uint32), body.tobytes()


def unpack(starts: np.ndarray, body: np.ndarray, blocks: np.ndarray | None = None) -> np.ndarray:
    """Ids of the given blocks (all of them without ``blocks``), a row of 128 each."""
    at = starts.astype(np.int64) if blocks is None else starts[blocks].astype(np.int64)
    if not len(at):
        return np.zeros((0, BLOCK), np.uint32)
    low = body[at].astype(np.uint32) | (body[at + 1].astype(np.uint32) << 8)
    width, misses = body[at + 2].astype(np.int64), body[at + 3].astype(np.int64)
    value = np.zeros((len(at), BLOCK), np.uint32)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        if w:
            packed = body[at[rows][:, None] + 4 + np.arange(w * BLOCK // 8)]
            bits = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(rows), BLOCK, w)
            wide = np.zeros((len(rows), BLOCK, 16), np.uint8)
            wide[:, :, :w] = bits
            value[rows] = np.packbits(wide, axis=2, bitorder="little").view("<u2")[:, :, 0]
    row = np.repeat(np.arange(len(at)), misses)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(misses) - misses, misses)
    base = at[row] + 4 + width[row] * BLOCK // 8
    rest = body[base + misses[row] + 2 * nth].astype(np.uint32) | (body[base + misses[row] + 2 * nth + 1].astype(np.uint32) << 8)
    value[row, body[base + nth]] |= rest << width[row].astype(np.uint32)
    return value + low[:, None]


def section(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    """The bytes of a section that holds these documents (ids as little-endian u16)."""
    flat = np.frombuffer(b"".join(ids), "<u2")
    starts, body = pack(flat)
    head = _HEAD.pack(b"PFOR1", 0, len(doc_ids), len(flat), len(starts), len(body))
    known = np.array([d if d is not None else 0 for d in doc_ids], "<i8").tobytes()
    null = np.array([d is None for d in doc_ids], np.uint8).tobytes()
    return b"".join([head, known, null, np.array([len(i) // 2 for i in ids], "<u8").tobytes(), starts.astype("<u4").tobytes(), body])


def sections(content: bytes) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """Of each section of a file: doc_ids, numbers of ids, and all ids."""
    at = 0
    while at < len(content):
        magic, _, docs, n, blocks, size = _HEAD.unpack_from(content, at)
        if magic != b"PFOR1":
            raise ValueError(f"no section at byte {at}")
        at += _HEAD.size
        known = np.frombuffer(content, "<i8", docs, at)
        null = np.frombuffer(content, np.uint8, docs, at + 8 * docs)
        counts = np.frombuffer(content, "<u8", docs, at + 9 * docs)
        starts = np.frombuffer(content, "<u4", blocks, at + 17 * docs)
        at += 17 * docs + 4 * blocks
        body = np.frombuffer(content, np.uint8, size, at)
        yield [None if x else int(d) for d, x in zip(known, null, strict=True)], counts.astype(np.int64), unpack(starts, body).reshape(-1)[:n]
        at += size
        if content[at : at + 1] != b"\n":
            raise ValueError(f"section isn't closed at byte {at}")
        at += 1


def write(docs: DataFrame, path: str, vocabulary: str, memo: int = MEMO) -> None:
    """Encode ``docs`` (doc_id, text) and write the files, one per range of doc_id, through Spark's committer.

    ``memo`` bounds the pieces that a task process remembers, at about 200 bytes each.
    """
    small_batches(docs.sparkSession)
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tie", F.xxhash64("text"))
    files = 1 + (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // FILE_BYTES
    ordered = ranged.repartitionByRange(files, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(vocabulary, memo), np.array([END], "<u2").tobytes()
        doc_ids, ids, size = [], [], 0
        for b in pieces(batches, "text", BYTES_PER_STEP):
            for d, i in zip(b.column("doc_id").to_pylist(), encode.ids(texts(b.column("text"))), strict=True):
                doc_ids.append(d)
                ids.append(i + end)
                size += len(i) // 2 + 1
                if size >= SECTION_IDS:
                    yield pa.RecordBatch.from_pydict({"section": pa.array([section(doc_ids, ids)], pa.binary())})
                    doc_ids, ids, size = [], [], 0
        if doc_ids:
            yield pa.RecordBatch.from_pydict({"section": pa.array([section(doc_ids, ids)], pa.binary())})

    ordered.select("doc_id", "text").mapInArrow(run, "section binary").select(F.col("section").cast("string").alias("value")).write.text(path)


def read(spark, path: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids before it), n_tokens, ids (binary, little-endian u32)."""
    small_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    schema = pa.schema([("file", pa.string()), ("place", pa.int64()), ("doc_id", pa.int64()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                before = place = 0
                for doc_ids, counts, ids in sections(content.as_buffer().to_pybytes()):
                    at = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])
                    blobs = [ids[x:y].astype("<u4").tobytes() for x, y in zip(at, at[1:], strict=False)]
                    yield batch(schema, file=[file.rsplit("/", 1)[-1]] * len(blobs), place=np.arange(place, place + len(blobs)), doc_id=doc_ids, before=at[:-1] + before, n_tokens=counts, ids=blobs)
                    before, place = before + int(at[-1]), place + len(blobs)

    return files.select("path", "content").mapInArrow(run, "file string, place bigint, doc_id bigint, before bigint, n_tokens bigint, ids binary")


def placed(rows: DataFrame) -> DataFrame:
    """Start of each document: ids of the files before (their part numbers follow doc_id) and before it in its file.

    Only one row per file is ordered in one task, and broadcast.
    """
    ends = rows.groupBy("file").agg(F.sum("n_tokens").alias("size")).withColumn("part", F.split("file", "-")[1].cast("long"))
    earlier = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    ahead = ends.select("file", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("ahead"))
    return rows.join(F.broadcast(ahead), "file").withColumn("start", F.col("before") + F.col("ahead")).drop("ahead", "before", "file", "place")


def digests(docs: DataFrame, vocabulary: str, memo: int = MEMO) -> DataFrame:
    """Write the token files and describe each document from them: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = f"{shared_scratch(spark)}/tokens"
    write(docs, path, vocabulary, memo)
    rows = read(spark, path).select("file", "place", "doc_id", "before", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return placed(stored(rows, "token-rows")).select("doc_id", "start", "n_tokens", "ids_crc32")

