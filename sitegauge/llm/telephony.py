"""Telephony audio columns: G.711 and IMA ADPCM in WAV, decoded and resampled with numpy.

``stored_media`` wraps a payload losslessly: mu-law or A-law as 8-bit samples of 8 kHz, or IMA ADPCM as 4-bit
units, a block of 192 payload bytes behind a head that starts the decoder at 0. ``decoded`` reads the
stored bytes back, expands mu-law and A-law by lookup tables, decodes ADPCM step by step for all blocks of a
batch at once, doubles the rate with a six-point interpolation filter and gives 16-bit PCM.

Defined results. Null text is empty; every payload is filled with spaces to a positive multiple of 192 bytes.
The codec depends on the payload alone, so equal texts give equal values.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sitegauge.llm.common import batch, pieces, small_batches

UNIT, RATE = 192, 8000
MULAW, ALAW, ADPCM = 7, 6, 17
NAMES = {MULAW: "mulaw", ALAW: "alaw", ADPCM: "ima"}
BYTES_PER_STEP = 1 << 19

#: Fixed values of the IMA ADPCM format: step sizes and index changes.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449,
    494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442,
    11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
CHANGES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)


def _mulaw_table() -> np.ndarray:
    """Sample of each mu-law byte."""
    b = ~np.arange(256) & 255
    size = (((b & 15) << 3) + 132 << (b >> 4 & 7)) - 132
    return np.where(b & 128, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    """Sample of each A-law byte."""
    b = np.arange(256) ^ 0x55
    part, low = b >> 4 & 7, (b & 15) << 4
    size = np.where(part == 0, low + 8, (low + 264) << np.maximum(part - 1, 0))
    return np.where(b & 128, size, -size).astype(np.int16)


TABLES = {MULAW: _mulaw_table(), ALAW: _alaw_table()}


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b" ")


def wav(payload: bytes, codec: int) -> bytes:
    """A WAV file of the payload; its bytes stand in the data chunk, in ADPCM after the head of each block."""
    if codec == ADPCM:
        blocks = np.zeros((len(payload) // UNIT, UNIT + 4), np.uint8)
        blocks[:, 4:] = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
        data, samples = blocks.tobytes(), 2 * UNIT + 1
        form = struct.pack("<HHIIHHHH", codec, 1, RATE, RATE * (UNIT + 4) // samples, UNIT + 4, 4, 2, samples)
        count = len(blocks) * samples
    else:
        data, count = payload, len(payload)
        form = struct.pack("<HHIIHHH", codec, 1, RATE, RATE, 1, 8, 0)
    fill = b"\0" * (len(data) & 1)
    chunks = b"".join([b"fmt ", struct.pack("<I", len(form)), form, b"fact", struct.pack("<II", 4, count), b"data", struct.pack("<I", len(data)), data, fill])
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def parsed(media: bytes) -> tuple[int, np.ndarray]:
    """Codec and payload bytes of a WAV file written by ``wav``."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("no WAV file")
    at, codec, width, data = 12, 0, 1, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            codec, _, _, _, width = struct.unpack_from("<HHIIH", media, at + 8)
        elif name == b"data":
            data = np.frombuffer(media, np.uint8, size, at + 8)
        at += 8 + size + (size & 1)
    if data is None:
        raise ValueError("no data chunk")
    return codec, data.reshape(-1, width)[:, 4:].reshape(-1) if codec == ADPCM else data


def adpcm(blocks: np.ndarray) -> np.ndarray:
    """Samples of IMA ADPCM blocks that start at 0, a row each: low four bits first, all blocks step by step."""
    codes = np.empty((blocks.shape[1] * 2, blocks.shape[0]), np.int32)
    codes[0::2], codes[1::2] = (blocks & 15).T, (blocks >> 4).T
    out = np.zeros((len(codes) + 1, blocks.shape[0]), np.int16)
    sample, index = np.zeros(blocks.shape[0], np.int32), np.zeros(blocks.shape[0], np.int32)
    for k, code in enumerate(codes, 1):
        step = STEPS[index]
        change = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        sample = np.clip(sample + np.where(code & 8, -change, change), -32768, 32767)
        index = np.clip(index + CHANGES[code], 0, 88)
        out[k] = sample
    return np.ascontiguousarray(out.T)


def resampled(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate: between two samples stands the six-point interpolation; the ends repeat."""
    x = np.concatenate([np.repeat(pcm[:1], 2), pcm, np.repeat(pcm[-1:], 3)]).astype(np.int32)
    n = len(pcm)
    between = 150 * (x[2 : n + 2] + x[3 : n + 3]) - 25 * (x[1 : n + 1] + x[4 : n + 4]) + 3 * (x[:n] + x[5 : n + 5])
    out = np.empty(2 * n, "<i2")
    out[0::2], out[1::2] = pcm, np.clip((between + 128) >> 8, -32768, 32767)
    return out


_MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])


def stored_media(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes (UTF-8 bytes of the text), media (a WAV file, its codec drawn by the payload's crc32)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", BYTES_PER_STEP):
            text = b.column("text").to_pylist()
            payloads = list(map(payload_of, text))
            media = [wav(p, (MULAW, ALAW, ADPCM)[zlib.crc32(p) % 3]) for p in payloads]
            yield batch(_MEDIA, doc_id=b.column("doc_id").cast(pa.int64()), n_bytes=[len((t or "").encode()) for t in text], media=media)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary")


def _samples(parts: list[tuple[int, np.ndarray]]) -> list[np.ndarray]:
    """PCM of each payload; all ADPCM blocks of the batch are decoded together."""
    blocks = [p.reshape(-1, UNIT) for codec, p in parts if codec == ADPCM]
    rows = adpcm(np.concatenate(blocks)) if blocks else None
    out, at = [], 0
    for codec, payload in parts:
        if codec == ADPCM:
            n = len(payload) // UNIT
            out.append(rows[at : at + n].reshape(-1))
            at += n
        else:
            out.append(TABLES[codec][payload])
    return out


def decoded(media: DataFrame, keep_pcm: bool = True) -> DataFrame:
    """Read ``media`` back: digests of payload and stored form, features, and resampled PCM (16 kHz) if it is kept."""
    small_batches(media.sparkSession)
    fields = [
        ("doc_id", pa.int64(), "bigint"), ("n_bytes", pa.int64(), "bigint"), ("payload_bytes", pa.int64(), "bigint"), ("payload_sha256", pa.string(), "string"), ("tail_crc32", pa.int64(), "bigint"),
        ("media_bytes", pa.int64(), "bigint"), ("media_sha256", pa.string(), "string"), ("feature", pa.string(), "string"), ("pcm_samples", pa.int64(), "bigint"), ("pcm_crc32", pa.int64(), "bigint"),
    ] + ([("pcm", pa.binary(), "binary")] if keep_pcm else [])
    schema = pa.schema([f[:2] for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "media", BYTES_PER_STEP):
            files = b.column("media").to_pylist()
            parts = list(map(parsed, files))
            out: dict[str, list] = {f[0]: [] for f in fields[2:]}
            for file, (codec, payload), pcm in zip(files, parts, _samples(parts), strict=True):
                raw, wide = payload.tobytes(), resampled(pcm)
                level = np.abs(pcm.astype(np.int32))
                power = int(np.square(pcm.astype(np.int64)).sum()) // len(pcm)
                turns = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
                values = [len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]), len(file), hashlib.sha256(file).hexdigest()]
                values += [f"{NAMES[codec]}:{len(pcm)}:{power}:{int(level.max())}:{int(level.sum()) // len(pcm)}:{turns}", len(wide), zlib.crc32(wide.tobytes())]
                for name, value in zip(out, [*values, *([wide.tobytes()] if keep_pcm else [])], strict=True):
                    out[name].append(value)
            yield batch(schema, doc_id=b.column("doc_id"), n_bytes=b.column("n_bytes"), **out)

    return media.mapInArrow(run, ", ".join(f"{f[0]} {f[2]}" for f in fields))
