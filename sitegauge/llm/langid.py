"""Language identification by string kernels.

The kernel of two texts is the number of n-grams (1 to 4 characters) present in both, over the geometric mean
of the numbers present in each (blended spectrum, presence only). N-grams are hashed to ``SLOTS``; the
``VOCABULARY`` most frequent of the fitting sample span the kernel. ``LANDMARKS`` texts of the sample give the
Nyström features, on which one ridge regression per language separates it from the rest. A batch of texts is
scored by two matrix products: presence times landmarks, then kernels times weights.

The sample holds about ``FIT_ROWS`` texts of each language, drawn by a hash of the id; all else covers whole
texts and all rows.

Defined results. Null text, or text without a letter: ``und`` with score 0. Null languages teach nothing.
Without training rows all texts are ``und``; with one language it is predicted with score 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegauge.llm.common import pieces, small_batches, texts, utf8
from sitegauge.llm.grams import characters, present

SIZES, SLOTS, VOCABULARY = (1, 2, 3, 4), 1 << 18, 1 << 13
FIT_ROWS, LANDMARKS, RIDGE = 400, 256, 1e-2
BYTES_PER_STEP = 1 << 19


@dataclass
class KernelModel:
    languages: list[str]
    feature: np.ndarray  # vocabulary entry of each slot, -1: none
    landmarks: np.ndarray  # presence of each landmark over the vocabulary, divided by its norm
    weights: np.ndarray  # landmarks x languages

    def kernels(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        owner, slot = present(*characters(data, offsets), SIZES, SLOTS, self.feature)
        x = np.zeros((len(offsets) - 1, self.landmarks.shape[1]), np.float32)
        x[owner, slot] = 1
        norm = np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
        return (x @ self.landmarks.T) / norm

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the best language of each text and a score from 0 to 1."""
        n = len(offsets) - 1
        if len(self.languages) == 1:
            return np.zeros(n, np.int64), np.ones(n)
        margin = self.kernels(data, offsets) @ self.weights
        best = margin.argmax(axis=1)
        return best, np.clip((margin[np.arange(n), best].astype(float) + 1) / 2, 0, 1)


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of texts of the task that hold each slot."""
    counts = np.zeros(SLOTS, np.int64)
    for b in pieces(batches, "text", BYTES_PER_STEP):
        counts += np.bincount(present(*characters(*utf8(b.column("text"))), SIZES, SLOTS)[1], minlength=SLOTS)
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_pydict({"slot": pa.array(used, pa.int64()), "n": pa.array(counts[used], pa.int64())})


def _vectors(feature: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", BYTES_PER_STEP):
            owner, slot = present(*characters(*utf8(b.column("text"))), SIZES, SLOTS, feature)
            at = np.searchsorted(owner, np.arange(b.num_rows + 1))
            packed = [slot[x:y].astype(np.uint16).tobytes() for x, y in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_pydict({"lang": b.column("lang"), "place": b.column("place"), "grams": pa.array(packed, pa.binary())})

    return run


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS, landmarks: int = LANDMARKS) -> KernelModel | None:
    """Learn from the documents given (doc_id, text, lang); None without a text and a language."""
    small_batches(docs.sparkSession)
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text", F.xxhash64("doc_id").alias("place"))
    n = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    languages = sorted(n)
    if len(languages) < 2:
        return KernelModel(languages, np.full(SLOTS, -1), np.zeros((0, 0)), np.zeros((0, 0))) if languages else None
    limit = F.create_map(*(x for k in languages for x in (F.lit(k), F.lit(int(min(1.0, fit_rows / n[k]) * (1 << 30))))))
    sample = known.where(F.pmod("place", F.lit(1 << 30)) < limit[F.col("lang")])
    counts = sample.select("text").mapInArrow(_grams, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
    common = counts.orderBy(F.desc("n"), "slot").limit(VOCABULARY).toPandas()["slot"].to_numpy()
    feature = np.full(SLOTS, -1)
    feature[np.sort(common)] = np.arange(len(common))
    got = sample.mapInArrow(_vectors(feature), "lang string, place bigint, grams binary").toPandas().sort_values(["place", "lang", "grams"], ignore_index=True)
    x = np.zeros((len(got), len(common)), np.float32)
    for row, grams in enumerate(got["grams"]):
        x[row, np.frombuffer(grams, np.uint16)] = 1
    x /= np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
    turn = got.groupby("lang").cumcount().to_numpy()  # landmarks take turns between the languages
    chosen = np.argsort(turn, kind="stable")[:landmarks]
    marks = x[chosen]
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(float))
    keep = values > 1e-6 * values[-1]
    root = vectors[:, keep] / np.sqrt(values[keep])
    z = (x @ marks.T).astype(float) @ root
    target = np.where(got["lang"].to_numpy()[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    # Each language weighs the same, however many texts it has in the sample.
    weight = 1 / got.groupby("lang")["lang"].transform("size").to_numpy()
    gram = (z * weight[:, None]).T @ z + RIDGE * np.eye(z.shape[1])
    w = root @ np.linalg.solve(gram, (z * weight[:, None]).T @ target)
    return KernelModel(languages, feature, marks, w.astype(np.float32))


def identified(docs: DataFrame, model: KernelModel | None) -> DataFrame:
    """Per document: doc_id, lang_pred, score."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in pieces(batches, "text", BYTES_PER_STEP):
            lettered = [any(map(str.isalpha, t)) for t in texts(b.column("text"))]
            best, score = model.predict(*utf8(b.column("text"))) if model else (None, None)
            pred = [model.languages[best[k]] if model and ok else "und" for k, ok in enumerate(lettered)]
            score = [float(score[k]) if model and ok else 0.0 for k, ok in enumerate(lettered)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, lang_pred string, score double")
