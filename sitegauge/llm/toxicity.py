"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the n-grams (2 to 5 characters) present in the whole text, hashed to ``SLOTS``. Presence counts
by label cover every labelled training row; they give each slot its log-count ratio. All slots that differ between
the labels (chi-squared above ``LEAST_CHI2``) are kept, and a logistic regression on ratio-scaled presence is fitted on a
sample of about ``FIT_ROWS`` training rows, drawn by a hash of the id: all rows of the rarer label up to half of
that, the rest of the other; the fitted bias is set back to the shares of all training rows. The ridge is the one of
``RIDGES`` with the least log loss on a quarter of the sample that the others are fitted without. Gradients are
summed over Spark's partitions; rows never come to the driver.

Defined results. Null or empty text has no n-grams and scores the intercept. Null labels teach nothing, a
label repeated for one id counts each time. Without training rows of both labels every score is the share
of label 1 (0 without rows).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from sitegauge.llm.common import fold, pieces, small_batches, stored, utf8
from sitegauge.llm.grams import characters, present

SIZES, SLOTS = (2, 3, 4, 5), 1 << 18
FIT_ROWS, RIDGES, STEPS = 12_000, (1e-5, 1e-4, 1e-3), 30
#: Partitions of the fitting sample: each sends one gradient to the driver.
PARTS = 12
#: Slots whose presence differs less between the labels, as a chi-squared value, are noise.
LEAST_CHI2 = 20
BYTES_PER_STEP = 1 << 18


@dataclass
class Classifier:
    feature: np.ndarray  # feature of each slot, -1: none
    weight: np.ndarray  # ratio times fitted weight of each feature
    bias: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each text."""
        n = len(offsets) - 1
        if not len(self.weight):
            return np.full(n, _sigmoid(np.array(self.bias)))
        owner, slot = present(*characters(data, offsets), SIZES, SLOTS, self.feature)
        return _sigmoid(self.bias + np.bincount(owner, self.weight[slot], minlength=n))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Presence counts of each slot by label, summed over the task."""
    counts = np.zeros((2, SLOTS), np.int64)
    for b in pieces(batches, "text", BYTES_PER_STEP):
        label = b.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
        owner, slot = present(*characters(*utf8(b.column("text"))), SIZES, SLOTS)
        for k in (0, 1):
            counts[k] += np.bincount(slot[label[owner] == k], minlength=SLOTS)
    used = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_pydict({"slot": pa.array(used, pa.int64()), "clean": counts[0, used], "toxic": counts[1, used]})


def _rows_of_features(feature: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", BYTES_PER_STEP):
            owner, slot = present(*characters(*utf8(b.column("text"))), SIZES, SLOTS, feature)
            at = np.searchsorted(owner, np.arange(b.num_rows + 1))
            packed = [slot[x:y].astype(np.uint32).tobytes() for x, y in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_pydict({"toxic": b.column("toxic").cast(pa.int64()), "apart": b.column("apart"), "features": pa.array(packed, pa.binary())})

    return run


def _sums_of_rows(size: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Loss and its gradient by bias and by summed feature, over the rows of the task."""
        weight, bias = shared.value
        loss, by_bias, by_feature = 0.0, 0.0, np.zeros(size)
        for b in batches:
            lists, label = b.column("features").to_pylist(), b.column("toxic").to_numpy(zero_copy_only=False)
            owner, slot = np.repeat(np.arange(len(lists)), [len(x) // 4 for x in lists]), np.frombuffer(b"".join(lists), np.uint32)
            z = bias + np.bincount(owner, weight[slot], minlength=len(lists))
            error = _sigmoid(z) - label
            loss, by_bias = loss + float((np.logaddexp(0, z) - label * z).sum()), by_bias + float(error.sum())
            by_feature += np.bincount(slot, error[owner], minlength=size)
        yield pa.RecordBatch.from_pydict({"loss": [loss], "by_bias": [by_bias], "by_feature": pa.array([by_feature.tobytes()], pa.binary())})

    return run


def _loss(rows: DataFrame, scale: np.ndarray, point: np.ndarray) -> tuple[float, np.ndarray]:
    """Summed log loss of (toxic, features) and its gradient; a Spark job sums them."""
    shared = rows.sparkSession.sparkContext.broadcast((scale * point[:-1], float(point[-1])))
    loss, by = 0.0, np.zeros(len(point))
    for r in rows.mapInArrow(_sums_of_rows(len(scale), shared), "loss double, by_bias double, by_feature binary").collect():
        loss, by = loss + r.loss, by + np.append(scale * np.frombuffer(r.by_feature), r.by_bias)
    shared.unpersist()
    return loss, by


def _logistic(rows: DataFrame, n: int, scale: np.ndarray, start: float, ridge: float) -> np.ndarray:
    """Logistic regression with a ridge over (toxic, features), by limited-memory BFGS: weights and bias."""

    def at(point: np.ndarray) -> tuple[float, np.ndarray]:
        loss, by = _loss(rows, scale, point)
        w = np.append(point[:-1], 0.0)
        return loss / n + ridge / 2 * float(w @ w), by / n + ridge * w

    point, past = np.append(np.zeros(len(scale)), start), []
    value, slope = at(point)
    for _ in range(STEPS):
        way, used = -slope, []
        for s, y in reversed(past):
            used.append((s @ way) / (s @ y))
            way = way - used[-1] * y
        way = way * ((past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(np.abs(slope).sum(), 1e-12))
        for (s, y), k in zip(past, reversed(used), strict=True):
            way = way + (k - (y @ way) / (s @ y)) * s
        length, down = 1.0, float(slope @ way)
        while (there := at(point + length * way))[0] > value + 1e-4 * length * down and length > 1e-3:
            length /= 2
        if there[0] >= value:
            break
        s, y, gain = length * way, there[1] - slope, value - there[0]
        past = [*past, (s, y)][-10:] if s @ y > 1e-12 else past
        point, (value, slope) = point + s, there
        if gain < 1e-4 * value or value < 1e-3:
            break
    return point


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Classifier:
    """Learn from the labelled documents given (``labels``: doc_id, toxic)."""
    small_batches(docs.sparkSession)
    known = labels.where("toxic IN (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    n = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    # Labels grow with the documents: shuffled at any size, never broadcast.
    joined = docs.select("doc_id", "text").join(known.hint("merge"), "doc_id")
    total = sum(n.values())
    if len(n) < 2:
        share = n.get(1, 0) / max(total, 1)
        return Classifier(np.full(SLOTS, -1), np.zeros(0), float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    rows = joined.select("toxic", "text").mapInArrow(_presence, "slot bigint, clean bigint, toxic bigint")
    sums = rows.groupBy("slot").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toPandas()
    counts = np.zeros((2, SLOTS))
    counts[0, sums["slot"]], counts[1, sums["slot"]] = sums["clean"], sums["toxic"]
    share = (counts + 1) / (np.array([[n[0]], [n[1]]]) + 2)
    ratio = np.log(share[1] / share[0])
    pooled = counts.sum(axis=0) / total
    spread = pooled * (1 - pooled) * (1 / n[0] + 1 / n[1])
    use = (counts[1] / n[1] - counts[0] / n[0]) ** 2 / np.maximum(spread, 1e-12)
    best = np.flatnonzero(use > LEAST_CHI2)
    feature = np.full(SLOTS, -1)
    feature[best] = np.arange(len(best))
    # Up to half of the sample for the rarer label, what is left for the other.
    rare = min(n, key=lambda k: (n[k], k))
    quota = {rare: min(n[rare], fit_rows // 2)}
    quota[1 - rare] = fit_rows - quota[rare]
    part = F.when(F.col("toxic") == rare, min(1.0, quota[rare] / n[rare])).otherwise(min(1.0, quota[1 - rare] / n[1 - rare]))
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < part * (1 << 30))
    drawn = drawn.withColumn("apart", F.pmod(F.xxhash64(F.lit("apart"), "doc_id"), F.lit(4)) == 0)
    sample = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("toxic", "apart", "text")  # about fit_rows rows
    got = sample.mapInArrow(_rows_of_features(feature), "toxic bigint, apart boolean, features binary")
    got = stored(got.repartition(PARTS).sortWithinPartitions("toxic", "features"), "features")
    held = {(r.toxic, r.apart): r["count"] for r in got.groupBy("toxic", "apart").count().collect()}
    drawn_n = {k: held.get((k, False), 0) + held.get((k, True), 0) for k in (0, 1)}
    if not all(drawn_n.values()) or not len(best):
        return Classifier(feature, ratio[best], float(np.log(n[1] / n[0])))
    start, ridge = float(np.log(drawn_n[1] / drawn_n[0])), RIDGES[len(RIDGES) // 2]
    if all(held.get((k, a), 0) for k in (0, 1) for a in (False, True)):
        inner, apart = (got.where(F.col("apart") == a).select("toxic", "features") for a in (False, True))
        loss = {r: _loss(apart, ratio[best], _logistic(inner, held[0, False] + held[1, False], ratio[best], start, r))[0] for r in RIDGES}
        ridge = min(RIDGES, key=lambda r: (loss[r], -r))
    point = _logistic(got.select("toxic", "features"), sum(drawn_n.values()), ratio[best], start, ridge)
    return Classifier(feature, ratio[best] * point[:-1], float(point[-1]) + float(np.log(n[1] / n[0])) - start)


def scored(docs: DataFrame, model: Classifier, columns: list[str]) -> DataFrame:
    """The named columns of ``docs`` and ``score``."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    out = docs.select(*columns).withColumn("score", F.lit(0.0))
    schema = to_arrow_schema(out.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "__text", BYTES_PER_STEP):
            score = shared.value.scores(*utf8(b.column("__text")))
            yield pa.RecordBatch.from_arrays([*(b.column(c).cast(schema.field(c).type) for c in columns), pa.array(score, pa.float64())], schema=schema)

    return docs.select(*columns, F.col("text").alias("__text")).mapInArrow(run, out.schema)


def training_labels(labels: DataFrame) -> DataFrame:
    """Labels that may be learned: those of the four folds that are not held out."""
    return labels.where(fold("doc_id", 5) != 0).select("doc_id", "toxic")


def without_toxic(docs: DataFrame, model: Classifier, limit: float = 0.5) -> DataFrame:
    """The documents that score below ``limit``; all columns, every row judged for itself."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", BYTES_PER_STEP):
            yield b.filter(pa.array(shared.value.scores(*utf8(b.column("text"))) < limit))

    return docs.mapInArrow(run, docs.schema)
