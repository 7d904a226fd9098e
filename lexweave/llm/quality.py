"""Quality scores by naive Bayes support vectors: n-gram indicators scaled by log-count ratios, linear hinge loss."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexweave.llm.common import arrow_bytes, cool, lean, words

#: Feature space: hashes of runs of 1 to 4 bytes.
BITS, GRAMS = 18, (1, 2, 3, 4)
#: Labelled rows that a model is fitted on, the first by crc32 of a salted doc_id: the documented bound.
SAMPLE_ROWS = 4000
#: Bytes whose features are computed at once, so that any text length takes bounded memory.
STRIDE = 1 << 16


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text is a multiple of 5; no id: held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def features(data: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The distinct features of a text's bytes; mask is a cleared scratch array of the feature space."""
    top = max(GRAMS)
    for i in range(0, max(len(data), 1), STRIDE):
        run = data[i : i + STRIDE + top - 1].astype(np.uint32)
        code = np.zeros(len(run), dtype=np.uint32)
        for n in GRAMS:
            if len(run) < n:
                break
            code = code[: len(run) - n + 1] * np.uint32(0x01000193) + run[n - 1 :] + np.uint32(n)
            mask[(code * np.uint32(2654435769)) >> np.uint32(32 - BITS)] = True
    mask[repeats(data)] = True
    found = np.flatnonzero(mask)
    mask[found] = False
    return found


def repeats(data: np.ndarray) -> list[int]:
    """Features of word bigrams whose words are equal: one for each power of two up to how often, and for their share."""
    hashed, _, _, _ = words(data, np.array([0, len(data)]))
    if len(hashed) < 2:
        return []
    same = int((hashed[1:] == hashed[:-1]).sum())
    share = int(16 * same / len(hashed))
    return [*range(2, 2 + same.bit_length()), *range(40, 40 + share)]


@dataclass
class Model:
    """Scale and weight of each feature, the bias, and the slope and offset that turn a margin into a probability."""

    scale: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, found: np.ndarray) -> float:
        v = self.scale[found].astype(np.float64)
        size = float(np.sqrt(v @ v))
        return (float(v @ self.weights[found]) / size if size else 0.0) + self.bias

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(np.clip(-(self.slope * margin + self.offset), -35, 35)))


def unit(v: np.ndarray) -> np.ndarray:
    """v at length 1, so that short and long texts weigh alike."""
    size = float(np.sqrt(v @ v))
    return v / size if size else v


def dual_coordinate_descent(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, cost: np.ndarray, epochs: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights of a linear classifier with hinge loss by dual coordinate descent.

    Row i's vector is scale at its features, at length 1; a bias is one more feature of constant 1. Each step solves the
    one-variable dual problem of a row: 0 <= alpha <= cost.
    """
    w, bias = np.zeros(len(scale)), 0.0
    alpha = np.zeros(len(rows))
    values = [unit(scale[r]) for r in rows]
    norm = np.array([float(v @ v) + 1.0 for v in values])
    rng = np.random.Generator(np.random.PCG64(seed))
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            grad = y[i] * (float(values[i] @ w[rows[i]]) + bias) - 1.0
            new = min(max(alpha[i] - grad / norm[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, bias


def calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (positive) and offset of a logistic curve through margins, by Newton steps on smoothed targets."""
    pos, neg = int((y > 0).sum()), int((y <= 0).sum())
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, math.log((pos + 1) / (neg + 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(np.clip(-(a * margin + b), -35, 35)))
        g = np.array([((p - t) * margin).sum(), (p - t).sum()])
        v = p * (1 - p)
        h = np.array([[(v * margin * margin).sum() + 1e-6, (v * margin).sum()], [(v * margin).sum(), v.sum() + 1e-6]])
        d = np.linalg.solve(h, g)
        a, b = a - d[0], b - d[1]
        if abs(d).max() < 1e-8:
            break
    return (float(a), float(b)) if a > 0 and np.isfinite(a) and np.isfinite(b) else (1.0, 0.0)


def fit(texts: list[bytes], labels: list[int], cost: float = 1.0, smoothing: float = 1.0) -> Model:
    """A model of label 1 from texts.

    A feature's scale is the log ratio of its smoothed shares in the two classes. The probability curve is
    fitted on margins that two halves of the rows give each other, so it isn't fooled by fitted rows. Without
    labels, or with one class alone, the score is that class's smoothed share for every text.
    """
    n = 1 << BITS
    y = np.where(np.array(labels, dtype=np.int64) > 0, 1.0, -1.0)
    pos = int((y > 0).sum())
    if not pos or pos == len(y):
        return Model(np.zeros(n, np.float32), np.zeros(n, np.float32), 0.0, 1.0, math.log((pos + 1) / (len(y) - pos + 1)))
    mask = np.zeros(n, dtype=bool)
    rows = [features(np.frombuffer(t, dtype=np.uint8), mask).astype(np.int32) for t in texts]

    def train(which: np.ndarray) -> Model:
        p, q = np.full(n, smoothing), np.full(n, smoothing)
        for i in which:
            (p if y[i] > 0 else q)[rows[i]] += 1
        a, b = max(1, int((y[which] > 0).sum())), max(1, int((y[which] <= 0).sum()))
        ratio = np.log(p / (a + 2 * smoothing)) - np.log(q / (b + 2 * smoothing))
        ratio[(p + q) < 3 + 2 * smoothing] = 0.0
        share = np.where(y[which] > 0, len(which) / (2 * a), len(which) / (2 * b))
        w, bias = dual_coordinate_descent([rows[i] for i in which], ratio, y[which], cost * share)
        return Model(ratio.astype(np.float32), w.astype(np.float32), bias, 1.0, 0.0)

    margin = np.zeros(len(y))
    half = np.arange(len(y)) % 2 == 0
    for own, rest in ((half, ~half), (~half, half)):
        m = train(np.flatnonzero(own))
        margin[rest] = [m.margin(rows[i]) for i in np.flatnonzero(rest)]
    slope, offset = calibrate(margin, y)
    m = train(np.arange(len(y)))
    return Model(m.scale, m.weights, m.bias, slope, offset)


def labelled(docs: DataFrame, labels: DataFrame, column: str, rows: int = SAMPLE_ROWS, salt: str = "fit") -> list[tuple[bytes, int]]:
    """At most rows labelled texts to learn from, the first by md5 of salt and id; held-out rows are never among them.

    Rows without id or label are left out; of several labels of one id the smallest counts.
    """
    lean(docs.sparkSession)
    one = labels.where(~held_out(F.col("doc_id")) & F.col(column).isNotNull()).groupBy("doc_id").agg(F.min(column).cast("int").alias("label"))
    picked = one.orderBy(F.md5(F.concat(F.lit(salt), F.col("doc_id").cast("string"))), "doc_id").limit(rows)
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")).join(F.broadcast(picked), "doc_id")
    return [(bytes(r["text"]), r["label"]) for r in found.orderBy("doc_id").select("text", "label").toLocalIterator()]


def scores(model: Model, texts: pa.Array, mask: np.ndarray) -> np.ndarray:
    """Scores of texts; mask is a cleared scratch array of the feature space."""
    data, at = arrow_bytes(texts)
    return model.score(np.array([model.margin(features(data[a:e], mask)) for a, e in zip(at[:-1], at[1:], strict=True)]))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs, from its whole text.

    The model is fitted on a bounded sample of labelled rows and every whole text is scored. Null and empty
    texts have no features and get the score of the bias. Repeated rows get equal scores; columns other than
    doc_id and text are not read, and an empty table gives no rows.
    """
    spark: SparkSession = docs.sparkSession
    sample = labelled(docs, labels, "quality", rows)
    shared = spark.sparkContext.broadcast(fit([t for t, _ in sample], [v for _, v in sample]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cool()
        mask = np.zeros(1 << BITS, dtype=bool)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores(shared.value, b.column(1), mask))], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs without the rows whose score is below threshold; rows are scored and dropped in one pass."""
    sample = labelled(docs, labels, "quality", rows)
    shared = docs.sparkSession.sparkContext.broadcast(fit([t for t, _ in sample], [v for _, v in sample]))
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cool()
        mask = np.zeros(1 << BITS, dtype=bool)
        for b in batches:
            yield b.filter(pa.array(scores(shared.value, b.column(text), mask) >= threshold))

    return docs.mapInArrow(run, docs.schema)
