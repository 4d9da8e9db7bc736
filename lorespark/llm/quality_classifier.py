"""Quality classifier by positive-unlabelled learning.

The classifier is linear over hashed n-grams and text statistics. It minimises the non-negative unbiased risk: the
positives' loss weighted by the class prior, plus the unlabelled loss as negatives less the share of it that the
positives explain, kept from going below zero. The loss is the bounded sigmoid loss: with an unbounded one the
sampling error of the explained share outgrows the few negatives as scores get large.

Trusted positives are a bounded sample of the rows labelled 1; rows labelled 0 are not used. Every document outside
the held-out fold is unlabelled text. Documents are learned from where they are read, in chunks: each chunk estimates the
class prior from the positives and its own texts, minimises the risk over both in mini-batches, and the chunks' weights are
averaged by their numbers of documents. Small partitions are put together, so that no chunk has too few texts for its prior. So the
cost of learning is in proportion to the text however a table is split, and a chunk's memory is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .features import SIZE, Matrix, adam, sigmoid, slices
from .training import bounded, held_out, quality_labels, sampled, weights_of

FOLDS = 5
THRESHOLD = 0.3
#: Trusted positives, at most.
MAX_POSITIVES = 2500
#: Features (numbers that are not zero) of a chunk of documents, about.
CHUNK = 1 << 21
#: Bytes of text that a task learns from, at least: about a chunk.
TASK_BYTES = 4 << 20
#: Positives that travel together.
PACK = 256
#: Mini-batches of a chunk, and steps of the two fits.
BATCHES = 8
STEPS, PRIOR_STEPS = 100, 10
PRIOR_RIDGE = 1e-3
RATE = 0.1
L2 = 1e-5


def risk(w: np.ndarray, x: Matrix, positive: np.ndarray, prior: float) -> tuple[float, float, np.ndarray]:
    """The positives' risk, the negatives' estimated one, and the gradient of the non-negative risk; other rows are unlabelled.

    Where the negatives' risk is below zero the step goes up it instead, so that it doesn't stay there.
    """
    p = np.where(positive, prior / max(1, positive.sum()), 0.0)
    u = np.where(positive, 0.0, 1 / max(1, (~positive).sum()))
    s = sigmoid(x.dot(w[:-1]) + w[-1])
    # The sigmoid loss: 1 - s as a positive, s as a negative.
    first, rest = p @ (1 - s), u @ s - p @ s
    d = s * (1 - s)
    r = (u - 2 * p) * d if rest >= 0 else (p - u) * d
    return first, rest, np.append(x.t_dot(r), r.sum())


def class_prior(positives: Matrix, unlabelled: Matrix) -> float:
    """The share of positives in the unlabelled rows: the smallest ratio of both groups' shares above a score.

    The score is a logistic one of positives against unlabelled rows over the text statistics alone, which a small chunk can't
    overfit. It is fitted on every other row; the shares are taken on the rest, above each twentieth of the positives' scores up to their median,
    the unlabelled one with a part of its standard error, as the smallest of several ratios comes out too small.
    """
    p, u = (np.column_stack([m.dense(), np.ones(len(m.sizes))]) for m in (positives, unlabelled))
    x, y = np.concatenate([p[::2], u[::2]]), np.repeat([1.0, 0.0], [len(p[::2]), len(u[::2])])
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    w = np.zeros(x.shape[1])
    for _ in range(PRIOR_STEPS):  # Newton's method with a ridge
        s = sigmoid(x @ w)
        slope = x.T @ (weight * (s - y)) + PRIOR_RIDGE * w
        w = w - np.clip(np.linalg.solve((x * (weight * s * (1 - s))[:, None]).T @ x + PRIOR_RIDGE * np.eye(len(w)), slope), -1, 1)
    p, u = p[1::2] @ w, u[1::2] @ w
    if not len(p) or not len(u):
        return 0.5
    above = np.quantile(p, np.arange(1, 11) / 20)
    share = (u[:, None] >= above).mean(axis=0)
    error = np.sqrt((share * (1 - share) + 1 / len(u)) / len(u))
    ratio = (share + 0.3 * error) / np.maximum((p[:, None] >= above).mean(axis=0), 1e-9)
    return float(np.clip(ratio.min(), 0.05, 0.95))


def learn(positives: Matrix, unlabelled: Matrix) -> tuple[np.ndarray, float]:
    """Weights that minimise the risk over one chunk, and its class prior."""
    prior = class_prior(positives, unlabelled)
    batches = []
    for k in range(min(BATCHES, len(unlabelled.sizes), len(positives.sizes))):
        p, u = (m.pick(np.arange(k, len(m.sizes), BATCHES)) for m in (positives, unlabelled))
        batches.append((Matrix.stack(p, u), np.arange(len(p.sizes) + len(u.sizes)) < len(p.sizes)))
    turn = iter(range(STEPS))

    def gradient(w: np.ndarray) -> np.ndarray:
        x, positive = batches[next(turn) % len(batches)]
        return risk(w, x, positive, prior)[2] + L2 * w

    return adam(gradient, STEPS, RATE), prior


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(at, vals) of some rows to packed matrices of up to PACK rows."""
    for batch in batches:
        for begin in range(0, batch.num_rows, PACK):
            at, values = (c.to_pylist() for c in batch.slice(begin, PACK).columns)
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in Matrix(at, values).packed()], names=["sizes", "at", "vals"])


def train(docs: DataFrame, labels: DataFrame, max_positives: int = MAX_POSITIVES, chunk: int = CHUNK) -> np.ndarray:
    """Weights learned from rows outside the held-out fold. Without positives or documents all weights are zero."""
    spark = docs.sparkSession
    free = quality_labels(labels).where(~held_out(F.col("doc_id"), FOLDS) & (F.col("quality") == 1))
    sample = bounded(free, max_positives, "positive").withColumn("label", F.lit(1))
    # No more than training.MAX_BYTES before they are packed; the driver hands them on as they come.
    parts = [tuple(r) for r in sampled(sample, docs).select("at", "vals").mapInArrow(pack, "sizes binary, at binary, vals binary").collect()]
    if not parts:
        return np.zeros(SIZE + 1)
    shared = spark.sparkContext.broadcast(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        positives = Matrix.unpacked(shared.value)
        total = np.zeros(SIZE + 2)  # in the last place the number of documents

        def close(at: list[bytes], values: list[bytes]) -> None:
            nonlocal total
            n, own = len(at), Matrix(at, values)
            at.clear()
            values.clear()
            total += n * np.append(learn(positives, own)[0], 1.0)

        at, values, size = [], [], 0
        for batch in batches:
            for _, part in slices(batch.column(0).to_pylist()):
                for a, v in part.rows():
                    at.append(a.tobytes())
                    values.append(v.tobytes())
                    size += len(a)
                    if size >= chunk:
                        close(at, values)
                        size = 0
        if at:
            close(at, values)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["i", "w"])

    size = docs.select(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    texts = docs.where(~held_out(F.col("doc_id"), FOLDS)).select("text").coalesce(max(1, size // TASK_BYTES))
    w = weights_of(texts.mapInArrow(run, "i int, w double").groupBy("i").agg(F.sum("w").alias("w")), SIZE + 2)
    shared.destroy()
    return w[:-1] / max(1.0, w[-1])


def scorer(weights: np.ndarray, text: Column) -> Column:
    """The probability of label 1 of a text; null is empty."""
    weights = weights.astype(np.float64)

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            out = np.zeros(len(part))
            for at, piece in slices(part.tolist()):
                out[at : at + len(piece.dense)] = sigmoid(piece.sums(weights[:-1]) + weights[-1])
            yield pd.Series(out)

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "double")(text)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with held_out, score (0 to 1) and predicted (1 if score >= threshold) added, one row for each row.

    Null text is empty and scored like any other; a null doc_id is not held out. Other columns are kept; columns of
    the added names are replaced.
    """
    weights = train(docs, labels)
    scored = docs.withColumn("held_out", held_out(F.col("doc_id"), FOLDS)).withColumn("score", scorer(weights, F.col("text")))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
