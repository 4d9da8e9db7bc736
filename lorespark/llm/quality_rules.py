"""Quality rules: text statistics with fixed limits, and a calibrated n-gram classifier with a fixed threshold.

The classifier is a logistic regression over hashed trigrams of characters, words, word pairs and text statistics, trained on
labelled rows. A quarter of its sample is set aside to calibrate its probability (a slope and an offset of the log
odds, folded into the weights). Texts are scored in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import SIZE, Matrix, adam, sigmoid, slices
from .training import bounded, fit, held_out, quality_labels

FOLDS = 5
MIN_WORDS = 10
#: Percent of words that may stand in repeated five-word windows.
MAX_REPEATED = 20
THRESHOLD = 0.5
#: The sample's bound for each label.
MAX_ROWS = 2500
STEPS = 120
RATE = 0.1
L2 = 1e-4


def logistic(x: Matrix, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    def gradient(w: np.ndarray) -> np.ndarray:
        r = weight * (sigmoid(x.dot(w[:-1]) + w[-1]) - y)
        return np.append(x.t_dot(r), r.sum()) + L2 * w

    return adam(gradient, STEPS, RATE)


def calibration(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps, with targets drawn in from 0 and 1 so that separable rows stay finite."""
    n1, n0 = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    ab = np.array([1.0, 0.0])
    design = np.stack([z, np.ones_like(z)], axis=1)
    for _ in range(50):
        p = sigmoid(design @ ab)
        g = design.T @ (weight * (p - t)) + 1e-6 * (ab - [1, 0])
        h = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-6 * np.eye(2)
        ab = ab - np.clip(np.linalg.solve(h, g), -1, 1)
    return (ab[0], ab[1]) if ab[0] > 0 else (1.0, 0.0)


def rule_fit(prior: float):
    def learn(label: np.ndarray, at: list[bytes], values: list[bytes]) -> np.ndarray:
        if len(set(label.tolist())) < 2:
            return np.zeros(SIZE + 1)
        apart = np.arange(len(label)) % 4 == 0
        weight = np.where(label == 1, prior / max(1, label.sum()), (1 - prior) / max(1, (1 - label).sum()))
        pick = lambda which: Matrix([at[i] for i in np.flatnonzero(which)], [values[i] for i in np.flatnonzero(which)])
        w = logistic(pick(~apart), label[~apart], weight[~apart] / weight[~apart].sum())
        z = pick(apart).dot(w[:-1]) + w[-1]
        a, b = calibration(z, label[apart], weight[apart] / weight[apart].sum())
        return np.append(a * w[:-1], a * w[-1] + b)

    return learn


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> np.ndarray:
    """Weights from labelled rows outside the held-out fold; all zero (probability one half) without both labels."""
    free = quality_labels(labels).where(~held_out(F.col("doc_id"), FOLDS))
    prior = free.agg(F.avg("quality")).first()[0]
    if prior is None:
        return np.zeros(SIZE + 1)
    each = [bounded(free.where(F.col("quality") == q).select("doc_id"), max_rows, f"label {q}").withColumn("label", F.lit(q)) for q in (0, 1)]
    return fit(each[0].union(each[1]), docs, rule_fit(min(max(prior, 0.01), 0.99)))


STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score) for each row.

    Null text has no words and fails. A text fails the limits with under MIN_WORDS words or over MAX_REPEATED percent
    of them in five-word windows that the text repeats; the others are kept if their probability of quality reaches
    the threshold. Repeated or null doc_ids are rows of their own. Other columns are not carried.
    """
    weights = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in STATS]
            score = [np.empty(0)]
            for _, part in slices(batch.column(1).to_pylist()):
                for values, name in zip(columns, STATS):
                    values.append(part.stats[name])
                score.append(sigmoid(part.sums(weights[:-1]) + weights[-1]))
            arrays = [pa.array(np.concatenate(v), pa.int64()) for v in columns]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays, pa.array(np.concatenate(score), pa.float64())], names=["doc_id", *STATS, "score"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = texts.mapInArrow(run, f"doc_id long, {', '.join(f'{s} long' for s in STATS)}, score double")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    found = found.withColumn("base_failed", failed)
    return found.select("doc_id", *STATS, "base_failed", (~F.col("base_failed") & (F.col("score") >= threshold)).alias("kept"), "score")
