"""Samples of labelled rows with their features, and the fit of a small linear model on them in one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .features import SIZE, featurize

#: Bytes of features that a sample holds at most.
MAX_BYTES = 64 << 20


def held_out(doc_id: Column, folds: int, fold: int = 0) -> Column:
    """Whether crc32 of the id as text falls in the fold; false for a null id."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % folds == fold, F.lit(False))


def quality_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, quality): 1 only if every row of the document says so; null ids and labels don't count."""
    rows = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
    return rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))


def bounded(ids: DataFrame, limit: int, salt: str) -> DataFrame:
    """At most limit of the distinct ids, the same ones each time: those whose salted hash is smallest."""
    return ids.select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(salt)), "doc_id").limit(limit)


def sampled(sample: DataFrame, docs: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(key, label, at, vals) in one partition: the features of sample (doc_id, label), a bounded number of distinct ids.

    Of rows that share an id the smallest text counts, so repeated rows add nothing. Documents come by a hash of
    the id until their features fill max_bytes.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # The sample's size is a parameter of its callers.
    rows = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    made = rows.select(F.col("doc_id").alias("key"), F.col("label").cast("int").alias("label"), "text")
    made = made.mapInArrow(featurize, "key long, label int, at binary, vals binary")
    size = F.sum(F.octet_length("at") + F.octet_length("vals")).over(Window.orderBy(F.xxhash64("key"), "key"))
    return made.withColumn("_size", size).where(F.col("_size") <= max_bytes).drop("_size")


def weights_of(found: DataFrame, size: int = SIZE + 1) -> np.ndarray:
    """size numbers: w at i for each row of (i, w), zero for the others."""
    found = found.toPandas()
    w = np.zeros(size)
    w[found["i"]] = found["w"]
    return w


def fit(sample: DataFrame, docs: DataFrame, learn: Callable[[np.ndarray, list[bytes], list[bytes]], np.ndarray]) -> np.ndarray:
    """Weights that learn(labels, at, vals) finds; sample is (doc_id, label) of a bounded number of distinct ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))]
        w = np.zeros(SIZE + 1)
        if rows:
            _, label, at, values = zip(*rows)
            w = learn(np.array(label), list(at), list(values))
        some = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(w[some], pa.float64())], names=["i", "w"])

    return weights_of(sampled(sample, docs).mapInArrow(run, "i int, w double"))
