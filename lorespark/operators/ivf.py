"""Approximate dense search: vectors are indexed under the nearest of a few centroids, and queries probe the nearest lists."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.sources.work import written

from .retrieval import BLOCK, block_topk, blocks

#: Rows that centroids are fitted on at most; every row is indexed.
SAMPLE = 20_000


def unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm > 0, norm, 1)


def centroids(vectors: DataFrame, lists: int, rounds: int = 10, sample: int = SAMPLE) -> np.ndarray:
    """Unit centroids by spherical k-means on the rows of smallest hashed id."""
    rows = vectors.orderBy(F.xxhash64("doc_id"), "doc_id").select("embedding").limit(sample).toPandas()["embedding"]
    x = unit(np.array(rows.tolist(), np.float64))
    c = x[np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int)]
    for _ in range(rounds):
        near = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(np.bincount(near, minlength=len(c))[:, None] > 0, unit(sums), c)
    return c


def assign(vectors: DataFrame, id_: str, c: np.ndarray, probes: int = 1) -> DataFrame:
    """(id, list, embedding), a row for each of the probes nearest lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = unit(np.array(batch.column(1).to_pylist(), np.float64))
                near = np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :probes]
                row = np.repeat(np.arange(len(x)), near.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(near.ravel(), pa.int32()), batch.column(1).take(pa.array(row))], names=[id_, "list", "embedding"])

    rows = vectors.select(F.col(id_).cast("long").alias(id_), "embedding").where(F.col("embedding").isNotNull())
    return rows.mapInArrow(run, f"{id_} long, list int, embedding array<float>")


def listed(assigned: DataFrame, id_: str, name: str, block: int = BLOCK) -> DataFrame:
    """The vectors of each list in blocks of their own; long lists have several."""
    sizes = assigned.groupBy("list").agg(F.ceil(F.count("*") / block).alias("_n"))  # a row for each list
    return blocks(assigned.join(F.broadcast(sizes), "list"), id_, name, F.col("_n"), "list")


def ivf_topk(queries: DataFrame, vectors: DataFrame, k: int, lists: int | None = None, probes: int | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank) among the lists that each query probes; a list's blocks are multiplied as in the exact search.

    Vectors without direction to group by need many probes for a recall of 0.9 (65 % of the lists, the default); give fewer where vectors have groups.
    """
    n = vectors.count()
    lists = lists or max(1, min(1024, int(math.sqrt(n))))
    probes = probes or max(1, math.ceil(lists * 0.65))
    c = centroids(vectors, lists)
    index = listed(written(assign(vectors, "doc_id", c), "lists"), "doc_id", "d")
    return block_topk(index.join(listed(written(assign(queries, "query_id", c, probes), "probes"), "query_id", "q"), "list"), k)
