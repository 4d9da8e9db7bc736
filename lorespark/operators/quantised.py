"""Dense search over codes: residual product quantisation, look-up tables, exact scores for the most promising few."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.functions.vectors import cosine
from lorespark.sources.log import LogTable, State

from .ivf import SAMPLE, centroids, unit
from .retrieval import QUERY_BYTES, top
from .segments import LISTED, among, fewest

#: Parts of a vector at most, entries of a part's book, rounds of fitting, and candidates for each wanted result.
PARTS, ENTRIES, ROUNDS, WIDER = 16, 256, 8, 10


def books_of(residuals: np.ndarray, parts: int, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """(part, entry, dimension): k-means on each part of what is left of the vectors beside their list's centroid."""
    n, dim = residuals.shape
    out = []
    for x in residuals.reshape(n, parts, dim // parts).transpose(1, 0, 2):
        c = x[np.linspace(0, n - 1, min(entries, n)).astype(int)]
        for _ in range(rounds):
            near = nearest(x, c)
            sums, counts = np.zeros_like(c), np.bincount(near, minlength=len(c))[:, None]
            np.add.at(sums, near, x)
            c = np.where(counts > 0, sums / np.maximum(counts, 1), c)
        out.append(c)
    return np.array(out)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(axis=1) - 2 * (x @ c.T), axis=1)


class CodedVectors:
    """Vectors kept with their list and a code of a byte for each part, in a table (list, code, key, embedding, more) with a commit log.

    Centroids and books are fitted once, on at most ``ivf.SAMPLE`` rows of the first batch, those of smallest hashed id; every vector is
    coded. A search reads lists, codes and keys, and the vectors themselves of WIDER candidates for each wanted result only.
    """

    def __init__(self, table: LogTable, key: str = "id"):
        self.table, self.key = table, key
        self.books = LogTable(table.spark, f"{table.path}-books")
        self._known: tuple[np.ndarray, np.ndarray] | None = None

    def create(self) -> None:
        self.books.create("kind string, centroids array<array<double>>, books array<array<array<double>>>")

    def _fitted(self, vectors: DataFrame | None = None) -> tuple[np.ndarray, np.ndarray] | None:
        if self._known is None:
            first = self.books.read().first()
            if not first and vectors is not None:
                rows = vectors.select(F.col(self.key).alias("doc_id"), "embedding").where("embedding IS NOT NULL")
                n = rows.count()
                if not n:
                    return None
                c = centroids(rows, max(1, min(1024, int(math.sqrt(n)))))
                sample = rows.orderBy(F.xxhash64("doc_id"), "doc_id").select("embedding").limit(SAMPLE).collect()
                x = unit(np.array([r[0] for r in sample], np.float64))
                parts = max(p for p in range(1, PARTS + 1) if x.shape[1] % p == 0)
                made = books_of(x - c[np.argmax(x @ c.T, axis=1)], parts)
                row = self.books.spark.createDataFrame([("pq", c.tolist(), made.tolist())], self.books.schema())
                self.books.insert_keyed(lambda old: row.join(old, "kind", "left_anti"), ["kind"], row.select("kind"))
                first = self.books.read().first()
            self._known = (np.array(first["centroids"]), np.array(first["books"])) if first else None
        return self._known

    def add(self, rows: DataFrame) -> DataFrame:
        """Append rows (key, embedding, more) with their lists and codes; rows without a vector are list -1."""
        fitted = self._fitted(rows)

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c, books = fitted or (None, None)
            for batch in batches:
                v = batch.column(batch.num_columns - 1)
                has = np.flatnonzero(v.is_valid().to_numpy(zero_copy_only=False))
                lists, codes = np.full(batch.num_rows, -1, np.int32), [None] * batch.num_rows
                if len(has):
                    x = unit(np.array(v.take(pa.array(has)).to_pylist(), np.float64))
                    lists[has] = np.argmax(x @ c.T, axis=1)
                    left = (x - c[lists[has]]).reshape(len(x), len(books), -1)
                    made = np.stack([nearest(left[:, p], books[p]) for p in range(len(books))], axis=1).astype(np.uint8)
                    for i, own in zip(has, made):
                        codes[i] = own.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(lists), pa.array(codes, pa.binary()), *batch.columns], names=["list", "code", *batch.schema.names])

        rows = rows.select(*[f.name for f in rows.schema if f.name not in ("embedding", "list", "code")], "embedding")
        schema = "list int, code binary, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        return self.table.append(rows.mapInArrow(code, schema).repartitionByRange("list", self.key), "list")

    def candidates(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame | None:
        """(query_id, doc_id): the k vectors that look nearest by their codes, in the lists that each query probes (all, by default)."""
        fitted = self._fitted()
        asked = queries.where("query_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("query_id").cast("long").alias("query_id"), "embedding")
        n = asked.count()
        if fitted is None or not n:
            return None
        c, books = fitted
        parts = -(-n * books.shape[0] * books.shape[1] * 8 // QUERY_BYTES)  # so many passes: a query's tables are sent
        now, found = self.table.state(), None
        for p in range(parts):
            part = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == p).orderBy("query_id").collect()  # bounded by QUERY_BYTES
            if part:
                ids, q = np.array([r[0] for r in part]), unit(np.array([r[1] for r in part], np.float64))
                hits = self._part(now, ids, q, c, books, k, min(probes or len(c), len(c)))
                found = hits if found is None else found.unionByName(hits)
        return top(found, k).select("query_id", "doc_id")

    def _part(self, now: State, ids: np.ndarray, q: np.ndarray, c: np.ndarray, books: np.ndarray, k: int, probes: int) -> DataFrame:
        to_lists = q @ c.T
        near = np.argsort(-to_lists, axis=1, kind="stable")[:, :probes]
        asks = np.zeros((len(c), len(q)), bool)
        asks[near.ravel(), np.repeat(np.arange(len(q)), near.shape[1])] = True
        lists = np.flatnonzero(asks.any(axis=1)).tolist()
        tables = np.einsum("qpd,ped->qpe", q.reshape(len(q), len(books), -1), books)
        sent = self.table.spark.sparkContext.broadcast((ids, to_lists, asks, tables))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, to_lists, asks, tables = sent.value
            best: list[tuple[np.ndarray, ...]] = []
            waiting = 0
            for batch in batches:
                own, keys = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
                codes = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(own), -1)
                for number in np.unique(own):
                    at, who = np.flatnonzero(own == number), np.flatnonzero(asks[number])
                    scores = np.repeat(to_lists[who, number][:, None], len(at), axis=1)
                    for p in range(codes.shape[1]):
                        scores += tables[who, p][:, codes[at, p]]
                    order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                    best.append((np.repeat(who, order.shape[1]), keys[at][order].ravel(), np.take_along_axis(scores, order, axis=1).ravel()))
                    waiting += order.size
                if waiting > 4 * k * len(ids):
                    best = [fewest(best, k)]
                    waiting = len(best[0][0])
            if best:
                query, doc, score = fewest(best, k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[query]), pa.array(doc), pa.array(score)], names=["query_id", "doc_id", "score"])

        rows = self.table.rows(now).select("list", F.col(self.key).cast("long"), "code").where((F.col("list") >= 0) & F.col(self.key).isNotNull())
        if len(lists) <= LISTED:
            rows = rows.where(among("list", lists))  # reaches the scan
        return rows.mapInArrow(run, "query_id long, doc_id long, score double")

    def search(self, queries: DataFrame, k: int, probes: int | None = None, wider: int = WIDER) -> DataFrame:
        """(query_id, doc_id, score, rank): the best k of wider x k candidates for each query (query_id, embedding), by their exact cosine."""
        some = self.candidates(queries, wider * k, probes)
        if some is None:
            return top(self.table.spark.createDataFrame([], "query_id long, doc_id long, score double"), k)
        vectors = self.table.read().select(F.col(self.key).cast("long").alias("doc_id"), "embedding")
        asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").alias("_asked"))
        both = some.join(vectors, "doc_id").join(asked, "query_id")
        return top(both.select("query_id", "doc_id", F.round(cosine(F.col("_asked"), F.col("embedding")), 6).alias("score")), k)
