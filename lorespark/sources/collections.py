"""Vector collections of knowledge bases: a table and its two indexes, made once, kept with every change and dropped together."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.operators.segments import TextIndex, VectorIndex

from .files import Storage
from .log import LogTable
from .tables import SCHEMAS
from .work import written

#: The dense index (inverted lists by cosine) and the sparse one (BM25 over the text).
INDEXES = {"embedding": {"kind": "ivf", "metric": "cosine"}, "text": {"kind": "bm25", "k1": 1.2, "b": 0.75}}


class Collections:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.ready: set[int] = set()

    def table(self, kb_id: int) -> LogTable:
        return LogTable(self.spark, f"{self.root}/kb_{kb_id}")

    def text_index(self, kb_id: int) -> TextIndex:
        return TextIndex(self.spark, f"{self.root}/kb_{kb_id}-text")

    def vector_index(self, kb_id: int) -> VectorIndex:
        return VectorIndex(self.table(kb_id))

    def create(self, kb_id: int, indexes: dict | None = None) -> None:
        """An empty table with its indexes and their definitions, unless there is one."""
        if not self.table(kb_id).exists():
            Storage(self.spark, self.root).put(f"kb_{kb_id}.json", json.dumps(indexes or INDEXES).encode())
            self.text_index(kb_id).create()
            self.vector_index(kb_id).create()
            self.table(kb_id).create("list int, " + SCHEMAS["chunk_vector"])  # last: what exists is whole
        self.ready.add(kb_id)

    def ensure_ready(self, kb_id: int) -> LogTable:
        """The collection's table; an error if there is none. What was found once is not looked up again."""
        if kb_id not in self.ready:
            if not self.table(kb_id).exists():
                raise LookupError(f"knowledge base {kb_id} has no vector collection; create the knowledge base first")
            self.ready.add(kb_id)
        return self.table(kb_id)

    def indexes(self, kb_id: int) -> dict:
        self.ensure_ready(kb_id)
        return json.loads(Storage(self.spark, self.root).get(f"kb_{kb_id}.json"))

    def read(self, kb_id: int) -> DataFrame:
        return self.ensure_ready(kb_id).read().drop("list")

    def insert(self, kb_id: int, rows: DataFrame) -> None:
        """Put chunk vectors in by id: rows with an id that is there take its place. Both indexes have them when this returns."""
        table = self.ensure_ready(kb_id)
        rows = written(rows, "rows")
        if table.state().files:
            self.delete(kb_id, keys=rows.select("id"))
        self.vector_index(kb_id).add(rows)
        self.text_index(kb_id).add(rows.select(F.col("id").alias("doc_id"), "text"))
        self.text_index(kb_id).merge()

    def delete(self, kb_id: int, where: Column | None = None, keys: DataFrame | None = None) -> int:
        """Take out chunk vectors that fit the condition and have their key in keys, from the table and both indexes. Returns how many went."""
        table = self.ensure_ready(kb_id)
        hits = table.read() if where is None else table.read().where(where)
        ids = written((hits if keys is None else hits.join(keys, keys.columns, "left_semi")).select("id").distinct(), "ids")
        self.text_index(kb_id).remove(ids.toDF("doc_id"))
        return table.delete(keys=ids)

    def search_text(self, kb_id: int, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, doc_id, score, rank) of queries (query_id, text) by BM25; doc_id is the chunk vector's id."""
        self.ensure_ready(kb_id)
        return self.text_index(kb_id).search(queries, k)

    def search_dense(self, kb_id: int, queries: DataFrame, k: int, probes: int | None = None, threshold: float | None = None) -> DataFrame:
        """(query_id, doc_id, score, rank) of queries (query_id, embedding) by cosine; doc_id is the chunk vector's id."""
        self.ensure_ready(kb_id)
        return self.vector_index(kb_id).search(queries, k, probes, threshold)

    def drop(self, kb_id: int) -> None:
        """No collection, whether there was one or not."""
        self.table(kb_id).drop()
        self.text_index(kb_id).table.drop()
        self.vector_index(kb_id).books.drop()
        self.ready.discard(kb_id)
