"""Indexes that are kept: postings in segments for BM25, vectors by nearest centroid for dense search.

Each batch of documents adds a segment at ingest; segments of one tier are merged into one of the next. A search reads the
segments of the moment. Both are tables with a commit log, so ingests, merges, deletes and searches may go on at once.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.sources.log import Change, LogTable, State
from lorespark.sources.work import tidied, written

from .ivf import centroids, unit
from .postings import WORDS, inverted, joined, scored, thinned
from .retrieval import K1, MANY_TERMS, QUERY_BYTES, ROUTE_TOP, B, tokens, top

#: Documents of a cell, which is scored or skipped as one; cells of a block (about), whose postings of a term are one row; segments of a tier that are merged.
CELL, BLOCK, FAN = 128, 32, 4
#: Values of a filter that is handed to the scan as a list.
LISTED = 2000
#: What scores are rounded by, twice.
SLACK = 1e-4


def among(column: str, values: list) -> Column:
    """Whether a column has one of the values: as ``isin``, in one call to Spark instead of one for each value."""
    if not values:
        return F.lit(False)
    quote = lambda v: "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(v, str) else str(v)
    return F.expr(f"{column} IN ({', '.join(map(quote, values))})")


class TextIndex:
    """BM25 postings. A row has a term's postings in a block of documents of a segment; a block is BLOCK cells, and has a row of its documents too (``postings``)."""

    SCHEMA = "term string, segment string, block int, n long, words long, docs array<int>, tfs array<int>, ids array<long>"
    ROWS = "term string, block int, n long, words long, docs array<int>, tfs array<int>, ids array<long>"

    def __init__(self, spark: SparkSession, path: str):
        self.table = LogTable(spark, path)

    def create(self) -> None:
        self.table.create(self.SCHEMA)

    def _segment(self, rows: DataFrame, tier: int) -> tuple[Change, int, int]:
        """A change that adds rows as a segment, with its documents and their words. A task's rows are one block, in the order of terms."""
        segment = uuid.uuid4().hex
        with tidied(self.table.spark):
            change = self.table.write(rows.withColumn("segment", F.lit(segment)), segment=segment, tier=tier, docs=0)
        if not change.add:
            return change, 0, 0
        (folder, facts), *_ = change.parts.items()
        written_rows = self.table.spark.read.schema(self.SCHEMA).parquet(f"{self.table.path}/{folder}")
        sizes = written_rows.where("term = ''").agg(F.sum("n").alias("docs"), F.sum("words").alias("words")).first()
        facts["docs"] = sizes["docs"]
        return change, sizes["docs"], sizes["words"]

    def add(self, docs: DataFrame) -> None:
        """Add documents (doc_id, text) as a segment. doc_ids must be new; ``remove`` old ones first.

        Documents are dealt into blocks by a hash of their ids, a block to a task. Only their texts are shuffled: postings are made where they are written.
        """
        n = docs.count()
        if not n:
            return
        blocks = max(math.ceil(n / (BLOCK * CELL)), min(math.ceil(n / CELL), self.table.spark.sparkContext.defaultParallelism))
        dealt = docs.select(F.pmod(F.xxhash64("doc_id", F.lit("block")), F.lit(blocks)).cast("int").alias("block"), F.col("doc_id").cast("long").alias("doc_id"), "text")
        words = dealt.repartitionById(blocks, F.col("block")).select("block", "doc_id", tokens(F.coalesce("text", F.lit(""))).alias("terms"))
        change, found, total = self._segment(words.mapInArrow(inverted(blocks), self.ROWS), 0)
        if found:
            change.sums = {"docs": found, "words": total}
            self.table.transact(lambda now: change, "append")

    def remove(self, ids: DataFrame) -> None:
        """Take documents (doc_id) out: the rows that hold them are written anew without them. Others' ids change nothing."""
        ids = written(ids.select(F.col("doc_id").cast("long")).where("doc_id IS NOT NULL").distinct(), "removed")

        def work(now: State) -> Change | None:
            rows = self.table.places(now)
            gone = rows.where("term = ''").select("segment", "block", F.explode("ids").alias("doc_id")).join(ids, "doc_id")
            gone = written(gone, "gone")
            own = rows.join(F.broadcast(gone.select("segment", "block").distinct()), ["segment", "block"], "left_semi")
            own = own.select("_file", "_pos", "term", "segment", "block", "n", "words", "docs", "tfs", "ids")
            hits = own.groupBy("segment", "block").cogroup(gone.groupBy("segment", "block")).applyInArrow(thinned, f"_file string, _pos long, {self.SCHEMA}, out long, out_words long")
            with tidied(self.table.spark):
                hits = written(hits, "hits")
            change = self.table.gone(hits.select("_file", "_pos"), now)
            if not change.gone:
                return None
            lost = hits.where("term = ''").agg(F.sum("out").alias("docs"), F.sum("out_words").alias("words")).first()
            kept = hits.where(F.size("docs") > 0)
            # Rows keep their segments, each in a folder of its own.
            for segment, part in {p["segment"]: p for p in now.parts.values()}.items():
                rows = self.table.write(kept.where(F.col("segment") == segment), "block", "term", **part)
                change.add |= rows.add
                change.parts |= rows.parts
            change.sums = {"docs": -lost["docs"], "words": -lost["words"]}
            return change

        self.table.transact(work, "remove")

    def _together(self, rows: DataFrame) -> list[tuple[str, int, int, int]]:
        """(segment, block, its block in a merged segment, where its documents start there): as many blocks together as one may hold. From a row for each block."""
        heads = rows.where("term = ''").select("segment", "block", "n", "words", F.array_max("docs") + 1).orderBy("segment", "block").collect()
        made, number, start, docs, words = [], -1, 0, math.inf, math.inf
        for segment, block, n, m, size in heads:
            if docs + n > BLOCK * CELL or words + m > WORDS:
                number, start, docs, words = number + 1, 0, 0, 0
            made.append((segment, block, number, start))
            start, docs, words = start + size, docs + n, words + m
        return made

    def merge(self, fan: int = FAN) -> int:
        """Merge the segments of each tier that has fan of them, and of the tiers above as they fill up. Returns how many merges there were.

        Small blocks are put together; the files of the segments that were merged stay for those who read them.
        """
        done = 0
        while True:
            by_tier: dict[int, set[str]] = {}
            for part in self.table.state().parts.values():
                by_tier.setdefault(part["tier"], set()).add(part["segment"])
            full = min((t for t, own in by_tier.items() if len(own) >= fan), default=None)
            if full is None:
                return done

            def work(now: State, own=by_tier[full], tier=full + 1) -> Change | None:
                files = [n for n, f in now.files.items() if now.parts[f["dir"]]["segment"] in own]
                if not files:
                    return None
                rows = self.table.rows(now, files)
                to = self._together(rows)
                blocks = to[-1][2] + 1 if to else 1
                to = self.table.spark.createDataFrame(to, "segment string, old int, block int, start int")
                rows = rows.withColumnRenamed("block", "old").join(F.broadcast(to), ["segment", "old"]).select("term", "block", "start", "n", "words", "docs", "tfs", "ids")
                rows = rows.repartitionById(blocks, F.col("block")).sortWithinPartitions("term", "start")
                change, _, _ = self._segment(rows.mapInArrow(joined, self.ROWS), tier)
                return Change(change.add, files, parts=change.parts, reads=set(files), writes=set(files))

            self.table.transact(work, "merge")
            done += 1

    def _asked(self, queries: DataFrame) -> tuple[DataFrame, DataFrame, float]:
        """The rows of asked terms and of documents; (query_id, term, idf); and the mean length."""
        spark, now = self.table.spark, self.table.state()
        docs, words = now.sums.get("docs", 0), now.sums.get("words", 0)
        asked = written(queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")), "asked")
        terms = asked.select("term").distinct()
        some = [r[0] for r in terms.limit(LISTED + 1).collect()]
        rows = self.table.rows(now).select("term", "segment", "block", "n", "docs", "tfs", "ids")
        if len(some) <= LISTED:
            rows = rows.where(among("term", ["", *some]))  # reaches the scan, whose files are sorted by term
        else:
            few = terms.limit(MANY_TERMS + 1).count() <= MANY_TERMS
            terms = terms.unionByName(spark.createDataFrame([("",)], "term string"))
            rows = rows.join(F.broadcast(terms) if few else terms, "term", "left_semi")
        with tidied(spark):
            rows = written(rows, "rows")
            df = rows.where("term <> ''").groupBy("term").agg(F.sum("n").alias("df"))
            wanted = asked.join(df, "term").select("query_id", "term", F.log(1 + (docs - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
            return rows, written(wanted, "wanted"), words / docs if docs and words else 1.0

    def _score(self, what: str, asked: tuple[DataFrame, DataFrame, float], k: int, k1: float, b: float, least: DataFrame | None = None) -> DataFrame:
        """``postings.scored`` of each block: every row goes there once, with those who ask for its term, their weights and the least score they look for."""
        rows, wanted, mean = asked
        few = wanted.limit(MANY_TERMS + 1).count() <= MANY_TERMS
        if least is None:
            wanted = wanted.withColumn("least", F.lit(None).cast("double"))
        else:
            least = least.select(F.col("query_id").alias("_query"), F.col("score").alias("least"))
            wanted = wanted.join(least, F.col("query_id").eqNullSafe(F.col("_query")), "left")
        askers = wanted.groupBy("term").agg(F.collect_list(F.struct("query_id", "idf", "least")).alias("askers"))
        rows = rows.join(F.broadcast(askers) if few else askers, "term", "left").select("segment", "block", "term", "docs", "tfs", "ids", "askers")
        query = f"query_id {wanted.schema['query_id'].dataType.simpleString()}, "
        schema = query + ("segment string, block int, cell int, bound double, alive boolean" if what == "cells" else "doc_id long, score double")
        return rows.groupBy("segment", "block").applyInArrow(scored(what, k, mean, k1, b, CELL, SLACK), schema)

    def _floor(self, asked: tuple[DataFrame, DataFrame, float], k: int, k1: float, b: float) -> DataFrame:
        """(query_id, score): the k-th best score in the k cells that promise most, for queries that have so many. The k best reach it."""

        def kth(what: str, least: DataFrame | None) -> DataFrame:
            with tidied(self.table.spark):
                return written(top(self._score(what, asked, k, k1, b, least), k).where(F.col("rank") == k).select("query_id", "score"), what)

        return kth("scores", kth("bounds", None))

    def search(self, queries: DataFrame, k: int = ROUTE_TOP, k1: float = K1, b: float = B) -> DataFrame:
        """(query_id, doc_id, score, rank): the k best documents for each query (query_id, text), as by ``bm25_topk`` over all documents of the index.

        The k cells that promise most are scored first. Their k-th score is one that the k best reach, and cells whose bound is below
        it are skipped: a document's score is at most the sum of the asked terms' largest weights in its cell. A block hands on its k best.
        """
        asked = self._asked(queries)
        return top(self._score("scores", asked, k, k1, b, self._floor(asked, k, k1, b)), k)

    def cells(self, queries: DataFrame, k: int = ROUTE_TOP) -> DataFrame:
        """(query_id, segment, block, cell, bound, alive): which cells a search scores."""
        asked = self._asked(queries)
        return self._score("cells", asked, k, K1, B, self._floor(asked, k, K1, B))


class VectorIndex:
    """Vectors in a table with a ``list`` column, the number of the nearest of a few centroids, by which its files are sorted.

    Centroids are fitted once, on a bounded sample of the first batch (``ivf.SAMPLE``); every vector is indexed. Deletes in the
    table need nothing of the index.
    """

    def __init__(self, table: LogTable, key: str = "id"):
        self.table, self.key = table, key
        self.books = LogTable(table.spark, f"{table.path}-centroids")
        self._known: np.ndarray | None = None

    def create(self) -> None:
        self.books.create("kind string, centroids array<array<double>>")

    def _centroids(self, vectors: DataFrame | None = None, lists: int | None = None) -> np.ndarray | None:
        if self._known is None:
            first = self.books.read().first()
            if not first and vectors is not None:
                rows = vectors.select(F.col(self.key).alias("doc_id"), "embedding").where("embedding IS NOT NULL")
                n = rows.count()
                if not n:
                    return None
                made = centroids(rows, lists or max(1, min(1024, int(math.sqrt(n)))))
                kind = self.books.spark.createDataFrame([("cosine",)], "kind string")
                row = self.books.spark.createDataFrame([("cosine", made.tolist())], self.books.schema())
                self.books.insert_keyed(lambda old: row.join(old, "kind", "left_anti"), ["kind"], kind)
                first = self.books.read().first()
            self._known = np.array(first["centroids"]) if first else None
        return self._known

    def add(self, rows: DataFrame, lists: int | None = None) -> DataFrame:
        """Append rows (key, embedding, more) under their lists; rows without a vector are list -1."""
        c = self._centroids(rows, lists)

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = batch.column(batch.num_columns - 1)
                has = np.flatnonzero(v.is_valid().to_numpy(zero_copy_only=False))
                near = np.full(batch.num_rows, -1, np.int32)
                if len(has):
                    near[has] = np.argmax(unit(np.array(v.take(pa.array(has)).to_pylist(), np.float64)) @ c.T, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(near), *batch.columns], names=["list", *batch.schema.names])

        rows = rows.select(*[f.name for f in rows.schema if f.name not in ("embedding", "list")], "embedding")
        schema = "list int, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        return self.table.append(rows.mapInArrow(nearest, schema).repartitionByRange("list", self.key), "list")

    def search(self, queries: DataFrame, k: int, probes: int | None = None, threshold: float | None = None) -> DataFrame:
        """(query_id, doc_id, score, rank): the k vectors nearest to each query (query_id, embedding) by cosine, in the lists it probes (all, by default).

        Queries come in parts of bounded size, which are broadcast; each task keeps the k best of its vectors for each query,
        whatever the number of its batches.
        """
        c = self._centroids()
        spark, empty = self.table.spark, "query_id long, doc_id long, score double"
        asked = queries.where("query_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("query_id").cast("long").alias("query_id"), "embedding")
        size = asked.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim")).first()
        if c is None or not size["n"]:
            return top(spark.createDataFrame([], empty), k)
        parts = -(-size["n"] * size["dim"] * 8 // QUERY_BYTES)
        now, found = self.table.state(), None
        for p in range(parts):
            part = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == p).orderBy("query_id").collect()  # bounded by QUERY_BYTES
            if part:
                hits = self._part(now, np.array([r[0] for r in part]), unit(np.array([r[1] for r in part], np.float64)), c, k, min(probes or len(c), len(c)))
                found = hits if found is None else found.unionByName(hits)
        best = top(found, k)
        return best if threshold is None else best.where(F.col("score") >= threshold)

    def _part(self, now: State, ids: np.ndarray, q: np.ndarray, c: np.ndarray, k: int, probes: int) -> DataFrame:
        near = np.argsort(-(q @ c.T), axis=1, kind="stable")[:, :probes]
        asks = np.zeros((len(c), len(q)), bool)
        asks[near.ravel(), np.repeat(np.arange(len(q)), near.shape[1])] = True
        lists = np.flatnonzero(asks.any(axis=1)).tolist()
        sent = self.table.spark.sparkContext.broadcast((ids, q, asks))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q, asks = sent.value
            best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # query, vector, score
            waiting = 0
            for batch in batches:
                own, keys = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
                x = unit(np.array(batch.column(2).to_pylist(), np.float64))
                for number in np.unique(own):
                    at, who = np.flatnonzero(own == number), np.flatnonzero(asks[number])
                    scores = np.round(q[who] @ x[at].T, 6)
                    order = np.lexsort((np.broadcast_to(keys[at], scores.shape), -scores))[:, :k]
                    best.append((np.repeat(who, order.shape[1]), keys[at][order].ravel(), np.take_along_axis(scores, order, axis=1).ravel()))
                    waiting += order.size
                if waiting > 4 * k * len(q):
                    best = [fewest(best, k)]
                    waiting = len(best[0][0])
            if best:
                query, doc, score = fewest(best, k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[query]), pa.array(doc), pa.array(score)], names=["query_id", "doc_id", "score"])

        rows = self.table.rows(now).select("list", F.col(self.key).cast("long"), "embedding").where((F.col("list") >= 0) & F.col(self.key).isNotNull())
        if len(lists) <= LISTED:
            rows = rows.where(among("list", lists))  # reaches the scan
        return rows.mapInArrow(run, "query_id long, doc_id long, score double")


def fewest(parts: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    """The k best of each query, of equal scores the smaller ids."""
    query, doc, score = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((doc, -score, query))
    query, doc, score = query[order], doc[order], score[order]
    first = np.searchsorted(query, query)
    keep = np.arange(len(query)) - first < k
    return query[keep], doc[keep], score[keep]
