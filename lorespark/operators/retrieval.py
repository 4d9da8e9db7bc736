"""Hybrid retrieval for many questions at once: dense and BM25 routes, rank fusion, eligibility, reranking, context.

Result frames are (query_id, doc_id, score) with more columns along the way; ties are always broken by doc_id.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorespark.functions.text import snippet
from lorespark.sources.work import written

K1, B = 1.2, 0.75
RRF_K = 60
ROUTE_TOP, FUSED_TOP, FINAL_TOP = 40, 20, 5
THRESHOLD = 0.3
#: Distinct terms of each query, counted over all queries, up to which they are broadcast.
MANY_TERMS = 200_000
#: Vectors of a block of the dense search.
BLOCK = 2048
#: Bytes of the queries' vectors up to which they are broadcast, and salts of each block of queries beyond.
QUERY_BYTES, SALTS = 64 << 20, 64


def top(df: DataFrame, k: int, by: str = "score", key: str = "query_id", tie: str = "doc_id") -> DataFrame:
    """The k best rows of each key, with rank from 1."""
    order = Window.partitionBy(key).orderBy(F.desc(by), tie)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def blocks(vectors: DataFrame, id_: str, name: str, n: Column, *by: str) -> DataFrame:
    """(by, name, name_ids, name_data): vectors packed as float32 in n blocks, numbered by name, those of each value of by apart."""

    def pack(table: pa.Table) -> pa.Table:
        data = np.array(table["v"].to_pylist(), "<f4")
        ids = np.array(table["i"].to_pylist(), "<i8")
        return pa.table({**{c: table[c][:1] for c in (*by, name)}, f"{name}_ids": pa.array([ids.tobytes()]), f"{name}_data": pa.array([data.tobytes()])})

    rows = vectors.select(*by, F.col(id_).cast("long").alias("i"), F.col("embedding").alias("v"), F.pmod(F.xxhash64(id_), n).cast("int").alias(name))
    rows = rows.where("i IS NOT NULL AND v IS NOT NULL")
    return rows.groupBy(*by, name).applyInArrow(pack, ", ".join([*(f"{c} int" for c in (*by, name)), f"{name}_ids binary", f"{name}_data binary"]))


def block_topk(pairs: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank): the k vectors nearest to each query by cosine, of pairs of blocks (q_ids, q_data, d_ids, d_data).

    Each pair is a numpy product that hands on its own k best only.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = [np.frombuffer(row[c], "<i8") for c in ("q_ids", "d_ids")]
                q, d = (np.frombuffer(row[c], "<f4").reshape(len(i), -1).astype(np.float64) for c, i in zip(("q_data", "d_data"), ids))
                q, d = (m / np.where((norm := np.linalg.norm(m, axis=1, keepdims=True)) > 0, norm, 1) for m in (q, d))
                scores = np.round(q @ d.T, 6)
                order = np.lexsort((np.broadcast_to(ids[1], scores.shape), -scores))[:, :k]
                best = np.take_along_axis(scores, order, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids[0], order.shape[1])), pa.array(ids[1][order].ravel()), pa.array(best.ravel())], names=["query_id", "doc_id", "score"]
                )

    return top(pairs.select("q_ids", "q_data", "d_ids", "d_data").mapInArrow(score, "query_id long, doc_id long, score double"), k)


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int = ROUTE_TOP, threshold: float | None = None, block: int = BLOCK) -> DataFrame:
    """(query_id, doc_id, score, rank): the k vectors nearest to each query (query_id, embedding) by cosine.

    vectors is (doc_id, embedding). Blocks of queries meet blocks of vectors. The threshold is applied after the k best were
    chosen. A zero vector is like nothing.
    """
    asked = queries.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    n = max(1, -(-asked["n"] // block))
    left = blocks(queries, "query_id", "q", F.lit(n))
    right = blocks(vectors, "doc_id", "d", F.lit(max(1, -(-vectors.count() // block)))).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    if 4 * asked["n"] * (asked["dim"] or 0) <= QUERY_BYTES:
        pairs = right.join(F.broadcast(left), "q")
    else:  # a block of queries is dealt to many tasks
        left = left.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        pairs = right.withColumn("salt", F.col("d") % SALTS).join(left, ["q", "salt"])
    found = block_topk(pairs, k)
    return found if threshold is None else found.where(F.col("score") >= threshold)


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits; runs of Han characters as pairs of neighbours."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    pair = lambda t: F.when(
        t.rlike(r"\p{IsHan}") & (F.length(t) > 1),
        F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2))),
    ).otherwise(F.array(t))
    return F.when(text.rlike(r"\p{IsHan}"), F.flatten(F.transform(words, pair))).otherwise(words)


def bm25_topk(queries: DataFrame, docs: DataFrame, k: int = ROUTE_TOP, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best documents (doc_id, text) for each query (query_id, text).

    One pass over the documents gives each one's length and how often it has the queries' own terms, by lookup in a broadcast
    table of them while it is bounded (``MANY_TERMS``), by a join beyond. Lengths and counts cover every document. With a bounded
    table a document's postings stay together, so that its scores need no shuffle of their own.
    """
    asked = written(queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")), "asked")
    terms = asked.select("term").distinct()
    few = asked.limit(MANY_TERMS + 1).count() <= MANY_TERMS
    parts = docs.select("doc_id", tokens(F.col("text")).alias("terms")).select("doc_id", F.size("terms").alias("dl"), F.explode_outer("terms").alias("term"))
    counted = parts.join(F.broadcast(terms.withColumn("_asked", F.lit(True))) if few else terms.withColumn("_asked", F.lit(True)), "term", "left")
    # Terms that nobody asks for are one entry of their document.
    counted = counted.groupBy("doc_id", "dl", F.when(F.col("_asked"), F.col("term")).alias("term")).agg(F.count("*").alias("tf"))
    postings = written(counted, "postings")
    sizes = postings.groupBy("doc_id").agg(F.max("dl").alias("dl"))
    # One row: the corpus size and mean length.
    stats = sizes.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    postings = postings.where("term IS NOT NULL")
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    wanted = asked.join(df, "term").join(F.broadcast(stats))
    wanted = wanted.select("query_id", "term", "avgdl", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    found = postings.repartition("doc_id").join(F.broadcast(wanted), "term") if few else postings.join(wanted, "term")
    weight = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = found.groupBy("query_id", "doc_id").agg(F.round(F.sum(weight), 4).alias("score"))
    return top(scored, k)


def fuse(*routes: DataFrame, k: int = FUSED_TOP, rrf_k: int = RRF_K, min_score: float = 0) -> DataFrame:
    """(query_id, doc_id, score, rank): reciprocal-rank fusion of routes (query_id, doc_id, rank)."""
    both = None
    for route in routes:
        part = route.select("query_id", "doc_id", (F.lit(1.0) / (rrf_k + F.col("rank"))).alias("part"))
        both = part if both is None else both.unionByName(part)
    fused = both.groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 10).alias("score"))
    return top(fused if min_score <= 0 else fused.where(F.col("score") >= min_score), k)


def hybrid(attempts: list[tuple[str, Callable[[int], DataFrame]]], k: int = FUSED_TOP) -> tuple[str, DataFrame]:
    """The name and the results of the first of the routes (name, function from k to results) that runs to its end.

    Each route is run and its results are written, so that failures in its tasks count too; k is what callers want, which
    the fused route gets from wider ones. The last route's failure is raised.
    """
    for name, attempt in attempts[:-1]:
        try:
            return name, written(attempt(k), "route")
        except (PySparkException, Py4JError, ConnectionError, TimeoutError) as e:
            logging.getLogger(__name__).warning("the %s route failed, the next one stands in: %s", name, str(e)[:200])
    name, attempt = attempts[-1]
    return name, written(attempt(k), "route")


def eligible_latest(found: DataFrame, documents: DataFrame, now: Column) -> DataFrame:
    """Results of documents that may be shown, each name's latest version among the query's own results only.

    documents is (doc_id, kb_id, file_name, version, status, expire_time). Late versions that a query didn't find
    hide nothing.
    """
    ok = F.col("status").isin(3, 5) & (F.col("expire_time").isNull() | (F.col("expire_time") >= now))
    joined = found.join(documents, "doc_id").where(ok)
    latest = F.max("version").over(Window.partitionBy("query_id", "kb_id", "file_name"))
    return joined.withColumn("_latest", latest).where("version = _latest").drop("_latest")


def overlap_score(question: Column, text: Column) -> Column:
    """A local stand-in for a reranking model: the share of the question's terms that the text has."""
    asked = F.array_distinct(tokens(question))
    return F.round(F.size(F.array_intersect(asked, tokens(text))) / F.greatest(F.size(asked), F.lit(1)), 6)


def with_texts(found: DataFrame, texts: DataFrame) -> DataFrame:
    """Results with the text (doc_id, text) that they are reranked by; one whose text is gone stays, with an empty one."""
    return found.join(texts.select("doc_id", "text"), "doc_id", "left").withColumn("text", F.coalesce("text", F.lit("")))


def rerank(found: DataFrame, score: Column, k: int = FINAL_TOP) -> DataFrame:
    """The k best results of each query by another score; a query with one result keeps it as it is."""
    many = F.count("*").over(Window.partitionBy("query_id"))
    scored = found.withColumn("_many", many).withColumn("rerank_score", F.when(F.col("_many") > 1, score).otherwise(F.col("score"))).drop("_many")
    return top(scored, k, by="rerank_score")


#: From a question and its passages to (number of the passage, score), best first.
Reranker = Callable[[str, list[str], int], list[tuple[int, float]]]


def rerank_by(found: DataFrame, model: Reranker, k: int = FINAL_TOP) -> DataFrame:
    """(query_id, doc_id, rank) of results (query_id, doc_id, rank, question, text) in the order that a model gives them.

    The model sees a query's results, which are as many as a route's k, in their order; missing text is empty. A query with one
    result isn't sent. Where the model fails or gives nothing, all results stay in their order.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["rank", "doc_id"])
        picked = []
        if len(rows) > 1:
            try:
                picked = [i for i, _ in model(rows["question"].iloc[0], rows["text"].fillna("").tolist(), k)]
            except Exception:  # whatever a service raises
                picked = []
        ids = rows["doc_id"].iloc[picked] if picked else rows["doc_id"]
        return pd.DataFrame({"query_id": rows["query_id"].iloc[0], "doc_id": ids.to_numpy(), "rank": np.arange(1, len(ids) + 1, dtype=np.int32)})

    return found.select("query_id", "doc_id", "rank", "question", "text").groupBy("query_id").applyInPandas(run, "query_id long, doc_id long, rank int")


def context(found: DataFrame) -> DataFrame:
    """(query_id, context, sources): numbered passages of results (query_id, rank, doc_id, file_name, page_no, text)."""
    mark = F.format_string("[来源%d] 文档：%s，第%d页\n%s\n\n", F.col("rank"), F.coalesce("file_name", F.lit("未知文档")), F.coalesce("page_no", F.lit(1)), "text")
    row = F.struct("rank", "doc_id", snippet(F.col("text")).alias("snippet"), mark.alias("passage"))
    rows = found.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    sources = F.transform("rows", lambda r: F.struct(r["rank"].alias("ref"), r["doc_id"].alias("doc_id"), r["snippet"].alias("snippet")))
    return rows.select("query_id", F.array_join("rows.passage", "").alias("context"), sources.alias("sources"))
