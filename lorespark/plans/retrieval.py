"""Queries over retrieval: questions are the benchmark's texts, whose dense vector is the embedding of the same id."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from lorespark.functions.text import citations, renumber, snippet
from lorespark.operators import ivf
from lorespark.operators import retrieval as R
from lorespark.sources.work import spread

from . import standins as S

QUERIES, ORACLES = {}, {}

_SIM = "round(list_dot_product(q.e, d.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(d.e, d.e))), 6)"


def dense_sql(queries: str, k: int) -> str:
    return f"""SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM
    (SELECT q.id AS query_id, d.id AS doc_id, {_SIM} AS score FROM ({queries}) q, (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings) d)
    QUALIFY rank <= {k}"""


_TOKENS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')"
BM25_SQL = f"""asked AS (SELECT DISTINCT item_id AS query_id, unnest({_TOKENS}) AS term FROM benchmark),
parts AS (SELECT doc_id, {_TOKENS} AS terms FROM documents),
stats AS (SELECT count(*) AS n, avg(len(terms)) AS avgdl FROM parts),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(terms) AS dl, unnest(terms) AS term FROM parts) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
scored AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {R.K1 + 1} / (tf + {R.K1} * (1 - {R.B} + {R.B} * dl / avgdl))), 4) AS score
    FROM asked JOIN tf USING (term) JOIN df USING (term), stats GROUP BY ALL),
bm25 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM scored QUALIFY rank <= 40)"""
_ITEMS = "SELECT item_id AS id, embedding::DOUBLE[] AS e FROM benchmark JOIN embeddings ON vec_id = item_id"
FUSED_SQL = f"""{BM25_SQL}, dense AS ({dense_sql(_ITEMS, 40)}),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM
    (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 10) AS score FROM (SELECT query_id, doc_id, rank FROM bm25 UNION ALL SELECT query_id, doc_id, rank FROM dense) GROUP BY ALL) QUALIFY rank <= 20)"""
ELIGIBLE_SQL = f"""{FUSED_SQL}, documents_ AS ({S.SQL["documents_"]}),
ok AS (SELECT query_id, doc_id, score, rank, kb_id, file_name, version, max(version) OVER (PARTITION BY query_id, kb_id, file_name) AS latest FROM fused JOIN documents_ ON id = doc_id
    WHERE status IN (3, 5) AND (expire_time IS NULL OR expire_time >= TIMESTAMP '2024-01-05'))"""


def questions(spark, sf_dir):
    return S.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def vectors(spark, sf_dir):
    return S.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


def dense_cosine_topk(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    asked = rows.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id")
    return R.dense_topk(asked, rows, 20, R.THRESHOLD)


def ivf_topk(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return ivf.ivf_topk(rows.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id"), rows, 20)


def bm25_topk(spark, sf_dir):
    return R.bm25_topk(questions(spark, sf_dir), spread(S.read(spark, sf_dir, "documents").select("doc_id", "text")))


def _fused(spark, sf_dir):
    asked = questions(spark, sf_dir).join(vectors(spark, sf_dir).withColumnRenamed("doc_id", "query_id"), "query_id")
    return R.fuse(bm25_topk(spark, sf_dir), R.dense_topk(asked.select("query_id", "embedding"), vectors(spark, sf_dir)))


def rrf_hybrid_topk(spark, sf_dir):
    return _fused(spark, sf_dir)


def _eligible(spark, sf_dir):
    docs = S.documents(spark, sf_dir).withColumnRenamed("id", "doc_id").drop("text")
    return R.eligible_latest(_fused(spark, sf_dir), docs, F.lit("2024-01-05").cast("timestamp_ntz"))


def eligible_latest_results(spark, sf_dir):
    return _eligible(spark, sf_dir).select("query_id", "doc_id", "score", "rank", "kb_id", "file_name", "version")


def _reranked(spark, sf_dir):
    found = R.with_texts(_eligible(spark, sf_dir), S.read(spark, sf_dir, "documents"))
    found = found.join(questions(spark, sf_dir).withColumnRenamed("text", "question"), "query_id")
    return R.rerank(found, R.overlap_score(F.col("question"), F.col("text")))


def reranked_snippets(spark, sf_dir):
    return _reranked(spark, sf_dir).select("query_id", "doc_id", "rerank_score", "rank", snippet(F.col("text")).alias("snippet"))


def reranked_without_texts(spark, sf_dir):
    """Results of which the texts of every third document are gone."""
    texts = S.read(spark, sf_dir, "documents").where("doc_id % 3 <> 1")
    found = R.with_texts(_eligible(spark, sf_dir), texts).join(questions(spark, sf_dir).withColumnRenamed("text", "question"), "query_id")
    return R.rerank(found, R.overlap_score(F.col("question"), F.col("text"))).select("query_id", "doc_id", "rerank_score", "rank", F.length("text").alias("n_chars"))


def answer_contexts(spark, sf_dir):
    found = _reranked(spark, sf_dir).withColumn("page_no", F.lit(None).cast("int"))
    made = R.context(found.select("query_id", "rank", "doc_id", "file_name", "page_no", "text"))
    return made.select("query_id", F.sha2("context", 256).alias("context_sha256"), F.size("sources").alias("n_sources"))


def cited_answers(spark, sf_dir):
    """An extractive answer that cites every other source, renumbered, with the sources that stay."""
    made = R.context(_reranked(spark, sf_dir).select("query_id", "rank", "doc_id", "file_name", F.lit(1).alias("page_no"), "text"))
    used = F.filter("sources", lambda s: s["ref"] % 2 == 0)
    answer = F.array_join(F.transform(used, lambda s: F.concat(s["snippet"], F.lit("[来源"), s["ref"].cast("string"), F.lit("]"))), "\n")
    made = made.withColumn("answer", answer).withColumn("cited", citations(F.col("answer"), F.size("sources")))
    kept = F.transform(F.filter("sources", lambda s: F.array_contains("cited", s["ref"])), lambda s: s["doc_id"].cast("string"))
    return made.select("query_id", renumber(F.col("answer"), F.col("cited")).alias("answer"), F.array_join(kept, ",").alias("doc_ids"))


def threshold_fallback(spark, sf_dir):
    """The hybrid route, whose embedding service fails while it runs, else BM25 with as many results as were wanted, else the dense one."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        raise ConnectionError("the embedding service is away")

    def fused(k):
        asked = questions(spark, sf_dir).select("query_id", embed("text").alias("embedding"))
        return R.fuse(bm25_topk(spark, sf_dir), R.dense_topk(asked, vectors(spark, sf_dir)), k=k)

    documents = spread(S.read(spark, sf_dir, "documents").select("doc_id", "text"))
    return R.hybrid([("hybrid", fused), ("bm25", lambda k: R.bm25_topk(questions(spark, sf_dir), documents, k)), ("dense", lambda k: dense_cosine_topk(spark, sf_dir))])[1]


def reranked_by_model(spark, sf_dir):
    """A model that answers for some questions, fails for others and gives nothing for the rest."""

    def model(question, texts, k):
        if len(question) % 3 == 0:
            raise TimeoutError
        order = sorted(range(len(texts)), key=lambda i: (-len(texts[i]), i))
        return [(i, float(len(texts[i]))) for i in order[:k]] if len(question) % 3 == 1 else []

    found = R.with_texts(_eligible(spark, sf_dir).select("query_id", "doc_id", "rank"), S.read(spark, sf_dir, "documents"))
    return R.rerank_by(found.join(questions(spark, sf_dir).withColumnRenamed("text", "question"), "query_id"), model)


_FINAL = f"""{ELIGIBLE_SQL}, found AS (SELECT query_id, doc_id, score, d.text, file_name, list_distinct({_TOKENS.replace("text", "b.text")}) AS asked,
    {_TOKENS.replace("text", "d.text")} AS terms FROM ok JOIN documents d USING (doc_id) JOIN benchmark b ON item_id = query_id WHERE version = latest),
re AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY query_id) > 1 THEN round(len(list_intersect(asked, terms)) / greatest(len(asked), 1), 6) ELSE score END AS rerank_score FROM found),
final AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, doc_id)::INT AS rank FROM re QUALIFY rank <= 5),
short AS (SELECT *, CASE WHEN length(text) > 120 THEN left(text, 120) || '...' ELSE text END AS snippet FROM final)"""

_THINNED = "JOIN (SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN '' ELSE text END AS text FROM documents) d USING (doc_id)"

QUERIES |= {
    f.__name__: f
    for f in (
        dense_cosine_topk, ivf_topk, bm25_topk, rrf_hybrid_topk, eligible_latest_results, reranked_snippets, reranked_without_texts, answer_contexts, cited_answers, threshold_fallback, reranked_by_model,
    )
}
ORACLES |= {
    "dense_cosine_topk": f"SELECT * FROM ({dense_sql('SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 = 0', 20)}) WHERE score >= {R.THRESHOLD}",
    "bm25_topk": f"WITH {BM25_SQL} SELECT * FROM bm25",
    "threshold_fallback": f"WITH {BM25_SQL} SELECT * FROM bm25 WHERE rank <= 20",
    "reranked_by_model": f"""WITH {ELIGIBLE_SQL}, r AS (SELECT query_id, doc_id, d.text, length(b.text) % 3 AS how, count(*) OVER (PARTITION BY query_id) AS many,
        row_number() OVER (PARTITION BY query_id ORDER BY rank, doc_id) AS pos FROM ok JOIN documents d USING (doc_id) JOIN benchmark b ON item_id = query_id WHERE version = latest)
        SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN how = 1 AND many > 1 THEN -length(text) END, pos)::INT AS rank FROM r QUALIFY rank <= 5 OR how <> 1 OR many = 1""",
    "rrf_hybrid_topk": f"WITH {FUSED_SQL} SELECT * FROM fused",
    "eligible_latest_results": f"WITH {ELIGIBLE_SQL} SELECT query_id, doc_id, score, rank, kb_id, file_name, version FROM ok WHERE version = latest",
    "reranked_snippets": f"WITH {_FINAL} SELECT query_id, doc_id, rerank_score, rank, snippet FROM short",
    "reranked_without_texts": f"WITH {_FINAL.replace('JOIN documents d USING (doc_id)', _THINNED)} SELECT query_id, doc_id, rerank_score, rank, length(text) AS n_chars FROM final",
    "answer_contexts": f"""WITH {_FINAL} SELECT query_id, sha256(string_agg('[来源' || rank || '] 文档：' || file_name || '，第1页' || chr(10) || text || chr(10) || chr(10), '' ORDER BY rank)) AS context_sha256,
        count(*)::INT AS n_sources FROM final GROUP BY ALL""",
    "cited_answers": f"""WITH {_FINAL} SELECT query_id, coalesce(string_agg(snippet || '[来源' || (rank // 2) || ']', chr(10) ORDER BY rank) FILTER (rank % 2 = 0), '') AS answer,
        coalesce(string_agg(doc_id::VARCHAR, ',' ORDER BY rank) FILTER (rank % 2 = 0), '') AS doc_ids FROM short GROUP BY ALL""",
}
