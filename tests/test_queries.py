"""Every registered query of the library against its SQL."""

import pytest
from frames import DATA, rows

from lorespark.plans import kept, relational, retrieval, streams, textual

QUERIES, ORACLES = {}, {}
for plan in (relational, textual, retrieval, streams, kept):
    QUERIES |= plan.QUERIES
    ORACLES |= plan.ORACLES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_ivf_recall(spark):
    want = retrieval.dense_cosine_topk(spark, DATA)
    want = {(r.query_id, r.doc_id) for r in want.collect()}
    got = {(r.query_id, r.doc_id) for r in retrieval.ivf_topk(spark, DATA).collect()}
    assert len(want & got) >= 0.9 * len(want)


def test_semantic_chunks_cover_documents(spark):
    got = textual.semantic_chunks(spark, DATA)
    assert got.select("document_id").distinct().count() == spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert got.groupBy("document_id").agg({"chunk_index": "max", "*": "count"}).where("`max(chunk_index)` + 1 <> `count(1)`").count() == 0


def test_entry_module_lists_queries():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
