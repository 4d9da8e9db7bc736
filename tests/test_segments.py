"""Kept indexes: segments that are merged, thinned and searched with skipping; vectors by list."""

import numpy as np
import pytest
from frames import DATA
from pyspark.sql import functions as F

from lorespark.operators import retrieval as R
from lorespark.operators import segments
from lorespark.operators.segments import TextIndex, VectorIndex, fewest
from lorespark.sources.collections import Collections
from lorespark.sources.log import LogTable


def found(df):
    return sorted(tuple(r) for r in df.select("query_id", "doc_id", "score", "rank").collect())


@pytest.fixture
def index(spark, tmp_path):
    made = TextIndex(spark, str(tmp_path / "i"))
    made.create()
    return made


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").cache()


@pytest.fixture(scope="module")
def asked(spark):
    return spark.read.parquet(f"{DATA}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text").where("item_id < 12")


def test_segments_merge_in_tiers(spark, index, docs, asked):
    for i in range(7):
        index.add(docs.where(F.pmod(F.col("doc_id"), F.lit(7)) == i))
        index.merge(2)
    parts = index.table.state().parts.values()
    assert sorted(p["tier"] for p in parts) == [0, 1, 2] and sum(p["docs"] for p in parts) == docs.count()
    assert found(index.search(asked, 10)) == found(R.bm25_topk(asked, docs, 10))
    assert index.merge(2) == 0


def test_removed_documents_leave_no_trace(spark, index, docs, asked):
    index.add(docs.where("doc_id % 2 = 0"))
    index.add(docs.where("doc_id % 2 = 1"))
    index.remove(docs.where("doc_id % 3 = 1").select("doc_id").unionByName(spark.createDataFrame([(-7,), (None,)], "doc_id long")))
    left = docs.where("doc_id % 3 <> 1")
    assert index.table.state().sums["docs"] == left.count()
    assert found(index.search(asked, 10)) == found(R.bm25_topk(asked, left, 10))
    index.remove(docs.where("doc_id % 5 = 0").select("doc_id"))
    left = left.where("doc_id % 5 <> 0")
    assert found(index.search(asked, 10)) == found(R.bm25_topk(asked, left, 10))
    index.merge(2)
    index.add(docs.where("doc_id % 3 = 1 OR doc_id % 5 = 0"))
    assert found(index.search(asked, 10)) == found(R.bm25_topk(asked, docs, 10))
    index.remove(docs.select("doc_id"))
    assert index.table.state().sums == {"docs": 0, "words": 0} and index.search(asked, 10).count() == 0


def test_odd_documents(spark, index):
    schema = "doc_id long, text string, cell int"
    index.add(spark.createDataFrame([], schema))
    data = spark.createDataFrame([(1, "alpha beta", 5), (2, None, 5), (3, "", 5), (4, "ALPHA alpha, gamma", 5), (5, "漢字検索 alpha", 5)], schema)
    index.add(data)
    queries = spark.createDataFrame([(1, "alpha"), (2, "delta"), (3, ""), (4, None), (5, "漢字")], "query_id long, text string")
    assert found(index.search(queries, 2)) == found(R.bm25_topk(queries, data, 2))
    assert index.table.state().sums["docs"] == 5
    index.remove(data.where("doc_id <= 3").select("doc_id"))
    assert index.table.state().sums["docs"] == 2


def test_cells_below_the_kth_score_are_skipped(spark, index, monkeypatch):
    """Most documents have a common word only; few have the rare one, and k of these are enough."""
    monkeypatch.setattr(segments, "CELL", 16)
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("common words here "), F.when(F.col("id") % 400 == 7, "rare").otherwise(F.concat(F.lit("w"), F.col("id") % 50))).alias("text"))
    index.add(docs)
    queries = spark.createDataFrame([(1, "common rare"), (2, "w3 rare common"), (3, "rare")], "query_id long, text string")
    assert found(index.search(queries, 5)) == found(R.bm25_topk(queries, docs, 5))
    cells = index.cells(queries, 5).groupBy("query_id").agg(F.count("*").alias("n"), F.count_if("alive").alias("alive")).collect()
    shares = {r.query_id: r.alive / r.n for r in cells}
    assert shares[1] < 0.1 and shares[2] < 0.4, shares


def test_many_terms(spark, index, docs, asked, monkeypatch):
    monkeypatch.setattr(segments, "LISTED", 3)
    index.add(docs)
    want = found(R.bm25_topk(asked, docs, 5))
    assert found(index.search(asked, 5)) == want
    monkeypatch.setattr(segments, "MANY_TERMS", 3)
    assert found(index.search(asked, 5)) == want


@pytest.fixture
def vectors(spark, tmp_path):
    made = VectorIndex(LogTable(spark, str(tmp_path / "v")), "doc_id")
    made.create()
    made.table.create("list int, doc_id long, embedding array<float>, note string")
    return made


def test_vectors_in_batches(spark, vectors, monkeypatch):
    rng = np.random.default_rng(2)
    groups = rng.normal(size=(30, 16))
    data = [(i, (groups[i % 30] + rng.normal(size=16) * 0.3).tolist(), f"n{i}") for i in range(1500)] + [(2000, None, "no vector"), (2001, [0.0] * 16, "zero")]
    table = spark.createDataFrame(data, "doc_id long, embedding array<float>, note string")
    asked = table.where("doc_id % 50 = 0 AND embedding IS NOT NULL").select(F.col("doc_id").alias("query_id"), "embedding")
    assert vectors.search(asked, 5).count() == 0
    for i in range(3):
        vectors.add(table.where(F.col("doc_id") % 3 == i))
    assert vectors.table.read().where("list = -1").select("doc_id").collect() == [(2000,)]
    exact = found(R.dense_topk(asked, table.where("embedding IS NOT NULL").select("doc_id", "embedding"), 10))
    assert found(vectors.search(asked, 10)) == exact
    got = {r[:2] for r in found(vectors.search(asked, 10, probes=6))}
    assert len(got & {r[:2] for r in exact}) >= 0.9 * len(exact)
    monkeypatch.setattr(segments, "QUERY_BYTES", 16 * 8 * 4)
    monkeypatch.setattr(segments, "LISTED", 0)
    assert found(vectors.search(asked, 10)) == exact
    vectors.table.delete(F.col("doc_id") % 2 == 1)
    assert found(vectors.search(asked, 10)) == found(R.dense_topk(asked, table.where("embedding IS NOT NULL AND doc_id % 2 = 0").select("doc_id", "embedding"), 10))


def test_fewest_breaks_ties_by_id():
    parts = [(np.array([0, 0, 1]), np.array([9, 4, 2]), np.array([0.5, 0.5, 0.1])), (np.array([0, 1, 1]), np.array([1, 7, 8]), np.array([0.5, 0.3, 0.3]))]
    assert [x.tolist() for x in fewest(parts, 2)] == [[0, 0, 1, 1], [1, 4, 7, 8], [0.5, 0.5, 0.3, 0.3]]


def test_collection_is_searched_after_each_change(spark, tmp_path):
    found_ = Collections(spark, str(tmp_path))
    found_.create(4)
    schema = "id long, knowledge_id long, document_id long, chunk_id long, page_no int, chunk_index int, text string, embedding array<float>"
    row = lambda i, text, x: (i, 4, i // 10, i, 1, i % 10, text, [1.0, float(x)])
    found_.insert(4, spark.createDataFrame([row(10, "red apple", 0), row(11, "green pear", 1), row(20, "red plum", 2)], schema))
    found_.insert(4, spark.createDataFrame([row(11, "red pear", 5), row(21, "blue plum", 9)], schema))
    asked = spark.createDataFrame([(1, "red", [1.0, 5.0])], "query_id long, text string, embedding array<float>")
    assert [r.doc_id for r in found_.search_text(4, asked, 9).orderBy("rank").collect()] == [10, 11, 20]
    assert [r.doc_id for r in found_.search_dense(4, asked, 2).orderBy("rank").collect()] == [11, 21]
    assert found_.delete(4, F.col("document_id") == 1) == 2 and found_.read(4).count() == 2
    assert [r.doc_id for r in found_.search_text(4, asked, 9).collect()] == [20]
    assert [r.doc_id for r in found_.search_dense(4, asked, 9).orderBy("rank").collect()] == [21, 20]
    found_.drop(4)
    found_.drop(4)
    with pytest.raises(LookupError):
        found_.search_text(4, asked, 1)
