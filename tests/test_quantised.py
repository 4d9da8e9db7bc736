"""Search over codes: recall against the exact search, deletes, odd rows."""

import numpy as np
from frames import DATA
from pyspark.sql import functions as F

from lorespark.operators import quantised
from lorespark.operators import retrieval as R
from lorespark.operators.quantised import CodedVectors
from lorespark.sources.log import LogTable


def made(spark, path):
    index = CodedVectors(LogTable(spark, str(path)), "doc_id")
    index.create()
    index.table.create("list int, code binary, doc_id long, embedding array<float>")
    return index


def pairs(df):
    return {(r.query_id, r.doc_id) for r in df.collect()}


def test_recall_with_a_tenth_of_the_vectors(spark, tmp_path):
    """The test tables' own vectors, which have no groups: every query reads at most a tenth of them in full."""
    rows = spark.read.parquet(DATA.replace("sf0.001", "sf0.1") + "/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), "embedding")
    asked = rows.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id")
    index = made(spark, tmp_path / "q")
    index.add(rows.where("doc_id % 2 = 0"))
    index.add(rows.where("doc_id % 2 = 1"))
    n = rows.count()
    k, wider = 20, n // 10 // 20
    read = index.candidates(asked, wider * k).groupBy("query_id").count().agg(F.max("count")).first()[0]
    want = pairs(R.dense_topk(asked, rows, k))
    got = index.search(asked, k, wider=wider)
    assert read <= n / 10 and len(pairs(got) & want) >= 0.9 * len(want)
    exact = {(r.query_id, r.doc_id): r.score for r in R.dense_topk(asked, rows, n).collect()}
    assert all(abs(exact[r.query_id, r.doc_id] - r.score) < 2e-6 for r in got.collect())


def test_deleted_and_odd_vectors(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(7)
    data = [(i, rng.normal(size=12).tolist()) for i in range(300)] + [(400, None), (401, [0.0] * 12), (None, [1.0] * 12)]
    rows = spark.createDataFrame(data, "doc_id long, embedding array<float>")
    index = made(spark, tmp_path / "q")
    asked = rows.where("doc_id % 60 = 0").select(F.col("doc_id").alias("query_id"), "embedding")
    assert index.search(asked, 3).count() == 0
    index.add(rows)
    exact = lambda where: pairs(R.dense_topk(asked, rows.where(where).where("embedding IS NOT NULL AND doc_id IS NOT NULL"), 3))
    assert pairs(index.search(asked, 3, wider=200)) == exact("1 = 1")
    index.table.delete(F.col("doc_id") % 3 == 1)
    monkeypatch.setattr(quantised, "QUERY_BYTES", 40_000)
    assert pairs(index.search(asked, 3, wider=200)) == exact("doc_id % 3 <> 1")
    assert index.search(asked.limit(0), 3).count() == 0 and len(pairs(index.search(asked, 3, probes=2))) <= 15
