"""Hand-made cases and properties of the operators."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from frames import DATA, rows
from lorespark.functions.vectors import cosine, hashed_embedding
from lorespark.functions.models import DEGRADED, extractive_chat
from lorespark.operators import access, answering, lifecycle, lists, retrieval
from lorespark.sources import files, keyed, tables
from lorespark.sources.collections import Collections
from lorespark.sources.work import spread


def values(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_chunk_diff_and_idempotence(spark):
    old = spark.createDataFrame([(1, 0, "h0", 1), (1, 1, "h1", None), (1, 2, "h2", 3), (1, 3, "h3", 4)], "document_id long, chunk_index long, content_hash string, vector_id long")
    new = spark.createDataFrame([(1, 0, "h0"), (1, 1, "h1"), (1, 2, "hX")], "document_id long, chunk_index long, content_hash string")
    diff = lifecycle.chunk_diff(old, new)
    assert values(diff, "chunk_index", "cls") == [(0, "skip"), (1, "vector_only"), (2, "save"), (2, "stale"), (3, "stale")]
    after = lifecycle.apply_diff(old, new, diff)
    assert {r.cls for r in lifecycle.chunk_diff(after, new).collect()} == {"skip"}


def test_vector_id(spark):
    get = lambda i: spark.range(1).select(lifecycle.vector_id(F.lit(7), F.lit(i))).first()[0]
    assert get(3) == 7000003
    for bad in (-1, 1_000_000):
        with pytest.raises(Exception, match="out of range"):
            get(bad)


def test_rrf(spark):
    route = lambda ids: spark.createDataFrame([(1, d, r) for r, d in enumerate(ids, 1)], "query_id long, doc_id string, rank int")
    a, b = route("abc"), route("bd")
    got = [r.doc_id for r in retrieval.fuse(a, b).orderBy("rank").collect()]
    assert got == ["b", "a", "d", "c"]
    assert values(retrieval.fuse(a, b), "doc_id", "score") == values(retrieval.fuse(b, a), "doc_id", "score")


def test_eligible_latest(spark):
    docs = spark.createDataFrame(
        [(1, 1, "n", 1, 3, None), (3, 1, "n", 3, 3, None), (4, 1, "n", 4, 3, None), (5, 1, "p", 1, 4, None), (6, 1, "q", 1, 6, None), (7, 1, "r", 1, None, None), (8, 1, "s", 1, 5, None), (9, 1, "t", 1, 3, "2000-01-01")],
        "doc_id long, kb_id long, file_name string, version int, status int, expire_time string",
    )
    found = spark.createDataFrame([(1, d, 1.0) for d in (1, 3, 5, 6, 7, 8, 9)], "query_id long, doc_id long, score double")
    assert values(retrieval.eligible_latest(found, docs, F.lit("2024-01-01")), "doc_id") == [(3,), (8,)]


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 2.0], [2.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    got = df.select(cosine("a", "b"), cosine("b", "a"), cosine("a", "z"), F.size(hashed_embedding(F.array(F.lit("x")), 8))).first()
    assert got[0] == pytest.approx(1) and got[0] == got[1] and got[2] == 0 and got[3] == 8


def test_dense_over_several_blocks(spark):
    rows = [(i, [float(i * 7 % 11), float(i % 5), 1.0]) for i in range(60)] + [(99, [0.0, 0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "doc_id long, embedding array<float>")
    asked = vectors.where("doc_id % 9 = 0").withColumnRenamed("doc_id", "query_id")
    small, whole = retrieval.dense_topk(asked, vectors, 5, block=7), retrieval.dense_topk(asked, vectors, 5)
    assert values(small, "query_id", "doc_id", "rank", "score") == values(whole, "query_id", "doc_id", "rank", "score")


def test_dense_with_many_queries(spark, monkeypatch):
    """Queries too large for a broadcast are dealt to the vectors' blocks by salts, with the same result."""
    vectors = spark.read.parquet(f"{DATA}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), "embedding")
    asked = vectors.withColumnRenamed("doc_id", "query_id")
    want = retrieval.dense_topk(asked, vectors, 5, block=16).toPandas()
    monkeypatch.setattr(retrieval, "QUERY_BYTES", 0)
    got = retrieval.dense_topk(asked, vectors, 5, block=16).toPandas()
    assert rows(got) == rows(want) and len(got) == 5 * asked.count()


def test_bm25_with_many_terms(spark, monkeypatch):
    """Queries with too many terms for a broadcast are joined, with the same result."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    asked = spark.read.parquet(f"{DATA}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    want = retrieval.bm25_topk(asked, docs, 7).toPandas()
    monkeypatch.setattr(retrieval, "MANY_TERMS", 1)
    assert rows(retrieval.bm25_topk(asked, docs, 7).toPandas()) == rows(want) and len(want)


def test_spread(spark):
    """A table in few partitions is dealt to all cores; a larger one is left as it is."""
    one = spark.range(100).coalesce(1)
    cores = spark.sparkContext.defaultParallelism
    assert spread(one).rdd.getNumPartitions() == max(cores, 1) and spread(one).count() == 100
    assert spread(spark.range(100).repartition(64)).rdd.getNumPartitions() == 64


def test_tasks_limit_before_and_documents_after_filter(spark):
    docs = spark.range(150).select("id", (F.col("id") < 50).cast("long").alias("kb_id"), F.lit("Ünï.pdf").alias("file_name"), F.lit(3).alias("status"), F.col("id").alias("create_time"))
    mine = spark.createDataFrame([(1,)], "kb_id long")
    bases = spark.createDataFrame([(1, "one"), (0, "zero")], "kb_id long, kb_name string")
    tasks = docs.select(F.col("id"), F.concat(F.lit("T"), "id").alias("task_no"), F.col("id").alias("document_id"), F.lit(0).alias("status"), "create_time")
    assert lists.list_documents(docs, mine, keyword="UNI").count() == 50
    assert lists.list_tasks(tasks, docs, bases, mine).count() == 0
    assert lists.list_documents(docs, None).count() == 100 and lists.list_documents(docs, mine.limit(0)).count() == 0


def test_last_owner_guard(spark):
    members = spark.createDataFrame([(1, 1, "OWNER"), (2, 1, "OWNER"), (2, 2, "OWNER")], "kb_id long, user_id long, role string")
    gone = members.select("kb_id", "user_id").where("user_id = 1")
    assert values(access.last_owners(members), "kb_id", "user_id") == [(1, 1)]
    assert values(access.revoke(members, gone), "kb_id", "user_id") == [(1, 1), (2, 2)]
    assert values(access.grant(members, gone.withColumn("role", F.lit("VIEWER"))), "kb_id", "user_id", "role") == [(1, 1, "OWNER"), (2, 1, "VIEWER"), (2, 2, "OWNER")]


def test_next_version(spark):
    docs = spark.createDataFrame([(1, "a", 1, 3), (1, "a", 2, 4)], "kb_id long, file_name string, version int, status int")
    assert values(lifecycle.next_versions(docs), "next_version") == [(3,)]


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string")
    once = keyed.upsert(old, new, "id")
    assert values(once, "id", "v") == values(keyed.upsert(once, new, "id"), "id", "v") == [(1, "a"), (2, "c"), (3, "d")]


def test_versioned_table_and_storage(spark, tmp_path):
    table = keyed.VersionedTable(spark, str(tmp_path / "t"))
    table.write(spark.range(3).withColumn("k", F.lit(1)), "k")
    table.write(keyed.upsert(table.read(), spark.createDataFrame([(9, 1)], "id long, k int"), "id"), "k")
    assert values(table.read(), "id") == [(0,), (1,), (2,), (9,)]
    store = files.Storage(spark, str(tmp_path / "s"))
    store.put("a/b.txt", b"one\ftwo")
    assert store.exists("a/b.txt") and store.get("a/b.txt") == b"one\ftwo" and store.delete("a/b.txt") and not store.exists("a/b.txt")


def test_read_pages_with_ocr(spark, tmp_path):
    (tmp_path / "x.TXT").write_text("long enough to be real text\f\fshort")
    (tmp_path / "y.bin").write_text("no parser")
    (tmp_path / "z.txt").write_text("")
    got = files.read_pages(spark, str(tmp_path), ocr=lambda content, page: "seen" if page == 2 else 1 / 0)
    assert values(got, "page_number", "text", "ocr") == [(1, "long enough to be real text", False), (2, "seen", True), (3, "short", False)]


def test_labels_and_schemas(spark):
    df = spark.createDataFrame([(3,), (77,), (None,)], "s int").select(tables.label(F.col("s"), tables.DOCUMENT_STATUS))
    assert [r[0] for r in df.collect()] == ["SUCCESS", "UNKNOWN", "UNKNOWN"]
    assert all(tables.empty(spark, t).count() == 0 for t in ("kb_member", "role_permission"))


def test_ask(spark):
    found = spark.createDataFrame([(1, 1, 7, "a", 1, "one"), (1, 2, 8, "b", None, "two")], "query_id long, rank int, doc_id long, file_name string, page_no int, text string")
    contexts = retrieval.context(found).withColumn("question", F.lit("what?"))
    got = answering.ask(contexts, extractive_chat).first()
    assert got.answer == "one[来源1]\ntwo[来源2]" and [s.doc_id for s in got.sources] == [7, 8]
    got = answering.ask(contexts, lambda system, user: "**only** [来源2] and [来源5]").first()
    assert got.answer == "only [来源1] and [来源5]" and [s.doc_id for s in got.sources] == [8]
    got = answering.ask(contexts, lambda system, user: 1 / 0).first()
    assert got.answer == DEGRADED and got.sources == []


def test_rerank_by(spark):
    found = spark.createDataFrame([(1, 10, 1, "q", "a"), (1, 11, 2, "q", None), (1, 12, 3, "q", "ccc"), (2, 10, 1, "q", "a")], "query_id long, doc_id long, rank int, question string, text string")
    longest = lambda q, texts, k: sorted(((i, float(len(t))) for i, t in enumerate(texts)), key=lambda x: -x[1])[:k]
    assert values(retrieval.rerank_by(found, longest, 2), "query_id", "rank", "doc_id") == [(1, 1, 12), (1, 2, 10), (2, 1, 10)]
    for broken in (lambda q, texts, k: 1 / 0, lambda q, texts, k: []):
        assert values(retrieval.rerank_by(found, broken, 2), "query_id", "rank", "doc_id") == [(1, 1, 10), (1, 2, 11), (1, 3, 12), (2, 1, 10)]


def test_hybrid_falls_back_at_run_time(spark):
    @F.pandas_udf("long")
    def broken(x: pd.Series) -> pd.Series:
        raise ConnectionError("away")

    good = lambda k: spark.range(k)
    name, got = retrieval.hybrid([("hybrid", lambda k: spark.range(5).select(broken("id"))), ("bm25", good), ("dense", good)], 7)
    assert name == "bm25" and got.count() == 7
    with pytest.raises(Exception, match="away"):
        retrieval.hybrid([("hybrid", lambda k: spark.range(5).select(broken("id")))])


def test_min_score(spark):
    route = spark.createDataFrame([(1, "a", 1), (1, "b", 9)], "query_id long, doc_id string, rank int")
    assert values(retrieval.fuse(route, min_score=0.016), "doc_id") == [("a",)]


def test_bm25_of_pairs(spark):
    """Runs of Han characters are matched by pairs of neighbours."""
    docs = spark.createDataFrame([(1, "考勤管理办法"), (2, "管理 考 勤"), (3, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "考勤")], "query_id long, text string")
    assert values(retrieval.bm25_topk(asked, docs), "doc_id", "rank") == [(1, 1)]


def test_require_role(spark):
    members = spark.createDataFrame([(1, 5, "OWNER"), (2, 5, "VIEWER"), (3, 5, "other")], "kb_id long, user_id long, role string")
    docs = spark.createDataFrame([(10, 1), (11, 2), (12, 3), (13, None)], "id long, kb_id long")
    assert values(access.require(docs, members, "VIEWER"), "id") == [(10,), (11,)]
    assert values(access.require(docs, members, "EDITOR"), "id") == [(10,)] and access.require(docs, None, "OWNER").count() == 4


def test_collections_and_indexes(spark, tmp_path):
    found = Collections(spark, str(tmp_path))
    with pytest.raises(LookupError):
        found.ensure_ready(1)
    found.create(1)
    found.create(1)
    assert Collections(spark, str(tmp_path)).read(1).count() == 0 and set(found.indexes(1)) == {"embedding", "text"}
    found.drop(1)
    with pytest.raises(LookupError):
        found.read(1)


def test_collections(spark, tmp_path):
    table = keyed.VersionedTable(spark, str(tmp_path / "kb_1"))
    assert not table.exists()
    table.create("id long, v string")
    table.write(spark.createDataFrame([(1, "a")], "id long, v string"))
    table.create("id long, v string")
    assert values(table.read(), "id") == [(1,)]
    table.drop()
    table.drop()
    assert not table.exists()
