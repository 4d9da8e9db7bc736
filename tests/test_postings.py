"""Blocks of postings: what they leave on disk, odd ids, long documents, places of removed documents."""

import os

import pyarrow as pa
import pytest
from frames import rows
from pyspark.sql import functions as F

from lorespark.operators import postings, segments
from lorespark.operators import retrieval as R
from lorespark.operators.segments import TextIndex
from lorespark.plans import retrieval
from lorespark.sources import work


def found(df):
    return sorted(tuple(r) for r in df.select("query_id", "doc_id", "score", "rank").collect())


@pytest.fixture
def index(spark, tmp_path):
    made = TextIndex(spark, str(tmp_path / "i"))
    made.create()
    return made


def on_disk(spark, *folders):
    """Bytes of Spark's own files, shuffles among them, and of folders."""
    own = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    spilt = sum(own.apply(i).length() for i in range(own.size()))
    return spilt + sum(os.lstat(f"{d}/{x}").st_size for top in folders for d, _, names in os.walk(top) for x in names)


def test_ingest_takes_little_more_disk_than_the_texts(spark, index):
    """Work tables and shuffles of an ingest go with it: what is there after ingests, a merge and a search is not a multiple of the texts."""
    word = lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", i), F.greatest(F.lit(1), F.pmod(F.xxhash64(i, "id"), F.lit(30000)))))
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(150)), word), " ").alias("text")).cache()
    size = docs.agg(F.sum(F.length("text"))).first()[0]
    queries = docs.where("doc_id % 200 = 0").select(F.col("doc_id").alias("query_id"), "text")
    folders = index.table.path, work.work_path(spark, "any").rpartition("/")[0].removeprefix("file:")
    before = on_disk(spark, *folders)
    for i in range(3):
        index.add(docs.where(F.col("doc_id") % 3 == i))
    index.merge(3)
    got = found(index.search(queries, 10))
    taken = on_disk(spark, *folders) - before
    assert taken < 4 * size, taken / size
    assert got == found(R.bm25_topk(queries, docs, 10))


def test_ids_that_are_missing_or_come_again(spark, duck, index):
    """As by the SQL: rows of one id and length are one document, scores of one id add up, each row counts for the mean."""
    data = [(1, "alpha beta"), (1, "alpha beta"), (1, "alpha gamma gamma"), (None, "alpha delta"), (2, "beta"), (3, None), (4, "gamma alpha beta delta")]
    asked = [(7, "alpha gamma"), (8, "beta delta none"), (9, "none")]
    index.add(spark.createDataFrame(data, "doc_id long, text string"))
    assert index.table.state().sums == {"docs": 7, "words": 14}
    got = index.search(spark.createDataFrame(asked, "query_id long, text string"), 40)
    con = duck.cursor()
    con.execute("CREATE SCHEMA odd; SET schema = 'odd'; CREATE TABLE documents (doc_id BIGINT, text VARCHAR); CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(i, t or "") for i, t in data])
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", asked)
    assert rows(got.toPandas()) == rows(con.execute(retrieval.ORACLES["bm25_topk"]).df())


def batch(*docs):
    block, ids, terms = pa.array([1] * len(docs), pa.int32()), pa.array([d[0] for d in docs], pa.int64()), pa.array([d[1].split() for d in docs], pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays([block, ids, terms], names=["block", "doc_id", "terms"])


def test_long_documents_end_a_block(monkeypatch):
    monkeypatch.setattr(postings, "WORDS", 5)
    made = list(postings.inverted(10)(iter([batch((3, "b a b")), batch((2, "a"), (1, "c c c")), batch(), batch((4, ""))])))
    got = {(r["block"], r["term"]): (r["n"], r["words"], r["docs"], r["tfs"], r["ids"]) for b in made for r in b.to_pylist()}
    assert got == {
        (1, ""): (3, 7, [0, 1, 2], [3, 1, 3], [1, 2, 3]), (1, "a"): (2, 2, [1, 2], [1, 1], []), (1, "b"): (1, 2, [2], [2], []), (1, "c"): (1, 3, [0], [3], []),
        (11, ""): (1, 0, [0], [0], [4]),
    }


def test_small_blocks_are_put_together_without_holes(spark, index, monkeypatch):
    monkeypatch.setattr(segments, "CELL", 4)
    monkeypatch.setattr(segments, "BLOCK", 5)
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit("all w"), F.col("id") % 7, F.lit(" v"), F.col("id") % 11).alias("text"))
    for i in range(4):
        index.add(docs.where(F.col("doc_id") % 4 == i))
    index.remove(docs.where("doc_id % 2 = 1 AND doc_id < 50").select("doc_id"))
    index.merge(4)
    heads = index.table.read().where("term = ''").select("block", "n", "docs").orderBy("block").collect()
    assert sum(h.n for h in heads) == 35 and len(heads) <= 3 and all(h.docs == list(range(h.n)) and h.n <= 20 for h in heads)
    queries = spark.createDataFrame([(1, "w3 v5"), (2, "all"), (3, "v0 w1 w2")], "query_id long, text string")
    for k in (1, 6, 100):
        assert found(index.search(queries, k)) == found(R.bm25_topk(queries, docs.where("NOT (doc_id % 2 = 1 AND doc_id < 50)"), k))


def test_shuffles_are_tidied_until_the_last_caller_ends(spark):
    before = spark.conf.get(work._CLEAN_UP)
    one, two = work.tidied(spark), work.tidied(spark)
    one.__enter__()
    two.__enter__()
    one.__exit__(None, None, None)
    assert spark.conf.get(work._CLEAN_UP) == "true"
    two.__exit__(None, None, None)
    assert spark.conf.get(work._CLEAN_UP) == before
