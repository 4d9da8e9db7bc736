"""Queries over what is kept: collections with their indexes, and tables with a commit log that several callers change."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorespark.operators import access, lifecycle, lists
from lorespark.operators import retrieval as R
from lorespark.operators.asof import asof_join
from lorespark.operators.contains import ContainsIndex
from lorespark.operators.quantised import CodedVectors
from lorespark.operators.segments import TextIndex, VectorIndex
from lorespark.sources.collections import Collections
from lorespark.sources.log import LogTable
from lorespark.sources.work import spread, work_folder

from . import retrieval
from . import standins as S

QUERIES, ORACLES = {}, {}
BATCHES = 5


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def logged(spark, rows, name: str) -> LogTable:
    """A table with a commit log that holds rows."""
    table = LogTable(spark, work_folder(spark, name))
    table.create(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema))
    table.append(rows)
    return table


@query(retrieval.ORACLES["bm25_topk"])
def kept_bm25_topk(spark, sf_dir):
    """documents ingested in five batches, whose segments are merged on the way."""
    index = TextIndex(spark, work_folder(spark, "text-index"))
    index.create()
    docs = spread(S.read(spark, sf_dir, "documents").select("doc_id", "text"))
    for i in range(BATCHES):
        index.add(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(BATCHES)) == i))
        index.merge(3)
    return index.search(retrieval.questions(spark, sf_dir), R.ROUTE_TOP)


@query(retrieval.ORACLES["dense_cosine_topk"])
def kept_dense_topk(spark, sf_dir):
    """embeddings ingested in five batches, of which some are deleted in place and come again; every list is probed."""
    rows = retrieval.vectors(spark, sf_dir)
    index = VectorIndex(LogTable(spark, work_folder(spark, "vector-index")), "doc_id")
    index.create()
    index.table.create("list int, doc_id long, embedding array<float>")
    for i in range(BATCHES):
        index.add(rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(BATCHES)) == i))
    index.table.delete(F.col("doc_id") % 7 == 2)
    index.add(rows.where("doc_id % 7 = 2"))
    return index.search(rows.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id"), 20, threshold=R.THRESHOLD)


@query()
def quantised_topk(spark, sf_dir):
    """embeddings kept as codes in two batches; the 200 that look nearest to a query are compared exactly."""
    rows = retrieval.vectors(spark, sf_dir)
    index = CodedVectors(LogTable(spark, work_folder(spark, "codes")), "doc_id")
    index.create()
    index.table.create("list int, code binary, doc_id long, embedding array<float>")
    for i in range(2):
        index.add(rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == i))
    return index.search(rows.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id"), 20)


_COLLECTION = "SELECT vec_id AS id, text FROM embeddings JOIN documents ON doc_id = vec_id WHERE NOT (vec_id % 3 = 1 AND label = 2)"


@query(
    "WITH "
    + retrieval.BM25_SQL.replace("FROM documents", f"FROM (SELECT id AS doc_id, text FROM ({_COLLECTION}))")
    + f""", dense AS ({retrieval.dense_sql("SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings JOIN benchmark ON item_id = vec_id", 40).replace("FROM embeddings) d", f"FROM embeddings WHERE vec_id IN (SELECT id FROM ({_COLLECTION}))) d")})
    SELECT 'text' AS route, query_id, doc_id, score, rank FROM bm25 UNION ALL SELECT 'dense', query_id, doc_id, score, rank FROM dense"""
)
def collection_search(spark, sf_dir):
    """A knowledge base's collection: ingested in two batches, put in again in part, thinned by a predicate, searched on both routes."""
    found = Collections(spark, work_folder(spark, "collections"))
    found.create(1)
    docs = S.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    rows = S.read(spark, sf_dir, "embeddings").join(docs, "vec_id").select(
        F.col("vec_id").alias("id"), F.lit(1).cast("long").alias("knowledge_id"), F.col("label").cast("long").alias("document_id"), F.col("vec_id").alias("chunk_id"),
        F.lit(1).alias("page_no"), F.lit(0).alias("chunk_index"), "text", "embedding",
    )
    found.insert(1, rows.where("id % 2 = 0").withColumn("text", F.when(F.col("id") % 4 == 0, F.lit("an older text")).otherwise(F.col("text"))))
    found.insert(1, rows.where("id % 2 = 1 OR id % 4 = 0"))
    found.delete(1, (F.col("id") % 3 == 1) & (F.col("document_id") == 2))
    asked = retrieval.questions(spark, sf_dir)
    vectors = asked.select("query_id").join(retrieval.vectors(spark, sf_dir).withColumnRenamed("doc_id", "query_id"), "query_id")
    text, dense = found.search_text(1, asked, R.ROUTE_TOP), found.search_dense(1, vectors, R.ROUTE_TOP)
    return text.select(F.lit("text").alias("route"), "query_id", "doc_id", "score", "rank").unionByName(dense.select(F.lit("dense").alias("route"), "query_id", "doc_id", "score", "rank"))


@query(
    S.with_("tasks_")
    + """SELECT id, CASE WHEN status = 0 AND (id % 2 = 0 OR id % 3 = 0) THEN 1 ELSE status END AS status,
    CASE WHEN status <> 0 THEN NULL WHEN id % 2 = 0 THEN 'second' WHEN id % 3 = 0 THEN 'first' END AS owner FROM tasks_"""
)
def claims_after_conflict(spark, sf_dir):
    """Two callers claim tasks at once. The second one commits while the first one works: that one works anew, and gets what is left."""
    table = logged(spark, S.tasks(spark, sf_dir).select("id", "status", F.lit(None).cast("string").alias("owner")), "tasks")
    calls = []

    def pick(rows):
        if not calls:
            calls.append(lifecycle.claim_in(LogTable(spark, table.path), rows.where("id % 2 = 0").select("id"), owner="second"))
        return rows.where("id % 3 = 0 AND status = 0")

    table.replace(pick, lambda rows: rows.withColumns({"status": F.lit(1), "owner": F.lit("first")}), "claim")
    return table.read()


@query(
    S.with_("documents_")
    + """, names AS (SELECT kb_id, file_name, max(version) AS v FROM documents_ GROUP BY ALL)
    SELECT kb_id, file_name, version, 'old' AS writer FROM documents_ UNION ALL SELECT kb_id, file_name, v + 1, 'second' FROM names WHERE file_name <> 'en'
    UNION ALL SELECT kb_id, file_name, v + CASE WHEN file_name <> 'en' THEN 2 ELSE 1 END, 'first' FROM names"""
)
def versions_after_conflict(spark, sf_dir):
    """Two callers add a version of the same names at once; versions stay unique."""
    table = logged(spark, S.documents(spark, sf_dir).select("kb_id", "file_name", "version", F.lit("old").alias("writer")), "versions")
    names = S.documents(spark, sf_dir).select("kb_id", "file_name").distinct()
    calls = []

    def make(old):
        made = lifecycle.numbered_versions(old, names.withColumn("writer", F.lit("first")))
        if not calls:
            calls.append(lifecycle.insert_versions(LogTable(spark, table.path), names.where("file_name <> 'en'").withColumn("writer", F.lit("second"))))
        return made

    table.insert_keyed(make, ["kb_id", "file_name"], names)
    return table.read()


@query("SELECT (row_number() OVER (ORDER BY writer, k))::BIGINT AS id, writer FROM (SELECT 1 AS writer, c_custkey AS k FROM customer UNION ALL SELECT 2, s_suppkey FROM supplier)")
def ids_of_batches(spark, sf_dir):
    """Two batch inserts with ids from the log: dense and unique, the later commit after the earlier one."""
    table = LogTable(spark, work_folder(spark, "ids"), ids=True)
    table.create("id long, writer int")
    first = table.append(S.read(spark, sf_dir, "customer").select(F.lit(1).alias("writer")).repartition(4))
    return first.unionByName(table.append(S.read(spark, sf_dir, "supplier").select(F.lit(2).alias("writer")).repartition(3)))


@query("SELECT vec_id AS id, label FROM embeddings WHERE NOT (label = 3 AND vec_id % 4 <> 0) AND NOT (label = 5 AND vec_id % 2 = 0)")
def vectors_deleted_in_place(spark, sf_dir):
    """Old vectors of documents that were ingested again go, then those that fit a predicate; files are left as they are, then compacted."""
    rows = S.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("document_id"))
    table = logged(spark, rows, "vectors")
    lifecycle.keep_vectors_in(table, rows.where("id % 4 = 0").select("id"), rows.where("document_id = 3").select("document_id"))
    table.delete((F.col("document_id") == 5) & (F.col("id") % 2 == 0))
    table.compact(0.1)
    return table.read().select("id", F.col("document_id").alias("label"))


@query(S.with_("chunks_") + "SELECT document_id, chunk_index FROM chunks_ WHERE document_id % 3 = 0 OR chunk_index < 3 + document_id % 4")
def vectors_trimmed_in_place(spark, sf_dir):
    table = logged(spark, S.chunks(spark, sf_dir).select("document_id", "chunk_index"), "chunks")
    sizes = S.read(spark, sf_dir, "documents").where("doc_id % 3 <> 0").select(F.col("doc_id").alias("document_id"), (3 + F.col("doc_id") % 4).alias("n"))
    lifecycle.trim_vectors_in(table, sizes)
    return table.read()


@query(
    S.with_("documents_", "chunks_", "tasks_")
    + """, gone AS (SELECT id FROM documents_ WHERE status = 4 AND id NOT IN (SELECT document_id FROM tasks_ WHERE status IN (0, 1)))
    SELECT 'documents' AS side, id AS document_id, NULL::BIGINT AS place FROM documents_ WHERE id NOT IN (FROM gone)
    UNION ALL SELECT 'chunks', document_id, chunk_index FROM chunks_ WHERE document_id NOT IN (FROM gone)
    UNION ALL SELECT 'tasks', document_id, id FROM tasks_ WHERE document_id NOT IN (FROM gone)
    UNION ALL SELECT 'vectors', vec_id, label FROM embeddings WHERE vec_id NOT IN (FROM gone)"""
)
def cascade_deleted_rows(spark, sf_dir):
    """What a cascade leaves in the four tables, row by row."""
    docs = S.documents(spark, sf_dir).select("id", "status")
    vectors = S.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("document_id"), "label")
    made = [logged(spark, t, n) for t, n in ((docs, "documents"), (S.chunks(spark, sf_dir).drop("content"), "chunks"), (S.tasks(spark, sf_dir).select("id", "document_id", "status"), "tasks"), (vectors, "vectors"))]
    lifecycle.delete_documents_in(docs.where("status = 4").select(F.col("id").alias("document_id")), *made)
    long = lambda c: F.col(c).cast("long").alias("place")
    left = [t.read() for t in made]
    sides = [left[0].select(F.lit("documents").alias("side"), F.col("id").alias("document_id"), F.lit(None).cast("long").alias("place"))]
    sides += [t.select(F.lit(n).alias("side"), "document_id", long(c)) for t, n, c in zip(left[1:], ("chunks", "tasks", "vectors"), ("chunk_index", "id", "label"))]
    return sides[0].unionByName(sides[1]).unionByName(sides[2]).unionByName(sides[3])


@query(
    S.with_("members_")
    + f"SELECT kb_id, user_id, role FROM members_ WHERE NOT (role = 'VIEWER' OR user_id % 3 = 0) OR (role = 'OWNER' AND kb_id IN (SELECT kb_id FROM members_ WHERE role = 'OWNER' GROUP BY kb_id HAVING count(*) = 1))"
)
def members_revoked_in_place(spark, sf_dir):
    """Memberships that may be revoked go from a table with a log; a last owner's stays."""
    rows = S.members(spark, sf_dir)
    table = logged(spark, rows, "members")
    kept = access.revoke(table.read(), table.read().where("role = 'VIEWER' OR user_id % 3 = 0")).select("kb_id", "user_id")
    table.delete(but=kept)
    return table.read()


@query(
    S.with_("chunks_")
    + """, headings AS (SELECT document_id, chunk_index AS at_, content AS heading FROM chunks_ WHERE length(content) BETWEEN 1 AND 60)
    SELECT c.document_id, c.chunk_index, h.heading FROM chunks_ c ASOF LEFT JOIN headings h ON c.document_id = h.document_id AND c.chunk_index >= h.at_"""
)
def chunk_headings_asof(spark, sf_dir):
    """Each chunk with the last heading of a table at or before it; short lines stand for headings."""
    chunks = S.chunks(spark, sf_dir)
    headings = chunks.where(F.length("content").between(1, 60)).select("document_id", "chunk_index", F.col("content").alias("heading"))
    return asof_join(chunks.select("document_id", "chunk_index"), headings, ["document_id"], "chunk_index")


@query("SELECT e.event_id, e.user_id, p.event_id AS purchase_id FROM events e ASOF LEFT JOIN (FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.event_id >= p.event_id")
def last_purchase_asof(spark, sf_dir):
    """Each event with its user's last purchase up to then."""
    events = S.read(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    purchases = events.where("event_type = 'purchase'").select("user_id", "event_id", F.col("event_id").alias("purchase_id"))
    return asof_join(events.select("user_id", "event_id"), purchases, ["user_id"], "event_id")


_NAMED = "SELECT id, kb_id, ['Rapport d''Été ', 'RAPPORT D''ETE ', 'Übersicht ', 'informe año ', 'Straße ', '要約 été '][1 + id % 6] || id AS file_name, create_time FROM documents_"


@query(
    S.with_("documents_")
    + f"""SELECT * EXCLUDE create_time FROM (SELECT 'a' AS part, id, file_name, create_time FROM ({_NAMED}) WHERE contains(strip_accents(lower(file_name)), 'ete 1') ORDER BY create_time DESC, id LIMIT 100)
    UNION ALL SELECT * EXCLUDE create_time FROM (SELECT 'b' AS part, id, file_name, create_time FROM ({_NAMED}) WHERE contains(strip_accents(lower(file_name)), 'ano 2') ORDER BY create_time DESC, id LIMIT 100)
    UNION ALL SELECT * EXCLUDE create_time FROM (SELECT 'c' AS part, id, file_name, create_time FROM ({_NAMED}) WHERE contains(strip_accents(lower(file_name)), 'ub') ORDER BY create_time DESC, id LIMIT 100)"""
)
def list_documents_accented(spark, sf_dir):
    """Lists by keyword through the index of file names, with accents in the names and in the keyword; one keyword is too short for it."""
    names = F.array(*map(F.lit, ("Rapport d'Été ", "RAPPORT D'ETE ", "Übersicht ", "informe año ", "Straße ", "要約 été ")))
    docs = S.documents(spark, sf_dir).withColumn("file_name", F.concat(F.get(names, F.col("id") % 6), F.col("id")))
    index = ContainsIndex(spark, work_folder(spark, "names"))
    index.create()
    for i in range(2):
        index.add(docs.where(F.col("id") % 2 == i), "id", "file_name")
    parts = None
    for part, keyword in (("a", "éTé 1"), ("b", "ANO 2"), ("c", "üB")):
        found = lists.list_documents(index.narrowed(docs, "id", "file_name", keyword), None)
        found = found.select(F.lit(part).alias("part"), "id", "file_name")
        parts = found if parts is None else parts.unionByName(found)
    return parts
