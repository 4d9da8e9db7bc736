"""Versions, incremental chunk changes, expiry and tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorespark.sources.keyed import changed, remove, upsert
from lorespark.sources.log import LogTable
from lorespark.sources.work import written

SUCCESS, DEPRECATED, EXPIRED = 3, 5, 6
PENDING, PROCESSING = 0, 1
MAX_CHUNKS = 1_000_000


def vector_id(document_id: Column, chunk_index: Column) -> Column:
    """The key of a chunk's vector; an index out of range is an error."""
    ok = (chunk_index >= 0) & (chunk_index < MAX_CHUNKS)
    return F.when(ok, document_id * MAX_CHUNKS + chunk_index).otherwise(F.raise_error(F.lit("chunk index out of range")).cast("long"))


def chunk_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(document_id, chunk_index, cls): what to do for each chunk of documents that are ingested again.

    old has content_hash and vector_id, new content_hash. new chunks and those of another hash are ``save`` (and
    their old rows ``stale``), equal ones without a vector ``vector_only``, other equal ones ``skip``, and old
    chunks that are gone ``stale``.
    """
    keys = ["document_id", "chunk_index"]
    both = old.select(*keys, F.col("content_hash").alias("was"), "vector_id", F.lit(True).alias("had")).join(
        new.select(*keys, F.col("content_hash").alias("now"), F.lit(True).alias("has")), keys, "full_outer"
    )
    had, has = F.col("had").isNotNull(), F.col("has").isNotNull()
    same = F.col("was").eqNullSafe(F.col("now"))
    cls = (
        F.when(~has, F.array(F.lit("stale")))
        .when(~had, F.array(F.lit("save")))
        .when(~same, F.array(F.lit("save"), F.lit("stale")))
        .when(F.col("vector_id").isNull(), F.array(F.lit("vector_only")))
        .otherwise(F.array(F.lit("skip")))
    )
    return both.select(*keys, F.explode(cls).alias("cls"))


def apply_diff(old: DataFrame, new: DataFrame, diff: DataFrame) -> DataFrame:
    """The chunk table after a diff: stale rows gone, saved ones added, and vectors noted for all that get one."""
    keys = ["document_id", "chunk_index"]
    kept = remove(old, diff.where("cls = 'stale'"), *keys)
    kept = kept.withColumn("vector_id", vector_id(F.col("document_id"), F.col("chunk_index")))
    saved = new.join(diff.where("cls = 'save'").select(*keys), keys, "left_semi")
    saved = saved.withColumn("vector_id", vector_id(F.col("document_id"), F.col("chunk_index")))
    return kept.select(*keys, "content_hash", "vector_id").unionByName(saved.select(*keys, "content_hash", "vector_id"))


def keep_vectors(vectors: DataFrame, keep: DataFrame, document_ids: DataFrame) -> DataFrame:
    """vectors without those of the documents whose id is not in keep; an empty keep removes them all."""
    of = vectors.join(document_ids.select("document_id"), "document_id", "left_semi").join(keep.select("id"), "id", "left_anti")
    return remove(vectors, of, "id")


def trim_vectors(vectors: DataFrame, sizes: DataFrame) -> DataFrame:
    """vectors (document_id, chunk_index) without those behind the last chunk of documents in sizes (document_id, n)."""
    joined = vectors.join(sizes.select("document_id", F.col("n").alias("_n")), "document_id", "left")
    return joined.where(F.col("_n").isNull() | (F.col("chunk_index") < F.col("_n"))).select(*vectors.columns)


def next_versions(documents: DataFrame) -> DataFrame:
    """(kb_id, file_name, next_version): one above the largest of any status."""
    return documents.groupBy("kb_id", "file_name").agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("next_version"))


def deprecate_old(documents: DataFrame, finished: DataFrame, now: Column, ttl_days: int) -> DataFrame:
    """documents after finished ones (id, kb_id, file_name) succeeded.

    Every other successful, active, unexpiring version of the name is deprecated, newer ones too, and expires after ttl_days.
    """
    names = finished.select("kb_id", "file_name").distinct().withColumn("_named", F.lit(True))
    ids = finished.select("id").distinct().withColumn("_new", F.lit(True))
    joined = documents.join(names, ["kb_id", "file_name"], "left").join(ids, "id", "left")
    fits = (F.col("status") == SUCCESS) & (F.col("is_active") == 1) & F.col("expire_time").isNull()
    joined = joined.withColumn("_old", fits & F.col("_named").isNotNull() & F.col("_new").isNull())
    expiry = now + F.make_dt_interval(F.lit(ttl_days))
    return changed(joined, F.col("_old"), status=F.lit(DEPRECATED), expire_time=expiry).select(*documents.columns)


def expire_overdue(documents: DataFrame, now: Column) -> DataFrame:
    """documents with successful and deprecated ones that are past their time set to expired, in all knowledge bases."""
    due = F.col("status").isin(SUCCESS, DEPRECATED) & (F.col("expire_time") < now)
    return changed(documents, due, status=F.lit(EXPIRED).cast(documents.schema["status"].dataType))


def claim(tasks: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """tasks with the pending ones among ids set to processing, and the ids that were won."""
    won = tasks.join(ids.select("id"), "id", "left_semi").where(F.col("status") == PENDING).select("id")
    hit = tasks.join(won.withColumn("_won", F.lit(True)), "id", "left")
    return changed(hit, F.col("_won"), status=F.lit(PROCESSING).cast(tasks.schema["status"].dataType)).drop("_won"), won


def unfinished(tasks: DataFrame) -> DataFrame:
    return tasks.where(F.col("status").isin(PENDING, PROCESSING))


def reset(tasks: DataFrame) -> DataFrame:
    """Unfinished tasks made pending again, with counters at zero and one more retry."""
    zero = {c: F.lit(0) for c in ("total_chunk", "success_chunk", "fail_chunk") if c in tasks.columns}
    error = {"error_message": F.lit(None).cast("string")} if "error_message" in tasks.columns else {}
    return changed(tasks, F.col("status").isin(PENDING, PROCESSING), **zero, **error, retry_count=F.coalesce("retry_count", F.lit(0)) + 1, status=F.lit(PENDING))


def progress(done: Column, total: Column) -> Column:
    """Whole percent, zero for an empty task."""
    return F.when(total > 0, F.floor(done * 100 / total)).otherwise(0).cast("long")


def failed_chunks(total: Column, skipped: Column, stored: Column) -> Column:
    return F.greatest(F.lit(0), total - skipped - stored)


def delete_documents(gone: DataFrame, documents: DataFrame, chunks: DataFrame, tasks: DataFrame, vectors: DataFrame) -> tuple[DataFrame, ...]:
    """The four tables without the documents (document_id) in gone; those with an unfinished task stay."""
    busy = unfinished(tasks).select("document_id").distinct()
    gone = gone.select("document_id").join(busy, "document_id", "left_anti")
    return (documents.join(gone.withColumnRenamed("document_id", "id"), "id", "left_anti"), *(remove(t, gone, "document_id") for t in (chunks, tasks, vectors)))


def store_vectors(vectors: DataFrame, new: DataFrame, limit: int = 65_535 // 3) -> DataFrame:
    """vectors with new ones put in by id; null places become zero and texts are cut to limit characters."""
    new = new.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("page_no", "chunk_index") if c in new.columns})
    return upsert(vectors, new.withColumn("text", F.substring(F.coalesce("text", F.lit("")), 1, limit)), "id")


def claim_in(table: LogTable, ids: DataFrame, **values: str) -> DataFrame:
    """Set the pending tasks among ids to processing in a table that others claim from too, with more values. Gives the rows that were won: no other caller gets them."""
    status = table.schema()["status"].dataType
    new = {"status": F.lit(PROCESSING).cast(status), **{k: F.lit(v) for k, v in values.items()}}
    return table.replace(lambda rows: rows.where(F.col("status") == PENDING).join(ids.select("id"), "id", "left_semi"), lambda rows: rows.withColumns(new), "claim")


def numbered_versions(old: DataFrame, new: DataFrame) -> DataFrame:
    """new (kb_id, file_name, ...) with the version after the largest of the name in old; repeated names go on counting."""
    known = next_versions(old)
    count = F.row_number().over(Window.partitionBy("kb_id", "file_name").orderBy(*[c for c in new.columns if c not in ("kb_id", "file_name")] or [F.lit(1)])) - 1
    return new.withColumn("_count", count).join(known, ["kb_id", "file_name"], "left").withColumn("version", F.coalesce("next_version", F.lit(1)) + F.col("_count")).drop("_count", "next_version")


def insert_versions(table: LogTable, new: DataFrame) -> DataFrame:
    """Add new documents as the next versions of their names, worked out anew if another caller adds one of a name meanwhile. Gives the added rows."""
    return table.insert_keyed(lambda old: numbered_versions(old, new), ["kb_id", "file_name"], new)


def delete_documents_in(gone: DataFrame, documents: LogTable, chunks: LogTable, tasks: LogTable, vectors: LogTable) -> dict[str, int]:
    """delete_documents in tables with a log: what depends on a document goes before it, so that a rerun ends what was begun."""
    busy = unfinished(tasks.read()).select("document_id").distinct()
    gone = written(gone.select("document_id").distinct().join(busy, "document_id", "left_anti"), "gone")
    count = {n: t.delete(keys=gone) for n, t in (("vectors", vectors), ("chunks", chunks), ("tasks", tasks))}
    return {**count, "documents": documents.delete(keys=gone.toDF("id"))}


def keep_vectors_in(vectors: LogTable, keep: DataFrame, document_ids: DataFrame) -> int:
    """keep_vectors in a table with a log; files stay as they are."""
    return vectors.delete(keys=document_ids.select("document_id").distinct(), but=keep.select("id"))


def trim_vectors_in(vectors: LogTable, sizes: DataFrame) -> int:
    """trim_vectors in a table with a log, where chunks from n on go; files stay as they are."""

    def work(now):
        hits = vectors.places(now).join(sizes.select("document_id", "n"), "document_id").where(F.col("chunk_index") >= F.col("n"))
        return vectors.gone_or_none(hits, now)

    return done.result if (done := vectors.transact(work, "trim")) else 0
