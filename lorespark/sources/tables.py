"""Schemas of the knowledge-base tables, code labels, scans and lookups."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Column names and types of the knowledge-base tables.
SCHEMAS = {
    "knowledge_base": "id long, name string, description string, status int, create_user long, create_time timestamp, update_time timestamp",
    "knowledge_document": (
        "id long, knowledge_id long, file_name string, file_path string, file_size long, file_type string, chunk_count int, embedding_model string, "
        "status int, create_time timestamp, update_time timestamp, version int, expire_time timestamp, is_active int"
    ),
    "knowledge_chunk": (
        "id long, document_id long, chunk_index int, content string, content_hash string, token_count int, page_no int, vector_id long, create_time timestamp"
    ),
    "embedding_task": (
        "id long, task_no string, document_id long, status int, total_chunk int, success_chunk int, fail_chunk int, parse_progress int, split_progress int, "
        "chunk_progress int, embed_progress int, vector_progress int, retry_count int, error_message string, start_time timestamp, finish_time timestamp, "
        "cost_time long, create_time timestamp, update_time timestamp"
    ),
    "kb_member": "id long, kb_id long, user_id long, role string, grant_user long, create_time timestamp, update_time timestamp",
    "kb_access_log": (
        "id long, user_id long, username string, action string, kb_id long, document_id long, ip string, detail string, create_time timestamp"
    ),
    "chunk_vector": "id long, knowledge_id long, document_id long, chunk_id long, page_no int, chunk_index int, text string, embedding array<float>",
    "user": "id long, username string, nickname string, email string, status int",
    "role": "id long, code string, name string, remark string, status int",
    "permission": "id long, code string, name string, type int, parent_id long, sort int, status int",
    "user_role": "user_id long, role_id long",
    "role_permission": "role_id long, permission_id long",
}

#: Status codes and role ranks.
DOCUMENT_STATUS = {0: "UPLOADING", 1: "PARSING", 2: "EMBEDDING", 3: "SUCCESS", 4: "FAILED", 5: "DEPRECATED", 6: "EXPIRED"}
TASK_STATUS = {0: "PENDING", 1: "PROCESSING", 2: "SUCCESS", 3: "FAILED"}
ROLE_RANK = {"VIEWER": 1, "EDITOR": 2, "OWNER": 3}


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[table])


def load(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A Parquet table of the knowledge base, with its declared schema where it has one."""
    reader = spark.read.schema(SCHEMAS[table]) if table in SCHEMAS else spark.read
    return reader.parquet(f"{path}/{table}.parquet")


def label(code: Column, labels: dict, default: str = "UNKNOWN") -> Column:
    """The label of a code; default where the code is null or unknown."""
    return F.coalesce(F.create_map(*map(F.lit, chain(*labels.items())))[code], F.lit(default))


def by_ids(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is among ids (one column); repeated ids don't repeat rows."""
    return df.join(ids.toDF(key), key, "left_semi")


def matching(df: DataFrame, **wanted) -> DataFrame:
    """Rows with these column values; an argument of None sets no condition, a list means any of its values."""
    for name, value in wanted.items():
        if value is not None:
            df = df.where(F.col(name).isin(value) if isinstance(value, (list, tuple, set)) else F.col(name) == value)
    return df
