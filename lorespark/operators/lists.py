"""The lists that the services show: documents, tasks, knowledge bases, members."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.sources.tables import DOCUMENT_STATUS, TASK_STATUS

from .access import visible


def contains_text(column: Column, keyword: str | None) -> Column:
    """Whether a column holds the keyword whatever its case or accents; always, without a keyword."""
    return F.lit(True) if not keyword else F.contains(F.collate(column, "UNICODE_CI_AI"), F.collate(F.lit(keyword), "UNICODE_CI_AI"))


def list_documents(documents: DataFrame, members: DataFrame | None, keyword: str | None = None, status: int | None = None, limit: int = 100) -> DataFrame:
    """The newest visible documents: filtered first, then limited."""
    found = visible(documents, members).where(contains_text(F.col("file_name"), keyword))
    if status in DOCUMENT_STATUS:  # an unknown one sets no filter
        found = found.where(F.col("status") == status)
    return found.orderBy(F.desc("create_time"), "id").limit(limit)


def list_tasks(
    tasks: DataFrame, documents: DataFrame, bases: DataFrame, members: DataFrame | None, keyword: str | None = None, status: int | None = None, limit: int = 100, kb: Any = None
) -> DataFrame:
    """Of the newest matching tasks, those of visible documents: limited first, then filtered.

    Of kb, a knowledge base, only its own are shown, after the limit too. An unknown status sets no filter. A keyword is sought in the task number and in the document's file name. Tasks without a document are dropped;
    those whose knowledge base is gone stay without its name.
    """
    found = tasks.where(F.col("status") == status) if status in TASK_STATUS else tasks
    if keyword:
        named = documents.where(contains_text(F.col("file_name"), keyword)).select(F.col("id").alias("document_id"), F.lit(True).alias("_named"))
        found = found.join(named, "document_id", "left").where(contains_text(F.col("task_no"), keyword) | F.col("_named")).drop("_named")
    newest = found.orderBy(F.desc("create_time"), "id").limit(limit)
    joined = newest.join(documents.select(F.col("id").alias("document_id"), "kb_id", "file_name"), "document_id")
    if kb is not None:
        joined = joined.where(F.col("kb_id") == kb)
    return visible(joined.join(bases.select("kb_id", "kb_name"), "kb_id", "left"), members)


def display_name(nickname: Column, username: Column, user_id: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(nickname), F.lit("")), username, user_id.cast("string"))


def with_creators(bases: DataFrame, users: DataFrame) -> DataFrame:
    """bases with creator: the nickname, else the name, else the id of who made it."""
    brief = users.select(F.col("user_id").alias("create_user"), "nickname", "username")
    joined = bases.join(brief, "create_user", "left")
    return joined.withColumn("creator", display_name(F.col("nickname"), F.col("username"), F.col("create_user"))).drop("nickname", "username")


def members_with_names(members: DataFrame, users: DataFrame) -> DataFrame:
    return members.join(users.select("user_id", "username"), "user_id", "left")


def search_users(users: DataFrame, keyword: str, limit: int = 20) -> DataFrame:
    return users.where(contains_text(F.col("username"), keyword)).orderBy("user_id").limit(limit)


def first_of(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key, by the order."""
    rest = [c for c in df.columns if c != key]
    best = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(key).agg(best.alias("_first")).select(key, "_first.*")
