"""Knowledge-base tables derived from the test tables, as DataFrames and as SQL of the same meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The fixed present of the queries.
NOW = "2024-02-01 00:00:00"

SQL = {
    "documents_": """SELECT doc_id AS id, source AS kb_id, lang AS file_name, doc_id AS version, (doc_id % 7)::INT AS status,
        TIMESTAMP '2024-01-01' + to_hours(doc_id) AS expire_time, TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS create_time, text FROM documents""",
    "members_": """SELECT DISTINCT event_id % 20 AS kb_id, user_id,
        max(CASE event_type WHEN 'purchase' THEN 'OWNER' WHEN 'click' THEN 'EDITOR' ELSE 'VIEWER' END) AS role FROM events GROUP BY ALL""",
    "order_members_": "SELECT l_orderkey AS kb_id, l_suppkey AS user_id, max(CASE WHEN l_returnflag = 'R' THEN 'OWNER' ELSE 'EDITOR' END) AS role FROM lineitem GROUP BY ALL",
    "tasks_": """SELECT o_orderkey AS id, 'EMB' || o_orderkey AS task_no, o_custkey AS document_id,
        CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 WHEN 'F' THEN 2 ELSE 3 END AS status, o_orderdate AS create_time FROM orders""",
    "task_documents_": "SELECT c_custkey AS id, c_nationkey AS kb_id, c_name AS file_name FROM customer",
    "bases_": "SELECT n_nationkey AS kb_id, n_name AS kb_name, n_regionkey AS create_user FROM nation WHERE n_nationkey <> 3",
    "creators_": "SELECT r_regionkey AS user_id, CASE WHEN r_regionkey % 2 = 0 THEN '  ' ELSE lower(r_name) END AS nickname, CASE WHEN r_regionkey = 4 THEN NULL ELSE r_name END AS username FROM region",
    "user_role_": "SELECT c_custkey AS user_id, c_nationkey AS role_id FROM customer",
    "role_": "SELECT n_nationkey AS role_id, CASE WHEN n_nationkey = 0 THEN 'ADMIN' ELSE n_name END AS code, n_regionkey AS sort FROM nation UNION ALL SELECT 99, 'NOBODY', 9",
    "role_permission_": "SELECT n_nationkey AS role_id, n_regionkey AS permission_id FROM nation",
    "permission_": "SELECT r_regionkey AS permission_id, r_name AS code, (r_regionkey <> 2)::INT AS status FROM region",
    "chunks_": """SELECT doc_id AS document_id, (i - 1)::BIGINT AS chunk_index, lines[i] AS content FROM
        (SELECT doc_id, string_split(text, chr(10)) AS lines, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents)""",
}


def with_(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + " "


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, sf_dir) -> DataFrame:
    base = F.lit("2024-01-01").cast("timestamp_ntz")
    zero = F.lit(0)
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("kb_id"), F.col("lang").alias("file_name"), F.col("doc_id").alias("version"),
        (F.col("doc_id") % 7).cast("int").alias("status"), (base + F.make_dt_interval(zero, F.col("doc_id").cast("int"))).alias("expire_time"),
        (base + F.make_dt_interval(zero, zero, F.col("doc_id").cast("int"))).alias("create_time"), F.lit(1).alias("is_active"), "text",
    )


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def members(spark, sf_dir) -> DataFrame:
    role = F.when(F.col("event_type") == "purchase", "OWNER").when(F.col("event_type") == "click", "EDITOR").otherwise("VIEWER")
    rows = read(spark, sf_dir, "events").select((F.col("event_id") % 20).alias("kb_id"), "user_id", role.alias("role"))
    return rows.groupBy("kb_id", "user_id").agg(F.max("role").alias("role"))


def order_members(spark, sf_dir) -> DataFrame:
    """Orders as knowledge bases and suppliers as their members, of whom often one only is an owner."""
    role = F.when(F.col("l_returnflag") == "R", "OWNER").otherwise("EDITOR")
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("kb_id"), F.col("l_suppkey").alias("user_id"), role.alias("role"))
    return rows.groupBy("kb_id", "user_id").agg(F.max("role").alias("role"))


def tasks(spark, sf_dir) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "P", 1).when(F.col("o_orderstatus") == "F", 2).otherwise(3)
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("EMB"), F.col("o_orderkey").cast("string")).alias("task_no"),
        F.col("o_custkey").alias("document_id"), status.alias("status"), F.col("o_orderdate").alias("create_time"),
    )


def task_documents(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("kb_id"), F.col("c_name").alias("file_name"))


def bases(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "nation").where("n_nationkey <> 3").select(F.col("n_nationkey").alias("kb_id"), F.col("n_name").alias("kb_name"), F.col("n_regionkey").alias("create_user"))


def creators(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "region").select(
        F.col("r_regionkey").alias("user_id"), F.when(F.col("r_regionkey") % 2 == 0, "  ").otherwise(F.lower("r_name")).alias("nickname"),
        F.when(F.col("r_regionkey") == 4, None).otherwise(F.col("r_name")).alias("username"),
    )


def user_role(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("role_id"))


def role(spark, sf_dir) -> DataFrame:
    code = F.when(F.col("n_nationkey") == 0, "ADMIN").otherwise(F.col("n_name"))
    rows = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("role_id"), code.alias("code"), F.col("n_regionkey").alias("sort"))
    return rows.union(spark.createDataFrame([(99, "NOBODY", 9)], "role_id int, code string, sort int"))


def role_permission(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("role_id"), F.col("n_regionkey").alias("permission_id"))


def permission(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "region").select(
        F.col("r_regionkey").alias("permission_id"), F.col("r_name").alias("code"), (F.col("r_regionkey") != 2).cast("int").alias("status")
    )


def chunks(spark, sf_dir) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("chunk_index", "content"))
    return rows.withColumn("chunk_index", F.col("chunk_index").cast("long"))
