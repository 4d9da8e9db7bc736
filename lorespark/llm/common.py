"""Helpers shared by the corpus operators: work tables, tokenizer paths and document blocks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.sources.work import written

MAX_ID = (1 << 63) - 1
#: Spark's setting by which a query's shuffle files are removed when it has ended.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to a new table in the shared folder and read it back: cuts lineage and survives lost executors.

    Shuffle files of the write go with its end, and the table when the driver ends, however the job ended.
    """
    spark = df.sparkSession
    before = spark.conf.get(CLEAN_UP)
    spark.conf.set(CLEAN_UP, "true")
    try:
        return written(df, name)
    finally:
        spark.conf.set(CLEAN_UP, before)


def tokenizer_path(name: str) -> str:
    """Default place of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def in_blocks(docs: DataFrame, block_bytes: int, min_blocks: int = 64) -> tuple[DataFrame, int]:
    """(doc_id, text as bytes, block) dealt into blocks of about block_bytes of text, a partition each, and their number.

    Blocks are dealt by a hash of the id and the text, so a hot source, a run of long documents, a repeated id or
    rows without one spread evenly, and each doubles as the unit whose contents are pre-aggregated before anything
    is shuffled by content. Null text becomes the empty text; extra columns are not carried.
    """
    size = docs.select(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = max(min_blocks, math.ceil(size / block_bytes))
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.encode(text, "UTF-8").alias("text"),
        F.pmod(F.xxhash64("doc_id", text, F.lit("block")), F.lit(n)).cast("int").alias("block"),
    )
    return out.repartitionById(n, F.col("block")), n
