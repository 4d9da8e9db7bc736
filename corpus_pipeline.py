"""Corpus preparation in stages: each works on all that its predecessor kept.

Stages take (spark, docs, sf_dir). All but the last return the columns of documents. They decide by row, which doc_id
and a hash of the text name: rows that repeat a doc_id or have none keep their own texts. A null doc_id counts as the
largest in near dedup and for repeated bytes, and as the smallest in exact dedup. Of rows that repeat a doc_id and text one stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.llm import exact_dedup, packing, quality_classifier, simhash, suffix_dedup
from lorespark.llm.common import MAX_ID, materialize, read


def text_key(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def one_each(rows: DataFrame, *keys: str) -> DataFrame:
    """The smallest row of each key, so that a repeated attempt finds the same."""
    rest = [c for c in rows.columns if c not in keys]
    if not rest:
        return rows.distinct()
    return rows.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row")).select(*keys, "_row.*")


def chosen(docs: DataFrame, key: Column, kept: DataFrame) -> DataFrame:
    """One row of docs for each (doc_id, key) in kept."""
    kept = kept.select(F.col("doc_id").alias("_id"), F.col("_sha").alias("_kept"))
    rows = docs.withColumn("_sha", key)
    rows = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_sha") == F.col("_kept")), "left_semi")
    return one_each(rows, "doc_id", "_sha").select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from docs and the labels table.

    Null texts count as empty and are scored like any other; repeated and null doc_ids are rows of their own. Without usable
    labels every score is one half and all stay. No documents give none.
    """
    found = quality_classifier.classify(docs, read(spark, sf_dir, "labels"))
    return found.where("predicted = 1").select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id, or one without where no row has any."""
    kept = exact_dedup.exact_dedup(docs).where("kept").select("doc_id", F.col("text_sha256").alias("_sha"))
    return chosen(docs, F.sha2(exact_dedup.normalised(F.col("text")), 256), kept)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the row with the smallest doc_id, and of these the smallest hash of its text.

    Texts without words have one fingerprint, so of them (null ones too) one stays. A null doc_id counts as the largest.
    """
    prints, named = simhash.linked(docs.withColumn("_sha", text_key(F.col("text"))), carry=("_sha",))
    first = prints.join(named, "print").groupBy("component").agg(F.min(F.struct("doc_id", "_sha")).alias("first"))
    kept = first.select(F.nullif("first.doc_id", F.lit(MAX_ID)).alias("doc_id"), "first._sha")
    return chosen(docs, text_key(F.col("text")), kept)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the byte strings that documents with smaller ids hold; texts may become empty.

    A character that a cut runs through becomes U+FFFD.
    """
    cut = suffix_dedup.suffix_dedup(docs).select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_key"), F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))
    cut = cut.withColumn("n_chars", F.length("text").cast("long"))
    rest = one_each(docs.withColumn("_sha", text_key(F.col("text"))).drop("text", "n_chars"), "doc_id", "_sha")
    return cut.join(rest, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_sha") == F.col("_key"))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece, its end id. Repeated and null doc_ids are documents of their own.
    """
    return packing.packed_digest(docs)


STAGES = [
    ("quality_classifier", quality),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("suffix_array_dedup", repeats),
    ("best_fit_packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, with the documents that each keeps written to the shared folder."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
