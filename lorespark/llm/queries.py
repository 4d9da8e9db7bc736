"""The registered query of each corpus operator, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorespark.sources.work import spread

from . import collocations, exact_dedup, fm_index, licenses, packing, pieces, ppm, quality_classifier, quality_rules, quotations, simhash, suffix_dedup, vector_codes
from .common import read


def documents(spark, sf_dir):
    """documents for operators that work where rows are read: in as many tasks as there are cores."""
    return spread(read(spark, sf_dir, "documents"))


def op1_best_fit_packing(spark, sf_dir):
    return packing.packed_digest(documents(spark, sf_dir))


def op2_suffix_array_dedup(spark, sf_dir):
    cut = suffix_dedup.suffix_dedup(read(spark, sf_dir, "documents"))
    return cut.select(
        "doc_id", F.col("n_units").alias("n_bytes"), "n_removed",
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def op3_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


def op4_substring_dedup(spark, sf_dir):
    cut = fm_index.substring_dedup(read(spark, sf_dir, "documents"))
    return cut.select("doc_id", F.col("n_units").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_ppm_scoring(spark, sf_dir):
    return ppm.score(read(spark, sf_dir, "documents"))


def op6_quality_rules(spark, sf_dir):
    return quality_rules.rules(documents(spark, sf_dir), read(spark, sf_dir, "labels"))


def op7_quotation_linking(spark, sf_dir):
    return quotations.link_replies(read(spark, sf_dir, "conversations"))


def quoted_replies(spark, sf_dir):
    """op7's operator on conversations that quote: the test tables' own messages don't."""
    return quotations.link_replies(quotations.quoting(read(spark, sf_dir, "conversations")))


def op8_quality_classifier(spark, sf_dir):
    found = quality_classifier.classify(documents(spark, sf_dir), read(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


def op9_sentencepiece(spark, sf_dir):
    made = pieces.encode_decode(documents(spark, sf_dir))
    text = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    return made.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(text, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_simhash_near_dedup(spark, sf_dir):
    found = simhash.near_dedup(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def op11_vector_codes(spark, sf_dir):
    return vector_codes.with_label_errors(*vector_codes.compress(spread(read(spark, sf_dir, "embeddings"))))


def op12_license_scans(spark, sf_dir):
    return licenses.scan(documents(spark, sf_dir))


def op13_phrase_collocations(spark, sf_dir):
    return collocations.collocations(documents(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_suffix_array_dedup,
        op3_exact_dedup,
        op4_substring_dedup,
        op5_ppm_scoring,
        op6_quality_rules,
        op7_quotation_linking,
        op8_quality_classifier,
        op9_sentencepiece,
        op10_simhash_near_dedup,
        op11_vector_codes,
        op12_license_scans,
        op13_phrase_collocations,
        quoted_replies,
    )
}

ORACLES: dict[str, str] = {
    "op3_exact_dedup": f"""
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, translate(coalesce(text, ''), '{exact_dedup.UPPER}', '{exact_dedup.LOWER}') AS t FROM documents)
        WINDOW same AS (PARTITION BY t)""",
    "op7_quotation_linking": quotations.ORACLE,
    "op11_vector_codes": vector_codes.ORACLE,
    "op12_license_scans": licenses.ORACLE,
    "op13_phrase_collocations": collocations.ORACLE,
    "quoted_replies": quotations.QUOTING_ORACLE,
}
