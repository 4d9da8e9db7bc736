"""Exact dedup by an extendible-hash index kept in shared files, in DataFrame functions only.

1. Every document's normalised text is hashed to 64 bits. The distinct hashes are counted by prefix, and the
   directory doubles until no bucket holds more than ``capacity`` of them (``directory``).
2. Each bucket is a range of hashes with one owner: the directory sets the task that its texts go to. There texts whose
   hashes collide are chained and told apart by comparing bytes: grouping is by bucket, hash and the text itself, which
   needs no further shuffle. Texts that very many rows hold are put together before they go to their owner, by
   map-side aggregation; there are at most ``HOT`` of them.
3. Each owner writes its range of the index to a file of its own in the shared folder, one row for each distinct text, and
   every document looks up its entry. Spark splits the lookup of a hot entry.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Distinct hashes of a bucket before it is split.
CAPACITY = 1 << 13
#: The deepest directory: a million slots, which are counted on the driver in columns and broadcast (24 bytes each).
MAX_DEPTH = 20
#: Texts that are put together before the shuffle, at most: those of over 1,000 rows, or of a larger number where there are more rows.
HOT, MANY = 100_000, 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """text with A-Z in lower case and nothing else changed; null is empty."""
    text = F.coalesce(text, F.lit(""))
    # lower() is far quicker than translate(), and the same on plain ASCII.
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def directory(counts: dict[int, int], capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> tuple[int, list[int]]:
    """The global depth and the bucket of each directory slot, from counts by max_depth-bit prefix.

    Starts with one bucket. An overfull bucket is split by one more bit; the directory doubles when a bucket
    is as deep as it. Buckets are numbered from 0 in the order of their ranges.
    """
    total = [0]  # of the prefixes before
    for p in range(1 << max_depth):
        total.append(total[-1] + counts.get(p, 0))
    depth, buckets, todo = 0, [], [(0, 0)]  # (local depth, prefix)
    while todo:
        local, prefix = todo.pop()
        span = 1 << (max_depth - local)
        if local < max_depth and total[prefix + span] - total[prefix] > capacity:
            depth = max(depth, local + 1)
            todo += [(local + 1, prefix + span // 2), (local + 1, prefix)]
        else:
            buckets.append(span)
    width = 1 << (max_depth - depth)
    return depth, [number for number, span in enumerate(buckets) for _ in range(span // width)]


def exact_dedup(docs: DataFrame, capacity: int = CAPACITY, text: str = "text", many: int = MANY) -> DataFrame:
    """docs' doc_id with keep_id, group_size, kept and text_sha256, one row for each row of docs.

    Texts are equal when their bytes are after A-Z became lower case; null text is empty. The largest doc_id
    of equal texts stays; rows that repeat it all stay, and a null doc_id stays only where its group has no
    other. Other columns are not carried.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col(text)).alias("_text"))
    rows = rows.withColumn("_hash", F.xxhash64("_text"))
    keys = materialize(rows.select("doc_id", "_hash", F.unhex(F.sha2("_text", 256)).alias("_sha")), "keys")
    copies = materialize(keys.groupBy("_hash").agg(F.count("*").alias("n")), "copies")
    size = copies.agg(F.count("*").alias("hashes"), F.sum("n").alias("rows"), F.max("n").alias("most")).first()
    # Four bits more than even buckets would need; at least two slots.
    deepest = min(MAX_DEPTH, max(1, math.ceil(math.log2(max(1, size["hashes"] / capacity))) + 4))
    prefix = F.shiftrightunsigned("_hash", 64 - deepest).cast("int")
    counts = copies.groupBy(prefix.alias("p")).agg(F.count("*").alias("n")).toArrow()  # 2^MAX_DEPTH rows at most
    depth, slots = directory(dict(zip(counts["p"].to_pylist(), counts["n"].to_pylist())), capacity, deepest)
    depth, slots = (depth, slots) if depth else (1, [0, 0])
    slot = F.shiftrightunsigned("_hash", 64 - depth).cast("int")
    table = F.broadcast(spark.createDataFrame(list(enumerate(slots)), "_slot int, _bucket int"))
    # No more than HOT texts can have as many rows as this.
    many = max(many, (size["rows"] or 0) // HOT)
    owned = rows.select("_hash", "_text", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    if (size["most"] or 0) > many:
        hot = F.broadcast(copies.where(F.col("n") > many).select("_hash"))
        together = rows.join(hot, "_hash", "left_semi").groupBy("_hash", "_text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        owned = owned.join(hot, "_hash", "left_anti").unionByName(together)
    owned = owned.withColumn("_slot", slot).join(table, "_slot").drop("_slot")
    owned = owned.repartitionById(max(slots) + 1, F.col("_bucket"))
    chains = owned.groupBy("_bucket", "_hash", "_text").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    index = materialize(chains.select("_bucket", "_hash", F.unhex(F.sha2("_text", 256)).alias("_sha"), "keep_id", "group_size"), "index")
    found = keys.join(index, ["_hash", "_sha"])
    return found.select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )
