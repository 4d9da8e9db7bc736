"""An index for ``contains_text``: folded trigrams with the rows that have them, kept beside a table."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.sources.log import LogTable

from .lists import contains_text
from .segments import LISTED, among

#: Ids of one row of postings (about); rarest grams of a keyword that are looked up.
BLOCK, RAREST = 4096, 4
#: Latin letters that are an ASCII letter with marks, and the marks themselves, which are left out.
_LETTERS = {chr(c): unicodedata.normalize("NFD", chr(c))[0] for c in range(0xC0, 0x250) if unicodedata.normalize("NFD", chr(c))[0].isascii() and chr(c).islower()}
_MARKS = "".join(map(chr, range(0x300, 0x370)))
#: The gram of rows that have other characters: these are always looked at.
OTHER = ""


def folded(text: Column) -> Column:
    """text in lower case, letters without their marks."""
    return F.translate(F.lower(text), "".join(_LETTERS) + _MARKS, "".join(_LETTERS.values()))


def grams(text: Column) -> Column:
    """The trigrams of folded text that are plain ASCII, and OTHER if it has other characters."""
    n = F.length(text)
    every = F.when(n >= 3, F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substring(text, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))
    plain = F.filter(F.array_distinct(every), lambda g: g.rlike(r"^[\t\n\r -~]+$"))
    return F.concat(plain, F.when(text.rlike(r"[^\t\n\r -~]"), F.array(F.lit(OTHER))).otherwise(F.array().cast("array<string>")))


class ContainsIndex:
    """Which rows may contain a keyword whatever its case or accents. Rows of any script are found: what isn't folded here is always a candidate."""

    def __init__(self, spark: SparkSession, path: str):
        self.table = LogTable(spark, path)

    def create(self) -> None:
        self.table.create("gram string, part string, block int, n long, ids array<long>")

    def add(self, rows: DataFrame, id_: str, column: str) -> None:
        """Index rows; ids that come again keep their older grams too, which is harmless: candidates are verified."""
        size = rows.count()
        ids = rows.where(F.col(column).isNotNull()).select(F.col(id_).cast("long").alias("id"), F.explode(grams(folded(F.col(column)))).alias("gram"))
        blocks = ids.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-size // BLOCK)))).cast("int"))
        blocks = blocks.groupBy("gram", "block").agg(F.array_sort(F.collect_set("id")).alias("ids"))
        part = F.lit(str(self.table.state().version)) if size else F.lit("")
        self.table.append(blocks.select("gram", part.alias("part"), "block", F.size("ids").cast("long").alias("n"), "ids").repartitionByRange("gram", "block"), "gram", "block")

    def candidates(self, keyword: str) -> DataFrame | None:
        """(id) of the rows that may contain the keyword; None if that may be any, as with keywords of one or two letters."""
        spark = self.table.spark
        wanted = [g for g in spark.range(1).select(grams(folded(F.lit(keyword)))).first()[0] if g != OTHER]
        if not wanted:
            return None
        rows = self.table.read()
        sizes = {r[0]: r[1] for r in rows.where(among("gram", wanted)).groupBy("gram").agg(F.sum("n")).collect()}  # a row for each gram of the keyword
        rarest = sorted(wanted, key=lambda g: (sizes.get(g, 0), g))[:RAREST]
        blocks = rows.where(among("gram", rarest)).groupBy("part", "block").agg(F.collect_list("ids").alias("lists"))
        both = F.aggregate(F.slice("lists", 2, len(rarest)), F.element_at("lists", 1), F.array_intersect)
        found = blocks.where(F.size("lists") == len(rarest)).select(F.explode(both).alias("id"))
        return found.unionByName(rows.where(F.col("gram") == OTHER).select(F.explode("ids").alias("id"))).distinct()

    def narrowed(self, rows: DataFrame, id_: str, column: str, keyword: str | None) -> DataFrame:
        """The rows that hold the keyword, as by ``contains_text``; few candidates reach the scan as a list of ids."""
        ids = self.candidates(keyword) if keyword else None
        if ids is not None:
            some = [r[0] for r in ids.limit(LISTED + 1).collect()]
            rows = rows.where(among(id_, some)) if len(some) <= LISTED else rows.join(ids.withColumnRenamed("id", id_), id_, "left_semi")
        return rows.where(contains_text(F.col(column), keyword))
