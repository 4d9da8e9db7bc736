"""Semantic chunking in column functions: paragraphs, a fold that merges them by topic and length, and a split of what is too long."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .chunking import CHUNK_TOKENS, MAX_CHARS, MIN_CHARS, MIN_PART, MIN_SEGMENT, SIMILARITY
from .text import SPACE, content_hash, heading_at, headings, strip, with_heading
from .vectors import cosine

SEGMENT = "struct<text:string,offset:int>"
#: Characters that CHUNK_TOKENS tokens are taken for: three for two tokens. A tokenizer's own counts need ``chunk_pages``.
PIECE = CHUNK_TOKENS * 3 // 2
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def none_of(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def paragraphs(text: Column, min_chars: int = MIN_SEGMENT) -> Column:
    """array<struct<text, offset>> of a page's paragraphs, which blank lines end; short ones are joined to the one before."""

    def put(acc: Column) -> Column:
        """The paragraphs with the lines gathered so far."""
        short = (F.size(acc["out"]) > 0) & (F.length(acc["part"]) < min_chars)
        last = F.element_at(acc["out"], -1)
        longer = F.array(F.struct(F.concat(last["text"], acc["part"]).alias("text"), last["offset"].alias("offset")))
        own = F.array(F.struct(acc["part"].alias("text"), acc["start"].alias("offset")))
        return F.when(acc["part"] == "", acc["out"]).when(short, F.concat(F.slice(acc["out"], 1, F.size(acc["out"]) - 1), longer)).otherwise(F.concat(acc["out"], own))

    def step(acc: Column, line: Column) -> Column:
        blank = line.rlike(f"^{SPACE}*$")
        return F.struct(
            (acc["at"] + F.length(line) + 1).alias("at"),
            F.when(acc["part"] == "", acc["at"]).otherwise(acc["start"]).alias("start"),
            F.when(blank, "").otherwise(F.concat(acc["part"], line, F.lit("\n"))).alias("part"),
            F.when(blank, put(acc)).otherwise(acc["out"]).alias("out"),
        )

    begin = F.struct(F.lit(0).alias("at"), F.lit(0).alias("start"), F.lit("").alias("part"), none_of(SEGMENT).alias("out"))
    return F.aggregate(F.split(text, "\n"), begin, step, put)


def merged(parts: Column, near: Column, threshold: float = SIMILARITY, min_chars: int = MIN_CHARS, max_chars: int = MAX_CHARS) -> Column:
    """The paragraphs (text, offset) put together: a new group where the topic turns and enough is gathered, or where it would get too long.

    near has the likeness of each paragraph to the one before; the first one's counts for nothing.
    """
    rows = F.zip_with(parts, near, lambda p, s: F.struct(p["text"].alias("text"), p["offset"].alias("offset"), s.alias("near")))

    def step(acc: Column, row: Column) -> Column:
        n = F.length(row["text"])
        turn = (acc["size"] >= 0) & (((row["near"] < threshold) & (acc["size"] >= min_chars)) | (acc["size"] + n > max_chars))
        done = F.concat(acc["out"], F.array(F.struct(acc["text"].alias("text"), acc["offset"].alias("offset"))))
        first = acc["size"] < 0
        return F.struct(
            F.when(first | turn, n).otherwise(acc["size"] + n).alias("size"),
            F.when(first | turn, row["text"]).otherwise(F.concat(acc["text"], row["text"])).alias("text"),
            F.when(first | turn, row["offset"]).otherwise(acc["offset"]).alias("offset"),
            F.when(turn, done).otherwise(acc["out"]).alias("out"),
        )

    begin = F.struct(F.lit(-1).alias("size"), F.lit("").alias("text"), F.lit(0).alias("offset"), none_of(SEGMENT).alias("out"))
    last = lambda acc: F.when(acc["size"] < 0, acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(acc["text"].alias("text"), acc["offset"].alias("offset")))))
    return F.aggregate(rows, begin, step, last)


def pieces(text: Column, size: int = PIECE, min_chars: int = MIN_CHARS, min_part: int = MIN_PART) -> Column:
    """Pieces of at most size characters, ending after the last sentence mark where that leaves over min_chars; stripped, and very short ones dropped."""

    def step(acc: Column, _: Column) -> Column:
        rest = F.substring(text, acc["at"] + 1, F.lit(size))
        end = F.length(F.regexp_extract(rest, r"(?s)^(.*[.?!\n])", 1))
        took = F.when(end > min_chars + 1, end).otherwise(F.length(rest))
        piece = strip(F.substring(rest, F.lit(1), took))
        return F.struct((acc["at"] + took).alias("at"), F.when(F.length(piece) > min_part, F.concat(acc["out"], F.array(piece))).otherwise(acc["out"]).alias("out"))

    most = F.ceil(F.length(text) / (min_chars + 1)).cast("int")
    begin = F.struct(F.lit(0).alias("at"), none_of("string").alias("out"))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), begin, step, lambda acc: acc["out"])


def letter_counts(text: Column) -> Column:
    """A vector without a model: how often each letter of LETTERS occurs."""
    low = F.lower(text)
    return F.transform(F.array(*map(F.lit, LETTERS)), lambda c: (F.length(low) - F.length(F.replace(low, c, F.lit("")))).cast("double"))


def merge_chunks(pages: DataFrame, vector: Callable[[Column], Column] = letter_counts) -> DataFrame:
    """(document_id, page_no, text, part, chunk, chunk_start) of pages (document_id, page_no, text), part numbers the chunks of a page.

    vector gives a paragraph's vector. A blank page, or one of a single paragraph, is one chunk however long. Null text is empty. All of it is one
    pass over the rows in column functions: a page is folded where it is read.
    """
    text = F.coalesce("text", F.lit(""))
    rows = pages.select(F.col("document_id").cast("long").alias("document_id"), F.col("page_no").cast("int").alias("page_no"), text.alias("text"))
    rows = rows.withColumn("parts", paragraphs(F.col("text")))
    rows = rows.withColumn("vectors", F.transform("parts", lambda p: vector(p["text"])))
    rows = rows.withColumn("near", F.transform("vectors", lambda v, i: F.when(i > 0, cosine(v, F.get("vectors", i - 1))).otherwise(0.0)))
    rows = rows.withColumn("groups", merged(F.col("parts"), F.col("near")))
    cut = F.transform("groups", lambda g: F.transform(F.when(F.length(g["text"]) > MAX_CHARS, pieces(g["text"])).otherwise(F.array(g["text"])), lambda t: F.struct(t.alias("text"), g["offset"].alias("offset"))))
    whole = F.array(F.struct(F.col("text").alias("text"), F.lit(0).alias("offset")))
    rows = rows.withColumn("chunks", F.when(F.size("parts") <= 1, whole).otherwise(F.flatten(cut)))
    # Outer: else Spark would filter by the size of chunks first, and work all of the above out once more where it does.
    rows = rows.select("document_id", "page_no", "text", F.posexplode_outer("chunks").alias("part", "c")).where("part IS NOT NULL")
    return rows.select("document_id", "page_no", "text", "part", F.col("c.text").alias("chunk"), F.col("c.offset").alias("chunk_start"))


def chunk_pages_by_columns(pages: DataFrame, vector: Callable[[Column], Column] = letter_counts) -> DataFrame:
    """(document_id, chunk_index, page_no, content, content_hash) as by ``chunk_pages``, without a Python worker; token counts are estimates."""
    rows = merge_chunks(pages, vector)
    content = with_heading(F.col("chunk"), heading_at(headings(F.col("text")), F.col("chunk_start")))
    index = F.row_number().over(Window.partitionBy("document_id").orderBy("page_no", "part")) - 1
    rows = rows.select("document_id", "page_no", "part", content.alias("content"))
    return rows.select("document_id", index.alias("chunk_index"), "page_no", "content", content_hash(F.col("content")).alias("content_hash"))
