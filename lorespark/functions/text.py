"""Text functions over columns: headings, names, snippets, citations, messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line endings that no heading has, and how headings start.
CLOSING = "。！？；，、,.;:!?"
NUMBERED = r"^\s*(\d+(?:\.\d+)*)\s*[.、．:：)）]?\s*"
CHAPTER = r"^\s*第[一二三四五六七八九十百千万\d]+([章节篇部部分条])"
MAX_DEPTH = 3
#: Fixed value: marks that no unnumbered heading has anywhere.
MARKS = "。！？；，、,.;:!?（）()「」『』《》〈〉\"'“”‘’"
#: White space but for no-break blanks, as titles are stripped of it.
SPACE = r"[\t-\r\x1c-\x1f\p{Z}&&[^\u00a0\u2007\u202f]]"
#: The message shown for failures of the embedding service, and what tells them.
EMBEDDING_ERROR = "向量化服务暂时不可用，请稍后重试"
EMBEDDING_MARKS = ("DashScope", "dashscope", "embedding", "Embedding")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def heading_depth(line: Column) -> Column:
    """1 to 3 for numbered and chapter headings, -1 for unnumbered ones in Han characters, else null."""
    text = strip(line)
    number, chapter = F.regexp_extract(text, NUMBERED, 1), F.regexp_extract(text, CHAPTER, 1)
    dots = F.length(number) - F.length(F.replace(number, F.lit("."), F.lit("")))
    fits = F.length(text).between(2, 40) & ~text.rlike(f"[{CLOSING}]$")
    depth = (
        F.when(number != "", F.least(dots + 1, F.lit(MAX_DEPTH)))
        .when(chapter != "", F.when(chapter == "节", 2).when(chapter == "条", 3).otherwise(1))
        .when(text.rlike(r"\p{IsHan}") & ~text.rlike(f"[{MARKS}]"), -1)
    )
    return F.when(fits, depth)


def headings(text: Column) -> Column:
    """array<struct<offset, depth, title, chain>> of a page; a chain joins the titles above by ``>``."""
    mark = "struct<offset:int,depth:int,title:string>"

    def note(acc: Column, line: Column) -> Column:
        depth = heading_depth(line)
        own = F.array(F.struct(acc["pos"].alias("offset"), depth.alias("depth"), strip(line).alias("title")))
        return F.struct((acc["pos"] + F.length(line) + 1).alias("pos"), F.when(depth.isNull(), acc["found"]).otherwise(F.concat(acc["found"], own)).alias("found"))

    none = F.array().cast(f"array<{mark}>")
    # Most pages have no line that could be a heading; those are told by one pattern.
    maybe = text.rlike(r"(?m)^[\s\p{Z}\x1c-\x1f]*[\d第]|\p{IsHan}")
    seen = F.aggregate(F.split(text, "\n"), F.struct(F.lit(0).alias("pos"), none.alias("found")), note, lambda acc: acc["found"])
    found = F.when(maybe, seen).otherwise(none)
    item = "struct<depth:int,title:string>"
    row = "struct<offset:int,depth:int,title:string,chain:string>"
    start = F.struct(F.array().cast(f"array<{item}>").alias("stack"), F.array().cast(f"array<{row}>").alias("out"))

    def push(acc: Column, h: Column) -> Column:
        above = F.coalesce(F.try_element_at(acc["stack"], F.lit(-1))["depth"], F.lit(0))
        depth = F.when(h["depth"] == -1, F.least(above + 1, F.lit(MAX_DEPTH))).otherwise(h["depth"])
        stack = F.concat(F.filter(acc["stack"], lambda s: s["depth"] < depth), F.array(F.struct(depth.alias("depth"), h["title"].alias("title"))))
        chain = F.array_join(F.transform(stack, lambda s: s["title"]), " > ")
        own = F.struct(h["offset"].alias("offset"), depth.alias("depth"), h["title"].alias("title"), chain.alias("chain"))
        return F.struct(stack.alias("stack"), F.concat(acc["out"], F.array(own)).alias("out"))

    return F.when(F.size(found) > 0, F.aggregate(found, start, push, lambda acc: acc["out"])).otherwise(F.array().cast(f"array<{row}>"))


def heading_at(found: Column, start: Column) -> Column:
    """The chain of the last heading at or before start; of the first one if there is none, or without a start."""
    before = F.filter(found, lambda h: h["offset"] <= start)
    return F.coalesce(F.try_element_at(before, F.lit(-1)), F.try_element_at(found, F.lit(1)))["chain"]


def with_heading(text: Column, chain: Column) -> Column:
    return F.when(F.trim(F.coalesce(chain, F.lit(""))) == "", text).otherwise(F.concat(F.lit("【"), chain, F.lit("】"), text))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def snippet(text: Column, size: int = 120) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def safe_name(name: Column) -> Column:
    """The file name without extension, for paths."""
    base = F.when(name.contains("."), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)
    return F.coalesce(F.substring(F.regexp_replace(base, r"[^一-龥a-zA-Z0-9_\-]", "_"), 1, 100), F.lit("unknown"))


def extension(name: Column) -> Column:
    return F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1))).otherwise("")


def object_path(kb: Column, day: Column, doc_id: Column, name: Column) -> Column:
    return F.format_string("%s/%s/%d_%s.%s", kb.cast("string"), F.date_format(day, "yyyy/MM/dd"), doc_id, safe_name(name), extension(name))


def page_number(page_number: Column, page: Column, chunk_index: Column) -> Column:
    return F.coalesce(page_number, page, chunk_index)


def strip_marks(answer: Column) -> Column:
    return F.regexp_replace(answer, r"\*\*|`", "")


def citations(answer: Column, n_sources: Column) -> Column:
    """Sorted distinct numbers that the answer cites, of those from 1 to n_sources."""
    found = F.transform(F.regexp_extract_all(answer, F.lit(r"\[来源(\d+)\]"), F.lit(1)), lambda s: s.try_cast("int"))
    return F.array_sort(F.array_distinct(F.filter(found, lambda n: (n >= 1) & (n <= n_sources))))


def renumber(answer: Column, cited: Column) -> Column:
    """The answer with its citations numbered from 1 without gaps, by their number however it is written; others stay as they are."""
    mark = lambda n: F.concat(F.lit("[来源"), n.cast("string"), F.lit("]"))
    digits = F.regexp_extract_all(answer, F.lit(r"\[来源(\d+)\]"), F.lit(1))
    place = lambda d: F.array_position(cited, d.try_cast("int"))
    marks = F.transform(digits, lambda d: F.when(place(d) > 0, mark(place(d))).otherwise(mark(d)))
    between = F.split(answer, r"\[来源\d+\]", -1)
    return F.array_join(F.zip_with(between, marks, lambda text, m: F.concat(text, F.coalesce(m, F.lit("")))), "")


def friendly_error(message: Column, error: Column | None = None, marks: tuple[str, ...] = EMBEDDING_MARKS, size: int = 200) -> Column:
    """What a user is told: a fixed message where one of the marks is in it, in this spelling, else its first size characters.

    In place of a null or blank message comes error, the text of the failure itself.
    """
    found = F.coalesce(message.rlike("|".join(marks)), F.lit(False))
    blank = message.isNull() | (strip(message) == "")
    shown = message if error is None else F.when(blank, error).otherwise(message)
    cut = F.when(F.length(shown) > size, F.concat(F.substring(shown, 1, size), F.lit("..."))).otherwise(shown)
    return F.when(found, EMBEDDING_ERROR).otherwise(cut)


def md5(text: Column) -> Column:
    return F.md5(F.encode(text, "UTF-8"))


def task_number(time: Column, random: Column) -> Column:
    """The number of a task: a prefix, its time in milliseconds, and the first eight hex digits of a random id."""
    return F.concat(F.lit("EMB"), F.unix_millis(time.cast("timestamp")).cast("string"), F.substring(F.replace(random, F.lit("-"), F.lit("")), 1, 8))


def file_size(size: Column) -> Column:
    kb, mb = size / 1024, size / (1024 * 1024)
    return F.when(size < 1024, F.format_string("%d B", size)).when(size < 1024 * 1024, F.format_string("%.1f KB", kb)).otherwise(F.format_string("%.1f MB", mb))


def escape_html(text: Column) -> Column:
    """text for the inside of an HTML page; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(mark), F.lit(name))
    return out


def duration(ms: Column) -> Column:
    """Milliseconds as seconds with one digit, as ``12.3s``; ``-`` for null.

    Halves are rounded by the binary number that the seconds are, upwards if it is the half itself or above: 0.25 is 0.3 and 0.35, a little below, is 0.3 too.
    """
    n = F.abs(ms.cast("long"))
    x = n / F.lit(1000.0)
    # What 1000 x is beyond n, without an error: x in two halves of its digits.
    wide = x * 134217729.0
    high = wide - (wide - x)
    product = x * 1000.0
    beyond = (product - n) + ((high * 1000.0 - product) + (x - high) * 1000.0)
    tenths = F.floor(n / 100) + F.when((n % 100 > 50) | ((n % 100 == 50) & (beyond >= 0)), 1).otherwise(0)
    sign = F.when((ms < 0) & (n > 0), "-").otherwise("")
    text = F.concat(sign, F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("s"))
    return F.coalesce(text, F.lit("-"))
