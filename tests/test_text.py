"""Hand-made cases of headings, chunking, citations and names."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorespark.functions import chunking, models
from lorespark.functions import text as T


def one(spark, column, **values):
    frame = spark.range(1)
    for name, value in values.items():
        frame = frame.withColumn(name, F.lit(value))
    return frame.select(column).first()[0]


@pytest.mark.parametrize(
    "line, depth",
    [("1. 概述", 1), ("3.2.1 考勤", 3), ("1.2.3.4 x", 3), ("第一章 总则", 1), ("第三节 休假", 2), ("第五条 请假", 3), ("公司考勤管理办法", -1), ("这是正文。", None), ("A", None), ("hello world", None), ("12", 1), ("《考勤办法》", None), ("考勤“办法”", None), ("考勤（办法）", None), ("\u3000 2.1 考勤\r", 2), ("\t公司制度\r", -1), ("1" + "x" * 40, None)],
)
def test_heading_depth(spark, line, depth):
    assert one(spark, T.heading_depth(F.col("t")), t=line) == depth


def test_heading_chains_and_asof(spark):
    found = one(spark, T.headings(F.col("t")), t="1 A\n1.2 B\n2 C")
    assert [h.chain for h in found] == ["1 A", "1 A > 1.2 B", "2 C"]
    assert one(spark, T.headings(F.col("t")), t="\t1 A\r\nbody\n\u3000第一章 总则")[0].title == "1 A"
    deep = one(spark, T.headings(F.col("t")), t="标题甲\n标题乙\n标题丙\n标题丁")
    assert [h.depth for h in deep] == [1, 2, 3, 3] and deep[-1].chain == "标题甲 > 标题乙 > 标题丁"
    frame = spark.createDataFrame([([(5, "A"), (40, "B")], s) for s in (0, 5, 39, 90, None)], "h array<struct<offset:int,chain:string>>, s int")
    assert [r[0] for r in frame.select(T.heading_at(F.col("h"), F.col("s"))).collect()] == ["A", "A", "A", "B", "A"]
    assert one(spark, T.with_heading(F.col("t"), F.col("c")), t="x", c="A > B") == "【A > B】x"


def test_segments_and_merging():
    parts = chunking.segments("a" * 24 + "\n\nbb\n\n" + "c" * 24)
    assert [(len(t), s) for t, s in parts] == [(28, 0), (25, 30)]
    assert chunking.merge_groups([100, 300, 50, 1500, 200], [0, 0.2, 0.1, 0.9, 0.1]) == [0, 0, 1, 1, 2]
    embed = models.hashing_embedder()
    assert chunking.page_chunks("x" * 5000, embed) == [("x" * 5000, 0)] and chunking.page_chunks("", embed) == [("", 0)]
    long = "\n\n".join("word " * 200 for _ in range(6))
    assert "".join(t for t, _ in chunking.page_chunks(long, embed)).replace("\n", "").replace(" ", "") == "word" * 1200


def test_chunk_pages(spark):
    pages = spark.createDataFrame([(1, 1, "1 A\n\n" + "text " * 10), (1, 2, None), (2, 1, "")], "document_id long, page_no int, text string")
    got = {(r.document_id, r.chunk_index): r.content for r in chunking.chunk_pages(pages).collect()}
    assert set(got) == {(1, 0), (1, 1), (2, 0)} and got[1, 0].startswith("【1 A】")


def test_citations(spark):
    answer = "x[来源4]y[来源2]z[来源9]w[来源2]"
    cited = one(spark, T.citations(F.col("a"), F.lit(5)), a=answer)
    assert cited == [2, 4]
    assert one(spark, T.renumber(F.col("a"), F.array(F.lit(2), F.lit(4))), a=answer) == "x[来源2]y[来源1]z[来源9]w[来源1]"


def test_padded_citations(spark):
    answer = "x[来源02] y[来源3]z[来源99999999999][来源0]"
    cited = one(spark, T.citations(F.col("a"), F.lit(3)), a=answer)
    assert cited == [2, 3]
    assert one(spark, T.renumber(F.col("a"), F.array(F.lit(2), F.lit(3))), a=answer) == "x[来源1] y[来源2]z[来源99999999999][来源0]"


def test_friendly_errors(spark):
    say = lambda m: one(spark, T.friendly_error(F.col("m"), F.lit("ValueError")), m=m)
    assert say("call to dashscope timed out") == say("Embedding x") == T.EMBEDDING_ERROR and say("EMBEDDING x") == "EMBEDDING x"
    assert say(" \t") == "ValueError" and say("y" * 201) == "y" * 200 + "..."


def test_token_split_loses_no_text():
    text = "".join(f"Sentence number {i} of a long part. " for i in range(200))
    parts = chunking.token_split(text, 300)
    assert " ".join(parts) == text.strip() and all(p.endswith(".") for p in parts)
    assert chunking.token_split("ab") == [] and chunking.token_split("tail of 23 characters..") == ["tail of 23 characters.."]
    encode, decode = (lambda t: t.split(" ")), (lambda t: " ".join(t))
    assert chunking.token_split("one two three four five six", 3, tokenizer=(encode, decode)) == ["one two three", "four five six"]


def test_names_and_snippets(spark):
    assert one(spark, T.safe_name(F.col("n")), n="报 告(v1).PDF") == "报_告_v1_" and one(spark, T.extension(F.col("n")), n="报 告(v1).PDF") == "pdf"
    assert one(spark, T.safe_name(F.lit(None).cast("string"))) == "unknown" and one(spark, T.safe_name(F.col("n")), n="a b") == "a_b"
    assert one(spark, T.snippet(F.col("t")), t="x" * 121) == "x" * 120 + "..." and one(spark, T.snippet(F.col("t")), t="x" * 120) == "x" * 120


def test_models():
    calls = []

    def flaky(texts):
        calls.append(len(texts))
        if len(calls) == 1:
            raise ConnectionError
        return np.ones((len(texts), 2))

    assert models.batched(flaky, sleep=lambda s: None)(["a"] * 23).shape == (23, 2) and calls == [10, 10, 10, 3]
    assert models.safe(lambda s, u: 1 / 0)("", "") == models.DEGRADED and models.safe(lambda s, u: " ok ")("", "") == "ok"
    assert models.extractive_chat("", "[来源1] 文档：a，第1页\nfirst line\nmore\n\n") == "first line[来源1]"


def test_display_formats(spark):
    from lorespark.functions.text import duration, escape_html

    got = spark.createDataFrame([("<a href=\"x\">it's & that</a>",), (None,)], "t string").select(escape_html(F.col("t"))).collect()
    assert [r[0] for r in got] == ["&lt;a href=&quot;x&quot;&gt;it&#39;s &amp; that&lt;/a&gt;", ""]

    def wanted(ms):
        """To the nearest tenth of the exact binary number, halves up."""
        from decimal import ROUND_HALF_UP, Decimal

        return "-" if ms is None else f"{Decimal(ms / 1000).quantize(Decimal('0.1'), ROUND_HALF_UP)}s"

    values = [None, 0, 49, 50, 149, 250, 350, 450, 1250, 12_345, 86_399_950, 2**53 - 1, *range(0, 60_000, 50)]
    rows = spark.createDataFrame([(v,) for v in values], "ms long").select("ms", duration(F.col("ms"))).collect()
    assert {r[0]: r[1] for r in rows} == {v: wanted(v) for v in values}
