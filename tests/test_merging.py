"""Chunking in column functions against the folds over one page."""

import re

import numpy as np
from pyspark.sql import functions as F

from lorespark.functions import chunking, merging

WORDS = "lorem ipsum dolor sit amet consectetur zzz qqq xyz "
PAGES = [
    "", None, " \n\t\n", "one line", "a" * 24 + "\n\nbb\n\n" + "c" * 24, "ab\n\ncd\n\n" + "x" * 2000, "x" * 5000, "\n\n1 Title\nfirst line of it. \n 　\n" + WORDS * 3,
    "\n\n".join((WORDS if i % 3 else "aaa bbb eee iii ") * (i % 7 + 1) for i in range(40)), "\n\n".join(("word. " * 60 + "tail") for _ in range(30)),
    ("sentence one! " * 200) + "\n\n" + ("no marks here " * 300) + "\n\nshort\n\n" + "e" * 1601,
]


def brute(text):
    text = text or ""
    parts = chunking.segments(text)
    if len(parts) <= 1:
        return [(text, 0)]
    v = [np.array([t.lower().count(c) for c in merging.LETTERS], float) for t, _ in parts]
    cos = lambda a, b: float(a @ b) / (np.sqrt(a @ a) * np.sqrt(b @ b)) if a.any() and b.any() else 0.0
    groups = chunking.merge_groups([len(t) for t, _ in parts], [0.0, *(cos(a, b) for a, b in zip(v[1:], v))])
    out = []
    for g in range(groups[-1] + 1):
        own = [p for p, h in zip(parts, groups) if h == g]
        joined = "".join(t for t, _ in own)
        if len(joined) <= chunking.MAX_CHARS:
            out.append((joined, own[0][1]))
            continue
        at = 0
        while at < len(joined):
            rest = joined[at : at + merging.PIECE]
            stop = max(rest.rfind(c) for c in ".?!\n")
            took = stop + 1 if stop > chunking.MIN_CHARS else len(rest)
            if len(rest[:took].strip()) > chunking.MIN_PART:
                out.append((rest[:took].strip(), own[0][1]))
            at += took
    return out


def test_pages_brute(spark):
    pages = spark.createDataFrame([(i, 1, t) for i, t in enumerate(PAGES)], "document_id long, page_no int, text string")
    got = {}
    for r in merging.merge_chunks(pages).orderBy("document_id", "part").collect():
        got.setdefault(r.document_id, []).append((r.chunk, r.chunk_start))
    assert got == {i: brute(t) for i, t in enumerate(PAGES)}


def test_paragraphs(spark):
    rows = spark.createDataFrame([(t or "",) for t in PAGES], "t string").select("t", merging.paragraphs(F.col("t")).alias("p")).collect()
    assert all([tuple(x) for x in r.p] == chunking.segments(r.t) for r in rows)


def test_headings_and_no_python(spark):
    pages = spark.createDataFrame([(1, 2, "1 Alpha\n\n" + "some text about alpha. " * 3), (1, 1, "plain"), (2, 1, None)], "document_id long, page_no int, text string")
    made = merging.chunk_pages_by_columns(pages)
    assert not re.search("Python|Pandas|InArrow", made._jdf.queryExecution().executedPlan().toString())
    got = {(r.document_id, r.chunk_index): (r.page_no, r.content) for r in made.collect()}
    assert got[1, 0] == (1, "plain") and got[2, 0] == (1, "")
    assert [c for (d, i), (_, c) in sorted(got.items()) if d == 1 and i][0].startswith("【1 Alpha】1 Alpha\n")
    assert merging.chunk_pages_by_columns(pages.limit(0)).count() == 0
