"""Document files: reading pages with a pluggable parser, OCR fallback, and object storage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGES = "path string, page_number int, end_page_number int, file_name string, text string, ocr boolean"
#: Texts of fewer characters count as scanned pages.
MIN_TEXT = 20

#: From a file's bytes to the text of each of its pages.
Parser = Callable[[bytes], list[str]]


def text_parser(content: bytes) -> list[str]:
    """Pages of a plain text: parts between form feeds."""
    return content.decode("utf-8", "replace").split("\f")


PARSERS: dict[str, Parser] = {"txt": text_parser}


def extension(name: str) -> str:
    return name.rpartition(".")[2].lower() if "." in name else ""


def read_pages(spark: SparkSession, path: str, parsers: dict[str, Parser] | None = None, ocr: Callable[[bytes, int], str] | None = None) -> DataFrame:
    """One row for each page of the files under path whose extension has a parser; empty pages are kept.

    ocr(content, page) gives the text of pages with too little; its failure or a blank answer keeps the page's text.
    """
    known = dict(PARSERS if parsers is None else parsers)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path_, content in zip(batch["path"], batch["content"]):
                name = path_.rpartition("/")[2]
                rows = []
                for i, text in enumerate(known[extension(name)](bytes(content)), 1):
                    done = False
                    if ocr and len(text.strip()) < MIN_TEXT:
                        try:
                            found = ocr(bytes(content), i)
                        except Exception:  # a page that can't be recognised keeps its text
                            found = ""
                        if found.strip():
                            text, done = found, True
                    rows.append((path_, i, i, name, text, done))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in PAGES.split(", ")])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    accepted = F.lower(F.substring_index("path", ".", -1)).isin(*known) & (F.col("length") > 0)
    return files.where(accepted).select("path", "content").mapInPandas(run, PAGES)


def needs_ocr(text):
    """The condition under which a page is recognised from its image."""
    return F.length(F.trim(text)) < MIN_TEXT


class Storage:
    """Files under a root of any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.root = self.jvm.org.apache.hadoop.fs.Path(root)
        self.fs = self.root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, key: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.root, key)

    def put(self, key: str, content: bytes) -> None:
        out = self.fs.create(self._path(key), True)
        try:
            out.write(bytearray(content))
        finally:
            out.close()

    def get(self, key: str) -> bytes:
        stream = self.fs.open(self._path(key))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def exists(self, key: str) -> bool:
        return self.fs.exists(self._path(key))

    def delete(self, key: str) -> bool:
        return self.fs.delete(self._path(key), False)
