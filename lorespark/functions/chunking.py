"""Splitting of pages into chunks: small folds over one page, run in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .models import Embedder, hashing_embedder
from .text import content_hash, heading_at, headings, with_heading

MIN_SEGMENT = 20
SIMILARITY, MIN_CHARS, MAX_CHARS = 0.55, 350, 1600
CHUNK_TOKENS = 800
#: Parts of no more characters are dropped by the token splitter; pages without a model have a larger limit.
MIN_PART, MIN_EMBED = 5, 80
#: Tokens that decode alone, as a stand-in for a tokenizer: three characters make two.
Tokenizer = tuple[Callable[[str], list], Callable[[list], str]]


def segments(text: str, min_chars: int = MIN_SEGMENT) -> list[tuple[str, int]]:
    """(text, offset) of a page's paragraphs; short ones are joined to the one before."""
    out: list[list] = []
    lines, start, at = [], 0, 0
    for line in [*text.split("\n"), ""]:
        if line.strip():
            if not lines:
                start = at
            lines.append(line + "\n")
        elif lines:
            part = "".join(lines)
            if out and len(part) < min_chars:
                out[-1][0] += part
            else:
                out.append([part, start])
            lines = []
        at += len(line) + 1
    return [tuple(x) for x in out]


def merge_groups(lengths: list[int], similarity: list[float], threshold: float = SIMILARITY, min_chars: int = MIN_CHARS, max_chars: int = MAX_CHARS) -> list[int]:
    """The group of each segment: a new one where the topic turns and enough is gathered, or where it would get too long."""
    groups, size = [], 0
    for i, n in enumerate(lengths):
        turn = i > 0 and ((similarity[i] < threshold and size >= min_chars) or size + n > max_chars)
        groups.append((groups[-1] + turn) if groups else 0)
        size = n if turn else size + n
    return groups


def stand_in_tokenizer() -> Tokenizer:
    """Two tokens for three characters, without a vocabulary."""

    def encode(text: str) -> list[str]:
        return [p for at in range(0, len(text), 3) for p in (text[at : at + 2], text[at + 2 : at + 3]) if p]

    return encode, "".join


def token_split(text: str, size: int = CHUNK_TOKENS, min_chars: int = MIN_CHARS, min_part: int = MIN_PART, tokenizer: Tokenizer | None = None) -> list[str]:
    """Parts of at most size tokens, ending after the last sentence mark where that leaves over min_chars; stripped, and very short ones dropped."""
    encode, decode = tokenizer or stand_in_tokenizer()
    out, tokens = [], encode(text)
    while tokens:
        part = decode(tokens[:size])
        stop = max(part.rfind(c) for c in ".?!\n")
        if stop > min_chars:
            part = part[: stop + 1]
        if len(part.strip()) > min_part:
            out.append(part.strip())
        tokens = tokens[max(1, len(encode(part))) :]
    return out


def page_chunks(text: str, embed: Embedder, tokenizer: Tokenizer | None = None) -> list[tuple[str, int | None]]:
    """(chunk, offset) of a page; a blank page or one paragraph is one chunk however long."""
    parts = segments(text)
    if not text.strip() or len(parts) <= 1:
        return [(text, 0)]
    try:
        v = embed([t for t, _ in parts])
    except Exception:  # without a model the page is cut by tokens
        return [(t, None) for t in token_split(text, min_part=MIN_EMBED, tokenizer=tokenizer)]
    norm = np.linalg.norm(v, axis=1)
    both = norm[1:] * norm[:-1]
    near = [0.0, *np.where(both > 0, (v[1:] * v[:-1]).sum(axis=1) / np.where(both > 0, both, 1), 0.0)]
    out: list[tuple[str, int]] = []
    groups = merge_groups([len(t) for t, _ in parts], near)
    for g in range(groups[-1] + 1):
        own = [p for p, h in zip(parts, groups) if h == g]
        joined = "".join(t for t, _ in own)
        out += [(t, own[0][1]) for t in (token_split(joined, tokenizer=tokenizer) if len(joined) > MAX_CHARS else [joined])]
    return out


def chunk_pages(pages: DataFrame, embed: Embedder | None = None, tokenizer: Tokenizer | None = None) -> DataFrame:
    """(document_id, chunk_index, page_no, content, content_hash) of pages (document_id, page_no, text).

    Chunks start with the chain of headings that they stand under; the hash covers it. chunk_index counts through a
    document from 0.
    """
    model = embed or hashing_embedder()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, p, list(f), i, t, s) for d, p, text, f in batch.itertuples(index=False) for i, (t, s) in enumerate(page_chunks(text or "", model, tokenizer))]
            yield pd.DataFrame(rows, columns=["document_id", "page_no", "found", "part", "text", "chunk_start"]).astype({"chunk_start": "Int32"})

    found = headings(F.coalesce("text", F.lit("")))
    row = "array<struct<offset:int,chain:string>>"
    found = F.transform(found, lambda h: F.struct(h["offset"].alias("offset"), h["chain"].alias("chain")))
    cut = pages.select(F.col("document_id").cast("long"), F.col("page_no").cast("int"), "text", found.alias("found")).mapInPandas(
        run, f"document_id long, page_no int, found {row}, part int, text string, chunk_start int"
    )
    joined = cut.withColumn("content", with_heading(F.col("text"), heading_at(F.col("found"), F.col("chunk_start"))))
    index = F.row_number().over(Window.partitionBy("document_id").orderBy("page_no", "part")) - 1
    return joined.select("document_id", index.alias("chunk_index"), "page_no", "content", content_hash(F.col("content")).alias("content_hash"))
