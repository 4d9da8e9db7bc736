"""Suffix-array dedup of bytes by a depth-limited radix sort.

Suffixes are ordered only through ``LENGTH`` bytes, by most-significant-digit passes of eight bytes. A suffix leaves
the sort as soon as its group holds one document only; groups that are still equal after the last digit are exactly
the repeated windows. Spark deals the suffixes out by content first (see windows), so each sort is small.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .windows import Units, remove_repeats

LENGTH = 50
DIGIT = 8


def radix_groups(data: np.ndarray, starts: np.ndarray, docs: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For the suffix of data at each start, the smallest of docs among suffixes equal through length bytes."""
    padded = np.concatenate([data, np.zeros(DIGIT, np.uint8)])
    eights = np.lib.stride_tricks.as_strided(padded[: DIGIT].view(">u8"), (len(data) + 1,), (1,))
    out = docs.copy()
    active, group = np.arange(len(starts)), None
    for depth in range(0, length, DIGIT):
        digit = eights[starts[active] + depth].astype(np.uint64)
        digit >>= np.uint64(8 * max(0, depth + DIGIT - length))
        order = np.argsort(digit) if group is None else np.lexsort((digit, group))
        digit, active = digit[order], active[order]
        new = np.concatenate([[True], digit[1:] != digit[:-1]])[: len(digit)]
        if group is not None:
            group = group[order]
            new[1:] |= group[1:] != group[:-1]
        first = np.flatnonzero(new)
        if not len(first):
            break
        own = docs[active]
        least = np.minimum.reduceat(own, first)
        size = np.diff(first, append=len(own))
        open_ = np.repeat(least != np.maximum.reduceat(own, first), size)
        if depth + DIGIT >= length:
            out[active] = np.repeat(least, size)
        active, group = active[open_], np.repeat(np.arange(len(first)), size)[open_]
    return out


def radix_engine(texts: list[bytes], docs: np.ndarray, length: int = LENGTH) -> np.ndarray:
    sizes = np.array([len(t) for t in texts], np.int64)
    windows = sizes - length + 1
    of = np.repeat(np.arange(len(texts)), windows)
    starts = np.arange(len(of)) + np.repeat(np.arange(len(texts)) * (length - 1), windows)
    return radix_groups(np.frombuffer(b"".join(texts), np.uint8), starts, docs[of], length)


def suffix_dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, text_sha256, kept, n_units, n_removed, spans): texts as UTF-8 bytes without what smaller documents hold.

    Every byte goes that a ``length``-byte string covers which also starts in a document with a smaller doc_id;
    strings are judged on the input. kept may be cut within a character. Null text is empty; rows with one doc_id
    never remove from each other; a null doc_id counts as the largest. Other columns are not carried.
    """
    units = Units(length, words=False)
    return remove_repeats(docs, units, lambda texts, least: radix_engine(texts, least, length))
