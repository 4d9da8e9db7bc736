"""Substring dedup of words with a compressed FM-index for each shard.

A shard's distinct texts become one sequence of word numbers with a separator after each. Two wavelet matrices of packed bits
with counted ranks are the index: one of the Burrows-Wheeler transform, one of the documents in suffix order. The suffix array
that orders both is dropped. The shard's documents are streamed through the index, some places at a time: from each place
a backward search extends the match word by word and counts how far the words agree with another place of the shard (the
matching statistic), until only the place itself is left or the threshold is reached. Places that reach it end a repeated
interval; the second matrix gives the smallest document among the suffixes of its match.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .windows import Units, remove_repeats

LENGTH = 13
#: Places of the streamed documents that are searched at once.
STREAM = 1 << 18


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """All suffixes in order, by doubling; codes are below 2^31."""
    rank, step = codes.astype(np.int64), 1
    while True:
        follow = np.concatenate([rank[step:] + 1, np.zeros(min(step, len(rank)), np.int64)])
        key = (rank << 32) | follow
        order = np.argsort(key)
        key = key[order]
        new = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        rank = np.empty_like(rank)
        rank[order] = new
        if new[-1] == len(codes) - 1:
            return order
        step *= 2


class WaveletMatrix:
    """A sequence of symbols below n_symbols as one packed bit vector for each bit of a symbol."""

    def __init__(self, sequence: np.ndarray, n_symbols: int):
        self.levels = max(1, (n_symbols - 1).bit_length())
        self.words, self.before, self.zeros = [], [], []
        for level in reversed(range(self.levels)):
            bits = (sequence >> level & 1).astype(bool)
            padded = np.zeros((len(bits) // 64 + 1) * 64, bool)
            padded[: len(bits)] = bits
            words = np.packbits(padded, bitorder="little").view("<u8")
            self.words.append(words)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int32)[:-1]]).astype(np.int32))
            self.zeros.append(int(len(bits) - bits.sum()))
            sequence = np.concatenate([sequence[~bits], sequence[bits]])

    def ones(self, i: int, at: np.ndarray) -> np.ndarray:
        """Set bits before each place of vector i."""
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i][at >> 6] + np.bitwise_count(self.words[i][at >> 6] & mask)

    def ends(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where each place ends up among equal symbols, on the deepest level."""
        for i, level in enumerate(reversed(range(self.levels))):
            ones = self.ones(i, at)
            at = np.where(symbols >> level & 1, self.zeros[i] + ones, at - ones)
        return at

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The smallest symbol in each range low..high; ranges are not empty."""
        out = np.zeros(len(low), np.int64)
        for i, level in enumerate(reversed(range(self.levels))):
            a, b = self.ones(i, low), self.ones(i, high)
            some = high - b > low - a  # a symbol without this bit
            low, high = np.where(some, low - a, self.zeros[i] + a), np.where(some, high - b, self.zeros[i] + b)
            out += np.where(some, 0, 1 << level)
        return out


class FMIndex:
    """Backward search over codes, and for the suffixes found the smallest of their owners, numbers below n_owners."""

    def __init__(self, codes: np.ndarray, n_symbols: int, owners: np.ndarray, n_owners: int):
        suffixes = suffix_array(codes)
        self.matrix = WaveletMatrix(codes[suffixes - 1], n_symbols)
        self.owners = WaveletMatrix(owners[suffixes], n_owners)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=n_symbols))])
        self.base = self.first[:-1] - self.matrix.ends(np.arange(n_symbols), np.zeros(n_symbols, np.int64))

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes low..high, each preceded by a symbol."""
        both = self.matrix.ends(np.concatenate([symbols, symbols]), np.concatenate([low, high]))
        shift = self.base[symbols]
        return both[: len(low)] + shift, both[len(low) :] + shift


def matching_statistics(index: FMIndex, codes: np.ndarray, places: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many words up to each place agree with another place of the index, up to threshold; and the suffixes of those that reach it.

    Each place must have threshold - 1 words of its document before it.
    """
    statistic = np.zeros(len(places), np.int64)
    found = np.zeros((2, len(places)), np.int64)
    open_, low, high = np.arange(len(places)), index.first[codes[places]], index.first[codes[places] + 1]
    for length in range(1, threshold + 1):
        if length > 1:
            low, high = index.extend(codes[places[open_] - length + 1], low, high)
        many = high - low > 1
        open_, low, high = open_[many], low[many], high[many]
        statistic[open_] = length
    found[:, open_] = low, high
    return statistic, found[0], found[1]


def fm_engine(texts: list[bytes], docs: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The smallest document of each window of the texts, which are words joined by spaces."""
    numbers: dict[bytes, int] = {}
    parts = [t.split(b" ") for t in texts]
    flat = [0] * (sum(map(len, parts)) + len(parts))
    at, sizes = 0, []
    for words in parts:
        flat[at : at + len(words)] = [numbers.setdefault(w, len(numbers) + 1) for w in words]
        at += len(words) + 1
        sizes.append(len(words))
    codes, size = np.array(flat, np.int64), np.array(sizes, np.int64)
    windows = size - length + 1
    of = np.repeat(np.arange(len(texts)), windows)
    ends = np.arange(len(of)) + np.repeat(np.arange(len(texts)) * length, windows) + length - 1
    out = docs[of]
    if not len(out):
        return out
    ids, owner = np.unique(docs, return_inverse=True)
    index = FMIndex(codes, len(numbers) + 1, np.repeat(owner, size + 1), len(ids))
    for at in range(0, len(ends), STREAM):
        statistic, low, high = matching_statistics(index, codes, ends[at : at + STREAM], length)
        reached = np.flatnonzero(statistic == length)
        if len(reached):  # matches are equal or apart
            low, where, which = np.unique(low[reached], return_index=True, return_inverse=True)
            out[at + reached] = ids[index.owners.least(low, high[reached][where])][which]
    return out


def substring_dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, text_sha256, kept, n_units, n_removed, spans): texts without the words that smaller documents hold.

    Words are runs of anything but ASCII white space, unchanged. Every word goes that a window of ``length`` words
    covers which also starts in a document with a smaller doc_id; windows are judged on the input. kept joins the
    other words by one space. Null text has no words; rows with one doc_id never remove from each other; a null
    doc_id counts as the largest. Other columns are not carried.
    """
    return remove_repeats(docs, Units(length, words=True), lambda texts, least: fm_engine(texts, least, length))
