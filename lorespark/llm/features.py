"""Hashed n-gram features and text statistics, computed with numpy over slices of texts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .windows import MIX, WordCodes

BITS = 16
#: Hashed features: trigrams of characters, words, word pairs; then the dense ones.
GROUPS = 3
DENSE = 9
SIZE = GROUPS * (1 << BITS) + DENSE
SLICE_BYTES = 1 << 20
#: Means of n-grams are small; scaled, one learning rate suits all features. The few dense ones weigh more, as they
#: carry over to new words.
SCALE, DENSE_SCALE = 10.0, 3.0
WINDOW = 5
SYMBOLS = b"#*$%&|<>"


@dataclass
class Slice:
    """Some texts: statistics and dense features a row each, and hashed features as (bucket, first position of each text)."""

    stats: dict[str, np.ndarray]
    dense: np.ndarray
    hashed: list[tuple[np.ndarray, np.ndarray]]

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """The weighted features of each text."""
        out = self.dense @ weights[-DENSE:]
        for group, (bucket, ends) in enumerate(self.hashed):
            total = np.concatenate([[0.0], np.cumsum(weights[(group << BITS) + bucket], dtype=np.float64)])
            n = np.diff(ends)
            out += SCALE * (total[ends[1:]] - total[ends[:-1]]) / np.maximum(n, 1)
        return out

    def rows(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(feature numbers, values) of each text."""
        for i in range(len(self.dense)):
            at, values = [], []
            for group, (bucket, ends) in enumerate(self.hashed):
                some, counts = np.unique(bucket[ends[i] : ends[i + 1]], return_counts=True)
                at.append((group << BITS) + some)
                values.append(SCALE * counts / max(1, ends[i + 1] - ends[i]))
            at.append(np.arange(SIZE - DENSE, SIZE))
            values.append(self.dense[i])
            yield np.concatenate(at).astype("<i4"), np.concatenate(values).astype("<f4")


def table_of(symbols: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(symbols)] = True
    return out


IS_SYMBOL = table_of(SYMBOLS)
IS_BLANK = table_of(b" \t\n\x0b\x0c\r")
IS_UPPER = table_of(bytes(range(65, 91)))
IS_DIGIT = table_of(b"0123456789")
IS_MARK = table_of(b"!\"'(),-./:;?[]_{}")
STARTS_CHAR = ~table_of(bytes(range(0x80, 0xC0)))


def analyse(strings: list[str], table: WordCodes) -> Slice:
    """Statistics and features of some texts; word and window equality is by 64-bit hashes."""
    texts = [s.encode() for s in strings]
    n = len(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.frombuffer(b"".join(texts), np.uint8)

    def per_text(flags: np.ndarray, at: np.ndarray = ends) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[at[1:]] - total[at[:-1]]

    words = [t.split() for t in texts]
    n_words = np.array([len(w) for w in words], np.int64)
    word_ends = np.concatenate([[0], np.cumsum(n_words)])
    codes = np.fromiter((c for w in words for c in map(table.__getitem__, w)), np.uint64, int(word_ends[-1]))
    owner = np.repeat(np.arange(n), n_words)
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    n_lines = np.array([len(x) for x in lines], np.int64)
    dup_lines = n_lines - np.array([len(set(x)) for x in lines], np.int64)

    repeated = np.zeros(len(codes), bool)
    with np.errstate(over="ignore"):
        if len(codes) >= WINDOW:
            k = len(codes) - WINDOW + 1
            inside = np.flatnonzero(owner[:k] == owner[WINDOW - 1 :])
            key = owner[:k].astype(np.uint64) * MIX[1]
            for j in range(WINDOW):
                key = (key ^ codes[j : j + k]) * MIX[0]
                key ^= key >> np.uint64(31)
            import pandas as pd

            which, _ = pd.factorize(key[inside])
            again = inside[np.bincount(which)[which] > 1] if len(which) else inside
            step = np.zeros(len(codes) + 1, np.int64)
            np.add.at(step, again, 1)
            np.add.at(step, again + WINDOW, -1)
            repeated = np.cumsum(step[:-1]) > 0
        points = np.frombuffer("".join(strings).encode("utf-32-le"), "<u4")
        grams = np.empty(0, np.uint32)
        if len(points) > 2:
            grams = (points[:-2] * np.uint32(0x9E3779B1) ^ points[1:-1]) * np.uint32(0x85EBCA6B) ^ points[2:]
        grams = (grams * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
        pairs = (codes[:-1] * MIX[0] ^ codes[1:] * MIX[1]) * MIX[0] >> np.uint64(64 - BITS)
    # Grams that reach into the next text are left out.
    point_ends = np.concatenate([[0], np.cumsum([len(s) for s in strings])]).astype(np.int64)
    whole = np.ones(len(grams), bool)
    for back in (1, 2):
        at = point_ends[1:-1] - back
        whole[at[(at >= 0) & (at < len(grams))]] = False
    pair_ok = owner[1:] == owner[:-1]
    char_ends = np.concatenate([[0], np.cumsum(whole)])[np.minimum(point_ends, len(grams))]
    pair_ends = np.concatenate([[0], np.cumsum(pair_ok)])[np.minimum(word_ends, len(pairs))]

    stats = {
        "n_words": n_words,
        "word_chars": per_text(STARTS_CHAR[flat] & ~IS_BLANK[flat]),
        "n_symbols": per_text(IS_SYMBOL[flat]),
        "n_dup_lines": dup_lines,
        "n_repeat_words": per_text(repeated, word_ends),
    }
    chars, count = np.maximum(stats["word_chars"], 1), np.maximum(n_words, 1)
    distinct = np.array([len(set(w)) for w in words], np.int64)
    dense = DENSE_SCALE * np.stack(
        [
            10 * stats["n_symbols"] / chars, 10 * per_text(IS_UPPER[flat]) / chars, 10 * per_text(IS_DIGIT[flat]) / chars,
            10 * per_text(IS_MARK[flat]) / chars, 3 * dup_lines / np.maximum(n_lines, 1), 3 * stats["n_repeat_words"] / count,
            3 * distinct / count, np.log1p(n_words) / 3, np.log1p(chars / count),
        ],
        axis=1,
    )
    hashed = [(grams[whole].astype(np.int64), char_ends), ((codes >> np.uint64(64 - BITS)).astype(np.int64), word_ends), (pairs[pair_ok].astype(np.int64), pair_ends)]
    return Slice(stats, dense, hashed)


def slices(texts: list[str | None]) -> Iterator[tuple[int, Slice]]:
    """(place of the first text, its slice), in slices of about SLICE_BYTES; null is empty."""
    table, at, part, size = WordCodes(), 0, [], 0
    for i, text in enumerate(texts):
        part.append(text or "")
        size += len(part[-1])
        if size >= SLICE_BYTES or i + 1 == len(texts):
            if len(table) > 500_000:  # remembered hashes only
                table = WordCodes()
            yield at, analyse(part, table)
            at, part, size = i + 1, [], 0


def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, label, text) to (key, label, at, vals): sparse features as little-endian int32 and float32."""
    for batch in batches:
        at, values = [], []
        for _, part in slices(batch.column(2).to_pylist()):
            for a, v in part.rows():
                at.append(a.tobytes())
                values.append(v.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.binary()), pa.array(values, pa.binary())], names=["key", "label", "at", "vals"])


class Matrix:
    """Sparse rows with products in both directions."""

    def __init__(self, at: list[bytes], values: list[bytes]):
        self._set(np.frombuffer(b"".join(at), "<i4"), np.frombuffer(b"".join(values), "<f4"), np.array([len(a) // 4 for a in at], np.int64))

    def _set(self, at: np.ndarray, values: np.ndarray, sizes: np.ndarray) -> Matrix:
        self.at, self.values, self.sizes = at, values, sizes
        self.begin = np.cumsum(sizes) - sizes
        return self

    @staticmethod
    def of(at: np.ndarray, values: np.ndarray, sizes: np.ndarray) -> Matrix:
        return Matrix([], [])._set(at, values, sizes)

    def pick(self, rows: np.ndarray) -> Matrix:
        sizes = self.sizes[rows]
        where = np.arange(sizes.sum()) + np.repeat(self.begin[rows] - (np.cumsum(sizes) - sizes), sizes)
        return Matrix.of(self.at[where], self.values[where], sizes)

    @staticmethod
    def stack(*parts: Matrix) -> Matrix:
        return Matrix.of(*(np.concatenate([getattr(p, c) for p in parts]) for c in ("at", "values", "sizes")))

    def packed(self) -> tuple[bytes, bytes, bytes]:
        """Sizes, feature numbers and values, compressed without loss: numbers as steps, both by planes of bytes, which repeat much."""
        step = np.diff(self.at, prepend=np.int32(0))
        planes = (np.ascontiguousarray(x).view(np.uint8).reshape(-1, 4).T.tobytes() for x in (step.astype("<i4"), self.values.astype("<f4")))
        return self.sizes.astype("<i8").tobytes(), *(pa.compress(x, codec="zstd", asbytes=True) for x in planes)

    @staticmethod
    def unpacked(parts: list[tuple[bytes, bytes, bytes]]) -> Matrix:
        """The rows of packed matrices, one after the other; no part is held twice."""
        sizes = [np.frombuffer(s, "<i8") for s, _, _ in parts]
        n = sum(int(s.sum()) for s in sizes)
        at, values, end = np.empty(n, "<i4"), np.empty(n, "<f4"), 0
        for own, (_, *planes) in zip(sizes, parts):
            begin, end = end, end + int(own.sum())
            for out, plane in zip((at, values), planes):
                plane = np.frombuffer(pa.decompress(plane, 4 * (end - begin), codec="zstd"), np.uint8)
                out[begin:end] = np.ascontiguousarray(plane.reshape(4, -1).T).view(out.dtype)[:, 0]
            np.cumsum(at[begin:end], dtype="<i4", out=at[begin:end])
        return Matrix.of(at, values, np.concatenate([np.empty(0, np.int64), *sizes]))

    def dense(self) -> np.ndarray:
        """The text statistics, which are the last of each row."""
        return self.values[(self.begin + self.sizes - DENSE)[:, None] + np.arange(DENSE)]

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.add.reduceat(w[self.at] * self.values, self.begin) if len(self.begin) else np.zeros(0)

    def t_dot(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, np.repeat(r, self.sizes) * self.values, SIZE)


def adam(gradient, steps: int, rate: float) -> np.ndarray:
    """Weights of SIZE and a bias in the last place; gradient(w) has the same shape."""
    w, m, s = np.zeros(SIZE + 1), np.zeros(SIZE + 1), np.zeros(SIZE + 1)
    for t in range(1, steps + 1):
        g = gradient(w)
        m += 0.1 * (g - m)
        s += 0.01 * (g * g - s)
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))
