"""Language-model scoring by prediction by partial matching (PPM) over bytes.

Two models learn from the training documents, with A-Z in lower case:

* Base: word counts with add-one smoothing.
* PPM: a byte-context trie of depth ``ORDER``. Escapes are estimated by method D (half a count of each distinct symbol goes to
  the escape), and symbols that a longer context has seen are excluded from the shorter ones.

Text is dealt into blocks. A block sends each distinct word and each distinct string of ORDER + 1 bytes once, with its count,
to a bucket; buckets add up the counts, comparing words themselves. The trie is a table of byte strings with counts. From
the shortest order on, each order's strings are joined with their shorter ones and looked at by context (``code_lengths``), where
a context has at most 255 symbols. Buckets then answer each block with the code lengths of its own strings. No step is
different at another size, and nothing of the model passes through the driver.

A document's score is the sum of the code lengths of its bytes and of its end, as log10 probability.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import MAX_ID, in_blocks, materialize
from .windows import cut_points

ORDER = 5
#: Never bytes of UTF-8: what stands before a text, and its end as a symbol.
BEFORE, END = 0xFE, 0xFF
#: Symbols that can follow: all bytes but BEFORE.
SYMBOLS = 255
FOLDS, FOLD = 7, 2
BLOCK_BYTES, MIN_BLOCKS = 8 << 20, 16
SLICE = 1 << 20


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and doc_id != MAX_ID and zlib.crc32(str(doc_id).encode()) % FOLDS == FOLD


def byte_slices(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """(place of the first text, ascending numbers) of at most SLICE strings at a time, each string once.

    A number is a string of ORDER + 1 bytes and, in its last 16 bits, its text's place after the first: one sort of plain
    numbers brings equal strings together and keeps their texts. Slices also end within texts.
    """
    flat = np.frombuffer(b"".join([*(bytes([BEFORE]) * ORDER + t + bytes([END]) for t in texts), bytes(ORDER)]), np.uint8)
    ends = np.cumsum(np.array([len(t) + ORDER + 1 for t in texts], np.int64))
    a = 0
    while a < len(flat) - ORDER:
        at = int(np.searchsorted(ends, a, "right"))
        b = min(a + SLICE, int(ends[min(at + (1 << 16), len(ends)) - 1]))
        own = ends[at : int(np.searchsorted(ends, b)) + 1]
        numbers = np.zeros(b - a, np.uint64)
        for j in range(ORDER + 1):
            numbers <<= 8
            numbers |= flat[a + j : b + j]
        numbers <<= 16
        numbers |= np.repeat(np.arange(len(own), dtype=np.uint16), np.diff(np.minimum(own, b), prepend=a))
        keep = np.ones(b - a, bool)
        for j in range(ORDER):  # those that reach into the next text
            last = own - 1 - j - a
            keep[last[(last >= 0) & (last < b - a)]] = False
        numbers = numbers[keep]
        numbers.sort()
        if len(numbers):
            yield at, numbers
        a = b


def code_lengths(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, log_p): log10 probability of the last byte of each string after the others.

    counts is (gram, n): strings of order + 1 bytes as numbers, once each, and how often training texts hold them. A string's own
    row holds what its symbol costs after an escape from its context (``lower``), which the next longer order builds on.
    """
    now = None
    for k in range(order + 1):
        # Strings of k + 1 bytes: a context of k and a symbol.
        strings = counts.groupBy(F.col("gram").bitwiseAND((1 << 8 * (k + 1)) - 1).alias("string")).agg(F.sum("n").cast("double").alias("n"))
        context = Window.partitionBy(F.shiftright("string", 8))
        total, kinds = F.sum("n").over(context), F.count_if(F.col("n") > 0).over(context).cast("double")
        if now is None:  # at most 256 strings
            lower = -F.log10(F.greatest(F.lit(1.0), SYMBOLS - kinds))
        else:
            short = now.select(F.col("string").alias("short"), *(F.col(c).alias(f"short_{c}") for c in ("n", "total", "kinds", "lower")))
            strings = strings.join(short, F.col("string").bitwiseAND((1 << 8 * k) - 1) == F.col("short"))
            # What the context has seen is excluded from the shorter one.
            seen = F.sum(F.when(F.col("n") > 0, F.col("short_n")).otherwise(0.0)).over(context)
            rest, left = F.col("short_total") - seen, F.col("short_kinds") - kinds
            lower = (
                F.when(rest <= 0, F.col("short_lower"))
                .when(F.col("short_n") > 0, F.log10((2 * F.col("short_n") - 1) / (2 * rest)))
                .otherwise(F.log10(left / (2 * rest)) + F.col("short_lower"))
            )
        now = strings.select("string", "n", total.alias("total"), kinds.alias("kinds"), lower.alias("lower"))
    cost = (
        F.when(F.col("n") > 0, F.log10((2 * F.col("n") - 1) / (2 * F.col("total"))))
        .when(F.col("total") > 0, F.log10(F.col("kinds") / (2 * F.col("total"))) + F.col("lower"))
        .otherwise(F.col("lower"))
    )
    return now.select(F.col("string").alias("gram"), cost.alias("log_p"))


def packed(numbers: np.ndarray) -> bytes:
    """Numbers with their first bytes first, then their second ones and so on: small ones and likes compress well."""
    return numbers.view(np.uint8).reshape(len(numbers), numbers.itemsize).T.tobytes()


def unpacked(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def packed_grams(grams: np.ndarray) -> bytes:
    """Ascending numbers as steps."""
    return packed(np.diff(grams, prepend=0).astype("<i8"))


def unpacked_grams(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, "<i8"))


class Numbers(dict):
    """Words numbered in the order of their first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Block:
    """The documents of a block: their words and strings, and both once each in the order that buckets are sent them."""

    #: Distinct strings, their counts in training documents and their buckets, by bucket; their order if all were ascending.
    grams: np.ndarray
    gram_counts: np.ndarray
    gram_bucket: np.ndarray
    gram_order: np.ndarray
    #: For each slice: the place of its first text, its distinct strings' places among all ascending ones, how often each occurs, and the text of each occurrence.
    slices: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]

    def __init__(self, table: pa.Table, n_buckets: int):
        import xxhash

        rows = sorted(zip(table["doc_id"].to_pylist(), table["text"].to_pylist()))
        self.docs = [d for d, _ in rows]
        self.texts = [t.lower() for _, t in rows]
        self.train = np.array([not is_held_out(d) for d in self.docs], bool)
        numbers = Numbers()
        flat = [np.empty(0, np.int32)]
        for text in self.texts:  # one text's words at a time
            words = text.split()
            flat.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
        self.n_words = np.array([len(f) for f in flat[1:]], np.int64)
        words = list(numbers)
        bucket = np.array([xxhash.xxh3_64_intdigest(w) % n_buckets for w in words], np.int64)
        order = np.argsort(bucket, kind="stable")
        self.words, self.word_bucket = [words[i] for i in order], bucket[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.flat = place[np.concatenate(flat)] if words else np.empty(0, np.int64)
        self.n_buckets = n_buckets
        self.find_strings()

    def find_strings(self) -> None:
        found = []
        for at, numbers in byte_slices(self.texts):
            doc = numbers.astype(np.uint16)
            numbers >>= 16
            first, end = cut_points(numbers)
            count = np.add.reduceat(self.train[at : at + (1 << 16)][doc], first, dtype=np.int64)
            found.append((at, numbers[first].astype(np.int64), count, (end - first).astype(np.int32), doc))
        every = np.concatenate([np.empty(0, np.int64), *(f[1] for f in found)])
        every.sort()
        every = every[cut_points(every)[0]]
        counts = np.zeros(len(every), np.int64)
        self.slices = []
        for at, own, count, times, doc in found:
            place = np.searchsorted(every, own).astype(np.int32)
            counts[place] += count
            self.slices.append((at, place, times, doc))
        bucket = every % self.n_buckets
        self.gram_order = np.argsort(bucket.astype(np.uint16) if self.n_buckets <= 1 << 16 else bucket, kind="stable")
        self.grams, self.gram_counts, self.gram_bucket = every[self.gram_order], counts[self.gram_order], bucket[self.gram_order]

    def scores(self, log_p: np.ndarray) -> np.ndarray:
        """The sum of each document's log_p, which are those of grams."""
        ascending = np.empty(len(log_p))
        ascending[self.gram_order] = log_p
        out = np.zeros(len(self.texts))
        for at, place, times, doc in self.slices:
            n = min(1 << 16, len(out) - at)
            out[at : at + n] += np.bincount(doc, np.repeat(ascending[place], times), n)
        return out


def pieces_of(bucket: np.ndarray) -> dict[int, tuple[int, int]]:
    return {int(bucket[a]): (a, b) for a, b in zip(*(x.tolist() for x in cut_points(bucket)))}


SENT = "bucket int, block int, words binary, word_counts binary, grams binary, gram_counts binary"


def send(table: pa.Table, n_buckets: int) -> pa.Table:
    """A row for each bucket: the block's distinct words, joined by blanks, and strings, with their counts in training documents."""
    block = Block(table, n_buckets)
    word_counts = np.bincount(block.flat, np.repeat(block.train, block.n_words), len(block.words)).astype("<u4")
    grams, gram_counts = block.grams, block.gram_counts
    words_at, grams_at = pieces_of(block.word_bucket), pieces_of(block.gram_bucket)
    buckets = sorted(words_at.keys() | grams_at.keys())
    rows: list[list] = [[], [], [], []]
    for b in buckets:
        i, j = words_at.get(b, (0, 0))
        k, m = grams_at.get(b, (0, 0))
        for column, value in zip(rows, (b" ".join(block.words[i:j]), packed(word_counts[i:j]), packed_grams(grams[k:m]), packed(gram_counts[k:m].astype("<u4")))):
            column.append(value)
    number = table["block"][0].as_py()
    return pa.table({
        "bucket": pa.array(buckets, pa.int32()), "block": pa.array([number] * len(buckets), pa.int32()),
        **{c: pa.array(v, pa.binary()) for c, v in zip(("words", "word_counts", "grams", "gram_counts"), rows)},
    })


def total_words(table: pa.Table) -> pa.Table:
    """The whole count of each word that a block sent; tokens and vocabulary of the bucket on its first row."""
    numbers = Numbers()
    sent = [[numbers[w] for w in words.split()] for words in table["words"].to_pylist()]
    counts = [unpacked(c, "<u4") for c in table["word_counts"].to_pylist()]
    total = np.bincount(np.concatenate([np.array(s, np.int64) for s in sent]), np.concatenate(counts), len(numbers)).astype("<i8")
    first = np.arange(len(sent)) == 0
    return pa.table({
        "block": table["block"], "bucket": table["bucket"], "counts": pa.array([packed(total[s]) if s else b"" for s in sent], pa.binary()),
        "tokens": pa.array(np.where(first, total.sum(), 0), pa.int64()), "kinds": pa.array(np.where(first, (total > 0).sum(), 0), pa.int64()),
    })


def total_grams(table: pa.Table) -> pa.Table:
    grams = [unpacked_grams(g) for g in table["grams"].to_pylist()]
    counts = [unpacked(c, "<u4") for c in table["gram_counts"].to_pylist()]
    which, distinct = pd.factorize(np.concatenate(grams))
    return pa.table({"gram": pa.array(distinct, pa.int64()), "n": pa.array(np.bincount(which, np.concatenate(counts), len(distinct)).astype(np.int64))})


def answer(sent: pa.Table, lengths: pa.Table) -> pa.Table:
    """The code lengths of the strings that each block sent to a bucket, to seven digits."""
    known = lengths["gram"].to_numpy()
    order = np.argsort(known)
    known, log_p = known[order], lengths["log_p"].to_numpy()[order].astype("<f4")
    back = [packed(log_p[np.searchsorted(known, unpacked_grams(g))]) if g else b"" for g in sent["grams"].to_pylist()]
    return pa.table({"block": sent["block"], "bucket": sent["bucket"], "counts": pa.nulls(len(back), pa.binary()), "logs": pa.array(back, pa.binary())})


SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def joined(answers: pa.Table, column: str, kind: str) -> np.ndarray:
    """A column's numbers by bucket, which is the order of Block."""
    parts = sorted((b, v) for b, v in zip(answers["bucket"].to_pylist(), answers[column].to_pylist()) if v is not None)
    return np.concatenate([np.empty(0, kind), *(unpacked(v, kind) for _, v in parts)])


def score_block(table: pa.Table, answers: pa.Table, n_buckets: int, tokens: int, kinds: int, ends: int) -> pa.Table:
    if not table.num_rows:
        return SCORED.empty_table()
    block = Block(table, n_buckets)
    each = joined(answers, "counts", "<i8")[block.flat]
    stop = np.cumsum(block.n_words)
    logs = np.concatenate([[0.0], np.cumsum(np.log10(each + 1.0))])
    known = np.concatenate([[0], np.cumsum(each > 0)])
    n = block.n_words
    base = logs[stop] - logs[stop - n] + math.log10(ends + 1) - (n + 1) * math.log10(tokens + kinds + 1)
    score = block.scores(joined(answers, "logs", "<f4"))
    columns = [
        pa.array([None if d == MAX_ID else d for d in block.docs], pa.int64()), pa.array(~block.train), pa.array(n + 1),
        pa.array(known[stop] - known[stop - n] + (ends > 0)), pa.array(base), pa.array(score),
    ]
    return pa.Table.from_arrays(columns, schema=SCORED)


def score(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs.

    Rows whose crc32 of the id as text leaves FOLD modulo FOLDS are held out of training. Null text is empty: it has
    its end only. Repeated doc_ids are documents of their own; a row of a null doc_id is learned from. Without rows to
    learn from every symbol is as likely as any other. Other columns are not carried.
    """
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(MAX_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    blocks, n = in_blocks(docs, block_bytes, MIN_BLOCKS)
    n_buckets = n | 1  # odd, so that strings that share their last bytes spread
    by_block = blocks.groupBy("block")
    sent = materialize(by_block.applyInArrow(lambda t: send(t, n_buckets), SENT), "sent")

    def by_bucket(*columns: str):
        return sent.select("bucket", "block", *columns).repartitionById(n_buckets, F.col("bucket")).groupBy("bucket")

    totals = by_bucket("words", "word_counts").applyInArrow(total_words, "block int, bucket int, counts binary, tokens long, kinds long")
    totals = materialize(totals, "words")
    fold = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % FOLDS == FOLD
    ends = docs.agg(F.count_if(~fold | (F.col("doc_id") == MAX_ID)).alias("n")).first()["n"]
    seen = totals.agg(F.sum("tokens").alias("tokens"), F.sum("kinds").alias("kinds")).first()
    tokens, kinds = (seen["tokens"] or 0) + ends, (seen["kinds"] or 0) + (ends > 0)
    counts = materialize(by_bucket("grams", "gram_counts").applyInArrow(total_grams, "gram long, n long"), "grams")
    lengths = materialize(code_lengths(counts), "lengths")
    dealt = lengths.withColumn("bucket", (F.col("gram") % n_buckets).cast("int")).repartitionById(n_buckets, F.col("bucket")).groupBy("bucket")
    logs = by_bucket("grams").cogroup(dealt).applyInArrow(answer, "block int, bucket int, counts binary, logs binary")
    answers = totals.select("block", "bucket", "counts", F.lit(None).cast("binary").alias("logs")).unionByName(logs)
    answers = answers.repartitionById(n, F.col("block")).groupBy("block")
    ddl = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    out = by_block.cogroup(answers).applyInArrow(lambda t, a: score_block(t, a, n_buckets, tokens, kinds, ends), ddl)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
