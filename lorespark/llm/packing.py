"""Best-fit packing planned over the histogram of piece lengths.

1. ``cut`` tokenises whole documents and cuts only those longer than a sequence.
2. The number of pieces of each length is counted: at most ``capacity`` rows, whatever the corpus size.
3. ``plan`` runs best-fit decreasing over those counts. Open sequences with equal room are one group, so
   the work depends on the number of lengths and not on the number of documents.
4. ``place`` numbers the pieces of each length and joins the plan on that rank. Pieces that fill a sequence need no plan.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, tokenizer_path

CAPACITY = 2048
END_ID = 0
#: Fixed value: the pre-tokenizer pattern of byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White-space runs from this length on are encoded without the pattern, whose engine fails on runs of a million characters.
LONG_RUN = 100_000
#: White space as the pattern's engine has it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Pieces that are ranked together, about: a length with more of them is spread over salts, at most so many, whose counts are added up.
RANKED, MOST_SALTS = 512, 4096
#: Tokens that a task holds before it hands pieces on.
BATCH_TOKENS = 1 << 20
PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])
#: Plan rows up to which the plan is broadcast (48 bytes a row); beyond it the plan is joined by shuffle.
BROADCAST_PLAN = 50_000


def byte_level_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a byte-level BPE file as bytes and ranks; an error if its ids are not in merge order."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    # Printable bytes stand for themselves, the others for the code points from 256 on, in order.
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"][a + b] for a, b in pairs]
    if made != sorted(made):
        raise ValueError("the ids of this vocabulary are not in merge order")
    tokens = [*byte_of, *(a + b for a, b in pairs)]
    return {bytes(byte_of[c] for c in t): model["vocab"][t] for t in tokens}


def added_tokens(path: str) -> dict[str, int]:
    """The added tokens of a tokenizers file and their ids; an error for those that aren't matched as they stand."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f).get("added_tokens") or []
    for token in found:
        if any(token[k] for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"the added token {token['content']!r} isn't matched as it stands")
    return {token["content"]: token["id"] for token in found}


def encoder(path: str):
    """A function from a text to its ids as a numpy array of little-endian unsigned 32-bit integers.

    The ids are those of the tokenizers library for the same file with its default setting, in which the file's added tokens
    become their ids; the tests check this. tiktoken's engine makes them several times faster.
    """
    import tiktoken

    special = added_tokens(path)
    tok = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=byte_level_ranks(path), special_tokens=special)
    long_runs = re.compile(f"[{SPACE}]{{{LONG_RUN},}}")

    def plain(text: str) -> np.ndarray:
        return tok.encode_to_numpy(text, allowed_special="all", disallowed_special=()).astype("<u4", copy=False)

    def encode(text: str) -> np.ndarray:
        if len(text) < LONG_RUN:
            return plain(text)
        parts, at = [], 0
        for run in long_runs.finditer(text):
            # The pattern leaves a run's last character to what follows, if anything but an added token does.
            end = run.end() if run.end() == len(text) or text.startswith(tuple(special), run.end()) else run.end() - 1
            whole = tok._core_bpe.encode_single_piece(text[run.start() : end].encode())
            parts += [plain(text[at : run.start()]), np.array(whole, "<u4")]
            at = end
        return np.concatenate([*parts, plain(text[at:])])

    return encode


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*rows) if rows else [()] * 5, PIECE.types)], schema=PIECE)


def cut(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids): each document's ids and the end id, in pieces of at most capacity.

    Documents that fit are one piece. Longer ones are cut into full pieces from their end, so only the first
    may be shorter. ids holds little-endian unsigned 32-bit integers. Null text counts as empty (one piece that
    holds the end id); repeated or null doc_ids are separate documents; other columns are not carried.
    """
    path = tokenizer or tokenizer_path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path), np.array([end_id], "<u4")
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.concatenate([encode(text.as_py()), end])
                n = len(ids)
                first = n if n <= capacity else (n % capacity or capacity)
                for k, lo in enumerate([0, *range(first, n, capacity)]):
                    part = ids[lo : lo + (capacity if k else first)]
                    rows.append((doc, k, lo, len(part), part.tobytes()))
                size += n
                if size > BATCH_TOKENS:
                    yield as_batch(rows)
                    rows, size = [], 0
            yield as_batch(rows)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return texts.mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows (length, from_rank, to_rank, sequence, per_sequence, offset).

    Pieces of that length with from_rank <= rank < to_rank go per_sequence to a sequence, from the numbered
    sequence on, side by side from the offset. Longest lengths go first; each takes the open sequences with the
    least room that still fits, and new ones only when none does.
    """
    out, opened = [], 0
    groups: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room: runs (first sequence, how many)

    def fill(length: int, rank: int, left: int, first: int, n: int, room: int) -> tuple[int, int]:
        """Place up to left pieces into the run; returns the new rank and how many are left."""
        each = room // length
        whole = min(n, left // each)
        if whole:
            out.append((length, rank, rank + whole * each, first, each, capacity - room))
            groups[room - each * length].append((first, whole))
            rank, left = rank + whole * each, left - whole * each
        rest = n - whole
        if left and rest:
            out.append((length, rank, rank + left, first + whole, left, capacity - room))
            groups[room - left * length].append((first + whole, 1))
            rank, left, rest = rank + left, 0, rest - 1
        if rest:
            groups[room].append((first + n - rest, rest))
        return rank, left

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        for room in sorted(r for r in groups if r >= length):
            if not left:
                break
            runs, groups[room] = groups[room], []
            while runs and left:
                first, n = runs.pop()
                rank, left = fill(length, rank, left, first, n, room)
            groups[room] += runs
        if left:
            n = -(-left // (capacity // length))
            rank, left = fill(length, rank, left, opened, n, capacity)
            opened += n
        for room in [r for r, runs in groups.items() if not runs]:
            del groups[room]
    return out


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (any columns with length in 1..capacity, none of them named with a leading underscore) with sequence_id and offset added.

    Every sequence is gapless from 0 and holds at most capacity tokens; those that one piece fills have negative numbers. pieces is
    read several times, so give it as a written table. Rows with a null length or one out of range are an error; an
    empty input gives no rows.
    """
    spark = pieces.sparkSession
    ok = F.col("length").isNotNull() & F.col("length").between(1, capacity)
    pieces = pieces.withColumn("length", F.when(ok, F.col("length").cast("long")).otherwise(F.raise_error(F.lit("length out of range"))))
    # capacity rows at most.
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    histogram.pop(capacity, None)
    whole = pieces.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    rows = plan(histogram, capacity)
    schema = "_length long, _from long, _to long, _sequence long, _each long, _offset long"
    slots = spark.createDataFrame(rows, schema)
    salts = [(length, min(MOST_SALTS, -(-n // RANKED))) for length, n in histogram.items()]
    salts = F.broadcast(spark.createDataFrame(salts, "_of long, _salts long"))  # capacity rows at most
    parts = pieces.join(salts, F.col("length") == F.col("_of")).withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.col("_salts"))).drop("_of", "_salts")
    counts = materialize(parts.groupBy("length", "_salt").agg(F.count("*").alias("_n")), "lengths")
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("length", "_salt", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")) - 1
    ranked = parts.withColumn("_own", own).join(starts, ["length", "_salt"]).withColumn("_rank", F.col("_before") + F.col("_own"))
    within = (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    if len(rows) <= BROADCAST_PLAN:
        placed = ranked.join(F.broadcast(slots), (F.col("length") == F.col("_length")) & within)
    else:  # the salts spread a hot length here too
        slots = slots.join(counts.select(F.col("length").alias("_of"), F.col("_salt").alias("_slot_salt")), F.col("_length") == F.col("_of")).drop("_of")
        placed = ranked.join(slots, (F.col("length") == F.col("_length")) & (F.col("_salt") == F.col("_slot_salt")) & within).drop("_slot_salt")
    step = F.col("_rank") - F.col("_from")
    placed = placed.withColumns(
        {
            "sequence_id": F.col("_sequence") + F.floor(step / F.col("_each")).cast("long"),
            "offset": F.col("_offset") + F.pmod(step, F.col("_each")) * F.col("length"),
        }
    )
    return whole.unionByName(placed.select(*whole.columns))


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Documents packed into sequences: doc_id, piece, start, length, ids, sequence_id, offset, a row for each piece.

    Null text is empty and has one piece, the end id; repeated or null doc_ids are documents of their own; no documents give no
    rows. Other columns are not carried.
    """
    return place(materialize(cut(docs, tokenizer, capacity, end_id), "pieces"), capacity)


def packed_digest(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Where each piece goes, with a checksum of its ids (ids_crc32) instead of the ids; rows and cases as in pack."""
    pieces = cut(docs, tokenizer)
    small = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return place(materialize(small, "pieces")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
