"""Removal of repeated windows: the steps that byte-level and word-level dedup share.

A window is ``length`` consecutive units (bytes or words) of one document. A unit goes when a window that covers it
also starts in a document with a smaller doc_id. Text never leaves its block except for the parts that can matter:

1. Each document is cut into runs of windows that have the same smallest gram hash. Equal windows have equal
   hashes, so they meet in runs of the same key. A block sends each key once, in 32 bits beside its bucket, and
   the number of distinct run texts for keys with more than ``MANY``.
2. Buckets say which keys occur in several blocks, and which are crowded: more than ``CROWD`` counted texts.
3. A block sends the text of runs with such keys, or with keys of several of its own documents, to the
   shard of the key: equal texts once, with the smallest doc_id that holds them. Where a passage meets the documents'
   own words, runs of one key have as many texts as documents; so runs of crowded keys are sent as single
   windows, each distinct window once for each block, to shards dealt by the whole window.
4. A shard finds, for each window, the smallest doc_id of all its windows with the same units. How it does so
   is the caller's method; it sees units, so hash collisions cost time and never change a result.
5. For each window of each text its block learns whether a smaller document has it. The places of texts pass by the
   shards in a row for each block; from both the block makes the spans and cuts them out.

All steps read one shuffle of the text by block. A key adds to a bucket or shard at most ``MANY`` texts for each
block and ``CROWD`` more, a window of a crowded key one for each block; no shard gets the places of a text.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MAX_ID, in_blocks

BLOCK_BYTES = 8 << 20
#: Units handled at once within a block.
SLICE = 1 << 19
#: Keys of a bucket, about.
BUCKET_KEYS = 1 << 20
#: Distinct texts of a key in one block up to which they are not counted.
MANY = 8
#: Counted texts of a key in all blocks beyond which its windows are dealt one by one.
CROWD = 1024
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))

#: (units of the shard's distinct texts, their smallest doc_ids) to the smallest doc_id of each window, text after text.
Engine = Callable[[list[bytes], np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Units:
    """How texts are cut into units: single bytes, or words."""

    length: int
    words: bool

    @property
    def gram(self) -> int:
        """Units of a hashed gram: the largest power of two within a third of the window."""
        return 1 << max(0, (self.length // 3).bit_length() - 1)

    def split(self, text: bytes) -> bytes | list[bytes]:
        return text.split() if self.words else text

    def join(self, part: bytes | list[bytes]) -> bytes:
        return b" ".join(part) if self.words else part


class WordCodes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = code = xxhash.xxh3_64_intdigest(word)
        return code


def gram_hashes(codes: np.ndarray, gram: int) -> np.ndarray:
    h = codes * MIX[0] + MIX[1]
    h ^= h >> np.uint64(29)
    size, factor = 1, MIX[0]
    while size < gram:
        h = h[:-size] * factor + h[size:]
        size, factor = 2 * size, factor * factor
    h ^= h >> np.uint64(32)
    h *= MIX[1]
    h ^= h >> np.uint64(29)
    return h


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (width - size)], h[width - size :]) if width > size else h


def runs(codes: np.ndarray, lengths: np.ndarray, units: Units) -> tuple[np.ndarray, ...]:
    """(document's place, first unit in codes, number of windows, 64-bit key) of each run."""
    empty = np.empty(0, np.int64)
    if len(codes) < units.length:
        return empty, empty, empty, empty.astype(np.uint64)
    with np.errstate(over="ignore"):
        least = sliding_min(gram_hashes(codes, units.gram), units.length - units.gram + 1)
    ends = np.cumsum(lengths)
    some = np.flatnonzero(lengths >= units.length)
    first, last = (ends - lengths)[some], ends[some] - units.length  # windows of each document
    edge = np.zeros(len(least) + 1, bool)
    edge[1:-1] = least[1:] != least[:-1]
    edge[first] = True
    edge[last + 1] = True
    at = np.flatnonzero(edge)
    doc = np.searchsorted(ends, at, "right")
    size = np.diff(at, append=len(least))
    ok = np.zeros(len(at), bool)
    known = doc < len(lengths)
    ok[known] = (lengths[doc[known]] >= units.length) & (at[known] <= ends[doc[known]] - units.length)
    return doc[ok], at[ok], size[ok], least[at[ok]]


def slices(texts: list[bytes], units: Units) -> Iterator[tuple[int, list, np.ndarray, np.ndarray]]:
    """(place of the first text, texts in units, codes one after another, their lengths), some texts at a time."""
    table = WordCodes()
    at, parts, size = 0, [], 0
    for i, text in enumerate(texts):
        parts.append(units.split(text))
        size += len(parts[-1])
        if size >= SLICE or i + 1 == len(texts):
            lengths = np.array([len(p) for p in parts], np.int64)
            if units.words:
                codes = np.fromiter((c for p in parts for c in map(table.__getitem__, p)), np.uint64, size)
            else:
                codes = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint64)
            yield at, parts, codes, lengths
            at, parts, size = i + 1, [], 0


def block_rows(table: pa.Table) -> tuple[np.ndarray, list[bytes]]:
    """doc_ids and texts of a block in an order that a repeated attempt finds again."""
    rows = sorted(zip(table["doc_id"].to_pylist(), table["text"].to_pylist()))
    return np.array([d for d, _ in rows], np.int64), [t for _, t in rows]


def composite(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    """bucket and 32-bit rest in one number."""
    return ((keys >> np.uint64(32)) % np.uint64(n_buckets) << np.uint64(32)) | (keys & np.uint64(0xFFFFFFFF))


def run_hashes(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of codes[start:end] for each run; it only serves to count distinct texts."""
    with np.errstate(over="ignore"):
        h = codes * MIX[1] + MIX[0]
        h ^= h >> np.uint64(31)
        power = np.cumprod(np.full(len(codes) + 1, MIX[0]))
        back = np.cumprod(np.full(len(codes) + 1, np.uint64(pow(int(MIX[0]), -1, 1 << 64))))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power[:-1])])
        return (sums[end] - sums[start]) * back[start]


def distinct_keys(keys: np.ndarray, docs: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, which of them more than one document has, and how many texts each has if over MANY, else 0."""
    order = np.argsort(keys)
    keys, docs, hashes = keys[order], docs[order], hashes[order]
    first, end = cut_points(keys)
    if not len(first):
        return keys, np.empty(0, bool), np.empty(0, np.int64)
    several = np.minimum.reduceat(docs, first) != np.maximum.reduceat(docs, first)
    size = end - first
    of = np.repeat(np.arange(len(first)), size)[np.repeat(size > MANY, size)]
    own = hashes[np.repeat(size > MANY, size)]
    order = np.lexsort((own, of))
    of, own = of[order], own[order]
    new = np.concatenate([[True], (of[1:] != of[:-1]) | (own[1:] != own[:-1])])[: len(of)]
    texts = np.bincount(of[new], minlength=len(first))
    return keys[first], several, np.where(texts > MANY, texts, 0)


def cut_points(sorted_group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where equal neighbours start and end."""
    first = np.flatnonzero(np.concatenate([[True], sorted_group[1:] != sorted_group[:-1]])[: len(sorted_group)])
    return first, np.append(first[1:], len(sorted_group))


def all_runs(texts: list[bytes], docs: np.ndarray, units: Units, n_buckets: int) -> tuple[np.ndarray, ...]:
    """(text's place, first unit in it, number of windows, composite key, hash) of each run of a block, in order."""
    found = [(np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2]
    for at, _, codes, lengths in slices(texts, units):
        doc, start, size, key = runs(codes, lengths, units)
        first = (np.cumsum(lengths) - lengths)[doc]
        found.append((at + doc, start - first, size, composite(key, n_buckets), run_hashes(codes, start, start + size + units.length - 1)))
    return tuple(np.concatenate(x) for x in zip(*found))


def send_keys(table: pa.Table, units: Units, n_buckets: int) -> pa.Table:
    docs, texts = block_rows(table)
    place, _, _, key, hashes = all_runs(texts, docs, units, n_buckets)
    keys, _, counts = distinct_keys(key, docs[place], hashes)
    bucket = (keys >> np.uint64(32)).astype(np.int64)
    first, end = cut_points(bucket)
    rest = (keys & np.uint64(0xFFFFFFFF)).astype("<u4")
    many = np.flatnonzero(counts)
    counted = [many[i:j] for i, j in zip(np.searchsorted(many, first), np.searchsorted(many, end))]
    return pa.table({
        "bucket": pa.array(bucket[first], pa.int32()),
        "block": pa.array([table["block"][0].as_py()] * len(first), pa.int32()),
        "keys": pa.array([rest[a:b].tobytes() for a, b in zip(first, end)], pa.binary()),
        "counts": pa.array([np.stack([rest[m], counts[m]]).astype("<u4").tobytes() for m in counted], pa.binary()),
    })


def find_shared(table: pa.Table) -> pa.Table:
    """For each key of each block, a bit that says whether another block has it too; and the block's crowded keys."""
    sets = [np.frombuffer(k, "<u4") for k in table["keys"].to_pylist()]
    every = np.sort(np.concatenate(sets))
    shared = np.unique(every[1:][every[1:] == every[:-1]])
    keys, counts = np.concatenate([np.frombuffer(c, "<u4").reshape(2, -1) for c in table["counts"].to_pylist()], axis=1)
    keys, of = np.unique(keys, return_inverse=True)
    crowded = keys[np.bincount(of, counts, len(keys)) > CROWD]
    flags, crowds = [], []
    for keys in sets:
        at = np.minimum(np.searchsorted(shared, keys), max(0, len(shared) - 1))
        flags.append(np.packbits(shared[at] == keys if len(shared) else np.zeros(len(keys), bool)).tobytes())
        crowds.append(np.intersect1d(keys, crowded).astype("<u4").tobytes())
    return pa.table({"block": table["block"], "bucket": table["bucket"], "flags": pa.array(flags, pa.binary()), "crowded": pa.array(crowds, pa.binary())})


TEXTS = pa.schema([("shard", pa.int32()), ("block", pa.int32()), *((c, pa.binary()) for c in ("docs", "sizes", "data", "sets", "windows", "places"))])
TEXTS_DDL = "shard int, block int, docs binary, sizes binary, data binary, sets binary, windows binary, places binary"


def send_texts(table: pa.Table, answers: pa.Table, units: Units, n_buckets: int, n_shards: int) -> pa.Table:
    """A row of texts for each shard, and one of notes, numbered behind the shards, for the block itself.

    Notes: sizes has the windows of each text, in order of the shards; sets has the windows of each crowded run and
    windows the text of each of these; places has columns: text, or run numbered behind the texts; steps of the document's place; first unit.
    """
    import xxhash

    if not table.num_rows:
        return TEXTS.empty_table()
    docs, texts = block_rows(table)
    place, start, size, key, hashes = all_runs(texts, docs, units, n_buckets)
    keys, several, _ = distinct_keys(key, docs[place], hashes)
    bucket = (keys >> np.uint64(32)).astype(np.int64)
    flags = dict(zip(answers["bucket"].to_pylist(), answers["flags"].to_pylist()))
    wanted = several.copy()
    for a, b in zip(*cut_points(bucket)):
        wanted[a:b] |= np.unpackbits(np.frombuffer(flags[int(bucket[a])], np.uint8), count=b - a).astype(bool)
    wanted = keys[wanted]
    crowded = [np.frombuffer(c, "<u4").astype(np.uint64) | np.uint64(b << 32) for b, c in zip(answers["bucket"].to_pylist(), answers["crowded"].to_pylist())]
    crowded = np.concatenate([np.empty(0, np.uint64), *crowded])
    # Documents come by doc_id, so the first that has a text is the smallest.
    entries: dict[bytes, int] = {}
    shards, least, sizes = [], [], []
    sets: dict[bytes, int] = {}
    set_sizes, windows = [], []

    def entry(text: bytes, shard: int, doc: int, n: int) -> int:
        e = entries.setdefault(text, len(shards))
        if e == len(shards):
            shards.append(shard)
            least.append(doc)
            sizes.append(n)
        return e

    if not len(wanted):
        return TEXTS.empty_table()
    near = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
    ok = wanted[near] == key
    place, start, size, key = place[ok], start[ok], size[ok], key[ok]
    to = ((key * MIX[0]) >> np.uint64(33)) % np.uint64(n_shards)
    own, at = [], -1
    for i, a, n, s, crowd in zip(place.tolist(), start.tolist(), size.tolist(), to.tolist(), np.isin(key, crowded).tolist()):
        if i != at:
            at, units_of, owner = i, units.split(texts[i]), int(docs[i])
        part = units_of[a : a + n + units.length - 1]
        text = units.join(part)
        if not crowd:
            own.append(entry(text, s, owner, n))
            continue
        k = sets.setdefault(text, len(set_sizes))
        if k == len(set_sizes):
            set_sizes.append(n)
            for j in range(n):
                window = units.join(part[j : j + units.length])
                windows.append(entry(window, xxhash.xxh3_64_intdigest(window) % n_shards, owner, 1))
        own.append(-1 - k)
    places = np.stack([np.array(own, np.int64), place, start], axis=1)
    if not entries:
        return TEXTS.empty_table()
    order = np.argsort(np.array(shards), kind="stable")
    number = np.empty_like(order)
    number[order] = np.arange(len(order))
    shard, least, sizes, texts = np.array(shards)[order], np.array(least, "<i8")[order], np.array(sizes, "<i4")[order], list(entries)
    run = places[:, 0]
    places[:, 0] = np.where(run < 0, len(order) - 1 - run, number[np.maximum(run, 0)])
    places[:, 1] = np.diff(places[:, 1], prepend=0)
    block = table["block"][0].as_py()
    rows = []
    for a, b in zip(*cut_points(shard)):
        some = [texts[e] for e in order[a:b]]
        rows.append({
            "shard": int(shard[a]), "block": block, "docs": least[a:b].tobytes(),
            "sizes": np.array([len(t) for t in some], "<i4").tobytes(), "data": b"".join(some),
        })
    rows.append({
        "shard": n_shards + block, "block": block, "sizes": sizes.tobytes(), "sets": np.array(set_sizes, "<i4").tobytes(),
        "windows": number[np.array(windows, np.int64)].astype("<i4").tobytes(), "places": places.T.astype("<i4").tobytes(),
    })
    return pa.Table.from_pylist(rows, schema=TEXTS)


FOUND_DDL = "block int, shard int, n int, flags binary, sizes binary, sets binary, windows binary, places binary"


def search(table: pa.Table, units: Units, engine: Engine, n_shards: int) -> pa.Table:
    """For each block a bit for each window of its texts: whether a document smaller than the block's own has it. Notes pass."""
    none = {c: table[c] for c in ("sizes", "sets", "windows", "places")}
    if table["shard"][0].as_py() >= n_shards:
        empty = pa.nulls(table.num_rows)
        return pa.table({"block": table["block"], "shard": table["shard"], "n": empty.cast(pa.int32()), "flags": empty.cast(pa.binary()), **none})
    entries: dict[bytes, int] = {}
    least: list[int] = []
    local = []
    for docs, sizes, data in zip(*(table[c].to_pylist() for c in ("docs", "sizes", "data"))):
        ends = np.cumsum(np.frombuffer(sizes, "<i4")).tolist()
        own = []
        for a, b, d in zip([0, *ends], ends, np.frombuffer(docs, "<i8").tolist()):
            e = entries.setdefault(data[a:b], len(least))
            if e == len(least):
                least.append(d)
            elif d < least[e]:
                least[e] = d
            own.append(e)
        local.append((np.array(own, np.int64), np.frombuffer(docs, "<i8")))
    texts = list(entries)
    count = np.array([(t.count(b" ") + 1 if units.words else len(t)) - units.length + 1 for t in texts], np.int64)
    smallest = engine(texts, np.array(least, np.int64))
    begin = np.cumsum(count) - count
    flags, sizes = [], []
    for own, docs in local:
        n = count[own]
        at = np.arange(n.sum()) + np.repeat(begin[own] - (np.cumsum(n) - n), n)
        flags.append(np.packbits(smallest[at] < np.repeat(docs, n)).tobytes())
        sizes.append(len(at))
    none = {c: pa.nulls(table.num_rows).cast(pa.binary()) for c in none}
    return pa.table({"block": table["block"], "shard": table["shard"], "n": pa.array(sizes, pa.int32()), "flags": pa.array(flags, pa.binary()), **none})


def removed(answers: pa.Table, docs: np.ndarray, length: int) -> np.ndarray:
    """Spans (place, first unit, end) of the windows that start in smaller documents too."""
    rows = sorted(answers.to_pylist(), key=lambda r: r["shard"])
    if not rows:
        return np.empty((0, 3), np.int64)
    notes = rows.pop()
    size, sets, windows, places = (np.frombuffer(notes[c], "<i4").astype(np.int64) for c in ("sizes", "sets", "windows", "places"))
    run, place, start = places.reshape(3, -1)
    place = np.cumsum(place)
    hit = np.concatenate([np.unpackbits(np.frombuffer(r["flags"], np.uint8), count=r["n"]) for r in rows]).astype(bool)
    least = np.full(len(size) + len(sets), MAX_ID)
    np.minimum.at(least, run, docs[place])
    # A window of a crowded run was compared for the smallest document of the block that has it.
    own = np.repeat(least[len(size) :], sets)
    first = np.full(len(size), MAX_ID)
    np.minimum.at(first, windows, own)
    hit = np.concatenate([hit, hit[(np.cumsum(size) - size)[windows]] | (first[windows] < own)])
    size = np.concatenate([size, sets])
    begin = np.cumsum(size) - size
    # Neighbouring hits of a run are one span.
    before, after = np.concatenate([[False], hit[:-1]]), np.concatenate([hit[1:], [False]])
    before[begin] = False
    after[begin[1:] - 1] = False
    edge, stop = np.flatnonzero(hit & ~before), np.flatnonzero(hit & ~after)
    of = np.searchsorted(begin, edge, "right") - 1
    n = np.bincount(of, minlength=len(size))
    # Of the places of a run, those in larger documents than its smallest go whole.
    whole = docs[place] > least[run]
    some = ~whole
    k = n[run[some]]
    at = np.arange(k.sum()) + np.repeat((np.cumsum(n) - n)[run[some]] - (np.cumsum(k) - k), k)
    shift = np.repeat(start[some], k) - begin[of[at]]
    return np.concatenate([
        np.stack([place[whole], start[whole], start[whole] + size[run[whole]] + length - 1], axis=1),
        np.stack([np.repeat(place[some], k), shift + edge[at], shift + stop[at] + length], axis=1),
    ])


CUT = pa.schema([
    ("doc_id", pa.int64()), ("text_sha256", pa.string()), ("kept", pa.binary()), ("n_units", pa.int64()), ("n_removed", pa.int64()),
    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
])
CUT_DDL = "doc_id long, text_sha256 string, kept binary, n_units long, n_removed long, spans array<struct<start: long, end: long>>"


def cut_out(table: pa.Table, answers: pa.Table, units: Units) -> pa.Table:
    if not table.num_rows:
        return CUT.empty_table()
    docs, texts = block_rows(table)
    spans = removed(answers, docs, units.length)
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    of = defaultdict(list)
    for place, a, b in spans.tolist():
        own = of[place]
        if own and a <= own[-1][1]:
            own[-1][1] = max(own[-1][1], b)
        else:
            own.append([a, b])
    rows = []
    for i, (doc, text) in enumerate(zip(docs.tolist(), texts)):
        parts = units.split(text)
        gone = of.get(i, [])
        edges = [0, *(x for span in gone for x in span), len(parts)]
        kept = [parts[a:b] for a, b in zip(edges[::2], edges[1::2])]
        kept = b" ".join(w for p in kept for w in p) if units.words else b"".join(kept)
        rows.append((None if doc == MAX_ID else doc, hashlib.sha256(text).hexdigest(), kept, len(parts), sum(b - a for a, b in gone), [{"start": a, "end": b} for a, b in gone]))
    return pa.Table.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*rows), CUT.types)], schema=CUT)


def remove_repeats(docs: DataFrame, units: Units, engine: Engine, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, text_sha256, kept, n_units, n_removed, spans) for each row of docs; spans are the maximal removed runs of units."""
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(MAX_ID)).alias("doc_id"), "text")
    blocks, n = in_blocks(docs, block_bytes)
    each = 6 if units.words else 1  # bytes of a unit, about
    n_buckets = max(64, math.ceil(2 * n * block_bytes / each / (units.length - units.gram + 2) / BUCKET_KEYS))
    n_shards = 2 * n
    by_block = blocks.groupBy("block")
    keys = by_block.applyInArrow(lambda t: send_keys(t, units, n_buckets), "bucket int, block int, keys binary, counts binary")
    shared = keys.repartitionById(n_buckets, F.col("bucket")).groupBy("bucket").applyInArrow(find_shared, "block int, bucket int, flags binary, crowded binary")
    texts = by_block.cogroup(shared.repartitionById(n, F.col("block")).groupBy("block")).applyInArrow(lambda t, a: send_texts(t, a, units, n_buckets, n_shards), TEXTS_DDL)
    found = texts.repartitionById(n_shards, F.col("shard")).groupBy("shard").applyInArrow(lambda t: search(t, units, engine, n_shards), FOUND_DDL)
    return by_block.cogroup(found.repartitionById(n, F.col("block")).groupBy("block")).applyInArrow(lambda t, a: cut_out(t, a, units), CUT_DDL)
