"""SimHash near-dedup with tiled exact comparison of fingerprints.

Fingerprints within ``RADIUS`` bits agree on some of the blocks that their bits are cut into, so only those that
share blocks are compared: exact at every size, without comparing all pairs. Each group that shares blocks is ordered by
population count and cut into tiles, and only tile pairs whose population counts come within the radius meet. Large groups
are cut into full tiles across tasks, each pair in a task of its own (``tiled``); within a task every group is cut into
smaller ones (``near_pairs``). Of a tile pair numpy compares every fingerprint with every other by exclusive-or and bit
count, and hands on links that span the groups, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from .common import MAX_ID, materialize
from .components import components

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Fingerprints of a tile, across tasks and within one.
TILE, SMALL = 1024, 128
#: Up to so many fingerprints a group is compared without tiles.
FEW = 16
#: Mean number of fingerprints that share blocks beyond which more blocks are used.
CROWD = 32


def fingerprint(text: bytes, words: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of the shingles, as a signed integer; zero where there is no word."""
    import xxhash

    tokens = text.lower().split()  # of bytes: A-Z only, and ASCII white space
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    k = min(words, len(tokens))
    starts = np.concatenate([[0], ends[: len(tokens) - k] + 1]).tolist()
    parts = map(joined.__getitem__, map(slice, starts, ends[k - 1 :].tolist()))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(seed)), "<u8", len(starts))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE, seed: int = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, print) and the columns to carry: the fingerprint of every row's whole text; null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", words, seed) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64()), *batch.columns[2:]], names=["doc_id", "print", *carry])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.col("text"), "UTF-8").alias("text"), *carry)
    return rows.mapInArrow(run, StructType([*StructType.fromDDL("doc_id long, print long"), *docs.select(*carry).schema]))


def block_keys(value: Column, blocks: int, radius: int = RADIUS) -> Column:
    """An array of (band, key): the value's bits outside each choice of radius blocks."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    out = []
    for band, gone in enumerate(combinations(range(blocks), radius)):
        mask = sum(((1 << (hi - lo)) - 1) << lo for i, (lo, hi) in enumerate(zip(cuts, cuts[1:])) if i not in gone)
        mask -= (mask >> 63) << 64
        out.append(F.struct(F.lit(band).alias("band"), value.bitwiseAND(F.lit(mask)).alias("key")))
    return F.array(*out)


def tile_pairs(low: np.ndarray, high: np.ndarray, side: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """The pairs of tiles whose population counts (low..high) come within the radius; where there are two sides, only across them."""
    across = side.min() != side.max()
    meet = (low[None, :] - high[:, None] <= radius) & (low[:, None] - high[None, :] <= radius)
    if across:
        meet &= side[:, None] != side[None, :]
    return list(zip(*(x.tolist() for x in np.nonzero(np.triu(meet)))))


def near_pairs(prints: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the prints within the radius of each other, by small tiles; where there are two sides, only across them."""
    ones = np.bitwise_count(prints).astype(np.int64)
    order = np.lexsort((prints, ones, side))
    turn = np.flatnonzero(np.diff(side[order])) + 1
    parts = [p for half in np.split(order, turn) for p in np.split(half, range(SMALL, len(half), SMALL))]
    found = [(np.empty(0, np.int64),) * 2]
    ends = np.array([(ones[p[0]], ones[p[-1]], side[p[0]]) for p in parts])
    for a, b in tile_pairs(*ends.T, radius):
        i, j = np.nonzero(np.bitwise_count(prints[parts[a]][:, None] ^ prints[parts[b]][None, :]) <= radius)
        found.append((parts[a][i], parts[b][j]))
    return tuple(np.concatenate(x) for x in zip(*found))


def spanning(prints: np.ndarray, nodes: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links from each node to the smallest that it reaches within one tile pair."""
    i, j = near_pairs(prints, side, radius)
    label = nodes.copy()
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        if (new == label).all():
            break
        label = new
    own = label != nodes
    return nodes[own], label[own]


def compare(batches: Iterator[pa.RecordBatch], radius: int = RADIUS) -> Iterator[pa.RecordBatch]:
    """Links (u, v) among rows (band, key, low, high, tile, print, node) that come sorted by the first four."""

    def links(keys: np.ndarray, side: np.ndarray, prints: np.ndarray, nodes: np.ndarray):
        edge = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(prints)]])
        size = ends - starts
        u, v = [], []
        group = np.repeat(np.arange(len(size)), size)
        few = (size <= FEW)[group]
        for d in range(1, FEW):
            i = np.flatnonzero(few[:-d] & (group[d:] == group[:-d])) if d < len(group) else np.empty(0, int)
            i = i[np.bitwise_count(prints[i] ^ prints[i + d]) <= radius]
            u.append(nodes[i])
            v.append(nodes[i + d])
        for g in np.flatnonzero(size > FEW):
            own = slice(starts[g], ends[g])
            a, b = spanning(prints[own], nodes[own], side[own], radius)
            u.append(a)
            v.append(b)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (u, v)], names=["u", "v"])

    kept = None
    for batch in batches:
        cols = [c.to_numpy() for c in batch.columns]
        rows = (np.stack(cols[:4], axis=1).astype(np.int64), cols[4].astype(np.int64), cols[5].view(np.uint64), cols[6])
        if kept:
            rows = tuple(np.concatenate(x) for x in zip(kept, rows))
        if not len(rows[1]):
            continue
        last = np.flatnonzero((rows[0] == rows[0][-1]).all(axis=1))[0]  # a group may go on in the next batch
        kept = tuple(x[last:] for x in rows)
        if last:
            yield links(*(x[:last] for x in rows))
    if kept:
        yield links(*kept)


def tiled(dealt: DataFrame, crowds: DataFrame, radius: int, size: int) -> DataFrame:
    """dealt (band, key, ones, print, node) with tile, and low and high of the tile pairs that each row takes part in.

    crowds are the (band, key) with more than size rows; others are one tile. A crowd's rows are laid out by population
    count, rows of one count by a hash, and cut into tiles of about size. No group is gathered: places come from the rows counted by
    population count, of which a group has at most 65.
    """
    crowd = ["band", "key"]
    classes = dealt.join(crowds, crowd, "left_semi").groupBy(*crowd, "ones").agg(F.count("*").alias("n"))
    by_ones = Window.partitionBy(*crowd).orderBy("ones")
    before = F.coalesce(F.sum("n").over(by_ones.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    classes = classes.withColumn("before", before)
    tile_of = lambda place: F.floor(place / size).cast("int")
    # The tiles of the counts within the radius below and above.
    classes = classes.withColumn("first", tile_of(F.min("before").over(by_ones.rangeBetween(-radius, 0))))
    classes = materialize(classes.withColumn("last", tile_of(F.max(F.col("before") + F.col("n")).over(by_ones.rangeBetween(0, radius)) - 1)), "classes")
    reach = classes.withColumn("tile", F.explode(F.sequence(tile_of(F.col("before")), tile_of(F.col("before") + F.col("n") - 1))))
    reach = materialize(reach.groupBy(*crowd, "tile").agg(F.min("first").alias("first"), F.max("last").alias("last")), "tiles")
    share = F.pmod(F.xxhash64("print"), F.lit(1 << 20)) / (1 << 20)
    rows = dealt.join(classes.select(*crowd, "ones", "n", "before"), [*crowd, "ones"])
    rows = rows.withColumn("tile", tile_of(F.col("before") + F.floor(share * F.col("n")))).join(reach, [*crowd, "tile"])
    rows = rows.withColumn("other", F.explode(F.sequence("first", "last")))
    return rows.select(*crowd, F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "print", "node")


def links(nodes: DataFrame, count: int, radius: int = RADIUS) -> DataFrame:
    """Links (u, v) that connect what prints within the radius connect; nodes is (print, node), prints distinct."""
    blocks = radius + 1
    while blocks < radius + 4 and count > CROWD << (64 * (blocks - radius) // blocks):
        blocks += 1
    dealt = nodes.select("print", "node", F.bit_count("print").cast("int").alias("ones"), F.inline(block_keys(F.col("print"), blocks, radius)))
    crowds = materialize(dealt.groupBy("band", "key").agg(F.count("*").alias("n")).where(F.col("n") > TILE).select("band", "key"), "crowds")
    none = F.lit(0)
    rows = dealt.join(crowds, ["band", "key"], "left_anti").select("band", "key", none.alias("low"), none.alias("high"), none.alias("tile"), "print", "node")
    if not crowds.isEmpty():
        rows = rows.unionByName(tiled(dealt, crowds, radius, TILE))
    by = ["band", "key", "low", "high"]
    return rows.repartition(*by).sortWithinPartitions(*by).mapInArrow(lambda b: compare(b, radius), "u long, v long")


def linked(docs: DataFrame, radius: int = RADIUS, words: int = SHINGLE, seed: int = SEED, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """fingerprints of docs with MAX_ID for a null doc_id, written; and (print, least, component) for each print.

    least is the smallest doc_id of the print, component the smallest print that its links reach.
    """
    prints = materialize(fingerprints(docs, words, seed, carry).withColumn("doc_id", F.coalesce("doc_id", F.lit(MAX_ID))), "prints")
    nodes = materialize(prints.groupBy("print").agg(F.min("doc_id").alias("least")), "nodes")
    found = components(links(nodes.select("print", F.col("print").alias("node")), nodes.count(), radius))
    named = nodes.join(found, F.col("print") == F.col("node"), "left")
    return prints, named.select("print", "least", F.coalesce("component", "print").alias("component"))


def near_dedup(docs: DataFrame, radius: int = RADIUS, words: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, print, component_id): component_id is the smallest doc_id that links of radius bits or fewer reach.

    Null text is empty; texts without words have print zero and are linked like any other. Repeated doc_ids are
    documents of their own; a null doc_id counts as the largest. Other columns are not carried.
    """
    prints, named = linked(docs, radius, words, seed)
    named = materialize(named, "components")
    # Written, so that the join can split a component of many prints.
    least = materialize(named.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    out = prints.join(named.join(least, "component"), "print")
    return out.select(F.nullif("doc_id", F.lit(MAX_ID)).alias("doc_id"), "print", F.nullif("component_id", F.lit(MAX_ID)).alias("component_id"))
