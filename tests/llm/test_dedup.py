import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import xxhash
from frames import rows
from pyspark.sql import functions as F
from texts import lower, words

from lorespark.llm import exact_dedup, fm_index, queries, simhash, windows
from lorespark.llm.common import materialize
from lorespark.llm.components import components
from lorespark.llm.fm_index import FMIndex, substring_dedup
from lorespark.llm.suffix_dedup import radix_groups, suffix_dedup

DATA = "/root/testdata/sf0.001"
LAST = 2**63 - 1


def test_exact_cases(odd, odd_rows):
    groups = {}
    for d, t in odd_rows:
        groups.setdefault(lower(t), []).append(d)
    want = []
    for d, t in odd_rows:
        ids = groups[lower(t)]
        keep = max((i for i in ids if i is not None), default=None)
        want.append((d, keep, len(ids), d == keep, hashlib.sha256(lower(t).encode()).hexdigest()))
    for capacity, many in ((1, 1), (3, 1000), (1 << 20, 2)):
        got = [tuple(r) for r in exact_dedup.exact_dedup(odd, capacity, many=many).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_exact_empty(empty):
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_directory():
    assert exact_dedup.directory({}, 10, 4) == (0, [0])
    depth, slots = exact_dedup.directory({0: 5, 1: 5, 8: 3}, 5, 4)
    assert depth == 4 and slots == [0, 1, 2, 2, 3, 3, 3, 3, *[4] * 8]
    assert exact_dedup.directory({3: 100}, 5, 4)[0] == 4  # copies of one hash can't be split


def test_owners_follow_the_directory(spark, monkeypatch):
    """Each bucket is written by one task, to a file of its own, and holds no more than its capacity."""
    kept = {}
    monkeypatch.setattr(exact_dedup, "materialize", lambda df, name: kept.setdefault(name, materialize(df, name)))
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 700).cast("string")).alias("text"))
    assert exact_dedup.exact_dedup(docs, 32, many=2).where("group_size = 3").count() == 1800
    files = kept["index"].withColumn("file", F.input_file_name()).groupBy("_bucket").agg(F.countDistinct("file").alias("files"), F.count("*").alias("n"), F.min("_hash"), F.max("_hash")).collect()
    assert len(files) > 20 and all(f.files == 1 and f.n <= 32 for f in files)
    ranges = sorted(((f[3] % 2**64, f[4] % 2**64) for f in files if (f[3] < 0) == (f[4] < 0)))
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))


def test_exact_sql(spark, duck):
    got = queries.op3_exact_dedup(spark, DATA).toPandas()
    assert rows(got) == rows(duck.execute(queries.ORACLES["op3_exact_dedup"]).df())


def cut_brute(data, length, as_words):
    split = [(LAST if d is None else d, words(t) if as_words else (t or "").encode()) for d, t in data]
    key = (lambda u, k: tuple(u[k : k + length])) if as_words else (lambda u, k: u[k : k + length])
    least = {}
    for d, u in split:
        for k in range(len(u) - length + 1):
            least[key(u, k)] = min(least.get(key(u, k), d), d)
    out = []
    for d, u in split:
        gone = np.zeros(len(u) + 1, bool)
        for k in range(len(u) - length + 1):
            if least[key(u, k)] < d:
                gone[k : k + length] = True
        gone = gone[:-1]
        kept = " ".join(w for w, g in zip(u, gone) if not g).encode() if as_words else bytes(b for b, g in zip(u, gone) if not g)
        out.append((None if d == LAST else d, kept, len(u), int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])[: len(gone)]).sum())))
    return sorted(out, key=repr)


@pytest.mark.parametrize("operator, length, as_words", [(suffix_dedup, 50, False), (substring_dedup, 13, True), (suffix_dedup, 7, False), (substring_dedup, 2, True)])
def test_windows(odd, odd_rows, empty, operator, length, as_words):
    got = [(r.doc_id, bytes(r.kept), r.n_units, r.n_removed, len(r.spans)) for r in operator(odd, length).collect()]
    assert sorted(got, key=repr) == cut_brute(odd_rows, length, as_words)
    assert operator(empty, length).count() == 0


def passage_rows(n):
    """A passage between words of each document's own, and copies of one such document."""
    rng = np.random.default_rng(3)
    passage = " ".join(f"shared{i}" for i in range(60))
    own = lambda: " ".join(f"{x:x}" for x in rng.integers(1 << 40, 1 << 44, 20))
    data = [(int(d), f"{own()} {passage} {own()}") for d in rng.permutation(n)]
    return data + [(n + i, data[0][1]) for i in range(20)] + [(None, data[1][1]), (5, data[2][1])]


@pytest.mark.parametrize("operator, length, as_words", [(suffix_dedup, 50, False), (substring_dedup, 13, True)])
def test_crowded_windows(spark, monkeypatch, operator, length, as_words):
    monkeypatch.setattr(windows, "MANY", 1)
    monkeypatch.setattr(windows, "CROWD", 20)
    data = passage_rows(400)
    got = [(r.doc_id, bytes(r.kept), r.n_units, r.n_removed, len(r.spans)) for r in operator(spark.createDataFrame(data, "doc_id long, text string"), length).collect()]
    assert sorted(got, key=repr) == cut_brute(data, length, as_words)


@pytest.mark.parametrize("length, as_words", [(50, False), (13, True)])
def test_a_passage_does_not_crowd_a_shard(length, as_words):
    """The fullest shard of passages in ever more documents, in 4 blocks; a shard gets no places."""
    units, fullest = windows.Units(length, as_words), []
    for n in (2000, 8000):
        data = passage_rows(n)[:n]
        blocks = [pa.table({"doc_id": [d for d, _ in data[i::4]], "text": [t.encode() for _, t in data[i::4]], "block": pa.array([i] * len(data[i::4]), pa.int32())}) for i in range(4)]
        keys = pa.concat_tables([windows.send_keys(b, units, 1) for b in blocks])
        answers = windows.find_shared(keys)
        load = Counter()
        for i, b in enumerate(blocks):
            sent = windows.send_texts(b, answers.filter(pc.equal(answers["block"], i)), units, 1, 4096)
            for r in sent.to_pylist():
                if r["shard"] < 4096:
                    assert not r["places"]
                    load[r["shard"]] += len(r["sizes"]) // 4
        fullest.append(max(load.values()))
    assert fullest[1] < windows.CROWD + 4 * windows.MANY


@pytest.mark.parametrize("query, length, as_words", [("op2_suffix_array_dedup", 50, False), ("op4_substring_dedup", 13, True)])
def test_window_queries(spark, query, length, as_words):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((d, n, gone, hashlib.sha256(kept).hexdigest()) for d, kept, n, gone, _ in cut_brute([tuple(r) for r in docs], length, as_words))
    got = queries.QUERIES[query](spark, DATA)
    assert sorted((r[0], r[1], r[2], r["kept_sha256"]) for r in got.collect()) == want


def test_radix_groups():
    data = np.frombuffer(b"abcabcabcxabcabcabc", np.uint8)
    starts = np.array([0, 3, 10, 13, 9])
    assert radix_groups(data, starts, np.array([5, 4, 3, 2, 1]), 6).tolist() == [2, 2, 2, 2, 1]


def test_fm_index():
    rng = np.random.default_rng(0)
    codes, owners = np.append(rng.integers(1, 5, 300), 0), rng.integers(0, 37, 301)
    index = FMIndex(codes, 5, owners, 37)
    assert not any(isinstance(v, np.ndarray) and len(v) >= len(codes) for v in vars(index).values())  # no suffix array
    for _ in range(50):
        at = rng.integers(0, 290)
        pattern = codes[at : at + 4]
        low, high = index.first[pattern[-1 :]], index.first[pattern[-1 :] + 1]
        for c in pattern[-2::-1]:
            low, high = index.extend(np.array([c]), low, high)
        held = [owners[i] for i in range(len(codes) - 3) if (codes[i : i + 4] == pattern).all()]
        assert high[0] - low[0] == len(held) and index.owners.least(low, high)[0] == min(held)


@pytest.mark.parametrize("stream", [7, 1 << 18])
def test_matching_statistics(monkeypatch, stream):
    monkeypatch.setattr(fm_index, "STREAM", stream)
    rng = np.random.default_rng(2)
    texts = [b" ".join(b"w%d" % x for x in rng.integers(0, 3, rng.integers(5, 30))) for _ in range(40)]
    docs, parts = rng.integers(0, 1000, 40), [t.split() for t in texts]
    numbers = {w: i + 1 for i, w in enumerate(sorted({w for p in parts for w in p}))}
    codes = np.array([c for p in parts for c in (*(numbers[w] for w in p), 0)])
    index = FMIndex(codes, 4, np.zeros(len(codes), np.int64), 1)
    places = np.concatenate([np.arange(4, len(p)) + sum(len(q) + 1 for q in parts[:i]) for i, p in enumerate(parts)])
    found = fm_index.matching_statistics(index, codes, places, 5)[0]
    for p, n in zip(places, found):
        same = [sum((codes[k - j : k + 1] == codes[p - j : p + 1]).all() for k in range(j, len(codes))) > 1 for j in range(5)]
        assert n == (same + [False]).index(False)
    least = {}
    for d, p in zip(docs, parts):
        for k in range(len(p) - 4):
            least[tuple(p[k : k + 5])] = min(d, least.get(tuple(p[k : k + 5]), d))
    assert fm_index.fm_engine(texts, docs, 5).tolist() == [least[tuple(p[k : k + 5])] for p in parts for k in range(len(p) - 4)]


def print_of(text):
    w = words(lower(text))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def groups_of(prints, ids, radius=3):
    a = np.array(prints, np.uint64)
    near = np.bitwise_count(a[:, None] ^ a[None, :]) <= radius
    label = np.array(ids)
    while True:
        new = np.array([label[r].min() for r in near])
        if (new == label).all():
            return label.tolist()
        label = new


def test_simhash_cases(odd, odd_rows, empty):
    prints, ids = [print_of(t) for _, t in odd_rows], [LAST if d is None else d for d, _ in odd_rows]
    want = sorted(zip(ids, prints, groups_of(prints, ids)))
    got = sorted((LAST if r.doc_id is None else r.doc_id, r["print"] % 2**64, LAST if r.component_id is None else r.component_id) for r in simhash.near_dedup(odd).collect())
    assert got == want
    assert simhash.near_dedup(empty).count() == 0


def test_simhash_links_through_null_ids(spark):
    text = [" ".join(f"w{i}" for i in range(300))]
    while len(text) < 3:  # each within the radius of the one before it only
        base = text[-1].split()
        for k in range(len(base)):
            new = " ".join([*base[:k], f"x{len(text)}", *base[k + 1 :]])
            near = [(print_of(new) ^ print_of(t)).bit_count() for t in text]
            if 0 < near[-1] <= 3 and all(n > 3 for n in near[:-1]):
                break
        else:
            raise AssertionError("no such text")
        text.append(new)
    other = "nothing like it at all " * 5
    docs = [(7, text[0]), (None, text[1]), (3, text[2]), (None, other)]
    got = {(r.doc_id, r["print"] % 2**64): r.component_id for r in simhash.near_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {(d, print_of(t)): None if t == other else 3 for d, t in docs}


def test_tile_pairs_are_skipped():
    rng = np.random.default_rng(5)
    prints = np.unique(rng.integers(0, 2**63, 1500).astype(np.uint64) & rng.integers(0, 2**63, 1500).astype(np.uint64))
    prints = np.unique(np.concatenate([prints, prints[:200] ^ np.uint64(5)]))
    ones = np.sort(np.bitwise_count(prints).astype(np.int64))
    low, high = ones[:: simhash.SMALL], np.append(ones[simhash.SMALL - 1 :: simhash.SMALL], ones[-1])[: -(-len(ones) // simhash.SMALL)]
    pairs = simhash.tile_pairs(low, high, np.zeros(len(low), int), 3)
    assert len(low) <= len(pairs) < len(low) * (len(low) + 1) // 2
    for side in (np.zeros(len(prints), np.int64), np.arange(len(prints)) % 2):
        i, j = simhash.near_pairs(prints, side, 3)
        got = {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist()) if a != b}
        near = np.argwhere(np.triu(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3, 1))
        assert got == {(a, b) for a, b in near.tolist() if side.max() == 0 or side[a] != side[b]} and got


def test_crowds_are_cut_into_full_tiles(spark):
    rng = np.random.default_rng(6)
    prints = [int(p) - (int(p) >> 63 << 64) for p in {int(x) for x in rng.integers(0, 2**63, 3000)}]
    rows = spark.createDataFrame([(0, 0, p, p) for p in prints], "band int, key long, print long, node long").withColumn("ones", F.bit_count("print").cast("int"))
    made = simhash.tiled(rows, rows.select("band", "key").distinct(), 3, 100).toPandas()
    assert made.groupby("tile")["print"].nunique().between(50, 150).mean() > 0.9
    ones = {p: (p % 2**64).bit_count() for p in prints}
    met = made.groupby(["low", "high"])["print"].agg(set)
    tile = dict(zip(made["print"], made["tile"]))
    assert len(met) < len(set(tile.values())) * (len(set(tile.values())) + 1) // 2
    for a, b in zip(rng.permutation(prints)[:1500].tolist(), rng.permutation(prints)[:1500].tolist()):
        pair = tuple(sorted((tile[a], tile[b])))
        if abs(ones[a] - ones[b]) <= 3:
            assert {a, b} <= met[pair]
    span = {t: (min(ones[p] for p in prints if tile[p] == t), max(ones[p] for p in prints if tile[p] == t)) for t in set(tile.values())}
    assert all(span[b][0] - span[a][1] <= 3 + 1 for a, b in met.index)


@pytest.mark.parametrize("tile, crowd, small", [(1024, 32, 128), (8, 32, 128), (16, 0, 4), (64, 32, 5)])
def test_links_in_any_tiling(spark, monkeypatch, tile, crowd, small):
    monkeypatch.setattr(simhash, "TILE", tile)
    monkeypatch.setattr(simhash, "SMALL", small)
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 20)
    prints = sorted({int(b) ^ sum(1 << int(x) for x in rng.integers(0, 64, rng.integers(0, 3))) for b in base for _ in range(15)})
    prints = [p - (p >> 63 << 64) for p in prints]
    nodes = spark.createDataFrame(list(zip(prints, range(len(prints)))), "print long, node long")
    found = {r.node: r.component for r in components(simhash.links(nodes, len(prints))).collect()}
    assert [found.get(i, i) for i in range(len(prints))] == groups_of([p % 2**64 for p in prints], range(len(prints)))


def test_components_of_a_long_path(spark):
    links = spark.range(1, 200).selectExpr("id AS u", "id - 1 AS v")
    assert {r.component for r in components(links).collect()} == {0}
