import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lorespark.llm import packing
from lorespark.llm.common import materialize

END = 0


def ids_of(texts):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [[*e.ids, END] for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_ids_equal_the_library():
    texts = ["", " ", "  a", "a  b \n c", "x's y'll  zé \t q", "<|endoftext|> 12345 …", "日本語 🎉🎉", "a" * 3000, "\n\n\n", "a\x00b"]
    encode = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert [[*encode(t).tolist(), END] for t in texts] == ids_of(texts)


@pytest.mark.parametrize("space", [" ", "\n", " \n", "\u3000", "\x1c"])
def test_long_white_space(space):
    run = space * (120_000 // len(space))
    texts = [f"a{run}", f"{run}b", f"a b{run}'s c{run[:99_999]}7 {run[:100_000]}d"] + [" " * 1_000_000] * (space == " ")
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for t in texts:
        assert encode(t).tolist() == tok.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["\n" * 1_000_000, "a" * 1_000_000, "é" * 300_000, "7" * 1_000_000, "." * 1_000_000, "ab1 " * 250_000])
def test_long_runs(text):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))(text).tolist() == tok.encode(text, add_special_tokens=False).ids


def test_added_tokens(spark):
    run = " " * 120_000
    texts = ["a<|endoftext|>b", "<|endoftext|>", " <|endoftext|><|endoftext|> x", "<|endoftext| >", f"a{run}<|endoftext|>{run}b", "plain"]
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = packing.cut(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for d, t in enumerate(texts):
        got = [i for p in sorted((p for p in pieces if p.doc_id == d), key=lambda p: p.start) for i in np.frombuffer(p.ids, "<u4").tolist()]
        assert got == [*tok.encode(t, add_special_tokens=False).ids, END]


def test_pieces_and_places(odd, odd_rows):
    got = packing.pack(odd).toPandas()
    want = sorted(zip([-1 if d is None else d for d, _ in odd_rows], map(tuple, ids_of([t or "" for _, t in odd_rows]))))
    docs = got.assign(doc_id=got.doc_id.fillna(-1).astype(int))
    whole = []
    for (doc, crc), g in docs.assign(first=0).groupby(["doc_id", "first"]):
        g = g.sort_values("start")
        starts = [0] if (g.start == 0).all() else None
        if starts is None:
            assert g.start.tolist() == [0, *np.cumsum(g.length)[:-1]] and (g.length[1:] == packing.CAPACITY).all()
            whole.append((doc, tuple(i for b in g.ids for i in np.frombuffer(b, "<u4").tolist())))
        else:
            whole += [(doc, tuple(np.frombuffer(b, "<u4").tolist())) for b in g.ids]
    assert sorted(whole) == want
    for _, g in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= packing.CAPACITY


def test_digest(odd):
    full, small = packing.pack(odd).toPandas(), packing.packed_digest(odd).toPandas()
    assert sorted(zlib.crc32(b) for b in full.ids) == sorted(small.ids_crc32)


def test_empty(empty):
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_plan_is_best_fit(seed):
    rng = random.Random(seed)
    histogram = {rng.randint(1, 64): rng.randint(1, 30) for _ in range(12)}
    rows = packing.plan(histogram, 64)
    used, n = {}, {length: 0 for length in histogram}
    for length, a, b, first, each, offset in sorted(rows, key=lambda r: (-r[0], r[1])):
        assert a == n[length]
        n[length] = b
        for i in range(a, b):
            seq = first + (i - a) // each
            assert used.get(seq, 0) == offset + (i - a) % each * length
            used[seq] = used.get(seq, 0) + length
    assert n == histogram and max(used.values()) <= 64 and sorted(used) == list(range(len(used)))
    room = []  # best fit decreasing, one piece at a time
    for length in sorted((x for x, k in histogram.items() for _ in range(k)), reverse=True):
        fit = [r for r in room if r >= length]
        if fit:
            room.remove(min(fit))
            room.append(min(fit) - length)
        else:
            room.append(64 - length)
    assert len(used) == len(room)


def test_plan_joined_by_shuffle(odd, monkeypatch):
    want = packing.packed_digest(odd).toPandas()
    monkeypatch.setattr(packing, "BROADCAST_PLAN", 0)
    monkeypatch.setattr(packing, "RANKED", 2)
    got = packing.packed_digest(odd).toPandas()
    assert len(got) == len(want) and got.sequence_id.nunique() == want.sequence_id.nunique()
    for _, g in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= packing.CAPACITY


def test_full_pieces(spark):
    """Pieces that fill a sequence have one each; no two share a number."""
    pieces = spark.range(500).selectExpr("id AS doc_id", "0 AS piece", "if(id % 3 = 0, 8, id % 5 + 1) AS length").repartition(7)
    got = packing.place(materialize(pieces, "pieces"), 8).toPandas()
    assert len(got) == 500 and (got.groupby("sequence_id").length.sum() <= 8).all()
    full = got[got.length == 8]
    assert full.sequence_id.is_unique and (full.offset == 0).all() and not set(full.sequence_id) & set(got[got.length < 8].sequence_id)
