"""Collocations, vector codes and license scans against brute force and SQL."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from frames import DATA, rows
from texts import lower

from lorespark.llm import collocations, licenses, queries, vector_codes


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_license_scans", "op13_phrase_collocations"])
def test_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), duck.execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


# Collocations.


def phrases_brute(data, least, top):
    counts, totals = {}, Counter()
    for lang, text in data:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text)):
            w = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for i in range(len(w)):
                for k in range(1, 5):
                    if i + k <= len(w):
                        counts.setdefault(lang, Counter())[tuple(w[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        kept = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and inside(p, q) for q, b in found.items()):
                continue
            score, _, l, r = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))  # noqa: E741
            kept.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, totals[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def phrase_data():
    rng = random.Random(3)
    vocabulary = ["Of", "the", "new", "york", "city", "ü", "日本", "x\x00y", "a-b", "12:30"]
    data = [(rng.choice(["en", "de", None, "und", ""]), "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "  ", "\t", ". ", "\r\n", ","]) for _ in range(rng.randrange(60)))) for _ in range(300)]
    return data + [("en", None), ("en", ""), (None, " . \n"), ("xx", "one two " * 500), ("de", "New York City " * 40), ("de", "New York City " * 40)]


@pytest.mark.parametrize("shard_bytes", [1, 500, 1 << 20])
def test_phrases_brute(spark, shard_bytes):
    data = phrase_data()
    docs = spark.createDataFrame([(*d, 1, 2) for d in data], "lang string, text string, bucket int, id int").repartition(3)
    for least, top in ((3, 40), (30, 2000)):
        got = collocations.collocations(docs, least=least, top=top, shard_bytes=shard_bytes).collect()
        assert sorted(tuple(r) for r in got) == phrases_brute(data, least, top)


def test_phrases_of_long_texts(spark, monkeypatch):
    """Texts of many slices, one without a blank, and one piece that runs through all slices."""
    monkeypatch.setattr(collocations, "SLICE", 64)
    shard = collocations.Shard()
    text = ("alpha beta gamma, delta " * 200 + "z" * 500 + " end. " + "alpha beta " * 300).encode()
    for part in (text, b"", b"last word"):
        shard.add("en", part)
    made = shard.rows(0, 1).to_pylist()
    names = {p: k for p, k in zip(collocations.unpacked(made[1]["places"], "<i4").tolist(), made[1]["keys"])}
    codes = np.concatenate([collocations.unpacked(r["words"], "<i4") for r in made if r["bucket"] is None])
    got = " ".join("|" if c < 0 else collocations.split_key(names[c])[1].decode() for c in codes)
    want = " | ".join(" ".join(p.split()) for t in (text, b"last word") for p in re.split("[.,]", t.decode()) if p.split())
    assert got == "| " + want


def test_phrases_empty(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(docs).count() == 0
    assert collocations.collocations(spark.createDataFrame([("en", None), (None, " ")], docs.schema)).count() == 0


def test_weakest_cut_is_exact(spark):
    """Products beyond 64 bits."""
    a, heads, tails = 10**17 + 7, [9 * 10**18, 10**18 + 3], [9 * 10**18, 10**17 + 9]
    row = spark.createDataFrame([(a, heads, tails)], "a long, heads array<long>, tails array<long>").select(collocations.weakest_cut().alias("c")).first()["c"]
    want = min((2000000 * a // (x + y), k, x, y) for k, (x, y) in enumerate(zip(heads, tails)))
    assert tuple(row) == want


def test_automaton_counts_places():
    """Every substring of up to four words of a shard has as many places as it occurs."""
    rng = random.Random(5)
    words = np.array([rng.randrange(-1, 4) for _ in range(400)], "<i4")
    states, names = words, {i: (i,) for i in range(4)}
    for depth in (2, 3, 4):
        key = collocations.keys_of(words, states, depth)
        known = np.unique(key[key >= 0])
        names = {i: (int(k & (1 << collocations.WORD_BITS) - 1), *names[int(k >> collocations.WORD_BITS)]) for i, k in enumerate(known)}
        states = np.where(key >= 0, np.searchsorted(known, key), -1)
        runs = [tuple(words[i : i + depth].tolist()) for i in range(len(words) - depth + 1)]
        assert Counter(names[i] for i in states[states >= 0].tolist()) == Counter(r for r in runs if min(r) >= 0)


# Vector codes.


def codes_brute(data, parts=16, entries=64, rounds=2):
    kept = [(i, v, g) for i, v, g in data if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[math.floor(x * 256) if abs(x) < 2**60 else int(x) * 256 for x in v] for _, v, _ in kept]
    w = len(whole[0]) // parts if whole else 0
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for v in whole]
    books = [[v[p] for v in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda: [[min(range(len(books[p])), key=lambda e: (far(v[p], books[p][e]), e)) for p in range(parts)] for v in cut]
    for _ in range(rounds):
        codes = near()
        new = []
        for p in range(parts):
            own = [[v[p] for v, c in zip(cut, codes) if c[p] == e] for e in range(len(books[p]))]
            new.append([[sum(x) // len(g) for x in zip(*g)] if g else old for g, old in zip(own, books[p])])
        books = new
    codes = near()
    errors = [sum(far(v[p], books[p][c[p]]) for p in range(parts)) for v, c in zip(cut, codes)]
    sums = Counter()
    for (_, _, g), e in zip(kept, errors):
        sums[g] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join("%02x" % x for x in c), e, sums[g], digest) for (i, _, g), c, e in zip(kept, codes, errors)), key=repr)


def compressed(df, **how):
    return sorted((tuple(r) for r in vector_codes.with_label_errors(*vector_codes.compress(df, **how)).collect()), key=repr)


@pytest.mark.parametrize("scale,kind", [(1.0, "float"), (0.01, "double"), (3e5, "float")])
def test_codes_brute(spark, monkeypatch, scale, kind):
    monkeypatch.setattr(vector_codes, "BLOCK", 7)
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(150, 32)) * scale).astype("f4").astype(float).tolist()
    data = [(int(i), v, int(i) % 3 or None) for i, v in zip(rng.permutation(150), vectors)]
    data += [(7, data[0][1], 1), (7, data[0][1], 1), (None, data[3][1], None), (200, None, 1), (201, [math.nan] * 32, 1), (202, [math.inf, *vectors[0][1:]], 2), (203, [None, *vectors[0][1:]], 2), (-5, data[9][1], 9)]
    df = spark.createDataFrame([(*d, "x") for d in data], f"vec_id long, embedding array<{kind}>, label int, code string").repartition(5)
    assert compressed(df) == codes_brute(data)
    assert compressed(df, parts=4, entries=3, rounds=3) == codes_brute(data, 4, 3, 3)


def test_codes_of_large_numbers(spark):
    """Beyond 64 bits on the way."""
    assert vector_codes.whole(np.array([1e300, -2.5, 0.001]), object).tolist() == [int(1e300) * 256, -640, 0]
    groups = [0.0, 2.0**40, -(2.0**41), 2.0**43]
    data = [(i, [groups[i % 4] + (i * k) % 5 for k in range(32)], i % 2) for i in range(40)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    assert compressed(df, entries=4) == codes_brute(data, entries=4)


def test_codes_of_few_rows(spark):
    schema = "vec_id long, embedding array<float>, label string"
    assert compressed(spark.createDataFrame([], schema)) == []
    assert compressed(spark.createDataFrame([(1, None, "a")], schema)) == []
    assert compressed(spark.createDataFrame([(1, [1.0] * 16, "a")], schema))[0][:4] == (1, "00" * 16, 0, 0)
    for bad in ([(1, [1.0] * 15, "a")], [(1, [1.0] * 16, "a"), (2, [1.0] * 32, "a")]):
        with pytest.raises(ValueError):
            vector_codes.compress(spark.createDataFrame(bad, schema))


# License scans.


def license_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))


def base_brute(text):
    w, found = license_words(text), []
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    starts = [i for i, _ in found]
    return len(w), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def test_license_base(spark, odd_rows):
    long = "Pad word. " * 50_000 + "ALL RIGHTS reserved " * 3
    texts = [t for _, t in odd_rows] + ["CC BY", "cc\x00by;cc-by cc", "all rights all rights reserved", "general public license " * 5, "licence généraleK cc by", "by cc by cc by", long]
    docs = spark.createDataFrame([(i // 2 if i % 5 else None, t, "en", 1) for i, t in enumerate(texts + texts[-3:])], "doc_id long, text string, label string, at int").repartition(4)
    got = sorted((tuple(r[:6]) for r in licenses.scan(docs).collect()), key=repr)
    assert got == sorted(((r.doc_id, *base_brute(r.text)) for r in docs.collect()), key=repr)


def labels_of(spark, texts):
    found = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return {r.doc_id: (r.labels, round(r.score, 4)) for r in found}


def test_license_labels(spark):
    mit = dict(licenses.NOTICES[::-1])["mit"]
    notice = licenses.NOTICES[3][1]
    w = notice.split()
    got = labels_of(spark, [
        f"before {mit} after", notice.upper(), " ".join(w[:8] + ["really"] + w[8:]), " ".join(w[:8] + w[9:]), " ".join(w[:8]), "of the in the to any", "Licensed under CC BY-NC 4.0.", "",
    ])
    assert got[0] == ("mit", 1.0) and got[1] == ("mit", 1.0)
    assert got[2] == ("mit", 1.0)  # a word added: two neighbouring diagonals
    assert got[3][0] == "mit" and 0.9 <= got[3][1] < 1
    assert got[4][0] == "" and 0 < got[4][1] < 0.9
    assert got[5][0] == "" and got[7] == ("", 0.0)
    assert got[6] == ("cc-by,cc-by-nc", 1.0)


def test_license_own_templates(spark):
    known = licenses.templates(spark, {"free to use": "free"}, [("odd", "Do what you like with these files, whoever you may be")], k=3)
    found = licenses.scan(spark.createDataFrame([(0, "it is FREE to use, do what you like with these files whoever you may be"), (1, "free to"), (2, "to use free to use")], "doc_id long, text string"), known, 3)
    assert {r.doc_id: (r.n_base, r.first_word, r.labels) for r in found.collect()} == {0: (1, 2, "free,odd"), 1: (0, None, ""), 2: (1, 2, "free")}
    with pytest.raises(Exception, match="needs 2 words"):
        licenses.templates(spark, {"one": "x"}, []).collect()


def test_license_is_native(spark):
    plan = licenses.scan(spark.createDataFrame([(1, "cc by")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|InArrow", plan)


def test_license_empty(spark, empty):
    assert licenses.scan(empty).count() == 0
