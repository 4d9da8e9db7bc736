"""Scoring, classifiers, pieces and quotations."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from frames import DATA, rows
from pyspark.sql import functions as F
from texts import lower, words

from lorespark.llm import features, pieces, ppm, quality_classifier, quality_rules, queries, quotations, training

LAST = 2**63 - 1


def held(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 7 == 2


def ppm_brute(data):
    k = ppm.ORDER
    count, ends, seen = Counter(), 0, [defaultdict(Counter) for _ in range(k + 1)]
    coded = [bytes([0xFE] * k) + lower(t).encode() + b"\xff" for _, t in data]
    for (d, t), b in zip(data, coded):
        if not held(d):
            count.update(words(lower(t)))
            ends += 1
            for i in range(k, len(b)):
                for o in range(k + 1):
                    seen[o][b[i - o : i]][b[i]] += 1
    tokens, kinds = sum(count.values()) + ends, len(count) + (ends > 0)

    def cost(context, s):
        p, gone = 0.0, set()
        for o in range(k, -1, -1):
            rest = {x: n for x, n in seen[o].get(context[k - o :], {}).items() if x not in gone}
            total = sum(rest.values())
            if s in rest:
                return p + math.log10((2 * rest[s] - 1) / (2 * total))
            if rest:
                p += math.log10(len(rest) / (2 * total))
                gone |= set(rest)
        return p - math.log10(255 - len(gone))

    for (d, t), b in zip(data, coded):
        w = words(lower(t))
        base = sum(math.log10((count[x] + 1) / (tokens + kinds + 1)) for x in w) + math.log10((ends + 1) / (tokens + kinds + 1))
        yield d, held(d), len(w) + 1, sum(count[x] > 0 for x in w) + (ends > 0), tokens, base, sum(cost(b[i - k : i], b[i]) for i in range(k, len(b)))


@pytest.mark.parametrize("block_bytes", [ppm.BLOCK_BYTES, 500])
def test_ppm(odd, odd_rows, block_bytes):
    got = sorted((tuple(r) for r in ppm.score(odd, block_bytes).collect()), key=repr)
    want = sorted(ppm_brute(odd_rows), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want])


def test_ppm_without_training_rows(spark):
    data = [(d, "only held out rows here") for d in range(300) if held(d)][:3]
    got = sorted(tuple(r) for r in ppm.score(spark.createDataFrame(data, "doc_id long, text string")).collect())
    assert np.allclose([g[5:] for g in got], [w[5:] for w in sorted(ppm_brute(data))])


def test_ppm_long_text(spark):
    data = [(1, "abc " * 600_000), (2, "x" * 2_000_000), (3, None)]
    got = {r.doc_id: r for r in ppm.score(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got[1].n_tokens == 600_001 and got[2].n_tokens == 2 and all(math.isfinite(r.score) for r in got.values())


def test_ppm_is_a_distribution(spark):
    rng = np.random.default_rng(0)
    pairs = {tuple(p) for p in rng.integers(97, 100, (300, 2)).tolist()}
    rows = [((a << 8 | b) << 8 | s, int(rng.integers(0, 3)) if 97 <= s < 100 else 0) for a, b in pairs for s in range(256) if s != ppm.BEFORE]
    p = {r.gram: 10**r.log_p for r in ppm.code_lengths(spark.createDataFrame(rows, "gram long, n long"), 2).collect()}
    assert len(p) == len(rows)
    for a, b in pairs:
        assert sum(v for g, v in p.items() if g >> 8 == (a << 8 | b)) == pytest.approx(1)


def test_ppm_beats_the_base_on_held_out_rows(spark):
    folder = DATA.replace("0.001", "0.1")  # with less to learn from, words alone predict better
    got = ppm.score(spark.read.parquet(f"{folder}/documents.parquet")).where("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert got["sum(score)"] > got["sum(base_score)"]


def block_table(texts):
    return pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.binary()), "block": pa.array([0] * len(texts), pa.int32())})


def test_ppm_cuts_a_block_into_strings_once(monkeypatch):
    texts, calls, cut = [b"some words, some more", b"", b"other words"] * 20, [], ppm.byte_slices
    table = block_table(texts)
    sent = ppm.send(table, 17)
    counts = [bytes(2 * len(c)) for c in sent["word_counts"].to_pylist()]
    logs = [ppm.packed(np.full(len(c) // 4, -1, "<f4")) for c in sent["gram_counts"].to_pylist()]
    answers = pa.table({"bucket": sent["bucket"], "counts": pa.array(counts, pa.binary()), "logs": pa.array(logs, pa.binary())})
    monkeypatch.setattr(ppm, "byte_slices", lambda t: calls.append(1) or cut(t))
    got = ppm.score_block(table, answers, 17, 100, 10, 50)
    assert got["score"].to_pylist() == [-len(t) - 1 for t in texts] and len(calls) == 1


@pytest.mark.parametrize("size", [1, 7, 50, 1 << 20])
def test_ppm_slices(monkeypatch, size):
    """Slices that end anywhere, and more texts than a slice's 16 bits tell apart, lose nothing."""
    monkeypatch.setattr(ppm, "SLICE", size)
    texts = [b"", b"a" * 40, b"abcabcabd", b"", b"\xe6\x97\xa5" * 9, b"x"] + [b"abc", b""] * (35_000 if size > 50 else 3)
    block = ppm.Block(block_table(texts), 7)
    grams = [[int.from_bytes(c[i : i + 6], "big") for i in range(len(c) - 5)] for c in (bytes([ppm.BEFORE] * 5) + t + bytes([ppm.END]) for t in block.texts)]
    count = Counter(g for own, learned in zip(grams, block.train) if learned for g in own)
    want = sorted({g for own in grams for g in own}, key=lambda g: (g % 7, g))
    assert block.grams.tolist() == want and block.gram_counts.tolist() == [count[g] for g in want]
    log_p = {g: -i / 8 for i, g in enumerate(want)}
    assert np.allclose(block.scores(np.array([log_p[g] for g in want])), [sum(map(log_p.__getitem__, own)) for own in grams])


def test_ppm_empty(empty):
    assert ppm.score(empty).count() == 0


def rules_brute(text):
    w = words(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n, covered, seen, dup = Counter(windows), set(), set(), 0
    for i, x in enumerate(windows):
        if n[x] > 1:
            covered.update(range(i, i + 5))
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_rule_counts(odd, odd_rows, labels, empty):
    got = quality_rules.rules(odd, labels).collect()
    want = [(d, *(s := rules_brute(t)), s[0] < 10 or 100 * s[4] > 20 * s[0]) for d, t in odd_rows]
    assert sorted((tuple(r)[:7] for r in got), key=repr) == sorted(want, key=repr)
    assert all(0 <= r.score <= 1 and not (r.kept and r.base_failed) for r in got)
    assert quality_rules.rules(empty, labels).count() == 0 and quality_rules.rules(odd, labels.limit(0)).count() == len(odd_rows)


@pytest.mark.parametrize("operator, column", [(quality_rules.rules, "kept"), (quality_classifier.classify, "predicted")])
def test_held_out_accuracy(spark, operator, column):
    folder = DATA.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = operator(docs, labels).select("doc_id", "score").join(labels, "doc_id").toPandas()
    fold = np.array([zlib.crc32(str(d).encode()) % 5 == 0 for d in got.doc_id])
    assert ((got.score >= (0.3 if column == "predicted" else 0.5)) == got.quality)[fold].mean() > 0.93


def small(rng, n, size):
    """A Matrix of n sparse rows over the first numbers and the statistics, and the same as a dense array."""
    at = [np.append(np.sort(rng.choice(size, 5, replace=False)), np.arange(features.SIZE - features.DENSE, features.SIZE)).astype("<i4") for _ in range(n)]
    values = [rng.normal(size=len(a)).astype("<f4") for a in at]
    full = np.zeros((n, features.SIZE))
    for row, a, v in zip(full, at, values):
        row[a] = v
    return features.Matrix([a.tobytes() for a in at], [v.tobytes() for v in values]), full


def test_matrix_is_its_dense_form():
    rng = np.random.default_rng(1)
    m, full = small(rng, 7, 20)
    w, r = rng.normal(size=features.SIZE), rng.normal(size=7)
    assert np.allclose(m.dot(w), full @ w) and np.allclose(m.t_dot(r), full.T @ r) and np.allclose(m.dense(), full[:, -features.DENSE :])
    assert np.allclose(features.Matrix.stack(m.pick(np.array([5, 2])), m).dot(w), (full @ w)[[5, 2, *range(7)]])


def test_packed_matrices_come_back_whole():
    rng = np.random.default_rng(7)
    parts = [small(rng, n, 20)[0] for n in (7, 0, 1, 300)]
    want, got = features.Matrix.stack(*parts), features.Matrix.unpacked([m.packed() for m in parts])
    for column in ("at", "values", "sizes", "begin"):
        assert np.array_equal(getattr(want, column), getattr(got, column))
    assert features.Matrix.unpacked([]).sizes.size == 0


@pytest.mark.parametrize("prior", [0.3, 0.95])
def test_risk_and_its_gradient(prior):
    rng = np.random.default_rng(2)
    x, full = small(rng, 12, 20)
    positive = np.arange(12) < 5
    some = np.append(np.flatnonzero(full.any(axis=0)), features.SIZE)
    w = np.zeros(features.SIZE + 1)
    w[some] = rng.normal(size=len(some))
    if prior > 0.5:  # towards the positives, so that they explain more than there is
        w[:-1] += 8 * full[positive].mean(axis=0)

    def parts(w):
        s = [1 / (1 + math.exp(-(row @ w[:-1] + w[-1]))) for row in full]
        first = prior * sum(1 - s[i] for i in range(5)) / 5
        return first, sum(s[5:]) / 7 - prior * sum(s[:5]) / 5

    first, rest, slope = quality_classifier.risk(w, x, positive, prior)
    assert np.allclose((first, rest), parts(w)) and (rest < 0) == (prior > 0.5)
    for i in some:
        step = np.zeros_like(w)
        step[i] = 1e-5
        up, down = parts(w + step), parts(w - step)
        want = (sum(up) - sum(down)) / 2e-5 if rest >= 0 else -(up[1] - down[1]) / 2e-5
        assert slope[i] == pytest.approx(want, abs=1e-6)


def test_class_prior():
    rng = np.random.default_rng(3)

    def rows(n, share):
        good = rng.random(n) < share
        at = np.arange(features.SIZE - features.DENSE, features.SIZE, dtype="<i4").tobytes()
        return features.Matrix([at] * n, [(rng.normal(size=features.DENSE) + 3 * g).astype("<f4").tobytes() for g in good])

    for share in (0.2, 0.5, 0.9):
        assert quality_classifier.class_prior(rows(2000, 1), rows(3000, share)) == pytest.approx(share, abs=0.05)


def test_logistic_and_calibration():
    rng = np.random.default_rng(4)
    x, full = small(rng, 60, 6)
    y, weight = (rng.random(60) < 0.4).astype(int), np.full(60, 1 / 60)
    w = quality_rules.logistic(x, y, weight)
    slope = full.T @ (weight * (1 / (1 + np.exp(-(full @ w[:-1] + w[-1]))) - y)) + quality_rules.L2 * w[:-1]
    assert np.abs(slope).max() < 0.02  # a minimum of the penalised loss
    z = rng.normal(size=200) * 3
    y = (rng.random(200) < 1 / (1 + np.exp(-(0.5 * z + 1)))).astype(int)
    a, b = quality_rules.calibration(z, y, np.full(200, 1 / 200))
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (200 - y.sum() + 2))
    loss = lambda a, b: -(t * np.log(p := 1 / (1 + np.exp(-(a * z + b)))) + (1 - t) * np.log(1 - p)).mean()
    assert all(loss(a, b) <= loss(a + i, b + j) + 1e-6 for i in (-0.05, 0, 0.05) for j in (-0.05, 0, 0.05))


def test_features_by_counting():
    texts = ["Ünï cödé 日本語のテキスト a b a b", "x", "", "日本", "plain words, plain words again\nplain"]
    part = features.analyse(texts, features.WordCodes())
    full = np.zeros((len(texts), features.SIZE))
    for row, (at, values) in zip(full, part.rows()):
        row[at] = values
    for row, t in zip(full, texts):
        grams, w = Counter(t[i : i + 3] for i in range(len(t) - 2)), words(t)
        h = lambda g: ((((ord(g[0]) * 0x9E3779B1 ^ ord(g[1])) * 0x85EBCA6B ^ ord(g[2])) * 0x9E3779B1) & 0xFFFFFFFF) >> 16
        chars = np.zeros(1 << 16)
        for g, n in grams.items():
            chars[h(g)] += features.SCALE * n / max(1, len(t) - 2)
        assert np.allclose(row[: 1 << 16], chars, atol=1e-5) and np.isclose(row[1 << 16 : 2 << 16].sum(), features.SCALE * bool(w), atol=1e-4)
        assert np.isclose(row[2 << 16 : 3 << 16].sum(), features.SCALE * (len(w) > 1), atol=1e-4)
    weights = np.random.default_rng(0).normal(size=features.SIZE)
    assert np.allclose(part.sums(weights), full @ weights, rtol=1e-4, atol=1e-4)


def test_samples_are_bounded(spark):
    """Rows that repeat an id add nothing to a sample, and its features have a limit."""
    docs = spark.createDataFrame([(7, f"text {i} of many") for i in range(400)] + [(i, "good words " * 20) for i in range(100, 140)], "doc_id long, text string")
    some = docs.select("doc_id")
    ids = training.bounded(some, 30, "x").withColumn("label", F.lit(1))
    assert ids.count() == 30 and training.sampled(training.bounded(some, 1000, "x").withColumn("label", F.lit(1)), docs).count() == 41
    made = training.sampled(ids, docs, max_bytes=4000).toPandas()
    assert 0 < made["at"].map(len).sum() + made["vals"].map(len).sum() <= 4000


def test_classifier_in_chunks(spark):
    """Chunks of any size and documents in any number of tasks keep the classes apart."""
    folder = DATA.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    for parts, chunk in ((1, 1 << 19), (3, 1 << 22), (64, 1 << 21)):
        w = quality_classifier.train(docs.repartition(parts), labels, chunk=chunk)
        got = docs.select("doc_id", (quality_classifier.scorer(w, docs["text"]) >= 0.3).cast("int").alias("predicted")).join(labels, "doc_id").toPandas()
        assert (got.predicted == got.quality).mean() > 0.93


def test_classifier_cases(odd, odd_rows, labels, empty):
    got = quality_classifier.classify(odd, labels)
    assert set(odd.columns) <= set(got.columns) and got.count() == len(odd_rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.collect())
    assert quality_classifier.classify(empty, labels).count() == 0 and quality_classifier.classify(odd, labels.limit(0)).where("score = 0.5").count() == len(odd_rows)


def test_pieces(odd, odd_rows, empty):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = []
    for d, t in odd_rows:
        ids = [*sp.encode(t or ""), sp.eos_id()]
        want.append((d, ids, sp.decode(ids)))
    assert sorted((tuple(r) for r in pieces.encode_decode(odd).collect()), key=repr) == sorted(want, key=repr)
    assert pieces.encode_decode(empty).count() == 0


def test_piece_texts():
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, encode = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Encoder(path)
    texts = ["  a", "a  b   c ", "x▁y", "日本語 🎉🎉", "a\x00b \x00 c", "\n\n a \t", "<s> </s> <unk> <0x0A>", "▁▁▁ ▁", "é" * 500, "ab" * 900, "x" * 300_000, "日本" * 50_000, " " * 50, "Don't, e.g. this.\nThat!"]
    ids, decoded = encode(texts)
    for t, i, text in zip(texts, ids, decoded):
        own = np.frombuffer(i, "<i4").tolist()
        assert own == [*sp.encode(t), sp.eos_id()] and text == sp.decode(own)


def test_short_words_are_merged_side_by_side(monkeypatch):
    """Words get the ids that merging each by itself gives, without an agenda for each."""
    vocabulary, rng = pieces.Vocabulary(public_tokenizers.path("piece_bpe_32k.model")), np.random.default_rng(5)
    letters = np.array(list("aaaeeettinosrh" + pieces.MARK + "éß日本🎉\0\n<0A>"))
    made = {pieces.MARK + "".join(rng.choice(letters, rng.integers(0, 80))) for _ in range(3000)}
    words = [*made, *(pieces.MARK + c * n for c in ("a", "ab", "=", " ", "日") for n in (1, 2, 5, 62, 63, 64, 65, 200)), *vocabulary.score]
    want, agendas, merge = [vocabulary.merge(w) for w in words], [], pieces.Vocabulary.merge
    for cells in (1 << 18, 64):
        monkeypatch.setattr(pieces, "CELLS", cells)
        ids, n = vocabulary.merge_all(words)
        assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert [len(x) for x in vocabulary.merge_all([])] == [0, 0]
    monkeypatch.setattr(pieces.Vocabulary, "merge", lambda self, w: agendas.append(w) or merge(self, w))
    pieces.Encoder(public_tokenizers.path("piece_bpe_32k.model"))([f"word{i} other{i}" for i in range(100)])
    assert len(agendas) <= 1  # the check's first word


def test_words_of_a_vocabulary_with_ties(tmp_path):
    """Pieces of one score merge leftmost first; characters that are no piece are unknown where no bytes are."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.trainer_spec.model_type, proto.normalizer_spec.add_dummy_prefix, proto.normalizer_spec.remove_extra_whitespaces = 2, True, False
    kinds = type(proto.pieces.add(piece="<unk>", score=0, type=2))
    for p, score in ((pieces.MARK, -9), ("a", -9), ("b", -9), ("ab", -1), ("ba", -1), ("aa", -1), ("aba", -2), ("xa", -2), ("abab", -3)):
        proto.pieces.add(piece=p, score=score, type=kinds.NORMAL)
    path = tmp_path / "ties.model"
    path.write_bytes(proto.SerializeToString())
    vocabulary = pieces.Vocabulary(str(path))
    words = [pieces.MARK + "".join("abx"[i // 3**k % 3] for k in range(n)) for n in range(7) for i in range(3**n)]
    ids, n = vocabulary.merge_all(words)
    want = [vocabulary.merge(w) for w in words]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_pieces_digest(spark):
    got = {r.doc_id: r for r in queries.op9_sentencepiece(spark, DATA).collect()}
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(20).collect():
        ids = [*sp.encode(r.text), sp.eos_id()]
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and got[r.doc_id].n_tokens == len(ids)


CHAT = [
    (1, 0, "user", "Hello there\nsecond line\n\nother para"), (1, 1, "assistant", "> Hello there\n> second  line\nI answer A"), (1, 2, "user", "unrelated"),
    (1, 3, "user", ">> hello there\n>> second line\n> I answer A\n\nreply to 1"), (1, 4, "assistant", "> other para\nb"),
    (1, 5, "user", "> nothing known\n>> reply to 1\nx"), (1, 6, "user", "> x\n> b\nlast"), (2, 0, "user", "> Hello there"), (3, 0, "user", None), (3, 1, None, ""),
]
CHAT_DDL = "conv_id long, turn long, role string, text string"


def test_quotations(spark):
    import duckdb

    chat = spark.createDataFrame(CHAT, CHAT_DDL).withColumn("level", quotations.F.lit(1))
    got = quotations.link_replies(chat).toPandas()
    conversations = chat.drop("level").toPandas()  # noqa: F841
    assert rows(got) == rows(duckdb.sql(quotations.ORACLE).df())
    links = {(r.conv_id, r.turn): (r.reply_to, r.thread, r.depth) for r in quotations.link_replies(chat).collect()}
    assert links[1, 3] == (1, 0, 2) and links[1, 6] == (5, 0, 4) and links[2, 0] == (None, 0, 0)


def test_quotation_edges(spark):
    chat = spark.createDataFrame([*CHAT[:2], CHAT[0], (None, 1, "user", "> Hello there"), (1, None, "user", "> Hello there"), (1, 1, "user", "other")], CHAT_DDL)
    got = quotations.link_replies(chat).collect()
    assert len(got) == 5 and {r.reply_to for r in got if r.conv_id is None or r.turn is None} == {None}
    assert quotations.link_replies(chat.limit(0)).count() == 0


def test_quotations_in_the_tables(spark, duck):
    got = queries.quoted_replies(spark, DATA).toPandas()
    assert got.reply_to.notna().sum() > 20 and got.depth.max() > 1
    assert rows(got) == rows(duck.execute(quotations.QUOTING_ORACLE).df())


def test_long_quotations(spark):
    own = "\n".join(f"line {i}" for i in range(20_000))
    chat = spark.createDataFrame([(1, 0, "user", own), (1, 1, "user", own.replace("line", "> line").replace("\n", "\n") + "\n> " + "x" * 500_000)], CHAT_DDL)
    got = {r.turn: r for r in quotations.link_replies(chat).collect()}
    assert got[1].reply_to == 0 and got[1].body == "" and got[0].body == own


def test_quotation_sql(spark, duck):
    assert rows(queries.op7_quotation_linking(spark, DATA).toPandas()) == rows(duck.execute(quotations.ORACLE).df())
