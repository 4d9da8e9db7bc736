"""Phrase collocations from generalised suffix automata, one for each shard of text, grown depth by depth.

A shard holds the words of some documents as numbers, a break between pieces. In its automaton the state of a place is
the substring that ends there; the suffix link of a state leads to the substring without its first word, and a state
of one more word is told by its link and the word before (``grow``). Its endpos count is the number of places that
share it. Counts are added up over all shards after each depth (``add_up``), and a state grows only where its link and
the substring without its last word occur often enough everywhere: no longer substring occurs more often than what it
holds, so nothing is lost. Shards send each substring once with its count, packed by bucket; buckets answer each shard
with the numbers of its frequent substrings.

The frequent substrings of each depth are tables. Suffix links, and the matching links to the substring without its
last word, give the counts of the parts of a phrase and tell which longer phrases hold it.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorespark.sources.work import release

from .common import materialize
from .ppm import packed, unpacked

#: Words of the longest phrase, occurrences of a candidate, and phrases of each language.
LONGEST, LEAST, TOP = 4, 30, 2000
#: A phrase goes when a longer one has at least this share (in percent) of its occurrences.
COVERED = 80
SCALE = 2_000_000
#: Shares of a language's phrases that are ranked apart first.
SALTS = 64
#: Bytes of text of a shard, of text that a bucket answers for, and of a slice that is cut into words at once.
SHARD_BYTES, BUCKET_BYTES, SLICE = 6 << 20, 12 << 20, 1 << 20
UNKNOWN = "und"

LOWER = bytes(range(256)).lower()
#: 0 of a word, 1 between words, 2 between pieces.
KIND = np.zeros(256, np.uint8)
KIND[list(b" \t")] = 1
KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
#: Places of a shard in one row: the rows stay small beside the heap of an executor.
PLACES = 50_000
#: Places of a left word in a substring's key; its link takes the rest.
WORD_BITS = 31

SHARDS = pa.schema([
    ("shard", pa.int64()), ("bucket", pa.int32()), ("part", pa.int32()), ("words", pa.binary()), ("states", pa.binary()), ("keys", pa.list_(pa.binary())), ("counts", pa.binary()), ("places", pa.binary()),
    ("totals", pa.map_(pa.string(), pa.int64())),
])
SHARDS_DDL = "shard long, bucket int, part int, words binary, states binary, keys array<binary>, counts binary, places binary, totals map<string,long>"
ANSWERS = pa.schema([("shard", pa.int64()), ("ids", pa.binary()), ("at", pa.binary()), ("keys", pa.list_(pa.binary())), ("counts", pa.binary())])
ANSWERS_DDL = "shard long, ids binary, at binary, keys array<binary>, counts binary"


def words_of(data: bytes) -> tuple[pa.Array, np.ndarray, bool]:
    """The words of a slice, whether something between pieces stands before each, and whether something does after the last."""
    flat = np.frombuffer(data.translate(LOWER), np.uint8)
    kind = KIND[flat]
    inside = (kind == 0).view(np.int8)
    edge = np.diff(inside, prepend=np.int8(0), append=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.concatenate([np.zeros(1, np.int32), np.cumsum(end - start, dtype=np.int32)])
    words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(flat[inside.view(bool)])])
    passed = np.cumsum(kind == 2, dtype=np.int32)
    before = np.diff(passed[start], prepend=np.int32(0)) > 0
    return words, before, bool(len(flat) and passed[-1] > (passed[start[-1]] if len(start) else 0))


class Shard:
    """Texts of several languages as numbers of their words."""

    def __init__(self):
        self.size = 0
        self.waiting: dict[str, list[bytes]] = {}
        self.waits: dict[str, int] = {}
        self.words: dict[str, list[pa.Array]] = {}
        self.before: dict[str, list[np.ndarray]] = {}
        self.open: dict[str, bool] = {}

    def add(self, lang: str, text: bytes) -> None:
        self.size += len(text) + 1
        for part in cut(text):
            self.waiting.setdefault(lang, []).append(part)
            self.waits[lang] = self.waits.get(lang, 0) + len(part)
            if self.waits[lang] >= SLICE:
                self.split(lang)

    def split(self, lang: str) -> None:
        words, before, after = words_of(b"".join(self.waiting.pop(lang)))
        self.waits[lang] = 0
        if len(words):
            before[0] |= self.open.get(lang, True)
            self.words.setdefault(lang, []).append(words)
            self.before.setdefault(lang, []).append(before)
        self.open[lang] = after or (self.open.get(lang, True) and not len(words))

    def rows(self, number: int, n_buckets: int) -> pa.Table:
        """The shard's words as numbers (-1 between pieces), and a row of its distinct words for each bucket."""
        for lang in list(self.waiting):
            self.split(lang)
        streams, keys, counts, totals = [], [], [], {}
        n_words = 0
        for lang in list(self.words):
            found = pa.chunked_array(self.words.pop(lang)).dictionary_encode()
            known, codes = found.chunk(found.num_chunks - 1).dictionary, np.concatenate([c.indices.to_numpy() for c in found.chunks])
            counts.append(np.bincount(codes, minlength=len(known)))
            totals[lang] = len(codes)
            keys.append(pc.binary_join_element_wise(pa.scalar(lang_key(lang), pa.binary()), known, pa.scalar(b"", pa.binary())))
            before = np.concatenate(self.before.pop(lang))
            streams.append(np.insert(codes + n_words, np.flatnonzero(before), -1).astype("<i4"))
            n_words += len(known)
        out = places(number, np.concatenate([np.empty(0, "<i4"), *streams]), None)
        out[0]["totals"] = list(totals.items())
        if n_words:
            keys, counts = pa.concat_arrays(keys), np.concatenate(counts)
            bucket = np.fromiter(map(zlib.crc32, keys.to_pylist()), np.int64, n_words) % n_buckets
            for b, at in groups(bucket):
                out.append({"shard": number, "bucket": b, "keys": keys.take(pa.array(at)), "counts": packed(counts[at].astype("<i8")), "places": packed(at.astype("<i4"))})
        return table(out, SHARDS)


def places(shard: int, words: np.ndarray, states: np.ndarray | None) -> list[dict]:
    """Rows of a shard's places."""
    cuts = range(0, max(1, len(words)), PLACES)
    return [{"shard": shard, "part": i, "words": packed(words[at : at + PLACES]), "states": None if states is None else packed(states[at : at + PLACES])} for i, at in enumerate(cuts)]


def table(rows: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array([r.get(c) for r in rows], schema.field(c).type) for c in schema.names], schema=schema)


def groups(number: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(number, places that have it), ascending."""
    order = np.argsort(number, kind="stable")
    first = np.flatnonzero(np.diff(number[order], prepend=-1))
    for a, b in zip(first, np.append(first[1:], len(order))):
        yield int(number[order[a]]), order[a:b]


def cut(text: bytes) -> Iterator[bytes]:
    """A text and what ends it, in slices that end behind a blank; a word is never cut."""
    at = 0
    while len(text) - at > SLICE:
        end = text.find(b" ", at + SLICE) + 1
        if not end:
            break
        yield text[at:end]
        at = end
    yield text[at:] + b"\n"


def lang_key(lang: str) -> bytes:
    """What a language's words are told by; it says where the word starts."""
    lang = lang.encode()
    return b"%d:%s" % (len(lang), lang)


def split_key(key: bytes) -> tuple[str, bytes]:
    size, _, rest = key.partition(b":")
    return rest[: int(size)].decode(), rest[int(size) :]


def shards(docs: DataFrame, n_buckets: int, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The words of docs (lang, text) in shards of about shard_bytes; a task's last shard may be smaller."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, shard = TaskContext.get().partitionId(), 0, Shard()
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                shard.add(lang.as_py(), text.as_py())
                if shard.size >= shard_bytes:
                    yield from shard.rows(task << 32 | n, n_buckets).to_batches()
                    n, shard = n + 1, Shard()
        if shard.size:
            yield from shard.rows(task << 32 | n, n_buckets).to_batches()

    return docs.mapInArrow(run, SHARDS_DDL)


def joined(column: pa.ChunkedArray, kind: str) -> list[np.ndarray]:
    return [unpacked(b.as_buffer(), kind) for chunk in column.chunks for b in chunk]


def numbered(frequent: np.ndarray, bucket: int, n_buckets: int) -> np.ndarray:
    """A number for each frequent entry of a bucket, that no other bucket gives."""
    ids = np.cumsum(frequent, dtype=np.int64) - 1
    return np.where(frequent, ids * n_buckets + bucket, -1)


def add_up_words(rows: pa.Table, n_buckets: int, least: int) -> pa.Table:
    """A bucket's frequent words (shard -1), and for each shard the numbers of its words by their places."""
    keys = pa.chunked_array([k.values for k in rows["keys"].combine_chunks()], pa.binary())
    code = keys.dictionary_encode().combine_chunks()
    known, code = code.dictionary, code.indices.to_numpy()
    total = np.zeros(len(known), np.int64)
    np.add.at(total, code, np.concatenate(joined(rows["counts"], "<i8")))
    ids = numbered(total >= least, rows["bucket"][0].as_py(), n_buckets)
    out = [{"shard": -1, "ids": packed(ids[ids >= 0]), "keys": known.filter(pa.array(ids >= 0)), "counts": packed(total[ids >= 0])}]
    first = 0
    for shard, at in zip(rows["shard"].to_pylist(), joined(rows["places"], "<i4")):
        own = ids[code[first : first + len(at)]]
        out.append({"shard": shard, "ids": packed(own[own >= 0]), "at": packed(np.diff(at[own >= 0].astype("<i8"), prepend=0))})
        first += len(at)
    return table(out, ANSWERS)


def add_up(rows: pa.Table, n_buckets: int, least: int) -> pa.Table:
    """A bucket's frequent substrings (shard -1), and for each shard its own ones' keys (at) and numbers."""
    own = [np.cumsum(k) for k in joined(rows["places"], "<i8")]
    known, code = np.unique(np.concatenate(own), return_inverse=True)
    total = np.zeros(len(known), np.int64)
    np.add.at(total, code, np.concatenate(joined(rows["counts"], "<i4")))
    ids = numbered(total >= least, rows["bucket"][0].as_py(), n_buckets)
    some = ids >= 0
    out = [{"shard": -1, "ids": packed(ids[some]), "at": packed(known[some]), "counts": packed(total[some])}]
    first = 0
    for shard, keys in zip(rows["shard"].to_pylist(), own):
        ids_ = ids[code[first : first + len(keys)]]
        out.append({"shard": shard, "ids": packed(ids_[ids_ >= 0]), "at": packed(np.diff(keys[ids_ >= 0], prepend=0))})
        first += len(keys)
    return table(out, ANSWERS)


def answered(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """What a shard was answered: keys or places, ascending, and their numbers."""
    at = np.concatenate([np.empty(0, "<i8"), *map(np.cumsum, joined(rows["at"], "<i8"))])
    ids = np.concatenate([np.empty(0, "<i8"), *joined(rows["ids"], "<i8")])
    order = np.argsort(at)
    return at[order], ids[order]


def keys_of(words: np.ndarray, states: np.ndarray, depth: int) -> np.ndarray:
    """The key of the substring of depth words that ends at each place: its suffix link and the word before; -1 where it can't be frequent.

    states are those of one word less.
    """
    key = np.full(len(words), -1, np.int64)
    if len(words) >= depth:
        link, left = states[depth - 1 :], words[: len(words) - depth + 1]
        ok = (link >= 0) & (states[depth - 2 : -1] >= 0)
        key[depth - 1 :][ok] = link[ok].astype(np.int64) << WORD_BITS | left[ok]
    return key


def grow(shard: pa.Table, answers: pa.Table, depth: int, n_buckets: int, last: bool) -> pa.Table:
    """A shard's automaton with states of depth words where they may be frequent: its places (unless it is the last time), and the endpos count of each new state by bucket."""
    shard = shard.filter(pc.is_null(shard["bucket"]))
    if not shard.num_rows or not answers.num_rows:
        return SHARDS.empty_table()
    at, ids = answered(answers)
    shard = shard.sort_by("part")
    words = np.concatenate(joined(shard["words"], "<i4"))
    if depth == 2:
        if len(ids) and ids.max() >> WORD_BITS:
            raise ValueError(f"more than 2**{WORD_BITS} frequent words")
        known = np.full(max([int(words.max(initial=-1)), *at[-1:]]) + 2, -1, "<i4")  # the last is for the places between pieces
        known[at] = ids
        words = states = known[words]
    else:
        states = np.concatenate(joined(shard["states"], "<i8")) if depth > 3 else words
        key = keys_of(words, states, depth - 1)
        near = np.minimum(np.searchsorted(at, key), max(0, len(at) - 1))
        states = np.where(at[near] == key, ids[near], -1) if len(at) else np.full(len(key), -1, np.int64)
        if states.max(initial=0) >> 63 - WORD_BITS:
            raise ValueError(f"more than 2**{63 - WORD_BITS} frequent phrases")
    # Only what a longer substring can start or end with stays, and one place between.
    need = states >= 0
    for _ in range(depth - 2):
        need[:-1] |= need[1:]
    need[1:] |= need[:-1]
    words, states = words[need], states[need]
    keys = keys_of(words, states, depth)
    keys, counts = np.unique(keys[keys >= 0], return_counts=True)
    number = shard["shard"][0].as_py()
    out = [] if last else places(number, words, states.astype("<i8") if depth > 2 else None)
    bucket = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % n_buckets
    for b, own in groups(bucket):
        out.append({"shard": number, "bucket": b, "places": packed(np.diff(keys[own], prepend=0)), "counts": packed(counts[own].astype("<i4"))})
    return table(out, SHARDS)


def found_words(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        for ids, counts, keys in zip(batch.column("ids"), batch.column("counts"), batch.column("keys")):
            split = [split_key(k.as_py()) for k in keys.values]
            yield pa.record_batch([
                pa.array(unpacked(ids.as_buffer(), "<i8")), pa.array([s[0] for s in split], pa.string()), pa.array([s[1].decode() for s in split], pa.string()), pa.array(unpacked(counts.as_buffer(), "<i8")),
            ], names=["id", "lang", "phrase", "a"])


def found_states(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        for ids, at, counts in zip(batch.column("ids"), batch.column("at"), batch.column("counts")):
            at = unpacked(at.as_buffer(), "<i8")
            yield pa.record_batch([
                pa.array(unpacked(ids.as_buffer(), "<i8")), pa.array(at >> WORD_BITS), pa.array(at & (1 << WORD_BITS) - 1), pa.array(unpacked(counts.as_buffer(), "<i8")),
            ], names=["id", "link", "left", "a"])


def substrings(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, shard_bytes: int = SHARD_BYTES, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n), the number of words, and for each depth the frequent substrings.

    Those are (id, link, left, prefix, lang, phrase, a, heads, tails): link, left and prefix are the ids of the substring without its
    first word, of its first word and of the substring without its last one; heads and tails have the counts of what its
    first and last words make, heads from one word on, tails from all but one.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    size = docs.select(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n_buckets = max(16, math.ceil(size / bucket_bytes))
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.encode(text, "UTF-8").alias("text"))
    state = materialize(shards(rows, n_buckets, shard_bytes), "shards")
    totals = state.where("bucket IS NULL").select(F.explode("totals").alias("lang", "n")).groupBy("lang").agg(F.sum("n").alias("n"))
    totals = materialize(totals, "totals")

    def counted(state: DataFrame, how, name: str) -> DataFrame:
        rows = state.where("bucket IS NOT NULL").select("shard", "bucket", "keys", "counts", "places")
        return materialize(rows.groupBy("bucket").applyInArrow(lambda t: how(t, n_buckets, least), ANSWERS_DDL), name)

    def grown(depth: int):
        return lambda shard, answers: grow(shard, answers, depth, n_buckets, depth == longest)

    answers = counted(state, add_up_words, "words")
    found = answers.where("shard = -1").select("ids", "counts", "keys").mapInArrow(found_words, "id long, lang string, phrase string, a long")
    none = F.array().cast("array<long>")
    words = found.select("id", F.lit(-1).cast("long").alias("link"), F.col("id").alias("left"), F.lit(-1).cast("long").alias("prefix"), "lang", "phrase", "a", none.alias("heads"), none.alias("tails"))
    words = materialize(words, "phrases")
    levels = [words]
    for depth in range(2, longest + 1):
        own = state.where("bucket IS NULL").groupBy("shard").cogroup(answers.where("shard >= 0").select("shard", "at", "ids").groupBy("shard"))
        grew = materialize(own.applyInArrow(grown(depth), SHARDS_DDL), "automata")
        release(state)
        release(answers)
        state, answers = grew, counted(grew, add_up, "states")
        new = answers.where("shard = -1").select("ids", "at", "counts").mapInArrow(found_states, "id long, link long, left long, a long")
        levels.append(materialize(with_links(new, levels[-1], words), "phrases"))
    release(state)
    release(answers)
    return totals, levels


def with_links(new: DataFrame, shorter: DataFrame, words: DataFrame) -> DataFrame:
    """Substrings (id, link, left, a) with what their links, first words and prefixes give."""
    link = shorter.select(F.col("id").alias("link"), F.col("prefix").alias("_middle"), F.col("phrase").alias("_rest"), F.col("a").alias("_rest_a"), "tails")
    left = words.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("_word"))
    prefix = shorter.select(F.col("link").alias("_middle"), "left", F.col("id").alias("prefix"), F.col("a").alias("_prefix_a"), "heads")
    return new.join(link, "link").join(left, "left").join(prefix, ["_middle", "left"]).select(
        "id", "link", "left", "prefix", "lang", F.concat_ws(" ", "_word", "_rest").alias("phrase"), "a",
        F.concat("heads", F.array("_prefix_a")).alias("heads"), F.concat(F.array("_rest_a"), "tails").alias("tails"),
    )


def wide(n: Column) -> Column:
    return n.cast("decimal(20,0)")


def weakest_cut() -> Column:
    """(score, k, l, r) of the cut with the smallest score, and of these the first."""

    def at(l: Column, k: Column) -> Column:  # noqa: E741
        r = F.get("tails", k)
        score = F.call_function("div", wide(F.col("a")) * F.lit(SCALE).cast("decimal(7,0)"), wide(l) + wide(r))
        return F.struct(score.cast("long").alias("score"), k.alias("k"), l.alias("l"), r.alias("r"))

    return F.array_min(F.transform("heads", at))


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, shard_bytes: int = SHARD_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first phrases of each language, from all of docs (lang, text).

    A phrase has 2 to longest words of one piece and occurs at least ``least`` times. Its score is the least of floor(2000000 a / (l + r))
    over its cuts in two parts that occur l and r times; equal ones count at the first cut. A phrase goes if one word more,
    before or behind it, keeps COVERED percent of its occurrences; longer phrases that hold it occur no more often than these do.

    A null text is empty, a null lang is ``und``; other columns, doc_id too, are not read, so repeated rows count as often as they
    stand there. Texts without words and empty tables give no rows. Long texts are cut into words by slices; a shard ends
    between texts, so that a task needs some 30 bytes for each word of a longer one.
    """
    totals, levels = substrings(docs, longest, least, shard_bytes, bucket_bytes)
    rows = None
    for own, longer in zip(levels[1:], [*levels[2:], None]):
        if longer is not None:
            holds = longer.select(F.col("link").alias("id"), F.col("a").alias("_most")).unionByName(longer.select(F.col("prefix").alias("id"), F.col("a").alias("_most")))
            own = own.join(holds.groupBy("id").agg(F.max("_most").alias("_most")), "id", "left")
            own = own.where(F.col("_most").isNull() | (wide(F.col("_most")) * 100 < wide(F.col("a")) * COVERED))
        own = own.select("lang", "phrase", "a", weakest_cut().alias("_cut"))
        rows = own if rows is None else rows.unionByName(own)
    rows = rows.select("lang", "phrase", "a", "_cut.l", "_cut.r", "_cut.score")
    # The best of each share of a language's phrases, then of these.
    rows = rows.withColumn("_salt", F.pmod(F.hash("phrase"), F.lit(SALTS)))
    for group in (["lang", "_salt"], ["lang"]):
        order = Window.partitionBy(*group).orderBy(F.desc("score"), F.desc("a"), "phrase")
        rows = rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return rows.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


UPPER_AZ, LOWER_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same as collocations with its default parameters.
ORACLE = rf"""
WITH pieces AS (
  SELECT row_number() OVER () AS piece, lang, p FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER_AZ}', '{LOWER_AZ}'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
words AS (
  SELECT piece, lang, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT piece, lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces)),
totals AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
runs AS (
  SELECT lang, w AS w1, lead(w, 1) OVER q AS w2, lead(w, 2) OVER q AS w3, lead(w, 3) OVER q AS w4 FROM words WINDOW q AS (PARTITION BY piece ORDER BY i)),
f AS (
  SELECT lang, ws, count(*) AS a FROM (
    SELECT lang, [w1] AS ws FROM runs UNION ALL SELECT lang, [w1, w2] FROM runs WHERE w2 IS NOT NULL
    UNION ALL SELECT lang, [w1, w2, w3] FROM runs WHERE w3 IS NOT NULL UNION ALL SELECT lang, [w1, w2, w3, w4] FROM runs WHERE w4 IS NOT NULL)
  GROUP BY lang, ws HAVING count(*) >= {LEAST}),
c AS (SELECT * FROM f WHERE len(ws) > 1),
parts AS (SELECT lang, ws, a, unnest(range(1, len(ws))) AS k FROM c),
scored AS (
  SELECT p.lang, p.ws, p.a, k, x.a AS l, y.a AS r, ({SCALE}::HUGEINT * p.a) // (x.a::HUGEINT + y.a) AS score
  FROM parts p JOIN f x ON x.lang = p.lang AND x.ws = p.ws[1:k] JOIN f y ON y.lang = p.lang AND y.ws = p.ws[k+1:]),
weakest AS (SELECT lang, ws, a, arg_min({{'l': l, 'r': r, 'score': score}}, score * 8 + k) AS s FROM scored GROUP BY lang, ws, a),
held AS (
  SELECT lang, s AS ws, max(a) AS most FROM (
    SELECT lang, a, unnest([ws[1:len(ws)-1], ws[2:], CASE WHEN len(ws) = 4 THEN ws[1:2] END, CASE WHEN len(ws) = 4 THEN ws[2:3] END, CASE WHEN len(ws) = 4 THEN ws[3:4] END]) AS s FROM c)
  WHERE len(s) > 1 GROUP BY ALL),
kept AS (
  SELECT lang, array_to_string(ws, ' ') AS phrase, a, s.l AS l, s.r AS r, s.score::BIGINT AS score
  FROM weakest LEFT JOIN held USING (lang, ws) WHERE most IS NULL OR 100::HUGEINT * most < {COVERED} * a::HUGEINT)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept) JOIN totals USING (lang)
WHERE rank <= {TOP}
"""
