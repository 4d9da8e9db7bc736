"""SentencePiece encoding and decoding for merge-type vocabularies.

Encoding starts from single characters and merges the adjacent pair whose joined piece scores highest, leftmost first.
The new words of a batch do so side by side in arrays, one merge of each at a time; long ones have an agenda that is ordered
by score. A vocabulary whose pieces never have the blank mark after another character
lets texts fall apart before each run of marks, so equal words are encoded once in a task. New words of each Arrow
batch are held against the sentencepiece library, and a difference is an error.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tokenizer_path

MARK = "▁"
#: Remembered words of a task; forgetting them changes no result.
MEMO = 600_000
SLICE = 1 << 20
#: Characters of the words that are merged side by side, up to each number; longer words are merged by themselves.
WIDTHS = (4, 6, 8, 10, 12, 16, 24, 40, 64)
#: Symbols that are merged side by side.
CELLS = 1 << 18
#: Symbols are characters, by their code, and pieces of several characters, numbered from CHARACTERS on.
CHARACTERS, NOTHING, BITS = 0x110000, (1 << 21) - 1, 21
NEVER = np.iinfo(np.int32).max


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("only merge-type vocabularies without normalisation are supported")
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        kinds = type(proto.pieces[0])
        self.pieces = [p.piece for p in proto.pieces]
        self.score = {p.piece: p.score for p in proto.pieces if p.type in (kinds.NORMAL, kinds.USER_DEFINED, kinds.UNUSED)}
        self.cost = {p: -x for p, x in self.score.items()}
        self.id = {p.piece: i for i, p in enumerate(proto.pieces) if p.piece in self.score}
        self.byte = {i: int(p.piece[3:5], 16) for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        self.byte_id = {b: i for i, b in self.byte.items()}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == kinds.UNKNOWN)
        self.silent = {i for i, p in enumerate(proto.pieces) if p.type == kinds.CONTROL}
        self.special = self.silent | set(self.byte) | {self.unknown}
        self.end = self.library.eos_id()
        self.splits = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.score)
        self.spelled: dict[int, list[int]] = {}
        self.is_special = np.zeros(len(self.pieces), bool)
        self.is_special[list(self.special)] = True
        self.tabulate()

    def tabulate(self) -> None:
        """Tables of symbols: the id of each, and for two that make a piece that piece and its place by cost."""
        number = {p: CHARACTERS + i for i, p in enumerate(p for p in self.score if len(p) > 1)}
        symbol = {p: ord(p) for p in self.score if len(p) == 1} | number
        self.symbol_id = np.full(CHARACTERS + len(number), -1, np.int32)
        self.symbol_id[list(symbol.values())] = [self.id[p] for p in symbol]
        place = {c: i for i, c in enumerate(sorted(set(self.cost.values())))}

        def part(p: str) -> int | None:
            return ord(p) if len(p) == 1 else number.get(p)

        pairs = [(a << BITS | b, n, place[self.cost[p]]) for p, n in number.items() for i in range(1, len(p)) if (a := part(p[:i])) is not None and (b := part(p[i:])) is not None]
        keys, made, by_cost = np.array(pairs, np.int64).reshape(-1, 3).T
        self.pairs = pd.Index(keys)
        self.made, self.by_cost = np.append(made, NOTHING).astype(np.int32), np.append(by_cost, NEVER).astype(np.int32)  # the last: no pair

    def merge_all(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many marked words, one word's after another's, and how many each has."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(size, kind="stable")
        ids, counts, a = [np.empty(0, np.int32)], [np.empty(0, np.int64)], 0
        for width in WIDTHS:
            b = int(np.searchsorted(size, width, "right", sorter=order))
            while a < b:
                some = order[a : min(b, a + CELLS // width)]
                own, n = self.merge_side_by_side([words[i] for i in some.tolist()], size[some], width)
                ids.append(own)
                counts.append(n)
                a += len(some)
        for i in order[a:].tolist():
            own = self.merge(words[i])
            ids.append(np.array(own, np.int32))
            counts.append(np.array([len(own)], np.int64))
        by_size = np.concatenate(counts)
        start, n = np.empty_like(by_size), np.empty_like(by_size)
        start[order], n[order] = np.cumsum(by_size) - by_size, by_size
        return np.concatenate(ids)[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())], n

    def merge_side_by_side(self, words: list[str], size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """As merge_all, for words of 1 to width characters: a row of symbols for each, and a last column that holds nothing."""
        row = width + 1
        symbols = np.full((len(words), row), NOTHING, np.int64)
        symbols[np.arange(row) < size[:, None]] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        pair = np.full((len(words), row), -1, np.int32)
        inside = np.arange(row) < size[:, None] - 1
        pair[inside] = self.pairs.get_indexer((symbols[:, :-1] << BITS | symbols[:, 1:])[inside[:, :-1]])
        cost = self.by_cost[pair]
        # The next and the last symbol of each; before the first comes the last column of the row above.
        after, before = np.tile(np.arange(1, row + 1), (len(words), 1)), np.tile(np.arange(-1, row - 1), (len(words), 1))
        live = np.arange(len(words))
        flat_symbols, flat_pair, flat_cost, flat_after, flat_before = (x.ravel() for x in (symbols, pair, cost, after, before))
        while len(live):
            best = cost[live].argmin(axis=1)  # the first of equal ones
            at = live * row + best
            some = flat_cost[at] < NEVER
            live, at = live[some], at[some]
            start = live * row
            gone = start + flat_after[at]
            new = self.made[flat_pair[at]].astype(np.int64)
            flat_symbols[at], flat_symbols[gone], flat_cost[gone] = new, -1, NEVER
            flat_after[at] = flat_after[gone]
            right, left = start + flat_after[at], start + flat_before[at]
            flat_before[right] = at - start
            found = self.pairs.get_indexer(np.concatenate([new << BITS | flat_symbols[right], flat_symbols[left] << BITS | new]))
            for place, own in ((at, found[: len(at)]), (left, found[len(at) :])):
                flat_pair[place], flat_cost[place] = own, self.by_cost[own]
        kept = (symbols != NOTHING) & (symbols >= 0)
        symbol, n = symbols[kept], kept.sum(axis=1)
        ids = self.symbol_id[symbol]
        if (strange := ids < 0).any():
            spelled = [self.spell(c) for c in symbol[strange].tolist()]
            length = np.ones(len(ids), np.int64)
            length[strange] = [len(x) for x in spelled]
            n = np.add.reduceat(length, np.cumsum(n) - n)
            ids, strange = np.repeat(ids, length), np.repeat(strange, length)
            ids[strange] = [i for x in spelled for i in x]
        return ids, n

    def spell(self, character: int) -> list[int]:
        """The ids of a character that is no piece."""
        if character not in self.spelled:
            self.spelled[character] = [self.byte_id[b] for b in chr(character).encode()] if self.byte_id else [self.unknown]
        return self.spelled[character]

    def merge(self, text: str) -> list[int]:
        """The ids of a marked text."""
        cost, push, pop = self.cost.get, heapq.heappush, heapq.heappop
        symbols: list[str] = list(text)
        n = len(symbols)
        before, after = [*range(-1, n - 1), -1], [*range(1, n), -1]
        agenda = [(c, i, pair) for i, pair in enumerate(map(add, symbols, symbols[1:])) if (c := cost(pair)) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, i, joined = pop(agenda)
            j = after[i]
            if j < 0 or not symbols[i] or symbols[i] + symbols[j] != joined:
                continue  # one of the two was merged meanwhile
            symbols[i], symbols[j] = joined, ""
            k, h = after[j], before[i]
            after[i], before[k] = k, i
            if k >= 0 and (c := cost(new := joined + symbols[k])) is not None:
                push(agenda, (c, i, new))
            if h >= 0 and (c := cost(new := symbols[h] + joined)) is not None:
                push(agenda, (c, h, new))
        out, id_of = [], self.id.get
        for s in symbols:
            if s:
                found = id_of(s)
                out += [found] if found is not None else self.spell(ord(s))
        return out

    def decode(self, ids: list[int]) -> str:
        """The marked text of ids, with marks as blanks."""
        out, raw = [], bytearray()
        for i in ids:
            if i in self.byte:
                raw.append(self.byte[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if i not in self.silent:
                out.append(self.pieces[i].replace(MARK, " "))
        return "".join(out) + raw.decode("utf-8", "replace")


@lru_cache(1)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, once in a worker."""
    return Vocabulary(path)


class Encoder:
    """ids (little-endian int32 bytes) and decoded texts, by remembered words."""

    def __init__(self, path: str, check: bool = True):
        self.vocabulary = vocabulary(path)
        self.check = check
        self.memo: dict[str, bytes] = {}
        self.changed: dict[str, str] = {}  # words that decode to another text than their own

    def chunks(self, text: str) -> list[str]:
        marked = MARK + text.replace(" ", MARK)
        if not text:
            return []
        if not self.vocabulary.splits:
            return [marked]
        if MARK + MARK in marked:
            return re.findall(f"{MARK}+[^{MARK}]*", marked)
        return marked.replace(MARK, "\0" + MARK).split("\0")[1:] if "\0" not in text else re.findall(f"{MARK}[^{MARK}]*", marked)

    def learn(self, new: list[str]) -> None:
        marks = [c for c in new if c.endswith(MARK)]
        words = len(new) - len(marks)
        new = [c for c in new if not c.endswith(MARK)] + marks  # marks alone come last: nothing may follow them
        ids, n = self.vocabulary.merge_all(new)
        ends = np.concatenate([[0], np.cumsum(n)])
        if self.check:
            known = self.vocabulary.merge(MARK + "a")  # a first word, as the library would take the first mark away
            for at, to in [*((a, min(a + 10_000, words)) for a in range(0, words, 10_000)), *((a, a + 1) for a in range(words, len(new)))]:
                if self.vocabulary.library.encode("a" + "".join(new[at:to])) != known + ids[ends[at] : ends[to]].tolist():
                    raise ValueError("the ids differ from the sentencepiece library's")
        data, bounds = ids.astype("<i4").tobytes(), (4 * ends).tolist()
        self.memo.update(zip(new, map(data.__getitem__, map(slice, bounds, bounds[1:]))))
        # Pieces alone spell their own word; only bytes, unknowns and controls can spell another.
        special = np.flatnonzero(self.vocabulary.is_special[ids])
        for w in np.unique(np.searchsorted(ends, special, "right") - 1).tolist():
            if (text := self.vocabulary.decode(ids[ends[w] : ends[w + 1]].tolist())) != new[w].replace(MARK, " "):
                self.changed[new[w]] = text

    def __call__(self, texts: list[str]) -> tuple[list[bytes], list[str]]:
        split = [self.chunks(t) for t in texts]
        new = set().union(*split)
        if len(self.memo) + len(new) > MEMO:
            self.memo.clear()
            self.changed.clear()
        self.learn(list(new.difference(self.memo)))
        end = np.array([self.vocabulary.end], "<i4").tobytes()
        ids = [b"".join(map(self.memo.__getitem__, c)) + end for c in split]
        if self.changed:
            return ids, ["".join(self.changed.get(x, x.replace(MARK, " ")) for x in c)[1:] for c in split]
        return ids, [t.replace(MARK, " ") for t in texts]


def encode_decode(docs: DataFrame, model: str | None = None, check: bool = True) -> DataFrame:
    """(doc_id, ids, decoded): each row's whole text as ids that end in the end id, and what decoding them gives.

    Null text is empty: the end id only, decoded to nothing. check holds new words against the sentencepiece
    library. Repeated or null doc_ids are rows of their own; other columns are not carried.
    """
    path = model or tokenizer_path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path, check)

        def made(part: list[tuple]) -> pa.RecordBatch:
            ids, texts = encode([t for _, t in part])
            offsets = np.concatenate([[0], np.cumsum([len(i) // 4 for i in ids])]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32())
            columns = [pa.array([d for d, _ in part], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), values), pa.array(texts, pa.string())]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"])

        for batch in batches:
            part, size = [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                part.append((doc, text.as_py() or ""))
                size += len(part[-1][1])
                if size >= SLICE:
                    yield made(part)
                    part, size = [], 0
            if part:
                yield made(part)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded string")
