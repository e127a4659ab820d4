"""Packing by minimum bin slack: token pieces fill sequences of a fixed length with next to no padding.

Each document's ids (byte-level BPE, then id 0) are cut into full windows and one
remainder. Remainders wait in a window of rows; for each sequence a subset-sum
dynamic programme over bitsets picks the multiset of waiting lengths whose sum
comes closest to the capacity, counts are backtracked, and the pattern is used as
often as the counts allow. At the end of a task's rows, where no pattern fills a
sequence any more, pieces are cut where a sequence ends, and the last ids form
sequences of powers of two, which need no padding.

With added, the tokenizer file's added tokens are found in a text first, as the
tokenizers library does by default; without it they are split as plain text.

Cases: a null or empty text is the single id 0; an empty table gives an empty
table; documents longer than a sequence are cut, and each id lies in exactly one
piece; repeated rows are packed as often as they come; further columns are not
read. Every task packs its own rows, so no key can make one task large, and a
task that is run again gives the same pieces.
"""

from __future__ import annotations

import json
import zlib
from collections import deque
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from codeloom.llm._spark import few_rows
from codeloom.llm._text import mix

CAPACITY = 1024
END_ID = 0
#: Remainders that wait for a place at once.
WINDOW = 8192
CHUNK_CHARS = 1 << 18
MOST_CACHED = 1 << 19
#: Code points classified at once.
CLASS_BLOCK = 1 << 14

U = np.uint64
#: Fixed value: how byte-level BPE splits a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CONTRACTION = regex.compile(r"'(?:[stmd]|re|ve|ll)")
_ROOT, _SPACE, _LETTER, _NUMBER, _OTHER = 0x9E3779B97F4A7C15 | 1, 0, 1, 2, 3


@cache
def _classes() -> np.ndarray:
    """White space, letter, number or other, by code point."""
    out = np.full(0x110000, _OTHER, np.uint8)
    for at in range(0, 0x110000, CLASS_BLOCK):
        every = "".join(chr(c) for c in range(at, at + CLASS_BLOCK) if not 0xD800 <= c < 0xE000)
        for kind, pattern in ((_SPACE, r"\s"), (_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}")):
            out[[ord(c) for c in regex.findall(pattern, every)]] = kind
    return out


@cache
def _byte_of() -> dict[str, int]:
    """Byte-level BPE writes each byte as one printable character; this undoes it."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


_held_powers: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """At least n powers of a root and of its inverse; only the longest lists are held."""
    if not _held_powers or len(_held_powers[0]) < n:
        _held_powers.clear()
        for base in (_ROOT, pow(_ROOT, -1, 1 << 64)):
            full = np.full(n, base, U)
            full[0] = 1
            _held_powers.append(np.multiply.accumulate(full, out=full))
    return _held_powers


class Encoder:
    """Ids of texts by a tokenizers file with byte-level BPE; the ids of words seen before come from a table."""

    def __init__(self, path: str, added: bool = False):
        with open(path, encoding="utf-8") as f:
            read = json.load(f)
        vocab = read["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in read.get("added_tokens") or []} if added else {}
        if added and any(t[flag] for t in read.get("added_tokens") or [] for flag in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that take blanks along or stand for whole words only are not supported")
        # The longest of those that begin at a place comes first.
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        of = _byte_of()
        ranks = {bytes(of[c] for c in token): i for token, i in vocab.items() if all(c in of for c in token) and token != "<|endoftext|>"}
        self.core = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.keys = np.zeros(0, U)
        self.place = np.zeros(0, np.int64)
        self.starts, self.ids, self.used = np.zeros(1, np.int64), np.zeros(1 << 16, np.uint32), 0

    def plain(self, text: str) -> np.ndarray:
        return np.array(self.core.encode_ordinary(text), np.uint32)

    def _with_added(self, text: str) -> np.ndarray:
        """Ids of a text that holds added tokens; what stands between them is encoded by itself."""
        pieces = [np.array([self.added[p]], np.uint32) if i % 2 else self.plain(p) for i, p in enumerate(self.split.split(text))]
        return np.concatenate(pieces)

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        if len(self.keys) + len(keys) > MOST_CACHED:
            self.keys, self.place, self.starts, self.used = self.keys[:0], self.place[:0], np.zeros(1, np.int64), 0
        one = self.core._encode_single_piece
        got = [one(w.encode()) for w in words]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        total = int(sizes.sum())
        if self.used + total > len(self.ids):
            grown = np.zeros(max(2 * len(self.ids), self.used + total), np.uint32)
            grown[: self.used] = self.ids[: self.used]
            self.ids = grown
        self.ids[self.used : self.used + total] = np.fromiter((i for g in got for i in g), np.uint32, total)
        base = len(self.starts) - 1
        self.starts = np.append(self.starts, self.used + np.cumsum(sizes))
        self.used += total
        both, where = np.append(self.keys, keys), np.append(self.place, base + np.arange(len(keys)))
        order = np.argsort(both)
        self.keys, self.place = both[order], where[order]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, at most a few million characters together unless one text is longer."""
        held = [self.split is not None and bool(self.split.search(t)) for t in texts]
        odd = [h or (bool(_CONTRACTION.search(t)) if "'" in t else False) for t, h in zip(texts, held)]
        joined = "".join(t for t, o in zip(texts, odd) if not o)
        sizes = np.array([0 if o else len(t) for t, o in zip(texts, odd)], np.int64)
        ids, counts = self._joined(joined, np.append(0, np.cumsum(sizes)))
        ends = np.cumsum(counts)
        return [self._with_added(t) if h else self.plain(t) if o else ids[e - c : e] for t, h, o, e, c in zip(texts, held, odd, ends, counts)]

    def _joined(self, text: str, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows, n = len(offsets) - 1, len(text)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(rows, np.int64)
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kind = _classes()[code]
        edge = np.zeros(n + 1, np.bool_)
        edge[offsets] = True
        first = edge.copy()
        first[1:n] |= kind[1:] != kind[:-1]
        space = kind == _SPACE
        # The last blank before a visible character of the same text stands with it if it is a plain blank, and alone if not.
        last = np.flatnonzero(space[:-1] & ~space[1:] & ~edge[1:n])
        plain = code[last] == 32
        first[last] = True
        first[last[plain] + 1] = False
        start = np.flatnonzero(first[:n])
        end = np.append(start[1:], n)
        up, down = _powers(1 << int(n + 1).bit_length())
        prefix = np.zeros(n + 1, U)
        np.cumsum((code.astype(U) + U(1)) * up[:n], out=prefix[1:])
        key = mix((prefix[end] - prefix[start]) * down[start] + U(0x51ED2701))
        found, back = np.unique(key, return_inverse=True)
        at = np.searchsorted(self.keys, found)
        at[at == len(self.keys)] = 0
        known = self.keys[at] == found if len(self.keys) else np.zeros(len(found), np.bool_)
        if not known.all():
            where = np.zeros(len(found), np.int64)
            where[back] = np.arange(len(key))
            if len(self.keys) + int((~known).sum()) > MOST_CACHED:
                known[:] = False
                self.keys = np.zeros(MOST_CACHED, U)
            new = np.flatnonzero(~known)
            self._learn(found[new], [text[start[w] : end[w]] for w in where[new]])
            at = np.searchsorted(self.keys, found)
        slot = self.place[at][back]
        begin, size = self.starts[slot], self.starts[slot + 1] - self.starts[slot]
        total = np.cumsum(size)
        ids = self.ids[np.repeat(begin - (total - size), size) + np.arange(total[-1])]
        until = np.append(0, total)[np.searchsorted(start, offsets)]
        return ids, np.diff(until)


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, added: bool = False) -> Encoder:
    if (path, added) not in _encoders:
        _encoders[path, added] = Encoder(path, added)
    return _encoders[path, added]


def best_pattern(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> dict[int, int]:
    """How many of each length to take so that their sum comes closest to, without exceeding, the capacity.

    Bit s of a step's set says that s can be reached with the lengths so far; a
    length that may be used c times is added in groups of 1, 2, 4 ... copies.
    Longer lengths come first. Backtracking takes later lengths' groups only where
    the sum cannot be reached without them.
    """
    reach, mask = 1, (1 << (capacity + 1)) - 1
    steps: list[tuple[int, int, int]] = []
    for length, count in zip(lengths[::-1].tolist(), counts[::-1].tolist()):
        count, group = min(count, capacity // length), 1
        while count > 0:
            take = min(group, count)
            steps.append((length, take, reach))
            reach = (reach | reach << length * take) & mask
            count -= take
            group *= 2
        if reach >> capacity & 1:
            break
    at, picked = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            picked[length] = picked.get(length, 0) + take
            at -= length * take
    return picked


def fill(waiting: dict[int, deque], capacity: int, all_of_it: bool) -> Iterator[list]:
    """Sequences, as lists of waiting pieces; with all_of_it False, stops at the first that has slack."""
    while waiting:
        lengths = np.array(sorted(waiting), np.int64)
        counts = np.array([len(waiting[k]) for k in lengths.tolist()], np.int64)
        picked = best_pattern(lengths, counts, capacity)
        if sum(k * v for k, v in picked.items()) < capacity and not all_of_it:
            return
        for _ in range(min(len(waiting[k]) // v for k, v in picked.items())):
            yield [waiting[k].popleft() for k in sorted(picked, reverse=True) for _ in range(picked[k])]
        for k in picked:
            if not waiting[k]:
                del waiting[k]


FIELDS = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


class Packer:
    """Packs one task's documents; take() and finish() give rows of FIELDS as lists."""

    def __init__(self, part: int, capacity: int):
        self.capacity, self.sequence = capacity, part << 40
        self.waiting: dict[int, deque] = {}
        self.held = 0

    def take(self, doc, ids: np.ndarray) -> Iterator[tuple]:
        ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
        n, full = len(ids), len(ids) // self.capacity * self.capacity
        for at in range(0, full, self.capacity):
            yield (doc, at, self.capacity, zlib.crc32(ids[at : at + self.capacity].tobytes()), n, self.sequence, 0)
            self.sequence += 1
        if full < n:
            self.waiting.setdefault(n - full, deque()).append((doc, full, ids[full:].tobytes(), n))
            self.held += 1
        if self.held >= WINDOW:
            yield from self._place(False)
            if self.held > WINDOW // 2:
                yield from self._place(True)

    def _place(self, all_of_it: bool) -> Iterator[tuple]:
        """Rows of the patterns that fill a sequence; with all_of_it the rest too, cut where a sequence ends."""
        left = sum(k * len(v) for k, v in self.waiting.items())
        room, offset = self._room(left), 0
        for pieces in fill(self.waiting, self.capacity, all_of_it):
            self.held -= len(pieces)
            for doc, start, raw, n in pieces:
                while raw:
                    part, raw = raw[: 4 * (room - offset)], raw[4 * (room - offset) :]
                    size = len(part) // 4
                    yield (doc, start, size, zlib.crc32(part), n, self.sequence, offset)
                    start, offset = start + size, offset + size
                    if offset == room:
                        left -= room
                        self.sequence, offset, room = self.sequence + 1, 0, self._room(left)

    def _room(self, left: int) -> int:
        """The next sequence's length: the capacity, or at the end the largest power of two."""
        return self.capacity if left >= self.capacity else 1 << max(0, left.bit_length() - 1)

    def finish(self) -> Iterator[tuple]:
        yield from self._place(True)


def pack(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, added: bool = False) -> DataFrame:
    """One row a piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    capacity must be a power of two. tokenizer: a tokenizers file, by default
    public_tokenizers' byte_bpe_50k.json where the task runs. added: whether the file's
    added tokens in a text are single ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer or public_tokenizers.path("byte_bpe_50k.json"), added)
        packer = Packer(TaskContext.get().partitionId(), capacity)
        kind = None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [[] for _ in FIELDS]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:])], FIELDS)

        for batch in few_rows(batches):
            kind = batch.column(0).type
            ids, texts, chars, rows = batch.column(0).to_pylist(), [], 0, []
            at = 0
            for text in batch.column(1):
                texts.append(text.as_py() or "")
                chars += len(texts[-1])
                if chars >= CHUNK_CHARS:
                    for doc, own in zip(ids[at:], coder.encode(texts)):
                        rows.extend(packer.take(doc, own))
                    at, texts, chars = at + len(texts), [], 0
            for doc, own in zip(ids[at:], coder.encode(texts)):
                rows.extend(packer.take(doc, own))
            yield out(rows)
        if kind is not None:
            rows = list(packer.finish())
            yield out(rows)

    kind = docs.schema[id_col].dataType.simpleString()
    packed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, ", ".join([f"id {kind}", *(f"{c} long" for c in FIELDS[1:])]))
    return packed.withColumnRenamed("id", id_col)
