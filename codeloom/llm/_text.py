"""Words and shingles of many texts at once, as numpy arrays over an Arrow batch's bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Text bytes worked on at once, unless a single text is longer.
CHUNK_BYTES = 1 << 20
#: Bits of a shingle's hash within a chunk; the bits above hold the row.
SHINGLE_BITS = 48
MOST_ROWS = (1 << (64 - SHINGLE_BITS)) - 1

_rng = np.random.default_rng(20240501)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
_ROOT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_ROOT, -1, 1 << 64)
_powers = {"up": np.ones(1, U), "down": np.ones(1, U)}


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of unsigned 64-bit numbers (a bijection)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        base = _ROOT if kind == "up" else _INV
        full = np.full(max(n, CHUNK_BYTES + 4096), base, U)
        full[0] = 1
        have = _powers[kind] = np.multiply.accumulate(full)
    return have[:n]


def spread(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    bytes_ = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return bytes_, offsets - (offsets[0] if len(offsets) else 0)


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a column with about ``most`` bytes each, and fewer rows than the bits above a shingle can number."""
    _, offsets = spread(column)
    at, n = 0, len(column)
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        end = min(n, max(at + 1, end), at + MOST_ROWS)
        yield at, end
        at = end


class Words:
    """start, end: byte ranges of the words; hash: of each word; first: index of each row's first word (one more at the end)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
        n = len(data)
        inside = np.zeros(n + 2, np.bool_)
        inside[1:-1] = is_word[data]
        row_edge = np.zeros(n + 1, np.bool_)
        row_edge[offsets] = True
        now, before = inside[1:], inside[:-1]
        self.start = np.flatnonzero(now & (~before | row_edge))
        self.end = np.flatnonzero(before & (~now | row_edge))
        prefix = np.zeros(n + 1, U)
        np.cumsum(_BYTE[data] * _power("up", n), out=prefix[1:])
        self.hash = mix((prefix[self.end] - prefix[self.start]) * _power("down", n + 1)[self.start])
        self.first = np.searchsorted(self.start, offsets)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))


def _visible() -> np.ndarray:
    is_word = np.ones(256, np.bool_)
    is_word[:33] = False
    return is_word


def _letters() -> np.ndarray:
    is_word = np.zeros(256, np.bool_)
    for a, b in ((48, 58), (65, 91), (97, 123), (128, 256)):
        is_word[a:b] = True
    return is_word


#: Bytes of words between white space, and bytes of words of letters, digits and non-ASCII characters.
VISIBLE, LETTERS = _visible(), _letters()


def grams(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each word on, and whether they all lie in its row."""
    h, n = words.hash, len(words.hash)
    out = np.zeros(n, U)
    for i in range(min(k, n)):
        out[: n - i] += h[i:] * U(pow(_ROOT, k - i, 1 << 64))
    return mix(out), np.arange(n) + k <= words.first[1:][words.row] if n else np.zeros(0, np.bool_)


def shingle_counts(words: Words, rows: int, k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, count): each row's distinct shingles of k words, ascending; a shorter row is one shingle of all its words."""
    gram, whole = grams(words, k)
    key, row = gram[whole] >> U(64 - SHINGLE_BITS), words.row[whole]
    size = np.diff(words.first)
    short = np.flatnonzero((size > 0) & (size < k))
    if len(short):
        at = np.zeros(len(words.hash) + 1, U)
        place = np.arange(len(words.hash)) - words.first[:-1][words.row]
        np.cumsum(words.hash * _power("up", k + 1)[np.minimum(place, k)], out=at[1:])
        own = mix(at[words.first[short + 1]] - at[words.first[short]] + U(k))
        key, row = np.append(key, own >> U(64 - SHINGLE_BITS)), np.append(row, short)
    full = np.sort((row.astype(U) << U(SHINGLE_BITS)) | key)
    if not len(full):
        return np.zeros(0, np.int64), full, np.zeros(0, np.int64)
    new = np.flatnonzero(np.append(True, full[1:] != full[:-1]))
    got = full[new]
    return (got >> U(SHINGLE_BITS)).astype(np.int64), got & U((1 << SHINGLE_BITS) - 1), np.diff(np.append(new, len(full)))
