"""Words and word hashes of Arrow string columns, computed with whole-array numpy operations.

Texts are handled as UTF-8 bytes.  Both word classes used by the operators treat every byte from
0x80 upwards as part of a word, so byte positions and code points split texts alike.  Texts are
taken in chunks of bounded size; a chunk always holds whole texts, so a text longer than the bound
forms a chunk of its own.  A null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18

_IDENTITY = np.arange(256, dtype=np.uint8)
LOWER = _IDENTITY.copy()
LOWER[65:91] += 32
#: Words [^\x20\x09-\x0D]+
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (of lower-cased bytes)
NAMES = np.zeros(256, dtype=bool)
NAMES[0x30:0x3A] = NAMES[0x61:0x7B] = NAMES[0x80:] = True

_RANDOM = np.random.default_rng(7)
_BYTE_VALUE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers


class Words:
    """Words of consecutive texts: byte bounds `starts`/`ends`, and `first[d]:first[d + 1]` as text d's words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, member: np.ndarray, lower: bool = False):
        self.data = LOWER[data] if lower else data
        self.offsets = offsets
        inside = member[self.data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        before = np.zeros(len(data), dtype=bool)
        before[1:] = inside[:-1]
        before[edge[:-1]] = False
        after = np.zeros(len(data), dtype=bool)
        after[:-1] = inside[1:]
        after[edge[1:]] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """The text number of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def left(self) -> np.ndarray:
        """How many words each word's text has from that word on."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes, independent of its place."""
        return span_hashes(self.data, self.starts, self.ends)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, independent of its place."""
    power, inverse = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[data] * power[: len(data)], out=total[1:])
    found = (total[ends] - total[starts]) * inverse[starts]
    return mix(found + (ends - starts).astype(np.uint64) * _BASE)


_COEFFICIENT = _RANDOM.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(word: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n word hashes starting at each place (len(word) - n + 1 of them; they may cross texts)."""
    size = len(word) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(size, np.uint64(n), np.uint64)
    for k in range(n):
        total += word[k : k + size] * _COEFFICIENT[k % 64] ** np.uint64(2 * (k // 64) + 1)
    return mix(total)


def shingle_sets(words: Words, n: int) -> list[np.ndarray]:
    """Each text's sorted distinct n-word shingle hashes; a shorter text with words gives one for its whole sequence."""
    word = words.hashes()
    gram = gram_hashes(word, n)
    first, out = words.first, []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= n:
            out.append(np.unique(gram[a : b - n + 1]))
        elif b > a:
            out.append(gram_hashes(word[a:b], int(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and len(column) + 1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type) and not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive runs of rows with at most `most` bytes, or one row."""
    data, offsets = string_buffers(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1
        end = min(rows, max(end, row + 1))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def spans_to_binary(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte spans of data as one Arrow binary column."""
    sizes = ends - starts
    bounds = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=bounds[1:])
    index = np.arange(bounds[-1]) + np.repeat(starts - bounds[:-1], sizes)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(bounds), pa.py_buffer(data[index])])
