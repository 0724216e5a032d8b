"""Periodic runs of words (operator 12), by a Kruskal pass over suffix classes with descending common prefixes.

A run is a stretch of words with a smallest period q, of at least `least` words and at least 2 * q, that no
neighbouring word extends.  A run that starts at i with period q has a common prefix of length - q >= q words at
the suffixes i and i + q, and no other suffix with as long a common prefix lies between them (else two periods
would meet over their sum, and q wouldn't be the smallest).  So:

* suffixes of a chunk's texts are sorted by doubling, over exact word numbers, with a text's number in front,
  so that classes never span texts; common prefixes of neighbours come from the ranks of each doubling;
* neighbours in that order are united from the longest common prefix down (union-find), each class holding its
  places in order; a place that moves into a larger class meets the two places beside it there;
* such a pair at a distance d within the common prefix, whose preceding words differ, is a run: start, d + prefix, d.

Pairs need a common prefix of least / 2 words, so texts whose grams of that size repeat nowhere within reach are
not sorted, and places whose nearest one of an equal gram is farther than their longest common prefix aren't
united; neither can be part of a pair that counts, nor lie between the places of one.  A text's work is
n log^2 n at most, and it stays in its row's task: nothing is shuffled.

Defined results: a null or empty text has no words and no runs.  Words are compared exactly.  Each input row
gives one row, so repeated rows give repeated rows; a row without an id has the checksum of an empty string.
Only doc_id and text are read, so further columns cannot clash.  An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm import bytetext
from tidemark.llm.scratch import map_batches

#: A run's words at least; words of a part of an ordered set.
LEAST = 12
PART = 1024
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Places:
    """An ordered set of places, in parts of bounded size."""

    def __init__(self, place: int):
        self.parts, self.first, self.size = [[place]], [place], 1

    def add(self, place: int) -> tuple[int, int]:
        """The places before and after the new one; -1 where there is none."""
        k = max(0, bisect_left(self.first, place) - 1)
        part = self.parts[k]
        insort(part, place)
        at = bisect_left(part, place)
        self.first[k] = part[0]
        self.size += 1
        before = part[at - 1] if at else self.parts[k - 1][-1] if k else -1
        after = part[at + 1] if at + 1 < len(part) else self.first[k + 1] if k + 1 < len(self.parts) else -1
        if len(part) > PART:
            half = len(part) // 2
            self.parts[k : k + 1] = [part[:half], part[half:]]
            self.first[k : k + 1] = [part[0], part[half]]
        return before, after

    def __iter__(self) -> Iterator[int]:
        return (place for part in self.parts for place in part)


def _repeated(word: np.ndarray, left: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """The distance from each place to the nearest one in its text with an equal n-gram; a very large one if there is none."""
    far = np.full(len(word), 1 << 60)
    at = np.flatnonzero(left >= n)
    if not len(at):
        return far
    gram = text[at].astype(np.uint64) * _MULTIPLIER  # equal grams give equal keys; that others may do so too only adds candidates
    for k in range(n):
        gram = bytetext.mix(gram + word[at + k].astype(np.uint64) + np.uint64(1))
    order = np.argsort(gram, kind="stable")
    same, gap = gram[order[1:]] == gram[order[:-1]], np.diff(at[order])
    for side in (order[1:][same], order[:-1][same]):
        far[at[side]] = np.minimum(far[at[side]], gap[same])
    return far


def _levels(word: np.ndarray, left: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The places in suffix order (a text's together), and for k = 0, 1, ... ranks that are equal where the first 2**k words are."""
    n = len(word)
    _, rank = np.unique(text.astype(np.int64) * (int(word.max()) + 1) + word, return_inverse=True)
    count = np.bincount(rank)
    # a class's rank is the number of places before it, so that a class can be split in place
    levels, size = [(np.cumsum(count) - count)[rank].astype(np.int32)], 1
    while True:
        rank = levels[-1]
        count = np.bincount(rank, minlength=n)
        open_ = np.flatnonzero(count[rank] > 1)
        if not len(open_):
            break
        follows = np.zeros(len(open_), np.int64)
        inside = left[open_] > size
        follows[inside] = rank[open_[inside] + size] + 1
        order = np.lexsort((follows, rank[open_]))
        place, old, new = open_[order], rank[open_][order], follows[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (old[1:] != old[:-1]) | (new[1:] != new[:-1])
        begin = np.ones(len(order), bool)
        begin[1:] = old[1:] != old[:-1]
        each = np.arange(len(order))
        head = np.maximum.accumulate(np.where(begin, each, 0))
        level = rank.copy()
        level[place] = old + np.maximum.accumulate(np.where(fresh, each, 0)) - head
        levels.append(level)
        size *= 2
    return np.argsort(levels[-1], kind="stable"), levels


def _common(a: np.ndarray, b: np.ndarray, left: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """The words that the suffixes at places a and b have in common."""
    out = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        size = 1 << k
        at = np.flatnonzero(np.minimum(left[a], left[b]) - out >= size)
        x, y = a[at] + out[at], b[at] + out[at]
        out[at[levels[k][x] == levels[k][y]]] += size
    return out


def find_runs(word: np.ndarray, first: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start (in `word`), length and period of all runs of texts word[first[d]:first[d + 1]], in order of start, then period."""
    none = (np.zeros(0, np.int64),) * 3
    least_prefix = -(-least // 2)
    sizes = np.diff(first)
    text, left = np.repeat(np.arange(len(sizes)), sizes), np.repeat(first[1:], sizes) - np.arange(len(word))
    near = _repeated(word, left, text, least_prefix)
    # a pair's prefix ends in the text, so a distance within it is at most half of what is left
    hopeful = np.unique(text[np.flatnonzero(2 * near <= left)])
    if not len(hopeful):
        return none
    chosen = np.flatnonzero(np.isin(text, hopeful))
    word, text, left, near = word[chosen], text[chosen], left[chosen], near[chosen]
    _, word = np.unique(word, return_inverse=True)
    order, levels = _levels(word, left, text)
    common = np.zeros(len(order) + 1, np.int64)
    common[1:-1] = _common(order[:-1], order[1:], left, levels)
    longest = np.zeros(len(order), np.int64)
    longest[order] = np.maximum(common[:-1], common[1:])
    stays = (near[order] <= longest[order]) & (longest[order] >= least_prefix)
    if not stays.any():
        return none
    # a place that goes hands the smaller of its two prefixes on to its neighbours
    kept = np.flatnonzero(stays)
    prefix = np.zeros(len(kept), np.int64)
    if len(kept) > 1:
        prefix[1:] = np.minimum.reduceat(common[: kept[-1] + 1], kept[:-1] + 1)
    return _kruskal(order[kept], prefix, word, text, chosen, least, least_prefix)


def _kruskal(order: np.ndarray, prefix: np.ndarray, word: np.ndarray, text: np.ndarray, chosen: np.ndarray, least: int, least_prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    places = order.tolist()
    classes: list[Places | None] = [Places(p) for p in places]
    root = list(range(len(places)))
    links = np.flatnonzero(prefix[1:] >= least_prefix) + 1
    links = links[np.argsort(-prefix[links], kind="stable")]
    seeds: list[tuple[int, int, int]] = []
    for k, size in zip(links.tolist(), prefix[links].tolist()):
        a, b = k - 1, k
        while root[a] != a:
            root[a] = a = root[root[a]]
        while root[b] != b:
            root[b] = b = root[root[b]]
        if classes[a].size < classes[b].size:
            a, b = b, a
        large, small = classes[a], list(classes[b])
        last = -1
        for place, following in zip(small, [*small[1:], len(word)]):
            before, after = large.add(place)
            # a place of the smaller class itself isn't a new neighbour
            if before > last and place - before <= size:
                seeds.append((before, place, size))
            if 0 <= after < following and after - place <= size:
                seeds.append((place, after, size))
            last = place
        root[b], classes[b] = a, None
    if not seeds:
        return (np.zeros(0, np.int64),) * 3
    i, j, size = np.array(seeds, np.int64).T
    starts = (i == 0) | (text[i - 1] != text[i]) | (word[i - 1] != word[j - 1])
    i, j, size = i[starts], j[starts], size[starts]
    found = np.unique(np.stack([chosen[i], j - i, j - i + size])[:, j - i + size >= least], axis=1)
    return found[0], found[2], found[1]


def looped(words: list[bytes], doc_id: str) -> list[bytes]:
    """The words of the contract's query: in a tenth of the documents, chosen by id, the tail repeats a stretch of words."""
    h, n = zlib.crc32(doc_id.encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def _numbers(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Exact word numbers of all texts in a row, and len(texts) + 1 offsets."""
    index: dict[bytes, int] = {}
    for words in texts:
        for w in set(words).difference(index):
            index[w] = len(index)
    first = np.concatenate([[0], np.cumsum([len(w) for w in texts])]).astype(np.int64)
    return np.concatenate([np.zeros(0, np.int64), *(np.fromiter(map(index.__getitem__, w), np.int64, len(w)) for w in texts)]), first


def runs(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, start, length, period) of every run, in words from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in bytetext.chunks(batch.column(1)):
                raw = data.tobytes()
                word, first = _numbers([raw[i:j].split() for i, j in zip(offsets[:-1], offsets[1:])])
                start, length, period = find_runs(word, first, least)
                row = np.searchsorted(first, start, "right") - 1
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(row)), *(pa.array(x, pa.int64()) for x in (start - first[row], length, period))], names)

    names = [id_col, "start", "length", "period"]
    source = docs.select(id_col, text_col)
    return map_batches(source, run, T.StructType([source.schema[id_col], *(T.StructField(n, T.LongType()) for n in names[1:])]))


def report(docs: DataFrame, change: Callable[[list[bytes], str], list[bytes]] | None = None) -> DataFrame:
    """Per row: n_runs, the longest run, digests of all runs and of the text without what runs repeat; `change` may replace a text's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in bytetext.chunks(batch.column(1)):
                raw, ids = data.tobytes(), batch.column(0).slice(a, b - a)
                texts = [raw[i:j].split() for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                if change:
                    texts = [change(words, "" if i is None else str(i)) for words, i in zip(texts, ids.to_pylist())]
                word, first = _numbers(texts)
                found = find_runs(word, first)
                bounds = np.searchsorted(found[0], first).tolist()
                rows = [_digest(words, k, *(x[i:j] for x in found)) for words, k, i, j in zip(texts, first.tolist(), bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, f.type) for c, f in zip(zip(*rows), fields))], names)

    fields = [pa.field(n, pa.int64()) for n in ("n_runs", "start", "length", "period", "exponent_milli")] + [pa.field(n, pa.string()) for n in ("runs_sha256", "collapsed_sha256")]
    names = ["doc_id", *(f.name for f in fields)]
    source = docs.select("doc_id", "text")
    types = [T.LongType()] * 5 + [T.StringType()] * 2
    return map_batches(source, run, T.StructType([source.schema["doc_id"], *(T.StructField(n, t) for n, t in zip(names[1:], types))]))


def _digest(words: list[bytes], base: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> tuple:
    start = start - base
    if not len(start):
        return 0, None, None, None, None, hashlib.sha256(b"").hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()
    best = np.lexsort((period, start, -length))[0]
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in zip(start.tolist(), length.tolist(), period.tolist()))
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
    s, n, q = int(start[best]), int(length[best]), int(period[best])
    text = b" ".join([words[k] for k in kept.tolist()])
    return len(start), s, n, q, 1000 * n // q, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text).hexdigest()
