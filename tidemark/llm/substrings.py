"""Removal of word passages that an earlier document has, by super-k-mer partitioning (operator 3).

A window is `window` consecutive words; its minimiser is the least hash among its runs of `MINIMISER`
words.  Consecutive windows of a text that share a minimiser form a super-k-mer; equal windows have
equal minimisers, so they can only lie in super-k-mers of one minimiser.

1. A map cuts each text into super-k-mers, as small rows of hashes and places.  Equal super-k-mers
   (say, of copies) are first combined in their batch: all but those of the least id are covered by
   an earlier document whatever else there is.  The rest meet by hash, where all but the least id's
   are found covered likewise; keys have at most a row (or a text's repeats) for each batch.
2. Of the super-k-mers that remain, those whose minimiser occurs in several documents travel, as one
   packed string each, to their minimiser's bucket.  Sorting the windows of a bucket by content and
   id finds those that a smaller id has too.  Minimisers with more than `BUCKET_WORDS` words are split
   over salted buckets, which pass on each window with its least id, to be compared by an aggregate.
3. Covered ranges return to their documents, which drop those words.

Windows are equal if two independent 64-bit hashes of their words are.  Windows are judged on the
input, not on what is left.  Defined results: null and wordless texts have no words; texts with
fewer words than a window lose none.  A row without an id loses nothing and takes nothing from
others.  Rows with one id are one document (equal texts): no row removes words of another of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bytetext
from tidemark.llm.scratch import map_batches, stored

MINIMISER = 8
BUCKET_WORDS = 1 << 20
_SEEDS = (np.uint64(0x632BE59BD9B4E019), np.uint64(0xD1B54A32D192ED03))


def _run_hashes(word: np.ndarray, start: np.ndarray, size: np.ndarray, seed: np.uint64) -> np.ndarray:
    """A hash of each run of word hashes, independent of its place."""
    power, inverse = bytetext._power_tables(len(word) + 1)
    total = np.zeros(len(word) + 1, np.uint64)
    np.cumsum(bytetext.mix(word + seed) * power[: len(word)], out=total[1:])
    return bytetext.mix((total[start + size] - total[start]) * inverse[start] + size.astype(np.uint64) * seed)


def _sliding_least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each n consecutive values."""
    have, out = 1, x
    while have * 2 <= n:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(x) - n + 1], out[n - have : n - have + len(x) - n + 1]) if have < n else out


def super_kmers(words: bytetext.Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, start (in its words), words, minimiser and content hash of each super-k-mer."""
    m = min(MINIMISER, window)
    if len(words) < window:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    word = words.hashes()
    least = _sliding_least(bytetext.gram_hashes(word, m), window - m + 1)
    whole = np.flatnonzero(words.left()[: len(least)] >= window)
    if not len(whole):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    key, text = least[whole], words.text_of()[whole]
    new = np.ones(len(whole), bool)
    new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    start = whole[at]
    size = np.diff(np.append(at, len(whole))) + window - 1
    return text[at], start - words.first[text[at]], size, key[at], _run_hashes(word, start, size, _SEEDS[0])


_KMER = "minimiser long, content long, id long, start int, words int, lost boolean"
_KMER_NAMES = ["minimiser", "content", "id", "start", "words", "lost"]


def _cut(docs: DataFrame, window: int) -> DataFrame:
    """The super-k-mers of (id, text); those that a smaller id of their batch has are lost, under a key of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts = batch.column(0).to_numpy(), []
            for a, _, data, offsets in bytetext.chunks(batch.column(1)):
                text, start, size, key, content = super_kmers(bytetext.Words(data, offsets, bytetext.SPACED), window)
                parts.append((ids[a + text], start, size, key, content))
            if not parts:
                continue
            id_, start, size, key, content = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((id_, content, key))
            id_, start, size, key, content = (x[order] for x in (id_, start, size, key, content))
            new = np.ones(len(id_), bool)
            new[1:] = (key[1:] != key[:-1]) | (content[1:] != content[:-1])
            lost = id_ > id_[np.maximum.accumulate(np.where(new, np.arange(len(id_)), 0))]
            content = np.where(lost, bytetext.mix(id_.view(np.uint64) + start.astype(np.uint64)), content)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(content.view(np.int64)), pa.array(id_), pa.array(start, pa.int32()), pa.array(size, pa.int32()), pa.array(lost)], _KMER_NAMES
            )

    return map_batches(docs, run, _KMER)


def _meet(kmers: DataFrame) -> DataFrame:
    """Marks as lost what a smaller id has too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, content, id_, lost = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2, 5))
            new = np.ones(len(id_), bool)
            new[1:] = (key[1:] != key[:-1]) | (content[1:] != content[:-1])
            least = id_[np.maximum.accumulate(np.where(new, np.arange(len(id_)), 0))].copy()
            if before and before[:2] == (key[0], content[0]):
                end = int(np.argmax(new[1:])) + 1 if new[1:].any() else len(new)
                least[:end] = before[2]
            before = (key[-1], content[-1], least[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(lost | (id_ > least))], _KMER_NAMES)

    # lost rows have keys of their own, so that they stay as they are
    return map_batches(kmers.repartition("minimiser", "content").sortWithinPartitions("minimiser", "content", "id"), run, _KMER)


def _packed(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """(minimiser, salted, id, start, packed): the needed super-k-mers with their text, as found in their documents."""
    lists = needed.groupBy("id").agg(F.collect_list(F.struct("start", "words", "minimiser", "salted")).alias("need"))  # at most a text's super-k-mers
    source = docs.join(lists, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in bytetext.chunks(batch.column(1)):
                words = bytetext.Words(data, offsets, bytetext.SPACED)
                need = batch.column(2).slice(a, b - a)
                flat, count = need.flatten(), np.asarray(need.value_lengths())
                start, size, key, salted = (x.to_numpy(zero_copy_only=False) for x in flat.flatten())
                at = np.repeat(words.first[:-1], count) + start
                text = bytetext.spans_to_binary(data, words.starts[at], words.ends[at + size - 1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key, pa.int64()), pa.array(salted, pa.int32()), pa.array(np.repeat(batch.column(0).slice(a, b - a).to_numpy(), count)), pa.array(start, pa.int32()), text.cast(pa.binary())],
                    ["minimiser", "salt", "id", "start", "packed"],
                )

    return map_batches(source.select("id", "text", "need"), run, "minimiser long, salt int, id long, start int, packed binary")


def _windows(ids: np.ndarray, starts: np.ndarray, packed: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two content hashes, id and start of each window of packed super-k-mers."""
    data, offsets = bytetext.string_buffers(packed)
    words = bytetext.Words(data, offsets, bytetext.SPACED)
    word = words.hashes()
    at = np.flatnonzero(words.left() >= window)
    of = np.searchsorted(words.first, at, "right") - 1
    size = np.full(len(at), window)
    return _run_hashes(word, at, size, _SEEDS[0]), _run_hashes(word, at, size, _SEEDS[1]), ids[of], starts[of] + at - words.first[of]


def _sort_buckets(packed: DataFrame, window: int) -> DataFrame:
    """Windows that a smaller id of their bucket has (lost), and, of salted buckets, all others (not lost), as runs or rows."""

    def judged(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        salts, ids, starts, texts = zip(*rows)
        h1, h2, id_, start = _windows(np.array(ids), np.array(starts, np.int64), pa.array(texts, pa.binary()), window)
        order = np.lexsort((id_, h2, h1))
        h1, h2, id_, start = (x[order] for x in (h1, h2, id_, start))
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        lost = id_ > id_[np.maximum.accumulate(np.where(new, np.arange(len(id_)), 0))] if len(id_) else np.zeros(0, bool)
        pass_on = np.full(len(h1), salts[0] >= 0) & ~lost  # all rows of one call are salted or none
        # neighbouring lost windows of a text as one range
        i, s = id_[lost], start[lost]
        by = np.lexsort((s, i))
        i, s = i[by], s[by]
        first = np.ones(len(i), bool)
        first[1:] = (i[1:] != i[:-1]) | (s[1:] > s[:-1] + 1)
        cut = np.flatnonzero(first)
        end = s[np.append(cut[1:], len(s)) - 1] if len(s) else s
        n, m = len(cut), int(pass_on.sum())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([i[cut], id_[pass_on]])),
                pa.array(np.concatenate([s[cut], start[pass_on]]), pa.int32()),
                pa.array(np.concatenate([end - s[cut] + window if n else s[cut], np.full(m, window)]), pa.int32()),
                pa.array(np.concatenate([np.zeros(n, np.uint64), h1[pass_on]]).view(np.int64)),
                pa.array(np.concatenate([np.zeros(n, np.uint64), h2[pass_on]]).view(np.int64)),
                pa.array(np.arange(n + m) < n),
            ],
            ["id", "start", "words", "h1", "h2", "lost"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, key = [], 0, None
        for batch in batches:
            for k, salt, id_, start, text in zip(*(c.to_pylist() for c in batch.columns)):
                # whole minimisers; of salted buckets, which are merged later, any number of rows
                if rows and held >= 1 << 22 and ((k, salt) != key or salt >= 0) or rows and (salt >= 0) != (key[1] >= 0):
                    yield from judged(rows)
                    rows, held = [], 0
                rows.append((salt, id_, start, text))
                held += len(text)
                key = (k, salt)
        if rows:
            yield from judged(rows)

    ordered = packed.repartition("minimiser", "salt").sortWithinPartitions(F.col("salt") >= 0, "minimiser", "salt")
    return map_batches(ordered, run, "id long, start int, words int, h1 long, h2 long, lost boolean")


def covered_ranges(docs: DataFrame, window: int, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """(id, start, words): ranges of (id, text) whose windows a smaller id has too; ranges may overlap."""
    found = stored(_meet(_cut(docs, window)), "super-kmers")
    first = found.where("not lost").select("minimiser", "content", "id", "start", "words")
    shared = first.groupBy("minimiser").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.sum("words").alias("total")).where("low < high")
    salts = F.ceil(F.col("total") / bucket_words).cast("int")
    salt = F.when(F.col("total") > bucket_words, F.pmod(F.col("content"), salts).cast("int")).otherwise(-1)
    needed = first.join(shared, "minimiser").select("id", "start", "words", "minimiser", salt.alias("salted"))
    judged = stored(_sort_buckets(_packed(docs, needed), window), "windows")
    split = judged.where("not lost")
    least = split.groupBy("h1", "h2").agg(F.min("id").alias("least"))
    late = split.join(least, ["h1", "h2"]).where("id > least")
    columns = ("id", "start", "words")
    return found.where("lost").select(*columns).unionByName(judged.where("lost").select(*columns)).unionByName(late.select(*columns))


def remove_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """(id, n_words, n_removed, kept) of every row: kept holds the remaining words, joined by one space."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ranges = covered_ranges(source.where("id is not null"), window, bucket_words)
    lists = ranges.groupBy("id").agg(F.collect_set(F.struct("start", "words")).alias("cover"))  # at most a text's windows
    joined = source.join(lists, "id", "left").select("id", "text", "cover")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in bytetext.chunks(batch.column(1)):
                words = bytetext.Words(data, offsets, bytetext.SPACED)
                cover = batch.column(2).slice(a, b - a).fill_null([])
                flat, count = cover.flatten(), np.asarray(cover.value_lengths())
                start, size = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in flat.flatten())
                at = np.repeat(words.first[:-1], count) + start
                step = np.zeros(len(words) + 1, np.int64)
                np.add.at(step, at, 1)
                np.add.at(step, at + size, -1)
                gone = np.cumsum(step[:-1]) > 0
                removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[words.first])
                # each kept word with one space behind it, the last of a text without
                keep = np.flatnonzero(~gone)
                kept_first = np.searchsorted(keep, words.first)
                width = words.ends[keep] - words.starts[keep] + 1
                filled = np.flatnonzero(np.diff(kept_first))
                width[kept_first[filled + 1] - 1] -= 1
                bounds = np.concatenate([[0], np.cumsum(width)])
                place = np.arange(bounds[-1]) + np.repeat(words.starts[keep] - bounds[:-1], width)
                text = data[np.minimum(place, max(len(data) - 1, 0))] if len(data) else data
                spaces = bounds[1:] - 1
                last = np.zeros(len(keep), bool)
                last[kept_first[filled + 1] - 1] = True
                text[spaces[~last]] = 0x20
                out = pa.LargeStringArray.from_buffers(b - a, pa.py_buffer(np.ascontiguousarray(bounds[kept_first])), pa.py_buffer(text))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(words.counts, pa.int64()), pa.array(removed, pa.int64()), out.cast(pa.string())], ["id", "n_words", "n_removed", "kept"])

    out = map_batches(joined, run, "id long, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("id", id_col)


def report(docs: DataFrame, window: int = 50) -> DataFrame:
    """Per row of documents: n_words, n_removed and the hash of the kept words."""
    return remove_repeats(docs, window).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
