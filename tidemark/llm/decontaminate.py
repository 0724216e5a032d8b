"""Benchmark decontamination with suffix arrays over the training texts (operator 1).

The training texts are cut into shards (runs of whole documents of about `SHARD_BYTES`, within one
Spark task).  For each shard a word-level suffix array is built and every suffix of every test item
is binary-searched in it, word by word: the interval of matching suffixes narrows until it is empty,
which gives its places at each depth.  A window is the first `window` words of a
test suffix; an item of fewer words is one window.  Wherever a window occurs, its words are hit.
The other way round, each place of the array is searched in the sorted test suffixes, which gives the
longest verbatim match at that place, so that each document has its own longest one (its first if
several are as long), whichever documents share its shard.  Test suffixes are sorted by doubling: the
rank of 2^(k+1) words comes from two ranks of 2^k words.  The ranks are kept by level, so that the
common prefix of two suffixes takes a look at each level, and no cost grows with an item's length but
by its logarithm.

The suffix array is sparse: it holds the training suffixes whose first g words (g = 3, less if some
item is shorter) start some test suffix too.  All others can't reach a match of g words, so no
window is lost.  A longest match is reported if it has 3 words or is a whole item.

The test items are broadcast in blocks of at most `BLOCK_BYTES` of text (and at least one item), and a map
over the documents takes `GROUP_BLOCKS` of them at once.  A benchmark of one such group needs no shuffle: each
row's state comes out of the map.  A larger one takes a map over the texts for each group, which gives
only the digest and state of those texts that match; these are put together by digest, and the documents
are joined with them once.  So no text is written, and what is written grows with the matches.

Defined results: a null or empty text, or one without words, has no words and no hits.  Null and
wordless items are ignored; items with one id count as one; an item without an id marks words but
is not listed.  Without items nothing is hit.  Each input row gives one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import bytetext
from tidemark.llm.scratch import map_batches, stored

SHARD_BYTES = 1 << 19
BLOCK_BYTES = 2 << 20
GROUP_BLOCKS = 4
_GATE_BITS = 22

_STATE = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("longest_words", T.IntegerType()),
        T.StructField("longest_start", T.IntegerType()),
    ]
)
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


class TestSuffixes:
    """All suffixes of the items of one block, as padded rows of word hashes."""

    def __init__(self, ids: list[str | None], texts: list[str | None], window: int):
        data, offsets = bytetext.string_buffers(pa.array(texts, pa.string()))
        words = bytetext.Words(data, offsets, bytetext.NAMES, lower=True)
        self.word, self.length = words.hashes(), words.left()
        self.item = words.text_of()
        self.ids = ids
        self.depth = int(self.length.max(initial=0))
        whole = words.counts[self.item]
        # a suffix starts a window if it has `window` words, or is the whole of a shorter item
        self.window = np.where(self.length >= window, window, np.where(self.length == whole, self.length, 0))
        self.gram = int(min([3, *self.window[self.window > 0]])) if len(self.word) else 1
        grams = bytetext.gram_hashes(self.word, self.gram)
        self.grams = np.unique(grams[self.length[: len(grams)] >= self.gram])
        self.gate = np.zeros(1 << _GATE_BITS, bool)
        self.gate[self.grams >> np.uint64(64 - _GATE_BITS)] = True
        self._double()

    def _double(self) -> None:
        """`order`, the suffixes sorted; `ranks[k]`, the rank of each suffix's first 2^k words; `keys[k]`, what those ranks stand for."""
        self.keys, rank = np.unique(self.word, return_inverse=True)
        self.keys, self.ranks = [self.keys], [(rank.reshape(-1) + 1).astype(np.int32)]
        step = 1
        while step < self.depth:
            pair = np.zeros(len(self.word), np.int64)  # 0 where the item ends
            on = np.flatnonzero(self.length > step)
            pair[on] = self.ranks[-1][on + step]
            key, rank = np.unique(self.ranks[-1].astype(np.int64) << 32 | pair, return_inverse=True)
            self.keys.append(key)
            self.ranks.append((rank.reshape(-1) + 1).astype(np.int32))
            step *= 2
        self.order = np.argsort(self.ranks[-1], kind="stable")

    def classes(self, word: np.ndarray, left: np.ndarray, near: np.ndarray) -> list[np.ndarray]:
        """By level k, the rank among the test suffixes of the 2^k words from each place on; 0 if they stand in no item. `near` are the places to look at."""
        out: list[np.ndarray] = []

        def look(keys: np.ndarray, places: np.ndarray, values: np.ndarray) -> np.ndarray:
            at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
            found = np.zeros(len(word), np.int32)
            hit = keys[at] == values
            found[places[hit]] = at[hit] + 1
            out.append(found)
            return places[hit]

        places = look(self.keys[0], near, word[near])
        for k in range(1, len(self.keys)):
            half = 1 << (k - 1)
            places = places[left[places] >= 2 * half]
            places = places[out[-1][places + half] > 0]
            if not len(places):
                break
            places = look(self.keys[k], places, out[-1][places].astype(np.int64) << 32 | out[-1][places + half])
        return out


def suffix_array(word: np.ndarray, left: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """`places` sorted by the word sequences that start there, compared up to `depth` words or the text's end."""
    order = places[np.argsort(word[places], kind="stable")]
    key = word[order]
    tied = np.arange(len(order))
    group = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])]) if len(key) else np.zeros(0, np.int64)
    for d in range(1, depth):
        same = group[1:] == group[:-1]
        keep = np.zeros(len(group), bool)
        keep[1:] |= same
        keep[:-1] |= same
        tied, group = tied[keep], group[keep]
        if not len(tied):
            break
        place = order[tied]
        on = left[place] > d
        key = np.zeros(len(place), np.uint64)
        key[on] = word[place[on] + d]
        by = np.lexsort((key, group))
        order[tied] = place[by]
        key, group = key[by], group[by]
        ended = ~on[by]
        change = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
        group = np.concatenate([[0], np.cumsum(change)])
        tied, group = tied[~ended], group[~ended]
    return order


def _narrow(word: np.ndarray, left: np.ndarray, order: np.ndarray, low: np.ndarray, high: np.ndarray, target: np.ndarray, d: int) -> list[np.ndarray]:
    """The parts of the intervals [low, high) of `order` whose suffixes have `target` as word d."""
    ends = []
    for right in (False, True):
        a, b = low.copy(), high.copy()
        open_ = np.arange(len(low))
        while len(open_):
            mid = (a[open_] + b[open_]) >> 1
            place = order[mid]
            on = left[place] > d
            value = np.where(on, word[np.where(on, place + d, 0)], np.uint64(0))
            less = (value <= target[open_]) if right else (value < target[open_])
            a[open_[less]] = mid[less] + 1
            b[open_[~less]] = mid[~less]
            open_ = open_[a[open_] < b[open_]]
        ends.append(a)
    return ends


def search(tests: TestSuffixes, word: np.ndarray, left: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each test suffix: the interval of `order` at its window's depth."""
    n = len(tests.word)
    low, high = np.zeros(n, np.int64), np.full(n, len(order), np.int64)
    from_, to = np.zeros(n, np.int64), np.zeros(n, np.int64)
    live = np.flatnonzero(tests.window > 0) if len(order) else np.zeros(0, np.int64)
    d = 0
    while len(live):
        low[live], high[live] = _narrow(word, left, order, low[live], high[live], tests.word[live + d], d)
        live = live[low[live] < high[live]]
        d += 1
        complete = live[tests.window[live] == d]
        from_[complete], to[complete] = low[complete], high[complete]
        live = live[tests.window[live] > d]
    return from_, to


def longest_matches(tests: TestSuffixes, word: np.ndarray, left: np.ndarray, places: np.ndarray) -> np.ndarray:
    """For each of `places`: how many words from there on stand in some test item, too."""
    if not len(places) or not len(tests.order):
        return np.zeros(len(places), np.int64)
    near = np.zeros(len(word), bool)
    for k in range(tests.gram):
        near[places + k] = True
    classes = tests.classes(word, left, np.flatnonzero(near))

    def common(place: np.ndarray, test: np.ndarray) -> np.ndarray:
        """Common prefixes of training and test suffixes, a power of two at a time."""
        size = np.zeros(len(place), np.int64)
        for k in range(len(classes) - 1, -1, -1):
            own, other = place + size, test + size
            whole = np.flatnonzero((left[place] - size >= 1 << k) & (tests.length[test] - size >= 1 << k))
            same = classes[k][own[whole]]
            size[whole[(same > 0) & (same == tests.ranks[k][other[whole]])]] += 1 << k
        return size

    low, high = np.zeros(len(places), np.int64), np.full(len(places), len(tests.order), np.int64)
    longest = np.zeros(len(places), np.int64)
    open_ = np.arange(len(places))
    while len(open_):  # to the first test suffix that isn't less; the longest match is one that was compared on the way
        mid = (low[open_] + high[open_]) >> 1
        place, test = places[open_], tests.order[mid]
        size = common(place, test)
        longest[open_] = np.maximum(longest[open_], size)
        ended, over = left[place] == size, tests.length[test] == size
        inside = ~ended & ~over
        less = over & ~ended
        less[inside] = tests.word[(test + size)[inside]] < word[(place + size)[inside]]
        low[open_[less]] = mid[less] + 1
        high[open_[~less]] = mid[~less]
        open_ = open_[low[open_] < high[open_]]
    return longest


def _scan_shard(tests: TestSuffixes, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, dict[int, tuple]]:
    """Word counts of the shard's texts, and for texts with matches (hit spans, item ids, longest match, its start)."""
    words = bytetext.Words(data, offsets, bytetext.NAMES, lower=True)
    if not len(words) or not len(tests.word):
        return words.counts, {}
    word, left = words.hashes(), words.left()
    grams = bytetext.gram_hashes(word, tests.gram)
    places = np.flatnonzero(tests.gate[grams >> np.uint64(64 - _GATE_BITS)])
    places = places[left[places] >= tests.gram]
    where = np.minimum(np.searchsorted(tests.grams, grams[places]), len(tests.grams) - 1)
    places = places[tests.grams[where] == grams[places]]
    order = suffix_array(word, left, places, int(tests.window.max()))  # intervals are taken at a window's depth
    if not len(order):
        return words.counts, {}
    low, high = search(tests, word, left, order)

    text_of = words.text_of()
    out: dict[int, list] = {}
    longest = np.zeros(len(words), np.int64)
    longest[order] = longest_matches(tests, word, left, order)
    longest[longest < 3] = 0
    hit = np.flatnonzero(high > low)
    if len(hit):
        interval, class_of = np.unique(np.stack([low[hit], tests.window[hit]], 1), axis=0, return_inverse=True)
        class_of = class_of.reshape(-1)
        size = np.zeros(len(interval), np.int64)
        size[class_of] = (high - low)[hit]
        total = np.concatenate([[0], np.cumsum(size)])
        place = order[np.arange(total[-1]) + np.repeat(interval[:, 0] - total[:-1], size)]
        of = np.repeat(np.arange(len(interval)), size)
        np.maximum.at(longest, place, interval[of, 1])  # whole items of fewer than 3 words
        step = np.zeros(len(words) + 1, np.int64)
        np.add.at(step, place, 1)
        np.add.at(step, place + interval[of, 1], -1)
        covered = np.zeros(len(words) + 2, np.int8)
        covered[1:-1] = np.cumsum(step[:-1]) > 0
        turn = np.diff(covered)
        cut = words.first[:-1][(words.counts > 0)]
        starts = np.union1d(np.flatnonzero(turn == 1), cut[covered[cut + 1] > 0])
        ends = np.union1d(np.flatnonzero(turn == -1), cut[covered[cut] > 0])
        for s, e in zip(starts.tolist(), ends.tolist()):
            d = int(text_of[s])
            base = int(words.first[d])
            out.setdefault(d, [[], [], 0, None])[0].append({"start": s - base, "end": e - base})
        pairs = np.unique(text_of[place] * np.int64(len(interval)) + of)
        items_of: list[set] = [set() for _ in range(len(interval))]
        for c, k in zip(class_of.tolist(), hit.tolist()):
            if (name := tests.ids[tests.item[k]]) is not None:
                items_of[c].add(name)
        for pair in pairs.tolist():
            d, c = divmod(pair, len(interval))
            out[d][1].append(c)
        for d, row in out.items():
            row[1] = sorted(set().union(*(items_of[c] for c in row[1])))
    found = np.flatnonzero(longest)
    found = found[np.lexsort((found, -longest[found], text_of[found]))]
    for k in found[np.unique(text_of[found], return_index=True)[1]].tolist():  # the first of a text's longest matches
        d = int(text_of[k])
        out.setdefault(d, [[], [], 0, None])[2:] = [int(longest[k]), int(k - words.first[d])]
    return words.counts, out


def _merged(parts: list[list[dict]]) -> list[dict]:
    spans: list[dict] = []
    for s in sorted((s for part in parts for s in part), key=lambda x: (x["start"], x["end"])):
        if spans and s["start"] <= spans[-1]["end"]:
            spans[-1] = {"start": spans[-1]["start"], "end": max(spans[-1]["end"], s["end"])}
        else:
            spans.append(s)
    return spans


def _scan(groups: list[TestSuffixes], data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, dict[int, tuple]]:
    """_scan_shard over several blocks of items, put together."""
    counts, found = _scan_shard(groups[0], data, offsets)
    parts = {d: [row] for d, row in found.items()}
    for tests in groups[1:]:
        for d, row in _scan_shard(tests, data, offsets)[1].items():
            parts.setdefault(d, []).append(row)
    out = {}
    for d, rows in parts.items():
        best = max(rows, key=lambda r: (r[2], -(r[3] or 0)))
        out[d] = rows[0] if len(rows) == 1 else (_merged([r[0] for r in rows]), sorted({i for r in rows for i in r[1]}), best[2], best[3])
    return counts, out


def _states(counts: np.ndarray | None, found: list[tuple | None]) -> list[pa.Array]:
    """The columns of _STATE (without n_words, if there are no counts) for texts of which `found` holds (spans, items, longest match, its start)."""
    none = ((), (), 0, None)
    spans, items, longest, start = zip(*(r or none for r in found)) if found else ((), (), (), ())
    columns = [pa.array(list(map(list, spans)), _ARROW_SPANS), pa.array(list(map(list, items)), pa.list_(pa.string())), pa.array(longest, pa.int32()), pa.array(start, pa.int32())]
    return columns if counts is None else [pa.array(counts, pa.int64()), *columns]


def _annotated(docs: DataFrame, keep: tuple[str, ...], held: list[Broadcast], window: int) -> DataFrame:
    """One map over the documents, with the state of every row; for benchmarks of one group."""
    n_keep = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = None
        for batch in batches:
            groups = groups or [TestSuffixes(*tests.value, window) for tests in held]
            for a, b, data, offsets in bytetext.chunks(batch.column(n_keep), SHARD_BYTES):
                counts, found = _scan(groups, data, offsets)
                state = pa.StructArray.from_arrays(_states(counts, [found.get(d) for d in range(b - a)]), _STATE.names)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(n_keep)), state], [*keep, "hits"])

    schema = T.StructType([*docs.schema.fields[:n_keep], T.StructField("hits", _STATE)])
    return map_batches(docs, run, schema)


_FOUND = T.StructType([T.StructField("digest", T.BinaryType()), *_STATE.fields[1:]])


def _matches(docs: DataFrame, held: list[Broadcast], window: int) -> DataFrame:
    """One map over the texts: digest and state of those that match an item of the group, once a task and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = None
        for batch in batches:
            groups = groups or [TestSuffixes(*tests.value, window) for tests in held]
            for a, _, data, offsets in bytetext.chunks(batch.column(0), SHARD_BYTES):
                found = _scan(groups, data, offsets)[1]
                texts = {hashlib.sha256(data[offsets[d] : offsets[d + 1]].tobytes()).digest(): row for d, row in found.items()}
                yield pa.RecordBatch.from_arrays([pa.array(list(texts), pa.binary()), *_states(None, list(texts.values()))], _FOUND.names)

    return map_batches(docs.select("__text"), run, _FOUND)


def _put_together(docs: DataFrame, keep: tuple[str, ...], parts: list[DataFrame]) -> DataFrame:
    """The documents with what all groups found in their texts; equal texts have equal states, so a digest has one row a group."""
    c = F.col
    every = parts[0].withColumn("__group", F.lit(0))
    for k, part in enumerate(parts[1:], 1):
        every = every.unionByName(part.withColumn("__group", F.lit(k)))
    whole = every.dropDuplicates(["digest", "__group"]).groupBy("digest").agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.max(F.struct("longest_words", (-c("longest_start")).alias("back"))).alias("best"),
    )
    joined = F.aggregate("spans", F.array().cast(_STATE["spans"].dataType), _joined_span)
    whole = whole.select("digest", joined.alias("spans"), "items", c("best.longest_words").alias("longest_words"), (-c("best.back")).alias("longest_start"))
    words = F.regexp_count(F.coalesce("__text", F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long")
    marked = docs.withColumn("digest", F.unhex(F.sha2(F.coalesce("__text", F.lit("")).cast("binary"), 256))).join(whole, "digest", "left")
    nothing = F.array().cast(_STATE["items"].dataType)
    state = [words.alias("n_words"), F.coalesce("spans", F.array().cast(_STATE["spans"].dataType)).alias("spans"), F.coalesce("items", nothing).alias("items"), F.coalesce("longest_words", F.lit(0)).alias("longest_words"), "longest_start"]
    return marked.select(*keep, F.struct(*state).alias("hits"))


def _joined_span(spans: Column, new: Column) -> Column:
    """Sorted spans, one by one: each one is joined to the last if it begins within it."""
    last = F.get(spans, F.size(spans) - 1)
    meets = (F.size(spans) > 0) & (new["start"] <= last["end"])
    widest = F.struct(last["start"].alias("start"), F.greatest(last["end"], new["end"]).alias("end"))
    return F.when(meets, F.concat(F.slice(spans, 1, F.greatest(F.size(spans) - 1, F.lit(0))), F.array(widest))).otherwise(F.concat(spans, F.array(new)))


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list[str | None], list[str | None]]]:
    """The items, at most BLOCK_BYTES of text (or one item) at a time: one read, whose parts come to the driver one after the other."""
    items = benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where("text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ids: list[str | None] = []
    texts: list[str | None] = []
    size = 0
    for row in items.repartition(max(1, -(-total // BLOCK_BYTES))).toLocalIterator():
        n = len(row.text.encode("utf-8", "surrogatepass"))
        if texts and size + n > BLOCK_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(row.id)
        texts.append(row.text)
        size += n
    yield ids, texts


def annotate(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """The columns `keep` of every document and `hits`: n_words, hit word spans, ids of occurring items, longest match."""
    spark = docs.sparkSession
    source = docs.select(*keep, F.col(text_col).alias("__text"))
    held: list[Broadcast] = []
    parts: list[DataFrame] = []
    for block in _blocks(benchmark, item_id_col, item_text_col):
        if len(held) == GROUP_BLOCKS:
            parts.append(stored(_matches(source, held, window), "matches"))
            for tests in held:
                tests.unpersist()
            held = []
        held.append(spark.sparkContext.broadcast(block))
    if not parts:
        return _annotated(source, keep, held, window)
    return _put_together(source, keep, [*parts, stored(_matches(source, held, window), "matches")])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text") -> DataFrame:
    """The documents in which no window of a test item occurs; all columns stay as they are."""
    carried = docs.toDF(*(f"__c{i}" for i in range(len(docs.columns))))  # `hits` may be a column of docs
    text = carried.columns[docs.columns.index(text_col)]
    kept = annotate(carried, benchmark, window, tuple(carried.columns), text).where(F.size("hits.spans") == 0).drop("hits")
    return kept.toDF(*docs.columns)


def report(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Per row of documents: n_words, n_hit, n_items, items_sha256, contaminated, and the longest match."""
    found = annotate(docs, benchmark, window)
    n_hit = F.aggregate("hits.spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        F.col("hits.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits.spans") > 0).alias("contaminated"),
        F.col("hits.longest_words").alias("longest_words"),
        F.col("hits.longest_start").alias("longest_start"),
    )
