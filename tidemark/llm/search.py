"""Ranked lexical search (operator 11): the best documents for each item, by the Best Position Algorithm.

1. One map over the documents keeps, a row, its number of terms and the numbers and counts of those terms that
   items have; this forward index is written once to the shared folder.  Counts of documents, terms and documents
   a term are sums over it.
2. A map over the forward index turns up to `SHARD_POSTINGS` postings of a task at a time into impact lists: a
   term's documents by falling impact (weight times saturated count).  For each item the lists of its terms are
   read in step, in blocks that double.  A document seen for the first time is looked up in all lists, which
   gives its whole score and marks its place in each of them.  A list's best position is the end of the unbroken
   stretch of marked places from its top, which may lie beyond what was read; no document that is still unseen
   can score more than the sum of the impacts that follow the best positions.  Reading stops when that sum is
   strictly below the score of the item's last kept document, or 0.  The kept ones are carried from shard to
   shard of a task, so that later shards stop early.
3. A task gives at most k rows an item; the best of tasks, then of all, are kept by windows.

Shards hold documents, so a frequent term's list is cut like everything else, and no task gathers a term's whole
list.  Items are taken in blocks of some `ITEM_BYTES` of text, since their terms are broadcast; each block is
one pass over the documents.  A block of more than four times that (one giant item) is refused.

Terms are the maximal matches of [^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+ with A-Z lower-cased.

Defined results: null and empty texts have no terms; such documents count nowhere and such items get no rows.
Each row of either table counts by itself: repeated documents both rank, a repeated item gets its rows twice.
Equal scores go by ascending id, a null id first.  Only id and text columns are read, so further columns cannot
clash.  Empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import bytetext
from tidemark.llm.scratch import map_batches, stored

TOP = 20
ITEM_BYTES = 8 << 20
SHARD_POSTINGS = 1 << 20
#: Places that are read from each list at first; twice as many each time.
FIRST_BLOCK = 32
#: Groups of tasks whose best rows are taken before those of all.
GROUPS = 64
#: Fixed values of the score.
WEIGHT, SCALE, SATURATION, LENGTH_SHARE = 1000, 1_000_000_000, 12, 25

_SPACES = bytes(b if bytetext.NAMES[b] else 0x20 for b in bytetext.LOWER.tolist())


def terms_of(raw: bytes) -> list[bytes]:
    return raw.translate(_SPACES).split()


def _blocks(items: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[object, bytes]]]:
    """(id, text) of the items, in blocks of about ITEM_BYTES."""
    chosen = items.select(F.col(item_col).alias("item"), F.encode(F.coalesce(text_col, F.lit("")), "UTF-8").alias("text"))
    total = chosen.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    number = max(1, -(-total // ITEM_BYTES))
    block = F.pmod(F.xxhash64("item", "text"), F.lit(number))
    if number > 1 and (most := chosen.groupBy(block.alias("b")).agg(F.sum(F.octet_length("text")).alias("s")).agg(F.max("s")).first()[0]) > 4 * ITEM_BYTES:
        raise ValueError(f"a block of items has {most} bytes: one item is too large to broadcast, or is repeated too often")
    for k in range(number):
        yield [(r.item, bytes(r.text)) for r in chosen.where(block == k).collect()]


def _forward_index(docs: DataFrame, index, id_col: str, text_col: str) -> DataFrame:
    """(doc, n, terms, tf): a row's number of terms, and the sorted numbers and counts of those in `index`."""
    source = docs.select(F.col(id_col).alias("doc"), text_col)
    names = ["doc", "n", "terms", "tf"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = index.value.get
        width = max(1, len(index.value))
        for batch in batches:
            for a, b, data, offsets in bytetext.chunks(batch.column(1)):
                raw = data.tobytes().translate(_SPACES)
                texts = [raw[i:j].split() for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                sizes = np.fromiter(map(len, texts), np.int64, len(texts))
                found = np.concatenate([np.fromiter(map(find, t, repeat(-1)), np.int64, len(t)) for t in texts])
                row = np.repeat(np.arange(len(texts)), sizes)
                key, count = np.unique(row[found >= 0] * width + found[found >= 0], return_counts=True)
                bounds = pa.array(np.searchsorted(key, np.arange(len(texts) + 1) * width), pa.int32())
                lists = [pa.ListArray.from_arrays(bounds, pa.array(x, pa.int32())) for x in (key % width, count)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sizes), *lists], names)

    lists = [T.StructField(n, T.ArrayType(T.IntegerType())) for n in names[2:]]
    return map_batches(source, run, T.StructType([source.schema["doc"], T.StructField("n", T.LongType()), *lists]))


class Shard:
    """Impact lists of some documents, with direct access by term and document."""

    def __init__(self, ids: pa.Array, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, terms: int):
        self.ids = ids
        tie = np.empty(len(ids), np.int64)
        tie[np.asarray(pc.sort_indices(ids, null_placement="at_start"))] = np.arange(len(ids))
        self.tie = tie
        order = np.argsort(term, kind="stable")  # postings come by document
        self.key = term[order] * np.int64(len(ids)) + doc[order]
        self.of_key = impact[order]
        by_impact = np.lexsort((tie[doc], -impact, term))
        self.doc, self.impact = doc[by_impact], impact[by_impact]
        place = np.empty(len(term), np.int64)
        place[by_impact] = np.arange(len(term))
        self.place = place[order]
        self.first = np.searchsorted(term[by_impact], np.arange(terms + 1))
        self.marked, self.seen = np.full(len(term), -1, np.int32), np.full(len(ids), -1, np.int32)

    def best(self, item: int, terms: np.ndarray, repeats: np.ndarray, kept: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents (their numbers here) and scores that may be among the k best, given the falling scores that are kept already."""
        low, high = self.first[terms], self.first[terms + 1]
        has = high > low
        terms, repeats, low, high = terms[has], repeats[has], low[has], high[has]
        best, docs, scores = low.copy(), np.zeros(0, np.int64), np.zeros(0, np.int64)
        depth, block = 0, FIRST_BLOCK
        while len(terms):
            read = [self.doc[a:b] for a, b in zip((low + depth).tolist(), np.minimum(low + depth + block, high).tolist()) if a < b]
            depth, block = depth + block, 2 * block
            fresh = np.unique(np.concatenate(read)) if read else docs[:0]
            fresh = fresh[self.seen[fresh] != item]
            self.seen[fresh] = item
            # direct access: the new documents in every list
            wanted = (terms[:, None] * np.int64(len(self.ids)) + fresh[None, :]).ravel()
            at = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
            hit = np.flatnonzero(self.key[at] == wanted)
            self.marked[self.place[at[hit]]] = item
            gain = np.zeros(len(wanted), np.int64)
            gain[hit] = self.of_key[at[hit]]
            total = (gain.reshape(len(terms), len(fresh)) * repeats[:, None]).sum(axis=0)
            docs, scores = np.concatenate([docs, fresh]), np.concatenate([scores, total])
            if len(docs) > k:
                top = np.lexsort((self.tie[docs], -scores))[:k]
                docs, scores = docs[top], scores[top]
            bound = 0
            for j in range(len(terms)):
                best[j] = self._unmarked(int(best[j]), int(high[j]), item)
                if best[j] < high[j]:
                    bound += int(self.impact[best[j]]) * int(repeats[j])
            together = np.sort(np.concatenate([kept, scores]))[::-1]
            if bound == 0 or (len(together) >= k and together[k - 1] > bound):
                break
        return docs, scores

    def _unmarked(self, at: int, high: int, item: int) -> int:
        """The first place from `at` on that isn't marked for the item."""
        step = 64
        while at < high:
            part = self.marked[at : min(at + step, high)] == item
            if not part.all():
                return at + int(part.argmin())
            at, step = at + len(part), 4 * step
        return high


def _best_of_tasks(index: DataFrame, items, weights, documents: int, length: int, k: int, terms: int) -> DataFrame:
    """(item, doc, score): at most k rows an item and task."""
    schema = T.StructType([T.StructField("item", T.IntegerType()), index.schema["doc"], T.StructField("score", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[tuple[int, bool, object]]] = [[] for _ in items.value]  # (-score, id is given, id), best first
        held: list[pa.RecordBatch] = []
        kind, postings = None, 0

        def settle() -> None:
            ids = pa.concat_arrays([h.column(0) for h in held])
            n = np.concatenate([np.asarray(h.column(1)) for h in held])
            term, tf = (np.concatenate([np.asarray(h.column(c).flatten()) for h in held]).astype(np.int64) for c in (2, 3))
            doc = np.repeat(np.arange(len(ids)), np.concatenate([np.asarray(h.column(2).value_lengths()) for h in held]))
            m = 100 - LENGTH_SHARE + (LENGTH_SHARE * n * documents) // max(1, length)
            impact = weights.value[term] * ((SCALE * tf) // (1000 * tf + SATURATION * m[doc]))
            some = impact > 0
            if not some.any():
                return
            shard = Shard(ids, term[some], doc[some], impact[some], terms)
            for item, (numbers, repeats) in enumerate(items.value):
                before = kept[item]
                docs, scores = shard.best(item, numbers, repeats, np.array([-x[0] for x in before], np.int64), k)
                if len(docs):
                    last = before[-1][0] if len(before) == k else 1
                    names = shard.ids.take(pa.array(docs)).to_pylist()
                    new = [(-s, i is not None, i if i is not None else 0) for s, i in zip(scores.tolist(), names) if s > 0 and -s <= last]
                    kept[item] = sorted(before + new)[:k]

        for batch in batches:
            held.append(batch)
            kind = batch.schema.field(0).type
            postings += len(batch.column(2).flatten())
            if postings >= SHARD_POSTINGS:
                settle()
                held, postings = [], 0
        if held:
            settle()
        rows = [(item, i if given else None, -s) for item, best in enumerate(kept) for s, given, i in best]
        if rows:
            item, doc, score = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc, kind), pa.array(score, pa.int64())], ["item", "doc", "score"])

    return map_batches(index, run, schema)


def _top(found: DataFrame, k: int, *group: str) -> DataFrame:
    order = Window.partitionBy("item", *group).orderBy(F.desc("score"), F.asc_nulls_first("doc"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _rank_block(docs: DataFrame, block: list[tuple[object, bytes]], item_type: T.DataType, k: int, id_col: str, text_col: str) -> DataFrame | None:
    spark = docs.sparkSession
    numbers: dict[bytes, int] = {}
    items, names = [], []
    for name, text in block:
        counts: dict[int, int] = {}
        for term in terms_of(text):
            t = numbers.setdefault(term, len(numbers))
            counts[t] = counts.get(t, 0) + 1
        if counts:
            chosen = sorted(counts)
            items.append((np.array(chosen, np.int64), np.array([counts[t] for t in chosen], np.int64)))
            names.append(name)
    if not items:
        return None
    index = stored(_forward_index(docs, spark.sparkContext.broadcast(numbers), id_col, text_col), "forward")
    documents, length = index.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequency = index.select(F.explode("terms").alias("t")).groupBy("t").count().toArrow()
    weights = np.zeros(len(numbers), np.int64)
    weights[frequency.column("t").to_numpy()] = [math.floor(WEIGHT * math.log((2 * documents + 2) / (2 * df + 1))) for df in frequency.column("count").to_pylist()]
    share = spark.sparkContext.broadcast
    found = _best_of_tasks(index, share(items), share(weights), documents, length, k, len(numbers))
    best = _top(_top(found.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(GROUPS))), k, "part").drop("part", "rank"), k)
    schema = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", item_type)])
    return best.join(F.broadcast(spark.createDataFrame(list(enumerate(names)), schema)), "item").select("item_id", "rank", F.col("doc").alias(id_col), "score")


def rank(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, id_col, score): the k documents with the highest scores above 0 for each item."""
    kind = items.schema[item_col].dataType
    parts = [p for block in _blocks(items, item_col, text_col) if (p := _rank_block(docs, block, kind, k, id_col, text_col)) is not None]
    if parts:
        return reduce(DataFrame.unionByName, parts)
    schema = T.StructType([T.StructField("item_id", kind), T.StructField("rank", T.IntegerType()), docs.schema[id_col], T.StructField("score", T.LongType())])
    return docs.sparkSession.createDataFrame([], schema)
