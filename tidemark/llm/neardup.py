"""Near-duplicate groups by a MinHash LSH forest, with links confirmed on full shingle sets (operator 2).

1. Each text's distinct word shingles give a set key (exact copies share it) and `trees` signatures of
   `CEILING` minimum hashes.  Copies collapse to the least id before anything else is shuffled.
2. Forest: for each tree the representatives are sorted by that tree's signature, by range partition
   over the whole order (a hot prefix spreads over partitions).  The longest common prefix of each
   two neighbours is measured.  A text's candidate edge leads to the first text of the run that
   shares this prefix, with the prefix's length; so all texts that agree on the first d hashes of a
   tree are connected by edges of length d or more.  At `FLOOR` hashes a pair at the threshold
   agrees in no tree with a chance of `miss` at most.
3. Depth by region: regions are connected by edges of `FLOOR` or more.  A region of more than
   `local_shingles` shingles is split by the edges of one hash more, and its parts again, down to
   `CEILING`.  A region that is small enough is settled in one task, exactly: texts are compared by full
   sets, breadth first, and only with texts that no component holds yet.
4. In regions that stay too large at `CEILING` a text is compared with the heads of its runs, at most two,
   which joins up a family of near copies with as many comparisons as it has texts.
5. Climbing back: what the descent kept apart is found by a join over each region that was split.
   With tokens in one order from rare to frequent, two linked sets share a token within the prefixes
   that their sizes allow, at places that leave room for enough common ones.  Only texts of different
   components are paired.  One pair for each two components is compared first, as most of
   those that belong together join up by it; the remaining pairs then make the result exact.
6. Components of the links; copies follow their representative.

Defined results: texts without words have an empty set and link with nothing; texts shorter than a
shingle have one shingle, the whole.  A row without an id is left alone: component null, kept true.
Repeated rows are one document, and each gives a row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import bytetext
from tidemark.llm.graph import connected_components
from tidemark.llm.scratch import map_batches, stored

FLOOR = 5
CEILING = 8
LOCAL_SHINGLES = 1 << 20
#: Token frequencies are counted in so many buckets, which bounds what is broadcast; a shared bucket costs time only.
FREQUENCY_BITS = 16


def trees_for(percent: int, miss: float, depth: int = FLOOR) -> int:
    """How many trees miss a pair at the threshold with a chance of `miss` at most."""
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** depth))


def linked(size: int, other: int, common: int, percent: int) -> bool:
    return 100 * common >= percent * (size + other - common)


# ---- 1: sets and signatures


def signatures(docs: DataFrame, shingle: int, trees: int, depth: int = CEILING, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, hi, lo, sig): set size, 128-bit set key, and the hashes of all trees, 4 bytes big-endian each."""
    n_hash = trees * depth
    draw = np.random.default_rng(29)
    factor = draw.integers(1, 1 << 63, n_hash, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    offset = draw.integers(0, 1 << 63, n_hash, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in bytetext.chunks(batch.column(1)):
                sets = bytetext.shingle_sets(bytetext.Words(data, offsets, bytetext.SPACED, lower=True), shingle)
                size = np.fromiter(map(len, sets), np.int64, len(sets))
                full = np.flatnonzero(size > 0)
                flat = np.concatenate([np.zeros(0, np.uint64), *sets])
                first = (np.cumsum(size) - size)[full]
                hi, lo = np.zeros((2, len(sets)), np.uint64)
                sig = np.zeros((len(sets), n_hash), ">u4")
                if len(full):
                    hi[full] = np.add.reduceat(bytetext.mix(flat), first)
                    lo[full] = np.add.reduceat(bytetext.mix(flat + np.uint64(0x5851F42D4C957F2D)), first)
                    for k in range(n_hash):
                        sig[full, k] = np.minimum.reduceat((flat * factor[k] + offset[k]) >> np.uint64(32), first)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(size, pa.int32()),
                        pa.array(hi.view(np.int64)),
                        pa.array(lo.view(np.int64)),
                        pa.array([row.tobytes() for row in sig], pa.binary()),
                    ],
                    ["id", "n_shingles", "hi", "lo", "sig"],
                )

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    return map_batches(source, run, "id long, n_shingles int, hi long, lo long, sig binary")


# ---- 2: the forest


def _common_prefix(key: np.ndarray, other: np.ndarray) -> np.ndarray:
    """How many leading hashes the rows of two matrices share."""
    return np.cumprod(key == other, axis=1).sum(1)


def forest_edges(reps: DataFrame, trees: int, depth: int = CEILING, floor: int = FLOOR) -> DataFrame:
    """(a, b, common): each text b of some tree's order with the head a of its run, the texts that share `common` hashes.

    `common` is the longest prefix that b shares with the text before it, if that is at least `floor`.
    """
    width = 4 * depth
    ends = (pa.int64(), pa.int32(), pa.binary())

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                sig = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(part.num_rows, -1)
                for t in range(trees):
                    key = np.ascontiguousarray(sig[:, t * width : (t + 1) * width])
                    fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(key), [None, pa.py_buffer(key)])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), t, np.int32)), fixed.cast(pa.binary()), part.column(0)], ["tree", "key", "id"])

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId()
        first = last = None  # (tree, key, id) of the partition's ends
        heads = np.zeros(depth + 1, np.int64)  # by prefix length: the head of the run that the last text is in

        def rows(a, b, common, mark=(None, None, None)):
            arrays = [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(common, pa.int32()), *(pa.array([m] * len(a), t) for m, t in zip(mark, ends))]
            return pa.RecordBatch.from_arrays(arrays, ["a", "b", "common", "place", "tree", "key"])

        for batch in batches:
            if not batch.num_rows:
                continue
            tree, id_ = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            key = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(len(tree), depth)
            common = np.zeros(len(tree), np.int32)
            common[1:] = np.where(tree[1:] == tree[:-1], _common_prefix(key[1:], key[:-1]), 0)
            if first is None:
                first = (int(tree[0]), key[0].tobytes(), int(id_[0]))
            elif last[0] == tree[0]:
                common[0] = _common_prefix(key[:1], np.frombuffer(last[1], np.uint32)[None, :])[0]
            head_of = np.zeros((depth + 1, len(tree)), np.int64)
            for d in range(floor, depth + 1):
                at = np.maximum.accumulate(np.where(common < d, np.arange(len(tree)), -1))
                head_of[d] = np.where(at < 0, heads[d], id_[at])
            heads = head_of[:, -1].copy()
            own = np.flatnonzero(common >= floor)
            yield rows(head_of[common[own], own], id_[own], common[own])
            last = (int(tree[-1]), key[-1].tobytes(), int(id_[-1]))
        if first is not None:  # the partition's ends, to be joined to the next partition's
            yield rows([first[2]], [None], [None], (2 * place, *first[:2]))
            yield rows([last[2]], [None], [None], (2 * place + 1, *last[:2]))

    keyed = map_batches(reps.select("id", "sig"), spread, "tree int, key binary, id long")
    ordered = keyed.repartitionByRange("tree", "key", "id").sortWithinPartitions("tree", "key", "id")
    found = stored(map_batches(ordered, neighbours, "a long, b long, common int, place long, tree int, key binary"), "neighbours")
    marks = sorted(found.where("place is not null").collect(), key=lambda r: r.place)  # two rows a partition
    across = []
    for x, y in zip(marks, marks[1:]):
        if x.tree == y.tree and x.a != y.a:
            common = int(_common_prefix(*(np.frombuffer(bytes(r.key), np.uint32)[None, :] for r in (x, y)))[0])
            across += [(x.a, y.a, common)] * (common >= floor)
    edges = found.where("place is null").select("a", "b", "common")
    return edges.unionByName(reps.sparkSession.createDataFrame(across, "a long, b long, common int")) if across else edges


# ---- 3: regions settled in one task


def settle(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """The component of each set: the least place linked to it, directly or through others."""
    n = len(sets)
    label = np.full(n, -1)
    size = np.fromiter(map(len, sets), np.int64, n)
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    bounds = np.concatenate([[0], np.cumsum(size)])
    mark = np.zeros(int(token.max(initial=0)) + 1, np.int64)
    rest, flat = np.arange(n), token  # texts that no component holds yet, and their tokens
    first, rest_size = bounds[:-1], size
    for start in range(n):
        if label[start] >= 0:
            continue
        label[start], queue = start, [start]
        while queue:
            open_ = label[rest] < 0
            if not open_.any():
                break
            if open_.sum() * 2 < len(rest):
                flat = flat[np.repeat(open_, rest_size)]
                rest, rest_size = rest[open_], rest_size[open_]
                first, open_ = np.cumsum(rest_size) - rest_size, np.ones(len(rest), bool)
            k = queue.pop()
            own = token[bounds[k] : bounds[k + 1]]
            mark[own] = 1
            common = np.add.reduceat(mark[flat], first)
            mark[own] = 0
            hit = rest[open_ & (100 * common >= percent * (size[k] + rest_size - common))]
            label[hit] = start
            queue.extend(hit.tolist())
    return label


def _local_components(active: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(id, component) of texts in clusters that fit one task; rows come as (cluster, id, text)."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
        cluster, ids, sets = None, [], []
        for batch in batches:
            for a, b, data, offsets in bytetext.chunks(batch.column(2)):
                found = bytetext.shingle_sets(bytetext.Words(data, offsets, bytetext.SPACED, lower=True), shingle)
                for c, i, s in zip(batch.column(0).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a).to_pylist(), found):
                    if c != cluster:
                        if ids:
                            yield ids, sets
                        cluster, ids, sets = c, [], []
                    if not ids or ids[-1] != i:  # a repeated row
                        ids.append(i)
                        sets.append(s)
        if ids:
            yield ids, sets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_id: list[int] = []
        out: list[int] = []
        for ids, sets in groups(batches):
            if len(ids) == 2:
                common = len(sets[0]) + len(sets[1]) - len(np.union1d(*sets))
                label = [0, 0 if linked(len(sets[0]), len(sets[1]), common, percent) else 1]
            else:
                label = settle(sets, percent).tolist()
            out_id += ids
            out += [ids[k] for k in label]  # ids ascend
            if len(out) >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(out_id, pa.int64()), pa.array(out, pa.int64())], ["id", "component"])
                out_id, out = [], []
        yield pa.RecordBatch.from_arrays([pa.array(out_id, pa.int64()), pa.array(out, pa.int64())], ["id", "component"])

    return map_batches(active.select("cluster", "id", "text").repartition("cluster").sortWithinPartitions("cluster", "id"), run, "id long, component long")


# ---- 4 and 5: regions that were split


def _needed(size: int, other: int, percent: int) -> int:
    """The least common size of linked sets."""
    return -(-percent * (size + other) // (100 + percent))


def _confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Those pairs (a, b) whose texts' full sets are linked; texts come as (id, text)."""
    sides = [texts.select(F.col("id").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int | None, np.ndarray] = (None, np.zeros(0, np.uint64))
        for batch in batches:
            keep = []
            for k, a in enumerate(batch.column(0).to_pylist()):
                x, y = (last[1] if c == 2 and a == last[0] else bytetext.shingle_sets(bytetext.Words(*bytetext.string_buffers(batch.column(c).slice(k, 1)), bytetext.SPACED, lower=True), shingle)[0] for c in (2, 3))
                last = (a, x)
                keep.append(linked(len(x), len(y), len(np.intersect1d(x, y, assume_unique=True)), percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(sides[1], "b").join(sides[0], "a")
    return map_batches(both.select("a", "b", "text_a", "text_b"), run, "a long, b long")


def _frequencies(texts: DataFrame, shingle: int) -> np.ndarray:
    """How many tokens of all texts fall into each of 2^FREQUENCY_BITS buckets."""
    size = 1 << FREQUENCY_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(size, np.int64)
        for batch in batches:
            for _, _, data, offsets in bytetext.chunks(batch.column(0)):
                sets = bytetext.shingle_sets(bytetext.Words(data, offsets, bytetext.SPACED, lower=True), shingle)
                token = np.concatenate([np.zeros(0, np.uint64), *sets])
                count += np.bincount((token >> np.uint64(64 - FREQUENCY_BITS)).astype(np.int64), minlength=size)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(count[used])], ["bucket", "n"])

    out = np.zeros(size, np.int64)
    for row in map_batches(texts.select("text"), run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def _prefixes(texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(region, id, token, size, place): each text's first tokens, from rare to frequent, that a linked one must share; rows as (region, id, text)."""
    frequency = texts.sparkSession.sparkContext.broadcast(_frequencies(texts, shingle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in bytetext.chunks(batch.column(2)):
                tokens, sizes, counts = [np.zeros(0, np.uint64)], [], []
                for own in bytetext.shingle_sets(bytetext.Words(data, offsets, bytetext.SPACED, lower=True), shingle):
                    size = len(own)
                    most = size - _needed(size, -(-percent * size // 100), percent) + 1 if size else 0
                    rare = frequency.value[(own >> np.uint64(64 - FREQUENCY_BITS)).astype(np.int64)]
                    tokens.append(own[np.lexsort((own, rare))[:most]])
                    sizes.append(size)
                    counts.append(most)
                row = np.repeat(np.arange(b - a), counts)
                part = batch.slice(a, b - a)
                place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
                arrays = [part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.array(sizes, np.int32)[row]), pa.array(place.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(arrays, ["region", "id", "token", "size", "place"])

    return map_batches(texts.select("region", "id", "text"), run, "region long, id long, token long, size int, place int")


def _across(tokens: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of different components that may be linked: one for each two components, and all; rows as of _prefixes and `component`."""
    key = ["region", "token"]
    side = lambda df, c: df.select(*key, *(F.col(k).alias(f"{k}_{c}") for k in ("id", "component", "size", "place")))
    needed = F.ceil(F.lit(percent) * (F.col("size_a") + F.col("size_b")) / F.lit(100 + percent))
    room = F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b")) >= needed
    fits = room & (F.lit(100) * F.least("size_a", "size_b") >= F.lit(percent) * F.greatest("size_a", "size_b"))
    # a token's rows by component; tokens that stay within one component pair nothing
    groups = tokens.groupBy(*key, "component").agg(F.count("*").alias("n"), F.min(F.struct("place", "id", "size")).alias("m"))
    shared = groups.groupBy(*key).agg(F.max(F.struct("n", "component")).alias("most"), F.count("*").alias("components")).where("components > 1")
    shared = stored(shared.select(*key, F.col("most.component").alias("largest")), "shared")
    one = groups.join(shared, key).select(*key, "component", "m.id", "m.size", "m.place")
    samples = side(one, "a").join(side(one, "b"), key).where((F.col("component_a") < F.col("component_b")) & fits)
    samples = samples.groupBy("component_a", "component_b").agg(F.min(F.struct(F.col("id_a").alias("a"), F.col("id_b").alias("b"))).alias("p")).select("p.a", "p.b")
    # of each token's components all but the largest are matched with all, so that a family isn't paired with itself
    rows = tokens.join(shared, key)
    few = side(rows.where("component != largest"), "a")
    pairs = few.join(side(rows, "b"), key).where((F.col("component_a") != F.col("component_b")) & fits)
    pairs = pairs.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()
    return samples, pairs


def _settle_split(split: DataFrame, labels: DataFrame, heads: DataFrame, source: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(id, component) of the texts in split regions.

    split: (id, region at the floor); labels: (id, component) out of parts that were settled; heads: (a, b), texts of
    parts that stayed too large with heads of their runs; source: (id, text).
    """
    texts = stored(source.join(split, "id").dropDuplicates(["id"]).select("region", "id", "text"), "split")
    links = stored(labels.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(_confirmed(heads, texts, shingle, percent)), "links")
    tokens = stored(_prefixes(texts, shingle, percent), "tokens")

    def labelled() -> DataFrame:
        found = connected_components(links)
        return split.join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))

    for step in (0, 1):
        pairs = _across(tokens.join(labelled(), "id"), percent)[step]
        links = stored(links.unionByName(_confirmed(pairs, texts, shingle, percent)), "links")
    return labelled()


# ---- all together


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, miss: float = 1e-6, id_col: str = "doc_id", text_col: str = "text", local_shingles: int = LOCAL_SHINGLES) -> DataFrame:
    """(id, n_shingles, component_id) of every row with an id; linked if 100 * common >= percent * union."""
    trees = trees_for(percent, miss)
    table = stored(signatures(docs, shingle, trees, CEILING, id_col, text_col), "signatures")
    best = table.where("n_shingles > 0").groupBy("hi", "lo").agg(F.min(F.struct("id", "n_shingles", "sig")).alias("m"))
    reps = stored(best.select("hi", "lo", "m.id", "m.n_shingles", "m.sig"), "representatives")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    edges = stored(forest_edges(reps, trees), "edges")
    labels, split, large = None, None, None
    for depth in range(FLOOR, CEILING + 1):
        found = connected_components(edges.where(F.col("common") >= depth))
        members = found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
        members = members.select(F.col("node").alias("id"), F.col("component").alias("cluster")).join(reps.select("id", "n_shingles"), "id")
        totals = members.groupBy("cluster").agg(F.sum("n_shingles").alias("total"))
        members = stored(members.join(totals, "cluster").select("id", "cluster", (F.col("total") > local_shingles).alias("large")), "members")
        settled = _local_components(source.join(members.where("not large"), "id"), shingle, percent)
        labels = settled if labels is None else labels.unionByName(settled)
        large = members.where("large").select("id", "cluster")
        if large.isEmpty():
            break
        if split is None:
            split = large.withColumnRenamed("cluster", "region")
        inside = large.select("id")  # both ends of an edge are in one region
        edges = stored(edges.join(inside.withColumnRenamed("id", "a"), "a", "left_semi"), "edges")
    if split is not None:
        labels = stored(labels, "labels")
        # edges are those of parts that are too large at the ceiling; each text keeps two of its heads
        heads = edges.where(F.lit(not large.isEmpty()) & (F.col("common") >= CEILING)).groupBy("b").agg(F.min("a").alias("least"), F.max("a").alias("most"))
        heads = heads.select(F.explode(F.array_distinct(F.array("least", "most"))).alias("a"), "b")
        deep = _settle_split(split, labels.join(split, "id", "left_semi"), heads, source, shingle, percent)
        labels = labels.join(split, "id", "left_anti").unionByName(deep)
    # one row a set: its component; then every row of the table by its set
    sets = reps.select("hi", "lo", "id").join(labels, "id", "left").select("hi", "lo", F.coalesce("component", "id").alias("component"))
    return table.select("id", "n_shingles", "hi", "lo").join(sets, ["hi", "lo"], "left").select(
        F.col("id").alias(id_col), F.col("n_shingles").cast("long").alias("n_shingles"), F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id")
    )


def deduplicate(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents but those whose component has a smaller id; all columns stay as they are."""
    found = near_duplicates(docs, shingle, percent, id_col=id_col, text_col=text_col)
    name = "__dropped"
    while name in docs.columns:
        name += "_"
    gone = found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(name)).distinct()
    return docs.join(gone, F.col(id_col) == F.col(name), "left_anti")


def report(docs: DataFrame, shingle: int = 3, percent: int = 85) -> DataFrame:
    """Per row of documents: n_shingles, component_id and kept."""
    found = near_duplicates(docs, shingle, percent)
    alone = docs.where("doc_id is null").select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return found.unionByName(alone).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
