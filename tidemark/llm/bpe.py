"""Byte-level BPE encoding and decoding (operator 9).

Encoding splits each text by a pretoken pattern.  The distinct pretokens of a batch are grouped by
padded length into numpy matrices of token ids (initially one id a byte).  In each round every row
merges its leftmost pair of minimum rank: pair ranks come from an open-addressing hash table, merged
rows are compacted, and rows without a mergeable pair leave the matrix.  A pretoken of more than
`PIECE` bytes is cut into pieces that are rows of the matrix like any other.  A cut stands if the
ids on its two sides stay apart when their bytes are encoded together: a merge across the cut would
have to happen inside these two tokens, so the ids on both sides are then those of the whole.  Where
a cut doesn't stand, some ids on either side of it are encoded anew as one row, twice as many each
time.  The work so grows in proportion to a pretoken's length.  A task keeps the ids of at most
`CACHE_PRETOKENS` pretokens between batches.

Defined results: a null text encodes as an empty list, an empty list decodes as empty bytes, a null
list likewise.  Each input row gives one row; repeated rows give repeated rows.  Only the id column
and the text (or ids) column are read, so further columns cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import bytetext
from tidemark.llm.scratch import map_batches

#: Bytes of a row of the matrix, but for those that span a cut; cells of a matrix.
PIECE = 64
MATRIX_CELLS = 1 << 16
CACHE_PRETOKENS = 100_000
#: Vocabularies are broadcast to executors; larger files are refused.
MAX_VOCABULARY_BYTES = 64 << 20
NONE = np.int64(1) << 40


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of lines `base64 rank`."""
    with open(path, "rb") as file:
        raw = file.read(MAX_VOCABULARY_BYTES + 1)
    if len(raw) > MAX_VOCABULARY_BYTES:
        raise ValueError("the vocabulary is larger than MAX_VOCABULARY_BYTES")
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}


class PairTable:
    """Hash table from a pair of token ids to the id (which is the rank) of their concatenation."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        key, value = np.array(keys, np.uint64), np.array(values, np.int64)
        self.bits = max(4, int(len(key) * 4).bit_length())
        self.keys = np.full(1 << self.bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.values = np.full(1 << self.bits, NONE)
        slot, left = self._slot(key), np.arange(len(key))
        while len(left):
            free = left[self.keys[slot[left]] == np.uint64(0xFFFFFFFFFFFFFFFF)]
            self.keys[slot[free]] = key[free]  # of keys with one slot the last stays
            placed = self.keys[slot[left]] == key[left]
            self.values[slot[left[placed]]] = value[left[placed]]
            left = left[~placed]
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; NONE where there is no such token."""
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.values[slot], NONE)
        open_ = np.flatnonzero((found != key) & (found != np.uint64(0xFFFFFFFFFFFFFFFF)))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            found = self.keys[slot[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (found != np.uint64(0xFFFFFFFFFFFFFFFF))]
        return out


class Encoder:
    """Pretokens to token ids; holds the vocabulary's tables and a bounded cache."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        self.table = PairTable(ranks)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.tokens = {rank: token for token, rank in ranks.items()}
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.bounds = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _merge_rows(self, rows: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge every row of a padded matrix of ids to its end; returns the matrix and the rows' lengths."""
        n, width = rows.shape
        rank = np.full((n, width), NONE)
        if width > 1:
            at, col = np.nonzero(np.arange(width - 1)[None, :] < (length - 1)[:, None])
            rank[at, col] = self.table.ranks(rows[at, col], rows[at, col + 1])
        done_rows, done_length, live = rows.copy(), length.copy(), np.arange(n)
        columns = np.arange(width)[None, :]
        while len(live):
            where = rank.argmin(axis=1)
            best = rank[np.arange(len(live)), where]
            going = best < NONE
            if not going.all():
                stop = ~going
                done_rows[live[stop]], done_length[live[stop]] = rows[stop], length[stop]
                rows, rank, length, live, where, best = rows[going], rank[going], length[going], live[going], where[going], best[going]
                if not len(live):
                    break
            each = np.arange(len(live))
            source = np.minimum(columns + (columns > where[:, None]), width - 1)  # compaction: close the gap after the merged pair
            rows, rank = np.take_along_axis(rows, source, 1), np.take_along_axis(rank, source, 1)
            rank[:, -1] = NONE
            rows[each, where] = best
            length = length - 1
            rank[each, where] = NONE
            has = np.flatnonzero(where < length - 1)
            rank[has, where[has]] = self.table.ranks(rows[has, where[has]], rows[has, where[has] + 1])
            has = np.flatnonzero(where > 0)
            rank[has, where[has] - 1] = self.table.ranks(rows[has, where[has] - 1], rows[has, where[has]])
        return done_rows, done_length

    def _encode_rows(self, raw: list[bytes]) -> list[np.ndarray]:
        """The ids of byte strings, each a row of some matrix."""
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        data, start = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(size) - size
        width = np.where(size <= 16, size, 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))
        parts: list[np.ndarray] = [np.zeros(0, np.int64)] * len(raw)
        for w in np.unique(width[size > 0]):
            at = np.flatnonzero(width == w)
            step = max(1, MATRIX_CELLS // max(1, int(w)))
            for block in (at[i : i + step] for i in range(0, len(at), step)):
                place = start[block][:, None] + np.arange(w)[None, :]
                rows = self.byte_ids[data[np.minimum(place, len(data) - 1)]]
                rows, length = self._merge_rows(rows, size[block])
                for k, row, m in zip(block.tolist(), rows, length.tolist()):
                    parts[k] = row[:m]
        return parts

    def _bytes_of(self, ids: np.ndarray) -> bytes:
        return b"".join(self.tokens[i] for i in ids.tolist())

    def _encode_long(self, raw: list[bytes]) -> list[np.ndarray]:
        """The ids of byte strings that are cut into pieces, with every cut made to stand."""
        pieces = [r[i : i + PIECE] for r in raw for i in range(0, len(r), PIECE)]
        parts = self._encode_rows(pieces)
        # the cut after each piece: 0 stands, -1 is the string's end, else how many ids to take from either side if it doesn't stand
        cuts = [-1 if i + PIECE >= len(r) else 2 for r in raw for i in range(0, len(r), PIECE)]
        while open_ := [i for i, k in enumerate(cuts) if k > 0]:
            pairs = sorted({(int(parts[i][-1]), int(parts[i + 1][0])) for i in open_})
            joined = self._encode_rows([self.tokens[a] + self.tokens[b] for a, b in pairs])
            stands = {p for p, ids in zip(pairs, joined) if tuple(ids.tolist()) == p}
            moved: dict[int, np.ndarray] = {}
            for i in open_:
                if (int(parts[i][-1]), int(parts[i + 1][0])) in stands:
                    cuts[i] = 0
                elif i - 1 not in moved:  # else its left piece changes in this round
                    moved[i] = np.concatenate([parts[i][-cuts[i] :], parts[i + 1][: cuts[i]]])
            fresh = dict(zip(moved, self._encode_rows([self._bytes_of(ids) for ids in moved.values()])))
            new_parts, new_cuts, i = [], [], 0
            while i < len(parts):
                if i not in fresh:
                    new_parts.append(parts[i])
                    new_cuts.append(cuts[i])
                    i += 1
                    continue
                k = cuts[i]
                left, right, after = parts[i][:-k], parts[i + 1][k:], cuts[i + 1]
                if len(left):
                    new_parts.append(left)
                    new_cuts.append(2 * k)
                elif new_cuts and new_cuts[-1] >= 0:
                    new_cuts[-1] = max(new_cuts[-1], 2 * k)
                new_parts.append(fresh[i])
                if len(right):
                    new_cuts.append(2 * k)
                    new_parts.append(right)
                elif after >= 0:
                    after = max(after, 2 * k)
                new_cuts.append(after)
                i += 2
            parts, cuts = new_parts, new_cuts
        out, begin = [], 0
        for i, k in enumerate(cuts):
            if k < 0:
                out.append(np.concatenate(parts[begin : i + 1]))
                begin = i + 1
        return out

    def _encode_new(self, pretokens: list[str]) -> None:
        """Append the ids of pretokens that follow those in the cache."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pretokens]
        long = [k for k, r in enumerate(raw) if len(r) > PIECE]
        parts = self._encode_rows([r if len(r) <= PIECE else b"" for r in raw])
        for k, ids in zip(long, self._encode_long([raw[k] for k in long])):
            parts[k] = ids
        self.flat = np.concatenate([self.flat, *parts]).astype(np.int32)
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(counts)])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and len(texts) + 1 offsets into it."""
        if len(self.index) > CACHE_PRETOKENS:
            self._forget()
        index, known, find = self.index, len(self.index), self.pattern.findall
        pieces, new = [], []
        for text in texts:
            found = find(text) if text else []
            for p in set(found).difference(index):
                index[p] = known + len(new)
                new.append(p)
            pieces.append(np.fromiter(map(index.__getitem__, found), np.int64, len(found)))
        if new:
            self._encode_new(new)
        piece = np.concatenate([np.zeros(0, np.int64), *pieces])
        sizes = self.bounds[piece + 1] - self.bounds[piece]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.flat[np.arange(ends[-1]) + np.repeat(self.bounds[piece] - ends[:-1], sizes)] if len(piece) else np.zeros(0, np.int32)
        return ids, ends[np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)]


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, token_ids ARRAY<INT>) of every row; special tokens are ordinary text."""
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks.value, pattern)
        for batch in batches:
            for a, b, _, _ in bytetext.chunks(batch.column(1)):
                part = batch.slice(a, b - a)
                ids, offsets = encoder.encode(part.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], [id_col, "token_ids"])

    source = docs.select(id_col, text_col)
    schema = T.StructType([source.schema[id_col], T.StructField("token_ids", T.ArrayType(T.IntegerType()))])
    return map_batches(source, run, schema)


class Decoder:
    """Token ids to bytes, by one gather of the vocabulary's bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.start, self.data = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> pa.LargeBinaryArray:
        """One value for each run ids[ends[k]:ends[k + 1]]."""
        text = bytetext.spans_to_binary(self.data, self.start[ids], self.start[ids] + self.size[ids])
        bounds = np.frombuffer(text.buffers()[1], np.int64)[ends]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds)), text.buffers()[2]])


def decode(encoded: DataFrame, vocabulary: str, ids_col: str = "token_ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` and `decoded` BINARY, the bytes that the ids of `ids_col` stand for."""
    ranks = encoded.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))
    source = encoded.select(*keep, F.col(ids_col).alias("__ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(ranks.value)
        for batch in batches:
            column = batch.column(len(keep)).fill_null([])
            rows = 0
            while rows < len(column):
                part = column.slice(rows, 256)
                ids, lengths = part.flatten().to_numpy(zero_copy_only=False), np.asarray(part.value_lengths())
                whole = decoder.decode(ids, np.concatenate([[0], np.cumsum(lengths)]))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(rows, len(part)) for k in range(len(keep))), whole.cast(pa.binary())], [*keep, "decoded"])
                rows += len(part)

    schema = T.StructType([*(source.schema[k] for k in keep), T.StructField("decoded", T.BinaryType())])
    return map_batches(source, run, schema)


def digest(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Per row of documents: n_tokens, SHA-256 of the decimal ids joined by a space, SHA-256 of the decoded bytes.

    Encoding and decoding are one map, so that the ids needn't leave the task.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))
    source = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(ranks.value, pattern), Decoder(ranks.value)
        written = np.array([b"%d" % k for k in range(len(decoder.size))], object)
        for batch in batches:
            for a, b, _, _ in bytetext.chunks(batch.column(1)):
                part = batch.slice(a, b - a)
                ids, ends = encoder.encode(part.column(1).to_pylist())
                decimal = written[ids]
                digests = [hashlib.sha256(b" ".join(decimal[i:j])).hexdigest() for i, j in zip(ends[:-1], ends[1:])]
                texts = [hashlib.sha256(t.as_buffer()).hexdigest() for t in decoder.decode(ids, ends)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(ends), pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())], names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    schema = T.StructType([source.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return map_batches(source, run, schema)
