"""SentencePiece encoding and decoding with source spans (operator 13).

A model file gives scored pieces and a compiled character map.  Texts are normalised chunk by chunk, as
bytes: at every place the longest prefix that the map knows is replaced (a vectorised walk of the map's
double array; where there is none, the character stays), spaces become the mark U+2581, and each normalised
byte keeps the place of the source that it came from.  A word is a run of marks and what follows up to the
next mark; no piece of a supported model reaches over a word's end, so words are encoded once each.  Within
a word the adjacent pair whose union has the best score is merged first, the leftmost of equal ones: words
of up to `ROW_CHARS` characters as rows of padded matrices, longer ones with a heap, in n log n steps.
Characters without a piece become their bytes' pieces.  Lengths of pieces, summed up, index the source
places, which gives each id its span of original bytes.  A task keeps the ids of at most `CACHE_WORDS` words.

Supported are BPE models with byte fallback that keep white space as a prefix and define no symbols of their
own; others are refused, as is a model file of more than `MAX_MODEL_BYTES`, since it is broadcast.

Defined results: a null text is an empty one, which has the end id only; a null list of ids decodes as an
empty text.  Each input row gives one row; repeated rows give repeated rows.  Only the columns named are
read, so further columns cannot clash.  An empty table gives an empty table.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import bytetext
from tidemark.llm.bpe import NONE, PairTable
from tidemark.llm.scratch import map_batches

#: Characters of a matrix row at most; cells of a matrix; words whose ids a task keeps.
ROW_CHARS = 32
MATRIX_CELLS = 1 << 16
CACHE_WORDS = 200_000
#: Bytes of text that are encoded together.
CHUNK_BYTES = 1 << 20
MAX_MODEL_BYTES = 64 << 20
#: The mark for a space, and the file format's kinds of pieces.
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
_MARK = MARK.encode()
_LAST = np.int64(1) << 60
codecs.register_error("each-byte", lambda error: ("\ufffd", error.start + 1))


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a serialised message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(raw):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}[key & 7] if key & 7 != 2 else number()
        yield key >> 3, raw[at : at + size]
        at += size


class CharacterMap:
    """The longest rule that starts at each place of a text, by a double-array trie over bytes."""

    def __init__(self, blob: bytes):
        size = struct.unpack("<I", blob[:4])[0] if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").astype(np.int64)
        self.pool = np.frombuffer(blob[4 + size :], np.uint8)
        stops = np.flatnonzero(self.pool == 0)
        self.stop = stops[np.searchsorted(stops, np.arange(len(self.pool)))] if len(stops) else stops

    @staticmethod
    def _offset(unit: np.ndarray) -> np.ndarray:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, data: np.ndarray, ends: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that the longest rule at each of `places` takes (0 if none), and the start of what it gives in the pool."""
        length, value = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
        if not len(self.units):
            return length, value
        live = np.arange(len(places))
        node = np.full(len(places), self._offset(self.units[:1])[0])
        step = 0
        while len(live := live[places[live] + step < ends[live]]):
            byte = data[places[live] + step].astype(np.int64)
            node[live] ^= byte
            inside = node[live] < len(self.units)
            live, byte = live[inside], byte[inside]
            unit = self.units[node[live]]
            match = unit & 0x800000FF == byte
            live, unit = live[match], unit[match]
            node[live] ^= self._offset(unit)
            step += 1
            leaf = live[unit >> 8 & 1 == 1]
            length[leaf], value[leaf] = step, self.units[node[leaf]] & 0x7FFFFFFF
        return length, value


class Model:
    """What a model file says."""

    def __init__(self, raw: bytes):
        self.texts: list[str] = []
        scores, kinds, trainer, normaliser = [], [], {}, {}
        for number, value in _fields(raw):
            if number == 1:
                piece = dict(_fields(value))
                self.texts.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
                kinds.append(piece.get(3, NORMAL))
            elif number in (2, 3):
                (trainer if number == 2 else normaliser).update(_fields(value))
        self.scores, self.kinds = np.array(scores), np.array(kinds)
        if trainer.get(3, 1) != 2 or not trainer.get(35, 0) or trainer.get(24, 0) or not set(kinds) <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only BPE models with byte fallback, white space as a prefix and no symbols of their own are supported")
        if not normaliser.get(5, 1) or any(MARK in t.lstrip(MARK) for t, k in zip(self.texts, kinds) if k == NORMAL):
            raise ValueError("only models that mark spaces and whose pieces stay inside words are supported")
        self.prefix, self.trim = bool(normaliser.get(3, 1)), bool(normaliser.get(4, 1))
        self.map = CharacterMap(normaliser.get(2, b""))
        self.end_id = self.texts.index(trainer.get(47, b"</s>").decode())
        self.unknown_text = trainer.get(44, " ⁇ ".encode()).decode()
        self.byte_ids = np.zeros(256, np.int64)
        for k in np.flatnonzero(self.kinds == BYTE):
            self.byte_ids[int(self.texts[k][3:-1], 16)] = k


def load_model(path: str) -> bytes:
    with open(path, "rb") as file:
        raw = file.read(MAX_MODEL_BYTES + 1)
    if len(raw) > MAX_MODEL_BYTES:
        raise ValueError("the model is larger than MAX_MODEL_BYTES")
    return raw


class Normaliser:
    """Texts to normalised bytes, with the source place of each."""

    def __init__(self, model: Model):
        self.model = model

    def _units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start, start in `data` + pool, and size of each character or rule's result in order; and the bytes they index."""
        starts = np.flatnonzero(data & 0xC0 != 0x80)
        ends = offsets[np.searchsorted(offsets, starts, "right")]
        take = np.diff(starts, append=len(data))
        length, value = self.model.map.longest(data, ends, starts)
        hit = np.flatnonzero(length)
        source, size = starts.copy(), take.copy()
        source[hit], size[hit] = len(data) + value[hit], self.model.map.stop[value[hit]] - value[hit]
        wide = hit[length[hit] > take[hit]]
        if len(wide):  # a rule over several characters covers those after its first, unless it is covered itself
            keep, free = np.ones(len(starts), bool), 0
            for k, a, b in zip(wide.tolist(), starts[wide].tolist(), (starts[wide] + length[wide]).tolist()):
                if a >= free:
                    last = int(np.searchsorted(starts, b))
                    keep[k + 1 : last] = False
                    free = b
            starts, source, size = starts[keep], source[keep], size[keep]
        return starts, source, size, np.concatenate([data, self.model.map.pool])

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Normalised bytes of all texts, len(texts) + 1 offsets into them, and source places: one a byte and one more a text."""
        starts, source, size, pool = self._units(data, offsets)
        ends = np.cumsum(size)
        raw = pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(source - ends + size, size)]
        place = np.repeat(starts, size)
        text = np.searchsorted(offsets, place, "right") - 1
        space = raw == 0x20
        last = offsets[1:].copy()
        if self.model.trim:  # drops spaces at either end, and those after another one
            at = np.flatnonzero(~space)
            first, final = np.full(len(offsets) - 1, len(raw)), np.full(len(offsets) - 1, -1)
            np.minimum.at(first, text[at], at)
            np.maximum.at(final, text[at], at)
            before = np.zeros(len(raw), bool)
            before[1:] = space[:-1]
            each = np.arange(len(raw))
            keep = ~(space & before) & (each >= first[text]) & (each <= final[text])
            gone = np.flatnonzero(space & (each > final[text]))
            np.minimum.at(last, text[gone], place[gone])
            raw, place, text, space = raw[keep], place[keep], text[keep], space[keep]
        count = np.bincount(text, minlength=len(offsets) - 1)
        lead = np.cumsum(count) - count
        if self.model.prefix:
            filled = np.flatnonzero(count)
            raw, space = np.insert(raw, lead[filled], 0x20), np.insert(space, lead[filled], True)
            place, text = np.insert(place, lead[filled], place[lead[filled]]), np.insert(text, lead[filled], filled)
        wide = np.where(space, 3, 1)
        out = np.repeat(raw, wide)
        at = (np.cumsum(wide) - wide)[space]
        for k, byte in enumerate(_MARK):
            out[at + k] = byte
        sizes = np.bincount(text, weights=wide, minlength=len(offsets) - 1).astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        # a text's places count from its own start, and end with the place of its end
        places = np.insert(np.repeat(place - offsets[text], wide), bounds[1:], last - offsets[:-1])
        return out, bounds, places


class Encoder:
    """Texts to ids and their spans; holds the model's tables and a bounded cache of words."""

    def __init__(self, model: Model):
        self.model, self.normalise = model, Normaliser(model)
        normal = np.flatnonzero(model.kinds == NORMAL)
        order = normal[np.argsort(-model.scores[normal], kind="stable")]
        texts = [model.texts[k] for k in order.tolist()]
        known = set(texts)
        texts += sorted({c for t in texts for c in t} - known)  # characters that pieces contain but that aren't pieces
        self.symbol = {t: k for k, t in enumerate(texts)}
        self.piece = np.concatenate([order, np.full(len(texts) - len(order), -1)])
        self.others = len(texts)  # the symbol of any other character is this plus its code point
        self.of_character = self.others + np.arange(0x110000)
        for text, k in self.symbol.items():
            if len(text) == 1:
                self.of_character[ord(text)] = k
        _, rank = np.unique(-model.scores[order], return_inverse=True)
        self.priority = np.concatenate([rank, np.full(len(texts) - len(order), _LAST)])
        self.table = PairTable({t.encode(): k for t, k in self.symbol.items()})
        self.sizes = np.array([len(t.encode()) for t in texts], np.int64)
        self._forget()

    def _forget(self) -> None:
        self.index: dict[bytes, int] = {}
        self.flat, self.covers, self.bounds = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)

    def _symbols(self, text: str) -> np.ndarray:
        return self.of_character[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]

    def _unions(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol of each pair's union (NONE if it has none) and its priority."""
        union = self.table.ranks(left, right)
        return union, np.where(union < NONE, self.priority[np.where(union < NONE, union, 0)], _LAST)

    def _merge_rows(self, rows: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every row of a padded matrix of symbols, merged to its end; and the rows' lengths."""
        n, width = rows.shape
        union, first = np.full((n, width), NONE), np.full((n, width), _LAST)
        at, col = np.nonzero(np.arange(width - 1)[None, :] < (length - 1)[:, None])
        union[at, col], first[at, col] = self._unions(rows[at, col], rows[at, col + 1])
        live, columns, done, sizes = np.arange(n), np.arange(width)[None, :], rows.copy(), length.copy()
        while len(live):
            where = first.argmin(axis=1)
            going = first[np.arange(len(live)), where] < _LAST
            if not going.all():
                stop = ~going
                done[live[stop]], sizes[live[stop]] = rows[stop], length[stop]
                rows, union, first, live, where, length = rows[going], union[going], first[going], live[going], where[going], length[going]
                if not len(live):
                    break
            each = np.arange(len(live))
            merged = union[each, where]
            source = np.minimum(columns + (columns > where[:, None]), width - 1)
            rows, union, first = rows[each[:, None], source], union[each[:, None], source], first[each[:, None], source]
            union[:, -1], first[:, -1] = NONE, _LAST
            rows[each, where], length = merged, length - 1
            union[each, where], first[each, where] = NONE, _LAST
            after, before = np.flatnonzero(where < length - 1), np.flatnonzero(where > 0)
            row, at = np.concatenate([after, before]), np.concatenate([where[after], where[before] - 1])
            union[row, at], first[row, at] = self._unions(rows[row, at], rows[row, at + 1])
        return done, sizes

    def _merge_long(self, word: str) -> np.ndarray:
        """A word's symbols, merged from a heap of pairs."""
        symbols = self._symbols(word)
        union, first = (x.tolist() for x in self._unions(symbols[:-1], symbols[1:]))
        row, last = symbols.tolist(), len(symbols)
        after, before, alive = list(range(1, last + 1)), list(range(-1, last - 1)), [True] * last
        heap = [(p, k, u, row[k], row[k + 1]) for k, (p, u) in enumerate(zip(first, union)) if p < _LAST]
        heapq.heapify(heap)
        known: dict[tuple[int, int], tuple[int, int]] = {}
        while heap:
            _, k, merged, left, right = heapq.heappop(heap)
            if not alive[k] or row[k] != left or (r := after[k]) >= last or row[r] != right:
                continue
            row[k], alive[r], after[k] = merged, False, after[r]
            if after[k] < last:
                before[after[k]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b < last:
                    pair = (row[a], row[b])
                    if pair not in known:
                        u, p = self._unions(np.array(pair[:1]), np.array(pair[1:]))
                        known[pair] = int(u[0]), int(p[0])
                    u, p = known[pair]
                    if p < _LAST:
                        heapq.heappush(heap, (p, a, u, *pair))
        return np.array([s for s, live in zip(row, alive) if live], np.int64)

    def _add(self, words: list[bytes]) -> None:
        """Put words into the cache, by length: those of a matrix have nearly the same one."""
        texts = [w.decode("utf-8", "surrogatepass") for w in words]
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(size, kind="stable")
        size, known = size[order], len(self.index)
        self.index.update(zip([words[k] for k in order.tolist()], range(known, known + len(words))))
        symbols = self._symbols("".join([texts[k] for k in order.tolist()]))
        start, short = np.cumsum(size) - size, int(np.searchsorted(size, ROW_CHARS, "right"))
        parts, counts, begin = [], [], 0
        while begin < short:
            most = min(ROW_CHARS, int(size[begin]) + 3)
            end = min(begin + MATRIX_CELLS // most, int(np.searchsorted(size, most, "right")))
            width = int(size[end - 1])
            place = start[begin:end, None] + np.arange(width)[None, :]
            rows, length = self._merge_rows(symbols[np.minimum(place, len(symbols) - 1)], size[begin:end])
            parts.append(rows[np.arange(width)[None, :] < length[:, None]])
            counts.append(length)
            begin = end
        for k in order[short:].tolist():
            parts.append(self._merge_long(texts[k]))
            counts.append(np.array([len(parts[-1])]))
        counts, symbols = np.concatenate(counts), np.concatenate(parts)
        ids = np.where(symbols < self.others, self.piece[np.minimum(symbols, self.others - 1)], -1)
        covers = np.where(symbols < self.others, self.sizes[np.minimum(symbols, self.others - 1)], 0)
        each = np.ones(len(symbols), np.int64)
        lost = np.flatnonzero(ids < 0)  # no piece: one id for each byte, the last of which covers them all
        if len(lost):
            bare = {k: t for t, k in self.symbol.items() if self.piece[k] < 0}
            raw = [(bare[s] if s < self.others else chr(s - self.others)).encode("utf-8", "surrogatepass") for s in symbols[lost].tolist()]
            each[lost] = [len(r) for r in raw]
            ends = np.cumsum(each)
            ids, covers = np.repeat(ids, each), np.repeat(covers, each)
            for k, r in zip(lost.tolist(), raw):
                ids[ends[k] - len(r) : ends[k]] = self.model.byte_ids[list(r)]
                covers[ends[k] - 1] = len(r)
        totals = np.add.reduceat(each, np.cumsum(counts) - counts)
        self.flat, self.covers = np.concatenate([self.flat, ids]), np.concatenate([self.covers, covers])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(totals)])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids, first and end byte of each one's source, of all texts, each with the end id; and len(texts) + 1 offsets into them."""
        if len(self.index) > CACHE_WORDS:
            self._forget()
        out, bounds, places = self.normalise(data, offsets)
        mark = np.zeros(len(out) + 3, bool)
        mark[: max(len(out) - 2, 0)] = (out[:-2] == _MARK[0]) & (out[1:-1] == _MARK[1]) & (out[2:] == _MARK[2])
        opens = mark[: len(out)].copy()
        opens[3:] &= ~mark[: max(len(out) - 3, 0)]
        opens[bounds[:-1][bounds[:-1] < len(out)]] = True
        begins = np.flatnonzero(opens)
        raw, stops = out.tobytes(), np.append(begins[1:], len(out))
        words = [raw[a:b] for a, b in zip(begins.tolist(), stops.tolist())]
        new = list(set(words).difference(self.index))
        if new:
            self._add(new)
        word = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        sizes = self.bounds[word + 1] - self.bounds[word]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        source = np.arange(ends[-1]) + np.repeat(self.bounds[word] - ends[:-1], sizes)
        ids, covers = self.flat[source], self.covers[source]
        # the end id after each text covers nothing
        tokens = ends[np.searchsorted(begins, bounds)]
        ids, covers = np.insert(ids, tokens[1:], self.model.end_id), np.insert(covers, tokens[1:], 0)
        tokens = tokens + np.arange(len(tokens))
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(tokens))
        stop = np.cumsum(covers)
        return ids, places[stop - covers + text], places[stop + text], tokens


class Decoder:
    """Ids to texts, by one gather of the pieces' bytes."""

    def __init__(self, model: Model):
        self.model = model
        texts = [t.replace(MARK, " ").encode() for t in model.texts]
        for k in np.flatnonzero(model.kinds != NORMAL).tolist():
            texts[k] = b"" if model.kinds[k] == CONTROL else model.unknown_text.encode() if model.kinds[k] == UNKNOWN else bytes([int(model.texts[k][3:-1], 16)])
        self.size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.start, self.data = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(texts), np.uint8)
        self.marked = np.array([t.startswith(MARK) for t in model.texts]) & (model.kinds == NORMAL)
        self.spaces = np.array([bool(t) and not t.strip(MARK) for t in model.texts]) & (model.kinds == NORMAL)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """One text for each run ids[ends[k]:ends[k + 1]]."""
        start, size = self.start[ids].copy(), self.size[ids].copy()
        if self.model.prefix or self.model.trim:
            shown = np.flatnonzero(self.model.kinds[ids] != CONTROL)
            at = np.searchsorted(shown, ends)
            head = shown[at[:-1][at[:-1] < at[1:]]]
            if self.model.trim:  # what begins with spaces loses one a piece, until a piece leaves text
                stop = ends[np.searchsorted(ends, head, "right")]
                while len(head):
                    head, stop = head[self.marked[ids[head]]], stop[self.marked[ids[head]]]
                    start[head] += 1
                    size[head] -= 1
                    empty = size[head] == 0
                    following = np.searchsorted(shown, head[empty], "right")
                    ok = following < len(shown)
                    head, stop = shown[following[ok]], stop[empty][ok]
                    head, stop = head[head < stop], stop[head < stop]
            else:
                head = head[self.marked[ids[head]]]
                start[head] += 1
                size[head] -= 1
        whole = bytetext.spans_to_binary(self.data, start, start + size)
        bounds, raw = np.frombuffer(whole.buffers()[1], np.int64)[ends], whole.buffers()[2].to_pybytes()
        texts = [raw[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        byte = self.model.kinds[ids] == BYTE
        if byte.any():  # in a run of byte ids, bytes that are no character each give a replacement mark
            edge = np.flatnonzero(byte[1:] != byte[:-1]) + 1
            places = np.frombuffer(whole.buffers()[1], np.int64)
            for k in np.unique(np.searchsorted(ends, np.flatnonzero(byte), "right") - 1).tolist():
                inside = edge[np.searchsorted(edge, ends[k], "right") : np.searchsorted(edge, ends[k + 1])]
                cuts = places[np.concatenate([[ends[k]], inside, [ends[k + 1]]])].tolist()
                texts[k] = "".join(raw[i:j].decode("utf-8", "each-byte") for i, j in zip(cuts[:-1], cuts[1:])).encode()
        return texts


def _lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, token_ids, begins, ends): every row's ids with the end id, and each id's span of the text's UTF-8 bytes."""
    raw = docs.sparkSession.sparkContext.broadcast(load_model(model))
    names = [id_col, "token_ids", "begins", "ends"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Model(raw.value))
        for batch in batches:
            for a, b, data, offsets in bytetext.chunks(batch.column(1), CHUNK_BYTES):
                ids, begins, ends, rows = encoder.encode(data, offsets)
                lists = [_lists(ids, rows, pa.int32()), _lists(begins, rows, pa.int64()), _lists(ends, rows, pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *lists], names)

    source = docs.select(id_col, text_col)
    spans = [T.StructField(n, T.ArrayType(T.LongType())) for n in names[2:]]
    schema = T.StructType([source.schema[id_col], T.StructField("token_ids", T.ArrayType(T.IntegerType())), *spans])
    return map_batches(source, run, schema)


def decode(encoded: DataFrame, model: str, ids_col: str = "token_ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` and `decoded` STRING, the text of the ids in `ids_col`."""
    raw = encoded.sparkSession.sparkContext.broadcast(load_model(model))
    source = encoded.select(*keep, F.col(ids_col).alias("__ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(Model(raw.value))
        for batch in batches:
            column = batch.column(len(keep)).fill_null([])
            for row in range(0, len(column), 256):
                part = column.slice(row, 256)
                ids, lengths = part.flatten().to_numpy(zero_copy_only=False), np.asarray(part.value_lengths())
                texts = decoder.decode(ids.astype(np.int64), np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(row, len(part)) for k in range(len(keep))), pa.array([t.decode() for t in texts], pa.string())], [*keep, "decoded"])

    schema = T.StructType([*(source.schema[k] for k in keep), T.StructField("decoded", T.StringType())])
    return map_batches(source, run, schema)


def digest(docs: DataFrame, model: str) -> DataFrame:
    """Per row of documents: n_tokens, SHA-256 of the decimal ids joined by a space, of the decoded text, and of the spans.

    spans_sha256 is of every id's first and end source byte as little-endian 64-bit integers, all firsts before all ends.
    Encoding and decoding are one map, so that the ids needn't leave the task.
    """
    raw = docs.sparkSession.sparkContext.broadcast(load_model(model))
    source = docs.select("doc_id", "text")
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(raw.value)
        encoder, decoder = Encoder(model), Decoder(model)
        written = np.array([b"%d" % k for k in range(len(model.texts))], object)
        for batch in batches:
            for a, b, data, offsets in bytetext.chunks(batch.column(1), CHUNK_BYTES):
                ids, begins, ends, rows = encoder.encode(data, offsets)
                decimal, runs = written[ids], list(zip(rows[:-1].tolist(), rows[1:].tolist()))
                columns = [
                    [hashlib.sha256(b" ".join(decimal[i:j])).hexdigest() for i, j in runs],
                    [hashlib.sha256(t).hexdigest() for t in decoder.decode(ids, rows)],
                    [hashlib.sha256(begins[i:j].astype("<i8").tobytes() + ends[i:j].astype("<i8").tobytes()).hexdigest() for i, j in runs],
                ]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(rows), pa.int64()), *(pa.array(c, pa.string()) for c in columns)], names)

    schema = T.StructType([source.schema["doc_id"], T.StructField("n_tokens", T.LongType()), *(T.StructField(n, T.StringType()) for n in names[2:])])
    return map_batches(source, run, schema)
