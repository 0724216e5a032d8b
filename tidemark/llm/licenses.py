"""License scans by an exact set-similarity join (operator 6).

Base: the places where the words of a license phrase stand consecutively (words of lower-cased
texts, [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+).  The method finds every text block whose distinct words
contain at least `threshold` of a template's distinct words.  A block is a \\n-split line or, with
`spanning`, a paragraph between blank lines or a run of 2 * n consecutive places of known words (those
of any phrase or template) for a template of n words; a text's runs start at every n-th such place, so
that each n + 1 consecutive ones lie in one run, whatever lines they are on.  Template words are
ordered by their frequency in all blocks of the corpus, rarest first.  A block that meets the
threshold needs k = ceil(threshold * |T|) words of T, so it has one of T's first |T| - k + 1 words
(prefix filter), at least k distinct words (length filter), and, if the first of T's words that it
has stands at place i of T, no more than |T| - i of them (positional filter).  What passes is
compared in full, so that the join is exact: `candidates` holds every block and template that meet the
threshold, with the containment and the block's first and last known word.

Notices of related licenses share most words, so that a block of one may meet the threshold of another's
template.  Templates (and phrases, whose places contain them whole) are related if they share `RELATED_WORDS`
words and half of the shorter one's.  A candidate gives its label unless a candidate of a related template with
another label overlaps it and has a higher containment; it stays a candidate all the same.

The templates and phrases are a small fixed table (`MAX_TEMPLATE_WORDS` is checked); each pass over
the documents is a map, and only counts of template words are aggregated between the two.

Defined results: a null or wordless text has no places, null first_word and last_word, empty labels
and score 0.  score is 1 for a text with a base place, else the largest containment of a template
in one of its blocks, whatever its label.  Equal containments give all their labels.  Each input row gives one row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import bytetext
from tidemark.llm.scratch import map_batches

#: Phrases of the base scan and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Templates of the containment scan, as a label and the text of a license's notice or of a part of its body.
TEMPLATES = [
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "licensed under the gnu gpl version 3 or later"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("apache", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("ecl", "licensed under the educational community license version 2 0 you may not use this file except in compliance with the license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("lgpl", "licensed under the gnu lgpl version 3 or later"),
]
THRESHOLD = 0.8
RELATED_WORDS = 3
MAX_TEMPLATE_WORDS = 100_000
_GATE_BITS = 16


class _Vocabulary:
    """Numbers for the words of phrases and templates, found by hash."""

    def __init__(self, texts: list[str]):
        data, offsets = bytetext.string_buffers(pa.array(texts, pa.string()))
        words = bytetext.Words(data, offsets, bytetext.NAMES, lower=True)
        if len(words) > MAX_TEMPLATE_WORDS:
            raise ValueError("the templates are larger than MAX_TEMPLATE_WORDS")
        word = words.hashes()
        self.known = np.unique(word)
        self.sequences = [np.searchsorted(self.known, word[a:b]) for a, b in zip(words.first[:-1], words.first[1:])]
        self.gate = np.zeros(1 << _GATE_BITS, bool)
        self.gate[self.known >> np.uint64(64 - _GATE_BITS)] = True

    def find(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of known words, and their numbers."""
        at = np.flatnonzero(self.gate[word >> np.uint64(64 - _GATE_BITS)])
        number = np.minimum(np.searchsorted(self.known, word[at]), len(self.known) - 1)
        same = self.known[number] == word[at]
        return at[same], number[same]


def _line_blocks(words: bytetext.Words, at: np.ndarray, spanning: bool = False) -> np.ndarray:
    """The block of each place in `at`: a line or paragraph of one text."""
    breaks = np.flatnonzero(words.data == 10)
    if spanning:  # only those that end a blank line
        before = np.concatenate([[0], np.cumsum(bytetext.SPACED[words.data])])[breaks]
        breaks = breaks[1:][before[1:] == before[:-1]]
    return np.searchsorted(breaks, words.starts[at]) * np.int64(len(words.counts)) + np.searchsorted(words.first, at, "right") - 1


def _run_blocks(words: bytetext.Words, at: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes into `at`, and the blocks that these places are in: runs of 2 * step of a text's known words, so most places are in two."""
    text = np.searchsorted(words.first, at, "right") - 1
    run = (np.arange(len(at)) - np.searchsorted(text, text)) // step
    later = np.flatnonzero(run > 0)  # the second half of the run before
    index = np.concatenate([np.arange(len(at)), later])
    return index, np.concatenate([run, run[later] - 1]) * np.int64(len(words.counts)) + text[index]


class _Blocks:
    """Blocks in order, with their distinct known words and the first and last place of one."""

    def __init__(self, block: np.ndarray, at: np.ndarray, number: np.ndarray):
        self.rows = np.unique(np.stack([block, number], 1), axis=0)
        self.cut = np.concatenate([[0], np.flatnonzero(np.diff(self.rows[:, 0])) + 1]) if len(block) else np.zeros(0, np.int64)
        self.sizes = np.diff(np.append(self.cut, len(self.rows)))
        ids = self.rows[self.cut, 0]
        self.low, self.high = np.full(len(ids), 1 << 60), np.full(len(ids), -1)
        place = np.searchsorted(ids, block)
        np.minimum.at(self.low, place, at)
        np.maximum.at(self.high, place, at)


def template_word_counts(docs: DataFrame, vocabulary: _Vocabulary, text_col: str, spanning: bool = False) -> np.ndarray:
    """In how many blocks of the corpus each vocabulary word occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary.known), np.int64)
        for batch in batches:
            for _, _, data, offsets in bytetext.chunks(batch.column(0)):
                words = bytetext.Words(data, offsets, bytetext.NAMES, lower=True)
                at, number = vocabulary.find(words.hashes())
                rows = np.unique(np.stack([_line_blocks(words, at, spanning), number], 1), axis=0)
                total += np.bincount(rows[:, 1], minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["word", "n"])

    counts = map_batches(docs.select(text_col), run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n"))
    out = np.zeros(len(vocabulary.known), np.int64)
    for row in counts.collect():  # at most one row a vocabulary word
        out[row.word] = row.n
    return out


class _Scan:
    def __init__(self, phrases: dict[str, str], templates: list[tuple[str, str]], threshold: float, spanning: bool = False):
        self.vocabulary = _Vocabulary([*phrases, *(t for _, t in templates)])
        self.phrases = list(zip(phrases.values(), self.vocabulary.sequences))
        sequences = self.vocabulary.sequences[len(phrases) :]
        self.templates = [(label, np.unique(s)) for (label, _), s in zip(templates, sequences)]
        self.lengths = [len(s) for s in sequences]
        self.threshold, self.spanning = threshold, spanning
        # templates come first, then phrases
        sets = [set(s.tolist()) for s in (*sequences, *self.vocabulary.sequences[: len(phrases)])]
        self.labels = [label for label, _ in templates] + list(phrases.values())
        near = lambda a, b: len(a & b) >= RELATED_WORDS and 2 * len(a & b) >= min(len(a), len(b))
        self.related = [[self.labels[i] != self.labels[k] and near(a, b) for k, b in enumerate(sets)] for i, a in enumerate(sets)]

    def order(self, counts: np.ndarray) -> None:
        """Fix the global order of words: by frequency, rarest first, ties by hash."""
        place = np.empty(len(counts), np.int64)
        place[np.lexsort((self.vocabulary.known, counts))] = np.arange(len(counts))
        self.templates = [(label, t[np.argsort(place[t])]) for label, t in self.templates]

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, dict[int, dict]]:
        """Word counts, and for texts with a place or a block above the threshold: starts, labels, spans and score."""
        words = bytetext.Words(data, offsets, bytetext.NAMES, lower=True)
        at, number = self.vocabulary.find(words.hashes())
        found: dict[int, dict] = {}
        if not len(at):
            return words.counts, found
        token = np.full(len(words), -1)
        token[at] = number
        left = words.left()

        def of(text: int) -> dict:
            return found.setdefault(text, {"starts": [], "base": set(), "labels": set(), "score": 0.0, "places": [], "candidates": []})

        for kind, (label, sequence) in enumerate(self.phrases, len(self.templates)):
            start = at[number == sequence[0]]
            start = start[left[start] >= len(sequence)]
            for k, want in enumerate(sequence):
                start = start[token[start + k] == want]
            for s, d in zip(start.tolist(), (np.searchsorted(words.first, start, "right") - 1).tolist()):
                row = of(d)
                row["starts"].append(s - int(words.first[d]))
                row["base"].add(label)
                row["score"] = 1.0
                row["places"].append((s, s + len(sequence) - 1, kind, 1.0))
        blocks = _Blocks(_line_blocks(words, at, self.spanning), at, number)
        text = np.searchsorted(words.first, at, "right") - 1
        for kind, ((_, template), length) in enumerate(zip(self.templates, self.lengths)):
            need = int(np.ceil(self.threshold * len(template) - 1e-9))
            self._join(blocks, kind, need, len(words.counts), of)
            if self.spanning:
                prefix = np.zeros(len(words.counts), bool)
                prefix[text[np.isin(number, template[: len(template) - need + 1])]] = True
                own = np.flatnonzero(prefix[text])  # runs of other texts would not pass the prefix filter
                index, block = _run_blocks(words, at[own], length)
                self._join(_Blocks(block, at[own][index], number[own][index]), kind, need, len(words.counts), of)
        for d, row in found.items():
            row["labels"] = {self.labels[k] for _, _, k, _ in self._undisputed(row["candidates"], row["places"])}
            first = int(words.first[d])
            row["candidates"] = sorted({(self.labels[k], n, low - first, high - first) for low, high, k, n in row["candidates"]})
        return words.counts, found

    def _join(self, blocks: _Blocks, kind: int, need: int, n_texts: int, of: Callable[[int], dict]) -> None:
        """Add every block that has `need` words of the template to its text's candidates."""
        if not len(blocks.rows):
            return
        template = self.templates[kind][1]
        has = np.zeros(len(self.vocabulary.known), bool)
        has[template[: len(template) - need + 1]] = True
        candidate = np.flatnonzero((np.add.reduceat(has[blocks.rows[:, 1]].astype(np.int64), blocks.cut) > 0) & (blocks.sizes >= need))
        for c in candidate.tolist():
            begin = int(blocks.cut[c])
            own = np.isin(template, blocks.rows[begin : begin + int(blocks.sizes[c]), 1])
            if len(template) - int(own.argmax()) < need or (n := int(own.sum())) < need:
                continue
            row = of(int(blocks.rows[begin, 0] % n_texts))
            row["candidates"].append((int(blocks.low[c]), int(blocks.high[c]), kind, n / len(template)))
            row["score"] = max(row["score"], n / len(template))

    def _undisputed(self, candidates: list[tuple[int, int, int, float]], places: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
        """The candidates that no overlapping one of a related template beats: a sweep over their first places."""
        beaten: set[int] = set()
        rows = sorted({*candidates, *places})
        live: list[int] = []
        for k, (low, _, kind, share) in enumerate(rows):
            live = [j for j in live if rows[j][1] >= low]
            for j in live:
                if rows[j][3] != share and self.related[kind][rows[j][2]]:
                    beaten.add(k if share < rows[j][3] else j)
            live.append(k)
        return [r for k, r in enumerate(rows) if k not in beaten and r[2] < len(self.templates)]


def scan(
    docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", spanning: bool = False
) -> DataFrame:
    """(id, n_words, starts ARRAY<LONG>, base_labels, labels ARRAY<STRING>, score, candidates) of every document; blocks span lines if `spanning`.

    candidates are structs of label, containment, first_word and last_word.
    """
    scanner = _Scan(phrases, templates, threshold, spanning)
    scanner.order(template_word_counts(docs, scanner.vocabulary, text_col, spanning))
    source = docs.select(id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in bytetext.chunks(batch.column(1)):
                counts, found = scanner.texts(data, offsets)
                rows = [found.get(d) for d in range(b - a)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(counts, pa.int64()),
                        pa.array([sorted(r["starts"]) if r else [] for r in rows], pa.list_(pa.int64())),
                        pa.array([sorted(r["base"]) if r else [] for r in rows], pa.list_(pa.string())),
                        pa.array([sorted(r["base"] | r["labels"]) if r else [] for r in rows], pa.list_(pa.string())),
                        pa.array([r["score"] if r else 0.0 for r in rows], pa.float64()),
                        pa.array([[dict(zip(fields.names, c)) for c in r["candidates"]] if r else [] for r in rows], pa.list_(arrow)),
                    ],
                    schema.names,
                )

    strings, longs = T.ArrayType(T.StringType()), T.ArrayType(T.LongType())
    fields = T.StructType.fromDDL("label string, containment double, first_word long, last_word long")
    arrow = pa.struct([("label", pa.string()), ("containment", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64())])
    schema = T.StructType(
        [source.schema[id_col], *(T.StructField(*f) for f in (("n_words", T.LongType()), ("starts", longs), ("base_labels", strings), ("labels", strings), ("score", T.DoubleType()), ("candidates", T.ArrayType(fields))))]
    )
    return map_batches(source, run, schema)


def report(docs: DataFrame, spanning: bool = False) -> DataFrame:
    """Per row of documents: n_words, n_base, first_word, last_word, base_labels, labels, score, and how many candidates there are."""
    return scan(docs, spanning=spanning).select(
        "doc_id",
        "n_words",
        F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").alias("first_word"),
        F.array_max("starts").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
        F.size("candidates").cast("long").alias("n_candidates"),
    )
