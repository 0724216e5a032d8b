"""Quality rules as a bitmask ledger (operator 4).

Every rule is evaluated once a document; the ledger keeps the measurements and one failure bit a
rule.  Policies are versioned sets of rules applied to the bits afterwards, and ablations (what a
policy would reject without one of its rules) are bitwise aggregates over the ledger, so neither
reads a text again.

Measurements of whole texts, by words [^\\x20\\x09-\\x0D]+ : n_words; word_chars, code points in words;
n_upper, bytes A-Z; n_symbols, characters of [#*$%&|<>]; n_lines, \\n-split lines with a word;
n_dup_lines, those equal to an earlier one; n_repeat_words, words in a 5-word window that the text
has twice or more.

Defined results: a null or empty text, or one without words, measures 0 everywhere and fails
`few_words` alone.  Each input row gives one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import bytetext
from tidemark.llm.scratch import map_batches

MEASURES = ("n_words", "word_chars", "n_upper", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
REPEAT_WINDOW = 5
_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True

#: Rule name -> a condition, over the measurements, under which a document fails it (integers only). Bit k is rule k.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "symbols": "100 * n_symbols > 10 * word_chars",
    "repeated_lines": "100 * n_dup_lines > 50 * n_lines",
    "capitals": "100 * n_upper > 50 * word_chars",
    "long_words": "word_chars > 20 * n_words",
}


@dataclass(frozen=True)
class Policy:
    """A document is rejected if it fails at least `fails` of `rules`."""

    version: str
    rules: tuple[str, ...]
    fails: int = 1

    @property
    def mask(self) -> int:
        return sum(1 << k for k, name in enumerate(RULES) if name in self.rules)


BASE = Policy("base", ("few_words", "repeated_words"))
POLICIES = {p.version: p for p in (BASE, Policy("v1", tuple(RULES)), Policy("v2-two-faults", tuple(RULES), 2))}


def _lines(words: bytetext.Words, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of the \\n-split lines that have a word."""
    if not len(words):
        return (np.zeros(0, np.int64),) * 3
    breaks = np.flatnonzero(words.data == 10)
    text_of = words.text_of()
    line_of = np.searchsorted(breaks, words.starts)  # newlines before the word
    new = np.ones(len(words), bool)
    new[1:] = (line_of[1:] != line_of[:-1]) | (text_of[1:] != text_of[:-1])
    at, text = line_of[new], text_of[new]
    before = np.where(at > 0, breaks[np.maximum(at - 1, 0)] + 1 if len(breaks) else 0, 0)
    after = np.where(at < len(breaks), breaks[np.minimum(at, len(breaks) - 1)] if len(breaks) else 0, len(words.data))
    return np.maximum(before, offsets[text]), np.minimum(after, offsets[text + 1]), text


def _repeated(key: np.ndarray) -> np.ndarray:
    """Which entries of key occur more than once."""
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    out = np.zeros(len(key), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def measure_texts(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The measurements of consecutive texts, in the order of MEASURES."""
    words = bytetext.Words(data, offsets, bytetext.SPACED)
    n_texts = len(offsets) - 1

    def per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[bounds])

    start, end, text = _lines(words, offsets)
    salt = bytetext.mix(np.arange(n_texts, dtype=np.uint64))
    line = bytetext.span_hashes(data, start, end) ^ salt[text]
    gram = bytetext.gram_hashes(words.hashes(), REPEAT_WINDOW)
    whole = np.flatnonzero(words.left()[: len(gram)] >= REPEAT_WINDOW)
    twice = whole[_repeated(gram[whole] ^ salt[words.text_of()[whole]])]
    step = np.zeros(len(words) + 1, np.int64)
    step[twice] += 1
    np.add.at(step, twice + REPEAT_WINDOW, -1)
    lines = np.bincount(text, minlength=n_texts)
    distinct = np.bincount(text[np.unique(line, return_index=True)[1]], minlength=n_texts)
    return [
        words.counts,
        per_text(bytetext.SPACED[data] & ((data & 0xC0) != 0x80), offsets),
        per_text((data >= 65) & (data <= 90), offsets),
        per_text(_SYMBOL[data], offsets),
        lines,
        lines - distinct,
        per_text(np.cumsum(step[:-1]) > 0, words.first),
    ]


def ledger(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns `keep` of every row and `ledger`: the measurements and `failed`, one bit a rule of RULES."""
    source = docs.select(*keep, F.col(text_col).alias("__text"))
    n_keep = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in bytetext.chunks(batch.column(n_keep)):
                found = pa.StructArray.from_arrays([pa.array(m, pa.int64()) for m in measure_texts(data, offsets)], MEASURES)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(n_keep)), found], [*keep, "ledger"])

    measures = T.StructType([T.StructField(m, T.LongType()) for m in MEASURES])
    measured = map_batches(source, run, T.StructType([*source.schema.fields[:n_keep], T.StructField("ledger", measures)]))
    return measured.withColumn("ledger", F.col("ledger").withField("failed", _bits()))


def _bits() -> Column:
    """One bit for each rule that the row's ledger fails."""
    bits = F.lit(0).cast("long")
    for k, rule in enumerate(RULES.values()):
        words = " ".join(f"ledger.{w}" if w in MEASURES else w for w in rule.split())
        bits = bits + F.when(F.expr(words), F.lit(1 << k)).otherwise(F.lit(0))
    return bits


def rejected(policy: Policy, failed: Column | None = None) -> Column:
    """Whether a policy rejects a row, from the ledger's bits."""
    failed = F.col("ledger.failed") if failed is None else failed
    return F.bit_count(failed.bitwiseAND(F.lit(policy.mask))) >= policy.fails


def ablations(ledgers: DataFrame, policies: dict[str, Policy] | None = None) -> DataFrame:
    """(version, without, documents, rejected): each policy whole (without null) and less one rule, in one aggregate.

    Documents with the same bits count together first, so that at most 2^rules rows are shuffled from a task.
    """
    patterns = ledgers.groupBy(F.col("ledger.failed").alias("failed")).agg(F.count("*").alias("n"))
    masks = []
    for p in (policies or POLICIES).values():
        for name in (None, *p.rules):
            mask = p.mask & ~(1 << list(RULES).index(name)) if name else p.mask
            masks.append(F.struct(F.lit(p.version).alias("version"), F.lit(name).cast("string").alias("without"), F.lit(mask).cast("long").alias("mask"), F.lit(p.fails).alias("fails")))
    each = patterns.select("failed", "n", F.inline(F.array(*masks)))
    hit = F.bit_count(F.col("failed").bitwiseAND(F.col("mask"))) >= F.col("fails")
    return each.groupBy("version", "without").agg(F.sum("n").alias("documents"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("rejected"))


def keep_good(docs: DataFrame, policy: Policy = POLICIES["v1"], text_col: str = "text") -> DataFrame:
    """The documents that the policy doesn't reject; all columns stay as they are."""
    carried = docs.toDF(*(f"__c{i}" for i in range(len(docs.columns))))
    kept = ledger(carried, tuple(carried.columns), carried.columns[docs.columns.index(text_col)])
    return kept.where(~rejected(policy)).drop("ledger").toDF(*docs.columns)


def report(docs: DataFrame, policy: Policy = POLICIES["v1"]) -> DataFrame:
    """Per row of documents: the measurements, the failure bits, base_failed and kept by the policy."""
    return ledger(docs).select(
        "doc_id",
        *(F.col(f"ledger.{m}").alias(m) for m in MEASURES),
        F.col("ledger.failed").alias("failed_bits"),
        rejected(BASE).alias("base_failed"),
        (~(rejected(BASE) | rejected(policy))).alias("kept"),
    )
