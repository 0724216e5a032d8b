"""Toxicity scores by a bidirectional gated recurrent network with attention pooling (operator 8).

A word's input is a hashed word vector joined with the mean of its hashed character trigram vectors.
Two gated recurrent networks read each window of `WINDOW` words, one from either end; attention over
their states pools a window into one score.  Windows overlap (`STRIDE` words apart) and cover the
whole text; a text's score is the calibrated maximum over its windows.

The network is trained in numpy on the driver, from a sample of labelled rows of a bounded size
(`Training.rows_per_class`, of at most `Training.most_chars` characters each), first on windows with
their texts' labels, then on each text's highest window.  Scoring is a map over the documents.

Defined results: a null or wordless text scores 0.  A sample without rows of both classes trains
nothing, and every text scores 0.  Labels that are null are left out; of several labels of one id the
largest counts.  Each input row gives one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import bytetext
from tidemark.llm.scratch import map_batches

WINDOW, STRIDE = 32, 24
HIDDEN, WORD_DIM, CHAR_DIM = 8, 8, 8
WORD_BITS, CHAR_BITS = 15, 13
BLOCK = 4096
f32 = np.float32


@dataclass(frozen=True)
class Training:
    """Bounds and settings of the fit."""

    rows_per_class: int = 1500
    most_chars: int = 8000
    windows: int = 16_000
    least_texts: int = 4
    window_rounds: int = 2
    text_windows: int = 300_000
    rate: float = 0.01
    seed: int = 3


class Inputs:
    """The words of consecutive texts as inputs: distinct words, their trigrams, and windows over them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        words = bytetext.Words(data, offsets, bytetext.NAMES, lower=True)
        self.counts = words.counts
        distinct, at, self.word = np.unique(words.hashes(), return_index=True, return_inverse=True)
        self.slot = (distinct >> np.uint64(64 - WORD_BITS)).astype(np.int64)
        starts, ends = words.starts[at], words.ends[at]
        size = ends - starts
        first = np.cumsum(size) - size
        place = np.arange(size.sum()) + np.repeat(starts - first, size)
        byte = words.data[place].astype(np.uint64)
        before, after = np.roll(byte, 1), np.roll(byte, -1)
        if len(first):
            before[first] = 0
            after[first + size - 1] = 0
        key = bytetext.mix(byte | before << np.uint64(8) | after << np.uint64(16))
        self.gram, self.gram_first, self.gram_size = (key >> np.uint64(64 - CHAR_BITS)).astype(np.int64), first, size
        n_windows = np.where(self.counts > 0, 1 + np.maximum(0, -(-(self.counts - WINDOW) // STRIDE)), 0)
        self.window_text = np.repeat(np.arange(len(self.counts)), n_windows)
        nth = np.arange(len(self.window_text)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
        self.window_start = words.first[:-1][self.window_text] + nth * STRIDE
        self.window_size = np.minimum(WINDOW, words.first[1:][self.window_text] - self.window_start)

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct-word numbers (windows, WINDOW) and whether each place is a word."""
        t = np.arange(WINDOW)
        mask = t[None, :] < self.window_size[which][:, None]
        return self.word[np.where(mask, self.window_start[which][:, None] + t, 0)], mask


class Network:
    """Parameters, forward and backward pass. Direction 0 reads forwards, 1 backwards."""

    def __init__(self, seed: int):
        r = np.random.default_rng(seed)
        draw = lambda *shape, s=0.3: (r.standard_normal(shape) * s).astype(f32)
        e = WORD_DIM + CHAR_DIM
        #: Word slots with a vector; the others' is zero, so that rare words count by their characters.
        self.known = np.ones(1 << WORD_BITS, bool)
        self.p = {
            "words": draw(1 << WORD_BITS, WORD_DIM, s=0.1),
            "chars": draw(1 << CHAR_BITS, CHAR_DIM, s=0.1),
            "wx": draw(2, e, 3 * HIDDEN),
            "wh": draw(2, HIDDEN, 3 * HIDDEN),
            "b": np.zeros((2, 1, 3 * HIDDEN), f32),
            "att": draw(2 * HIDDEN),
            "out": draw(2 * HIDDEN),
            "bias": np.zeros(1, f32),
        }

    def word_inputs(self, x: Inputs) -> np.ndarray:
        char = np.zeros((len(x.slot), CHAR_DIM), f32)
        if len(x.slot):
            char = np.add.reduceat(self.p["chars"][x.gram], x.gram_first, axis=0) / x.gram_size[:, None].astype(f32)
        return np.concatenate([self.p["words"][x.slot] * self.known[x.slot][:, None], char], 1)

    def forward(self, inputs: np.ndarray, index: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows; with `keep` also what backward needs."""
        p, n = self.p, len(index)
        gates = np.stack([inputs @ p["wx"][0], inputs @ p["wx"][1]]) + p["b"]  # of each distinct word, once
        h, states, tape = np.zeros((2, n, HIDDEN), f32), np.zeros((WINDOW, 2, n, HIDDEN), f32), []
        for t in range(WINDOW):
            u = WINDOW - 1 - t
            x = np.stack([gates[0][index[:, t]], gates[1][index[:, u]]])
            m = np.stack([mask[:, t], mask[:, u]])[:, :, None]
            r = h @ p["wh"]
            zr = 0.5 * np.tanh(0.5 * (x[..., : 2 * HIDDEN] + r[..., : 2 * HIDDEN])) + f32(0.5)
            z, q = zr[..., :HIDDEN], zr[..., HIDDEN:]
            c = np.tanh(x[..., 2 * HIDDEN :] + q * r[..., 2 * HIDDEN :])
            new = np.where(m, h + z * (c - h), h)
            if keep:
                tape.append((h, z, q, c, r[..., 2 * HIDDEN :], m))
            h = new
            states[t, 0] = h[0]
            states[u, 1] = h[1]
        both = states.transpose(2, 0, 1, 3).reshape(n, WINDOW, 2 * HIDDEN)
        e = np.where(mask, both @ p["att"], f32(-1e9))
        a = np.exp(e - e.max(1, keepdims=True))
        a /= a.sum(1, keepdims=True)
        pooled = np.einsum("nt,nth->nh", a, both)
        logit = pooled @ p["out"] + p["bias"]
        return (logit, (tape, both, a, pooled)) if keep else logit

    def backward(self, x: Inputs, inputs: np.ndarray, index: np.ndarray, kept, d_logit: np.ndarray) -> dict[str, np.ndarray]:
        tape, both, a, pooled = kept
        p, n = self.p, len(index)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["bias"][0], g["out"] = d_logit.sum(), d_logit @ pooled
        d_pooled = d_logit[:, None] * p["out"]
        d_both = a[:, :, None] * d_pooled[:, None, :]
        d_a = np.einsum("nth,nh->nt", both, d_pooled)
        d_e = a * (d_a - (a * d_a).sum(1, keepdims=True))
        g["att"] = np.einsum("nt,nth->h", d_e, both)
        d_both += d_e[:, :, None] * p["att"]
        d_states = d_both.reshape(n, WINDOW, 2, HIDDEN).transpose(1, 2, 0, 3)
        d_gates = np.zeros((2, len(inputs), 3 * HIDDEN), f32)
        d_h = np.zeros((2, n, HIDDEN), f32)
        for t in reversed(range(WINDOW)):
            u = WINDOW - 1 - t
            h, z, q, c, rc, m = tape[t]
            d_h = d_h + np.stack([d_states[t, 0], d_states[u, 1]])
            d_new = d_h * m
            d_z, d_c = d_new * (c - h) * z * (1 - z), d_new * z * (1 - c * c)
            d_q = d_c * rc * q * (1 - q)
            d_x = np.concatenate([d_z, d_q, d_c], 2)
            d_r = np.concatenate([d_z, d_q, d_c * q], 2)
            g["wh"] += h.transpose(0, 2, 1) @ d_r
            d_h = d_h * ~m + d_new * (1 - z) + d_r @ p["wh"].transpose(0, 2, 1)
            for k, s in ((0, t), (1, u)):
                np.add.at(d_gates[k], index[:, s], d_x[k])
        g["b"] = d_gates.sum(1, keepdims=True)
        g["wx"] = inputs.T @ d_gates
        d_in = d_gates[0] @ p["wx"][0].T + d_gates[1] @ p["wx"][1].T
        np.add.at(g["words"], x.slot, d_in[:, :WORD_DIM] * self.known[x.slot][:, None])
        share = np.repeat(d_in[:, WORD_DIM:] / x.gram_size[:, None].astype(f32), x.gram_size, axis=0)
        np.add.at(g["chars"], x.gram, share)
        return g


class ToxicityModel:
    """A trained network and the calibration of its largest window score."""

    def __init__(self, network: Network, slope: float, offset: float):
        self.network, self.slope, self.offset = network, slope, offset

    def text_logits(self, x: Inputs) -> np.ndarray:
        """The largest window logit of each text; -inf without words."""
        inputs, best = self.network.word_inputs(x), np.full(len(x.counts), -np.inf)
        for a in range(0, len(x.window_text), BLOCK):
            which = np.arange(a, min(a + BLOCK, len(x.window_text)))
            np.maximum.at(best, x.window_text[which], self.network.forward(inputs, *x.windows(which)))
        return best

    def scores(self, x: Inputs) -> np.ndarray:
        best = self.text_logits(x)
        return np.where(np.isfinite(best), 1 / (1 + np.exp(-np.clip(self.slope * np.where(np.isfinite(best), best, 0) + self.offset, -40, 40))), 0.0)


def train(texts: list[str], labels: list[int], settings: Training = Training()) -> ToxicityModel | None:
    """Fit on labelled texts; None without both classes."""
    label = np.array(labels, f32)
    if len(set(labels)) < 2:
        return None
    x = Inputs(*bytetext.string_buffers(pa.array(texts, pa.string())))
    net, rnd = Network(settings.seed), np.random.default_rng(settings.seed)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    model, steps = ToxicityModel(net, 1.0, 0.0), 0
    text_of = np.repeat(np.arange(len(texts)), x.counts)
    pairs = np.unique(np.stack([x.slot[x.word], text_of], 1), axis=0)
    net.known = np.bincount(pairs[:, 0], minlength=1 << WORD_BITS) >= settings.least_texts

    def step(which: np.ndarray) -> None:
        nonlocal steps
        steps += 1
        # the distinct words of this step only
        index, mask = x.windows(which)
        used, local = np.unique(index, return_inverse=True)
        part = _Part(x, used)
        inputs = net.word_inputs(part)
        logit, kept = net.forward(inputs, local.reshape(index.shape), mask, keep=True)
        y = label[x.window_text[which]]
        weight = np.where(y > 0, 0.5 / max(y.mean(), 0.05), 0.5 / max(1 - y.mean(), 0.05)).astype(f32)
        grads = net.backward(part, inputs, local.reshape(index.shape), kept, (1 / (1 + np.exp(-logit)) - y) * weight / f32(len(which)))
        for k, g in grads.items():
            m, v = moment[k]
            m += f32(0.1) * (g - m)
            v += f32(0.01) * (g * g - v)
            net.p[k] -= f32(settings.rate) * (m / f32(1 - 0.9**steps)) / (np.sqrt(v / f32(1 - 0.99**steps)) + f32(1e-6))

    all_windows = np.arange(len(x.window_text))
    text_rounds = int(np.clip(settings.text_windows // max(len(all_windows), 1), 3, 40))  # a small sample needs more of them
    for _ in range(settings.window_rounds):
        chosen = rnd.permutation(all_windows)[: settings.windows]
        for a in range(0, len(chosen), 512):
            step(chosen[a : a + 512])
    for _ in range(text_rounds):
        inputs = net.word_inputs(x)
        logit = np.concatenate([np.zeros(0, f32), *(net.forward(inputs, *x.windows(all_windows[a : a + BLOCK])) for a in range(0, len(all_windows), BLOCK))])
        order = np.lexsort((logit, x.window_text))
        top = order[np.append(np.diff(x.window_text[order]) > 0, True)]
        top = rnd.permutation(top)
        size = 256 if len(top) > 1000 else 64
        for a in range(0, len(top), size):
            step(top[a : a + size])
    best = model.text_logits(x)
    seen = np.isfinite(best)
    slope, offset = 1.0, 0.0
    for _ in range(300):  # calibration: logistic regression on the largest window logit
        error = label[seen] - 1 / (1 + np.exp(-np.clip(slope * best[seen] + offset, -40, 40)))
        slope, offset = max(0.05, slope + 0.05 * float((error * best[seen]).mean())), offset + 0.5 * float(error.mean())
    return ToxicityModel(net, slope, offset)


class _Part:
    """Some of the distinct words of an Inputs."""

    def __init__(self, x: Inputs, used: np.ndarray):
        self.slot, self.gram_size = x.slot[used], x.gram_size[used]
        self.gram_first = np.cumsum(self.gram_size) - self.gram_size
        self.gram = x.gram[np.arange(self.gram_size.sum()) + np.repeat(x.gram_first[used] - self.gram_first, self.gram_size)]


def is_held_out(id_col: str = "doc_id"):
    """Rows whose labels training must not see: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, settings: Training) -> DataFrame:
    """(text, toxic) of at most rows_per_class labelled rows of each class that aren't held out, in the order of a hash."""
    known = labels.where("toxic is not null and doc_id is not null").where(~is_held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    pick = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.rows_per_class) for y in (0, 1)]
    chosen = F.broadcast(pick[0].unionByName(pick[1]))  # at most 2 * rows_per_class small rows
    own = docs.select("doc_id", "text").where(F.length("text") <= settings.most_chars)
    return own.join(chosen, "doc_id").select("doc_id", "text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, settings: Training = Training()) -> ToxicityModel | None:
    rows = training_rows(docs, labels, settings).dropDuplicates(["doc_id"]).orderBy("doc_id").limit(2 * settings.rows_per_class).collect()
    return train([r.text for r in rows], [int(r.toxic) for r in rows], settings)


def score(docs: DataFrame, model: ToxicityModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every document."""
    spread = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in bytetext.chunks(batch.column(1)):
                found = spread.value.scores(Inputs(data, offsets)) if spread.value else np.zeros(b - a)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(found, pa.float64())], [id_col, "score"])

    return map_batches(source, run, T.StructType([source.schema[id_col], T.StructField("score", T.DoubleType())]))


def report(docs: DataFrame, labels: DataFrame, settings: Training = Training(), threshold: float = 0.3) -> DataFrame:
    """Per row of documents: held_out, score and predicted."""
    scored = score(docs, fit(docs, labels, settings))
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
