"""Ranked search against scoring every document for every item."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import search

from .helpers import frame, names, odd_texts, random_texts


def brute(docs, items, k=20):
    counted = [(i, Counter(names(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    total, length = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        asked, scored = Counter(names(text)), []
        for i, c, n in counted:
            m = 100 - 25 + (25 * n * total) // length
            score = sum(r * math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t, r in asked.items() if c[t])
            if score > 0:
                scored.append((-score, i is not None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def test_equals_scoring_everything(spark):
    words = random_texts(1, 300, vocabulary=200, most=60)
    texts = [*words, *odd_texts(), "rare", "rare rare", "rare", "common " * 5000, "Common rare"]
    ids = [*range(len(texts)), None, 7]
    texts += ["rare common", texts[7]]
    items = [(k, t) for k, t in enumerate([*random_texts(1, 12, vocabulary=200, most=40), "rare common common", "nowhere", "", None, "RARE", "!"])]
    items.append((12, "rare common common"))
    table = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, texts, ids)
    got = sorted(map(tuple, search.rank(docs.repartition(3), table).collect()), key=str)
    assert got == brute(list(zip(ids, texts)), items)
    assert sorted(map(tuple, search.rank(docs, table, k=3).collect()), key=str) == brute(list(zip(ids, texts)), items, 3)
    assert search.rank(docs.limit(0), table).count() == 0
    assert search.rank(docs, table.limit(0)).count() == 0
    other = spark.createDataFrame([("a", "rare"), ("b", "common rare")], "doc_id string, text string")
    assert search.rank(other, spark.createDataFrame([("x", "rare common")], "item_id string, text string")).count() == 2


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    docs, items = frame(spark, random_texts(2, 120)), spark.createDataFrame(list(enumerate(random_texts(2, 30))), "item_id long, text string")
    want = sorted(map(tuple, search.rank(docs, items).collect()))
    monkeypatch.setattr(search, "ITEM_BYTES", 1500)
    assert sorted(map(tuple, search.rank(docs, items).collect())) == want
    monkeypatch.setattr(search, "ITEM_BYTES", 20)
    with pytest.raises(ValueError):
        search.rank(docs, items)


@pytest.mark.parametrize("seed", range(4))
def test_shards_stop_early_and_lose_nothing(seed):
    """Shards in turn, kept scores carried; some lists must be left unread, and ties at the last place go by id."""
    rnd = np.random.default_rng(seed)
    terms, k, read, whole = 40, 5, 0, 0
    asked, repeats = np.arange(0, terms, 3), rnd.integers(1, 3, len(range(0, terms, 3)))
    kept, scored = [], []
    for part in range(3):
        n = 4000
        present = rnd.random((n, terms)) < rnd.random(terms) ** 3
        impact = np.where(present, rnd.integers(1, 9, (n, terms)) ** (1 + 3 * (rnd.random((n, terms)) < 0.02)), 0)
        doc, term = np.nonzero(impact)
        ids = rnd.permutation(n) * 3 + part
        shard = search.Shard(pa.array(ids), term.astype(np.int64), doc.astype(np.int64), impact[doc, term].astype(np.int64), terms)
        docs, scores = shard.best(0, asked, repeats, np.array([-s for s, _ in kept], np.int64), k)
        kept = sorted(kept + [(-s, i) for s, i in zip(scores.tolist(), ids[docs].tolist()) if s > 0])[:k]
        total = (impact[:, asked] * repeats).sum(axis=1)
        scored += [(-s, i) for s, i in zip(total.tolist(), ids.tolist()) if s > 0]
        read, whole = read + int((shard.seen == 0).sum()), whole + int((impact[:, asked].sum(axis=1) > 0).sum())
    assert kept == sorted(scored)[:k]
    assert read < whole
