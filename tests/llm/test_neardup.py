"""Operator 2 against all pairs."""

import random

import pytest
from tests.llm.helpers import frame, lower, odd_texts, random_texts, spaced
from tidemark.llm import graph, neardup


def shingles(text, n):
    w = spaced(lower(text))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def components(ids, texts, n, percent):
    sets = [shingles(t, n) for t in texts]
    parent = list(range(len(ids)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(ids)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b, key=lambda k: ids[k])] = min(a, b, key=lambda k: ids[k])
    return {i: (len(s), ids[root(k)]) for k, (i, s) in enumerate(zip(ids, sets))}


def near_copies(seed, n, words=60, most=14):
    """A text with exact copies, and copies with ever more edits (changed, added and left out words)."""
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(400)}" for _ in range(words)]
    out = [" ".join(base)] * 3
    for _ in range(n):
        copy = list(base)
        for _ in range(rnd.randrange(most)):
            k = rnd.randrange(len(copy))
            how = rnd.random()
            copy[k : k + 1] = [f"x{rnd.randrange(30)}"] if how < 0.5 else [] if how < 0.8 else [copy[k], "y"]
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("local", [neardup.LOCAL_SHINGLES, 200])
def test_components_match_all_pairs(spark, local):
    texts = odd_texts() + random_texts(4, 30) + near_copies(1, 90) + near_copies(2, 60, 30, 6) + ["A b C", "a B c", "a b", "A B"]
    rnd = random.Random(3)
    ids = rnd.sample(range(10_000), len(texts))
    docs = frame(spark, texts + texts[-1:], ids + ids[-1:])
    want = components(ids, texts, 3, 85)
    found = neardup.near_duplicates(docs, 3, 85, local_shingles=local).collect()
    assert len(found) == len(texts) + 1
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want


def test_report_nulls_and_empty_tables(spark):
    docs = frame(spark, ["a b c d", "a b c d", None, ""], [None, 5, 6, 7])
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.report(docs).collect()}
    assert got == {None: (None, None, True), 5: (2, 5, True), 6: (0, 6, True), 7: (0, 7, True)}
    assert neardup.report(docs.limit(0)).count() == 0


def test_deduplicate_keeps_one_of_each_group(spark):
    text = " ".join(f"w{k}" for k in range(40))
    docs = frame(spark, [text, text + " end", "other words here", text, None], [9, 3, 5, 4, 8])
    kept = neardup.deduplicate(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 5, 8]


def test_connected_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 99), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in graph.connected_components(edges).collect()}
    assert got == {**{k: 0 for k in range(1, 41)}, 100: 99}


@pytest.mark.parametrize("size", [40])
def test_families_in_one_region_take_pairs_in_proportion_to_their_size(spark, monkeypatch, size):
    """Families that share most of their words but aren't linked, in one region that is too large for a task."""
    rnd = random.Random(5)
    base = [f"b{k}" for k in range(120)]
    texts = []
    for f in range(4):
        own = list(base)
        for k in range(f * 25, f * 25 + 20):
            own[k] = f"f{f}w{k}"
        for m in range(size):
            copy = list(own)
            copy[100 + rnd.randrange(20)] = f"m{m}"
            texts.append(" ".join(copy))
    counts = []
    confirmed = neardup._confirmed
    monkeypatch.setattr(neardup, "_confirmed", lambda pairs, *rest: (counts.append(pairs.count()), confirmed(pairs, *rest))[1])
    ids = rnd.sample(range(10_000), len(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(frame(spark, texts, ids), 3, 85, local_shingles=500).collect()}
    assert got == components(ids, texts, 3, 85)
    assert counts and sum(counts) <= 4 * len(texts)


def test_common_prefixes_are_measured(spark):
    """Each text meets the head of the run that shares its longest prefix with the text before it."""
    import numpy as np

    sig = [[1, 1, 1, 1, 1, 1, 1, 1], [1, 1, 1, 1, 1, 1, 1, 2], [1, 1, 1, 1, 1, 2, 1, 1], [1, 1, 1, 1, 1, 2, 1, 1], [1, 1, 1, 1, 2, 1, 1, 1], [2, 1, 1, 1, 1, 1, 1, 1]]
    rows = [(k, bytearray(np.array(s, ">u4").tobytes())) for k, s in enumerate(sig)]
    edges = neardup.forest_edges(spark.createDataFrame(rows, "id long, sig binary"), 1)
    got = {(r.a, r.b, r.common) for r in edges.collect()}
    # a partition's end may lead to the text before it instead of the head
    assert {(b, c) for _, b, c in got} == {(1, 7), (2, 5), (3, 8)} and all(sig[a][:c] == sig[b][:c] for a, b, c in got)
