"""Periodic runs against a search over all periods, on random, planted and hostile texts."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest

from tidemark.llm import runs

from .helpers import frame, odd_texts, random_texts, spaced


def all_runs(words, least=12):
    """Maximal stretches of every period, less those that a smaller period explains."""
    found, n = [], len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, 2 * q):
                stretch = words[i : i + length]
                if not any(stretch[r:] == stretch[:-r] for r in range(1, q)):
                    found.append((i, length, q))
            i = j + 1
    return sorted((s, n, q) for s, n, q in found)


def contract(doc_id, text):
    words = spaced(text)
    h, n = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()), len(words)
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = all_runs(words)
    drop = {k for s, length, q in found for k in range(s + q, s + length)}
    s, length, q = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(found, key=lambda r: (r[0], r[2])))
    kept = " ".join(w for k, w in enumerate(words) if k not in drop)
    return (len(found), s, length, q, 1000 * length // q if found else None, *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)))


def planted(seed, n):
    rnd, out = random.Random(seed), []
    for _ in range(n):
        words = []
        while len(words) < rnd.randrange(10, 160):
            block = [rnd.choice("abcd") for _ in range(rnd.randrange(1, 12))]
            words += block * rnd.choice([1, 1, 2, 3, 5]) + block[: rnd.randrange(len(block) + 1)] if rnd.random() < 0.5 else [rnd.choice("abcdefgh") for _ in range(rnd.randrange(9))]
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("least", [2, 4, 12])
def test_every_run_is_found(least):
    texts = [t.split() for t in planted(least, 500)] + [["a"] * k for k in range(30)] + [list("ab" * 20), list("aab" * 20 + "ab" * 9)]
    numbers = [np.array([ord(c[0]) for c in t], np.int64) for t in texts]
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    start, length, period = runs.find_runs(np.concatenate(numbers), first, least)
    assert (np.diff(start) >= 0).all()
    row = np.searchsorted(first, start, "right") - 1
    got = {}
    for k, s, n, q in zip(row.tolist(), (start - first[row]).tolist(), length.tolist(), period.tolist()):
        got.setdefault(k, []).append((s, n, q))
    for k, words in enumerate(texts):
        assert sorted(got.get(k, [])) == all_runs(words, least), words


def test_report_equals_the_contract(spark):
    texts = [*planted(7, 150), *random_texts(3, 60), *odd_texts(), "a b c d e f " * 2, "a b c d e f g " * 3, "a\x85b " * 9, "twice " * 40, "twice " * 40]
    docs = frame(spark, [*texts, "no id " * 12], [*range(len(texts)), None])
    got = runs.report(docs, runs.looped).collect()
    assert len(got) == len(texts) + 1
    for row in got:
        assert tuple(row)[1:] == contract(row.doc_id, "no id " * 12 if row.doc_id is None else texts[row.doc_id])
    plain = {(r.doc_id, r.start, r.length, r.period) for r in runs.runs(docs.where("doc_id is not null")).collect()}
    assert plain == {(k, *r) for k, t in enumerate(texts) for r in all_runs(spaced(t))}
    assert runs.report(docs.limit(0)).count() == 0


def test_long_texts_take_no_quadratic_time():
    rnd = random.Random(2)
    fibonacci = ["a", "b"]
    while len(fibonacci[-1]) < 60_000:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    for words in (["x"] * 100_000, ["x", "y"] * 50_000, list(fibonacci[-1]), [rnd.choice("ab") for _ in range(100_000)], [str(k % 3000) for k in range(100_000)]):
        numbers = np.unique(np.array(words), return_inverse=True)[1].astype(np.int64)
        began = time.time()
        start, length, period = runs.find_runs(numbers, np.array([0, len(numbers)]))
        assert time.time() - began < 30
        for s, n, q in list(zip(start.tolist(), length.tolist(), period.tolist()))[:50]:
            assert (numbers[s : s + n - q] == numbers[s + q : s + n]).all()
