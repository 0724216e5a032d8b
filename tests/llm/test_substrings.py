"""Operator 3 against brute force."""

import hashlib
import random

import pytest
from tests.llm.helpers import frame, odd_texts, random_texts, spaced
from tidemark.llm import substrings


def brute(ids, texts, window):
    first = {}
    words = [spaced(t) for t in texts]
    for i, w in sorted(zip(ids, words), key=lambda x: x[0]):
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    out = {}
    for i, w in zip(ids, words):
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


@pytest.mark.parametrize("window, bucket", [(50, substrings.BUCKET_WORDS), (12, 300), (5, 40), (1, 10)])
def test_removal_matches_brute_force(spark, window, bucket):
    rnd = random.Random(window)
    passages = [" ".join(f"p{rnd.randrange(50)}" for _ in range(rnd.randrange(window, 3 * window + 2))) for _ in range(6)]
    texts = odd_texts() + random_texts(8, 25, 200, 150)
    texts += [" ".join([rnd.choice(texts[-20:]), rnd.choice(passages), rnd.choice(texts[-20:]), rnd.choice(passages)]) for _ in range(40)]
    texts += [rnd.choice(texts) or "" for _ in range(15)] + [texts[-1] + "\n \t" + texts[-2]] + ["a b a b " * 60, "b a " * 90]
    ids = rnd.sample(range(-50, 3000), len(texts))
    got = substrings.remove_repeats(frame(spark, texts + texts[-4:-3], ids + ids[-4:-3]), window, bucket_words=bucket).collect()
    assert len(got) == len(texts) + 1
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in got} == brute(ids, texts, window)


def test_rows_without_ids_and_empty_tables(spark):
    text = " ".join(f"w{k}" for k in range(60))
    docs = frame(spark, [text, text, text, None], [None, 4, 3, 2])
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.report(docs).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == {None: (60, 0, sha(text)), 4: (60, 60, sha("")), 3: (60, 0, sha(text)), 2: (0, 0, sha(""))}
    assert substrings.report(docs.limit(0)).count() == 0
