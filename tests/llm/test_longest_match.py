"""Operator 1's longest match of every document against brute force."""

import random

import pytest
from tests.llm.helpers import frame, names, odd_texts, random_texts
from tidemark.llm import decontaminate


def longest(text, items):
    """(words, start) of the first longest run shared with an item, of 3 words or a whole item."""
    words, best = names(text), (0, None)
    for start in range(len(words)):
        for item in items:
            for k in range(len(item)):
                n = 0
                while start + n < len(words) and k + n < len(item) and words[start + n] == item[k + n]:
                    n += 1
                if n > best[0] and (n >= 3 or n == len(item)):
                    best = (n, start)
    return best


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 600])
@pytest.mark.parametrize("short", [(), ("a b", "zebra")])
def test_every_document_has_its_own_longest_match(spark, monkeypatch, block, short):
    """Copies of a contaminated page and shorter matches of the same passage share a shard."""
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    rnd = random.Random(6)
    passages = [[f"p{k}w{j}" if rnd.random() < 0.8 else "of" for j in range(40)] for k in range(6)]
    items = [" ".join(p) for p in passages] + [*short, "", None]
    texts = odd_texts() + random_texts(8, 20, 8, 40) + ["a zebra", "zebra a b"]
    for p in passages:
        texts += [f"intro {' '.join(p[5:30])} end"] * 3 + [" ".join(p[a : a + n]) + " x " + " ".join(p[b : b + 4]) for a, b, n in ((5, 0, 12), (5, 20, 2), (8, 1, 22), (0, 9, 40))]
    rows = {r.doc_id: (r.longest_words, r.longest_start) for r in decontaminate.report(frame(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    words = [names(t) for t in items if names(t)]
    for i, text in enumerate(texts):
        assert rows[i] == longest(text, words), text[:80] if text else text


def test_large_benchmarks_write_no_texts(spark, monkeypatch, tmp_path):
    """40 MB of items, in groups: what is stored are the matches, and the result is that of one block."""
    written = []

    def counted(df, name):
        path = str(tmp_path / f"{name}{len(written)}")
        df.write.parquet(path)
        written.append((sum(f.stat().st_size for f in (tmp_path / f"{name}{len(written)}").rglob("*.parquet")), tuple(df.columns)))
        return spark.read.schema(df.schema).parquet(path)

    monkeypatch.setattr(decontaminate, "stored", counted)
    rnd = random.Random(9)
    word = [f"w{k}" for k in range(20_000)]
    items = [(k, " ".join(rnd.choices(word, k=7000))) for k in range(1000)]
    assert sum(len(t) for _, t in items) > 40e6
    texts = [None, "", "one two", *(" ".join(rnd.choices(word, k=400)) for _ in range(300))]
    texts += [" ".join(["x"] * 5 + items[k][1].split()[50 : 50 + n] + ["y"] + items[k + 1][1].split()[90:104]) for k, n in ((3, 12), (500, 30), (998, 10))] * 2
    docs = frame(spark, texts)
    got = {r.doc_id: r for r in decontaminate.report(docs, spark.createDataFrame(items, "item_id long, text string").repartition(8)).collect()}
    assert len(written) >= 5 and sum(n for n, _ in written) < 1e6 and all("__text" not in c for _, c in written)
    for i, text in enumerate(texts):
        hit = i >= 303
        assert (got[i].n_words, got[i].contaminated) == (len(names(text)), hit), i
        if hit:
            k, n = ((3, 12), (500, 30), (998, 10))[(i - 303) % 3]
            assert (got[i].n_hit, got[i].n_items, got[i].longest_words, got[i].longest_start) == (n + 14, 2, *max((n, 5), (14, 6 + n), key=lambda x: (x[0], -x[1])))
