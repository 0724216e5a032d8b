"""The pipeline's stages on a small corpus with known cases."""

import random

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402


def corpus():
    rnd = random.Random(1)
    words = ["".join(rnd.choice("aeioulnrst") for _ in range(rnd.randrange(2, 8))) for _ in range(400)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    item, clean = text(30), [text(60) for _ in range(12)]
    docs = list(enumerate(clean))
    docs += [(20, clean[0]), (21, clean[1] + " end"), (22, "too short"), (23, "same line again here now\n" * 12), (24, text(20) + " " + item + " " + text(20)), (25, text(30) + ' token = "abcdef123456" ' + text(5)), (26, None), (27, "")]
    return docs, item


def test_stages_and_run(spark, tmp_path):
    docs, item = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append({r.doc_id: r.text for r in now.collect()})
    quality, near, clean, secret = kept
    assert set(quality) == {*range(12), 20, 21, 24, 25}
    assert set(near) == {*range(12), 24, 25}
    assert set(clean) == set(secret) == {*range(12), 25}
    assert "abcdef123456" not in secret[25] and "[SECRET]" in secret[25] and all(secret[i] == clean[i] for i in range(12))
    done = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(done) == set(secret) and all(r.n_tokens > 0 for r in done.values())


def test_stages_on_empty_tables_long_texts_and_clashing_columns(spark, tmp_path):
    schema = "doc_id long, text string, hits string, ledger string, secrets string, component_id string, __text string"
    spark.createDataFrame([(7, "a b c")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rnd = random.Random(2)
    long = " ".join("".join(rnd.choice("aeiounrst") for _ in range(5)) for _ in range(60_000)) + " token=hunter22"
    for rows in ([], [(1, long, *["x"] * 5), (1, long, *["x"] * 5), (None, None, *["x"] * 5), (2, "", *["x"] * 5)]):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns
            assert {r.doc_id for r in out.collect()} <= {r[0] for r in rows}
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == len(rows)
