"""Documents with the cases that every operator must handle, and plain tokenisers."""

import random
import re

from pyspark.sql import types as T

NAME = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SPACED = re.compile("[^\x20\x09-\x0d]+")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("hits", T.StringType()),
        T.StructField("ledger", T.StringType()),
        T.StructField("secrets", T.StringType()),
        T.StructField("component_id", T.StringType()),
    ]
)


def lower(text):
    return (text or "").translate(_LOWER)


def names(text):
    return NAME.findall(lower(text))


def spaced(text):
    return SPACED.findall(text or "")


def odd_texts():
    return [None, "", " ", "\n\n\n", "a", "A\u0000b", "é" * 50, "one two\x0bthree\x0cfour five six", "\U0001f600 x\r\ny", "x " * 3000, "word" * 2000]


def frame(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", "s", len(t or ""), "clash", "clash", "clash", "clash") for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, DOCS)


def random_texts(seed, n, vocabulary=60, most=80):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeéñ") for _ in range(rnd.randrange(1, 7))) for _ in range(vocabulary)]
    return ["".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "\n", ", ", "  "]) for _ in range(rnd.randrange(most))) for _ in range(n)]
