"""URL filters: host and path rules, then a logistic regression on hashed character n-grams (operator 5).

The classifier is trained with numpy from the small labelled table of `url_labels` on the driver (its
size doesn't depend on the pages) and scores all pages in a map.  Rules are a small list: a rule fits its host
and all subdomains if the url's path starts with the rule's path; the longest fitting rule decides,
and the classifier decides where no rule fits.

Host: after the first :// up to /, ?, # or the end, A-Z lower-cased; path: from there up to ?, # or
the end.  Defined results: for a null url, or one without ://, both are empty; no rule fits, and the
classifier's verdict on empty strings holds.  Each input row gives one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import bytetext
from tidemark.llm.scratch import map_batches
from tidemark.llm.url_labels import labelled_urls

#: The rules of the filter, verdict by host and path.
RULES = {
    "net/": "block",
    "example.net/en/": "allow",
    "example.com/de/": "block",
    "org/fr/": "allow",
}
NGRAMS = (3, 4, 5)
BITS = 16


def _features(hosts: pa.Array, paths: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of each row's host and path: (bucket, row) of every occurrence."""
    buckets, rows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for part, column in enumerate((hosts, paths)):
        data, offsets = bytetext.string_buffers(column)
        size, row = np.diff(offsets), np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        left = np.repeat(offsets[1:], size) - np.arange(len(data))
        for n in NGRAMS:
            at = np.flatnonzero(left >= n)
            key = bytetext.span_hashes(data, at, at + n) + np.uint64(part)
            buckets.append((bytetext.mix(key) >> np.uint64(64 - BITS)).astype(np.int64))
            rows.append(row[at])
    return np.concatenate(buckets), np.concatenate(rows)


class UrlClassifier:
    """Logistic regression: the mean weight of a url's n-grams, scaled by the root of their number, plus a bias."""

    def __init__(self, rows: list[tuple[str, int]], rounds: int = 1500, rate: float = 8.0, decay: float = 1e-6):
        parts = [split_url(u) for u, _ in rows]
        label = np.array([y for _, y in rows], np.float64)
        bucket, row = _features(pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()))
        scale = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=len(rows)), 1))
        self.weights, self.bias = np.zeros(1 << BITS), 0.0
        for _ in range(rounds):
            score = np.bincount(row, self.weights[bucket], len(rows)) * scale + self.bias
            error = (label - 1 / (1 + np.exp(-score))) / len(rows)
            self.weights += rate * (np.bincount(bucket, (error * scale)[row], 1 << BITS) - decay * self.weights)
            self.bias += rate * error.sum()

    def scores(self, hosts: pa.Array, paths: pa.Array) -> np.ndarray:
        bucket, row = _features(hosts, paths)
        n = np.maximum(np.bincount(row, minlength=len(hosts)), 1)
        return 1 / (1 + np.exp(-(np.bincount(row, self.weights[bucket], len(hosts)) / np.sqrt(n) + self.bias)))


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path, as the columns of `filter_urls` have them."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    cut = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    end = min((k for k in map(rest.find, "?#") if k >= 0), default=len(rest))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), rest[:end]


def _rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest fitting rule; null if none fits."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=len):  # the longest is the outermost
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def filter_urls(pages: DataFrame, rules: dict[str, str] = RULES, threshold: float = 0.5, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, score): score is the classifier's probability that a url is unwanted."""
    model = pages.sparkSession.sparkContext.broadcast(UrlClassifier(labelled_urls()))
    url = F.coalesce(F.col(url_col), F.lit(""))
    parts = (
        pages.select(F.col(id_col).alias("id"), url.alias("u"))
        .select("id", F.when(F.locate("://", "u") > 0, F.expr("substring(u, locate('://', u) + 3)")).otherwise("").alias("rest"))
        .select("id", F.regexp_extract("rest", r"(?s)^([^/?#]*)", 1).alias("host"), F.regexp_extract("rest", r"(?s)^[^/?#]*([^?#]*)", 1).alias("path"))
        .select("id", F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"), "path")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.value.scores(batch.column(1), batch.column(2)))], [*batch.schema.names, "score"])

    scored = map_batches(parts, run, T.StructType([*parts.schema.fields, T.StructField("score", T.DoubleType())]))
    rule = _rule(F.col("host"), F.col("path"), rules)
    verdicts = F.create_map(*(F.lit(x) for item in rules.items() for x in item))
    return scored.withColumn("rule", rule).select(
        F.col("id").alias(id_col),
        "host",
        "path",
        "rule",
        F.coalesce(verdicts[F.col("rule")], F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"),
        "score",
    )
