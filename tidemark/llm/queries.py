"""The registered queries of the corpus operators, each over its whole table, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, licenses, neardup, pages, pieces, quality, runs, search, secrets, substrings, toxicity, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.withColumn("longest_start", F.coalesce("longest_start", F.lit(-1)))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.report(_table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(_table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(_table(spark, sf_dir, "documents"))


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each policy rejects, whole and less one rule, from the ledger's bits."""
    return quality.ablations(quality.ledger(_table(spark, sf_dir, "documents")))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(_table(spark, sf_dir, "pages"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(_table(spark, sf_dir, "documents"), spanning=True)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.report(_table(spark, sf_dir, "pages"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.rank(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.report(_table(spark, sf_dir, "documents"), runs.looped)


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_decontaminate, op2_near_duplicates, op3_substring_dedup, op4_quality_rules, quality_ablations, op5_url_filter, op6_license_scan, op7_secret_scan, op8_toxicity, op9_byte_bpe, op10_main_text, op11_ranked_search, op12_periodic_runs, op13_sentencepiece)
}

_NAMES = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACED = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
#: The measurements of each document, and its failure bits.
_RULES = rf"""d AS (SELECT doc_id, coalesce(text, '') AS text, {_SPACED} AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
g AS (SELECT doc_id, k, list_slice(w, k, k + 4) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS k FROM d WHERE len(w) >= 5)),
twice AS (SELECT doc_id, g FROM g GROUP BY doc_id, g HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(k, k + 5)) AS p FROM g JOIN twice USING (doc_id, g)) GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(text, '[A-Z]')) AS BIGINT) AS n_upper, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN rep USING (doc_id)),
bits AS (SELECT *, CAST((CASE WHEN n_words < 10 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END) + (CASE WHEN 100 * n_symbols > 10 * word_chars THEN 4 ELSE 0 END)
  + (CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END) + (CASE WHEN 100 * n_upper > 50 * word_chars THEN 16 ELSE 0 END) + (CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END) AS BIGINT) AS failed_bits FROM m)"""

ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": rf"""
WITH d AS (SELECT doc_id, {_NAMES} AS w FROM documents),
i AS (SELECT item_id, {_NAMES} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, list_slice(w, k, k + 9) AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS k FROM i WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len(g) AS n FROM iw),
dw AS (SELECT doc_id, k, n, list_slice(w, k, k + n - 1) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM d) CROSS JOIN lens WHERE k + n - 1 <= len(w)),
m AS (SELECT doc_id, k, n, item_id FROM dw JOIN iw USING (g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT doc_id, k, n FROM m)) GROUP BY doc_id),
t3 AS (SELECT doc_id, k, list_slice(w, k, k + 2) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS k FROM d WHERE len(w) >= 3)),
i3 AS (SELECT DISTINCT w, j, list_slice(w, j, j + 2) AS g FROM (SELECT DISTINCT w, unnest(range(1, len(w) - 1)) AS j FROM i WHERE len(w) >= 3)),
run AS (SELECT doc_id, w, k - j AS diag, k, k - row_number() OVER (PARTITION BY doc_id, w, k - j ORDER BY k) AS island FROM t3 JOIN i3 USING (g)),
lm AS (SELECT doc_id, count(*) + 2 AS n, min(k) - 1 AS pos FROM run GROUP BY doc_id, w, diag, island
  UNION ALL SELECT m.doc_id, m.n, m.k - 1 FROM m JOIN i ON i.item_id = m.item_id AND len(i.w) = m.n WHERE m.n < 3),
best AS (SELECT doc_id, max(n) AS longest, arg_min(pos, (-n, pos)) AS pos FROM lm GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(longest, 0) AS INTEGER) AS longest_words, CAST(coalesce(pos, -1) AS INTEGER) AS longest_start
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN best USING (doc_id)""",
    "op2_near_duplicates": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, list_slice(w, k, k + 2) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)""",
    "op3_substring_dedup": rf"""
WITH d AS (SELECT doc_id, {_SPACED} AS w FROM documents),
x AS (SELECT doc_id, k, md5(array_to_string(list_slice(w, k, k + 49), ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS k FROM d WHERE len(w) >= 50)),
f AS (SELECT g, min(doc_id) AS first FROM x GROUP BY g),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 50)) AS p FROM x JOIN f USING (g) WHERE first < doc_id),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS t FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(t, ' ' ORDER BY p) AS text FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
    "op4_quality_rules": rf"""
WITH {_RULES}
SELECT doc_id, n_words, word_chars, n_upper, n_symbols, n_lines, n_dup_lines, n_repeat_words, failed_bits, failed_bits & 3 > 0 AS base_failed, failed_bits = 0 AS kept FROM bits""",
    "op11_ranked_search": rf"""
WITH d AS (SELECT doc_id, {_NAMES} AS w FROM documents),
n AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n FROM d WHERE len(w) > 0),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM n),
q AS (SELECT item_id, t, count(*) AS r FROM (SELECT item_id, unnest({_NAMES}) AS t FROM benchmark) GROUP BY item_id, t),
p AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM d) SEMI JOIN q USING (t) GROUP BY doc_id, t),
f AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS weight FROM (SELECT t, count(*) AS df FROM p GROUP BY t) CROSS JOIN s),
m AS (SELECT doc_id, 100 - 25 + (25 * n * docs) // length AS m FROM n CROSS JOIN s),
x AS (SELECT item_id, doc_id, CAST(sum(r * weight * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM q JOIN p USING (t) JOIN f USING (t) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
o AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM x WHERE score > 0)
SELECT * FROM o WHERE rank <= 20""",
    "quality_ablations": rf"""
WITH {_RULES},
p AS (SELECT 'base' AS version, 3 AS mask, 1 AS fails UNION ALL SELECT 'v1', 63, 1 UNION ALL SELECT 'v2-two-faults', 63, 2),
r AS (SELECT * FROM (VALUES ('few_words', 1), ('repeated_words', 2), ('symbols', 4), ('repeated_lines', 8), ('capitals', 16), ('long_words', 32)) AS t(name, bit)),
a AS (SELECT version, CAST(NULL AS VARCHAR) AS without, mask, fails FROM p UNION ALL SELECT version, name, mask - bit, fails FROM p JOIN r ON mask & bit > 0)
SELECT version, without, count(*) AS documents, count(*) FILTER (bit_count(failed_bits & mask) >= fails) AS rejected FROM a CROSS JOIN bits GROUP BY version, without""",
}
