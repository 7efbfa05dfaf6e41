"""The operators as registered queries over their whole tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodespark.llm import bpe, decontaminate, hpy, jaccard, lengths, licences, quality, ring, substring, warc

NORM_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{80}-\x{10FFFF}]+')"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_copies(_read(spark, sf_dir, "documents"))


JACCARD_SQL = rf"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, {NORM_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT r, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) ELSE [array_to_string(w, ' ')] END) AS s FROM w WHERE len(w) > 0),
e AS (SELECT r, len(s) AS n, unnest(s) AS tok FROM s),
p AS (SELECT a.r AS x, b.r AS y, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS ov FROM e a JOIN e b ON a.tok = b.tok AND a.r <> b.r GROUP BY 1, 2),
l AS (SELECT x, y FROM p WHERE ov::DOUBLE / (na + nb - ov) >= 0.5),
reach AS (SELECT DISTINCT x AS a, x AS b FROM l UNION SELECT reach.a, l.y FROM reach JOIN l ON reach.b = l.x),
c AS (SELECT a AS r, min(doc_id) AS class_id FROM reach JOIN w ON w.r = reach.b GROUP BY a)
SELECT doc_id, class_id, n_links FROM w JOIN c USING (r) JOIN (SELECT x AS r, count(*) AS n_links FROM l GROUP BY x) USING (r)
"""


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeats(_read(spark, sf_dir, "documents"))


RAW_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')"
SUBSTRING_SQL = rf"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id, text) AS r, doc_id, {RAW_WORDS} AS w FROM (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL)),
e AS (SELECT r, doc_id, w, unnest(range(0, len(w) - 49)) AS s FROM d WHERE len(w) >= 50),
g AS (SELECT r, doc_id, s, count(*) OVER (PARTITION BY t) AS c, row_number() OVER (PARTITION BY t ORDER BY doc_id, r, s) AS k FROM (SELECT r, doc_id, s, array_to_string(w[s + 1:s + 50], ' ') AS t FROM e)),
i AS (SELECT *, CASE WHEN s - lag(s) OVER p <= 50 THEN 0 ELSE 1 END AS new FROM g WHERE c > 1 WINDOW p AS (PARTITION BY r ORDER BY s)),
n AS (SELECT *, sum(new) OVER (PARTITION BY r ORDER BY s) AS span FROM i),
l AS (SELECT r, span, sum(least(50, coalesce(nxt - s, 50))) AS later_words FROM (SELECT r, span, s, lead(s) OVER (PARTITION BY r ORDER BY s) AS nxt FROM n WHERE k > 1) GROUP BY ALL)
SELECT doc_id, start_word, end_word, end_word - start_word AS n_words, coalesce(later_words, 0)::BIGINT AS later_words
FROM (SELECT r, doc_id, span, min(s) AS start_word, max(s) + 50 AS end_word FROM n GROUP BY ALL) LEFT JOIN l USING (r, span)
"""


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


LEAKS_SQL = rf"""
WITH b AS (SELECT row_number() OVER () AS br, item_id, {NORM_WORDS} AS w FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL)),
n AS (SELECT DISTINCT least(13, len(w)) AS n FROM b WHERE len(w) > 0),
bg AS (SELECT br, item_id, n, unnest(range(0, len(w) - n + 1)) AS i, w FROM b JOIN n ON n.n = least(13, len(w))),
bs AS (SELECT br, item_id, n, i, array_to_string(w[i + 1:i + n], ' ') AS g FROM bg),
d AS (SELECT row_number() OVER () AS dr, doc_id, {NORM_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL),
dg AS (SELECT dr, doc_id, n, w, unnest(range(0, len(w) - n + 1)) AS p FROM d JOIN n ON len(w) >= n),
m AS (SELECT dr, doc_id, br, item_id, bs.n, p, i FROM (SELECT dr, doc_id, n, p, array_to_string(w[p + 1:p + n], ' ') AS g FROM dg) x JOIN bs USING (n, g)),
r AS (SELECT *, p - row_number() OVER (PARTITION BY dr, br, p - i ORDER BY p) AS run FROM m),
s AS (SELECT doc_id, item_id, min(p) AS doc_word, min(i) AS item_word, count(*) + any_value(n) - 1 AS match_words FROM r GROUP BY dr, doc_id, br, item_id, p - i, run)
SELECT doc_id, item_id, match_words, doc_word, item_word FROM s QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY match_words DESC, doc_word, item_word) = 1
"""


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op1_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_read(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.length_histogram(_read(spark, sf_dir, "documents"))


def op4_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring.assign(_read(spark, sf_dir, "documents"))


def op8_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_read(spark, sf_dir, "documents"))


def op5_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.salvage_pages(_read(spark, sf_dir, "pages"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpy.score(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe_encoding": op1_bpe_encoding,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_bounded_ring": op4_bounded_ring,
    "op5_warc_salvage": op5_warc_salvage,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_token_counts": op7_token_counts,
    "op8_licence_scan": op8_licence_scan,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_quality_rules": op10_quality_rules,
}
ORACLE: dict[str, str] = {
    "op2_benchmark_decontamination": LEAKS_SQL,
    "op4_bounded_ring": ring.assign_sql(),
    "op6_ngram_jaccard_join": JACCARD_SQL,
    "op8_licence_scan": licences.scan_sql(),
    "op9_substring_dedup": SUBSTRING_SQL,
}
