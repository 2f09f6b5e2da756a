"""Queries of the training-data operators: thin views of their results, and SQL for those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workers import spread
from . import bpe, exact_dedup, language_id, packing, quality, secret_scan, sharding, simhash, toxicity, url_filter

Query = Callable[[SparkSession, str], DataFrame]


def ranks_path() -> str:
    """The public byte-level vocabulary that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table dealt over all cores, for operators whose tasks run Python."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_copies(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(table(spark, sf_dir, "documents"), ranks_path(), public_tokenizers.PATTERN)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), ranks_path())


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("score", "held")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


# What SQL can say of these operators: the fixed parts of their results.


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_quality_rules(spark, sf_dir).select("doc_id", *quality.METRICS[:5], "base_failed")


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_secret_scans(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def shard_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, first and last slot of each shard, and its number of slots."""
    found = op5_sharding(spark, sf_dir).groupBy("shard")
    return found.agg(F.count(F.lit(1)).alias("n"), F.min("slot").alias("low"), F.max("slot").alias("high"), F.countDistinct("slot").alias("slots"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ruled = F.when(F.col("rule").isNotNull(), F.col("verdict"))
    return op10_url_filters(spark, sf_dir).select("page_id", "host", "path", "rule", ruled.alias("ruled"))


def queries() -> dict[str, Query]:
    main = (op1_exact_dedup, op2_byte_bpe, op3_quality_rules, op4_secret_scans, op5_sharding, op6_language_id, op7_simhash, op8_toxicity, op9_packing, op10_url_filters, pipeline)
    return {f.__name__: f for f in (*main, quality_counts, secret_counts, shard_balance, url_rules)}


_SPACE = "[\\x20\\x09-\\x0D]"
_WORD = "[^\\x20\\x09-\\x0D]+"

_OP1 = f"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '{_SPACE}', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept,
       text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)
"""

_QUALITY = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i, len(words) AS n FROM d),
s AS (SELECT doc_id, i, string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS s, n FROM w),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS k FROM s WHERE i <= n - 7) WHERE k > 1),
r AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, range(8) t(j) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{_WORD}') GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m
"""

_SECRETS = """
SELECT doc_id,
  CAST(len([x for x in regexp_extract_all(coalesce(text, ''), '(?i:password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1) if length(x) >= 8]) AS BIGINT) AS n_assign,
  CAST(len([x for x in regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+') if length(x) >= 16]) AS BIGINT) AS n_access,
  CAST(len([x for x in regexp_extract_all(coalesce(text, ''), '[0-9a-f]+') if length(x) >= 32]) AS BIGINT) AS n_hex
FROM documents
"""

_SHARDS = """
WITH c AS (SELECT count(*) AS n FROM documents), q AS (SELECT CAST(i AS INTEGER) AS shard, n // 16 + CASE WHEN i < n % 16 THEN 1 ELSE 0 END AS n FROM c, range(16) t(i))
SELECT shard, CAST(n AS BIGINT) AS n, CAST(0 AS BIGINT) AS low, CAST(n - 1 AS BIGINT) AS high, CAST(n AS BIGINT) AS slots FROM q WHERE n > 0
"""

_RULES = """
WITH r(ruled, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path FROM u)
SELECT page_id, host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(ruled, length(h || p)) AS ruled
FROM s LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id, host, path
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": _OP1, "quality_counts": _QUALITY, "secret_counts": _SECRETS, "shard_balance": _SHARDS, "url_rules": _RULES}
