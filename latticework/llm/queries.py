"""The queries of the training-data operators, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, katz, mixing, near_dedup, packing, quality, token_count, toxicity, training_order, url_filter

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op5_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.similar(table(spark, sf_dir, "documents"), words=3, percent=85, bands=24, rows=5)


def op7_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.materialise(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.report(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_url_filter, op2_toxicity, op3_token_counts, op4_quality_rules, op5_katz, op6_near_dedup, op7_training_order, op8_exact_dedup, op9_packing, op10_mixing)}

OP1_SQL = r"""
WITH cut AS (
  SELECT page_id,
         CASE WHEN contains(url, '://') THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
rules(rule, verdict, h, p) AS (VALUES
  ('net/', 'block', 'net', '/'), ('example.net/en/', 'allow', 'example.net', '/en/'),
  ('example.com/de/', 'block', 'example.com', '/de/'), ('org/fr/', 'allow', 'org', '/fr/')),
fits AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM cut JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT cut.page_id, host, path, fits.rule,
       CASE WHEN fits.verdict IS NOT NULL THEN fits.verdict
            WHEN contains(host, 'spam-farm.') OR contains(host, 'cheap-pills.') OR contains(host, 'casino') OR contains(host, 'free-downloads.')
              OR contains(path, 'sessionid=') THEN 'block' ELSE 'allow' END AS verdict
FROM cut LEFT JOIN fits ON cut.page_id = fits.page_id
"""

OP10_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
whole AS (SELECT source, sum(size)::BIGINT AS n FROM sizes GROUP BY source),
ranked AS (SELECT source, n, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM whole),
-- those that reach three times their size first, by size for each weight; k of them are held there
held AS (
  SELECT *, row_number() OVER o AS k, 3 * coalesce(sum(n) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held_n,
         sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS free_w,
         sum(n) OVER () AS total
  FROM ranked WINDOW o AS (ORDER BY n::DOUBLE / w, source NULLS LAST)),
level AS (SELECT (total - held_n)::DOUBLE / free_w::DOUBLE AS share FROM held WHERE w * ((total - held_n)::DOUBLE / free_w::DOUBLE) < 3 * n ORDER BY k LIMIT 1),
targets AS (
  SELECT source, n AS source_size, CASE WHEN w * coalesce((SELECT share FROM level), 0) >= 3 * n THEN (3 * n)::DOUBLE ELSE w * (SELECT share FROM level) END AS target FROM ranked),
rates AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM targets)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':mix-1'), 1, 8))::BIGINT / 4294967296.0 < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sizes JOIN rates ON sizes.source IS NOT DISTINCT FROM rates.source
"""

OP8_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS n FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY n) AS group_size, doc_id IS NOT DISTINCT FROM first_value(doc_id) OVER w AS kept, sha256(n) AS text_sha256
FROM t WINDOW w AS (PARTITION BY n ORDER BY length(text) DESC, doc_id NULLS LAST)
"""

ORACLE_SQL: dict[str, str] = {"op1_url_filter": OP1_SQL, "op8_exact_dedup": OP8_SQL, "op10_mixing": OP10_SQL}
