"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, langid, mixing, pii, quality, simhash, suffix, topk, wrapper


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(_table(spark, sf_dir, "documents"))


def op2_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), words=3, distance=2)


def op4_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate_perspectives(_table(spark, sf_dir, "conversations"))


def op5_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymised(_table(spark, sf_dir, "documents").select("doc_id", "text"), pii.key_of(spark))


def op6_html_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extracted(_table(spark, sf_dir, "pages"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.deduplicated(_table(spark, sf_dir, "documents"))


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.range_sorted(mixing.mix_plan(_table(spark, sf_dir, "documents")))
    return plan.select("doc_id", "size", "source_size", "target", "taken", F.round("position", 6).alias("position"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_language_id, op2_quality_pu, op3_simhash_dedup, op4_chat_rotation, op5_pii_pseudonyms, op6_html_wrapper, op7_suffix_dedup, op8_topk_search, op9_decontaminate, op10_mix_sources)
}

_OP4 = r"""
WITH t AS (
  SELECT conv_id, turn, role, replace(coalesce(text, ''), '<|', '< |') AS text, text AS raw,
         role IS NULL OR role = 'system' AS context, row_number() OVER () AS id
  FROM conversations WHERE conv_id IS NOT NULL),
who AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE NOT context),
seg AS (
  SELECT t.*, perspective,
         CASE WHEN context THEN 'system' WHEN role = perspective THEN 'assistant' ELSE 'user' END AS role_as
  FROM t JOIN who USING (conv_id)),
named AS (
  SELECT *, CASE WHEN role_as = 'user' THEN role END AS name,
         '<|im_start|>' || role_as || CASE WHEN role_as = 'user' THEN ' name=' || replace(replace(role, '<|', '< |'), chr(10), ' ') ELSE '' END || chr(10) AS header
  FROM seg),
placed AS (
  SELECT *, header || text || '<|im_end|>' || chr(10) AS segment,
         row_number() OVER w - 1 AS seq,
         coalesce(sum(length(header || text || '<|im_end|>' || chr(10))) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg_start
  FROM named WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, role NULLS FIRST, raw NULLS FIRST, id))
SELECT conv_id, perspective, CAST(seq AS BIGINT) AS seq, turn, role_as, name, segment, role_as = 'assistant' AS trained,
       CAST(seg_start AS BIGINT) AS seg_start,
       CAST(seg_start + length(header) AS BIGINT) AS mask_start,
       CAST(seg_start + length(header) + CASE WHEN role_as = 'assistant' THEN length(text) + 10 ELSE 0 END AS BIGINT) AS mask_end
FROM placed
"""

_OP8 = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""

_OP9 = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (
  SELECT item_id, row_number() OVER () AS iid, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
isz AS (SELECT *, least(5, len(w)) AS n FROM i WHERE len(w) > 0),
ish AS (
  SELECT DISTINCT iid, item_id, n, array_to_string(w[j:j + n - 1], ' ') AS shingle
  FROM (SELECT *, unnest(generate_series(1, len(w) - n + 1)) AS j FROM isz)),
cnt AS (SELECT iid, count(*) AS n_shingles FROM ish GROUP BY iid),
dsh AS (
  SELECT DISTINCT rid, doc_id, n, array_to_string(w[j:j + n - 1], ' ') AS shingle
  FROM (SELECT d.*, k.n, unnest(generate_series(1, len(w) - k.n + 1)) AS j FROM d, (SELECT DISTINCT n FROM isz) k WHERE len(w) >= k.n))
SELECT doc_id, item_id, n_shingles, n_shared, n_shared / n_shingles AS containment
FROM (SELECT rid, any_value(doc_id) AS doc_id, iid, any_value(item_id) AS item_id, count(*) AS n_shared FROM dsh JOIN ish USING (n, shingle) GROUP BY rid, iid)
JOIN cnt USING (iid)
WHERE n_shared >= 0.8 * n_shingles
"""

_OP10 = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS idx FROM s),
w AS (SELECT *, idx % 3 AS kind, CASE idx % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM n),
r AS (SELECT *, CAST(3 * source_size AS DOUBLE) / weight AS rate FROM w),
l AS (
  SELECT *, sum(source_size) OVER () AS total,
         coalesce(sum(3 * source_size) OVER (ORDER BY rate, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(weight) OVER (ORDER BY rate, idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM r),
t AS (
  SELECT source, source_size, kind,
         least(CAST(3 * source_size AS DOUBLE), max(CAST(total - before AS DOUBLE) / rest) OVER () * weight) AS target FROM l),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.kind, t.target,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (
  SELECT *, CAST(floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) AS BIGINT) AS whole FROM p),
e AS (
  SELECT *, CASE WHEN size > 0 THEN whole + CAST((start + size / 2.0::DOUBLE) <= target - CAST(whole * source_size AS DOUBLE) AND whole < 3 AS BIGINT) ELSE 0 END AS copies,
         least(CASE WHEN target > 0 THEN start / target END, 1.0::DOUBLE) AS y FROM c)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken,
       CASE WHEN copies > 0 THEN round(round(least(greatest(
         CASE kind WHEN 0 THEN 2.0::DOUBLE * y / (1.5::DOUBLE + sqrt(greatest(2.25::DOUBLE - 2.0::DOUBLE * y, 0.0::DOUBLE)))
                   WHEN 1 THEN 2.0::DOUBLE * y / (1.0::DOUBLE + sqrt(1.0::DOUBLE))
                   ELSE 2.0::DOUBLE * y / (0.5::DOUBLE + sqrt(0.25::DOUBLE + 2.0::DOUBLE * y)) END, 0.0::DOUBLE), 1.0::DOUBLE), 9), 6) END AS position
FROM e
"""

ORACLE_SQL: dict[str, str] = {"op4_chat_rotation": _OP4, "op8_topk_search": _OP8, "op9_decontaminate": _OP9, "op10_mix_sources": _OP10}
