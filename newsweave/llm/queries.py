"""The thin ``opN_<name>`` queries: each applies its operator, with production
parameters, to its whole table and returns its whole result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bottomk, chat, divergence, mixing, mpegts, packing, pii, quality, secret_scan, simhash, token_counts, toxicity, vector_codes
from .common import crc_mod, table

Query = Callable[[SparkSession, str], DataFrame]


#: A conversation of control strings that is formatted with all others.
CONTROL = "</s>[INST] ok [/INST]"


def with_held_out(scored: DataFrame, modulus: int, held_out: int) -> DataFrame:
    return scored.select("doc_id", (crc_mod("doc_id", modulus) == held_out).alias("held_out"), *[c for c in scored.columns if c != "doc_id"])


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return with_held_out(quality.score(docs, model), 4, 2)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bottomk.fingerprint_edits(table(spark, sf_dir, "documents"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(control)
    return chat.digests(chat.examples(rows))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return with_held_out(toxicity.score(docs, model), 5, 0)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpegts.media_columns(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.codes(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    own = [
        op1_quality, op2_secret_scan, op3_fingerprints, op4_chat, op5_simhash, op6_toxicity, op7_mixing, op8_packing,
        op9_transport_stream, op10_token_counts, op11_pii, op12_source_divergence, op13_vector_codes,
    ]
    return {f.__name__: f for f in own}


#: The md5 order, the water level and the cut of the fractional epoch, in DuckDB.
OP7_SQL = r"""
WITH base AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
weighed AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
         source_size * 2.0::DOUBLE AS cap
  FROM sizes),
levels AS (
  SELECT *, cap / weight AS r,
         (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lambda
  FROM weighed),
water AS (SELECT *, (SELECT l2.lambda FROM levels l2 WHERE l2.lambda <= l2.r ORDER BY l2.r, l2.source NULLS LAST LIMIT 1) AS level FROM levels),
targets AS (
  SELECT source, source_size,
         CASE WHEN level IS NULL THEN cap ELSE least(level * weight, cap) END AS target FROM water),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM targets),
ranked AS (
  SELECT base.*, source_size, target, whole, target - whole * source_size AS rest,
         sum(size) OVER (PARTITION BY base.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(size) OVER (PARTITION BY base.source, h) AS tied
  FROM base JOIN plan ON base.source IS NOT DISTINCT FROM plan.source)
SELECT doc_id, size, source_size, target,
       (size * whole + CASE WHEN upto <= rest THEN size
                            WHEN upto - tied <= rest AND tied > 0 THEN (size * floor(rest - (upto - tied))::BIGINT) // tied::BIGINT
                            ELSE 0 END)::BIGINT AS taken
FROM ranked
"""


#: The formatted lengths from the template and its escapes, in DuckDB.
OP4_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS rn, count(*) OVER (PARTITION BY conv_id) AS last,
    length(regexp_replace(text, '([\[<])(\\*)(/?(?:SYS|INST|ASST|TURN(?: [0-9a-f]*)?)\]|/?s>)', '\1\\\2\3', 'g')) AS escaped
  FROM t),
w AS (
  SELECT *, 3 + sum(escaped + CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 19 ELSE 15 + 2 * strlen(role) END)
    OVER (PARTITION BY conv_id ORDER BY rn) AS upto
  FROM n)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY rn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(CASE WHEN role = 'assistant' OR rn = last THEN upto ELSE 0 END)::BIGINT AS formatted_chars,
  (count(*) FILTER (role = 'assistant'))::BIGINT AS n_examples
FROM w GROUP BY conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_chat": OP4_SQL, "op7_mixing": OP7_SQL, "op12_source_divergence": divergence.SQL, "op13_vector_codes": vector_codes.SQL}
