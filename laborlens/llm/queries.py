"""The corpus operators over the test tables, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, extract, lm, quality, rules, simhash, substrings, toxicity
from .common import table

TOKENIZER = "word_bpe_49k.json"


def op1_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return quality.graded(table(spark, sf_dir, "documents"), labels)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extracted(table(spark, sf_dir, "pages"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT -7L AS conv_id, t.turn, t.role, '{said}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    return chat.digests(chat.formatted(turns.unionByName(extra)))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.tokenized(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), with_ids=False)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.deduplicated(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return toxicity.graded(table(spark, sf_dir, "documents"), labels)


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash_near_duplicates,
        op2_quality_classifier,
        op3_html_extraction,
        op4_chat_formatting,
        op5_bpe,
        op6_substring_dedup,
        op7_quality_rules,
        op8_decontamination,
        op9_lm_scoring,
        op10_toxicity,
    )
}

ORACLES = {
    "op4_chat_formatting": """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
o AS (SELECT *, row_number() OVER w AS i, lag(role) OVER w AS before, lead(role) OVER w AS after FROM c
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
p AS (SELECT *, CASE WHEN after = role THEN 0 WHEN role = 'assistant' THEN 7 ELSE 3 END AS closed,
  length(text) + length(regexp_replace(text, '[^\\\\\\[\\]<]', '', 'g')) + length(role) + length(regexp_replace(role, '[^\\\\\\[\\]<]', '', 'g')) + 3 AS chars FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256, (3 + sum(chars + closed))::BIGINT AS formatted_chars
FROM p GROUP BY conv_id""".replace("\\\\", "\\"),
    "op6_substring_dedup": substrings.ORACLE,
    "op7_quality_rules": rules.ORACLE,
    "op8_decontamination": decontaminate.ORACLE,
}
