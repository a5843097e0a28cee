"""The registered queries of the corpus operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cardwatch.llm import exact_dedup, fingerprint, language, mixing, near_dedup, packing, periodic_runs, prefix_trie, quality, sharding, suffix_dedup, tokens, toxicity


TOKENIZER = "byte_bpe_50k.json"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_by_bytes(_table(spark, folder, "documents"))


def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, folder, "documents"))


def op4_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_scores(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify_languages(_table(spark, folder, "documents"))


def op2_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, folder, "documents"))


def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.token_counts(_table(spark, folder, "documents"), public_tokenizers.path(TOKENIZER))


def op7_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint.fingerprints(_table(spark, folder, "documents"))


def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents"), public_tokenizers.path(TOKENIZER))


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.interleave(_table(spark, folder, "documents"))


def op10_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.repeats_removed(_table(spark, folder, "documents"))


def op11_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity_scores(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic_runs.run_report(_table(spark, folder, "documents"), tails=True)


def op13_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.prefix_trie(_table(spark, folder, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_near_dedup": op2_near_dedup,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_language_id": op5_language_id,
    "op6_token_counts": op6_token_counts,
    "op7_fingerprints": op7_fingerprints,
    "op8_packing": op8_packing,
    "op9_mixing": op9_mixing,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_toxicity": op11_toxicity,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_conversation_trie": op13_conversation_trie,
}

ORACLE = {
    "op3_exact_dedup": r"""
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY digest) AS keep_id,
       count(*) OVER (PARTITION BY digest) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY digest) AS kept,
       digest AS text_sha256
FROM (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS digest FROM documents) d
""",
    "op13_conversation_trie": r"""
WITH own AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, role, text) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), headed AS (  -- h: the checksum of the id, one byte and one bit at a time
  SELECT conv_id, turns, conv_id - ((conv_id % 100) + 100) % 100 AS base,
         xor(list_reduce(
               list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
               lambda a, x: list_reduce(
                 list_prepend(xor(a, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                 lambda b, z: CASE WHEN b & 1 = 1 THEN xor(b >> 1, 3988292384::BIGINT) ELSE b >> 1 END)
             ), 4294967295::BIGINT) % 6 AS h
  FROM own
), rebuilt AS (
  SELECT a.conv_id, list_concat(coalesce(list_slice(b.turns, 1, a.h), []), list_slice(a.turns, a.h + 1, len(a.turns))) AS seq
  FROM headed a LEFT JOIN own b ON b.conv_id = a.base
), members AS (
  SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS depth FROM rebuilt
), nodes AS (
  SELECT list_slice(seq, 1, depth) AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len(seq) = depth), '')) AS ends_sha256
  FROM members GROUP BY 1, 2
), linked AS (
  SELECT n.*, list_slice(node, 1, depth - 1) AS above, CASE WHEN depth > 0 THEN (n_convs - 1) * length(node[depth].text) ELSE 0 END AS saved
  FROM nodes n
), families AS (
  SELECT above, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY above
), counted AS (
  SELECT l.*, coalesce(f.n_children, 0) AS n_children FROM linked l LEFT JOIN families f ON f.above = l.node
), subtrees AS (
  SELECT list_slice(node, 1, d) AS node, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT node, n_children, saved, unnest(range(0, depth + 1)) AS d FROM counted) x GROUP BY 1
)
SELECT c.conv_id, c.depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children,
       CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, c.ends_sha256
FROM counted c JOIN subtrees s ON s.node = c.node LEFT JOIN nodes p ON c.depth > 0 AND p.node = c.above
""",
}
