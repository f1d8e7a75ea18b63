"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.bpe import encode_documents
from millrace.llm.common import table
from millrace.llm.exact_dedup import exact_dedup
from millrace.llm.jaccard_join import near_components
from millrace.llm.language_id import identify
from millrace.llm.mixing import mix_sources
from millrace.llm.quality_classifier import score_quality
from millrace.llm.quality_rules import quality_rules
from millrace.llm.substring_dedup import substring_dedup
from millrace.llm.token_store import read_summaries, write_store
from millrace.llm.url_filter import filter_urls
from millrace.plans.scratch import new_path


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "store")
    write_store(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), path)
    return read_summaries(spark, path)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    all_of_them = (
        op1_substring_dedup, op2_mixing, op3_url_filter, op4_bpe, op5_exact_dedup, op6_quality_rules,
        op7_token_store, op8_quality_classifier, op9_language_id, op10_jaccard_join,
    )
    return {f.__name__: f for f in all_of_them}


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": OP5}


OP5 = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS t
  FROM documents)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
FROM (
  SELECT doc_id, sha256(t) AS text_sha256,
         first_value(doc_id) OVER (PARTITION BY t ORDER BY points DESC, doc_id NULLS FIRST
           ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
         count(*) OVER (PARTITION BY t) AS group_size
  FROM n)
"""
