"""Whole queries: pattern mining, projection with example sentences, training and use of the tagger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import tokens
from millrace.operators.counting import phrase_counts
from millrace.operators.grammar import Grammar, default_grammar
from millrace.operators.lines import sample_lines
from millrace.operators.lm import BackoffModel, kneser_ney
from millrace.operators.matching import pattern_rows
from millrace.operators.mining import example_rollup, good_patterns, pretty
from millrace.operators.projection import flattened, nested, project, ranked, rendered, with_sentences
from millrace.operators.tagger import tag_lines
from millrace.plans.scratch import materialise


def mine_patterns(sents: DataFrame, vocab: set[str] | None, grammar: Grammar | None = None) -> DataFrame:
    """Tagged sentences to patterns with counts and instances, as in PATTERN_SCHEMA."""
    rows = materialise(pattern_rows(sents, grammar or default_grammar(), vocab), "pattern_rows")
    return pretty(example_rollup(rows, good_patterns(rows)))


def project_patterns(patterns: DataFrame, phrases: DataFrame, sents: DataFrame, sample: int | None = None) -> DataFrame:
    """Patterns and a phrase table to text lines of target patterns with example sentences."""
    rows = with_sentences(ranked(project(patterns, phrases)), sents).withColumn("sents", F.when(F.col("sents").isNotNull(), F.array("sents")))
    table = nested(rows)
    return rendered(flattened(table if sample is None else sample_lines(table, sample)))


def train_tagger(tagged: DataFrame, order: int = 6) -> tuple[DataFrame, DataFrame]:
    """(phrases, language model) from tagged text: words and tags, as arrays."""
    return phrase_counts(tagged), kneser_ney(tagged.select(F.col("tags").alias("words")), order)


def tag_text(lines: DataFrame, phrases: DataFrame, model: DataFrame) -> DataFrame:
    return tag_lines(lines, phrases, BackoffModel.collected(model))


def tagged_lines(records: DataFrame) -> DataFrame:
    """(record, words, tags) from records of words and tags."""
    return records.select("record", tokens(F.get("values", F.lit(0))).alias("words"), tokens(F.get("values", F.lit(1))).alias("tags"))
