"""Evaluation: word differences between outputs, error spans, and article matching."""

from __future__ import annotations

import difflib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.sequences import overlap_score
from millrace.functions.text import tokens


def word_diff(a: list[str], b: list[str]) -> str:
    """a and b as one text: words of a alone in [-...-], of b alone in {+...+}."""
    out = []
    for kind, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if kind == "equal":
            out += a[i:j]
        else:
            out += [f"[-{' '.join(a[i:j])}-]"] * (j > i) + [f"{{+{' '.join(b[k:m])}+}}"] * (m > k)
    return " ".join(out)


def diff_lines(pairs: DataFrame, a: str = "src", b: str = "tgt") -> DataFrame:
    """(line_no, value): word_diff of each pair of lines."""

    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [word_diff((x or "").split(), (y or "").split()) for x, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines, pa.string())], ["line_no", "value"])

    return pairs.select(F.col("line_no").cast("long"), a, b).mapInArrow(made, "line_no bigint, value string")


def error_spans(lines: DataFrame, value: str = "value") -> DataFrame:
    """(line_no, span): each replaced span [-...-] {+...+}."""
    return lines.select("line_no", F.explode(F.regexp_extract_all(value, F.lit(r"(\[-.*?-\] \{\+.*?\+\})"), F.lit(1))).alias("span"))


def error_words(spans: DataFrame) -> DataFrame:
    """(line_no, word): the words that were replaced."""
    return spans.select("line_no", F.explode(tokens(F.regexp_extract("span", r"^\[-(.*)-\]", 1))).alias("word"))


def article_score(en: Column, ch: Column, translate) -> Column:
    """Mean of the overlap scores of sentence pairs, per English token; null unless the counts agree.

    en, ch: arrays of sentences. translate: a function of a column that gives a sentence's tokens in English; what
    translates is up to the caller.
    """
    words = lambda s: tokens(F.lower(s))
    scores = F.zip_with(en, ch, lambda a, b: overlap_score(words(a), translate(b)))
    total = F.aggregate(scores, F.lit(0.0), lambda s, x: s + x)
    n = F.aggregate(en, F.lit(0), lambda s, x: s + F.size(words(x)))
    return F.when((F.size(en) == F.size(ch)) & (n > 0), total / n)


def split_articles(articles: DataFrame, translate, en: str = "en", ch: str = "ch") -> DataFrame:
    """(article_id, at, score, en, ch): sentence pairs of the articles whose sentence counts agree."""
    scored = articles.withColumn("score", article_score(F.col(en), F.col(ch), translate)).filter("score is not null")
    pairs = F.arrays_zip(F.col(en).alias("a"), F.col(ch).alias("b"))
    return scored.select("article_id", "score", F.posexplode(pairs).alias("at", "p")).select("article_id", "at", "score", F.col("p.a").alias("en"), F.col("p.b").alias("ch"))
