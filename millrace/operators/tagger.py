"""Segmenting and tagging unspaced text by phrase lookup and an n-gram model of tags."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import char_tokens, latin_originals, mark_latin, mark_numbers, number_originals, preprocess, restore, squeeze, to_half_width
from millrace.operators.lm import BackoffModel
from millrace.plans.lookup import attach
from millrace.plans.scratch import materialise

LONGEST, BEAM, UNKNOWN_TAG, UNKNOWN_PR = 15, 5, "Nb", -17.0
CUTS = ";!?:。,"


class Hypothesis(NamedTuple):
    """A segmented and tagged stretch; tag_cat shows phrase boundaries."""

    zh: str
    zh_seg: str
    tag: str
    tag_cat: str
    pr: float

    def then(self, other: Hypothesis) -> Hypothesis:
        return Hypothesis(self.zh + other.zh, f"{self.zh_seg} {other.zh_seg}", f"{self.tag} {other.tag}", f"{self.tag_cat} + {other.tag_cat}", self.pr + other.pr)


def best_hypotheses(tokens: list[str], phrases: Mapping[str, list[Hypothesis]], lm: BackoffModel, beam: int = BEAM) -> list[Hypothesis]:
    """The best readings of one clause, worst first.

    From the end backwards, each suffix keeps for each sequence of tags the most probable reading and of those
    the ``beam`` best by phrase and tag model together. An unknown stretch is one noun of -17 a token.
    """
    kept: list[list[Hypothesis]] = [[] for _ in range(len(tokens) + 1)]
    for i in range(len(tokens) - 1, -1, -1):
        best: dict[str, Hypothesis] = {}
        for n in range(min(LONGEST, len(tokens) - i), 0, -1):
            text = "".join(tokens[i : i + n])
            first = phrases.get(text) or [Hypothesis(text, text, UNKNOWN_TAG, UNKNOWN_TAG, UNKNOWN_PR * n)]
            for head in first:
                for whole in [head] if i + n == len(tokens) else [head.then(rest) for rest in kept[i + n]]:
                    if whole.tag not in best or (best[whole.tag].pr, best[whole.tag]) < (whole.pr, whole):
                        best[whole.tag] = whole
        ordered = sorted(best.values(), key=lambda h: h.tag)
        kept[i] = sorted(ordered, key=lambda h: lm[h.tag] + h.pr)[-beam:]
    return kept[0]


def clauses(tokens: list[str]) -> list[list[str]]:
    """Cut after each clause mark."""
    out: list[list[str]] = [[]]
    for t in tokens:
        out[-1].append(t)
        if t in CUTS:
            out.append([])
    return [c for c in out if c]


def token_runs(toks: DataFrame, *keys: str) -> DataFrame:
    """(keys, zh): the distinct runs of up to LONGEST tokens of the arrays ``t``."""
    starts = toks.filter(F.size("t") > 0).select(*keys, "t", F.explode(F.sequence(F.lit(1), F.size("t"))).alias("i"))
    runs = F.transform(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.size("t") - F.col("i") + 1)), lambda n: F.array_join(F.slice("t", F.col("i"), n), ""))
    return starts.select(*keys, F.explode(runs).alias("zh")).distinct()


def needed_phrases(lines: DataFrame, phrases: DataFrame, value: str = "value") -> DataFrame:
    """The phrases whose text occurs in some line: what a lookup table has to hold.

    Substrings of up to LONGEST tokens, distinct, in a semi-join on the phrase table.
    """
    toks = lines.select(char_tokens(preprocess(F.col(value))).alias("t"))
    return phrases.join(token_runs(toks), "zh", "left_semi")


def first_phrases(phrases: DataFrame, most: int = 21) -> DataFrame:
    """At most ``most`` entries for each text, the most probable first (ties by segmentation and tag)."""
    from millrace.operators.counting import best_per_group

    return best_per_group(phrases, ["zh"], [F.desc("pr"), F.col("zh_seg"), F.col("tag")], most)


def table_of(rows: Iterable[Mapping]) -> dict[str, list[Hypothesis]]:
    table: dict[str, list[Hypothesis]] = {}
    for r in rows:
        table.setdefault(r["zh"], []).append(Hypothesis(r["zh"], r["zh_seg"], r["tag"], r["tag"], r["pr"]))
    return table


def with_phrases(rows: DataFrame, phrases: DataFrame) -> DataFrame:
    """rows with _phrases: the phrases that occur in their _tokens. A line's list is bounded by its length."""
    rows = materialise(rows.withColumn("_row", F.monotonically_increasing_id()), "lines_to_tag")
    hits = token_runs(rows.select("_row", F.col("_tokens").alias("t")), "_row").join(phrases, "zh")
    lists = hits.groupBy("_row").agg(F.collect_list(F.struct("zh", "zh_seg", "tag", "pr")).alias("_phrases"))
    return rows.join(lists, "_row", "left").drop("_row")


def tag_lines(lines: DataFrame, phrases: DataFrame, lm: BackoffModel, value: str = "value", most_phrases: int = 3_000_000) -> DataFrame:
    """lines with zh, zh_seg, tag, tag_cat and pr; an empty line gets empty strings and 0.

    Each distinct text is searched once, and its reading joined to the lines that hold it. Only phrases that occur in
    the lines are looked up, in a table that is sent to the executors. More than
    ``most_phrases`` are joined to the lines instead: each line then brings its own table. Folding and placeholders
    are column expressions; the search itself runs in an Arrow function.
    """
    spark = lines.sparkSession
    every, lines = lines, materialise(lines.select(value).distinct(), "texts")
    needed = materialise(needed_phrases(lines, phrases, value).select("zh", "zh_seg", "tag", "pr"), "needed_phrases")
    joined = needed.limit(most_phrases + 1).count() > most_phrases
    shared = spark.sparkContext.broadcast(({} if joined else table_of(r.asDict() for r in needed.collect()), lm))
    folded = lines.repartition(4 * spark.sparkContext.defaultParallelism).withColumn("_folded", to_half_width(squeeze(F.col(value))))
    ready = folded.withColumn("_numbers", number_originals(F.col("_folded"))).withColumn("_marked", mark_numbers(F.col("_folded"))).withColumn("_latin", latin_originals(F.col("_marked"))).withColumn("_tokens", char_tokens(mark_latin(F.col("_marked"))))
    keep = [c for c in ready.columns if c not in ("_folded", "_marked", "_tokens")]
    if joined:
        ready = with_phrases(ready, needed)
    fields = [("zh", pa.string()), ("zh_seg", pa.string()), ("tag", pa.string()), ("tag_cat", pa.string()), ("pr", pa.float64())]

    def tagged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases_of, model = shared.value
        for batch in batches:
            out = []
            own = batch.column("_phrases") if joined else None
            for k, tokens in enumerate(batch.column("_tokens").to_pylist()):
                known = phrases_of if own is None else table_of(own[k].as_py() or [])
                whole = None
                for clause in clauses(tokens or []):
                    best = best_hypotheses(clause, known, model)[-1]
                    whole = best if whole is None else whole.then(best)
                out.append(whole or Hypothesis("", "", "", "", 0.0))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(c, t) for c, (_, t) in zip(cols, fields, strict=True))], [*keep, *(n for n, _ in fields)])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ready.schema if f.name in keep)
    done = ready.mapInArrow(tagged, f"{schema}, zh string, zh_seg string, tag string, tag_cat string, pr double")
    seg = restore(restore(F.col("zh_seg"), "{{CD}}", F.col("_numbers")), "{{FW}}", F.col("_latin"))
    readings = materialise(done.withColumn("zh_seg", seg).drop("_numbers", "_latin"), "readings")
    return attach(every, readings, value, salts=1)
