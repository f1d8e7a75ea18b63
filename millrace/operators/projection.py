"""Projection of patterns across word alignments, ranking, and example sentences."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.sequences import locate_run, ngrams, numbered
from millrace.functions.text import tokens

#: Tags that must be aligned, and that stand for themselves in a target pattern.
IMPORTANT = (
    "V ADJP sth1 sth2 sth adjp advp inf wh doing adj ADJ ADJER ADJERP ADJEST adv do done N one's oneself prep -thing v-link"
).split()
#: A pattern is kept if it holds one of these as a substring.
SLOTS = "sth inf sth1 sth2 v-link advp adjp wh do doing done one's oneself prep -thing".split()
LEAST_PROBABILITY = 1e-10


def numbered_tags(tags: Column) -> Column:
    """A map from position to tag: tags that occur more than once get 1, 2, ... by ascending position."""
    entries = F.array_sort(F.map_entries(tags))
    return F.map_from_arrays(F.transform(entries, lambda e: e["key"]), numbered(F.transform(entries, lambda e: e["value"])))


def numbered_pattern(pattern: Column) -> Column:
    return F.array_join(numbered(tokens(pattern)), " ")


def phrase_bigrams(phrases: DataFrame) -> DataFrame:
    """phrases with a row for each bigram of ``en`` (repeats included) as ``bigram``."""
    return phrases.withColumn("bigram", F.explode(ngrams(tokens(F.col("en")), 2)))


def containing_phrases(instances: DataFrame, phrases: DataFrame, text: str = "instance") -> DataFrame:
    """Instances joined with the phrases that contain them, alignments moved to the instance's words.

    The instance's first two words meet the phrases' bigrams in an equi-join; containment is only
    tested on what meets. A one-word instance finds nothing.
    """
    words = tokens(F.col(text))
    asked = instances.withColumn("_words", words).filter(F.size("_words") >= 2).withColumn("bigram", F.array_join(F.slice("_words", 1, 2), " "))
    met = asked.join(phrase_bigrams(phrases), "bigram").withColumn("_en", tokens(F.col("en")))
    inside = F.contains(F.concat(F.lit(" "), "en", F.lit(" ")), F.concat(F.lit(" "), F.col(text), F.lit(" ")))
    placed = met.filter(inside).withColumn("_start", locate_run(F.col("_en"), F.col("_words")))
    within = F.map_filter("aligns", lambda k, v: (k >= F.col("_start")) & (k < F.col("_start") + F.size("_words")))
    return placed.withColumn("aligns", F.transform_keys(within, lambda k, v: k - F.col("_start"))).drop("_words", "_en", "_start", "bigram")


def target_pattern(tags: dict[int, str], aligns: dict[int, list[int]], words: list[str]) -> str | None:
    """The tags laid over the target words; null if an important tag is not aligned, an alignment is out of
    range, or a word already stands for an important tag."""
    placed: list[tuple[int, str]] = []
    taken: set[int] = set()
    aligned = [(tag, aligns.get(at)) for at, tag in tags.items()]
    if any(ends is None and tag in IMPORTANT for tag, ends in aligned):
        return None
    if any(end >= len(words) for _, ends in aligned for end in ends or ()):
        return None
    for tag, ends in aligned:
        if ends is None:
            continue
        if taken.intersection(ends):
            return None
        important = tag in IMPORTANT
        if important:
            taken.update(ends)
        if important and not tag.isupper():
            placed += [(end, tag) for end in ends[:1]]
        else:
            placed += [(end, f"{words[end]}:{tag}") for end in ends]
    return " ".join(text for _, text in sorted(placed, key=lambda p: p[0]))


def project(patterns: DataFrame, phrases: DataFrame) -> DataFrame:
    """(keyword, keyword_count, pattern, pattern_count, ch_pattern, phrase_prob, lex_prob, prob, en_phrase, ch_phrase).

    patterns as in PATTERN_SCHEMA; a row for each instance and phrase that contains it with a target
    pattern. The order-dependent fold over tags runs in an Arrow function, after the join.
    """
    one = patterns.withColumn("pattern", numbered_pattern(F.col("pattern"))).select("keyword", "keyword_count", "pattern", "pattern_count", F.explode("instances").alias("i"))
    asked = one.select("keyword", "keyword_count", "pattern", "pattern_count", F.col("i.instance").alias("instance"), numbered_tags(F.transform_keys("i.tag", lambda k, v: k.cast("int"))).alias("tags"))
    met = containing_phrases(asked, phrases).withColumn("_ch", tokens(F.col("ch")))
    columns = [c for c in met.columns if c not in ("tags", "aligns", "_ch")]

    def laid(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(n).to_pylist() for n in ("tags", "aligns", "_ch")), strict=True)
            out = [target_pattern(dict(t), dict(a), w) for t, a, w in rows]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in columns), pa.array(out, pa.string())], [*columns, "ch_pattern"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in met.schema if f.name in columns)
    s = [F.get("scores", F.lit(i)) for i in range(4)]
    done = met.mapInArrow(laid, f"{schema}, ch_pattern string").filter("ch_pattern is not null and ch_pattern <> ''")
    return done.select("keyword", "keyword_count", "pattern", "pattern_count", "ch_pattern", (s[0] * s[2]).alias("phrase_prob"), (s[1] * s[3]).alias("lex_prob"), (s[0] * s[1] * s[2] * s[3]).alias("prob"), F.col("en").alias("en_phrase"), F.col("ch").alias("ch_phrase"))


def has_slot(pattern: Column) -> Column:
    out = F.lit(False)
    for slot in SLOTS:
        out |= F.contains(pattern, F.lit(slot))
    return out


def ranked(projected: DataFrame, least: float = LEAST_PROBABILITY, slots: bool = True) -> DataFrame:
    """Of each (keyword, pattern) and target pattern the most probable row, if above ``least``; slots keeps
    patterns with a slot only. Ties: smallest phrases. A partial minimum per group, no sort of the input."""
    rows = projected.filter(has_slot(F.col("pattern"))) if slots else projected
    keys = ["keyword", "pattern", "ch_pattern"]
    order = F.struct((-F.col("prob")).alias("_m"), "en_phrase", "ch_phrase", *(c for c in rows.columns if c not in (*keys, "en_phrase", "ch_phrase")))
    best = rows.filter(F.col("prob") > least).groupBy(*keys).agg(F.min(order).alias("b"))
    return best.select(*keys, "b.*").drop("_m").select(*rows.columns)


def nested(rows: DataFrame) -> DataFrame:
    """One row for each (keyword, pattern), ch_patterns by falling probability, then text."""
    rest = [c for c in rows.columns if c not in ("keyword", "keyword_count", "pattern", "pattern_count")]
    lists = rows.groupBy("keyword", "keyword_count", "pattern", "pattern_count").agg(F.array_sort(F.collect_list(F.struct((-F.col("prob")).alias("_m"), *rest))).alias("_c"))
    return lists.select("keyword", "keyword_count", "pattern", "pattern_count", F.transform("_c", lambda x: F.struct(*(x[c].alias(c) for c in rest))).alias("ch_patterns"))


def sentence_matches(phrases: DataFrame, sents: DataFrame) -> DataFrame:
    """(phrase_id, line_no): sentence pairs that hold all bigrams of ``en_phrase`` and both phrases as substrings.

    phrases: phrase_id, en_phrase, ch_phrase. sents: line_no, en, ch. Each bigram of a phrase meets the
    inverted index of sentences once; a pair that meets on all of them is tested.
    """
    asked = phrases.select("phrase_id", F.array_distinct(ngrams(tokens(F.col("en_phrase")), 2)).alias("_b")).select("phrase_id", F.size("_b").alias("_n"), F.explode("_b").alias("gram"))
    index = sents.select("line_no", F.explode(F.array_distinct(ngrams(tokens(F.col("en")), 2))).alias("gram"))
    rare = index.join(asked.select("gram").distinct(), "gram", "left_semi")
    met = asked.join(rare, "gram").groupBy("phrase_id", "line_no", "_n").agg(F.count("*").alias("k")).filter("k = _n")
    tested = met.select("phrase_id", "line_no").join(phrases, "phrase_id").join(sents, "line_no")
    return tested.filter(F.contains("en", F.col("en_phrase")) & F.contains("ch", F.col("ch_phrase"))).select("phrase_id", "line_no", "en", "ch")


def with_sentences(rows: DataFrame, sents: DataFrame) -> DataFrame:
    """rows with sents: the first sentence pair of each phrase as [en, ch]; null without one."""
    phrases = rows.select("en_phrase", "ch_phrase").distinct().withColumn("phrase_id", F.xxhash64("en_phrase", "ch_phrase"))
    first = sentence_matches(phrases, sents).groupBy("phrase_id").agg(F.min(F.struct("line_no", "en", "ch")).alias("s")).select("phrase_id", F.array("s.en", "s.ch").alias("sents"))
    return rows.withColumn("phrase_id", F.xxhash64("en_phrase", "ch_phrase")).join(first, "phrase_id", "left").drop("phrase_id")


def flattened(table: DataFrame) -> DataFrame:
    """(en_pattern, ch_pattern, prob, sents): one row for each target pattern, its first sentence pair."""
    return table.select(F.col("pattern").alias("en_pattern"), F.explode("ch_patterns").alias("c")).select("en_pattern", "c.ch_pattern", "c.prob", F.get("c.sents", F.lit(0)).alias("sents"))


def rendered(flat: DataFrame) -> DataFrame:
    """(value): a pattern line and its sentences; missing sentences are empty."""
    line = F.concat(F.lit(" |||  ||| "), "en_pattern", F.lit(" ||| "), "ch_pattern", F.lit(" ||| "), F.col("prob").cast("string"), F.lit("\n"))
    sent = lambda i: F.coalesce(F.get("sents", F.lit(i)), F.lit(""))
    return flat.select(F.concat(line, sent(0), sent(1)).alias("value"))


def flat_tsv(flat: DataFrame) -> DataFrame:
    """(value): TAB, en, ch and prob, without quotes."""
    return flat.select(F.replace(F.concat_ws("\t", F.lit(""), "en_pattern", "ch_pattern", F.col("prob").cast("string")), F.lit('"'), F.lit("")).alias("value"))
