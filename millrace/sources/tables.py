"""Structured sources and sinks: phrase tables, lexical tables, JSON, templates, command-line formats."""

from __future__ import annotations

import json
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.sequences import align_map, slash_joined

PATTERN_SCHEMA = "keyword string, keyword_count bigint, pattern string, pattern_count bigint, instances array<struct<instance string, tag map<string,string>>>"
PROJECTED_SCHEMA = (
    "keyword string, keyword_count bigint, pattern string, pattern_count bigint, ch_patterns array<struct<"
    "ch_pattern string, phrase_prob double, lex_prob double, prob double, en_phrase string, ch_phrase string, sents array<array<string>>>>"
)
TABLES = {"toktag": "zh string, zh_seg string, tag string, count int, pr double", "lexical": "src string, tgt string, prob double"}


def phrase_table(lines: DataFrame, reverse: bool = False) -> DataFrame:
    """(line_no, en, ch, aligns, scores) of ``en ||| ch ||| scores ||| i-j ...`` lines.

    Four scores stay. reverse swaps the languages, the two pairs of scores and the alignments.
    """
    f = F.split("value", r" \|\|\| ")
    part = lambda i: F.get(f, F.lit(i))
    scores = F.transform(F.slice(F.filter(F.split(part(2), r"\s+"), lambda x: x != ""), 1, 4), lambda x: x.cast("double"))
    pairs = F.filter(F.split(part(3), r"\s+"), lambda x: x != "")
    en, ch = part(0), part(1)
    if reverse:
        en, ch = ch, en
        scores = F.concat(F.slice(scores, 3, 2), F.slice(scores, 1, 2))
        pairs = F.transform(pairs, lambda p: F.concat_ws("-", F.split_part(p, F.lit("-"), F.lit(2)), F.split_part(p, F.lit("-"), F.lit(1))))
    return lines.select("line_no", F.trim(en).alias("en"), F.trim(ch).alias("ch"), align_map(pairs).alias("aligns"), scores.alias("scores"))


def lexical_table(lines: DataFrame) -> DataFrame:
    """(src, tgt, prob): first token, what lies between, last token."""
    take = lambda i: F.regexp_extract("value", r"^(\S+) (.*) (\S+)$", i)
    return lines.select(take(1).alias("src"), take(2).alias("tgt"), take(3).cast("double").alias("prob"))


def read_json_lines(spark: SparkSession, path: str, schema: str = PATTERN_SCHEMA, document: bool = False) -> DataFrame:
    """JSON objects, one a line, or one array of them; what doesn't fit the schema raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", document).json(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", "false").json(path)


def write_json_document(df: DataFrame, path: str) -> None:
    """One JSON array in one file. The rows pass through the driver one partition at a time; for large
    results write_json_lines is the sink to use."""
    with open(path, "w", encoding="utf-8") as f:
        f.write("[")
        for i, row in enumerate(df.toJSON().toLocalIterator() if hasattr(df, "toJSON") else ()):
            f.write((",\n" if i else "\n") + json.dumps(json.loads(row), ensure_ascii=False))
        f.write("\n]\n")


def int_keys(c: Column) -> Column:
    """A JSON object's string keys as integers."""
    return F.transform_keys(c, lambda k, v: k.cast("int"))


def write_indexed(df: DataFrame, table: str, key: str, buckets: int = 64) -> None:
    """A table bucketed and sorted by its lookup key: equality lookups and joins on it need no shuffle."""
    df.write.bucketBy(buckets, key).sortBy(key).mode("overwrite").saveAsTable(table)


def within_bytes(limits: dict[str, int]) -> Column:
    """Whether every column keeps its limit in UTF-8 bytes."""
    out = F.lit(True)
    for column, most in limits.items():
        out &= F.coalesce(F.octet_length(column), F.lit(0)) <= most
    return out


def aligner_configs(template: str, source: str, target: str, **values: str) -> dict[str, str]:
    """The aligner's configuration for both directions, from a $-template."""
    one = {"src": source, "tgt": target} | values
    two = one | {"src": target, "tgt": source}
    return {"src_tgt": string.Template(template).substitute(one), "tgt_src": string.Template(template).substitute(two)}


def cli_format(style: str) -> Column:
    """Tagger output as text: verbose (all five fields), tab (words TAB tags) or / (w/t w/t)."""
    if style == "verbose":
        return F.concat_ws("\t", "zh", "zh_seg", "tag", "tag_cat", F.col("pr").cast("string"))
    if style == "tab":
        return F.concat_ws("\t", "zh_seg", "tag")
    if style == "/":
        parts = lambda c: F.filter(F.split(c, " "), lambda x: x != "")  # noqa: E731 - an empty line has none
        return slash_joined(parts("zh_seg"), parts("tag"))
    raise ValueError(f"unknown format {style}")
