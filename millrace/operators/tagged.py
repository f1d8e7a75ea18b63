"""Tagged sentences: from tagger output and from lines of four columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.sequences import to_inside_head
from millrace.functions.text import tokens
from millrace.operators.lines import blank_line_groups


def from_blocks(lines: DataFrame) -> DataFrame:
    """(record, words, lemmas, poss, chunks) from blocks of word, lemma, tag, chunk, entity lines.

    Chunk tags turn from begin/inside to inside/head; entities are dropped, as are empty blocks.
    """
    rows = blank_line_groups(lines).filter(F.size("values") > 0)
    column = lambda i: F.transform("values", lambda v: F.get(F.split(v, "\t"), F.lit(i)))
    return rows.select("record", column(0).alias("words"), column(1).alias("lemmas"), column(2).alias("poss"), to_inside_head(column(3)).alias("chunks"))


def from_columns(lines: DataFrame) -> DataFrame:
    """(line_no, words, lemmas, poss, chunks) from lines of four TAB-separated columns; fewer raise."""
    parts = F.split("value", "\t", 4)
    wrong = F.raise_error(F.concat(F.lit("fewer than four columns in line "), F.col("line_no").cast("string"))).cast("array<string>")
    return lines.withColumn("_p", F.when(F.size(parts) == 4, parts).otherwise(wrong)).select("line_no", *(tokens(F.get("_p", F.lit(i))).alias(n) for i, n in enumerate(("words", "lemmas", "poss", "chunks"))))


def to_columns(sents: DataFrame, key: str = "record") -> DataFrame:
    """Tagged sentences as lines of four TAB-separated columns."""
    return sents.select(F.col(key).alias("line_no"), F.concat_ws("\t", *(F.array_join(c, " ") for c in ("words", "lemmas", "poss", "chunks"))).alias("value"))


def malformed(sents: DataFrame) -> DataFrame:
    """Sentences whose columns differ in length; matching drops them."""
    n = F.size("words")
    return sents.filter((n != F.size("lemmas")) | (n != F.size("poss")) | (n != F.size("chunks")))


def number_repeats(rows: DataFrame, key: str, items: str) -> DataFrame:
    """(key, at, item): items of long arrays, repeated ones numbered by position.

    The row form of functions.sequences.numbered, which compares all pairs of a short array.
    """
    flat = rows.select(key, F.posexplode(items).alias("at", "_item"))
    same = Window.partitionBy(key, "_item")
    item = F.when(F.count("*").over(same) > 1, F.concat("_item", F.row_number().over(same.orderBy("at")).cast("string"))).otherwise(F.col("_item"))
    return flat.select(key, "at", item.alias("item"))
