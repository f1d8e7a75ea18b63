"""Operators over ordered lines and over records of several lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.sequences import before_slash, slash_joined
from millrace.functions.text import preprocess, tokens
from millrace.sources.lines import counted_before


def apply_steps(df: DataFrame, *steps: Callable[..., DataFrame]) -> DataFrame:
    """A chain of table functions, lazily."""
    for step in steps:
        df = df.transform(step)
    return df


def zip_lines(a: DataFrame, b: DataFrame, names: tuple[str, str] = ("src", "tgt")) -> DataFrame:
    """(line_no, src, tgt): lines with the same number; the shorter file decides."""
    return a.select("line_no", F.col("value").alias(names[0])).join(b.select("line_no", F.col("value").alias(names[1])), "line_no")


def interleave(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two files as records of three lines: first, second, blank."""
    rows = zip_lines(a, b).select("line_no", F.posexplode(F.array("src", "tgt", F.lit(""))).alias("_at", "value"))
    return rows.select((F.col("line_no") * 3 + F.col("_at")).alias("line_no"), "value")


def unpivot_columns(rows: DataFrame) -> DataFrame:
    """(line_no, cols) as records: each column on its own line, then a blank one. Equal arity is assumed."""
    flat = rows.select("line_no", F.size("cols").alias("_n"), F.posexplode(F.concat("cols", F.array(F.lit("")))).alias("_at", "value"))
    return flat.select((F.col("line_no") * (F.col("_n") + 1) + F.col("_at")).alias("line_no"), "value")


def groups_of(lines: DataFrame, n: int) -> DataFrame:
    """(record, values) of n consecutive lines; an incomplete last group is dropped."""
    rows = lines.groupBy(F.floor(F.col("line_no") / n).alias("record")).agg(F.sort_array(F.collect_list(F.struct("line_no", "value"))).alias("_rows"))
    return rows.filter(F.size("_rows") == n).select("record", F.transform("_rows", lambda x: x["value"]).alias("values"))


def slice_groups(lines: DataFrame, n: int, which: int | slice) -> DataFrame:
    """Of every n lines those that ``which`` picks, renumbered; an incomplete last group is dropped."""
    if isinstance(which, int):
        places = [range(n)[which]]
    elif isinstance(which, slice):
        places = list(range(n)[which])
    else:
        raise AssertionError("which must be an int or a slice")
    total = lines.agg(F.count("*").alias("_total"))
    rank = F.array_position(F.array(*(F.lit(p) for p in places)), (F.col("line_no") % n).cast("int")) - 1
    # total has one row
    inside = lines.crossJoin(F.broadcast(total)).filter(F.floor(F.col("line_no") / n) < F.floor(F.col("_total") / n)).filter(rank >= 0)
    return inside.select((F.floor(F.col("line_no") / n) * len(places) + rank).alias("line_no"), "value")


def split_pairs(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records of three lines as two files."""
    return slice_groups(lines, 3, 0), slice_groups(lines, 3, 1)


def blank_line_groups(lines: DataFrame, width: int | None = None) -> DataFrame:
    """(record, values): the lines up to each blank line; repeated blank lines give empty records.

    Blank lines are counted within ranges of lines, so no task sees more than one range.
    """
    blank = F.col("value") == ""
    rows = counted_before(lines, blank, "record")
    grouped = rows.groupBy("record").agg(F.sort_array(F.collect_list(F.when(~blank, F.struct("line_no", "value")))).alias("_rows"))
    return grouped.select("record", F.transform("_rows", lambda x: x["value"]).alias("values"))


def merge_tags(records: DataFrame) -> DataFrame:
    """(record, value) with w/t pairs from records of words, tags, blank; the shorter line decides."""
    return records.select("record", slash_joined(tokens(F.get("values", F.lit(0))), tokens(F.get("values", F.lit(1)))).alias("value"))


def strip_tags(c: Column) -> Column:
    """The text before the first slash of each token."""
    return F.array_join(before_slash(tokens(c)), " ")


def remove_separator(c: Column, sep: str = " ") -> Column:
    return F.replace(c, F.lit(sep), F.lit(""))


def strip_stops(c: Column) -> Column:
    """Full stops 。 stripped at both ends."""
    return F.regexp_replace(c, "^。+|。+$", "")


def preprocess_records(records: DataFrame) -> DataFrame:
    """records with the first value preprocessed."""
    return records.withColumn("values", F.concat(F.array(preprocess(F.get("values", F.lit(0)))), F.slice("values", 2, F.size("values"))))


def prune_long(pairs: DataFrame, column: str = "tgt", most: int = 119) -> DataFrame:
    """Pairs whose column has at most ``most`` characters."""
    return pairs.filter(F.length(column) <= most)


def route_chunks(df: DataFrame, chunks: str = "chunks") -> DataFrame:
    """df with route: vp if the first chunk tag is B-VP, pure_np if none is, else np."""
    c = F.col(chunks)
    return df.withColumn("route", F.when(F.get(c, F.lit(0)) == "B-VP", "vp").when(~F.array_contains(c, "B-VP"), "pure_np").otherwise("np"))


def fold_split(lines: DataFrame, record: int = 3, folds: int = 10) -> DataFrame:
    """lines with part: the last of every ``folds`` records is test, the others train; an incomplete fold goes."""
    whole = record * folds
    total = lines.agg(F.count("*").alias("_total"))
    inside = lines.crossJoin(F.broadcast(total)).filter(F.floor(F.col("line_no") / whole) < F.floor(F.col("_total") / whole)).drop("_total")
    return inside.withColumn("part", F.when(F.col("line_no") % whole < record * (folds - 1), "train").otherwise("test"))


def sample_lines(lines: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n rows at random, the same ones for a seed: the n smallest hashes (a top-n, not a full sort)."""
    return lines.orderBy(F.xxhash64(F.lit(seed), *lines.columns)).limit(n)
