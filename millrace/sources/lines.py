"""Line files in, line files out: order is an explicit line_no."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.plans.scratch import materialise, new_path

LINES = T.StructType([T.StructField("line_no", T.LongType()), T.StructField("value", T.StringType())])


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """df with consecutive line_no from 0: in the order of the columns, or by input partition.

    Rows are numbered within ranges (or input partitions), whose sizes give each one its first
    number; no task sees more than one range. The ranges are written, so both passes agree.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    path = new_path(spark, "numbered")
    ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).write.option("compression", "zstd").parquet(path)
    stored = spark.read.parquet(path)
    sizes = stored.groupBy("_part").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each partition of the input
    sizes = sizes.withColumn("_first", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    return stored.join(F.broadcast(sizes), "_part").withColumn("line_no", F.col("_first") + F.col("_at")).drop("_part", "_at", "_first")


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(line_no, value) of text files, folders or globs, one after the other in the order given.

    The files of a folder or glob follow one another by name; gz files are read as they are. Spark may read
    the blocks of files in any order: lines are counted by block, and each block's first number
    comes from the sizes of the blocks before it.
    """
    parts = [spark.read.text(p).select("value", F.lit(i).alias("_path"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")) for i, p in enumerate([paths] if isinstance(paths, str) else paths)]
    path, block = new_path(spark, "lines"), ["_path", "_file", "_block"]
    reduce(DataFrame.unionByName, parts).withColumn("_at", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)
    stored = spark.read.parquet(path)
    blocks = stored.groupBy(*block).agg(F.count("*").alias("_size"), F.min("_at").alias("_least"))
    before = Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    # one row for each block of a file
    blocks = blocks.withColumn("_first", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    return stored.join(F.broadcast(blocks), block).select((F.col("_first") + F.col("_at") - F.col("_least")).alias("line_no"), "value")


def counted_before(lines: DataFrame, flag: Column, name: str) -> DataFrame:
    """lines with ``name``: how many lines before have the flag. Counted within ranges of line_no, and over the ranges' sums."""
    ranged = materialise(lines.withColumn("_flag", F.coalesce(flag.cast("long"), F.lit(0))).repartitionByRange("line_no").withColumn("_part", F.spark_partition_id()), "ranged")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each range
    sums = ranged.groupBy("_part").agg(F.sum("_flag").alias("_sum")).withColumn("_first", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    within = Window.partitionBy("_part").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(F.broadcast(sums), "_part").withColumn(name, F.col("_first") + F.coalesce(F.sum("_flag").over(within), F.lit(0))).drop("_part", "_flag", "_first")


def write_lines(lines: DataFrame, path: str, column: str = "value") -> None:
    """Write a column in the order of line_no; the part files are in order by name."""
    lines.repartitionByRange("line_no").sortWithinPartitions("line_no").select(F.coalesce(F.col(column), F.lit("")).alias("value")).write.text(path)


def write_columns(lines: DataFrame, path: str, columns: list[str]) -> None:
    """Each column as a line file of its own, below path."""
    for column in columns:
        write_lines(lines, f"{path}/{column}", column)


def split_two(lines: DataFrame) -> DataFrame:
    """(line_no, left, right): cut at the first TAB."""
    parts = F.split("value", "\t", 2)
    return lines.select("line_no", F.get(parts, F.lit(0)).alias("left"), F.get(parts, F.lit(1)).alias("right"))


def split_columns(lines: DataFrame, count: int | None = None) -> DataFrame:
    """(line_no, cols): TAB-separated columns of the stripped line; another number than ``count`` raises."""
    cols = F.split(F.regexp_replace("value", r"(?U)^\s+|\s+$", ""), "\t")
    out = lines.select("line_no", cols.alias("cols"))
    if count is None:
        return out
    wrong = F.raise_error(F.concat(F.lit("wrong number of columns in line "), F.col("line_no").cast("string"))).cast("array<string>")
    return out.withColumn("cols", F.when(F.size("cols") == count, F.col("cols")).otherwise(wrong))


def split_bar_tags(lines: DataFrame) -> DataFrame:
    """(line_no, text, tag): cut at the last |||, TABs to blanks."""
    flat = F.translate("value", "\t", " ")
    return lines.select("line_no", F.regexp_extract(flat, r"^(.*)\|\|\|(.*)$", 1).alias("text"), F.substring_index(flat, "|||", -1).alias("tag"))


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(word): one a line, trailing white space dropped."""
    return spark.read.text(path).select(F.regexp_replace("value", r"(?U)\s+$", "").alias("word")).distinct()


def phrasal_verbs(lines: DataFrame) -> DataFrame:
    """(verb, n_words, rest) from lines like carry_out; rest keeps its underscores."""
    v = F.regexp_replace("value", r"(?U)\s+$", "")
    return lines.filter(v != "").select(F.substring_index(v, "_", 1).alias("verb"), F.size(F.split(v, "_")).alias("n_words"), F.substr(v, F.instr(v, "_") + 1).alias("rest"))
