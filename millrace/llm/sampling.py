"""Bounded samples of labelled documents for models that are trained on the driver."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.plans.lookup import attach
from millrace.plans.scratch import materialise

#: Most rows of a sample, over all classes.
MOST_ROWS = 20_000
#: Most bytes of text that a class brings, and of one text in a sample.
MOST_BYTES, LONGEST = 16 << 20, 256 << 10


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null ids are in fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)), F.lit(0))


def sample_by_class(rows: DataFrame, id_col: str, class_col: str, per_class: int, most_rows: int = MOST_ROWS) -> DataFrame:
    """About per_class rows of each class, the same at each run: those whose hash lies below a share.

    The shares come from the counts of all rows; classes with fewer rows are taken whole. With very many
    classes each brings less, so that all have about most_rows rows.
    """
    counts = materialise(rows.groupBy(class_col).agg(F.count("*").alias("_n")), "class_counts")
    each = max(1, min(per_class, most_rows // max(1, counts.count())))
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(17)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return attach(rows, counts, class_col).filter(draw < F.lit(float(each)) / F.col("_n")).drop("_n")


def within_bytes(sample: DataFrame, id_col: str, class_col: str, most_bytes: int = MOST_BYTES, longest: int = LONGEST) -> DataFrame:
    """The rows of a sample (with _bytes) that keep each class within most_bytes; texts above longest are left out."""
    upto = Window.partitionBy(class_col).orderBy(F.xxhash64(F.col(id_col), F.lit(18)), id_col)
    return sample.filter(F.col("_bytes") <= longest).withColumn("_sum", F.sum("_bytes").over(upto)).filter(F.col("_sum") <= most_bytes).drop("_sum", "_bytes")


def order_of(key: object) -> tuple[int, str]:
    """A sort key that mixes ids alike at every run, whatever their type."""
    return zlib.crc32(str(key).encode()), str(key)
