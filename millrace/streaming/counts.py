"""Counts that add up, over a stream: an extension, with the same results as the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.sequences import ngrams_upto


def stream_phrase_counts(stream: DataFrame, words: str = "words", tags: str = "tags", most: int = 5) -> DataFrame:
    """Running (zh_seg, tag, count); for output mode update or complete."""
    pairs = F.arrays_zip(ngrams_upto(F.col(words), most).alias("w"), ngrams_upto(F.col(tags), most).alias("t"))
    return stream.select(F.explode(pairs).alias("p")).groupBy(F.col("p.w").alias("zh_seg"), F.col("p.t").alias("tag")).agg(F.count("*").alias("count"))


def stream_windowed_counts(stream: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, key, count) in tumbling windows; rows later than the watermark are not counted."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("count")).select(F.col("window.start").alias("start"), key, "count")
