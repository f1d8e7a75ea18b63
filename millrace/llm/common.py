"""What the operators of this subpackage share: the word rule and table access."""

from __future__ import annotations

import gc
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The bytes between words; ``bytes.split()`` splits at just these.
SPACE_BYTES = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str) -> Column:
    """The text, empty where null."""
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


_held: dict[str, Any] = {}


def held(name: str, make: Callable[[], Any]) -> Any:
    """The one large table that a worker process keeps for its next tasks; asking for another lets it go."""
    if name not in _held:
        if _held:
            _held.clear()
            gc.collect()
        _held[name] = make()
    return _held[name]
