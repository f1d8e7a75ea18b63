"""Equi-joins against a small keyed table whose size is checked first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most rows of a table that is broadcast.
BROADCAST_ROWS = 50_000


def attach(df: DataFrame, small: DataFrame, key: str, how: str = "inner", broadcast_rows: int = BROADCAST_ROWS, salts: int = 64) -> DataFrame:
    """df joined with small (one row per key; nulls match) on the column named key.

    small should be cheap to count (a scratch table). Up to broadcast_rows it is broadcast.
    Beyond that, df is dealt out by key and a salt, and small is repeated for each salt, so that
    a key with a third of df's rows still spreads over ``salts`` tasks.
    """
    small = small.withColumnRenamed(key, "_key")
    if small.limit(broadcast_rows + 1).count() <= broadcast_rows:
        return df.join(F.broadcast(small), F.col(key).eqNullSafe(F.col("_key")), how).drop("_key")
    small = small.withColumn("_small_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = df.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    return salted.join(small, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_salt") == F.col("_small_salt")), how).drop("_key", "_salt", "_small_salt")


def restrict(df: DataFrame, keys: DataFrame, key: str, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of df whose key is among keys (distinct, cheap to count), broadcast up to broadcast_rows."""
    small = keys.limit(broadcast_rows + 1).count() <= broadcast_rows
    return df.join(F.broadcast(keys) if small else keys, key, "left_semi")
