"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auctionflow.session import fits_broadcast, slots

COPIES = "_copies"


def hot_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys holding more than 1/slots of the rows, with the number of pieces each needs.

    Rows are counted per key, in each task first, so a hot key is one row per task when it is
    shuffled and no task merges what all others found. Only keys above a 1/slots share pass, so
    the result has fewer than `slots` rows.
    """
    n, total = slots(df.sparkSession), df.count()
    counts = df.groupBy(F.col(key).alias("_hot")).agg(F.count("*").alias("_n"))
    return counts.filter((F.col("_n") * n > total) & F.col("_hot").isNotNull()).select(
        "_hot", F.ceil(F.col("_n") * n / F.lit(max(total, 1))).cast("int").alias(COPIES))


def _found(df: DataFrame, key: str) -> DataFrame | None:
    """The hot keys as a local table, or None; at most `slots` rows come to the driver."""
    found = hot_keys(df, key)
    rows = found.collect()
    return df.sparkSession.createDataFrame(rows, found.schema) if rows else None


def _salt(df: DataFrame, key: str, hot: DataFrame | None, name: str) -> DataFrame:
    """Give each row of a hot key one of its pieces, from its values and input partition.

    Both are the same when a task is run again, so a retry puts the row in the same piece;
    the partition number spreads rows that are exact copies of each other.
    """
    if hot is None:
        return df.withColumn(name, F.lit(0))
    spread = F.xxhash64(*[F.col(c) for c in df.columns], F.spark_partition_id())
    return (
        df.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
        .withColumn(name, F.when(F.col(COPIES) > 1, F.pmod(spread, F.col(COPIES)).cast("int")).otherwise(0))
        .drop("_hot", COPIES)
    )


def _copy(df: DataFrame, key: str, hot: DataFrame | None, name: str) -> DataFrame:
    """One copy of each row per piece of its key, so that every salted row finds its partner."""
    if hot is None:
        return df.withColumn(name, F.lit(0))
    return (
        df.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
        .withColumn(name, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(COPIES), F.lit(1)) - 1)))
        .drop("_hot", COPIES)
    )


def skew_join(big: DataFrame, small: DataFrame, big_key: str, small_key: str,
              condition: Column | None = None, both: bool = False, max_rows: int = 250_000) -> DataFrame:
    """Inner equi-join that neither copies a large table nor piles a hot key into one task.

    If `small` has at most `max_rows` rows it is broadcast. Otherwise the hot keys of `big`, of
    which there are fewer than `slots`, are looked up. Without any this is a plain join, whose
    partitioning a later groupBy on the key can use. Hot keys are split: each row of `big` goes
    to one piece and the matching rows of `small` to all of them. With `both`, for tables where
    a key can repeat on either side, hot keys of `small` are split as well, into a grid.

    Column names of the two sides must differ, and `condition` may use both.
    """
    on = F.col(big_key) == F.col(small_key)
    if condition is not None:
        on = on & condition
    if fits_broadcast(small, max_rows):
        return big.join(F.broadcast(small), on)
    hot_big = _found(big, big_key)
    hot_small = _found(small, small_key) if both else None
    if hot_big is None and hot_small is None:
        return big.join(small, on)
    left = _copy(_salt(big, big_key, hot_big, "_row"), big_key, hot_small, "_col")
    right = _copy(_salt(small, small_key, hot_small, "_col_r"), small_key, hot_big, "_row_r")
    pieces = (F.col("_row") == F.col("_row_r")) & (F.col("_col") == F.col("_col_r"))
    return left.join(right, on & pieces).drop("_row", "_col", "_row_r", "_col_r")
