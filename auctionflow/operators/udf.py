"""User-defined operators. Column expressions come first; these are for what they cannot say."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auctionflow.functions import int_div


def unary(df: DataFrame, logic: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Apply `logic` to batches of rows, in place and without movement."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield logic(batch)
    return df.mapInPandas(run, schema)


def binary(left: DataFrame, right: DataFrame, key: str, logic: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
           schema: str, max_group: int = 100_000, distributive: bool = False) -> DataFrame:
    """Apply `logic(left rows, right rows)` to groups of whole keys, of about `max_group` rows of both sides.

    A group holds many small keys, so `logic` must join on the key itself. It gets all rows of its
    keys, however many a key has, and those have to fit in a task's memory.

    Logic that may be applied to any part of a key's left rows can say so with `distributive`: a
    key with more than `max_group` left rows is then cut into pieces, each with a copy of its right
    rows, which should be few per key (one auction, one person). Pieces follow from values and
    input partition, so a repeated task makes the same.
    """
    groups = (left.count() + right.count()) // max_group + 1
    if not distributive:
        group = F.pmod(F.xxhash64(F.col(key)), F.lit(groups)).alias("_group")
        l, r = left.select("*", group), right.select("*", group)
        return l.groupBy("_group").cogroup(r.groupBy("_group")).applyInPandas(
            lambda a, b: logic(a.drop(columns="_group"), b.drop(columns="_group")), schema)
    sizes = left.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > max_group).select(
        F.col(key).alias("_key"), (int_div(F.col("_n"), F.lit(max_group)) + 1).alias("_pieces"))
    pieces = F.coalesce(F.col("_pieces"), F.lit(1).cast("bigint"))
    # at most one key per `max_group` rows is that large
    sizes = F.broadcast(sizes) if groups <= max_group else sizes

    def group_of(piece: Column) -> Column:
        return F.pmod(F.xxhash64(F.col(key), piece), F.lit(groups))

    def place(df: DataFrame, group: Column) -> DataFrame:
        return df.join(sizes, F.col(key) == F.col("_key"), "left").select(*df.columns, group.alias("_group"))

    l = place(left, group_of(F.pmod(F.xxhash64(*left.columns, F.spark_partition_id()), pieces)))
    # two pieces of a key can fall into one group, which needs the right rows only once
    r = place(right, F.explode(F.array_distinct(F.transform(
        F.sequence(F.lit(0).cast("bigint"), pieces - 1), group_of))))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return logic(a.drop(columns="_group"), b.drop(columns="_group"))

    return l.groupBy("_group").cogroup(r.groupBy("_group")).applyInPandas(run, schema)


def fold(df: DataFrame, keys: Sequence[str], partial: Callable[[pd.DataFrame], pd.DataFrame], state: str,
         **merge: Column) -> DataFrame:
    """A user-defined aggregate: `partial` folds each batch to rows of `state`, Spark merges them.

    Folding happens before the shuffle, so a key of any size is at most one state row per batch.
    """
    return unary(df, partial, state).groupBy(*keys).agg(*[c.alias(n) for n, c in merge.items()])


@F.udtf(returnType="words: array<string>")
class SplitWords:
    """Table function: the whitespace-separated words of a text, in one row; a row from Python costs more than its words."""

    def eval(self, text: str):
        yield ((text or "").split(),)
