"""Projection, filtering, splitting, merging and movement of rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auctionflow.functions import int_div, words
from auctionflow.operators.skew import skew_join


def demux(events: DataFrame, kind: str) -> DataFrame:
    """The rows of one kind of a tagged stream, with that kind's fields as columns."""
    return events.filter(F.col("type") == kind).select(f"{kind}.*")


def convert_currency(bids: DataFrame) -> DataFrame:
    """Prices in the other currency, 89 to 100, truncated (Q1)."""
    return bids.withColumn("price", int_div(F.col("price") * 89, F.lit(100)))


def select_auctions(bids: DataFrame, modulus: int = 123) -> DataFrame:
    """Auction and price of the bids on every `modulus`-th auction (Q2)."""
    return bids.filter(F.col("auction") % modulus == 0).select("auction", "price")


def flat_map_words(df: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    return df.select(*keep, F.explode(words(F.col(text))).alias("word"))


def flat_map_range(df: DataFrame, n: str, keep: Sequence[str]) -> DataFrame:
    """One row per integer in [0, n), unrolled in pieces, so that no array grows with n."""
    step, last = F.lit(65_536).cast("bigint"), F.col(n).cast("bigint") - 1
    pieces = df.filter(F.col(n) > 0).select(
        *keep, last.alias("_last"), F.explode(F.sequence(F.lit(0).cast("bigint"), last, step)).alias("_from"))
    return pieces.select(*keep, F.explode(F.sequence(F.col("_from"), F.least("_last", F.col("_from") + step - 1))).alias("i"))


def branch(df: DataFrame, predicate: Column) -> tuple[DataFrame, DataFrame]:
    """(rows where false or NULL, rows where true)."""
    yes = F.coalesce(predicate, F.lit(False))
    return df.filter(~yes), df.filter(yes)


def branch_when(df: DataFrame, time: str, at: str) -> tuple[DataFrame, DataFrame]:
    """(rows before `at`, rows at or after it)."""
    return branch(df, F.col(time) >= F.lit(at).cast(df.schema[time].dataType))


def route(df: DataFrame, key: Column, parts: int) -> DataFrame:
    """Add the output number of each row as `part`."""
    return df.withColumn("part", F.pmod(key, F.lit(parts)).cast("bigint"))


def partition(df: DataFrame, parts: int, key: Column, columns: Sequence[str | Column] = ("*",)) -> list[DataFrame]:
    """`parts` disjoint outputs by key, each projected to `columns`."""
    routed = route(df, key, parts)
    return [routed.filter(F.col("part") == i).drop("part").select(*columns) for i in range(parts)]


def exchange(df: DataFrame, *keys: str) -> DataFrame:
    """Bring rows with equal keys together; a key too large for one partition is split."""
    return df.hint("rebalance", *keys)


def exchange_by_id(df: DataFrame, key: str, parts: int) -> DataFrame:
    """Exact modulo placement: the row goes to partition `key mod parts`, named in `part`."""
    routed = route(df, F.col(key), parts)
    return routed.repartitionById(parts, F.col("part").cast("int"))


def lookup_join(facts: DataFrame, dim: DataFrame, fact_key: str, dim_key: str,
                max_rows: int = 250_000) -> DataFrame:
    """Inner join that copies `dim` to every task if it is small, else a skew-safe shuffle join."""
    return skew_join(facts, dim, fact_key, dim_key, max_rows=max_rows)


def concat(left: DataFrame, right: DataFrame) -> DataFrame:
    """Bag union: duplicates stay."""
    return left.unionByName(right)


def concatenate(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(concat, frames)
