"""Loops over DataFrames: one Spark job per round, lineage cut as they go."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auctionflow.session import cut, store

MOST = (2**63 - 2) // 3  # of which three times and one more is a long


def iterate(state: DataFrame, step: Callable[[DataFrame], DataFrame], active: Column | None = None,
            max_rounds: int | None = None, cut_every: int = 1) -> DataFrame:
    """Apply `step` until no row is `active`, or for `max_rounds` rounds.

    The state is written every `cut_every` rounds, which is also when activity is looked up.
    """
    if active is None and max_rounds is None:
        raise ValueError("a loop needs an end: give active, max_rounds or both")
    done = 0
    while True:
        if active is not None and done % cut_every == 0 and state.filter(active).isEmpty():
            return state
        if max_rounds is not None and done >= max_rounds:
            return state
        state = step(state)
        done += 1
        if done % cut_every == 0:
            state = cut(state)


def _positive(starts: DataFrame, column: str) -> DataFrame:
    value = F.col(column)
    return starts.select(F.when((value >= 1) | value.isNull(), value).otherwise(
        F.raise_error(F.lit("starts must be positive"))).alias(column)).filter(F.col(column).isNotNull())


def collatz_steps(starts: DataFrame, column: str, per_round: int = 128) -> DataFrame:
    """Steps from each positive start to 1 under x -> x/2 or 3x+1; a round does up to `per_round` of them.

    A start below 1, from which 1 is never reached, fails the query."""
    starts = _positive(starts, column)
    def many(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            x, steps = rows["x"].to_numpy(copy=True), rows["steps"].to_numpy(copy=True)
            at = np.flatnonzero(x != 1)
            for _ in range(per_round):
                if not len(at):
                    break
                v = x[at]
                odd = v % 2 == 1
                if (v[odd] > MOST).any():
                    raise OverflowError("a number is beyond 64 bits")
                x[at] = v = np.where(odd, v * 3 + 1, v >> 1)
                steps[at] += 1
                at = at[v != 1]
            yield pd.DataFrame({"start": rows["start"], "x": x, "steps": steps})

    column_type = starts.schema[column].dataType
    left = starts.select(F.col(column).cast("bigint").alias("start")).distinct().select(
        "start", F.col("start").alias("x"), F.lit(0).cast("bigint").alias("steps"))
    over = left.filter("x = 1")
    left = left.filter("x <> 1")
    while True:  # numbers that have got to 1 are left where they are
        turned = store(left.mapInPandas(many, "start long, x long, steps long"), "collatz")
        over, left = over.unionByName(turned.filter("x = 1")), turned.filter("x <> 1")
        if left.isEmpty():
            return over.select(F.col("start").cast(column_type).alias(column), "steps")


def collatz_two_loops(starts: DataFrame, column: str, turns: int = 10) -> DataFrame:
    """The same steps with two loops: halving makes even numbers odd, 3x+1 makes odd ones even.

    Each turn swaps the two frames, so several turns make two straight plans before the cut.
    A number that has reached 1 stays as it is in both. A start below 1 fails the query.
    """
    starts = _positive(starts, column)
    def halve(even: DataFrame) -> DataFrame:
        return even.selectExpr(column, "x div (x & -x) AS x",
                               "steps + CAST(log2(CAST(x & -x AS DOUBLE)) AS BIGINT) AS steps")

    def triple(odd: DataFrame) -> DataFrame:
        return odd.selectExpr(column, "IF(x = 1, x, x * 3 + 1) AS x", "steps + IF(x = 1, 0, 1) AS steps")

    def step(d: DataFrame) -> DataFrame:
        even, odd = d.filter("x % 2 = 0"), d.filter("x % 2 = 1")
        for _ in range(turns):
            even, odd = triple(odd), halve(even)
        return even.unionByName(odd).hint("rebalance")

    state = starts.select(column).distinct().select(
        F.col(column), F.col(column).cast("bigint").alias("x"), F.lit(0).cast("bigint").alias("steps"))
    return iterate(state, step, F.col("x") != 1).select(column, "steps")


def ping_pong(df: DataFrame, value: str, rounds: int) -> DataFrame:
    """Exchange by value and add one, `rounds` times."""
    def step(d: DataFrame) -> DataFrame:
        return d.hint("rebalance", value).withColumn(value, F.col(value) + 1)
    return iterate(df, step, max_rounds=rounds, cut_every=4)
