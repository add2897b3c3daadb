"""Tumbling and sliding windows over event time.

Windows are [start, start + size) with starts at multiples of the slide, size being slide times
slices, and are named by `window_end`. All durations are whole seconds. Only windows that start
at or after `origin` are given; by default that is the first event, floored to the slide. The
functions work on streams too, where `origin` must be given.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auctionflow.functions import int_div, seconds
from auctionflow.operators.running import expand, running


def _sec(n: int) -> str:
    return f"{n} seconds"


def _from_origin(df: DataFrame, window: str, source: DataFrame, time: str, slide: int,
                 origin: Column | None, leading: bool) -> DataFrame:
    if leading:
        return df
    if origin is None:
        if source.isStreaming:
            raise ValueError("a stream has no first event to look up: give an origin")
        first = source.agg(F.min(time).alias("t")).select(F.window("t", _sec(slide)).start)
        origin = first.scalar()
    return df.filter(F.col(window).start >= origin)


def _bounds(df: DataFrame, window: str, *columns: str) -> DataFrame:
    return df.select(F.col(window).start.alias("window_start"), F.col(window).end.alias("window_end"), *columns)


def assign_windows(df: DataFrame, time: str, slide: int, slices: int,
                   origin: Column | None = None, leading: bool = False) -> DataFrame:
    """One row per record and window that holds it; no shuffle."""
    spread = df.select(F.window(time, _sec(slide * slices), _sec(slide)).alias("_w"), "*")
    return _bounds(_from_origin(spread, "_w", df, time, slide, origin, leading), "_w", *df.columns)


def pane_counts(df: DataFrame, time: str, pane: int, keys: Sequence[str] = ()) -> DataFrame:
    """Records per pane (and key): the only step that touches every record."""
    return df.groupBy(F.window(time, _sec(pane)).alias("pane"), *keys).agg(F.count("*").alias("n"))


def _counts(df: DataFrame, time: str, slide: int, slices: int, keys: Sequence[str],
            origin: Column | None, leading: bool, pane: int | None) -> DataFrame:
    pane = pane or slide
    if slide % pane:
        raise ValueError("panes must divide the slide")
    size = _sec(slide * slices)
    if slices == 1 and pane == slide:
        return _from_origin(pane_counts(df, time, slide, keys).withColumnRenamed("pane", "_w"),
                            "_w", df, time, slide, origin, leading)
    rolled = (
        pane_counts(df, time, pane, keys)
        .groupBy(F.window(F.window_time("pane"), size, _sec(slide)).alias("_w"), *keys)
        .agg(F.sum("n").alias("n"))
    )
    return _from_origin(rolled, "_w", df, time, slide, origin, leading)


def window_count(df: DataFrame, time: str, slide: int, slices: int, origin: Column | None = None,
                 leading: bool = False, pane: int | None = None, fill_gaps: bool = False) -> DataFrame:
    """Records per window, through panes: each pane, not each record, goes to its windows.

    `pane` may be shorter than the slide. `fill_gaps` adds windows without records, count 0,
    between the first and the last one.
    """
    out = _bounds(_counts(df, time, slide, slices, (), origin, leading, pane), "_w", "n")
    if not fill_gaps:
        return out
    ends = out.agg(F.min("window_end").alias("lo"), F.max("window_end").alias("hi"))
    steps = F.expr("extract(DAY FROM hi - lo) * 86400L + extract(HOUR FROM hi - lo) * 3600L"
                   " + extract(MINUTE FROM hi - lo) * 60L + CAST(extract(SECOND FROM hi - lo) AS BIGINT)")
    spine = expand(ends.withColumn("_n", int_div(steps, F.lit(slide)) + 1), "_n", "_i").select(
        (F.col("lo") + F.make_dt_interval(secs=(F.lit(slide) * (F.col("_i") - 1)).cast("decimal(18,6)"))).alias("window_end"))
    return spine.join(out.drop("window_start"), "window_end", "left").select(
        (F.col("window_end") - seconds(slide * slices)).alias("window_start"), "window_end",
        F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def window_count_rows(df: DataFrame, time: str, slide: int, slices: int,
                      origin: Column | None = None, leading: bool = False) -> DataFrame:
    """Records per window with every record sent to every window; pays when slices is 1."""
    counted = df.groupBy(F.window(time, _sec(slide * slices), _sec(slide)).alias("_w")).agg(
        F.count("*").alias("n"))
    return _bounds(_from_origin(counted, "_w", df, time, slide, origin, leading), "_w", "n")


def keyed_window_count(df: DataFrame, time: str, key: str, slide: int, slices: int,
                       origin: Column | None = None, leading: bool = False,
                       pane: int | None = None) -> DataFrame:
    """Records per window and key."""
    return _bounds(_counts(df, time, slide, slices, (key,), origin, leading, pane), "_w", key, "n")


def window_rank(df: DataFrame, time: str, key: str, slide: int, slices: int,
                origin: Column | None = None, leading: bool = False,
                pane: int | None = None) -> DataFrame:
    """Competition rank of each key within its window, keys ascending, with its record count `n`.

    A rank is one more than the number of records with smaller keys, so it follows from the
    counts; no window's records are ever sorted.
    """
    counts = keyed_window_count(df, time, key, slide, slices, origin, leading, pane)
    return running(counts, ["window_end"], [key], {"_upto": ("sum", "n")}).select(
        "window_start", "window_end", key, (F.col("_upto") - F.col("n") + 1).alias("rank"), "n")


def window_rank_rows(df: DataFrame, time: str, key: str, slide: int, slices: int,
                     origin: Column | None = None, leading: bool = False,
                     pane: int | None = None) -> DataFrame:
    """As `window_rank`, one row per record."""
    ranks = window_rank(df, time, key, slide, slices, origin, leading, pane)
    return expand(ranks, "n", "_i").select("window_start", "window_end", key, "rank")


def keyed_window_rank(df: DataFrame, time: str, key: str, slide: int, slices: int,
                      origin: Column | None = None, leading: bool = False) -> DataFrame:
    """Rank within (key, window), one row per record: all ids there are equal, so always 1."""
    return assign_windows(df.select(key, time), time, slide, slices, origin, leading).select(
        "window_start", "window_end", key, F.lit(1).cast("bigint").alias("rank"))


def hot_items(df: DataFrame, time: str, key: str, slide: int = 1, slices: int = 60,
              origin: Column | None = None, leading: bool = False) -> DataFrame:
    """The key with most records per window; of equal counts the largest key (Q5)."""
    counts = _counts(df, time, slide, slices, (key,), origin, leading, None)
    best = counts.groupBy("_w").agg(F.max(F.struct(F.col("n"), F.col(key))).alias("_top"))
    return _bounds(best.select("_w", "_top.*"), "_w", key, "n")


def highest_bid(df: DataFrame, time: str, price: str, size: int = 10) -> DataFrame:
    """Highest price per tumbling window (Q7)."""
    top = df.groupBy(F.window(time, _sec(size)).alias("_w")).agg(F.max(price).alias(price))
    return _bounds(top, "_w", price)
