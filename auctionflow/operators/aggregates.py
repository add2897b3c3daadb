"""Folds per key and time, running folds, and the averages of the auction queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auctionflow.functions import int_div
from auctionflow.operators import packed
from auctionflow.operators.running import PIECE, expand, running, trailing
from auctionflow.session import store


def aggregate(df: DataFrame, time: str, keys: Sequence[str], **folds: Column) -> DataFrame:
    """Fold the rows of each key within one time; without keys, of the whole time."""
    return df.groupBy(time, *keys).agg(*[c.alias(n) for n, c in folds.items()])


def distinct_per_time(df: DataFrame, time: str, value: str) -> DataFrame:
    return df.select(time, value).dropDuplicates([time, value])


def word_counts(occurrences: DataFrame) -> DataFrame:
    """Final count per word of a (word) table."""
    return occurrences.groupBy("word").agg(F.count("*").alias("n"))


def running_word_counts(occurrences: DataFrame) -> DataFrame:
    """(time, word, n) for every occurrence: how often the word has been seen so far.

    Occurrences are counted per (word, time) first, so a frequent word is one row per time
    when it is ordered, and is unrolled only at the end.
    """
    counts = store(occurrences.groupBy("word", "time").agg(F.count("*").alias("k")), "counts")
    total = running(counts, ["word"], ["time"], {"upto": ("sum", "k")})
    return expand(total, "k", "i", spread=not counts.filter(F.col("k") > PIECE).isEmpty()).select(
        "time", "word", (F.col("upto") - F.col("k") + F.col("i")).alias("n"))


def running_diffs(changes: DataFrame) -> DataFrame:
    """(time, word, n): the word's count after all changes of one time, for signed changes.

    Integers are moved packed; other times and changes a row each.
    """
    if packed.packable(changes):
        return packed.running_sums(changes)
    net = changes.groupBy("word", "time").agg(F.sum("diff").alias("diff")).filter("diff <> 0")
    return running(net, ["word"], ["time"], {"n": ("sum", "diff")}).select("time", "word", "n")


def compact(changes: DataFrame, items: Sequence[str], diff: str = "diff") -> DataFrame:
    """Sum the changes per item and drop the items that cancel out."""
    return changes.groupBy(*items).agg(F.sum(diff).alias(diff)).filter(F.col(diff) != 0)


def category_average(closed: DataFrame) -> DataFrame:
    """Average closing price per category, truncated (Q4, final)."""
    return closed.groupBy("category").agg(
        int_div(F.sum("price"), F.count("*")).alias("avg_price"))


def category_average_running(closed: DataFrame) -> DataFrame:
    """The category's average after each closed auction, by (expires, auction) (Q4)."""
    slim = closed.select("category", "expires", "auction", "price")
    return running(slim, ["category"], ["expires", "auction"],
                   {"total": ("sum", "price"), "n": ("count", "*")}).select(
        "category", "expires", "auction", int_div(F.col("total"), F.col("n")).alias("avg_price"))


def last_prices_average(closed: DataFrame, rows: int = 10) -> DataFrame:
    """Average of the bidder's last `rows` winning prices, after each closed auction (Q6)."""
    slim = closed.select("bidder", "expires", "auction", "price")
    return trailing(slim, ["bidder"], ["expires", "auction"], rows,
                    {"total": F.sum("price"), "n": F.count("*")}).select(
        "bidder", "expires", "auction", int_div(F.col("total"), F.col("n")).alias("avg_price"))


def state_machine_sum(df: DataFrame, key: str, value: str, order: Sequence[str]) -> DataFrame:
    """The key's sum after each of its rows, in time order."""
    return running(df, [key], order, {"running": ("sum", value)})
