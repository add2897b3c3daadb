"""The joins of the auction queries; each works on bounded tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auctionflow.functions import seconds
from auctionflow.operators.skew import skew_join


def hash_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Inner join of two (key, val) tables, keys repeating on both sides; gives (key, val1, val2)."""
    l = left.select(F.col("key"), F.col("val").alias("val1"))
    r = right.select(F.col("key").alias("_rk"), F.col("val").alias("val2"))
    return skew_join(l, r, "key", "_rk", both=True).select("key", "val1", "val2")


def local_items(auctions: DataFrame, persons: DataFrame, category: int = 10,
                states: Sequence[str] = ("OR", "ID", "CA"), latest: bool = False) -> DataFrame:
    """People of some states who sell in one category (Q3).

    Person ids are unique in the data model; with `latest`, repeated ids keep the newest row.
    """
    people = persons.filter(F.col("state").isin(*states)).select(
        F.col("id").alias("person"), "name", "city", "state", "date_time")
    if latest:
        people = people.groupBy("person").agg(
            F.max(F.struct("date_time", "name", "city", "state")).alias("p")).select("person", "p.*")
    items = auctions.filter(F.col("category") == category).select(F.col("id").alias("auction"), "seller")
    return skew_join(items, people.drop("date_time"), "seller", "person").select(
        "name", "city", "state", "auction")


def valid_bids(auctions: DataFrame, bids: DataFrame) -> DataFrame:
    """Bids at or above the reserve, placed from the start of the auction until before it expires."""
    a = auctions.select(F.col("id"), "reserve", F.col("date_time").alias("opened"),
                        "expires", "seller", "category")
    b = bids.select("auction", "bidder", "price", F.col("date_time").alias("bid_time"))
    ok = ((F.col("price") >= F.col("reserve")) & (F.col("bid_time") >= F.col("opened"))
          & (F.col("bid_time") < F.col("expires")))
    return skew_join(b, a, "auction", "id", ok)


def closed_auctions(auctions: DataFrame, bids: DataFrame) -> DataFrame:
    """The winning bid of every auction that has a valid one.

    Highest price wins, then the earliest bid, then the smallest bidder. The maximum is taken
    per task before the shuffle, so an auction with very many bids sends one row per task.
    """
    rank = F.struct(F.col("price").alias("p"), F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00' - bid_time AS t"),
                    (-F.col("bidder")).alias("b"), "bid_time", "seller", "category", "expires")
    return (
        valid_bids(auctions, bids)
        .groupBy("auction").agg(F.max(rank).alias("w"))
        .select("auction", "w.seller", "w.category", "w.expires", F.col("w.p").alias("price"),
                (-F.col("w.b")).alias("bidder"), "w.bid_time")
    )


def new_sellers(persons: DataFrame, auctions: DataFrame, within: int = 43_200) -> DataFrame:
    """People who open an auction less than `within` seconds after joining, once per auction (Q8)."""
    p = persons.select(F.col("id").alias("person"), F.col("date_time").alias("joined"))
    a = auctions.select("seller", F.col("date_time").alias("opened"))
    soon = (F.col("opened") >= F.col("joined")) & (F.col("opened") < F.col("joined") + seconds(within))
    return skew_join(a, p, "seller", "person", soon).select("person")
