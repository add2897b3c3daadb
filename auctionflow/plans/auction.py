"""The nine auction queries and the auction views they share, over one folder of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from auctionflow.operators import aggregates as A
from auctionflow.operators import basic as B
from auctionflow.operators import joins as J
from auctionflow.operators import windows as W
from auctionflow.sources import tables as S

SLIDE, SLICES = 21_600, 4          # six hours, one day
NEW_SELLER = 180 * 86_400          # 180 days, to suit tables that span years


def closed(spark: SparkSession, d: str) -> DataFrame:
    return J.closed_auctions(S.auctions(spark, d), S.bids(spark, d))


def q0(spark: SparkSession, d: str) -> DataFrame:
    return S.bids(spark, d)


def q1(spark: SparkSession, d: str) -> DataFrame:
    return B.convert_currency(S.bids(spark, d))


def q2(spark: SparkSession, d: str) -> DataFrame:
    return B.select_auctions(S.bids(spark, d))


def q3(spark: SparkSession, d: str) -> DataFrame:
    return J.local_items(S.auctions(spark, d), S.persons(spark, d))


def q4(spark: SparkSession, d: str) -> DataFrame:
    return A.category_average(closed(spark, d))


def q4_running(spark: SparkSession, d: str) -> DataFrame:
    return A.category_average_running(closed(spark, d))


def q5(spark: SparkSession, d: str) -> DataFrame:
    return W.hot_items(S.event_bids(spark, d), "date_time", "auction", SLIDE, SLICES)


def q6(spark: SparkSession, d: str) -> DataFrame:
    return A.last_prices_average(closed(spark, d))


def q7(spark: SparkSession, d: str) -> DataFrame:
    return W.highest_bid(S.event_bids(spark, d), "date_time", "price", 3600)


def q8(spark: SparkSession, d: str) -> DataFrame:
    return J.new_sellers(S.persons(spark, d), S.auctions(spark, d), NEW_SELLER)
