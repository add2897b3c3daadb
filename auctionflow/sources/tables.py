"""The auction entities as views over the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auctionflow.functions import cents

PERSON = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("name", T.StringType()),
    T.StructField("city", T.StringType()), T.StructField("state", T.StringType()),
    T.StructField("date_time", T.TimestampNTZType())])
AUCTION = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("initial_bid", T.LongType()),
    T.StructField("reserve", T.LongType()), T.StructField("date_time", T.TimestampNTZType()),
    T.StructField("expires", T.TimestampNTZType()), T.StructField("seller", T.LongType()),
    T.StructField("category", T.LongType())])
BID = T.StructType([
    T.StructField("auction", T.LongType()), T.StructField("bidder", T.LongType()),
    T.StructField("price", T.LongType()), T.StructField("date_time", T.TimestampNTZType())])
EVENT = T.StructType([
    T.StructField("type", T.StringType()), T.StructField("person", PERSON),
    T.StructField("auction", AUCTION), T.StructField("bid", BID)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("auction"), F.col("l_suppkey").alias("bidder"),
        cents(F.col("l_extendedprice")).alias("price"), F.col("l_shipdate").alias("date_time"))


def auctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.round("o_totalprice").cast("bigint").alias("initial_bid"),
        F.round(F.col("o_totalprice") * 5).cast("bigint").alias("reserve"),
        F.col("o_orderdate").alias("date_time"),
        (F.col("o_orderdate") + F.expr("INTERVAL '730' DAY")).alias("expires"),
        F.col("o_custkey").alias("seller"),
        (10 + F.col("o_orderkey") % 5).alias("category"))


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    city = F.expr("CASE c_custkey % 3 WHEN 0 THEN 'phoenix' WHEN 1 THEN 'boise' ELSE 'seattle' END")
    state = F.expr("CASE c_nationkey % 6 WHEN 0 THEN 'AZ' WHEN 1 THEN 'CA' WHEN 2 THEN 'ID' "
                   "WHEN 3 THEN 'OR' WHEN 4 THEN 'WA' ELSE 'WY' END")
    joined = F.expr("TIMESTAMP_NTZ'1995-01-01 00:00:00' "
                    "+ make_dt_interval(CAST((c_custkey * 37) % 2400 AS INT))")
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), city.alias("city"),
        state.alias("state"), joined.alias("date_time"))


def event_bids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bids with distinct, spread-out times, for windows and state."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("auction"), cents(F.col("value")).alias("price"),
        F.col("ts").alias("date_time"))


def union_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three entities as one tagged stream; fields of the other kinds are NULL."""

    def tag(df: DataFrame, kind: str) -> DataFrame:
        parts = [F.lit(kind).alias("type")]
        for f in EVENT.fields[1:]:
            body = F.struct(*df.columns) if f.name == kind else F.lit(None)
            parts.append(body.cast(f.dataType).alias(f.name))
        return df.select(*parts)

    return (tag(persons(spark, sf_dir), "person")
            .unionByName(tag(auctions(spark, sf_dir), "auction"))
            .unionByName(tag(bids(spark, sf_dir), "bid")))


def order_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed edges customer -> customer, one per order; the modulus is the customer count."""
    n = table(spark, sf_dir, "customer").agg(F.count("*")).scalar()
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("src"), (F.col("o_orderkey") % n).alias("dst"))


def owner_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between customers (even ids) and their orders (odd ids)."""
    return table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") * 2).alias("src"), (F.col("o_orderkey") * 2 + 1).alias("dst"))
