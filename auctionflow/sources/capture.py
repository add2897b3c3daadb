"""Streams kept as tables of (time, row), and read back."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auctionflow.operators.running import expand, running


def extract(captured: DataFrame, time: str, data: str) -> DataFrame:
    """The captured rows sorted within each time, as (time, position, data); no array is built."""
    counts = captured.groupBy(time, data).agg(F.count("*").alias("_n"))
    placed = running(counts, [time], [data], {"_upto": ("sum", "_n")})
    return expand(placed, "_n", "_i").select(
        time, (F.col("_upto") - F.col("_n") + F.col("_i")).alias("position"), data)


def replay(spark: SparkSession, schema: T.StructType, paths: Sequence[str],
           files_per_trigger: int | None = None) -> DataFrame:
    """One stream from any number of captured streams."""

    def one(path: str) -> DataFrame:
        reader = spark.readStream.schema(schema)
        if files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", files_per_trigger)
        return reader.parquet(path)

    return reduce(DataFrame.unionByName, [one(p) for p in paths])
