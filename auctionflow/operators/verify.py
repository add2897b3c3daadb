"""Comparison of two results as bags of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auctionflow.operators.aggregates import compact


def verify(correct: DataFrame, output: DataFrame) -> DataFrame:
    """Rows whose multiplicity differs, with `diff`: negative if missing in `output`.

    Empty if the two are equal. Each side is counted per distinct row before the shuffle.
    """
    columns = correct.columns
    changes = correct.withColumn("diff", F.lit(-1).cast("bigint")).unionByName(
        output.select(*columns).withColumn("diff", F.lit(1).cast("bigint")))
    return compact(changes, columns)


def verify_per_time(correct: DataFrame, output: DataFrame, time: str) -> DataFrame:
    """Per time: how many rows are missing from `output`, and how many it has too many."""
    return verify(correct, output).groupBy(time).agg(
        F.sum(F.greatest(-F.col("diff"), F.lit(0))).alias("missing"),
        F.sum(F.greatest(F.col("diff"), F.lit(0))).alias("extra"))
