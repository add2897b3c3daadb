"""Latency reports over a table of (time, latency) samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auctionflow.functions import int_div
from auctionflow.operators.running import running

# fixed values: the reported shares of a latency distribution
PERCENTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99, "p999": 0.999, "max": 1.0}
BUCKET = 65_536


def _bucket(latency: str, width: int):
    return (int_div(F.col(latency), F.lit(width).cast("bigint")) * width).alias("latency")


def latency_ccdf(samples: DataFrame, latency: str, width: int = BUCKET) -> DataFrame:
    """Per latency bucket: the number of samples and the share of samples above the bucket."""
    counts = samples.groupBy(_bucket(latency, width)).agg(F.count("*").alias("n"))
    above = running(counts, (), [F.col("latency").desc()], {"_upto": ("sum", "n")})
    total = samples.agg(F.count("*")).scalar()
    return above.select("latency", ((F.col("_upto") - F.col("n")) / total).alias("share_above"), "n")


def latency_timeline(samples: DataFrame, time: str, latency: str, step_ms: int = 250,
                     width: int = BUCKET) -> DataFrame:
    """Latency percentiles per time step, exact on bucketed latencies.

    Samples are counted per (step, bucket) before anything is ordered, so a step with very many
    samples is no larger than its number of buckets.
    """
    counts = samples.groupBy(
        F.window(time, f"{step_ms} milliseconds").end.alias("step_end"), _bucket(latency, width)
    ).agg(F.count("*").alias("n"))
    upto = running(counts, ["step_end"], ["latency"], {"_upto": ("sum", "n")})
    total = upto.groupBy("step_end").agg(F.max("_upto").alias("n_total"))
    ranked = upto.join(total, "step_end")
    reached = [
        F.min(F.when(F.col("_upto") >= F.ceil(F.col("n_total") * p), F.col("latency"))).alias(name)
        for name, p in PERCENTILES.items()
    ]
    return ranked.groupBy("step_end").agg(*reached)
