"""Moving rows in time: delays and re-timing to a clock."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auctionflow.operators.running import running


def delay(df: DataFrame, time: str, new_time: Column) -> DataFrame:
    """Give each row a later time; a row never moves back."""
    return df.withColumn(time, F.greatest(F.col(time), new_time))


def delay_batch(df: DataFrame, time: str, step: int) -> DataFrame:
    """Hold rows until the end of the `step`-second interval of their time."""
    return delay(df, time, F.window(time, f"{step} seconds").end)


def reclock(df: DataFrame, clock: DataFrame, time: str, tick: str, keys: Sequence[str] = ()) -> DataFrame:
    """Add `tick`, the first clock tick at or after the row's time; rows after the last tick leave.

    Rows and ticks are ordered backwards in time together, and the smallest tick so far is
    carried along. With `keys`, each key has its own clock.
    """
    ticks = clock.select(*keys, F.col(tick).alias(time), F.col(tick).alias("_tick")).distinct()
    rows = df.withColumn("_is_row", F.lit(1))
    both = rows.unionByName(ticks.withColumn("_is_row", F.lit(0)), allowMissingColumns=True)
    # the hash lets many rows of one time fall into several chunks
    order = [F.col(time).desc(), F.col("_is_row"), F.xxhash64(*df.columns)]
    timed = running(both, keys, order, {"_next": ("min", "_tick")})
    return timed.filter("_is_row = 1 AND _next IS NOT NULL").select(
        *df.columns, F.col("_next").alias(tick))


def late_rows(df: DataFrame, epoch: str, time: str, seconds: int) -> DataFrame:
    """Rows older than the watermark of their epoch: the newest time of earlier epochs less the delay."""
    tops = df.groupBy(epoch).agg(F.max(time).alias("_top"))
    asked = tops.select(F.col(epoch), F.lit(0).alias("_phase"), F.lit(None).cast(df.schema[time].dataType).alias("_top"))
    told = tops.select(F.col(epoch), F.lit(1).alias("_phase"), F.col("_top"))
    # an epoch asks before it tells, so it only sees the epochs before it
    seen = running(asked.unionByName(told), (), [epoch, "_phase"], {"_seen": ("max", "_top")})
    marks = seen.filter("_phase = 0").select(
        epoch, (F.col("_seen") - F.expr(f"INTERVAL '{seconds}' SECOND")).alias("_mark"))
    return df.join(marks, epoch).filter(F.col(time) < F.col("_mark")).select(*df.columns)
