"""Running values over a stream, for keys of any size.

Every micro-batch is accumulated like a table, spread over range chunks, and continues from what
earlier batches left of its keys. That carry is a log of runs (see `carry`): a batch writes what it
touched, not the table of all keys. Batches must follow each other in the given order, as epochs and closed
windows do; a row before one of its key's in an earlier batch fails the query.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auctionflow.operators.running import FIRST, FOLD, running, trailing
from auctionflow.session import forget, new_path, store
from auctionflow.streaming.carry import Carry
from auctionflow.streaming.harness import _results, run_batches
from auctionflow.streaming.joins import Joined

DISORDER = "a row comes before one of its key in an earlier batch"


def _inputs(stream: DataFrame | Joined) -> DataFrame:
    return stream.inputs if isinstance(stream, Joined) else stream


def _settle(stream: DataFrame | Joined, batch: DataFrame, number: int) -> DataFrame:
    """The micro-batch, or what a join gives for it, as a stored table, without the marks a watermark leaves on its columns."""
    batch = stream.step(batch, number) if isinstance(stream, Joined) else batch
    return store(batch.select(*[F.col(c).alias(c, metadata={}) for c in batch.columns]), "batch")


def running_batches(stream: DataFrame | Joined, keys: Sequence[str], order: Sequence[str],
                    aggs: dict[str, tuple[str, str]], folder: str | None = None) -> DataFrame:
    """`operators.running.running` over a stream; with the `folder` of an earlier run it goes on from there."""
    spark = stream.sparkSession
    folder = folder or new_path(spark, "running")
    place = F.struct(*order)

    def totals(df: DataFrame) -> DataFrame:
        return df.groupBy(*keys).agg(F.max(place).alias("_last"), *[FIRST[kind](c).alias(n) for n, (kind, c) in aggs.items()])

    def merged(df: DataFrame) -> DataFrame:
        return df.groupBy(*keys).agg(F.max("_last").alias("_last"), *[FOLD[kind][0](n).alias(n) for n, (kind, _) in aggs.items()])

    state = totals(spark.createDataFrame([], stream.schema)).schema
    carry = Carry(f"{folder}/carry", state, merged)

    def each(batch: DataFrame, number: int) -> None:
        settled = batch = _settle(stream, batch, number)
        own = batch.sparkSession
        before = merged(carry.before(own, number, batch, keys))
        earlier = before.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_last").alias("_k_last"),
                                *[F.col(n).alias(f"_c_{n}") for n in aggs])
        on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
        local = running(batch, keys, order, aggs).join(earlier, on, "left")
        in_time = local.filter(F.when(place < F.col("_k_last"), F.raise_error(F.lit(DISORDER)).cast("boolean")).otherwise(True))
        in_time.select(*batch.columns, *[
            FOLD[kind][1](F.col(n), F.col(f"_c_{n}")).alias(n) for n, (kind, _) in aggs.items()
        ]).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
        carry.add(own, number, totals(batch))
        forget(settled)

    run_batches(_inputs(stream), each, checkpoint=f"{folder}/progress")
    fields = {f.name: f.dataType for f in state}
    schema = stream.schema
    for name in aggs:
        schema = schema.add(name, fields[name])
    return _results(spark, schema, f"{folder}/out/*")


def trailing_batches(stream: DataFrame | Joined, keys: Sequence[str], order: Sequence[str], rows: int,
                     aggs: dict[str, Column], folder: str | None = None) -> DataFrame:
    """`operators.running.trailing` over a stream; the carry is the last `rows - 1` rows of each key."""
    spark = stream.sparkSession
    folder = folder or new_path(spark, "trailing")
    newest = Window.partitionBy(*keys).orderBy(*[F.col(o).desc() for o in order])

    def last(df: DataFrame) -> DataFrame:
        """The last `rows - 1` rows of each key; tasks send no more than that of a key."""
        return df.withColumn("_back", F.row_number().over(newest)).filter(F.col("_back") < rows).drop("_back")

    carry = Carry(f"{folder}/carry", stream.schema, last)

    def each(batch: DataFrame, number: int) -> None:
        settled = batch = _settle(stream, batch, number)
        own = batch.sparkSession
        old = store(last(carry.before(own, number, batch, keys)), "carried")
        both = old.withColumn("_old", F.lit(True)).unionByName(batch.withColumn("_old", F.lit(False)))
        ends = both.groupBy(*keys).agg(F.max(F.when(F.col("_old"), F.struct(*order))).alias("a"), F.min(F.when(~F.col("_old"), F.struct(*order))).alias("b"))
        if not ends.filter("b < a").isEmpty():
            raise ValueError(DISORDER)
        trailing(both, keys, order, rows, aggs).filter("NOT _old").drop("_old").write.mode(
            "overwrite").parquet(f"{folder}/out/batch={number}")
        carry.add(own, number, last(batch))
        forget(settled, old)

    run_batches(_inputs(stream), each, checkpoint=f"{folder}/progress")
    return getattr(spark, "_base", spark).read.parquet(f"{folder}/out/*").drop("batch")
