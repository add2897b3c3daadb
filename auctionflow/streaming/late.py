"""Late rows kept aside instead of dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auctionflow.session import new_path
from auctionflow.streaming.harness import _results, run_batches


def split_late(stream: DataFrame, time: str, delay: int, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows on time, late rows) of a stream.

    A row is late if it is older than the newest time of earlier micro-batches less `delay`
    seconds; a row without a time is on time. Every batch leaves the newest time so far in a small
    table, from which the next one takes its mark; a repeated batch overwrites its output. With
    `folder`, a stream that is started again with the same one goes on where it stopped.
    """
    spark = stream.sparkSession
    folder = folder or new_path(spark, "late")
    marks, on_time, late = (f"{folder}/{n}" for n in ("marks", "ontime", "late"))

    def each(batch: DataFrame, number: int) -> None:
        kept = rows = batch.persist()
        seen = rows.agg(F.max(time).alias("top"))
        rows = rows.withColumn("_late", F.lit(False))
        if number:
            before = batch.sparkSession.read.schema(seen.schema).parquet(f"{marks}/batch={number - 1}")
            rows = rows.crossJoin(F.broadcast(before)).withColumn("_late", F.coalesce(
                F.col(time) < F.col("top") - F.expr(f"INTERVAL '{delay}' SECOND"), F.lit(False))).drop("top")
            seen = seen.unionByName(before).agg(F.max("top").alias("top"))
        rows.filter("NOT _late").drop("_late").write.mode("overwrite").parquet(f"{on_time}/batch={number}")
        rows.filter("_late").drop("_late").write.mode("overwrite").parquet(f"{late}/batch={number}")
        seen.write.mode("overwrite").parquet(f"{marks}/batch={number}")
        kept.unpersist()

    run_batches(stream, each, checkpoint=f"{folder}/progress")
    read = lambda path: _results(spark, stream.schema, path)
    return read(f"{on_time}/*"), read(f"{late}/*")
