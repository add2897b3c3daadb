"""A live stream kept as a log: the rows of every micro-batch, and how far time had come after it."""

from __future__ import annotations

import json

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auctionflow.session import get_json, new_path, put_json
from auctionflow.sources.custom import ParquetFeed, open_store, register
from auctionflow.streaming.harness import DroppedRows, run_batches

HEAD = "head.json"


def capture(stream: DataFrame, time: str, folder: str | None = None, delay: int = 0, allow_late: bool = False, **how) -> str:
    """Keep a stream's rows and its progress in `folder`, which is given back.

    Every micro-batch leaves its rows and then a manifest with its number, its rows and the frontier,
    in microseconds: the newest time so far less `delay` seconds, which no later row lies before. A row that does is late; it
    fails the run, or with `allow_late` goes to the log's late rows. A batch that is run again replaces
    its own rows and manifest, and only batches with a manifest are part of the log, so it can be
    replayed while it grows. `how` goes to `run_batches`; without a checkpoint of its own the
    log has one in its folder and goes on there.
    """
    spark = stream.sparkSession
    folder = folder or new_path(spark, "log")
    if get_json(spark, f"{folder}/{HEAD}") is None:
        put_json(spark, f"{folder}/{HEAD}", {"time": time, "delay": delay, "schema": stream.schema.json()})

    def each(batch: DataFrame, number: int) -> None:
        before = get_json(batch.sparkSession, f"{folder}/manifest/{number - 1}.json") if number else {"frontier": None}
        if before is None:
            raise ValueError(f"the log has no batch {number - 1}: its folder belongs to another checkpoint")
        rows = batch.persist()
        at, mark = F.unix_micros(time), before["frontier"]
        behind = F.coalesce(at < F.lit(mark), F.lit(False)) if mark is not None else F.lit(False)
        n, late, newest = rows.agg(F.count("*"), F.count(F.when(behind, 1)), F.max(at)).first()
        if late and not allow_late:
            rows.unpersist()
            raise DroppedRows(f"{late} rows came after the frontier")
        rows.filter(~behind).write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
        if late:
            rows.filter(behind).write.mode("overwrite").parquet(f"{folder}/late/batch={number}")
        rows.unpersist()
        reached = [x for x in (mark, newest - delay * 1_000_000 if newest is not None else None) if x is not None]
        put_json(batch.sparkSession, f"{folder}/manifest/{number}.json", {"batch": number, "rows": n - late, "late": late, "frontier": max(reached, default=None)})

    run_batches(stream, each, **{"checkpoint": f"{folder}/progress", **how})
    return folder


def progress(spark: SparkSession, folder: str) -> DataFrame:
    """(batch, rows, late, frontier) of a log, frontier in microseconds."""
    schema = "batch long, rows long, late long, frontier long"
    return spark.read.schema(schema).option("pathGlobFilter", "*.json").json(f"{folder}/manifest")


class LogFeed(ParquetFeed):
    """A log as a feed. Places are batches, so that what is read together was complete together."""

    def __init__(self, folder: str, schema: T.StructType, rows: int = 100_000):
        super().__init__(f"{folder}/rows", schema, rows)
        self.folder, self._end = folder, 0

    def end(self) -> int:
        where, root = open_store(f"{self.folder}/manifest")
        while where.get_file_info(f"{root}/{self._end}.json").type != pyarrow.fs.FileType.NotFound:
            self._end += 1
        return self._end

    def pieces(self, start: int, stop: int) -> list[tuple[str, int, int]]:
        out = []
        for batch in range(start, stop):
            part = ParquetFeed(f"{self.path}/batch={batch}", self.schema, self.rows)
            out.extend(part.pieces(0, part.end()))
        return out


def replay(spark: SparkSession, folder: str, together: int = 1) -> DataFrame:
    """A log as a stream again, `together` of its batches per micro-batch, with the watermark that it had.

    The watermark is that of the manifests: after the same batches it is at the same frontier, so no row of the log is
    behind it, however many batches are read together. It needs `run(..., until_idle=True)`.
    """
    head = get_json(spark, f"{folder}/{HEAD}")
    if head is None:
        raise ValueError(f"{folder} holds no log")
    schema = T.StructType.fromJson(json.loads(head["schema"]))
    name = "log_" + folder.rstrip("/").rpartition("/")[2].replace("-", "_")
    register(spark, name, LogFeed(folder, schema))
    stream = spark.readStream.format(name).option("ahead", together).option("marks", new_path(spark, "marks")).load()
    return stream.withWatermark(head["time"], f"{head['delay']} seconds")
