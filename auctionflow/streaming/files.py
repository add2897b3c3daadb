"""Sinks made of a user's functions, written in two phases: tasks write, the driver commits or aborts a batch."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage

from auctionflow.session import new_path
from auctionflow.sources.custom import open_store
from auctionflow.streaming.harness import _finish, _trigger, probe


class Outlet:
    """What a user's sink does. Nothing that was written counts before its batch is committed; a batch can come again."""

    def write(self, batches: Iterator[pa.RecordBatch]) -> object:
        """Write a task's rows, and say what was written."""
        raise NotImplementedError

    def commit(self, said: list, batch: int) -> None:
        """Make what the tasks of a batch have written count, instead of what an earlier run of it has."""
        raise NotImplementedError

    def abort(self, said: list, batch: int) -> None:
        """Clear up after a batch that failed; tasks that failed have said nothing."""


class _Said(WriterCommitMessage):
    def __init__(self, said):
        self.said = said


def register_sink(spark: SparkSession, name: str, outlet: Outlet) -> None:
    """Make `outlet` a format of `writeStream`; it travels with the tasks."""
    class Writer(DataSourceStreamArrowWriter):
        def write(self, iterator):
            return _Said(outlet.write(iterator))

        def commit(self, messages, batchId):
            outlet.commit([m.said for m in messages if m is not None], batchId)

        def abort(self, messages, batchId):
            outlet.abort([m.said for m in messages if m is not None], batchId)

    class Sink(DataSource):
        @classmethod
        def name(cls):
            return name

        def streamWriter(self, schema, overwrite):
            return Writer()

    spark.dataSource.register(Sink)


@contextmanager
def active(spark: SparkSession) -> Iterator[None]:
    """The name of a sink is looked up in the session that the JVM holds active in this thread, which can be any or none:
    inside, it is `spark`."""
    sessions = spark.sparkContext._jvm.org.apache.spark.sql.classic.SparkSession
    before = sessions.getActiveSession()
    sessions.setActiveSession(spark._jsparkSession)
    try:
        yield
    finally:
        if before.isDefined():
            sessions.setActiveSession(before.get())
        else:
            sessions.clearActiveSession()


class TaggedFiles(Outlet):
    """Parquet files below a folder, one folder for each value of a column, and a manifest for each committed batch.

    Files that no manifest names don't count: those of failed tasks, aborted batches and batches that were run again."""

    def __init__(self, folder: str, tag: str):
        self.folder, self.tag = folder, tag

    def write(self, batches: Iterator[pa.RecordBatch]) -> list[list]:
        where, root = open_store(self.folder)
        writers: dict[str, tuple] = {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            tags = table.column(self.tag)
            for tag in tags.unique().to_pylist():
                rows = table.filter(pa.compute.equal(tags, tag)).drop_columns([self.tag])
                if tag not in writers:
                    where.create_dir(f"{root}/{tag}", recursive=True)
                    name = f"{tag}/{uuid.uuid4().hex}.parquet"
                    writers[tag] = (name, pq.ParquetWriter(f"{root}/{name}", rows.schema, filesystem=where))
                writers[tag][1].write_table(rows)
        for _, w in writers.values():
            w.close()
        return [[tag, name] for tag, (name, _) in writers.items()]

    def commit(self, said: list, batch: int) -> None:
        where, root = open_store(self.folder)
        where.create_dir(f"{root}/manifest", recursive=True)
        files = [{"batch": batch, "tag": tag, "file": name} for task in said for tag, name in task]
        with where.open_output_stream(f"{root}/manifest/{batch}.new") as f:
            f.write("".join(json.dumps(x) + "\n" for x in files).encode())
        where.move(f"{root}/manifest/{batch}.new", f"{root}/manifest/{batch}.json")

    def abort(self, said: list, batch: int) -> None:
        where, root = open_store(self.folder)
        for task in said:
            for _, name in task:
                where.delete_file(f"{root}/{name}")


def committed(spark: SparkSession, folder: str, tag: str, schema: str | T.StructType) -> DataFrame:
    """The committed rows of a tag."""
    listed = spark.read.schema("batch long, tag string, file string").option("pathGlobFilter", "*.json").json(f"{folder}/manifest")
    files = [f"{folder}/{r.file}" for r in listed.filter(F.col("tag") == tag).select("file").collect()]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def run_outputs(stream: DataFrame, outputs: dict[str, str], folder: str | None = None, checkpoint: str | None = None,
                allow_late: bool = False, trigger: dict | None = None, until_idle: bool = False) -> dict[str, DataFrame]:
    """Run the tagged stream of `ordered.operator` and give each output as a table."""
    spark = stream.sparkSession
    folder = folder or new_path(spark, "outputs")
    probe(spark)
    name = "files_" + uuid.uuid4().hex
    register_sink(spark, name, TaggedFiles(folder, "output"))
    with active(spark):
        query = (stream.writeStream.format(name).option("checkpointLocation", checkpoint or new_path(spark, "progress"))
                 .outputMode("append").trigger(**(trigger or _trigger(until_idle))).start())
    _finish(spark, query, allow_late, None, until_idle)
    own = getattr(spark, "_base", spark)
    return {tag: committed(own, folder, tag, schema) for tag, schema in outputs.items()}
