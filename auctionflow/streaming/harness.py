"""Running bounded inputs as streams: ordered epochs in, a table out."""

from __future__ import annotations

import datetime
import threading
import time
from collections import deque
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from auctionflow.session import SETTINGS, new_path

CLOSING = "_closing"  # true in the row that closes a bounded stream
START = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def stream_session(spark: SparkSession) -> SparkSession:
    """A session of the runs' own: keyed state in RocksDB, times in UTC, one state partition per core.

    The caller's settings stay as they are."""
    if hasattr(spark, "_base"):
        return spark
    own = getattr(spark, "_streams", None)
    if own is None:
        own = spark.newSession()
        for key in ("spark.sql.streaming.stateStore.providerClass", "spark.sql.session.timeZone"):
            own.conf.set(key, SETTINGS[key])
        own.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
        spark._streams, own._base = own, spark
    return own


def _results(spark: SparkSession, schema, path: str) -> DataFrame:
    """What a run wrote, in the caller's session."""
    return getattr(spark, "_base", spark).read.schema(schema).parquet(path)


def instant(local: Column | str) -> Column:
    """A zone-less time as the instant that it is in UTC, whatever the session's zone."""
    since = (F.col(local) if isinstance(local, str) else local) - F.expr(START)
    part = lambda name: F.extract(F.lit(name), since).cast("bigint")
    micros = (F.extract(F.lit("SECOND"), since) * 1_000_000).cast("bigint")
    return F.timestamp_micros(((part("DAY") * 24 + part("HOUR")) * 60 + part("MINUTE")) * 60_000_000 + micros)


def wall_clock(at: Column | str) -> Column:
    """An instant as the zone-less time that it is in UTC."""
    micros = F.unix_micros(at)
    days, rest = F.floor(micros / 86_400_000_000).cast("bigint"), F.pmod(micros, F.lit(86_400_000_000))
    zero = F.lit(0)
    return F.expr(START) + F.make_dt_interval(days.cast("int"), zero, zero, (rest / F.lit(1_000_000).cast("decimal(18,6)")).cast("decimal(18,6)"))


def zoned(df: DataFrame, *times: str) -> DataFrame:
    """Times as TIMESTAMP, the only type a watermark takes."""
    kinds = dict(df.dtypes)
    return df.withColumns({t: instant(t) if kinds[t] == "timestamp_ntz" else F.col(t) for t in times})


def plain(df: DataFrame) -> DataFrame:
    """Times back as TIMESTAMP_NTZ, as the batch queries give them."""
    return df.select(*[wall_clock(f.name).alias(f.name)
                       if f.dataType.typeName() == "timestamp" else F.col(f.name) for f in df.schema])


def real(stream: DataFrame) -> DataFrame:
    """The stream without its closing row, for operators that give out rows as they come."""
    return stream.filter(f"NOT {CLOSING}").drop(CLOSING)


class Epochs:
    """A table laid down as files in event-time order, and read back one epoch per micro-batch.

    Epochs hold about equally many rows. Each is written on its own and into the same number of
    files, so that the file source, which takes files by modification time, can be told to take
    exactly one epoch at a time. With `order`, epochs follow that column, one per value, and
    times arrive out of order.

    `closing` adds a last row that many seconds beyond the newest one, with -1 for every number
    and true in the column `_closing`; it pushes the watermark past every window and timer of the
    data and never leaves state itself. It has no NULLs, which filters in front of a join would
    drop before the watermark sees them. With `shuffled`, the rows of an epoch lie in its files in
    the order of a hash. The stream belongs to a session of its own.
    """

    def __init__(self, df: DataFrame, time: str, epochs: int = 2, closing: int | None = None,
                 order: str | None = None, shuffled: bool = False):
        self.shuffled = shuffled
        df = df.withColumn(CLOSING, F.lit(False))
        self.spark, self.time, self.schema = stream_session(df.sparkSession), time, df.schema
        self.path = new_path(self.spark, "epochs")
        parts = self._by_time(df, epochs) if order is None else self._by_value(df, order)
        for part in parts:
            self._write(part)
        if closing is not None:
            self._write(self._closing_row(F.timestamp_micros(F.lit(self.last + closing * 1_000_000))))

    def _by_time(self, df: DataFrame, epochs: int) -> list[DataFrame]:
        t = F.col(self.time)
        shares = [i / epochs for i in range(1, epochs)]
        marks = F.percentile_approx(t.cast("double"), shares) if shares else F.array()
        self.first, self.last, rows, found = df.agg(
            F.unix_micros(F.min(t)), F.unix_micros(F.max(t)), F.count("*"),
            F.transform(marks, lambda s: F.unix_micros(F.timestamp_seconds(s)))).first()
        self._share_out(rows // epochs)
        parts, rest = [], df
        for mark in sorted(set(found)):
            parts.append(rest.filter(F.unix_micros(t) < mark))
            rest = df.filter(F.unix_micros(t) >= mark)
        return [*parts, rest]

    def _by_value(self, df: DataFrame, order: str) -> list[DataFrame]:
        sizes = df.groupBy(order).agg(
            F.count("*").alias("n"), F.unix_micros(F.min(self.time)).alias("lo"), F.unix_micros(F.max(self.time)).alias("hi")
        ).orderBy(order).collect()
        self.first, self.last = min(r.lo for r in sizes), max(r.hi for r in sizes)
        self._share_out(min(r.n for r in sizes))
        return [df.filter(F.col(order) == r[0]) for r in sizes]

    def _share_out(self, rows: int) -> None:
        """Files per epoch: one per core, but so few that even the smallest epoch fills them all."""
        self.files = max(1, min(self.spark.sparkContext.defaultParallelism, rows // 1000))

    def _closing_row(self, end: Column) -> DataFrame:
        blank = {"timestamp": end, "string": F.lit(""), "boolean": F.lit(False)}
        return self.spark.range(1).select(*[
            F.lit(True).alias(CLOSING) if f.name == CLOSING
            else blank.get(f.dataType.typeName(), F.lit(-1)).cast(f.dataType).alias(f.name) for f in self.schema])

    def _write(self, rows: DataFrame) -> None:
        placed = rows.repartition(self.files) if self.files > 1 else rows.coalesce(1)
        if self.shuffled:
            placed = placed.sortWithinPartitions(F.xxhash64(*rows.columns))
        placed.write.mode("append").parquet(self.path)

    def origin(self, slide: int):
        """The first event, floored to the slide."""
        return F.timestamp_seconds(F.lit(self.first // 1_000_000 // slide * slide))

    def source(self) -> DataFrame:
        """The epochs as a stream, one per micro-batch."""
        return (self.spark.readStream.schema(self.schema)
                .option("maxFilesPerTrigger", self.files).parquet(self.path))

    def stream(self, delay: str = "0 seconds") -> DataFrame:
        """The same with a watermark on the event time."""
        return self.source().withWatermark(self.time, delay)


class DroppedRows(RuntimeError):
    pass


class Probe(StreamingQueryListener):
    """How far a query has come: asked from outside, while it runs or afterwards.

    The frontier of a query is its watermark, in microseconds: all rows before it are done, later ones may
    still come. A query that is over, after all its input, has no frontier."""

    def __init__(self):
        self.frontier: dict[str, int] = {}
        self.over: dict[str, bool] = {}
        self.progress: dict[str, deque] = {}  # not taken yet
        self.failed: dict[str, str | None] = {}
        self.batch: dict[str, int] = {}
        self.news = threading.Condition()

    def _tell(self, change: Callable[[], None]) -> None:
        with self.news:
            change()
            self.news.notify_all()

    def onQueryStarted(self, event) -> None:
        self._tell(lambda: self.over.setdefault(str(event.runId), False))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        mark = (p.eventTime or {}).get("watermark")

        def add() -> None:
            self.progress.setdefault(str(p.runId), deque(maxlen=10_000)).append(p)
            self.batch[str(p.runId)] = p.batchId
            if mark:
                at = datetime.datetime.fromisoformat(mark.replace("Z", "+00:00"))
                self.frontier[str(p.runId)] = round(at.timestamp() * 1_000_000)
        self._tell(add)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        def end() -> None:
            self.over[str(event.runId)] = True
            self.failed[str(event.runId)] = event.exception
        self._tell(end)

    def take(self, query) -> list:
        """The progress of the query's micro-batches since the last call."""
        with self.news:
            new = self.progress.get(str(query.runId), deque())
            return [new.popleft() for _ in range(len(new))]

    def less_than(self, query, time: int) -> bool:
        """Whether rows before `time` (microseconds) may still come or are under way."""
        with self.news:
            return not self._done(query) and self.frontier.get(str(query.runId), -2**62) < time

    def less_equal(self, query, time: int) -> bool:
        """The same for rows up to `time`."""
        with self.news:
            return not self._done(query) and self.frontier.get(str(query.runId), -2**62) <= time

    def _done(self, query) -> bool:
        run_id = str(query.runId)
        return self.over.get(run_id, False) and self.failed.get(run_id) is None

    def done(self, query) -> bool:
        """Whether the query is over, without an error."""
        with self.news:
            return self._done(query)

    def catch_up(self, query) -> None:
        """Wait until all that the query has done has been heard of."""
        run_id, last = str(query.runId), (query.lastProgress or {}).get("batchId", -1)
        self.wait_while(lambda: self.batch.get(run_id, -1) < last or not (query.isActive or self.over.get(run_id, False)))

    def wait_while(self, asked: Callable[[], bool], seconds: float = 600) -> bool:
        """Wait until `asked` is false, looking again at every piece of news; false if it took too long."""
        end = time.monotonic() + seconds
        while asked():
            with self.news:
                if not self.news.wait(min(1.0, max(0.0, end - time.monotonic()))) and time.monotonic() >= end:
                    return False
        return True


def probe(spark: SparkSession) -> Probe:
    """The probe of the session's streams; it hears of every micro-batch, however fast they come."""
    if not hasattr(spark, "_probe"):
        spark._probe = Probe()
        spark.streams.addListener(spark._probe)
    return spark._probe


def _finish(spark: SparkSession, query, allow_late: bool, progress: list | None, until_idle: bool = False) -> None:
    """Wait for the end, adding up dropped rows on the way; a stream without end goes on until stopped."""
    heard, run_id, late = probe(spark), str(query.runId), 0

    def look() -> None:
        nonlocal late
        for p in heard.take(query):
            late += sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
            if progress is not None:
                progress.append(p)
        if late and not allow_late:
            query.stop()
            raise DroppedRows(f"{late} rows came after the watermark")

    if until_idle:
        quiet, last = 0, None
        while quiet < 2:  # a source that is held back may say once that there is nothing
            query.processAllAvailable()
            now = (query.lastProgress or {}).get("batchId")
            quiet, last = (quiet + 1 if now == last else 0), now
            look()
        query.stop()
    while not query.awaitTermination(0.2):
        look()
    # the listener is told of the end after the last batch
    heard.wait_while(lambda: not heard.over.get(run_id, False), 60)
    look()


def _trigger(until_idle: bool) -> dict:
    return {"processingTime": "0 seconds"} if until_idle else {"availableNow": True}


def run(stream: DataFrame, allow_late: bool = False, progress: list | None = None, path: str | None = None,
        checkpoint: str | None = None, trigger: dict | None = None, until_idle: bool = False) -> DataFrame:
    """Run an append-mode stream over its input and return what it wrote.

    `path` and `checkpoint` name the folders of the output and of the stream's progress; a run with
    the folders of an earlier one goes on where that stopped. `trigger` is that of `writeStream`,
    by default all input there is, then the end. `until_idle` is for sources that give out more after
    every batch: batch follows batch until there is nothing more.
    """
    spark = stream.sparkSession
    probe(spark)
    path = path or new_path(spark, "sink")
    query = (stream.writeStream.format("parquet").option("path", path)
             .option("checkpointLocation", checkpoint or new_path(spark, "progress"))
             .outputMode("append").trigger(**(trigger or _trigger(until_idle))).start())
    _finish(spark, query, allow_late, progress, until_idle)
    return _results(spark, stream.schema, path)


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], mode: str = "append",
                allow_late: bool = False, checkpoint: str | None = None, trigger: dict | None = None, until_idle: bool = False) -> list:
    """Run a stream with `each(batch, number)` called per micro-batch; a retry repeats a number.

    `checkpoint`, `trigger` and `until_idle` as for `run`; the progress of the batches is returned."""
    spark, progress = stream.sparkSession, []
    probe(spark)
    query = (stream.writeStream.foreachBatch(each)
             .option("checkpointLocation", checkpoint or new_path(spark, "progress"))
             .outputMode(mode).trigger(**(trigger or _trigger(until_idle))).start())
    _finish(spark, query, allow_late, progress, until_idle)
    return progress
