"""Session set-up and the places where lineage is cut."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app: str = "auctionflow", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this package expects; `conf` keys use `__` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def runs_in_one_process(master: str) -> bool:
    """True for local masters, whose executor shares the driver's folders."""
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only in local mode, where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not runs_in_one_process(spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="auctionflow-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


FIXED_WIDTH = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.DayTimeIntervalType)
_stored: dict[str, list[str]] = {}
_tables: dict[str, str] = {}


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared one, remembered for `drop_stored`."""
    path = f"{shared_dir(spark)}/auctionflow/{label}-{uuid.uuid4().hex}"
    _stored.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def drop_stored(spark: SparkSession) -> int:
    """Delete the tables this application has stored, once no result that reads them is needed."""
    paths = _stored.pop(spark.sparkContext.applicationId, [])
    for name in paths:
        if name in _tables:
            spark.sql(f"DROP TABLE IF EXISTS {_tables.pop(name)}")
        delete(spark, name)
    return len(paths)


def store(df: DataFrame, label: str = "table") -> DataFrame:
    """Write `df` to the shared folder and read it back: columnar, with real sizes; for large tables."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored._stored_at = path
    return stored


def store_bucketed(df: DataFrame, keys: Sequence[str], label: str = "table") -> DataFrame:
    """Like `store`, but laid out by the hash of `keys`, as wide as a shuffle: a join or an aggregate on
    them reads it where it lies, and only the other side is shuffled."""
    spark = df.sparkSession
    path, n = new_path(spark, label), int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = path.rpartition("/")[2].replace("-", "_")
    df.repartition(n, *keys).write.option("path", path).bucketBy(n, *keys).sortBy(*keys).saveAsTable(name)
    _tables[path] = name
    stored = spark.table(name)
    stored._stored_at = path
    return stored


def forget(*tables: DataFrame) -> None:
    """Delete tables that `store` gave, after their last reader; others are left alone."""
    for table in tables:
        path = getattr(table, "_stored_at", None)
        if path is not None:
            session = table.sparkSession
            if path in _tables:
                session.sql(f"DROP TABLE IF EXISTS {_tables.pop(path)}")
            delete(session, path)
            known = _stored.get(session.sparkContext.applicationId, [])
            if path in known:
                known.remove(path)


def put_json(spark: SparkSession, path: str, content: dict) -> None:
    """Write a small file that is there as a whole or not at all; a retry replaces it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    target, fresh = hadoop.Path(path), hadoop.Path(f"{path}.new")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(fresh, True)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    fs.delete(target, False)
    if not fs.rename(fresh, target):
        raise OSError(f"cannot name {path}")


def get_json(spark: SparkSession, path: str) -> dict | None:
    """What `put_json` wrote, or None."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(target):
        return None
    stream = fs.open(target)
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint `df` in the shared folder: short plan, survives lost executors; for loop state."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def slots(spark: SparkSession) -> int:
    """How many ways a hot key should be split at most: the shuffle width."""
    return max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fits_broadcast(df: DataFrame, max_rows: int = 250_000, max_bytes: int = 64 << 20) -> bool:
    """True if `df` has at most `max_rows` rows, and what they hold at most `max_bytes`. Looks for one row beyond
    them, a few partitions at a time, so a large table is given up after its first ones; only columns
    without a fixed width are measured."""
    if df.select(F.lit(1)).offset(max_rows).take(1):
        return False
    wide = [f.name for f in df.schema if not isinstance(f.dataType, FIXED_WIDTH)]
    if not wide:
        return True
    size = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in wide])))
    return (df.agg(F.sum(size.cast("bigint"))).first()[0] or 0) <= max_bytes


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs inside sends at most `rows` rows to Python at a time; for rows that are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def spread(scan: DataFrame) -> DataFrame:
    """Use all cores on a scan that has fewer splits than cores; larger scans stay as they are."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)
