"""Sources made of a user's functions: as a table of pieces, or as a source with offsets that can be read as a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema


def from_function(plan: DataFrame, read: Callable[[dict], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """The rows that `read` gives for each row of `plan`, which describes one piece of the source.

    The pieces are dealt out evenly and read by the tasks, in batches as they come; the driver
    opens nothing, and a lost task reads its pieces again. `plan` is a table like any other, so it
    can be the result of a query, and of any length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in batch.to_pylist():
                yield from read(piece)

    return plan.hint("rebalance").mapInArrow(run, schema)


class Feed:
    """What a user's source tells about itself. Places count from 0; what lies before a place never changes."""

    schema: str | T.StructType

    def end(self) -> int:
        """The first place that isn't there yet."""
        raise NotImplementedError

    def pieces(self, start: int, stop: int) -> Sequence:
        """Descriptions of pieces that hold the places from `start` to `stop`, each read by one task."""
        raise NotImplementedError

    def read(self, piece, columns: Sequence[str], filters: Sequence[Filter]) -> Iterator[pa.RecordBatch]:
        """The rows of a piece: these columns, and only rows that pass the filters that `takes` took."""
        raise NotImplementedError

    def takes(self, condition: Filter) -> bool:
        """Whether `read` applies this filter."""
        return False


class _Piece(InputPartition):
    def __init__(self, piece):
        super().__init__(piece)


def open_store(path: str) -> tuple[pa.fs.FileSystem, str]:
    """A file system for a path, and the path in it; for tasks and sources, which have no session."""
    if path.startswith("file:"):  # with one slash or three
        return pa.fs.LocalFileSystem(), "/" + path[len("file:"):].lstrip("/")
    return pa.fs.FileSystem.from_uri(path) if ":/" in path else (pa.fs.LocalFileSystem(), path)


class _Batch(DataSourceReader):
    def __init__(self, feed: Feed, schema: T.StructType):
        self.feed, self.columns, self.filters = feed, schema.fieldNames(), []

    def pushFilters(self, filters):
        for f in filters:
            if self.feed.takes(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self):
        return [_Piece(p) for p in self.feed.pieces(0, self.feed.end())]

    def read(self, partition):
        yield from self.feed.read(partition.value, self.columns, self.filters)


class _Stream(DataSourceStreamReader):
    """Gives out at most `ahead` places beyond what has been processed.

    Spark asks for the latest offset only when all batches up to the last one are over, so a second
    question says that what the first one was told is done. (Its `commit` comes too late: with the
    next batch, which would never be there.) A source isn't told where a restarted query goes on. So
    the offset is noted in the folder `marks` before it is given out, and after a restart none before it is."""

    def __init__(self, feed: Feed, schema: T.StructType, ahead: int | None, marks: str | None):
        if ahead and not marks:
            raise ValueError("a source that is held back needs a folder for its marks")
        self.feed, self.columns, self.ahead, self.marks = feed, schema.fieldNames(), ahead, marks
        self.given, self.asked = self._noted() if ahead else 0, False

    def _noted(self) -> int:
        where, path = open_store(f"{self.marks}/mark")
        if where.get_file_info(path).type == pa.fs.FileType.NotFound:
            return 0
        with where.open_input_stream(path) as f:
            return int(f.read())

    def _note(self) -> None:
        where, path = open_store(f"{self.marks}/mark")
        where.create_dir(path.rpartition("/")[0], recursive=True)
        with where.open_output_stream(f"{path}.new") as f:
            f.write(str(self.given).encode())
        where.move(f"{path}.new", path)

    def initialOffset(self):
        return {"place": 0}

    def latestOffset(self):
        if not self.ahead:
            return {"place": self.feed.end()}
        if self.asked or not self.given:
            further = min(self.feed.end(), self.given + self.ahead)
            if further > self.given:
                self.given = further
                self._note()
        self.asked = True
        return {"place": self.given}

    def partitions(self, start, end):
        return [_Piece(p) for p in self.feed.pieces(start["place"], end["place"])] if end["place"] > start["place"] else []

    def read(self, partition):
        yield from self.feed.read(partition.value, self.columns, ())


def register(spark: SparkSession, name: str, feed: Feed) -> None:
    """Make `feed` a format of `spark.read` and `spark.readStream`; it travels with the tasks. The session is
    set to push filters down to Python sources.

    A schema that names some of its columns reads only those. Options of a stream: `ahead`, the most
    places it may be beyond what has been processed, and `marks`, a folder that belongs to the query. A
    stream that is held back gives out more after every batch, so it needs a trigger that goes on: `run`
    with `until_idle`."""
    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return feed.schema

        def reader(self, schema):
            return _Batch(feed, schema)

        def streamReader(self, schema):
            ahead = self.options.get("ahead")
            return _Stream(feed, schema, int(ahead) if ahead else None, self.options.get("marks"))

    spark.dataSource.register(Source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


#: Comparisons that a Parquet file can apply by its row groups' statistics and then by row.
_OPERATORS = {EqualTo: "==", LessThan: "<", LessThanOrEqual: "<=", GreaterThan: ">", GreaterThanOrEqual: ">="}


class ParquetFeed(Feed):
    """Rows of Parquet files, in the order of their names; new files must sort behind those that are there.

    Places are rows. A piece is a range of rows of one file, at most `rows` long; of a file, only the
    row groups that hold it are read, and of them only the asked columns. `limit` hides what lies beyond."""

    def __init__(self, path: str, schema: T.StructType, rows: int = 100_000, limit: int | None = None):
        self.path, self.schema, self.rows, self.limit = path, schema, rows, limit
        self._sizes: dict[str, int] = {}

    def _files(self) -> list[tuple[str, int]]:
        where, root = open_store(self.path)
        names = sorted(f.path for f in where.get_file_info(pa.fs.FileSelector(root)) if f.base_name.endswith(".parquet"))
        for n in names:
            if n not in self._sizes:
                self._sizes[n] = pq.read_metadata(n, filesystem=where).num_rows
        return [(n, self._sizes[n]) for n in names]

    def end(self) -> int:
        n = sum(rows for _, rows in self._files())
        return n if self.limit is None else min(n, self.limit)

    def pieces(self, start: int, stop: int) -> list[tuple[str, int, int]]:
        out, at = [], 0
        for name, n in self._files():
            lo, hi = max(start, at) - at, min(stop, at + n) - at
            out.extend((name, a, min(a + self.rows, hi)) for a in range(lo, hi, self.rows))
            at += n
        return out

    def takes(self, condition: Filter) -> bool:
        return type(condition) in _OPERATORS and len(condition.attribute) == 1 and isinstance(condition.value, (int, float, str)) and not isinstance(condition.value, bool)

    def read(self, piece, columns, filters):
        name, lo, hi = piece
        where, _ = open_store(self.path)
        schema = to_arrow_schema(T.StructType([self.schema[c] for c in columns]))
        tests = [(f.attribute[0], _OPERATORS[type(f)], f.value) for f in filters]
        with pq.ParquetFile(name, filesystem=where) as file:
            at = 0
            for g in range(file.num_row_groups):
                n = file.metadata.row_group(g).num_rows
                a, b = max(lo, at) - at, min(hi, at + n) - at
                at += n
                if a >= b:
                    continue
                found = file.read_row_group(g, columns=list(dict.fromkeys([*columns, *[t[0] for t in tests]]))).slice(a, b - a)
                if tests:
                    found = found.filter(pq.filters_to_expression(tests))
                yield from found.select(columns).cast(schema).to_batches()
