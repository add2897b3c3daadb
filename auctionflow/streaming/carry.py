"""What a stream has left per key, as a log of runs: a batch writes only the keys that it touched."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auctionflow.session import delete, get_json, put_json

FAN = 4  # runs of a level that become one of the next


class Carry:
    """Rows per key in runs, newest last. A batch adds one run of its own; FAN runs of a level are merged
    into one of the next, so a row is written again once a level, and there are few runs at any time.

    A manifest per batch lists the runs that hold after it. A batch that comes again starts from the
    manifest before it and replaces its own runs; runs go when no manifest that can still be needed has them.
    """

    def __init__(self, folder: str, schema: T.StructType, merge: Callable[[DataFrame], DataFrame]):
        self.folder, self.schema, self.merge = folder, schema, merge

    def _runs(self, spark: SparkSession, number: int) -> list[list]:
        if number < 0:
            return []
        found = get_json(spark, f"{self.folder}/manifest/{number}.json")
        if found is None:
            raise ValueError(f"there is no carry of batch {number}: the folder belongs to another checkpoint")
        return found["runs"]

    def _read(self, spark: SparkSession, runs: Sequence[list]) -> DataFrame:
        parts = [spark.read.schema(self.schema).parquet(f"{self.folder}/{name}") for _, name in runs]
        return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], self.schema)

    def before(self, spark: SparkSession, number: int, touched: DataFrame, keys: Sequence[str]) -> DataFrame:
        """What earlier batches left of the keys in `touched`, not merged."""
        mine = touched.select(*[F.col(k).alias(f"_t_{k}") for k in keys]).distinct()
        on = [F.col(k).eqNullSafe(F.col(f"_t_{k}")) for k in keys]
        return self._read(spark, self._runs(spark, number - 1)).join(mine, on, "left_semi")

    def all(self, spark: SparkSession, number: int) -> DataFrame:
        """What earlier batches left, not merged."""
        return self._read(spark, self._runs(spark, number - 1))

    def add(self, spark: SparkSession, number: int, rows: DataFrame) -> DataFrame:
        """Add a batch's run; its rows as they are stored now."""
        before = self._runs(spark, number - 1)
        runs = [*before, [0, f"run-{number}-0"]]
        rows.write.mode("overwrite").parquet(f"{self.folder}/{runs[-1][1]}")
        while len(runs) >= FAN and len({level for level, _ in runs[-FAN:]}) == 1:
            level, old = runs[-1][0] + 1, runs[-FAN:]
            self.merge(self._read(spark, old)).write.mode("overwrite").parquet(f"{self.folder}/run-{number}-{level}")
            runs = [*runs[:-FAN], [level, f"run-{number}-{level}"]]
        put_json(spark, f"{self.folder}/manifest/{number}.json", {"runs": runs})
        if number > 1:  # the batch before this one won't come again
            for _, name in self._runs(spark, number - 2):
                if [name] not in [r[1:] for r in before]:
                    delete(spark, f"{self.folder}/{name}")
        return self._read(spark, [[0, f"run-{number}-0"]])
