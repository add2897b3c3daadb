"""Stream-stream joins. A time bound keeps their state finite; without one, both sides are kept for ever.

The joins in built-in operators keep every row in Spark's state store, which takes longer for a row than all the
rest. `Joined` ones keep their sides as tables instead, in logs of runs (see `carry`): a micro-batch joins its new rows
with the other side's, new and old. It reads what is kept of a side only if the other one has new rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auctionflow.functions import seconds
from auctionflow.session import get_json, new_path, put_json
from auctionflow.streaming.carry import Carry
from auctionflow.streaming.harness import DroppedRows, _results, run_batches


def new_sellers(persons: DataFrame, auctions: DataFrame, within: int) -> DataFrame:
    """As the batch query, on two streams with watermarks on date_time."""
    p = persons.select(F.col("id").alias("person"), F.col("date_time").alias("joined"))
    a = auctions.select("seller", F.col("date_time").alias("opened"))
    return a.join(p, (F.col("seller") == F.col("person")) & (F.col("opened") >= F.col("joined"))
                  & (F.col("opened") < F.col("joined") + seconds(within))).select("person")


def local_items(auctions: DataFrame, persons: DataFrame, retain: int | None = None, category: int = 10,
                states: Sequence[str] = ("OR", "ID", "CA")) -> DataFrame:
    """As the batch query; with `retain`, for people and auctions at most that many seconds apart."""
    p = persons.filter(F.col("state").isin(*states)).select(
        F.col("id").alias("person"), "name", "city", "state", F.col("date_time").alias("joined"))
    a = auctions.filter(F.col("category") == category).select(
        F.col("id").alias("auction"), "seller", F.col("date_time").alias("opened"))
    on = F.col("seller") == F.col("person")
    if retain is not None:
        on = (on & (F.col("opened") >= F.col("joined") - seconds(retain))
              & (F.col("opened") <= F.col("joined") + seconds(retain)))
    return a.join(p, on).select("name", "city", "state", "auction")


def hash_join(left: DataFrame, right: DataFrame, within: int | None = None) -> DataFrame:
    """Inner join of two (key, val, ts) streams; with `within`, of rows less than that many seconds apart."""
    l = left.select(F.col("key").alias("_lk"), F.col("val").alias("val1"), F.col("ts").alias("_lt"))
    r = right.select(F.col("key").alias("_rk"), F.col("val").alias("val2"), F.col("ts").alias("_rt"))
    on = F.col("_lk") == F.col("_rk")
    if within is not None:
        on = on & (F.col("_lt") > F.col("_rt") - seconds(within)) & (F.col("_lt") < F.col("_rt") + seconds(within))
    return l.join(r, on).select("val1", "val2")


def closing_auctions(auctions: DataFrame, bids: DataFrame, longest: int | None = None) -> DataFrame:
    """The winning bid of each auction once the watermark passes its expiry, in built-in operators.

    `auctions` has its watermark on `expires`, `bids` on `date_time`. The join keeps an auction
    until it expires, and the aggregate one bid per open auction. Bids are kept for ever, or for
    `longest` seconds, if no auction is open for longer; one that is fails the query.
    """
    if longest is not None:
        kept = F.col("expires") <= F.col("date_time") + seconds(longest)
        auctions = auctions.withColumn("reserve", F.when(F.coalesce(kept, F.lit(True)), F.col("reserve")).otherwise(
            F.raise_error(F.lit("an auction is open for longer than promised"))))
    a = auctions.select("id", "reserve", "seller", "category", "expires", F.col("date_time").alias("opened"))
    b = bids.select("auction", "bidder", "price", F.col("date_time").alias("bid_time"))
    valid = ((F.col("price") >= F.col("reserve")) & (F.col("bid_time") >= F.col("opened"))
             & (F.col("bid_time") < F.col("expires")))
    if longest is not None:
        valid = valid & (F.col("expires") <= F.col("bid_time") + seconds(longest))
    rank = F.struct(F.col("price").alias("p"), (-F.unix_micros("bid_time")).alias("t"),
                    (-F.col("bidder")).alias("b"), "bid_time", "seller", "category")
    return (
        b.join(a, (F.col("auction") == F.col("id")) & valid)
        .groupBy("expires", "auction").agg(F.max(rank).alias("w"))
        .select("auction", "w.seller", "w.category", "expires", F.col("w.p").alias("price"),
                (-F.col("w.b")).alias("bidder"), "w.bid_time")
    )


class Joined:
    """What a join of streams gives, micro-batch by micro-batch: `step(batch, number)` is what it gives for a batch of
    `inputs`, which has the rows of all sides, tagged. A batch that comes again gives the same."""

    def __init__(self, sides: dict[str, DataFrame], schema: T.StructType, step: Callable[[DataFrame, int], DataFrame]):
        self.sparkSession, self.schema, self.step = next(iter(sides.values())).sparkSession, schema, step
        kinds = {name: T.StructType([T.StructField(f.name, f.dataType) for f in df.schema]) for name, df in sides.items()}
        self.inputs = reduce(DataFrame.unionByName, [
            df.select(*[(F.struct(*[F.col(c).alias(c, metadata={}) for c in df.columns]) if other == name
                         else F.lit(None).cast(kinds[other])).alias(other) for other in sides]) for name, df in sides.items()])

    def select(self, *columns: Column | str) -> Joined:
        made, step = Joined.__new__(Joined), self.step
        made.sparkSession, made.inputs = self.sparkSession, self.inputs
        made.schema = self.sparkSession.createDataFrame([], self.schema).select(*columns).schema
        made.step = lambda batch, number: step(batch, number).select(*columns)
        return made

    def run(self, folder: str | None = None) -> DataFrame:
        """All that the join gives; with the `folder` of an earlier run it goes on from there."""
        folder = folder or new_path(self.sparkSession, "joined")
        run_batches(self.inputs, lambda b, i: self.step(b, i).write.mode("overwrite").parquet(f"{folder}/out/batch={i}"),
                    checkpoint=f"{folder}/progress")
        return _results(self.sparkSession, self.schema, f"{folder}/out/*")


def _side(batch: DataFrame, name: str) -> DataFrame:
    return batch.filter(F.col(name).isNotNull()).select(f"{name}.*")


def _none(df: DataFrame) -> DataFrame:
    """A table with the columns of a stream and no rows."""
    return df.sparkSession.createDataFrame([], T.StructType([T.StructField(f.name, f.dataType) for f in df.schema]))


def _pairs(join: Callable[[DataFrame, DataFrame], DataFrame], left: tuple[DataFrame, DataFrame], right: tuple[DataFrame, DataFrame]) -> DataFrame:
    """What new rows add to a join, of both sides' (old, new) rows."""
    out = join(left[1], right[0].unionByName(right[1]))
    return out if right[1].isEmpty() else out.unionByName(join(left[0], right[1]))


def join_batches(left: DataFrame, right: DataFrame, join: Callable[[DataFrame, DataFrame], DataFrame],
                 folder: str | None = None) -> Joined:
    """The inner join `join(left rows, right rows)` of two streams of any order, both of which are kept for ever.

    The streams should have only the columns that it needs. With the `folder` of an earlier run it goes on from there."""
    sides = {"left": left, "right": right}
    folder = folder or new_path(left.sparkSession, "sides")
    empty = {name: _none(df) for name, df in sides.items()}
    kept = {name: Carry(f"{folder}/{name}", df.schema, lambda rows: rows) for name, df in empty.items()}

    def step(batch: DataFrame, number: int) -> DataFrame:
        own = batch.sparkSession
        both = [(kept[name].all(own, number), kept[name].add(own, number, _side(batch, name))) for name in sides]
        return _pairs(join, *both)

    return Joined(sides, join(*empty.values()).schema, step)


def closing_batches(auctions: DataFrame, bids: DataFrame, longest: int | None = None, delay: int = 0,
                    folder: str | None = None) -> Joined:
    """As `closing_auctions`, with both sides and the best bids so far as tables.

    The frontier is the smaller one of the newest expiry and the newest bid, less `delay` seconds; auctions are given out with
    the batch that takes it to their expiry. A row from before the frontier that earlier batches reached fails the query.
    """
    folder = folder or new_path(auctions.sparkSession, "closing")
    sides = {"a": auctions.select("id", "reserve", "seller", "category", "expires", F.col("date_time").alias("opened")),
             "b": bids.select("auction", "bidder", "price", F.col("date_time").alias("bid_time"))}
    empty = {name: _none(df) for name, df in sides.items()}

    def join(b: DataFrame, a: DataFrame) -> DataFrame:
        valid = (F.col("price") >= F.col("reserve")) & (F.col("bid_time") >= F.col("opened")) & (F.col("bid_time") < F.col("expires"))
        return b.join(a, (F.col("auction") == F.col("id")) & valid).select(
            "expires", "auction", "price", (-F.unix_micros("bid_time")).alias("t"), (-F.col("bidder")).alias("b"), "seller", "category")

    def best(rows: DataFrame) -> DataFrame:
        rank = F.struct("price", "t", "b", "seller", "category")
        return rows.groupBy("expires", "auction").agg(F.max(rank).alias("w")).select("expires", "auction", "w.*")

    def closed(rows: DataFrame) -> DataFrame:
        return rows.select("auction", "seller", "category", "expires", "price", (-F.col("b")).alias("bidder"),
                           F.timestamp_micros(-F.col("t")).alias("bid_time"))

    found = best(join(empty["b"], empty["a"]))

    def step(batch: DataFrame, number: int) -> DataFrame:
        own = batch.sparkSession
        before = get_json(own, f"{folder}/marks/{number - 1}.json") if number > 0 else {"a": None, "b": None}
        if before is None:
            raise ValueError(f"there is no frontier of batch {number}: the folder belongs to another checkpoint")
        mark = _frontier(before, delay)

        def still(time: str, rows: DataFrame, longer: int = 0) -> DataFrame:
            """Rows that can matter to this batch or to later ones."""
            return rows if mark is None else rows.filter(F.unix_micros(time) > mark - longer * 1_000_000)

        carries = {"a": Carry(f"{folder}/a", empty["a"].schema, lambda rows: still("expires", rows)),
                   "b": Carry(f"{folder}/b", empty["b"].schema, lambda rows: rows if longest is None else still("bid_time", rows, longest)),
                   "best": Carry(f"{folder}/best", found.schema, lambda rows: best(still("expires", rows)))}
        old = {name: carry.all(own, number) for name, carry in carries.items()}
        new = {name: carries[name].add(own, number, _side(batch, name)) for name in sides}
        newest, behind = {}, 0
        for name, time in (("a", "expires"), ("b", "bid_time")):
            at = F.unix_micros(time)
            late = F.lit(False) if mark is None else at <= mark if name == "a" else at < mark
            last, n = new[name].agg(F.max(at), F.count_if(late)).first()
            newest[name], behind = max((x for x in (before[name], last) if x is not None), default=None), behind + n
        if behind:
            raise DroppedRows(f"{behind} rows came after the watermark")
        if longest is not None and not new["a"].filter(F.col("expires") > F.col("opened") + seconds(longest)).isEmpty():
            raise ValueError("an auction is open for longer than promised")
        put_json(own, f"{folder}/marks/{number}.json", newest)
        a = still("expires", old["a"]), new["a"]
        b = old["b"] if longest is None else still("bid_time", old["b"], longest), new["b"]
        fresh = carries["best"].add(own, number, best(_pairs(join, b, a)))
        now = _frontier(newest, delay)
        over = still("expires", old["best"]).unionByName(fresh)
        return closed(best(over.filter(F.lit(False) if now is None else F.unix_micros("expires") <= now)))

    return Joined(sides, closed(found).schema, step)


def _frontier(newest: dict, delay: int) -> int | None:
    """Up to where all sides have come, in microseconds."""
    return None if None in newest.values() else min(newest.values()) - delay * 1_000_000
