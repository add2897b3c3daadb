"""Keyed state with event-time timers: the operators that no built-in aggregate expresses."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from auctionflow.streaming.ordered import in_order, together


def running_sum(stream: DataFrame) -> DataFrame:
    """(key, id, running) for a stream of (key, id, ts, value): a sum per key after every row, in time order."""
    def fold(key, rows, state):
        running = rows["value"].cumsum() + (state[0] if state else 0)
        return pd.DataFrame({"key": key[0], "id": rows["id"], "running": running}), (int(running.iloc[-1]),)

    return state_machine(stream, ["key"], "total long", "key long, id long, running long", fold, "ts", ["id"])


class Counter(StatefulProcessor):
    """A count per key; a key without state counts from 0."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "count long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n = (self.count.get()[0] if self.count.exists() else 0) + sum(len(r) for r in rows)
        self.count.update((n,))
        yield pd.DataFrame({"key": [key[0]], "n": [n]})

    def close(self) -> None:
        pass


def count_changes(stream: DataFrame) -> DataFrame:
    """(key, n) whenever a micro-batch changed the key's count."""
    return stream.groupBy("key").transformWithStateInPandas(
        Counter(), "key long, n long", "Update", "None")


class MapMerge(StatefulProcessor):
    """A map per key whose values are merged by addition."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.items = handle.getMapState("items", "item string", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        changed = pd.concat([r.groupby("item")["n"].sum() for r in rows]).groupby(level=0).sum()
        out = []
        for item, n in changed.items():
            old = self.items.getValue((item,))[0] if self.items.containsKey((item,)) else 0
            self.items.updateValue((item,), (int(old + n),))
            out.append((key[0], item, int(old + n)))
        yield pd.DataFrame(out, columns=["key", "item", "n"])

    def close(self) -> None:
        pass


def map_changes(stream: DataFrame) -> DataFrame:
    """(key, item, n) for the map entries a micro-batch changed, from (key, item, n)."""
    return stream.groupBy("key").transformWithStateInPandas(
        MapMerge(), "key long, item string, n long", "Update", "None")


def hold(stream: DataFrame) -> DataFrame:
    """(id, ts) released at their new time, from a stream of (key, id, ts, new_ts); no row moves back."""
    held = stream.select("key", "id", "ts", F.greatest("ts", "new_ts").alias("due"))
    release = lambda key, rows, state: (rows[["id", "due"]].rename(columns={"due": "ts"}), None, ())
    return in_order(held, ["key"], "due", ["id"], None, "id long, ts timestamp", release)


NO_BID = -(2**62)  # the time of the best bid of an auction without one
BID = ["price", "time", "bidder"]


def _best_bids(rows: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
    """The auctions with their best valid bid so far, and the bids whose auction has not come."""
    both = pd.concat([state, rows[[c for c in state.columns if c != "timer"]].assign(timer=0)], ignore_index=True) if len(state) else rows.assign(timer=0)
    auctions = both[both["is_auction"]].drop_duplicates("auction", keep="last")
    known = both["auction"].isin(auctions["auction"])
    offers = both.loc[known & (both["time"] != NO_BID), ["auction", *BID]].merge(auctions.drop(columns=BID), on="auction")
    valid = (offers["price"] >= offers["reserve"]) & (offers["time"] >= offers["opened"]) & (offers["time"] < offers["expires"])
    best = offers[valid].sort_values(BID, ascending=[False, True, True]).drop_duplicates("auction")
    none = auctions[~auctions["auction"].isin(best["auction"])].assign(price=-1, time=NO_BID, bidder=-1)
    early = both[~known]
    opened = pd.concat([best, none], ignore_index=True)
    return pd.concat([opened.assign(timer=-(-opened["expires"] // 1000)), early.assign(timer=early["time"] // 1000 + 1)], ignore_index=True)


def _close_auctions(due: pd.DataFrame) -> pd.DataFrame:
    won = due[due["is_auction"] & (due["time"] != NO_BID)]
    at = lambda us: pd.to_datetime(us, unit="us").astype("datetime64[ns]")
    return pd.DataFrame({"auction": won["auction"], "seller": won["seller"], "category": won["category"], "expires": at(won["expires"]),
                         "price": won["price"], "bidder": won["bidder"], "bid_time": at(won["time"])})


def closing_auctions(auctions: DataFrame, bids: DataFrame) -> DataFrame:
    """The winning bid of each auction as a stream; both inputs carry a watermark on date_time.

    The best valid bid is given out when the watermark passes the expiry. Bids that come before their auction
    wait. If the watermark passes a bid whose auction has not come, no auction that could accept it can
    follow, and it is dropped.
    """
    # columns of the other kind hold -1: without NULLs they stay integers in Arrow and pandas
    fill = lambda *names: [F.lit(-1).cast("bigint").alias(n) for n in names]
    a = auctions.filter("id IS NOT NULL AND date_time IS NOT NULL AND expires IS NOT NULL AND reserve IS NOT NULL").select(
        F.col("id").alias("auction"), "date_time", F.lit(True).alias("is_auction"), F.unix_micros("date_time").alias("opened"),
        F.unix_micros("expires").alias("expires"), "reserve", "seller", "category", *fill("price"),
        F.lit(NO_BID).cast("bigint").alias("time"), *fill("bidder"))
    b = bids.filter("auction IS NOT NULL AND date_time IS NOT NULL AND price IS NOT NULL").select(
        "auction", "date_time", F.lit(False).alias("is_auction"), *fill("opened", "expires", "reserve", "seller", "category"), "price",
        F.unix_micros("date_time").alias("time"), "bidder")
    return together(
        a.unionByName(b), ["auction"], "auction long, is_auction boolean, opened long, expires long, reserve long, seller long, "
        "category long, price long, time long, bidder long, timer long",
        "auction long, seller long, category long, expires timestamp, price long, bidder long, bid_time timestamp",
        _best_bids, _close_auctions)


def notify(stream: DataFrame, keys: Sequence[str], state: str, schema: str, on_rows: Callable, on_timer: Callable | None = None,
           time: str | None = None, order: Sequence[str] = ()) -> DataFrame:
    """A stream operator made of the user's functions.

    `on_rows(key, rows, state)` gets a pandas batch of one key's rows and the key's state (a tuple,
    or None) and returns (rows to give out or None, new state or None to drop it, timers in ms).
    `on_timer(key, ms, state)` is called once the watermark has passed a timer and returns the same.
    With `time`, rows and timers come in event-time order (see `in_order`). Without, rows come as they
    arrive: in the order of files and of chunks, which only logic may use that doesn't depend on it;
    then no watermark is needed unless there is `on_timer`. A key's state is in one task.
    For very many small keys see `ordered.together`.
    """
    return in_order(stream, keys, time, order, state, schema, on_rows, on_timer)


def notify_two(left: DataFrame, right: DataFrame, keys: Sequence[str], state: str, schema: str, on_rows: Callable,
               on_timer: Callable | None = None, time: str | None = None, order: Sequence[str] = ()) -> DataFrame:
    """`notify` with two inputs: the column `is_left` tells them apart, and what only the other input
    has is missing. Both have the key columns and, with timers or `time`, the same watermark column."""
    both = left.withColumn("is_left", F.lit(True)).unionByName(right.withColumn("is_left", F.lit(False)), allowMissingColumns=True)
    return notify(both, keys, state, schema, on_rows, on_timer, time, order)


def state_machine(stream: DataFrame, keys: Sequence[str], state: str, schema: str, fold: Callable, time: str,
                  order: Sequence[str] = ()) -> DataFrame:
    """`fold(key, rows, state)` gives (rows to give out, new state); a state of None is dropped, and the
    key starts anew with its next row. Rows come in the order of `time`, ties by `order`, however
    they were laid out, once the watermark has passed them."""
    return notify(stream, keys, state, schema, lambda key, rows, before: (*fold(key, rows, before), ()), time=time, order=order)
