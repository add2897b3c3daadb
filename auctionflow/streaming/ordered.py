"""User logic over keyed state whose rows and timers come in event-time order.

A call to Spark's state from Python costs a tenth of a millisecond, so keys are not kept one by one: they are put into
shards by their hash, and the state of a shard's keys is read and written together, as Arrow tables in pieces.
Rows reach a task in the order of shuffled files and in several chunks. So they wait in the shard's state until
the watermark has passed their time, and then they are handed over key by key in the order of their
times, with the timers between them, by a single timer of Spark's per shard and batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from copy import copy
from functools import reduce
from heapq import heappop, heappush
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

TIMELESS = -(2**62)  # the time of rows without one: they come first
SHARDS = 1024  # groups of keys whose state is read and written together
PIECE = 4096  # rows that are kept, read and written together
TOGETHER = 64  # pieces that are sorted together
AT_ONCE = 100_000  # rows that are given out, or to a function on many keys, at once


def sharded(stream: DataFrame, keys: Sequence[str]) -> GroupedData:
    """The stream grouped by shards of its keys; the last column, `_shard`, is the shard."""
    return stream.withColumn("_shard", F.pmod(F.xxhash64(*keys), F.lit(SHARDS)).cast("int")).groupBy("_shard")


def fields_of(schema: T.StructType) -> T.StructType:
    """The columns without the marks a watermark leaves on them."""
    return T.StructType([T.StructField(f.name, f.dataType) for f in schema])


def arrow_of(schema: T.StructType | str) -> pa.Schema:
    """The columns in Arrow, times without a zone, as pandas has them here."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return pa.schema([pa.field(f.name, pa.timestamp("us") if pa.types.is_timestamp(f.type) else f.type) for f in to_arrow_schema(schema)])


def _pack(batch: pa.RecordBatch) -> tuple:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return (sink.getvalue().to_pybytes(),)


def _unpack(value: tuple) -> pa.Table:
    return pa.ipc.open_stream(bytes(value[0])).read_all()


class Kept:
    """A table in a shard's state, read and written as a whole, in pieces."""

    def __init__(self, handle: StatefulProcessorHandle, name: str, schema: pa.Schema):
        self.schema, self.pieces, self.n = schema, handle.getMapState(name, "number long", "rows binary"), 0

    def read(self) -> pa.Table:
        found = [_unpack(v) for _, v in self.pieces.iterator()]
        self.n = len(found)
        return pa.concat_tables(found) if found else self.schema.empty_table()

    def write(self, table: pa.Table) -> None:
        """The table instead of the one that was read last."""
        batches = [b for b in table.combine_chunks().to_batches(max_chunksize=PIECE) if len(b)]
        for i, batch in enumerate(batches):
            self.pieces.updateValue((i,), _pack(batch))
        for i in range(len(batches), self.n):
            self.pieces.removeKey((i,))
        self.n = len(batches)


class Waiting:
    """Rows of a shard, kept as pieces that are sorted by time, in a map keyed by (first time, last time, number).

    What is due is merged from the pieces that overlap at the moment; a piece is written again only
    if the watermark falls inside it. No rows but those pieces are in memory.
    """

    def __init__(self, handle: StatefulProcessorHandle, schema: T.StructType, time: str, order: Sequence[str], label: str = ""):
        self.names, self.time, self.order = [f.name for f in schema], time, [time, *order]
        self.kinds = arrow_of(schema)
        self.stamps = [f.name for f in schema if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))]
        key = T.StructType([T.StructField(n, T.LongType()) for n in ("lo", "hi", "number")])
        self.pieces = handle.getMapState(f"waiting{label}", key, "rows binary")
        self.number = handle.getValueState(f"number{label}", "n long")

    def _micros(self, times: pd.Series) -> pd.Series:
        return (times.astype("datetime64[us]").astype("int64")).where(times.notna(), TIMELESS)

    def _put(self, rows: pd.DataFrame, number: int) -> None:
        lo, hi = int(rows["_us"].iloc[0]), int(rows["_us"].iloc[-1])
        self.pieces.updateValue((lo, hi, number), _pack(pa.RecordBatch.from_pandas(rows[self.names], self.kinds, preserve_index=False)))

    def _get(self, key: tuple) -> pd.DataFrame:
        rows = _unpack(self.pieces.getValue(key)).to_pandas()
        for name in self.stamps:
            rows[name] = rows[name].astype("datetime64[ns]")
        rows["_us"] = self._micros(rows[self.time])
        return rows

    def add(self, batches: Iterator[pd.DataFrame]) -> int | None:
        """Keep the rows; the first of their times."""
        first, number, pool = None, self.number.get()[0] if self.number.exists() else 0, []

        def keep() -> None:
            nonlocal first, number
            rows = pd.concat(pool, ignore_index=True) if len(pool) > 1 else pool[0]
            pool.clear()
            rows = rows.assign(_us=self._micros(rows[self.time])).sort_values(["_us", *self.order[1:]], kind="stable")
            first = min(int(rows["_us"].iloc[0]), first if first is not None else 2**62)
            for at in range(0, len(rows), PIECE):
                self._put(rows.iloc[at:at + PIECE], number)
                number += 1

        for rows in batches:
            if not len(rows):
                continue
            rows = rows.iloc[:, :len(self.names)].set_axis(self.names, axis=1)  # names that are no identifiers don't arrive
            if pool and list(rows.dtypes) != list(pool[0].dtypes):  # whole numbers beside missing ones would lose digits
                keep()
            pool.append(rows)
            if sum(map(len, pool)) >= PIECE:
                keep()
        if pool:
            keep()
        self.number.update((number,))
        return first

    def due(self, limit: int) -> Iterator[pd.DataFrame]:
        """The rows up to `limit` (microseconds), in order and a few pieces at a time; they are not kept any longer."""
        keys = sorted(tuple(k) for k in self.pieces.keys())
        keys = [k for k in keys if k[0] <= limit]
        pool: pd.DataFrame | None = None
        for at in range(0, len(keys), TOGETHER):
            new = []
            for key in keys[at:at + TOGETHER]:
                rows = self._get(key)
                self.pieces.removeKey(key)
                late = rows["_us"] > limit
                if late.any():
                    self._put(rows[late], key[2])
                new.append(rows[~late])
            pool = pd.concat([*([pool] if pool is not None else []), *new], ignore_index=True).sort_values(
                ["_us", *self.order[1:]], kind="stable")
            after = keys[at + TOGETHER][0] if at + TOGETHER < len(keys) else limit + 1
            ready = pool["_us"] < after
            if ready.any():
                yield pool[ready].reset_index(drop=True)
            pool = pool[~ready]

    def first(self) -> int | None:
        return min((k[0] for k in self.pieces.keys()), default=None)


class Timed(StatefulProcessor):
    """What all of these have: one timer of Spark's per shard, for the first time that waits."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.armed = handle.getValueState("armed", "ms long")

    def _arm(self, first: int | None, timers: Sequence[int] = (), fired: int | None = None) -> None:
        """One timer of Spark's, at the first time that waits, in whole milliseconds. The one that has just
        `fired` goes once this call is over, so the next one must be later."""
        marks = [max(0, -(-first // 1000))] if first is not None else []
        wanted = min([*marks, *timers], default=None)
        now = self.armed.get()[0] if fired is None and self.armed.exists() else None
        if fired is not None and wanted is not None:
            wanted = max(wanted, fired + 1)
        if wanted is not None and (now is None or wanted < now):
            if now is not None:
                self.handle.deleteTimer(now)
            self.handle.registerTimer(wanted)
            self.armed.update((wanted,))
        elif wanted is None and fired is not None:
            self.armed.clear()

    @staticmethod
    def _passed(timerValues, expired) -> int:
        return max(timerValues.getCurrentWatermarkInMs(), expired.getExpiryTimeInMs())

    def close(self) -> None:
        pass


def _joined(outs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Small tables put together, those of the same columns and types."""
    pools: dict[tuple, list[pd.DataFrame]] = {}
    sizes: dict[tuple, int] = {}
    for out in outs:
        kind = (*out.columns, *out.dtypes)
        pools.setdefault(kind, []).append(out)
        sizes[kind] = sizes.get(kind, 0) + len(out)
        if sizes[kind] >= AT_ONCE:
            del sizes[kind]
            yield pd.concat(pools.pop(kind), ignore_index=True)
    for pool in pools.values():
        yield pd.concat(pool, ignore_index=True)


class Ordered(Timed):
    """Calls `on_rows` and `on_timer` key by key: in event-time order, see `in_order`, or without `time` as rows arrive.

    The state of a shard is a table with a row per key: the key, the user's state, the timers that are set."""

    def __init__(self, schema: T.StructType, keys: Sequence[str], time: str | None, order: Sequence[str], state: str | None,
                 on_rows: Callable, on_timer: Callable | None = None, made: Sequence[str] | None = None):
        self.made = list(made) if made else None  # columns to give out; tables may have some of them
        self.schema, self.keys, self.time, self.order = schema, list(keys), time, order
        self.on_rows, self.on_timer = on_rows, on_timer
        whole = (T.LongType, T.IntegerType, T.ShortType, T.ByteType)  # with missing values they arrive as floats
        self.whole = [isinstance(schema[k].dataType, whole) for k in self.keys]
        self.kind = pa.struct(list(arrow_of(state))) if state else pa.null()

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.waiting = Waiting(handle, self.schema, self.time, self.order) if self.time else None
        named = arrow_of(T.StructType([self.schema[k] for k in self.keys]))
        fields = [pa.field(f"key{i}", f.type) for i, f in enumerate(named)]
        self.kept = Kept(handle, "kept", pa.schema([*fields, ("state", self.kind), ("timers", pa.list_(pa.int64()))]))

    def _open(self, kept: dict | None):
        """A key's state from what is kept of it."""
        return tuple(kept.values()) if kept is not None else None

    def _close(self, state) -> tuple | None:
        """What is kept of a key's state."""
        return tuple(state) if state is not None else None

    def _load(self) -> dict[tuple, list]:
        """By key: its state and a heap of its timers."""
        table = self.kept.read()
        columns = [table.column(i).to_pylist() for i in range(table.num_columns)]
        return {key: [self._open(state), timers] for key, state, timers in zip(zip(*columns[:-2]), *columns[-2:])}

    def _save(self, slots: dict[tuple, list]) -> None:
        rows = [(key, self._close(state), sorted(timers)) for key, (state, timers) in slots.items()]
        rows = [r for r in rows if r[1] is not None or r[2]]
        columns = [*([r[0][i] for r in rows] for i in range(len(self.keys))), [r[1] for r in rows], [r[2] for r in rows]]
        self.kept.write(pa.table([pa.array(c, f.type) for c, f in zip(columns, self.kept.schema)], self.kept.schema))

    def _by_key(self, rows: pd.DataFrame) -> Iterator[tuple[tuple, pd.DataFrame]]:
        """Every key with its rows, in the order they have."""
        ids = rows.groupby(self.keys, sort=False, dropna=False).ngroup().to_numpy()
        place = np.argsort(ids, kind="stable")
        rows, ids = rows.take(place), ids[place]
        starts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist()]
        heads = rows[self.keys].iloc[starts]
        columns = [[None if gone else int(v) if whole else v for v, gone in zip(heads[k].tolist(), heads[k].isna())]
                   for k, whole in zip(self.keys, self.whole)]
        for key, start, end in zip(zip(*columns), starts, [*starts[1:], len(ids)]):
            yield key, rows.iloc[start:end].reset_index(drop=True)

    def _call(self, key: tuple, slot: list, f: Callable, *args) -> Iterator[pd.DataFrame]:
        out, slot[0], new = f(key, *args, slot[0])
        for ms in map(int, new if self.on_timer else ()):
            heappush(slot[1], ms)
        yield from (t for t in (out if isinstance(out, list) else [out]) if t is not None and len(t))

    def _together(self, outs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for out in _joined(outs):
            yield out.assign(**{n: None for n in self.made if n not in out.columns})[self.made] if self.made else out

    def _fire(self, key: tuple, slot: list, passed: int, until: int | None = None) -> Iterator[pd.DataFrame]:
        """The key's timers up to `passed`, and before the time `until` (microseconds)."""
        timers = slot[1]
        while timers and timers[0] <= passed and (until is None or timers[0] * 1000 < until):
            ms = heappop(timers)
            while timers and timers[0] == ms:
                heappop(timers)
            yield from self._call(key, slot, self.on_timer, ms)

    def _arrived(self, slots: dict, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = self.schema.names
        for rows in batches:
            if len(rows):
                for key, part in self._by_key(rows.iloc[:, :len(names)].set_axis(names, axis=1)):
                    yield from self._call(key, slots.setdefault(key, [self._open(None), []]), self.on_rows, part)

    def _came_due(self, slots: dict, passed: int) -> Iterator[pd.DataFrame]:
        for ready in self.waiting.due(passed * 1000) if self.waiting else ():
            for key, rows in self._by_key(ready):
                slot = slots.setdefault(key, [self._open(None), []])
                us, rows = rows["_us"].to_numpy(), rows.drop(columns="_us")
                if not self.on_timer:
                    yield from self._call(key, slot, self.on_rows, rows)
                    continue
                # a timer that on_rows asks for may lie before the next time, so with timers every time is a batch
                ends = [*(np.flatnonzero(np.diff(us)) + 1).tolist(), len(us)]
                for start, end in zip([0, *ends], ends):
                    yield from self._fire(key, slot, passed, int(us[start]))
                    yield from self._call(key, slot, self.on_rows, rows.iloc[start:end].reset_index(drop=True))
        for key, slot in slots.items():
            yield from self._fire(key, slot, passed)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if self.waiting:
            self._arm(self.waiting.add(rows))
            return
        slots = self._load()
        yield from self._together(self._arrived(slots, rows))
        self._save(slots)
        if self.on_timer:
            self._arm(None, [slot[1][0] for slot in slots.values() if slot[1]])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed, slots = self._passed(timerValues, expiredTimerInfo), self._load()
        yield from self._together(self._came_due(slots, passed))
        self._save(slots)
        first = self.waiting.first() if self.waiting else None
        self._arm(first, [slot[1][0] for slot in slots.values() if slot[1]], expiredTimerInfo.getExpiryTimeInMs())


def in_order(stream: DataFrame, keys: Sequence[str], time: str | None, order: Sequence[str], state: str | None, schema: str | T.StructType,
             on_rows: Callable, on_timer: Callable | None = None, made: Sequence[str] | None = None) -> DataFrame:
    """A stream operator made of the user's functions, which see every key's rows and timers in time order.

    `on_rows(key, rows, state)` gets a pandas batch, sorted by `time` and the columns of `order`, of
    rows that the watermark has passed, each batch later than those before it. It returns (rows to
    give out or None, new state or None to drop it, timers in ms). `on_timer(key, ms, state)` comes after all
    rows up to its time and before all later ones, and returns the same; a timer in the past comes at
    once. With `on_timer`, a batch holds the rows of one time. Rows without a time come first. `time` can be another column than
    that of the watermark; with None, rows come as they arrive. A key's state is in one task, which holds a few pieces of
    its rows and the states of its shard in memory.
    """
    mode = "EventTime" if time or on_timer else "None"
    return sharded(stream, keys).transformWithStateInPandas(
        Ordered(fields_of(stream.schema), keys, time, order, state, on_rows, on_timer, made), schema, "Append", mode)


class Together(Timed):
    """Calls functions on the rows and states of many keys, see `together`."""

    def __init__(self, schema: T.StructType, state: T.StructType, on_rows: Callable, on_timers: Callable):
        self.names, self.state, self.on_rows, self.on_timers = schema.names, arrow_of(state), on_rows, on_timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.kept = Kept(handle, "kept", self.state)

    def _keep(self, state: pd.DataFrame) -> None:
        self.kept.write(pa.Table.from_pandas(state[self.state.names], self.state, preserve_index=False))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state, pool = self.kept.read().to_pandas(), []
        for batch in rows:
            pool.append(batch.iloc[:, :len(self.names)].set_axis(self.names, axis=1))
            if sum(map(len, pool)) >= AT_ONCE:
                state, pool = self.on_rows(pd.concat(pool, ignore_index=True), state), []
        if pool:
            state = self.on_rows(pd.concat(pool, ignore_index=True), state)
        self._keep(state)
        self._arm(None, [int(state["timer"].min())] if len(state) else [])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self.kept.read().to_pandas()
        due = state["timer"] <= self._passed(timerValues, expiredTimerInfo)
        out, rest = self.on_timers(state[due].reset_index(drop=True)), state[~due]
        self._keep(rest)
        self._arm(None, [int(rest["timer"].min())] if len(rest) else [], expiredTimerInfo.getExpiryTimeInMs())
        if out is not None and len(out):
            yield out


def together(stream: DataFrame, keys: Sequence[str], state: str, schema: str, on_rows: Callable, on_timers: Callable) -> DataFrame:
    """A stream operator for very many small keys, whose functions see many of them at a time, in tables.

    `on_rows(rows, state)` gets rows of many keys as they arrive, in no order, and the table of all that is kept for those and
    other keys; it returns that table anew. Its columns are those of `state`, without missing values; one is `timer`, in
    ms. `on_timers(due)` gets the rows of the table whose timer the watermark has passed, which are not kept any longer, and returns rows to give
    out. All that belongs to a key is in the same shard.
    """
    return sharded(stream, keys).transformWithStateInPandas(
        Together(fields_of(stream.schema), T.StructType.fromDDL(state), on_rows, on_timers), schema, "Append", "EventTime")


class Reclocked(Timed):
    """Holds rows until a tick at or after them has come; ticks are rows whose `_tick` is true."""

    def __init__(self, schema: T.StructType, time: str, tick: str):
        self.schema, self.time, self.tick = schema, time, tick

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.waiting = Waiting(handle, self.schema, self.time, ())
        self.ticks = Waiting(handle, T.StructType([self.schema[self.time]]), self.time, (), "_ticks")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ticks: list[pd.DataFrame] = []

        def without_ticks() -> Iterator[pd.DataFrame]:
            for batch in rows:
                batch = batch.iloc[:, :len(self.schema)].set_axis(self.schema.names, axis=1)
                is_tick = batch["_tick"].to_numpy(bool)
                ticks.append(batch.loc[is_tick, [self.time]].dropna().drop_duplicates())
                yield batch[~is_tick]

        self.waiting.add(without_ticks())
        self._arm(self.ticks.add(iter([pd.concat(ticks, ignore_index=True).drop_duplicates()])))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for ticks in self.ticks.due(self._passed(timerValues, expiredTimerInfo) * 1000):
            due = np.unique(ticks["_us"].to_numpy())
            for rows in self.waiting.due(int(due[-1])):  # all later rows are after these ticks
                at = due[np.searchsorted(due, rows["_us"].to_numpy())]
                yield rows.drop(columns=["_us", "_tick"]).assign(**{self.tick: pd.to_datetime(at, unit="us").astype("datetime64[ns]")})
        self._arm(self.ticks.first(), (), expiredTimerInfo.getExpiryTimeInMs())


def _blank(kind: T.DataType):
    """A value that is not missing, so that whole numbers beside it stay whole."""
    if isinstance(kind, T.NumericType):
        return F.lit(0).cast(kind)
    return {"string": F.lit(""), "boolean": F.lit(False)}.get(kind.typeName(), F.lit(None).cast(kind))


def reclock(stream: DataFrame, clock: DataFrame, time: str, tick: str, shards: int | None = None) -> DataFrame:
    """Add `tick`, the first tick of the clock at or after the row's time; rows wait for it, those after the last tick for ever.

    `clock` has the ticks in the column `time`; both streams have a watermark on it. Rows are spread
    over `shards` by their hash, and every shard is told every tick, so no task holds all rows.
    """
    shards = shards or stream.sparkSession.sparkContext.defaultParallelism
    rows = stream.withColumn("_tick", F.lit(False)).withColumn("_shard", F.pmod(F.xxhash64(*stream.columns), F.lit(shards)).cast("int"))
    ticks = clock.select(
        *[F.col(time) if f.name == time else _blank(f.dataType).alias(f.name) for f in stream.schema], F.lit(True).alias("_tick"),
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("_shard"))
    both = rows.unionByName(ticks)
    fields = fields_of(both.drop("_shard").schema)
    out = T.StructType([*[f for f in fields if f.name != "_tick"], T.StructField(tick, T.TimestampType())])
    return both.groupBy("_shard").transformWithStateInPandas(Reclocked(fields, time, tick), out, "Append", "EventTime")


class Count:
    """A number per key that starts at 0."""

    kind = pa.int64()

    def open(self, kept: int | None) -> Count:
        """The handle of a key, from what is kept of it."""
        own = copy(self)
        own.n = kept or 0
        return own

    def keep(self) -> int | None:
        return self.n or None

    def get(self) -> int:
        return self.n

    def set(self, value: int) -> None:
        self.n = int(value)

    def increase(self, amount: int = 1) -> int:
        self.set(self.get() + amount)
        return self.get()

    def decrease(self, amount: int = 1) -> int:
        return self.increase(-amount)


class Value:
    """A value per key; `merge(old, change)` says what a change makes of it, of None where there is none."""

    def __init__(self, schema: str, merge: Callable | None = None):
        self.kind, self.merge = pa.struct(list(arrow_of(schema))), merge

    def open(self, kept: dict | None) -> Value:
        own = copy(self)
        own.value = tuple(kept.values()) if kept is not None else None
        return own

    def keep(self) -> tuple | None:
        return self.value

    def get(self) -> tuple | None:
        return self.value

    def set(self, value: tuple) -> None:
        self.value = tuple(value)

    def take(self) -> tuple | None:
        """The value, which is gone then."""
        value, self.value = self.value, None
        return value

    def rmw(self, change) -> tuple:
        value = self.merge(self.get(), change)
        self.set(value)
        return value


class Items:
    """A list per key."""

    def __init__(self, schema: str):
        self.kind = pa.list_(pa.struct(list(arrow_of(schema))))

    def open(self, kept: list[dict] | None) -> Items:
        own = copy(self)
        own.values = [tuple(v.values()) for v in kept or ()]
        return own

    def keep(self) -> list[tuple] | None:
        return self.values or None

    def append(self, *values: tuple) -> None:
        self.values.extend(tuple(v) for v in values)

    def get(self) -> list[tuple]:
        return list(self.values)

    def take(self) -> list[tuple]:
        values, self.values = self.values, []
        return values


class Map:
    """A map per key, whose own keys are tuples; `merge` as for Value. It is iterated in the order of its keys."""

    def __init__(self, key: str, value: str, merge: Callable | None = None):
        self.kind = pa.list_(pa.struct([("k", pa.struct(list(arrow_of(key)))), ("v", pa.struct(list(arrow_of(value))))]))
        self.merge = merge

    def open(self, kept: list[dict] | None) -> Map:
        own = copy(self)
        own.values = {tuple(e["k"].values()): tuple(e["v"].values()) for e in kept or ()}
        return own

    def keep(self) -> list[tuple] | None:
        return list(self.values.items()) or None

    def insert(self, key: tuple, value: tuple) -> None:
        self.values[tuple(key)] = tuple(value)

    def contains(self, key: tuple) -> bool:
        return tuple(key) in self.values

    def get(self, key: tuple) -> tuple | None:
        return self.values.get(tuple(key))

    def remove(self, key: tuple) -> tuple | None:
        """The value of a key, which is gone then."""
        return self.values.pop(tuple(key), None)

    def rmw(self, key: tuple, change) -> tuple:
        value = self.merge(self.get(key), change)
        self.insert(key, value)
        return value

    def iterate(self, prefix: tuple = ()) -> list[tuple[tuple, tuple]]:
        """The entries whose key begins with `prefix`, in the order of their keys."""
        return sorted((e for e in self.values.items() if e[0][:len(prefix)] == tuple(prefix)), key=lambda e: e[0])


class Handled(Ordered):
    """Rows in time order for a function that works on state handles."""

    def __init__(self, schema: T.StructType, keys: Sequence[str], time: str, order: Sequence[str], states: dict, on_rows: Callable):
        super().__init__(schema, keys, time, order, None, lambda key, rows, own: (on_rows(key, rows, own), own, ()))
        self.states = states
        self.kind = pa.struct([(name, state.kind) for name, state in states.items()])

    def _open(self, kept: dict | None) -> SimpleNamespace:
        return SimpleNamespace(**{name: state.open(kept[name] if kept else None) for name, state in self.states.items()})

    def _close(self, own: SimpleNamespace) -> tuple | None:
        kept = tuple(getattr(own, name).keep() for name in self.states)
        return kept if any(k is not None for k in kept) else None


def with_state(stream: DataFrame, keys: Sequence[str], time: str, order: Sequence[str], states: dict[str, Count | Value | Items | Map],
               schema: str, on_rows: Callable) -> DataFrame:
    """`on_rows(key, rows, handles)` gives rows to give out, or None; `handles` has a state of each kind in `states` by
    its name. Rows come in time order as for `in_order`, and states are kept per key."""
    return sharded(stream, keys).transformWithStateInPandas(
        Handled(fields_of(stream.schema), keys, time, order, states, on_rows), schema, "Append", "EventTime")


def operator(inputs: dict[str, DataFrame], keys: Sequence[str], time: str, order: Sequence[str], state: str | None,
             outputs: dict[str, str], on_rows: Callable, on_timer: Callable | None = None) -> DataFrame:
    """An operator with any number of inputs and outputs in one stateful pass, as a stream of tagged rows.

    Rows come as for `in_order`, with the name of their input in the column `input`; what only other inputs have is
    0 or empty. The functions return ({output: rows}, state, timers). The stream has the column `output`
    and all outputs' columns, which have one type each by their name; `files.run_outputs` takes it apart.
    """
    columns: dict[str, T.DataType] = {}
    for df in inputs.values():
        columns.update({f.name: f.dataType for f in df.schema})
    parts = [df.select(*[F.col(c) if c in df.columns else _blank(kind).alias(c) for c, kind in columns.items()], F.lit(name).alias("input"))
             for name, df in inputs.items()]
    both = reduce(DataFrame.unionByName, parts)
    made: dict[str, T.DataType] = {"output": T.StringType()}
    for schema in outputs.values():
        for f in T.StructType.fromDDL(schema):
            if made.setdefault(f.name, f.dataType) != f.dataType:
                raise ValueError(f"two outputs have a column {f.name} of different types")

    def tagged(f: Callable | None) -> Callable | None:
        def call(key, *args):
            found, state, timers = f(key, *args)
            return [rows.assign(output=name) for name, rows in (found or {}).items() if rows is not None and len(rows)], state, timers
        return call if f else None

    schema = T.StructType([T.StructField(n, k) for n, k in made.items()])
    return in_order(both, keys, time, order, state, schema, tagged(on_rows), tagged(on_timer), list(made))
