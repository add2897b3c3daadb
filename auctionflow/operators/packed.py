"""Running sums of signed changes per word, moved in packed pieces of one to a few bytes a change.

A task packs its changes, some at a time: what it has of a word is one row, a piece, with the steps from each
time to the next and the changes at them as variable-length integers. Its pieces of a word are merged before they
leave it, as many as fit its memory. Pieces are stored and shuffled once each; behind the shuffle a word's pieces are merged and summed up, a bounded number of changes at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auctionflow.session import fits_broadcast, store

PACK = 1_000_000  # changes that a task packs at a time,
PACK_BYTES = 64 << 20  # or bytes of them
MERGE_BYTES = 64 << 20  # of pieces that a task merges before they leave it
AT_ONCE = 250_000  # changes that a task unpacks at a time, if they are of more than one word
HOT = 1_000_000  # changes of a word that one task may sum up
EVERY = 64  # a hot word's times are looked at in steps of so many changes
FAR = np.uint64(1 << 60)  # longer steps begin a new piece

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
PIECE = "word string, at long, last long, n long, steps binary, odd binary"


def packable(changes: DataFrame) -> bool:
    word, time, diff = (changes.schema[c].dataType for c in ("word", "time", "diff"))
    return word == T.StringType() and isinstance(time, INTEGERS) and isinstance(diff, INTEGERS)


def running_sums(changes: DataFrame) -> DataFrame:
    """(time, word, n): the sum of the word's changes up to a time, for all times whose changes don't cancel out.

    Words of up to `HOT` changes are summed up whole. Those that may have more are cut at times that part their
    changes evenly; each part begins with the sum of the parts before it, which comes as a row of the shuffle.
    """
    kind = changes.schema["time"].dataType
    pieces = store(changes.select("word", *[F.col(c).cast("long") for c in ("time", "diff")]).mapInArrow(
        _pack, f"{PIECE}, lead long"), "pieces")
    # a word has no more pieces than there are leading ones
    most, packs = pieces.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("lead"), F.lit(0))).first()
    pieces = pieces.drop("lead")
    if most * packs <= HOT:
        sums = _summed(pieces, ["word"])
    else:
        hot = store(pieces.filter(F.col("n") * packs > HOT).select(F.col("word").alias("_h")).distinct(), "hot")
        hot = F.broadcast(hot) if fits_broadcast(hot) else hot
        here = F.col("word").eqNullSafe(F.col("_h"))
        sums = _summed(pieces.join(hot, here, "left_anti"), ["word"]).unionByName(
            _summed(_parts(pieces.join(hot, here, "left_semi")), ["word", "part"]))
    return sums.withColumn("time", F.col("time").cast(kind))


def _summed(pieces: DataFrame, keys: list[str]) -> DataFrame:
    kept = pieces.drop("last")
    return kept.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_sum_up, "time long, word string, n long")


def _parts(pieces: DataFrame) -> DataFrame:
    """Pieces cut so that none reaches into the next part, and what comes before a part as a piece without changes."""
    order = Window.partitionBy("word").orderBy("time").rowsBetween(Window.unboundedPreceding, -1)
    cuts = (
        pieces.mapInArrow(_points, "word string, time long, n long").groupBy("word", "time").agg(F.sum("n").alias("n"))
        .withColumn("_part", F.floor(F.coalesce(F.sum("n").over(order), F.lit(0)) / HOT))
        .groupBy("word", "_part").agg(F.min("time").alias("cut")).filter("_part > 0")
        .groupBy(F.col("word").alias("_w")).agg(F.sort_array(F.collect_list("cut")).alias("cuts")))
    cuts = store(cuts, "cuts")
    cuts = F.broadcast(cuts) if fits_broadcast(cuts) else cuts
    cut = pieces.join(cuts, F.col("word").eqNullSafe(F.col("_w")), "left").select(
        *pieces.columns,
        F.coalesce(F.size(F.filter("cuts", lambda c: c <= F.col("at"))), F.lit(0)).cast("long").alias("part"),
        F.filter("cuts", lambda c: (c > F.col("at")) & (c <= F.col("last"))).alias("cuts"),
    ).mapInArrow(_cut, f"{PIECE}, part long, total long")
    before = Window.partitionBy("word").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(b"")
    carry = cut.groupBy("word", "part").agg(F.sum("total").alias("total")).select(
        "word", F.lit(None).cast("long").alias("at"), F.lit(None).cast("long").alias("last"), F.lit(0).cast("long").alias("n"),
        none.alias("steps"), none.alias("odd"), "part", F.sum("total").over(before).alias("base")).filter("base <> 0")
    return cut.drop("total").withColumn("base", F.lit(0).cast("long")).unionByName(carry)


# -- in the tasks ---------------------------------------------------------------------------------


def _put(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unsigned numbers in groups of seven bits, the lowest first; the bytes and how many each number has."""
    size = np.ones(len(values), np.int64)
    for bits in range(7, 64, 7):
        more = values >= np.uint64(1 << bits)
        if not more.any():
            break
        size += more
    start = np.cumsum(size) - size
    raw = np.empty(int(size.sum()), np.uint8)
    for j in range(int(size.max(initial=0))):
        at = np.flatnonzero(size > j)
        raw[start[at] + j] = (values[at] >> np.uint64(7 * j)) & np.uint64(127) | ((size[at] > j + 1).astype(np.uint64) << np.uint64(7))
    return raw, size


def _get(raw: np.ndarray) -> np.ndarray:
    """The numbers that `_put` has written."""
    end = np.flatnonzero(raw < 128)
    start = np.concatenate(([0], end[:-1] + 1)) if len(end) else end
    size = end - start + 1
    values = (raw[start] & 127).astype(np.uint64)
    for j in range(1, int(size.max(initial=0))):
        at = np.flatnonzero(size > j)
        values[at] |= (raw[start[at] + j] & 127).astype(np.uint64) << np.uint64(7 * j)
    return values


def _changed(*columns: np.ndarray) -> np.ndarray:
    """True for the first row and for those that differ from the one before in any column."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return new


def _most(values: np.ndarray) -> int:
    return max(int(values.max()), -int(values.min())) if len(values) else 0


def _fits(diff: np.ndarray, base: np.ndarray = np.empty(0)) -> bool:
    """True if no sum of some of the changes, with a base, can go beyond 64 bits."""
    return _most(diff) * len(diff) + _most(base) < 1 << 63


def _net(key: np.ndarray, known: np.ndarray, time: np.ndarray, diff: np.ndarray) -> list[np.ndarray]:
    """The rows by key and time (unknown ones first), changes of one time added up; without those that cancel out."""
    if not len(key):
        return [key, known, time, diff]
    low, high = int(time.min()), int(time.max())
    span = high - low + 2
    if (int(key.max()) + 1) * span < 1 << 62:
        order = np.argsort(key * span + np.where(known, time - low + 1, 0))
    else:
        order = np.lexsort((time, known, key))
    key, known, time, diff = key[order], known[order], time[order], diff[order]
    first = np.flatnonzero(_changed(key, known, time))
    total = np.add.reduceat(diff, first)
    if not _fits(diff) and any(x != y for x, y in zip(np.add.reduceat(diff.astype(object), first), total.tolist())):
        raise OverflowError("a sum of changes goes beyond 64 bits")
    first, total = first[total != 0], total[total != 0]
    return [key[first], known[first], time[first], total]


def _binary(raw: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw)])


def _pieces(head: np.ndarray, known: np.ndarray, time: np.ndarray, diff: np.ndarray) -> dict[str, pa.Array]:
    """Rows in order as pieces that begin where `head` is true; a step of `FAR` must begin one."""
    start, n = np.flatnonzero(head), len(head)
    bounds = np.append(start, n)
    step = np.zeros(n, np.uint64)
    step[1:] = (time[1:] - time[:-1]).view(np.uint64)
    step[head] = 0
    signed = ((diff << 1) ^ (diff >> 63)).view(np.uint64)  # 0, -1, 1, -2, ... as 0, 1, 2, 3, ...
    odd = signed >= 7
    raw, size = _put(step << np.uint64(3) | np.minimum(signed, np.uint64(7)))
    odd_raw, odd_size = _put(signed[odd])
    odd_sizes = np.zeros(n, np.int64)
    odd_sizes[odd] = odd_size
    at, last = (pa.array(time[rows], pa.int64(), mask=~known[rows]) for rows in (start, bounds[1:] - 1))
    return {
        "at": at, "last": last, "n": pa.array(np.diff(bounds), pa.int64()),
        "steps": _binary(raw, np.concatenate(([0], np.cumsum(size)))[bounds]),
        "odd": _binary(odd_raw, np.concatenate(([0], np.cumsum(odd_sizes)))[bounds])}


def _steps_far(time: np.ndarray) -> np.ndarray:
    far = np.zeros(len(time), bool)
    far[1:] = (time[1:] - time[:-1]).view(np.uint64) >= FAR
    return far


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows, size = [], 0, 0
    made, made_size = [], 0
    for batch in chain(batches, [None]):
        if batch is not None:
            held.append(batch)
            rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows and (batch is None or rows >= PACK or size >= PACK_BYTES):
            made.append(_packed(pa.Table.from_batches(held)))
            made_size += made[-1].nbytes
            held, rows, size = [], 0, 0
        if made and (batch is None or made_size >= MERGE_BYTES):
            yield from _merged(made)
            made, made_size = [], 0


def _packed(rows: pa.Table) -> pa.RecordBatch:
    word = rows["word"].dictionary_encode(null_encoding="encode")
    words = word.chunk(word.num_chunks - 1).dictionary  # the one of the last chunk has all
    key = np.concatenate([c.indices.to_numpy(zero_copy_only=False) for c in word.chunks]).astype(np.int64)
    known = rows["time"].is_valid().to_numpy()
    time, diff = (rows[c].fill_null(0).to_numpy() for c in ("time", "diff"))
    return _rows(words, *_net(key, known, time, diff))


def _rows(words: pa.Array, key: np.ndarray, known: np.ndarray, time: np.ndarray, diff: np.ndarray) -> pa.RecordBatch:
    """Rows in order as pieces. Leading are the first one and those that are not the first one of their word."""
    first = _changed(key)
    head = first | _changed(known) | _steps_far(time)
    lead = (~first[head]).astype(np.int64)
    lead[:1] += 1
    return pa.RecordBatch.from_pydict({
        "word": words.take(pa.array(key[head])).cast(pa.string()), **_pieces(head, known, time, diff), "lead": pa.array(lead)})


def _merged(made: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if len(made) == 1:
        yield made[0]
        return
    rows = _joined(made)
    made.clear()
    word = rows["word"].dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    rows = rows.take(pa.array(np.argsort(word, kind="stable")))
    begins = _groups(rows)
    leads = 1
    for lo, hi in _slices(rows, np.append(np.flatnonzero(begins)[1:], rows.num_rows)):
        some = rows.slice(lo, hi - lo)
        word = np.maximum.accumulate(np.where(begins[lo:hi], np.arange(hi - lo), 0))  # the first piece of the same word
        piece, *values = _unpacked(some)
        out = _rows(some["word"], *_net(word[piece], *values))
        if not out.num_rows:
            continue
        lead = out["lead"].to_numpy().copy()
        lead[0] += leads - 1
        leads = 0
        yield out.set_column(out.schema.get_field_index("lead"), "lead", pa.array(lead))


def _column(array: pa.Array) -> np.ndarray:
    """The bytes of all values of a binary array."""
    if not len(array):
        return np.empty(0, np.uint8)
    array = array.cast(pa.large_binary())
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset:array.offset + len(array) + 1]
    data = array.buffers()[2]
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.empty(0, np.uint8)


def _unpacked(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The piece, whether its time is known, the time and the change of everything in the pieces."""
    value = _get(_column(batch["steps"]))
    step, signed = (value >> np.uint64(3)).view(np.int64), value & np.uint64(7)
    signed[signed == 7] = _get(_column(batch["odd"]))
    diff = (signed >> np.uint64(1)).view(np.int64) ^ -(signed & np.uint64(1)).view(np.int64)
    n = batch["n"].to_numpy()
    piece = np.repeat(np.arange(len(n)), n)
    since = np.cumsum(step)
    begin = batch["at"].fill_null(0).to_numpy()
    start = (np.cumsum(n) - n)[n > 0]
    base = np.zeros(len(n), np.int64)
    base[n > 0] = begin[n > 0] - since[start]
    return [piece, batch["at"].is_valid().to_numpy(zero_copy_only=False)[piece], since + base[piece], diff]


def _slices(batch: pa.RecordBatch, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """From and to of rows that together hold at most `AT_ONCE` changes, or go up to the next of `ends`."""
    upto = np.concatenate(([0], np.cumsum(batch["n"].to_numpy())))
    lo = done = 0
    while done < len(ends):
        done = max(done + 1, int(np.searchsorted(upto[ends], upto[lo] + AT_ONCE, "right")))
        yield lo, int(ends[done - 1])
        lo = int(ends[done - 1])


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.concat_batches(batches)


def _groups(batch: pa.RecordBatch) -> np.ndarray:
    """True where a word, or a part of it, begins."""
    word = batch["word"].dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return _changed(word, batch["part"].to_numpy()) if "part" in batch.schema.names else _changed(word)


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []  # pieces of one word, which may have more
    for batch in chain(batches, [None]):
        if batch is not None and held and batch.num_rows and not _groups(_joined([held[-1].slice(held[-1].num_rows - 1), batch]))[1:].any():
            held.append(batch)
            continue
        parts = [*held, *([batch] if batch is not None and batch.num_rows else [])]
        if not parts:
            continue
        rows = _joined(parts)
        begins = np.flatnonzero(_groups(rows))
        ends = begins[1:] if batch is not None else np.append(begins[1:], rows.num_rows)
        for lo, hi in _slices(rows, ends):
            yield _sums(rows.slice(lo, hi - lo))
        held = [rows.slice(int(begins[-1]))] if batch is not None else []


def _sums(rows: pa.RecordBatch) -> pa.RecordBatch:
    begin = _groups(rows)
    group = np.cumsum(begin) - 1
    piece, known, time, diff = _unpacked(rows)
    key, known, time, diff = _net(group[piece], known, time, diff)
    base = np.zeros(int(begin.sum()), np.int64)
    if "base" in rows.schema.names:
        base += np.add.reduceat(rows["base"].to_numpy(), np.flatnonzero(begin))
    first = np.flatnonzero(_changed(key))
    run = np.cumsum(diff)
    run += np.repeat(base[key[first]] - run[first] + diff[first], np.diff(np.append(first, len(key))))
    if not _fits(diff, base):
        _check(key, diff, base, run)
    return pa.RecordBatch.from_pydict({
        "time": pa.array(time, pa.int64(), mask=~known),
        "word": rows["word"].take(pa.array(np.flatnonzero(begin)[key])).cast(pa.string()), "n": pa.array(run)})


def _check(key: np.ndarray, diff: np.ndarray, base: np.ndarray, run: np.ndarray) -> None:
    """The sums once more, without a bound."""
    before, total = None, 0
    for k, d, r in zip(key.tolist(), diff.tolist(), run.tolist()):
        before, total = k, (total if k == before else int(base[k])) + d
        if total != r:
            raise OverflowError("a running sum of changes goes beyond 64 bits")


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every `EVERY`th time of a piece, and how many changes lie from it to the next one."""
    for batch in batches:
        for lo, hi in _slices(batch, np.arange(1, batch.num_rows + 1)):
            rows = batch.slice(lo, hi - lo)
            piece, known, time, _ = _unpacked(rows)
            n = rows["n"].to_numpy()
            place = np.arange(len(piece)) - (np.cumsum(n) - n)[piece]
            at = np.flatnonzero((place % EVERY == 0) & known)
            yield pa.RecordBatch.from_pydict({
                "word": rows["word"].take(pa.array(piece[at])).cast(pa.string()), "time": pa.array(time[at]),
                "n": pa.array(np.minimum(EVERY, n[piece[at]] - place[at]))})


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces cut at the times in `cuts`, with their part and the sum of their changes."""
    for batch in batches:
        for lo, hi in _slices(batch, np.arange(1, batch.num_rows + 1)):
            rows = batch.slice(lo, hi - lo)
            piece, known, time, diff = _unpacked(rows)
            head = _changed(piece)
            part = rows["part"].to_numpy()[piece]
            begins = np.append(np.flatnonzero(head), len(piece))
            cuts = rows["cuts"]
            sizes = cuts.value_lengths().fill_null(0).to_numpy()
            for i in np.flatnonzero(sizes):
                own = slice(begins[i], begins[i + 1])
                part[own] += np.searchsorted(cuts[int(i)].values.to_numpy(), time[own], "right")
            head |= _changed(part)
            start = np.flatnonzero(head)
            total = np.add.reduceat(diff, start)
            if not _fits(diff) and any(x != y for x, y in zip(np.add.reduceat(diff.astype(object), start), total.tolist())):
                raise OverflowError("a sum of changes goes beyond 64 bits")
            yield pa.RecordBatch.from_pydict({
                "word": rows["word"].take(pa.array(piece[head])).cast(pa.string()), **_pieces(head, known, time, diff),
                "part": pa.array(part[head]), "total": pa.array(total)})
