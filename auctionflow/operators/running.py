"""Running values over ordered rows, split by range so that no key fills one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auctionflow.functions import int_div
from auctionflow.session import store

CHUNK = "_chunk"
HOT = 1_000_000  # rows of a key that one task may order


def _add(a: Column, b: Column) -> Column:
    # a missing side is no change
    return F.coalesce(a + b, a, b)


# kind -> (how totals are combined, how two values are); least and greatest skip NULL
FOLD = {"sum": (F.sum, _add), "count": (F.sum, _add), "min": (F.min, F.least), "max": (F.max, F.greatest)}
# kind -> how rows are folded
FIRST = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
            aggs: dict[str, tuple[str, str]]) -> DataFrame:
    """Add running aggregates per key in the given order, current row included.

    `aggs` maps an output name to (kind, column), kind one of sum, count, min, max. `order`
    should be total within a key. Keys of up to `HOT` rows are shuffled whole, once. Of larger ones
    the rows are range-partitioned by (keys, order), so a key of any
    size covers several chunks of even size; each chunk is accumulated on its own and receives
    the totals of the chunks before it. Only the first key of a chunk can have earlier rows, so
    at most one carry row per chunk exists and the broadcast is bounded by the shuffle width.
    """
    order_cols = [_column(o) for o in order]
    if not keys:
        return _chunked(df, keys, order_cols, aggs)
    df = df if getattr(df, "_stored_at", None) else store(df, "running")
    hot = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > HOT).select(
        *[F.col(k).alias(f"_h_{k}") for k in keys])
    n = hot.count()
    if not n:
        return _whole(df, keys, order_cols, aggs)
    hot = store(hot, "hot")  # at most one key per HOT rows
    hot = F.broadcast(hot) if n <= HOT else hot
    on = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in keys], F.lit(True))
    return _whole(df.join(hot, on, "left_anti"), keys, order_cols, aggs).unionByName(
        _chunked(df.join(hot, on, "left_semi"), keys, order_cols, aggs))


def _whole(df: DataFrame, keys: Sequence[str], order: Sequence[Column], aggs: dict[str, tuple[str, str]]) -> DataFrame:
    """Keys that a task can hold."""
    here = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.select("*", *[FIRST[kind](col).over(here).alias(name) for name, (kind, col) in aggs.items()])


def _chunked(df: DataFrame, keys: Sequence[str], order_cols: Sequence[Column], aggs: dict[str, tuple[str, str]]) -> DataFrame:
    """Keys of any size, in chunks."""
    placed = store(
        df.repartitionByRange(*[F.col(k) for k in keys], *order_cols)
        .withColumn(CHUNK, F.spark_partition_id()), "running")

    totals = placed.groupBy(*keys, CHUNK).agg(
        F.count("*").alias("_rows"),
        *[FIRST[kind](col).alias(f"_t_{name}") for name, (kind, col) in aggs.items()])
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col(CHUNK).alias("_k_chunk"),
        F.sum("_rows").over(before).alias("_before"),
        *[FOLD[kind][0](f"_t_{name}").over(before).alias(f"_c_{name}")
          for name, (kind, _) in aggs.items()],
    ).filter("_before > 0")

    here = Window.partitionBy(*keys, CHUNK).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    local = placed.select(
        "*", *[FIRST[kind](col).over(here).alias(f"_l_{name}") for name, (kind, col) in aggs.items()])
    on = F.col(CHUNK) == F.col("_k_chunk")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = local.join(F.broadcast(carry), on, "left")
    return joined.select(*df.columns, *[
        FOLD[kind][1](F.col(f"_l_{name}"), F.col(f"_c_{name}")).alias(name)
        for name, (kind, _) in aggs.items()])


def trailing(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], rows: int,
             aggs: dict[str, Column], block: int = 100_000) -> DataFrame:
    """Aggregates over the last `rows` rows of a key, current row included.

    Every row gets its position in its key; blocks of `block` positions are framed apart, each
    with a copy of the `rows - 1` rows before it. A key of any size is thus spread over blocks; a
    longer frame makes longer blocks.
    """
    block = max(block, rows)
    one = "_pos"
    placed = running(df, keys, order, {one: ("count", "*")})
    here = int_div(F.col(one) - 1, F.lit(block).cast("bigint"))
    tail = (F.col(one) - 1) % block >= block - (rows - 1)
    spread = placed.withColumn("_home", here).withColumn(
        "_block", F.explode(F.when(tail, F.array(here, here + 1)).otherwise(F.array(here))))
    frame = Window.partitionBy(*keys, "_block").orderBy(one).rowsBetween(-(rows - 1), 0)
    return (
        spread.select("*", *[c.over(frame).alias(n) for n, c in aggs.items()])
        .filter("_block = _home")
        .select(*df.columns, *aggs)
    )


PIECE = 65_536


def expand(df: DataFrame, count: str, index: str, piece: int = PIECE, spread: bool = True) -> DataFrame:
    """Repeat each row `count` times, numbered from 1 in `index`.

    A row with a very large count is first cut into pieces of `piece` repeats, which are spread
    over the cluster before they are unrolled. Without `spread`, for counts that are known to be small, rows stay where they are.
    """
    n = F.col(count)
    step = F.lit(piece).cast("bigint")
    pieces = df.filter(n > 0).withColumn(
        "_from", F.explode(F.sequence(F.lit(1).cast("bigint"), n, step)))
    return (
        (pieces.hint("rebalance") if spread else pieces)
        .withColumn(index, F.explode(F.sequence(F.col("_from"), F.least(n, F.col("_from") + step - 1))))
        .drop("_from")
    )
