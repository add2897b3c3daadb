"""Exact search for the highest inner products, by a table of distances to pivots.

Every vector's distances to the pivots are worked out once. For a query q and a candidate x with pivot
p, |d(x, p) - d(q, p)| <= d(x, q); the largest of these bounds over all pivots, with
q.x = (|x|^2 + |q|^2 - d(x, q)^2) / 2, bounds the score from above. Candidates are evaluated from
the highest bound down, until the next bound is below the k-th best score found.

Rows are laid out along their nearest pivots: shards of blocks, each block and shard with the range
of its distances, so that whole shards and blocks are passed over by the same bound. A query starts
with the k-th best score of its own block. Queries meet shards in blocks; nothing is broadcast but
the pivots.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from auctionflow.llm.common import batch, lists, pick
from auctionflow.llm.vectors import check_exact, sound, whole, widest
from auctionflow.session import forget, spread, store

SCALE, TOP, EVERY = 1024, 10, 100
PIVOTS, SAMPLE = 64, 4096  # pivots are chosen among so many vectors, the first by a hash
SHARD, BLOCK, QUERIES = 32_768, 512, 8_192  # most rows of a shard (about), of a block, of a block of queries (about)
ROUNDING = 4e-7  # distances are kept in 32 bits; bounds give way by so much of the largest

BLOCKS = pa.schema([
    ("shard", pa.int64()), ("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("vectors", pa.binary()), ("norms", pa.binary()),
    ("dists", pa.binary()), ("lo", pa.list_(pa.float32())), ("hi", pa.list_(pa.float32())), ("top_norm", pa.float64()),
    ("asking", pa.list_(pa.int32())), ("known", pa.list_(pa.float64()))])
ASKED = pa.schema([
    ("asked", pa.int64()), ("ids", pa.list_(pa.int64())), ("vectors", pa.binary()), ("norms", pa.binary()), ("dists", pa.binary()),
    ("lo", pa.list_(pa.float32())), ("hi", pa.list_(pa.float32())), ("top_norm", pa.float64()), ("known", pa.list_(pa.float64())),
    ("least", pa.float64())])
FOUND = pa.schema([("asked", pa.int64()), ("place", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def choose_pivots(sample: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Up to `n` different vectors, each the farthest from those before it."""
    at, far = [], np.full(len(sample), np.inf)
    while len(at) < min(n, len(sample)) and far.max() > 0:
        at.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[at[-1]]) ** 2).sum(1))
    return sample[at]


def distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (rows * rows).sum(1)[:, None] - 2 * (rows @ pivots.T) + (pivots * pivots).sum(1)
    return np.sqrt(square).astype(np.float32)  # the squares are exact


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, the smaller id of equal ones (ids as _order gives them)."""
    if len(scores) > 4 * k:
        places = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[-k])
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((ids[places], -scores[places]))[:k]]


def search_shard(query: np.ndarray, norm: float, dist: np.ndarray, own: int | None, known: float, k: int, rows: np.ndarray,
                 norms: np.ndarray, dists: np.ndarray, ids: np.ndarray, lo: np.ndarray, hi: np.ndarray,
                 starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(places, scores, evaluated) of the k best rows that reach `known`, in bound order until the exact stop.

    `lo` and `hi` are the distance ranges of the blocks that begin at `starts` (with the end)."""
    give = ROUNDING * (float(dist.max(initial=0)) + float(hi.max(initial=0)))

    def highest(bound: np.ndarray, norms: np.ndarray) -> np.ndarray:
        low = np.maximum(bound.astype(np.float64) - give, 0)
        return (norms + norm - low * low) / 2 + 1e-9 * (norms + norm)

    tops = np.maximum.reduceat(norms, starts[:-1])
    alive = np.flatnonzero(highest(np.maximum(lo - dist, dist - hi).max(1, initial=0), tops) >= known)
    if not len(alive):
        return np.zeros(0, np.int64), np.zeros(0), 0
    places = np.concatenate([np.arange(starts[b], starts[b + 1]) for b in alive])
    if own is not None:
        places = places[ids[places] != own]
    bounds = highest(np.abs(dists[places] - dist).max(1, initial=0), norms[places])
    keep = bounds >= known
    places, bounds = places[keep], bounds[keep]
    order = np.argsort(-bounds, kind="stable")
    places, bounds = places[order], bounds[order]
    got, scores, at, step = np.zeros(0, np.int64), np.zeros(0), 0, 64
    while at < len(places) and bounds[at] >= known:
        new = places[at:at + step]
        got, scores = np.concatenate([got, new]), np.concatenate([scores, rows[new] @ query])
        at, step = at + len(new), step * 2
        first = best(scores, ids[got], k)
        got, scores = got[first], scores[first]
        if len(got) == k:
            known = max(known, scores[-1])
    return got, scores, at


def _order(ids: pa.Array) -> np.ndarray:
    """Ids as numbers that keep their order; NULL comes last."""
    return ids.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False).astype(np.int64)


def _block(ids: list, rows: np.ndarray, pivots: np.ndarray) -> dict:
    norms, dists = (rows * rows).sum(1), distances(rows, pivots)
    return {"ids": ids, "vectors": rows.astype(np.int32).tobytes(), "norms": norms.tobytes(), "dists": dists.tobytes(),
            "lo": dists.min(0), "hi": dists.max(0), "top_norm": float(norms.max())}


def pivot_table(vectors: DataFrame, pivots: np.ndarray, width: int, scale: int, every: int, k: int) -> DataFrame:
    """Blocks of rows with their distances to the pivots, in shards along the nearest pivot.

    `asking` are the places of the queries in a block, `known` the k-th best score each finds there."""
    near = pa.schema([("vec_id", pa.int64()), ("vector", pa.list_(pa.float64())), ("cell", pa.int32()), ("away", pa.float32())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                rows = whole(b.column("vector"), scale, width)
                check_exact(rows, width)
                d = distances(rows, pivots)
                yield batch(near, vec_id=b.column("vec_id"), vector=b.column("vector"), cell=d.argmin(1).astype(np.int32), away=d.min(1))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, rest = TaskContext.get().partitionId(), 0, []

        def block(ids: list, rows: np.ndarray) -> pa.RecordBatch:
            nonlocal number
            number += 1
            out = _block(ids, rows, pivots)
            asking = [i for i, x in enumerate(ids) if x is not None and x % every == 0]
            scores = rows[asking] @ rows.T
            own = np.array([np.nan if x is None else x for x in ids])
            known = []
            for i, s in zip(asking, scores):
                others = s[own != ids[i]]
                known.append(float(np.partition(others, -k)[-k]) if len(others) >= k else -np.inf)
            return batch(BLOCKS, shard=[shard], block=[number], asking=[asking], known=[known],
                         lo=lists([out.pop("lo")], pa.float32()), hi=lists([out.pop("hi")], pa.float32()), **{c: [v] for c, v in out.items()})

        for b in batches:
            rest.append((b.column("vec_id").to_pylist(), whole(b.column("vector"), scale, width)))
            while sum(len(ids) for ids, _ in rest) >= BLOCK:
                ids, rows = sum((i for i, _ in rest), []), np.concatenate([r for _, r in rest])
                yield block(ids[:BLOCK], rows[:BLOCK])
                rest = [(ids[BLOCK:], rows[BLOCK:])]
        ids = sum((i for i, _ in rest), [])
        if ids:
            yield block(ids, np.concatenate([r for _, r in rest]))

    n = vectors.count()
    shards = max(-(-n // SHARD), min(vectors.sparkSession.sparkContext.defaultParallelism, -(-n // 2048)), 1)
    placed = vectors.mapInArrow(place, from_arrow_schema(near))
    order = ["cell", "away", "vec_id", F.xxhash64("vector")]
    ranged = placed.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    kind = vectors.schema["vector"].dataType
    return ranged.select("vec_id", F.col("vector").cast(kind).alias("vector")).mapInArrow(build, from_arrow_schema(BLOCKS))


def _queries(blocks: DataFrame, pivots: np.ndarray, width: int) -> DataFrame:
    """The queries, in blocks along the same order; equal rows ask once."""
    one = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("vec_id", pa.int64()), ("row", pa.binary()), ("known", pa.float64())])

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                rows, at = np.frombuffer(r["vectors"], np.int32).reshape(-1, width), r["asking"]
                yield batch(one, shard=[r["shard"]] * len(at), block=[r["block"]] * len(at), vec_id=[r["ids"][i] for i in at],
                            row=[rows[i].tobytes() for i in at], known=r["known"])

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, now = 0, []

        def out() -> pa.RecordBatch:
            rows = np.frombuffer(b"".join(r["row"] for r in now), np.int32).reshape(-1, width).astype(np.float64)
            made, known = _block([r["vec_id"] for r in now], rows, pivots), [r["known"] for r in now]
            return batch(ASKED, asked=[TaskContext.get().partitionId() * 1_000_000 + number], known=[known], least=[min(known)],
                         lo=lists([made.pop("lo")], pa.float32()), hi=lists([made.pop("hi")], pa.float32()), **{c: [v] for c, v in made.items()})

        for b in batches:
            for r in b.select(["vec_id", "row", "known"]).to_pylist():
                now.append(r)
                if len(now) == QUERIES:
                    yield out()
                    number, now = number + 1, []
        if now:
            yield out()

    rows = blocks.filter(F.size("asking") > 0).select("shard", "block", "ids", "vectors", "asking", "known").mapInArrow(
        take, from_arrow_schema(one))
    total = blocks.agg(F.sum(F.size("asking"))).first()[0] or 0
    rows = rows.groupBy("vec_id", "row").agg(F.min("shard").alias("shard"), F.min("block").alias("block"), F.max("known").alias("known"))
    order = ["shard", "block", "vec_id", "row"]
    return rows.repartitionByRange(max(1, -(-total // QUERIES)), *order).sortWithinPartitions(*order).mapInArrow(group, from_arrow_schema(ASKED))


def _reaches(q: str, s: str) -> Column:
    """Whether some row of a shard may reach the least known score of a block of queries."""
    gap = F.array_max(F.zip_with(F.zip_with(f"{q}_lo", f"{s}_hi", lambda a, b: a - b), F.zip_with(f"{s}_lo", f"{q}_hi", lambda a, b: a - b), lambda a, b: F.greatest(a, b)))
    give = ROUNDING * (F.array_max(f"{q}_hi") + F.array_max(f"{s}_hi"))
    low = F.greatest(F.coalesce(gap.cast("double"), F.lit(0.0)) - give, F.lit(0.0))
    norms = F.col(f"{q}_top") + F.col(f"{s}_top")
    return (norms - low * low) / 2 + 1e-9 * norms >= F.col(f"{q}_least")


def _tiles(asked: DataFrame, blocks: DataFrame) -> DataFrame:
    """(asked, shard) of the blocks of queries and the shards that have to meet."""
    ranges = blocks.select("shard", "top_norm", F.posexplode(F.arrays_zip("lo", "hi")).alias("p", "r")).groupBy("shard", "p").agg(
        F.min("r.lo").alias("lo"), F.max("r.hi").alias("hi"), F.max("top_norm").alias("top")).groupBy("shard").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("p", "lo"))), lambda x: x.lo).alias("s_lo"),
        F.transform(F.array_sort(F.collect_list(F.struct("p", "hi"))), lambda x: x.hi).alias("s_hi"), F.max("top").alias("s_top"))
    last = blocks.agg(F.max("shard")).first()[0]
    heads = asked.select("asked", F.col("lo").alias("q_lo"), F.col("hi").alias("q_hi"), F.col("top_norm").alias("q_top"), F.col("least").alias("q_least"))
    return heads.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(last).cast("bigint")))).join(
        ranges, "shard").filter(_reaches("q", "s")).select("asked", "shard")


def search(df: DataFrame, k: int = TOP, every: int = EVERY, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest inner products of every query, exactly.

    Components become floor(scale * x). Queries are the rows whose id is divisible by `every`;
    candidates are all rows but those of the query's own id. Equal scores go to the smaller id. Vectors
    that are NULL or hold NULL, NaN or infinity take no part; a shorter vector goes on with zeros. A row without an id is a
    candidate, behind all others of its score. Repeated candidates count each; a query that is
    repeated asks once, and different vectors of one id ask each. With fewer candidates there are fewer rows; an
    empty table gives none. A component too large for exact sums fails the query.
    """
    spark = df.sparkSession
    vectors = spread(pick(df, id_col, vector_col).toDF("vec_id", "vector").filter(sound("vector")).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("vector").cast("array<double>").alias("vector")))
    width = widest(vectors, "vector")
    sample = [r[0] for r in vectors.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(SAMPLE).collect()]
    pivots = choose_pivots(whole(pa.array(sample, pa.list_(pa.float64())), scale, width)) if sample else np.zeros((0, width))
    check_exact(pivots, width)
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    blocks = store(pivot_table(vectors, pivots, width, scale, every, k), "pivots")
    asked = store(_queries(blocks, pivots, width), "asked")
    tiles = store(_tiles(asked, blocks), "tiles")
    dims, n_pivots = width, len(pivots)

    def meet(key, left: pa.Table, right: pa.Table) -> pa.Table:
        cols: dict[str, list] = {f.name: [] for f in FOUND}
        if left.num_rows and right.num_rows:
            ids = pa.concat_arrays([c.flatten() for c in left.column("ids").chunks])
            sizes = [len(x) for c in left.column("ids").chunks for x in c]
            starts = np.concatenate([[0], np.cumsum(sizes)])
            load = lambda name, kind, w: np.frombuffer(b"".join(left.column(name).to_pylist()), kind).reshape(-1, *w)
            rows, norms, dists = load("vectors", np.int32, [dims]).astype(np.float64), load("norms", np.float64, []), load("dists", np.float32, [n_pivots])
            ends = [np.array(left.column(c).to_pylist(), np.float32).reshape(-1, n_pivots) for c in ("lo", "hi")]
            order = _order(ids)
            for q in right.to_pylist():
                asks = np.frombuffer(q["vectors"], np.int32).reshape(-1, dims).astype(np.float64)
                ask_norms, ask_dists = np.frombuffer(q["norms"]), np.frombuffer(q["dists"], np.float32).reshape(-1, n_pivots)
                for i, own in enumerate(q["ids"]):
                    places, scores, _ = search_shard(asks[i], ask_norms[i], ask_dists[i], own, q["known"][i], k, rows, norms, dists, order, *ends, starts)
                    for c, v in zip(cols, ([q["asked"]] * len(places), [i] * len(places), [own] * len(places), ids.take(pa.array(places)).to_pylist(), scores.astype(np.int64).tolist())):
                        cols[c].extend(v)
        return pa.table(cols, FOUND)

    left = blocks.select("shard", "ids", "vectors", "norms", "dists", "lo", "hi", "block").join(tiles, "shard")
    right = asked.join(tiles, "asked").select("asked", "shard", "ids", "vectors", "norms", "dists", "known")
    found = left.groupBy("asked", "shard").cogroup(right.groupBy("asked", "shard")).applyInArrow(meet, from_arrow_schema(FOUND))
    first = Window.partitionBy("asked", "place").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The query as SQL: every query against every row.
SQL = """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
    FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10"""
