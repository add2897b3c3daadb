"""Vector codes: each part of a vector becomes the number of its nearest codebook entry.

Rounds after the first are active-entry ones. Every row keeps, for each part, its entry and the exact
squared distance to it. After the entries were updated, a part whose own entry stayed where it
was only looks at the entries that moved: all others are as far as they were, and none of them
was nearer. A part whose entry moved is compared with all entries again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from auctionflow.llm.common import batch, pick
from auctionflow.llm.vectors import check_exact, sound, whole, widest
from auctionflow.operators.skew import skew_join
from auctionflow.session import forget, spread, store

PARTS, ENTRIES, SCALE, ROUNDS = 16, 64, 256, 2


class Codebooks(NamedTuple):
    """`entries[p]` are the whole-numbered entries of part p, one a row; `moved[p]` tells which the last update changed."""

    entries: np.ndarray
    moved: np.ndarray

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.astype(np.int64).ravel().tolist())).encode()).hexdigest()


def _distances(part: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances, exact in float64 (see check_exact)."""
    return (part * part).sum(1)[:, None] - 2 * (part @ entries.T) + (entries * entries).sum(1)


def rescan(part: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest entry, distance) of every row, the lower index of equal ones."""
    d = _distances(part, entries)
    near = d.argmin(1)
    return near, d[np.arange(len(d)), near]


def follow(part: np.ndarray, entries: np.ndarray, moved: np.ndarray, near: np.ndarray, dist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same, from what held before the entries marked in `moved` changed."""
    near, dist = near.astype(np.int64), dist.astype(np.float64)
    changed = np.flatnonzero(moved)
    if not len(changed):
        return near, dist
    lost = moved[near]
    if lost.any():
        near[lost], dist[lost] = rescan(part[lost], entries)
    rest = np.flatnonzero(~lost)
    at, least = rescan(part[rest], entries[changed])
    at = changed[at]
    better = (least < dist[rest]) | ((least == dist[rest]) & (at < near[rest]))
    near[rest[better]], dist[rest[better]] = at[better], least[better]
    return near, dist


def _start(vectors: DataFrame, width: int, parts: int, entries: int, scale: int) -> Codebooks | None:
    """The first entries are those of the vectors of the smallest ids; at most `entries` rows come to the driver."""
    first = vectors.select("vec_id", "vector").orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()
    if not first:
        return None
    rows = whole(pa.array([r["vector"] for r in first], pa.list_(pa.float64())), scale, width)
    books = np.ascontiguousarray(rows.reshape(len(rows), parts, -1).transpose(1, 0, 2))
    return Codebooks(books, np.ones(books.shape[:2], bool))


def _assign(vectors: DataFrame, books: Codebooks, width: int, scale: int, again: bool) -> DataFrame:
    """vec_id, label, vector, code (one byte a part) and dist (float64 a part) of every row."""
    parts = len(books.entries)
    schema = pa.schema([("vec_id", pa.int64()), ("vector", pa.list_(pa.float64())), ("label", pa.string()), ("code", pa.binary()), ("dist", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            rows = whole(b.column("vector"), scale, width)
            check_exact(rows, width // parts)
            rows = rows.reshape(n, parts, -1)
            near, dist = np.empty((n, parts), np.uint8), np.empty((n, parts))
            if again:
                before = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(n, parts)
                far = np.frombuffer(b"".join(b.column("dist").to_pylist()), np.float64).reshape(n, parts)
            for p in range(parts):
                part = np.ascontiguousarray(rows[:, p])
                if again:
                    near[:, p], dist[:, p] = follow(part, books.entries[p], books.moved[p], before[:, p], far[:, p])
                else:
                    near[:, p], dist[:, p] = rescan(part, books.entries[p])
            yield batch(schema, **{f: b.column(f) for f in ("vec_id", "label", "vector")},
                        code=[x.tobytes() for x in near], dist=[x.tobytes() for x in dist])

    return vectors.mapInArrow(run, from_arrow_schema(schema))


def _update(assigned: DataFrame, books: Codebooks, width: int, scale: int) -> Codebooks:
    """Every entry becomes the floored mean of its parts. Tasks add up first; what comes to the
    driver is one row per part and entry, whatever the table's size."""
    parts, entries = books.entries.shape[:2]
    schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width // parts), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            rows = whole(b.column("vector"), scale, width).astype(np.int64).reshape(b.num_rows, parts, -1)
            code = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(b.num_rows, parts)
            for p in range(parts):
                n[p] += np.bincount(code[:, p], minlength=entries)
                np.add.at(sums[p], code[:, p], rows[:, p])
        p, e = np.nonzero(n)
        yield batch(schema, part=p.astype(np.int32), entry=e.astype(np.int32), n=n[p, e], sums=list(sums[p, e]))

    partial = assigned.select("vector", "code").mapInArrow(run, from_arrow_schema(schema))
    totals = partial.select("part", "entry", "n", F.posexplode("sums").alias("at", "x")).groupBy("part", "entry", "at").agg(
        F.sum("n").alias("n"), F.sum("x").alias("total")).collect()
    new = books.entries.copy()
    for r in totals:
        new[r["part"], r["entry"], r["at"]] = r["total"] // r["n"]  # floors
    return Codebooks(new, (new != books.entries).any(2))


def compress(df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, scale: int = SCALE, rounds: int = ROUNDS,
             id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, Codebooks | None]:
    """(rows, codebooks): vec_id, label, vector, code (a byte a part), dist (float64 a part) of every sound vector.

    Vectors that are NULL or hold NULL, NaN or infinity are left out. Components become
    floor(scale * x); vectors are cut into `parts` equal parts, shorter ones (or those whose length
    the number of parts doesn't divide) going on with zeros. Each part's codebook starts as that part
    of the `entries` (at most 256) smallest ids, NULL ids last, equal ids by vector; fewer rows make fewer entries. Each of
    `rounds` rounds assigns parts to the nearest entry, the lower index of equal ones, and moves the entries to the
    floored means; unused ones stay. The rows are those of a last assignment. Repeated rows count
    each. Without a sound vector there are no rows and no codebooks. A component too large for exact sums fails the query.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte: 1 to 256 entries")
    vectors = spread(pick(df, id_col, vector_col, label_col).toDF("vec_id", "vector", "label").filter(sound("vector")).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("vector").cast("array<double>").alias("vector"), F.col("label").cast("string").alias("label")))
    width = widest(vectors, "vector", parts)
    books = _start(vectors, width, parts, entries, scale)
    if books is None:
        empty = vectors.limit(0).withColumns({"code": F.lit(b""), "dist": F.lit(b"")})
        return empty, None
    check_exact(books.entries, width // parts)
    rows, before = vectors, None
    for k in range(rounds + 1):
        assigned = _assign(rows, books, width, scale, k > 0)
        kept = store(assigned.withColumn("vector", F.col("vector").cast(df.schema[vector_col].dataType)), "codes")
        if before is not None:
            forget(before)
        before, rows = kept, kept.withColumn("vector", F.col("vector").cast("array<double>"))
        if k < rounds:
            books = _update(rows, books, width, scale)
    return rows, books


def digest(rows: DataFrame, books: Codebooks | None) -> DataFrame:
    """vec_id, code in hex, error, label_error and codebooks_sha256 of every row; NULL labels are one label."""
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("code", pa.string()), ("error", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch(schema, vec_id=b.column("vec_id"), label=b.column("label"),
                        code=[c.hex() for c in b.column("code").to_pylist()],
                        error=[int(np.frombuffer(d).sum()) for d in b.column("dist").to_pylist()])

    errors = rows.select("vec_id", "label", "code", "dist").mapInArrow(run, from_arrow_schema(schema)).withColumn(
        "_label", F.coalesce(F.concat(F.lit("="), "label"), F.lit("none")))
    sums = errors.groupBy(F.col("_label").alias("_of")).agg(F.sum("error").alias("label_error"))
    return skew_join(errors, sums, "_label", "_of").select(
        "vec_id", "code", "error", "label_error", F.lit(books.sha256() if books else None).cast("string").alias("codebooks_sha256"))


def _sql_books(k: int) -> str:
    return f"""a{k} AS (SELECT v.rn, v.part, min({{'d': list_sum(list_transform(range(1, len(v.x) + 1), lambda j: (v.x[j] - b.x[j]) * (v.x[j] - b.x[j]))), 'e': b.entry}}) AS m
    FROM v JOIN b{k} b ON b.part = v.part GROUP BY v.rn, v.part),
n{k} AS (SELECT v.part, a.m.e AS entry, j, CAST(floor(sum(v.x[j]) / count(*)) AS BIGINT) AS x
    FROM v JOIN a{k} a ON a.rn = v.rn AND a.part = v.part, (SELECT unnest(range(1, 5)) AS j) GROUP BY 1, 2, 3),
b{k + 1} AS (SELECT b.part, b.entry, coalesce(n.x, b.x) AS x FROM b{k} b
    LEFT JOIN (SELECT part, entry, list(x ORDER BY j) AS x FROM n{k} GROUP BY ALL) n ON n.part = b.part AND n.entry = b.entry)"""


#: The query as SQL, for vectors of 64 components.
SQL = f"""WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w,
    row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rn FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT rn, part, w[part * 4 + 1:part * 4 + 4] AS x FROM kept, (SELECT unnest(range(16)) AS part)),
b0 AS (SELECT part, rn - 1 AS entry, x FROM v WHERE rn <= 64),
{_sql_books(0)},
{_sql_books(1)},
{_sql_books(2).split(chr(10) + 'n2')[0].rstrip(',')},
sha AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b2),
e AS (SELECT rn, string_agg(lower(printf('%02x', CAST(m.e AS INTEGER))), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a2 GROUP BY rn)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN e ON e.rn = kept.rn, sha"""
