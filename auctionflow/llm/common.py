"""Small helpers shared by the operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auctionflow.session import fits_broadcast

#: Byte translation that lower-cases A-Z and nothing else.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Odd multipliers of the usual 64-bit finalizers.
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def pick(df: DataFrame, *cols: str) -> DataFrame:
    """Only the named columns, so that others can't clash with what an operator adds."""
    return df.select(*[F.col(f"`{c}`") for c in cols])


def chosen(df: DataFrame, ids: DataFrame, how: str, key: str = "doc_id") -> DataFrame:
    """Rows of `df` whose key is (left_semi) or isn't (left_anti) in `ids`; few ids are broadcast."""
    return df.join(F.broadcast(ids) if fits_broadcast(ids, 500_000) else ids, key, how)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; a bijection."""
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


class Hashed(dict):
    """64-bit hash per word, remembered for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= 300_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def word_hashes(words: list[bytes], seen: Hashed) -> np.ndarray:
    return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))


def batch(schema: pa.Schema, **cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [cols[f.name] if isinstance(cols[f.name], pa.Array) else pa.array(cols[f.name], f.type) for f in schema],
        schema=schema)


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column from one numpy array per row."""
    ends = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=ends[1:])
    flat = np.concatenate(values) if values else np.zeros(0, kind.to_pandas_dtype())
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind))
