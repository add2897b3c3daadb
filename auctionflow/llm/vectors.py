"""Vectors as whole numbers: what the vector operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXACT = 2.0**53  # sums below are exact in floating point


def sound(vector: str) -> Column:
    """True of a vector that is there and holds neither NULL nor a number that isn't finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.col(vector).isNotNull() & ~F.exists(vector, bad)


def widest(vectors: DataFrame, vector: str, least: int = 1) -> int:
    """The greatest length, rounded up to a multiple of `least`; shorter vectors go on with zeros."""
    longest = vectors.agg(F.max(F.size(vector))).first()[0] or 0
    return -(-max(longest, 1) // least) * least


def whole(column: pa.Array, scale: int, width: int) -> np.ndarray:
    """floor(scale * x) of every component, as float64 that hold whole numbers; one row a vector."""
    out = np.zeros((len(column), width))
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def check_exact(values: np.ndarray, terms: int) -> None:
    """Fail rather than round: sums of `terms` squared differences must be exact."""
    most = float(np.abs(values).max(initial=0))
    if terms * 4 * most * most >= EXACT:
        raise ValueError(f"a component of {most:g} after scaling is too large for exact sums over {terms} components")
