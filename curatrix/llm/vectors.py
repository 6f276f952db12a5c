"""Shared pieces of the operators on embedding vectors: usability, packing, pivots."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Number of values of a usable vector.
DIM = 256


def usable(vec: str = "embedding", dim: int = DIM) -> Column:
    """True for a vector of ``dim`` values, none null, NaN or infinite, not all zero; never null."""
    v = F.col(vec)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce((F.size(v) == dim) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def usable_rows(df: DataFrame, id_col: str = "id", vec_col: str = "embedding", dim: int = DIM, *keep: str) -> DataFrame:
    """(id, vec, *keep) of the rows with an id and a usable vector; repeated rows of an id are left in."""
    return df.where(F.col(id_col).isNotNull() & usable(vec_col, dim)).select(F.col(id_col).cast("string").alias("id"), F.col(vec_col).cast("array<float>").alias("vec"), *keep)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The float32 rows of an Arrow list column whose lists all have ``dim`` values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in a way that tiny and huge rows survive."""
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), np.float32(1e-38))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def pack(x: np.ndarray) -> list[bytes]:
    """Rows as bytes: two per value where all rows survive float16 unchanged, else four."""
    half = x.astype(np.float16)
    return [r.tobytes() for r in (half if np.array_equal(half.astype(np.float32), x) else x)]


def unpack(column: pa.Array, dim: int) -> np.ndarray:
    """The float32 rows packed by :func:`pack`."""
    rows = column.to_pylist()
    if all(len(b) == 2 * dim for b in rows):
        return np.frombuffer(b"".join(rows), np.float16).reshape(-1, dim).astype(np.float32)
    return np.stack([np.frombuffer(b, np.float16 if len(b) == 2 * dim else np.float32).astype(np.float32) for b in rows]) if rows else np.zeros((0, dim), np.float32)


def pivot_count(rows: int, least: int = 4, most: int = 65_536) -> int:
    """Pivots for a collection: 1.5 times the square root, or one for 1,000 rows where that is more. ``most`` bounds what is sent to the executors (32 MB)."""
    return int(min(most, max(least, math.ceil(1.5 * math.sqrt(max(rows, 1))), rows // 1000)))


def pick_pivots(vectors: DataFrame, count: int, rows: int | None = None, seed: int = 0) -> np.ndarray:
    """Unit vectors of the ``count`` ids with the smallest hash: a bounded sample that follows the density, so that a crowd gets pivots in proportion.

    With the number of ``rows`` known, only ids with a hash below what about one and a half times ``count`` have are sorted;
    then a task sends its part of these, not ``count`` rows.
    """
    h = F.xxhash64("id", F.lit(seed))
    few = vectors.select("vec", h.alias("h"), "id")
    if rows and rows > 2 * count:
        few = few.where(F.col("h") < F.lit(min((1 << 63) - 1, int(-(1 << 63) + min(1.0, (1.5 * count + 100) / rows) * (1 << 64)))))
    got = few.orderBy("h", "id").limit(count).select("vec").toArrow()
    if not got.num_rows:
        return np.zeros((0, DIM), np.float32)
    x = unit(matrix(got.column("vec"), len(got.column("vec")[0])))
    return x[np.sort(np.unique(np.round(x, 4), axis=0, return_index=True)[1])]
