"""Exact arithmetic on vectors of whole numbers: which vectors take part, and products and distances without rounding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST, MOST = -(1 << 63), (1 << 63) - 1


def floored(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component as a long; null if the vector is null or holds a null or non-finite component."""
    x = F.transform(vector, lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(fine, F.transform(x, lambda v: F.floor(v * scale)))


def extent(rows: DataFrame, column: str, multiple: int = 1) -> tuple[int, int, int]:
    """(number of rows, longest vector's length rounded up to a multiple, largest size of a component), found in one pass."""
    size = F.greatest(F.array_max(column), -1 - F.array_min(column))  # without overflow at the least long
    n, length, most = rows.agg(F.count("*"), F.max(F.size(column)), F.max(size)).first()
    return n, -(-(length or 0) // multiple) * multiple, int(most or 0)


def padded(vector: Column, length: int, most: int) -> Column:
    """The vector with zeros at its end up to a length, as ints if the largest component allows it."""
    kind = "int" if most < 1 << 31 else "long"
    return F.concat(vector, F.array_repeat(F.lit(0).cast("long"), F.greatest(F.lit(length) - F.size(vector), F.lit(0)))).cast(f"array<{kind}>")


def matrix(column: pa.Array, length: int) -> np.ndarray:
    """Vectors of one length as a matrix of 64-bit whole numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), length)


def exact(length: int, *tables: np.ndarray) -> list[np.ndarray]:
    """The tables in a type in which sums of `length` squares or products of (sums of two of) their values are exact: floats, longs, or Python's integers."""
    most = max((max(int(t.max()), -int(t.min())) for t in tables if t.size), default=0)
    bound = 4 * max(length, 1) * most * most
    kind = np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 63 else object
    return [t.astype(kind) for t in tables]


def longs(values: np.ndarray) -> np.ndarray:
    """Exact values as 64-bit numbers; those beyond take the nearest."""
    if values.dtype == object:
        values = np.array([min(max(int(v), LEAST), MOST) for v in values.ravel()], dtype=np.int64).reshape(values.shape)
    return values.astype(np.int64)


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of all rows of a to all rows of b, exact in the type of `exact`."""
    return (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]
