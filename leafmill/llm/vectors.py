"""Whole-number vectors, which the operators on embeddings share.

Defined cases: a null vector, or one with a null or non-finite entry, takes no part; entries
whose 256-fold leaves the range of a long are held at its ends.  Rows are numbered, so rows
of one id stay different rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Products and sums below this are exact in doubles.
EXACT = float(1 << 53)


def whole_numbers(vectors: DataFrame, vec_col: str, scale: int, **columns: Column) -> DataFrame:
    """``x``, an array of floor(scale * entry) as longs, of every row that takes part, beside ``columns``."""
    entry = F.col(vec_col)
    bad = F.exists(entry, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    x = F.transform(entry, lambda c: F.floor(c.cast("double") * F.lit(float(scale))))
    return vectors.where(entry.isNotNull() & ~bad).select(*[c.alias(k) for k, c in columns.items()], x.alias("x"))


def padded(rows: DataFrame) -> DataFrame:
    """The rows with every ``x`` filled up with zeros to the length of the longest."""
    dims = rows.agg(F.max(F.size("x"))).first()[0] or 0
    return rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("x"))))


def matrix(column: pa.Array, dims: int | None = None) -> np.ndarray:
    """An Arrow column of lists as rows of longs; shorter lists are padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(np.asarray(column.offsets))
    flat = np.asarray(column.flatten(), dtype=np.int64)
    dims = int(sizes.max(initial=0)) if dims is None else dims
    if (sizes == dims).all():
        return flat.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims), dtype=np.int64)
    out[np.arange(dims) < sizes[:, None]] = flat
    return out


def exact(x: np.ndarray, most: float) -> np.ndarray:
    """The values as doubles where sums of ``most`` products stay exact, otherwise as Python numbers."""
    return x.astype(np.float64) if most < EXACT else x.astype(object)
