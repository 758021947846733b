"""Whitening by polarisation: covariances from variances alone.

For two dimensions, ``2 cov(i, j) = var(i + j) - var(i) - var(j)``, so the only thing that is
aggregated over the rows is one sum of squares for each dimension and for each sum of two
dimensions.  Rows are whole numbers; each is centred by the nearest whole mean before it is
squared, and the rest of the mean (at most a half) is taken out afterwards in whole numbers,
so every variance is exact at every size.  Spark adds what its tasks have summed; the driver
sees one number for each pair of dimensions and takes the eigenvectors of that matrix.

The fit list holds every distinct vector once.  Defined cases: vectors are taken as
``vectors.whole_numbers`` says, shorter ones padded with zeros; repeated rows and ids are
whitened alike, null ids too; an empty table gives no rows.  A component without variance
(one distinct vector, or dimensions that depend on each other) has no scale: its ``whitened``
is null and its ``explained`` 0 (null where nothing varies at all); ``identity_error`` is that
of the components with variance, and null without any.  ``deviation`` is null where it does
not fit a long; ``deviation_text`` always has it.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import discard, materialize
from leafmill.llm.vectors import matrix, padded, whole_numbers

#: Eigenvalues below this share of the largest are rounding.
_FLAT = 1e-12
_SAFE = 1 << 62
_ROWS = 4096
_NUMBER = pa.decimal128(38, 0)
_LONG = 1 << 63


def _total(values: np.ndarray, square: bool = False) -> list[int]:
    """Exact column sums (of squares) as Python numbers."""
    peak = max(abs(int(values.max(initial=0))), abs(int(values.min(initial=0))))
    if (peak * peak if square else peak) * max(1, len(values)) >= _SAFE:
        values = values.astype(object)
    return [int(v) for v in ((values * values) if square else values).sum(axis=0)]


def _summed(batches, dims: int, of):
    """(k, total): sums of ``of(rows)`` over a whole task, one row for each number."""
    totals: list[int] = []
    for batch in batches:
        x = matrix(batch.column("x"), dims)
        for at in range(0, len(x), _ROWS):
            found = of(x[at : at + _ROWS])
            totals = [a + b for a, b in zip(totals, found, strict=True)] if totals else found
    if totals:
        yield pa.record_batch([pa.array(range(len(totals)), pa.int64()), pa.array(totals, _NUMBER)], names=["k", "total"])


def _collected(fit: DataFrame, dims: int, of) -> list[int]:
    sums = fit.select("x").mapInArrow(lambda b: _summed(b, dims, of), "k long, total decimal(38,0)")
    return [int(r.total) for r in sums.groupBy("k").agg(F.sum("total").cast("decimal(38,0)").alias("total")).orderBy("k").collect()]


def _pairs(x: np.ndarray, middle: np.ndarray) -> list[int]:
    """Sums of squares of every centred dimension, then of every sum of two."""
    d = x - middle if abs(middle).max(initial=0) + abs(x).max(initial=0) < _SAFE else x.astype(object) - middle.astype(object)
    out = _total(d, square=True)
    for i in range(d.shape[1] - 1):
        out += _total(d[:, i : i + 1] + d[:, i + 1 :], square=True)
    return out


def covariance(squares: list[int], sums: list[int], middle: list[int], n: int) -> list[list[Fraction]]:
    """Exact covariances from sums of squares around ``middle``; divisor ``n``."""
    dims = len(sums)
    rest = [s - n * m for s, m in zip(sums, middle, strict=True)]

    def variance(k: int, left: int) -> Fraction:
        return Fraction(n * squares[k] - left * left, n * n)

    own = [variance(i, rest[i]) for i in range(dims)]
    out, k = [[Fraction(0)] * dims for _ in range(dims)], dims
    for i in range(dims):
        out[i][i] = own[i]
        for j in range(i + 1, dims):
            out[i][j] = out[j][i] = (variance(k, rest[i] + rest[j]) - own[i] - own[j]) / 2
            k += 1
    return out


class Whitener:
    """What the fit has found: means, directions and scales, all bounded by the dimensions."""

    def __init__(self, n: int, sums: list[int], cov: list[list[Fraction]], components: int):
        self.n, self.sums, self.dims = n, sums, len(sums)
        v = np.array([[float(c) for c in row] for row in cov]).reshape(self.dims, self.dims)
        values, vectors = np.linalg.eigh(v) if self.dims else (np.zeros(0), np.zeros((0, 0)))
        order = np.argsort(-values, kind="stable")[:components]
        self.values, self.vectors = values[order], vectors[:, order]
        at = np.abs(self.vectors).argmax(axis=0) if self.dims else np.zeros(0, dtype=int)
        self.vectors = self.vectors * np.where(self.vectors[at, np.arange(len(order))] < 0, -1.0, 1.0)
        trace = float(sum((cov[i][i] for i in range(self.dims)), Fraction(0)))
        top = self.values.max(initial=0)
        self.varies = (self.values > _FLAT * top) & (top > 0)
        self.explained = [None if trace <= 0 else float(e / trace) if ok else 0.0 for e, ok in zip(self.values, self.varies, strict=True)]
        self.scale = np.where(self.varies, 1 / np.sqrt(np.where(self.varies, self.values, 1.0)), np.nan)

    def deviations(self, x: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """n * x - S as doubles, and the exact sum of its squares in each row."""
        reach = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        safe = reach * reach * max(1, self.dims) < _SAFE
        off = (x if safe else x.astype(object)) * self.n - np.array(self.sums, dtype=np.int64 if safe else object)
        return off.astype(np.float64), [int(v) for v in (off * off).sum(axis=1)] if self.dims else [0] * len(x)

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, list[int]]:
        off, squares = self.deviations(x)
        return (off / max(self.n, 1)) @ self.vectors * self.scale, squares


def _moments(batches, model: Whitener):
    """Sums of whitened values and of their products over a whole task."""
    k = int(model.varies.sum())
    n, first, second = 0, np.zeros(k), np.zeros((k, k))
    for batch in batches:
        w, _ = model(matrix(batch.column("x"), model.dims))
        w = w[:, model.varies]
        n, first, second = n + len(w), first + w.sum(axis=0), second + w.T @ w
    if n:
        yield pa.record_batch([pa.array(range(k + k * k), pa.int64()), pa.array([*first, *second.ravel()], pa.float64())], names=["k", "total"])


def identity_error(fit: DataFrame, model: Whitener) -> float | None:
    """Largest entry of the whitened fit list's covariance minus the identity, measured over all its rows."""
    k = int(model.varies.sum())
    if not k:
        return None
    got = fit.select("x").mapInArrow(lambda b: _moments(b, model), "k long, total double").groupBy("k").agg(F.sum("total").alias("total")).orderBy("k").collect()
    mean, second = np.array([r.total for r in got[:k]]) / model.n, np.array([r.total for r in got[k:]]).reshape(k, k) / model.n
    return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())


def fit_whitener(fit: DataFrame, components: int = 4) -> Whitener | None:
    """The whitener of a frame of distinct ``x``; None where it is empty."""
    shape = fit.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("dims")).first()
    if not shape.n:
        return None
    sums = _collected(fit, shape.dims, _total) if shape.dims else []
    middle = [(2 * s + shape.n) // (2 * shape.n) for s in sums]
    around = np.array(middle, dtype=np.int64)
    squares = _collected(fit, shape.dims, lambda x: _pairs(x, around)) if shape.dims else []
    return Whitener(shape.n, sums, covariance(squares, sums, middle, shape.n), components)


def _whitened(batches, model: Whitener, error: float | None):
    k = len(model.values)
    for batch in batches:
        values, squares = model(matrix(batch.column("x"), model.dims))
        m = len(squares)
        rows = pa.array(np.repeat(np.arange(m), k))
        cells = {
            "row_id": batch.column("row_id").take(rows), "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), "n": pa.array(np.full(m * k, model.n), pa.int64()),
            "deviation": pa.array([s if s < _LONG else None for s in squares], pa.int64()).take(rows), "whitened": pa.array(values.ravel(), pa.float64(), from_pandas=True),
            "explained": pa.array(model.explained * m, pa.float64()), "identity_error": pa.array([error] * (m * k), pa.float64()), "deviation_text": pa.array(map(str, squares), pa.string()).take(rows),
        }
        yield pa.record_batch(list(cells.values()), names=list(cells))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256, components: int = 4) -> DataFrame:
    """A row for each remaining row and component: id, component, n, deviation, whitened, explained, identity_error, deviation_text."""
    kept = padded(whole_numbers(vectors, vec_col, scale, row_id=F.col(id_col)))
    fit = materialize(kept.select("x").distinct(), "whitening-fit")
    model = fit_whitener(fit, components)
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"row_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_text string"
    if model is None:
        discard(fit)
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("row_id", id_col)
    error = identity_error(fit, model)
    discard(fit)
    return kept.mapInArrow(lambda b: _whitened(b, model, error), schema).withColumnRenamed("row_id", id_col)
