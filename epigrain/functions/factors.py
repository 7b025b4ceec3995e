"""Triangular factors of tall tables: a tree of QR steps, so that neither rows nor squared condition numbers reach the driver.

Each task folds its rows, a block at a time, into the k x k upper triangle of their QR factorisation. Triangles are merged in groups by
further tasks until few are left. What R holds of a least-squares problem is exact up to rounding of the data themselves, whereas sums
of products lose twice the digits.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that are folded at once, and triangles that one task merges.
BLOCK_ROWS, GROUP = 8_192, 16

_SCHEMA = "part int, n long, r array<double>"


def fold(r: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The triangle of ``r`` on top of more rows."""
    k = r.shape[1]
    out = np.zeros((k, k))
    made = np.linalg.qr(np.vstack((r, rows)), mode="r")
    out[: made.shape[0]] = made
    return out


def _batch(part: int, n: int, r: np.ndarray) -> pa.RecordBatch:
    arrays = [pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([r.ravel().tolist()], pa.list_(pa.float64()))]
    return pa.RecordBatch.from_arrays(arrays, ["part", "n", "r"])


def triangle(df: DataFrame, columns: Sequence[str], centres: Sequence[float]) -> tuple[int, np.ndarray]:
    """(rows, R) of the matrix (1, columns - centres) over the rows in which no column is null or NaN.

    ``centres`` near the means keep the digits of columns that lie far from zero.
    """
    k = len(columns) + 1
    middle = np.array(centres, float)

    def reduce(batches):
        from pyspark import TaskContext

        r, n = np.zeros((k, k)), 0
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            x = x[~np.isnan(x).any(axis=1)]
            n += len(x)
            x = np.hstack((np.ones((len(x), 1)), x - middle))
            for s in range(0, len(x), BLOCK_ROWS):
                r = fold(r, x[s : s + BLOCK_ROWS])
        yield _batch(TaskContext.get().partitionId(), n, r)

    def merge(batches):
        r, n, part = np.zeros((k, k)), 0, None
        for batch in batches:
            for p, m, cells in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part, n = p if part is None else min(part, p), n + m
                r = fold(r, np.array(cells).reshape(k, k))
        if part is not None:
            yield _batch(part, n, r)

    parts = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).mapInArrow(reduce, _SCHEMA)
    left = df.rdd.getNumPartitions()
    while left > GROUP:
        left = -(-left // GROUP)
        parts = parts.repartition(left, F.col("part") % left).mapInArrow(merge, _SCHEMA)
    r, n = np.zeros((k, k)), 0
    for row in sorted(parts.collect()):
        n, r = n + row.n, fold(r, np.array(row.r).reshape(k, k))
    return n, r


def least_squares(r: np.ndarray, chosen: Sequence[int]) -> tuple[np.ndarray, float]:
    """Intercept and coefficients of the last column on the chosen ones (counted without the ones), and the residual sum of squares."""
    idx = [0, *[c + 1 for c in chosen]]
    part = np.linalg.qr(r[:, [*idx, r.shape[1] - 1]], mode="r")
    top, y = part[: len(idx), : len(idx)], part[: len(idx), -1]
    scale = np.linalg.norm(top, axis=0)
    scale[scale == 0] = 1
    beta = np.linalg.lstsq(top / scale, y, rcond=None)[0]
    rest = float(part[len(idx), -1] ** 2) if part.shape[0] > len(idx) else 0.0
    missed = y - (top / scale) @ beta  # not zero only where columns depend on each other
    return beta / scale, rest + float(missed @ missed)
