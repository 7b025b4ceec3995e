"""Moments of wide tables: means, spreads and cross products of thousands of columns in two passes.

A column costs an array slot in an Arrow batch, not an aggregate expression of its own, so the plan stays as small as for one column.
The first pass adds up values, the second centred products; partial results are merged by further tasks, some at a time, and the driver
gets the merged ones. Cross products are kept in square blocks of columns; their correlations are made into rows by tasks as well.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of a block, partial results that one task merges, and cells of a batch that is worked on at once.
BLOCK, GROUP, CELLS = 256, 16, 4_000_000

_PARTIAL = "part int, key int, sums binary"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _packed(df: DataFrame, names: Sequence[str], *more: Column) -> DataFrame:
    # one expression in text: thousands of Column objects would take longer than the data
    return df.select(F.expr(f"array({', '.join(f'cast({quoted(n)} AS double)' for n in names)})").alias("x"), *more)


def _matrices(batches, p: int):
    """(values, NaN where null; the batch's other columns as float arrays), some rows at a time."""
    step = max(1, CELLS // max(p, 1))
    for batch in batches:
        for s in range(0, batch.num_rows, step):
            part = batch.slice(s, step)
            flat = part.column(0).flatten().to_numpy(zero_copy_only=False).astype(float)
            yield flat.reshape(part.num_rows, p), [c.to_numpy(zero_copy_only=False).astype(float) for c in part.columns[1:]]


def _record(part: int, key: int, sums: np.ndarray) -> pa.RecordBatch:
    arrays = [pa.array([part], pa.int32()), pa.array([key], pa.int32()), pa.array([sums.astype("<f8").tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, ["part", "key", "sums"])


def _added(parts: DataFrame, partitions: int) -> DataFrame:
    """Merge partial sums of each key, ``GROUP`` tasks' at a time, until there is one row per key."""

    def add(batches):
        held: dict[int, np.ndarray] = {}
        part = 0
        for batch in batches:
            for p, key, sums in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part = p
                own = np.frombuffer(sums, "<f8")
                held[key] = held[key] + own if key in held else own
        for key, sums in held.items():
            yield _record(part, key, sums)

    while partitions > 1:
        partitions = -(-partitions // GROUP)
        group = F.col("part") % partitions
        parts = parts.withColumn("part", group).repartition(F.col("part"), F.col("key")).mapInArrow(add, _PARTIAL)
    return parts


def _task(run):
    def task(batches):
        from pyspark import TaskContext

        yield from (_record(TaskContext.get().partitionId(), key, sums) for key, sums in run(batches))

    return task


def column_moments(df: DataFrame, names: Sequence[str], response: str | None = None, zeros: bool = False) -> dict[str, np.ndarray]:
    """Per column: ``n`` values, ``mean`` and ``ss`` (sum of squares about it); with a response, over the rows that have both, also
    its mean ``mean_y``, ``ss_y`` and the cross product ``xy``. Nulls and NaN are no values, or 0 with ``zeros``; a column without any has mean 0."""
    p, paired = len(names), response is not None
    packed = _packed(df, names, *([F.col(f"`{response}`").cast("double").alias("y")] if paired else []))

    def both(x, rest):
        x = np.nan_to_num(x) if zeros else x
        seen = ~np.isnan(x)
        y = rest[0] if paired else np.zeros(len(x))
        seen &= ~np.isnan(y)[:, None]
        return np.where(seen, x, 0.0), np.where(np.isnan(y), 0.0, y), seen

    def totals(batches):
        out = np.zeros((3, p))
        for x, rest in _matrices(batches, p):
            x, y, seen = both(x, rest)
            out += np.stack((seen.sum(axis=0), x.sum(axis=0), y @ seen))
        yield 0, out.ravel()

    partitions = packed.rdd.getNumPartitions()
    first = _added(packed.mapInArrow(_task(totals), _PARTIAL), partitions).collect()
    n, sx, sy = sum((np.frombuffer(r.sums, "<f8") for r in first), np.zeros(3 * p)).reshape(3, p)
    mean, mean_y = (np.divide(s, n, out=np.zeros(p), where=n > 0) for s in (sx, sy))

    def centred(batches):
        out = np.zeros((3, p))
        for x, rest in _matrices(batches, p):
            x, y, seen = both(x, rest)
            x = np.where(seen, x - mean, 0.0)
            y = np.where(seen, y[:, None] - mean_y, 0.0) if paired else np.zeros((len(x), p))
            out += np.stack(((x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)))
        yield 0, out.ravel()

    second = _added(packed.mapInArrow(_task(centred), _PARTIAL), partitions).collect()
    ss, ss_y, xy = sum((np.frombuffer(r.sums, "<f8") for r in second), np.zeros(3 * p)).reshape(3, p)
    return {"n": n, "mean": mean, "ss": ss, "mean_y": mean_y, "ss_y": ss_y, "xy": xy}


def cross_products(df: DataFrame, names: Sequence[str], mean: np.ndarray) -> DataFrame:
    """(key, sums): centred cross products of every pair of column blocks on or above the diagonal; nulls count as zero. ``key`` is
    first block times blocks plus second block."""
    p = len(names)
    blocks = -(-p // BLOCK)
    packed = _packed(df, names)

    def run(batches):
        out: dict[int, np.ndarray] = {}
        for x, _ in _matrices(batches, p):
            x = np.nan_to_num(x) - mean
            parts = [x[:, b * BLOCK : (b + 1) * BLOCK] for b in range(blocks)]
            for i in range(blocks):
                for j in range(i, blocks):
                    made = parts[i].T @ parts[j]
                    key = i * blocks + j
                    out[key] = out[key] + made if key in out else made
        yield from ((key, sums.ravel()) for key, sums in out.items())

    return _added(packed.mapInArrow(_task(run), _PARTIAL), packed.rdd.getNumPartitions()).select("key", "sums")


def correlations(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(i, j, corr) of every ordered pair of columns, by their places; nulls count as zero, a constant column has null correlations
    and 1 with itself. The rows are made by the tasks that hold a block."""
    p = len(names)
    blocks = -(-p // BLOCK)
    mean = column_moments(df, names, zeros=True)["mean"]
    products = cross_products(df, names, mean)
    spread = np.zeros(p)
    for row in products.where(F.expr(f"key DIV {blocks} = key % {blocks}")).collect():  # the blocks on the diagonal hold the variances
        b = row.key // blocks
        w = min(BLOCK, p - b * BLOCK)
        spread[b * BLOCK : b * BLOCK + w] = np.diag(np.frombuffer(row.sums, "<f8").reshape(w, w))
    length = np.sqrt(np.maximum(spread, 0))

    def rows(batches):
        for batch in batches:
            for key, sums in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = divmod(key, blocks)
                i = np.arange(a * BLOCK, min((a + 1) * BLOCK, p))
                j = np.arange(b * BLOCK, min((b + 1) * BLOCK, p))
                scale = np.outer(length[i], length[j])
                made = np.full(scale.shape, np.nan)
                np.divide(np.frombuffer(sums, "<f8").reshape(len(i), len(j)), scale, out=made, where=scale > 0)
                made = np.clip(made, -1, 1)
                if a == b:
                    np.fill_diagonal(made, 1.0)
                ii, jj = np.repeat(i, len(j)), np.tile(j, len(i))
                flat = made.ravel()
                if a != b:
                    ii, jj, flat = np.concatenate((ii, jj)), np.concatenate((jj, ii)), np.concatenate((flat, flat))
                arrays = [pa.array(ii, pa.int32()), pa.array(jj, pa.int32()), pa.array(flat, pa.float64(), mask=np.isnan(flat))]
                yield pa.RecordBatch.from_arrays(arrays, ["i", "j", "corr"])

    return products.mapInArrow(rows, "i int, j int, corr double")
