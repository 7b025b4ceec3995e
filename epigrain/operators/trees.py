"""Extremely randomised trees as a table of nodes.

Every draw is a hash of the node it is made for: a node's candidate features are those of smallest hash, its cuts lie at hashed places
between the smallest and the largest value, and its children are named by hashes of it. So a tree does not depend on where or in what
order its nodes are grown, and two ways give the same table:

* a training table that :func:`fits` a task is written to the shared folder and read by tasks, each of which grows some trees whole (and
  can score what they held out, or note which candidate cut every node took, from which the same trees can be grown again at once);
* a larger one is grown level by level, all trees together, by joins and aggregates: rows are joined to the candidates of their open
  node, an aggregate gives each node's class counts and ranges, a second one the counts beside each cut, and rows move to the children.
  The driver sees whether a node was split, and nothing of the trees.

Class counts are whole numbers until they are weighted, so both ways compare the same figures.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage

#: Cells (rows x features) of a table that may be sent to tasks, trees that a task grows together at most, rows of them together, and
#: nodes that one scoring task holds (at least one tree's).
TASK_CELLS, TREES_AT_ONCE, TASK_ROWS, BLOCK_NODES = 8_000_000, 50, 400_000, 200_000
#: A task may hold a table of so many times as many cells if it reads it from files, which have up to ``FILE_CELLS`` cells each.
READ_TIMES, FILE_CELLS = 16, 4_000_000
#: Rows that are scored together, and hashes that are drawn together.
BLOCK_ROWS, _HASHES = 2_048, 16_384

NODES = "tree int, node long, feature int, cut double, left long, right long, prob double"
_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)


def hash_longs(*columns: np.ndarray) -> np.ndarray:
    """What ``xxhash64`` of these long columns gives."""
    h = np.uint64(42)
    with np.errstate(over="ignore"):
        for column in columns:  # of shapes that broadcast
            x = np.asarray(column, np.int64).view(np.uint64) * _P2
            x = (x << np.uint64(31) | x >> np.uint64(33)) * _P1
            h = np.asarray((h + _P5 + np.uint64(8)) ^ x)
            h = h << np.uint64(27) | h >> np.uint64(37)
            h *= _P1
            h += _P4
            h ^= h >> np.uint64(33)
            h *= _P2
            h ^= h >> np.uint64(29)
            h *= _P3
            h ^= h >> np.uint64(32)
    return h.view(np.int64)


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a file that Spark names, and the path in it."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), unquote("/" + uri.removeprefix("file:").lstrip("/"))
    return fs.FileSystem.from_uri(uri)


def _load(files: Sequence[str], columns: Sequence[str], order: str) -> tuple[np.ndarray, pa.Table]:
    """The features of all rows of some files, and other columns."""
    opened = [pq.ParquetFile(system.open_input_file(path)) for system, path in map(_open, files)]
    n, at, x, others = sum(f.metadata.num_rows for f in opened), 0, np.empty((0, 0)), []
    for file in opened:
        got = file.read(columns=[*columns, "features"])
        others.append(got.select(columns))
        if got.num_rows:
            values = _matrix(got, "features")
            if not at:
                x = np.empty((n, values.shape[1]), values.dtype, order)
            x[at : at + len(values)] = values
            at += len(values)
        file.close(force=True)
    pa.default_memory_pool().release_unused()  # as much again as the features, else
    return x, pa.concat_tables(others)


def _in_files(table: DataFrame, rows: int, width: int, path: str | None = None) -> list[str]:
    """The files of ``table``, written once for tasks to read, to ``path`` if that is given."""
    some = table.repartition(max(1, -(-rows * max(width, 1) // FILE_CELLS)))
    if path is None:
        return sorted(stage(some).inputFiles())
    some.write.parquet(path)
    return sorted(table.sparkSession.read.parquet(path).inputFiles())


@dataclass
class Growth:
    """What a task needs to grow trees: the files of the training table, the models with their class weights, and how it is done. Trees
    grow in blocks of ``at_once``, in order."""

    files: list[str]
    models: list[tuple[int, int]]
    weights: np.ndarray
    trees: int
    tries: int
    max_depth: int | None
    n_folds: int
    at_once: int

    @classmethod
    def over(cls, table: DataFrame, models, weights, trees, tries, max_depth, n_folds, path: str | None = None) -> "Growth":
        rows, first = table.count(), table.first()
        files = _in_files(narrow(table), rows, len(first["features"]) if first else 0, path)
        at_once = max(1, min(TREES_AT_ONCE, TASK_ROWS // max(rows, 1)))
        return cls(files, list(models), np.asarray(weights), trees, tries, max_depth, n_folds, at_once)

    @property
    def blocks(self) -> int:
        return -(-len(self.models) * self.trees // self.at_once)

    def tasks(self, spark: SparkSession) -> int:
        return min(self.blocks, 4 * spark.sparkContext.defaultParallelism)

    def held(self):
        """The table, as a task holds it: features in column order, labels, folds, peptides."""
        x, got = _load(self.files, ["peptide", "label", "folds"], "F")
        folds = _matrix(got, "folds", len(self.models) // self.n_folds)
        return x, got["label"].to_numpy().astype(np.int64), folds, got["peptide"].combine_chunks()

    def block(self, held, b: int, **how) -> Iterator[tuple]:
        """The nodes of a block of trees, as :func:`grow_block` gives them."""
        x, label, folds, _ = held
        tree = np.arange(b * self.at_once, min((b + 1) * self.at_once, len(self.models) * self.trees))
        model = tree // self.trees
        taken = [_rows_of(folds, m, self.n_folds) for m in model]
        root = roots(self.models, self.trees)[tree]
        return grow_block(x, label, taken, tree, root, self.weights[model], self.tries, self.max_depth, **how)

    def walk(self, held, b: int, **how) -> "_Walk":
        parts = [np.concatenate(c) for c in zip(*((g[0], g[1], g[2], g[3], g[6]) for g in self.block(held, b, **how)))]
        return _Walk(*parts, self.trees)


@dataclass
class Forest:
    """The nodes of all trees, ``trees`` for each model (seed, fold) in order. Leaves have feature -1.

    Stored by :func:`save_grown`, it has its training table (``growth``) and the cuts that the nodes took (``taken``), a row per block of
    trees, and the nodes are worked out from these when they are asked for.
    """

    nodes: DataFrame
    features: list[str]
    models: list[tuple[int, int]]
    trees: int
    growth: Growth | None = None
    taken: DataFrame | None = None

    @property
    def n_trees(self) -> int:
        return len(self.models) * self.trees

    def save(self, path: str) -> None:
        """Two tables below ``path``: the nodes, and one row that tells what they are of."""
        spark = self.nodes.sparkSession
        self.nodes.drop("left", "right").write.parquet(f"{path}/nodes")  # the children's names are hashes of the node's
        about = [(self.features, [m[0] for m in self.models], [m[1] for m in self.models], self.trees)]
        spark.createDataFrame(about, _ABOUT).write.parquet(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Forest":
        about = spark.read.parquet(f"{path}/about").first()
        named = list(about.features), list(zip(about.seeds, about.folds)), about.trees
        if "at_once" not in about:
            stored = spark.read.parquet(f"{path}/nodes")
            sides = [f"if(feature < 0, 0L, xxhash64(node, {side}L)) AS {name}" for side, name in enumerate(("left", "right"))]
            return cls(stored.selectExpr("tree", "node", "feature", "cut", *sides, "prob"), *named)
        files = sorted(spark.read.parquet(f"{path}/rows").inputFiles())
        growth = Growth(files, named[1], np.array(about.weights), about.trees, about.tries, about.max_depth, about.n_folds, about.at_once)
        taken = spark.read.schema(_TAKEN).parquet(f"{path}/taken")

        def run(batches):
            held = growth.held()
            for b, told in _told(batches):
                yield from _batches(growth.block(held, b, told=told))

        return cls(_in_order(taken, growth).mapInArrow(run, NODES), *named, growth, taken)


_ABOUT, _TAKEN = "features array<string>, seeds array<int>, folds array<int>, trees int", "block long, taken binary"


def save_grown(path: str, table: DataFrame, names: list[str], models, weights: np.ndarray, trees: int, tries: int, max_depth: int | None, n_folds: int) -> None:
    """Grow trees and store them below ``path`` for :meth:`Forest.load`: the training table, which candidate cut each node with both labels
    took, and one row that tells what they are of. That is less than a byte per node, and gives every node back to the bit."""
    spark = table.sparkSession
    growth = Growth.over(table, models, weights, trees, tries, max_depth, n_folds, f"{path}/rows")

    def run(batches):
        held = growth.held()
        for batch in batches:
            for b in batch.column(0).to_pylist():
                noted = []
                for _ in growth.block(held, b, noted=noted):
                    pass
                packed = zlib.compress(np.concatenate([np.empty(0, np.uint16), *noted]).astype(_code(tries)).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([packed], pa.binary())], ["block", "taken"])

    spark.range(0, growth.blocks, 1, growth.tasks(spark)).mapInArrow(run, _TAKEN).write.parquet(f"{path}/taken")
    about = (names, [m[0] for m in models], [m[1] for m in models], trees, growth.weights.tolist(), tries, max_depth, n_folds, growth.at_once)
    kinds = f"{_ABOUT}, weights array<array<double>>, tries int, max_depth int, n_folds int, at_once int"
    spark.createDataFrame([about], kinds).write.parquet(f"{path}/about")


def _code(tries: int) -> type:
    return np.uint8 if tries < 256 else np.uint16


def _in_order(taken: DataFrame, growth: Growth) -> DataFrame:
    """The blocks dealt out in order, so that a task has those of few models."""
    return taken.repartitionByRange(growth.tasks(taken.sparkSession), "block").sortWithinPartitions("block")


def _told(batches) -> Iterator[tuple[int, bytes]]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def roots(models: Sequence[tuple[int, int]], trees: int) -> np.ndarray:
    seed, fold = (np.repeat(np.array(m, np.int64), trees) for m in zip(*models))
    return hash_longs(seed, fold, np.tile(np.arange(trees, dtype=np.int64), len(models)))


def _gini(zeros, ones):
    total = zeros + ones
    p = ones / total
    return total * 2 * p * (1 - p)


def _candidates(node: np.ndarray, p: int, tries: int) -> np.ndarray:
    """(node, try): the features of smallest hash, in that order."""
    if not tries:
        return np.empty((len(node), 0), np.int64)
    found, some = np.empty((len(node), tries), np.int64), max(1, _HASHES // p)
    for s in range(0, len(node), some):
        drawn = hash_longs(node[s : s + some, None], np.arange(p)[None, :])
        if tries > 8:
            found[s : s + some] = drawn.argsort(axis=1, kind="stable")[:, :tries]
            continue
        at = np.arange(len(drawn))
        for j in range(tries):  # a few passes for the smallest one are cheaper than a sort
            least = drawn.argmin(axis=1)
            found[s : s + some, j] = least
            drawn[at, least] = np.iinfo(np.int64).max
    return found


def _as_limit(cut: np.ndarray, kind: np.dtype) -> np.ndarray:
    """What the values of a column are less than exactly if they are less than the cut: the next number of their kind."""
    limit = cut.astype(kind)
    return limit if limit.dtype == cut.dtype else np.where(limit < cut, np.nextafter(limit, kind.type(np.inf)), limit)


def grow_block(x, label, taken, tree, root, weight, tries, max_depth=None, noted=None, told=None):
    """The nodes of some trees: ``taken[k]`` are the rows of tree k, ``weight[k]`` its class weights. Yields arrays in NODES order.

    A column of ``x`` is read at a time, so it is best in column order. Cuts are double, whatever the kind of ``x``. ``noted`` gets an array
    for each level: the candidate that each node with both labels took, or ``tries``. ``told`` is what was noted of these trees, as
    compressed bytes; no other candidate is tried then.
    """
    n, p = x.shape
    flat = x.T.ravel()
    smallest, largest = (np.fmin, np.fmax) if flat.size and np.isnan(flat.min()) else (np.minimum, np.maximum)
    known = None if told is None else np.frombuffer(zlib.decompress(told), _code(tries)).astype(np.int64)
    rows = np.concatenate(taken) if len(taken) else np.empty(0, np.int64)
    full = np.array([len(r) for r in taken], np.int64)
    empty = np.flatnonzero(full == 0)
    if len(empty):
        none = np.zeros(len(empty))
        yield tree[empty], root[empty], np.full(len(empty), -1), none, none.astype(np.int64), none.astype(np.int64), none + 0.5
    # one sum counts the rows of both labels: those of label 1 in its upper half
    packed = 1 + (label << 32)
    half = (1 << 32) - 1
    g_t = np.flatnonzero(full)
    g_node = root[g_t]
    ones = np.array([label[taken[k]].sum() for k in g_t], np.int64)
    zeros = full[g_t] - ones
    depth = 0
    rows = rows[np.repeat((zeros > 0) & (ones > 0), full[g_t])]
    while len(g_t):
        # rows are those of the mixed nodes, node by node
        w0, w1 = weight[g_t, 0], weight[g_t, 1]
        prob = ones * w1 / (zeros * w0 + ones * w1)
        feature, cut = np.full(len(g_t), -1), np.zeros(len(g_t))
        mixed = np.flatnonzero((zeros > 0) & (ones > 0)) if max_depth is None or depth < max_depth else np.empty(0, np.int64)
        inner = mixed
        if len(mixed):
            node, c0, c1, v0, v1 = (a[mixed] for a in (g_node, zeros, ones, w0, w1))
            size = c0 + c1
            first = np.cumsum(size) - size
            candidates = _candidates(node, p, tries)
            place = hash_longs(node[:, None], -1 - np.arange(tries)[None, :])
            u = (place.view(np.uint64) >> np.uint64(11)).astype(float) * 2.0**-53
            count = packed[rows]
            best, best_cut, best_feature = np.full(len(mixed), np.inf), np.zeros(len(mixed)), np.full(len(mixed), -1)
            best_j = np.full(len(mixed), tries)
            lefts, goes_left = np.zeros(len(mixed), np.int64), np.zeros(len(rows), bool)
            tried = [np.full(len(mixed), j) for j in range(tries)]
            if known is not None:
                now, known = known[: len(mixed)], known[len(mixed) :]
                if len(now) < len(mixed):
                    raise ValueError("the cuts are not those of these trees")
                tried = [now] if tries else []
            every = np.arange(len(mixed))
            for j in tried:  # one candidate of each node at a time, so that one value per row is held
                at_j = every, np.minimum(j, tries - 1)
                drawn = candidates[at_j]
                values = np.repeat(drawn * n, size)
                values += rows
                values = flat.take(values)
                low, high = (f.reduceat(values, first).astype(float) for f in (smallest, largest))
                at = low + (high - low) * u[at_j]
                left = values < np.repeat(_as_limit(at, flat.dtype), size)
                del values
                both = np.add.reduceat(count * left, first)
                l0, l1 = (both & half) - (both >> 32), both >> 32
                if known is None:
                    with np.errstate(divide="ignore", invalid="ignore"):
                        gini = _gini(l0 * v0, l1 * v1) + _gini((c0 - l0) * v0, (c1 - l1) * v1)
                    usable = (high > low) & (l0 + l1 > 0) & (l0 + l1 < size)
                    better = np.flatnonzero(usable & (gini < best))
                    best[better] = gini[better]
                else:
                    better = np.flatnonzero(j < tries)
                if len(better):
                    best_cut[better], best_feature[better], best_j[better], lefts[better] = at[better], drawn[better], j[better], both[better]
                    chosen = np.zeros(len(mixed), bool)
                    chosen[better] = True
                    np.copyto(goes_left, left, where=np.repeat(chosen, size))
            if noted is not None:
                noted.append(best_j)
            splits = best_feature >= 0
            inner = mixed[splits]
            feature[inner], cut[inner] = best_feature[splits], best_cut[splits]
        children = [np.zeros(len(g_t), np.int64) for _ in (0, 1)]
        for side, child in enumerate(children):
            child[inner] = hash_longs(g_node[inner], np.full(len(inner), side))
        yield tree[g_t], g_node, feature, cut, *children, prob
        if not len(inner):
            return
        # left children come before right ones, each in the order of their parents; rows of pure children go
        l0, l1 = (lefts & half) - (lefts >> 32), lefts >> 32
        r0, r1 = c0 - l0, c1 - l1
        stay = [np.repeat(splits & (a > 0) & (b > 0), size) for a, b in ((l0, l1), (r0, r1))]
        rows = np.concatenate((rows[stay[0] & goes_left], rows[stay[1] & ~goes_left]))
        zeros, ones = (np.concatenate((a[splits], b[splits])) for a, b in ((l0, r0), (l1, r1)))
        g_t, g_node = np.tile(g_t[inner], 2), np.concatenate([c[inner] for c in children])
        depth += 1


def _batches(parts):
    types = [pa.int32(), pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.float64()]
    names = [c.split()[0] for c in NODES.split(", ")]
    for part in parts:
        yield pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(part, types, strict=True)], names)


def _rows_of(folds: np.ndarray, model: int, n_folds: int) -> np.ndarray:
    own = folds[:, model // n_folds]
    return np.flatnonzero((own > 0) & (own != model % n_folds + 1))


def _held_out(folds: np.ndarray, model: int, n_folds: int) -> np.ndarray:
    return np.flatnonzero(folds[:, model // n_folds] == model % n_folds + 1)


def _matrix(got: pa.Table, column: str, width: int | None = None) -> np.ndarray:
    flat = got[column].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(got.num_rows, -1 if width is None else width)


def is_small(rows: int, width: int) -> bool:
    """Whether a table of that many rows and features may be sent to tasks."""
    return rows * max(width, 1) <= TASK_CELLS


def fits(rows: int, width: int) -> bool:
    """Whether a task may hold a table of that many rows and features, which it reads from files."""
    return rows * max(width, 1) <= READ_TIMES * TASK_CELLS


def narrow(table: DataFrame) -> DataFrame:
    """``table`` with single-precision features if that holds every one of them exactly, else as it is: tasks hold it whole."""
    exact = table.agg(F.expr("coalesce(bool_and(forall(features, v -> cast(cast(v AS float) AS double) <=> v)), true)")).first()[0]
    return table.withColumn("features", F.expr("cast(features AS array<float>)")) if exact else table


def _in_tasks(table, models, weights, trees, tries, max_depth, n_folds, schema: str, made) -> DataFrame:
    """Each task reads the whole training table, whose size has been checked, and grows some trees in order; ``made(growth, held, blocks)``
    are the batches it leaves of some blocks of trees."""
    spark = table.sparkSession
    growth = Growth.over(table, models, weights, trees, tries, max_depth, n_folds)

    def run(batches):
        yield from made(growth, growth.held(), (b for batch in batches for b in batch.column(0).to_pylist()))

    return spark.range(0, growth.blocks, 1, growth.tasks(spark)).mapInArrow(run, schema)


def _grow_in_tasks(table, models, weights, trees, tries, max_depth, n_folds):
    def made(growth, held, blocks):
        return _batches(part for b in blocks for part in growth.block(held, b))

    return _in_tasks(table, models, weights, trees, tries, max_depth, n_folds, NODES, made)


def _by_model(parts: Iterator[tuple]) -> Iterator[tuple]:
    """(model, rows, sums) with successive parts of a model added up: a task leaves a row per model and peptide, however many blocks of
    trees it grows, and holds one model at a time."""
    held = None
    for model, rows, sums in parts:
        if held and held[0] == model:
            held = model, rows, held[2] + sums
            continue
        if held:
            yield held
        held = model, rows, sums
    if held:
        yield held


def held_out_scores(table: DataFrame, models, weights: np.ndarray, trees: int, tries: int, max_depth: int | None, n_folds: int) -> DataFrame:
    """(row, peptide, model, score) of the rows that a model held out. The task that grows a tree scores them, and no node is kept; for a
    table that :func:`fits` a task."""

    def made(growth, held, blocks):
        x, _, folds, peptides = held
        parts = (part for b in blocks for part in growth.walk(held, b).sums(x, lambda m: _held_out(folds, m, n_folds)))
        for model, rows, sums in _by_model(parts):
            columns = [pa.array(rows, pa.int64()), peptides.take(pa.array(rows)), pa.array(np.full(len(rows), model), pa.int32()), pa.array(sums)]
            yield pa.RecordBatch.from_arrays(columns, ["row", "peptide", "model", "sum"])

    schema = f"row long, peptide {table.schema['peptide'].dataType.simpleString()}, model int, sum double"
    sums = _in_tasks(table, models, weights, trees, tries, max_depth, n_folds, schema, made)
    return sums.groupBy("row", "peptide", "model").agg((F.sum("sum") / trees).alias("score"))


def _grow_by_levels(table, models, weights, trees, tries, max_depth, n_folds, width):
    """All trees a level at a time, by joins and aggregates over (tree, node)."""
    spark = table.sparkSession
    total = len(models) * trees
    rows = stage(table.withColumn("row", F.monotonically_increasing_id()))
    root = spark.createDataFrame([(t, int(n), float(weights[t // trees][0]), float(weights[t // trees][1])) for t, n in enumerate(roots(models, trees))], "tree int, root long, w0 double, w1 double")
    root = stage(root)  # one row per tree
    dealt = rows.select("row", "label", "folds", F.explode(F.sequence(F.lit(0), F.lit(total - 1))).alias("tree"))
    own = f"folds[cast(tree DIV {trees * n_folds} AS int)]"
    open_rows = dealt.where(f"{own} > 0 AND {own} <> (tree DIV {trees}) % {n_folds} + 1").join(root.select("tree", F.col("root").alias("node")), "tree")
    open_rows = stage(open_rows.select("row", "label", "tree", "node"))
    order = f"array_sort(transform(sequence(0, {width - 1}), f -> struct(xxhash64(node, cast(f AS bigint)) AS h, f AS f)))"
    js = range(tries)
    out, depth = [], 0
    while True:
        nodes = stage(open_rows.select("tree", "node").distinct().withColumn("candidates", F.expr(f"transform(slice({order}, 1, {tries}), s -> s.f)")))
        seen = open_rows.join(nodes, ["tree", "node"]).join(rows.select("row", "features"), "row")
        values = "transform(candidates, c -> if(isnan(features[c]), null, features[c]))"
        seen = stage(seen.select("tree", "node", "row", "label", F.expr(values).alias("v")))
        ranges = seen.groupBy("tree", "node").agg(
            F.count_if(F.col("label") == 0).alias("zeros"), F.count_if(F.col("label") == 1).alias("ones"),
            *[F.min(F.col("v")[j]).alias(f"lo{j}") for j in js], *[F.max(F.col("v")[j]).alias(f"hi{j}") for j in js],
        )
        u = "cast(shiftrightunsigned(xxhash64(node, cast(-1 - {j} AS bigint)), 11) AS double) * 1.1102230246251565E-16D"
        cuts = [f"lo{j} + (hi{j} - lo{j}) * ({u.format(j=j)}) AS cut{j}" for j in js]
        ranges = stage(ranges.selectExpr("*", *cuts))
        beside = seen.join(ranges.select("tree", "node", *[f"cut{j}" for j in js]), ["tree", "node"]).groupBy("tree", "node").agg(
            *[F.count_if((F.col("v")[j] < F.col(f"cut{j}")) & (F.col("label") == k)).alias(f"l{k}{j}") for j in js for k in (0, 1)]
        )
        both = ranges.join(beside, ["tree", "node"]).join(root.drop("root"), "tree").join(nodes, ["tree", "node"])
        gini = "(({a} + {b}) * 2 * ({b} / ({a} + {b})) * (1 - {b} / ({a} + {b})))"
        tried = []
        for j in js:
            left = gini.format(a=f"(l0{j} * w0)", b=f"(l1{j} * w1)")
            right = gini.format(a=f"((zeros - l0{j}) * w0)", b=f"((ones - l1{j}) * w1)")
            usable = f"zeros > 0 AND ones > 0 AND hi{j} > lo{j} AND l0{j} + l1{j} > 0 AND l0{j} + l1{j} < zeros + ones"
            tried.append(f"if({usable}, struct({left} + {right} AS after, {j} AS j, candidates[{j}] AS feature, cut{j} AS cut), null)")
        grows = max_depth is None or depth < max_depth
        best = F.expr(f"array_min(array({', '.join(tried)}))") if grows else F.lit(None).cast("struct<after: double, j: int, feature: int, cut: double>")
        made = both.withColumn("best", best).selectExpr(
            "tree", "node", "coalesce(best.feature, -1) AS feature", "coalesce(best.cut, 0D) AS cut", "best.j AS j",
            "if(best IS NULL, 0L, xxhash64(node, 0L)) AS left", "if(best IS NULL, 0L, xxhash64(node, 1L)) AS right",
            "(ones * w1) / (zeros * w0 + ones * w1) AS prob",
        )
        made = stage(made)
        out.append(made.drop("j"))
        splits = made.where("feature >= 0").select("tree", "node", "j", "cut", "left", "right")
        if splits.isEmpty():
            break
        moved = seen.join(splits, ["tree", "node"])
        open_rows = stage(moved.selectExpr("row", "label", "tree", "if(coalesce(v[j] < cut, false), left, right) AS node"))
        depth += 1
    found = out[0]
    for level in out[1:]:
        found = found.unionByName(level)
    without = root.join(found.select("tree", F.col("node").alias("root")), ["tree", "root"], "left_anti")  # trees that got no row
    bare = without.selectExpr("tree", "root AS node", "-1 AS feature", "0D AS cut", "0L AS left", "0L AS right", "0.5D AS prob")
    return found.unionByName(bare)


def grow(
    table: DataFrame, width: int, models, weights: np.ndarray, trees: int, tries: int, max_depth: int | None, n_folds: int, written: bool = True
) -> DataFrame:
    """The node table of all trees. ``table`` has peptide, label (0 or 1), features, and a fold per seed (0: not drawn for that seed).

    Without ``written`` the table is for one use, such as storing the trees: it may be computed anew by each.
    """
    if not fits(table.count(), width):
        return _grow_by_levels(table, models, weights, trees, tries, max_depth, n_folds, width)
    nodes = _grow_in_tasks(table, models, weights, trees, tries, max_depth, n_folds)
    return stage(nodes) if written else nodes


# --- scoring --------------------------------------------------------------------------------------------------------------------


class _Walk:
    """Some trees, ready to be walked. No two of their nodes may share a hash."""

    def __init__(self, tree: np.ndarray, node: np.ndarray, feature: np.ndarray, cut: np.ndarray, prob: np.ndarray, trees: int):
        order = np.argsort(node)
        ids = node[order]
        if (ids[1:] == ids[:-1]).any():
            raise ValueError("two nodes have the same hash; take other seeds")
        self.feature, self.cut, self.prob = feature[order], cut[order], prob[order]
        inner = np.flatnonzero(self.feature >= 0)
        self.left, self.right = np.zeros((2, len(ids)), np.int64)
        for side, child in enumerate((self.left, self.right)):
            child[inner] = np.searchsorted(ids, hash_longs(ids[inner], np.full(len(inner), side)))
        below = np.zeros(len(ids), bool)
        below[self.left[inner]] = below[self.right[inner]] = True
        self.roots = np.flatnonzero(~below)
        self.model = tree[order][self.roots] // trees

    def _leaves(self, x: np.ndarray, rows: np.ndarray, roots: np.ndarray) -> np.ndarray:
        """(row, tree): the leaf that the row reaches."""
        at, row = np.tile(roots, len(rows)), np.repeat(rows, len(roots))
        going = np.flatnonzero(self.feature[at] >= 0)
        while len(going):
            here = at[going]
            here = np.where(x[row[going], self.feature[here]] < self.cut[here], self.left[here], self.right[here])
            at[going] = here
            going = going[self.feature[here] >= 0]
        return at.reshape(len(rows), len(roots))

    def sums(self, x: np.ndarray, wanted=None):
        """(model, rows, the sum of the probabilities of the model's trees here) for the rows that ``wanted`` gives for a model, or all."""
        for model in np.unique(self.model):
            roots = self.roots[self.model == model]
            rows = np.arange(len(x)) if wanted is None else wanted(model)
            total = np.zeros(len(rows))
            for s in range(0, len(rows), BLOCK_ROWS):
                for r in range(0, len(roots), 100):
                    total[s : s + BLOCK_ROWS] += self.prob[self._leaves(x, rows[s : s + BLOCK_ROWS], roots[r : r + 100])].sum(axis=1)
            if len(rows):
                yield int(model), rows, total


def _tree_blocks(forest: Forest, most: int) -> tuple[DataFrame, int]:
    """(tree, block): successive trees of up to ``most`` nodes together (at least one tree); and the number of blocks."""
    sizes = forest.nodes.groupBy("tree").count().collect()  # a row per tree
    block, held, of = 0, 0, []
    for tree, n in sorted(map(tuple, sizes)):
        if held and held + n > most:
            block, held = block + 1, 0
        of.append((tree, block))
        held += n
    return forest.nodes.sparkSession.createDataFrame(of, "tree int, block int"), block + 1


def model_sums(forest: Forest, rows: DataFrame, keys: Sequence[str], n_folds: int | None = None) -> DataFrame:
    """(row, keys, model, score): the mean probability by each model for rows with ``features``. With ``n_folds`` a row is scored by the
    models that held it out by its ``folds`` alone.

    Nodes meet in blocks of trees. Rows that are few (counted) are sent to the tasks; more are cut into slices, and a group is one block
    and one slice. There are as many partitions as about two groups need, whatever the session's number: a task sorts its nodes.
    """
    spark, keys, trees, width = forest.nodes.sparkSession, list(keys), forest.trees, len(forest.features)
    if forest.growth is not None:
        sums, listed = _sums_of_grown(forest, rows, keys, n_folds)
        return _scores(sums, listed, keys, trees)
    listed = stage(rows.withColumn("row", F.monotonically_increasing_id()).select("row", *[F.col(f"`{k}`") for k in keys], "features", *(["folds"] if n_folds and "folds" not in keys else [])))
    needed = ["row", "features", *(["folds"] if n_folds else [])]
    n = listed.count()
    small = is_small(n, width)
    names, blocks = _tree_blocks(forest, BLOCK_NODES if small else 5 * BLOCK_NODES)
    value = F.expr("if(feature < 0, prob, cut)").alias("value")  # a leaf has no cut, and no other node's share is asked for
    nodes = forest.nodes.select("tree", "node", "feature", value).join(F.broadcast(names), "tree")  # a row per tree

    def arrays(got):
        return got["row"].to_numpy(), _matrix(got, "features", width).astype(float), _matrix(got, "folds") if n_folds else None

    def score(got, row, x, folds):
        walk = _Walk(*(got[c].to_numpy() for c in ("tree", "node", "feature", "value", "value")), trees)
        parts = [(row[at], np.full(len(at), m), s) for m, at, s in walk.sums(x, (lambda m: _held_out(folds, m, n_folds)) if n_folds else None)]
        columns = [np.concatenate(c) for c in zip(*parts)] or [np.empty(0)] * 3
        return pa.table({c: pa.array(a, t) for c, a, t in zip(("row", "model", "sum"), columns, (pa.int64(), pa.int32(), pa.float64()))})

    if small:
        shared = spark.sparkContext.broadcast(arrays(listed.select(*needed).toArrow()))
        sums = nodes.repartition(-(-blocks // 2), "block").groupBy("block").applyInArrow(lambda got: score(got, *shared.value), _SUMS)
    else:
        slices = -(-n * width // TASK_CELLS) if TASK_CELLS else 2
        every = [F.explode(F.sequence(F.lit(0), F.lit(k - 1))) for k in (blocks, slices)]
        dealt = listed.select(*needed, F.expr(f"cast(pmod(xxhash64(row), {slices}) AS int) AS slice")).withColumn("block", every[0])
        parts = -(-blocks * slices // 2)
        both = [d.repartition(parts, "block", "slice").groupBy("block", "slice") for d in (nodes.withColumn("slice", every[1]), dealt)]
        sums = both[0].cogroup(both[1]).applyInArrow(lambda got, own: score(got, *arrays(own)), _SUMS)
    return _scores(sums, listed, keys, trees)


_SUMS = "row long, model int, sum double"


def _scores(sums: DataFrame, listed: DataFrame, keys: Sequence[str], trees: int) -> DataFrame:
    scores = sums.groupBy("row", "model").agg((F.sum("sum") / trees).alias("score"))
    return scores.join(listed.select("row", *[F.col(f"`{k}`") for k in keys]), "row").select("row", *[F.col(f"`{k}`") for k in keys], "model", "score")


def _some(walks: Iterator[_Walk], nodes: int) -> Iterator[list[_Walk]]:
    """Successive walks, of that many nodes together or a little more."""
    own, held = [], 0
    for walk in walks:
        own.append(walk)
        held += len(walk.prob)
        if held >= nodes:
            yield own
            own, held = [], 0
    if own:
        yield own


def _sums_of_grown(forest: Forest, rows: DataFrame, keys: Sequence[str], n_folds: int | None) -> tuple[DataFrame, DataFrame]:
    """The sums by model, and the rows with their numbers. No node is moved or written: a task works the nodes of some trees out and walks
    them with the rows, a file of these at a time. Its sums are those of one or two models, and of as many rows as it may hold."""
    growth, width, n = forest.growth, len(forest.features), rows.count()
    parts = max(1, -(-n * max(width, 1) // FILE_CELLS))
    numbered = narrow(rows).repartition(parts).withColumn("row", F.monotonically_increasing_id())
    extra = ["folds"] if n_folds and "folds" not in keys else []
    listed = stage(numbered.select("row", *[F.col(f"`{k}`") for k in keys], "features", *extra))
    files = sorted(listed.inputFiles())
    some = max(1, READ_TIMES * TASK_CELLS // FILE_CELLS)
    slices, needed = [files[i : i + some] for i in range(0, len(files), some)], ["row", *(["folds"] if n_folds else [])]

    def run(batches):
        held, mine = growth.held(), list(_told(batches))
        for own in slices:
            found: dict[int, dict[str, list]] = {}  # of each model and file the rows and their sums
            for walks in _some((growth.walk(held, b, told=told) for b, told in mine), 5 * BLOCK_NODES):
                for file in own:
                    x, got = _load([file], needed, "C")
                    row, folds = got["row"].to_numpy(), _matrix(got, "folds", len(growth.models) // n_folds) if n_folds else None
                    for walk in walks:
                        for model, at, sums in walk.sums(x, (lambda m: _held_out(folds, m, n_folds)) if n_folds else None):
                            parts = found.setdefault(model, {})
                            parts[file] = [row[at], parts[file][1] + sums if file in parts else sums]
                for model in sorted(found)[:-1]:  # blocks come in order, so only the last one may get more
                    yield from batches_of(model, found.pop(model))
            for model, parts in found.items():
                yield from batches_of(model, parts)

    def batches_of(model, parts):
        for rows, sums in parts.values():
            columns = [pa.array(rows, pa.int64()), pa.array(np.full(len(rows), model), pa.int32()), pa.array(sums)]
            yield pa.RecordBatch.from_arrays(columns, ["row", "model", "sum"])

    return _in_order(forest.taken, growth).mapInArrow(run, _SUMS), listed


def model_scores(forest: Forest, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, scores): the mean probability by each model, as an array in their order, for rows with ``features``."""
    in_order = F.sort_array(F.collect_list(F.struct("model", "score")))  # one entry per model
    got = model_sums(forest, rows, keys).groupBy("row", *keys).agg(in_order.alias("_all"))
    return got.select(*keys, F.col("_all.score").alias("scores"))
