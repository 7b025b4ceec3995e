"""Near-duplicate documents by an LSH forest over MinHash signatures, confirmed on whole shingle sets.

Words are runs of ``[^\\x20\\x09-\\x0D]`` with A-Z folded; a document's set holds its distinct shingles of ``width`` words, or its
whole word sequence if it is shorter. Documents with equal sets are one node.

The forest has ``TREES`` orders. Order t sorts all nodes by the signature rotated to begin at value ``3 t``, so neighbours in an
order are the nodes with the longest common prefix, however dense their region is: depth adapts by itself. Nodes that share the
first ``DEPTH`` values form a run. First every node proposes the neighbour within ``NEIGHBOURS`` places that agrees with it best;
proposals are confirmed on the whole sets and links make components. Then the runs that still hold several components are searched
for pairs across components: a pair must agree in ``AGREE`` of the values and reach the similarity on the smallest ``BOTTOM`` hashes
(exact for smaller sets), and is confirmed on the whole sets. So every pair of a run is examined unless it is already connected; no
link is dropped by a cap, and pairs that are no links are not written anywhere. The work of the second search grows with the square
of a run only as far as its nodes are not connected.

The orders are cut into ranges of rows, not by key: a run that holds a third of the corpus spans many tasks. Pairs across the cuts
are found by a second, much smaller pass over the rows beside the cuts. In the second search a long run is dealt out as pairs of
blocks.

A pair of similarity 0.8 meets in some run with probability 1 - (1 - 0.8^3)^20, which is above 0.9999994, and fails the agreement
test with probability below 0.000001.

Null or empty texts and texts without words have an empty set, size 0 and no link. A null doc_id is the smallest of its group
only if all are null. Rows that repeat a doc_id are nodes by their text and stay separate rows. Other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import bit_table, tidy, written
from .words import distinct_per_text, in_pieces, mix, shingle_hashes, slices_of, word_hashes

TREES, DEPTH = 20, 3
VALUES = TREES * DEPTH
#: Depth, agreement and the rule on sizes lose no link from this similarity on.
LEAST_SIMILARITY = 0.8
#: Values that must agree: fewer at similarity 0.8 has a probability below 0.000001.
AGREE = 32
#: How far apart in an order the first candidates are sought.
NEIGHBOURS = 16
#: Nodes of a run that are compared with each other in one task; a longer run is dealt out as pairs of such blocks.
BLOCK = 4096
#: Limit of the bit table that tells which sets are needed (32 MB).
MOST_BITS = 1 << 28
#: Smallest shingle hashes of a set by which such pairs are compared before they are confirmed.
BOTTOM = 1024
#: Rows of an order per task.
TASK_ROWS = 100_000

_SIGNED = "row long, doc_id long, n int, key binary, wide binary, narrow binary"


def _factors(n: int, seed: int = 20240229) -> np.ndarray:
    return np.random.default_rng(seed).integers(1 << 62, (1 << 63) - 1, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array, width: int):
    """The sorted distinct shingle hashes of each text of a column, some texts at a time."""
    for some in slices_of(texts):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in some]
        for a, b in in_pieces(raw):
            words, offsets = word_hashes(raw[a:b])
            yield distinct_per_text(*shingle_hashes(words, offsets, width))


def signatures(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of ``VALUES`` mixed minima per non-empty set (zeros for an empty one)."""
    out = np.zeros((len(at) - 1, VALUES), dtype=np.uint64)
    full = np.flatnonzero(np.diff(at) > 0)
    if len(full):
        starts = at[:-1][full]
        for k, factor in enumerate(_factors(VALUES)):
            out[full, k] = np.minimum.reduceat(hashes * factor, starts)
    return mix(out)


def _key(members: bytes) -> bytes:
    return hashlib.blake2b(members, digest_size=16).digest()


def signed_rows(docs: DataFrame, width: int) -> DataFrame:
    """A row per document: set size, set digest, and the signature in 16 bits and in 8 bits a value."""

    def run(batches):
        rows = count(TaskContext.get().partitionId() << 33)
        for batch in batches:
            ids, done = batch.column(0), 0
            for hashes, at in shingle_sets(batch.column(1), width):
                n = len(at) - 1
                values = signatures(hashes, at)
                wide, narrow = values.astype(">u2"), (values >> np.uint64(16)).astype(np.uint8)
                keys = [_key(hashes[at[i] : at[i + 1]].astype("<u8").tobytes()) for i in range(n)]
                arrays = [
                    pa.array([next(rows) for _ in range(n)], pa.int64()),
                    ids.slice(done, n),
                    pa.array(np.diff(at).astype(np.int32)),
                    pa.array(keys, pa.binary()),
                    pa.array([w.tobytes() for w in wide], pa.binary()),
                    pa.array([w.tobytes() for w in narrow], pa.binary()),
                ]
                done += n
                yield pa.RecordBatch.from_arrays(arrays, ["row", "doc_id", "n", "key", "wide", "narrow"])

    return written(_texts(docs).mapInArrow(tidy(run), _SIGNED), "signed")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def orders(nodes: DataFrame) -> DataFrame:
    """A row per node and order: (tree, place, node, n); ``place`` is what the order sorts by, and ends in the 8-bit signature."""
    tree = nodes.select("node", "n", "wide", "narrow", F.explode(F.expr(f"sequence(0, {TREES - 1})")).alias("tree"))
    return tree.selectExpr(
        "tree",
        f"concat(substring(concat(wide, wide), {2 * DEPTH} * tree + 1, {4 * DEPTH}), "
        f"substring(narrow, {DEPTH} * tree + 1), substring(narrow, 1, {DEPTH} * tree)) AS place",
        "node",
        "n",
    )


def _likely(x: np.ndarray, y: np.ndarray, nx: int, ny: int, similarity: float, bottom: int) -> bool:
    """Whether two sets can have the similarity, from their smallest ``bottom`` hashes; certain if neither set has more."""
    both = np.concatenate((x, y))
    both.sort()
    same = both[1:] == both[:-1]
    if nx <= bottom and ny <= bottom:
        shared = int(np.count_nonzero(same))
        return 100 * shared >= round(100 * similarity) * (len(both) - shared)
    last = np.concatenate((np.flatnonzero(np.concatenate(([True], ~same)))[bottom : bottom + 1], [len(both)]))[0]
    shared = int(np.count_nonzero(same[: last - 1]))
    union = last - shared
    return shared >= (similarity - 5 * (similarity * (1 - similarity) / union) ** 0.5) * union


def sorted_neighbours(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From order rows (tree, place, node, n): for each row the later neighbour in its run that agrees best, as pairs (a, b, agree)
    with a < b, and the rows (tree, head, node) whose run holds another node."""
    pairs = runs = None
    while True:
        total = rows.count()
        parts = -(-total // TASK_ROWS)
        whole = parts <= 1
        order = ["tree", "place", "node"]
        placed = (rows.coalesce(1) if whole else rows.repartitionByRange(parts, *order)).sortWithinPartitions(*order)
        out = written(placed.select("tree", "place", "node", "n").mapInArrow(tidy(_window_task(not whole)), _WINDOW), "window")
        new_pairs = out.where(f"kind = {PAIR}").select("a", "b", "agree")
        new_runs = out.where(f"kind = {RUN}").select("tree", F.col("place").alias("head"), F.col("a").alias("node"))
        pairs = new_pairs if pairs is None else pairs.union(new_pairs)
        runs = new_runs if runs is None else runs.union(new_runs)
        if whole:
            break
        rows = out.where(f"kind = {EDGE}").select("tree", "place", F.col("a").alias("node"), F.col("agree").alias("n"))
    return pairs, runs.distinct()


PAIR, EDGE, RUN = 0, 1, 2
_WINDOW = "kind int, tree int, place binary, a long, b long, agree int"
_WIDTH = 4 * DEPTH + VALUES


def _places(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, _WIDTH)


def _window_task(with_edges: bool):
    """A sorted partition in blocks that overlap by ``NEIGHBOURS`` rows: its pairs, its rows in shared runs, and the rows beside its
    ends, from which a later pass finds what the cut between two partitions parts."""
    names = [c.split()[0] for c in _WINDOW.split(", ")]
    reach = NEIGHBOURS

    def rows_of(kind, tree, place, a, b, agree):
        n = len(a)
        nothing = pa.nulls(n, pa.int32()) if tree is None else tree, pa.nulls(n, pa.binary()) if place is None else place
        arrays = [pa.array(np.full(n, kind, np.int32)), *nothing, a, pa.nulls(n, pa.int64()) if b is None else b]
        arrays.append(pa.nulls(n, pa.int32()) if agree is None else agree)
        arrays = [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in arrays]
        return pa.RecordBatch.from_arrays(arrays, names)

    def found(table: pa.Table):
        place = _places(table["place"])
        tree, node, n = (table[c].to_numpy() for c in ("tree", "node", "n"))
        head = place[:, : 2 * DEPTH]
        same = (tree[1:] == tree[:-1]) & (head[1:] == head[:-1]).all(axis=1)
        if not same.any():
            return
        inside = np.flatnonzero(np.concatenate((same, [False])) | np.concatenate(([False], same)))
        heads = pa.array([h.tobytes() for h in head[inside]], pa.binary())
        yield rows_of(RUN, pa.array(tree[inside]), heads, pa.array(node[inside]), None, None)
        run = np.cumsum(np.concatenate(([True], ~same)))
        near = []
        for lag in range(1, min(reach, len(node) - 1) + 1):
            i = np.flatnonzero(run[lag:] == run[:-lag])
            if not len(i):
                break
            i = i[_same_size(n[i], n[i + lag]) & (node[i] != node[i + lag])]
            agree = (place[i, 4 * DEPTH :] == place[i + lag, 4 * DEPTH :]).sum(axis=1)
            good = agree >= AGREE
            near.append((i[good], i[good] + lag, agree[good]))
        i, j, agree = (np.concatenate(x) for x in zip(*near, strict=True))
        order = np.lexsort((j, -agree, i))
        i, j, agree = i[order], j[order], agree[order]
        best = np.ones(len(i), dtype=bool)
        best[1:] = i[1:] != i[:-1]
        a, b = node[i[best]], node[j[best]]
        yield rows_of(PAIR, None, None, pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(agree[best].astype(np.int32)))

    def edge(table: pa.Table):
        return rows_of(EDGE, table["tree"], table["place"], table["node"], None, table["n"])

    def run(batches):
        block: pa.Table | None = None
        first: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            if with_edges and (first is None or first.num_rows < reach):
                first = new.slice(0, reach) if first is None else pa.concat_tables([first, new]).slice(0, reach)
            block = new if block is None else pa.concat_tables([block, new])
            if block.num_rows >= 2 * reach + 10_000:
                yield from found(block)
                block = block.slice(block.num_rows - reach)
        if block is None:
            return
        yield from found(block)
        if with_edges:
            yield edge(first)
            yield edge(block.slice(max(0, block.num_rows - reach)))

    return run


def _same_size(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the sizes of two sets allow a similarity of 0.8."""
    return 5 * np.minimum(x, y).astype(np.int64) >= 4 * np.maximum(x, y).astype(np.int64)


def pairs_across(rows: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of different components in a shared run that can have the similarity, sought in the first order whose run holds
    both. Once a certain pair has joined two components in a task, it tells no other pair of these.

    ``rows`` are (tree, head, size, node, n, comp, wide, narrow, members). A run of more than ``BLOCK`` nodes is dealt out as
    pairs of blocks, so a task holds two blocks at most, whatever the run's size.
    """
    dealt = rows.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("own", F.expr("pmod(xxhash64(node), blocks)").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")})
    group, bottom = ["tree", "head", "x", "y"], BOTTOM

    def search(parts):
        tree, x, y, own, node, n, comp, wide, narrow, members = parts
        names, label = np.unique(comp, return_inverse=True)
        joined = list(range(len(names)))  # components that links found here have put together

        def find(c: int) -> int:
            while joined[c] != c:
                joined[c] = joined[joined[c]]
                c = joined[c]
            return c

        for start in range(0, len(node), 512):
            stop = min(start + 512, len(node))
            i, j = np.nonzero(comp[start:stop, None] != comp[None, :])
            i = i + start
            ok = (node[i] < node[j]) & _same_size(n[i], n[j])
            if x != y:
                ok &= own[i] != own[j]
            i, j = i[ok], j[ok]
            for s in range(0, len(i), 100_000):
                a, b = i[s : s + 100_000], j[s : s + 100_000]
                good = (narrow[a] == narrow[b]).sum(axis=1) >= AGREE
                a, b = a[good], b[good]
                first = (wide[a] == wide[b]).all(axis=2).argmax(axis=1) == tree
                for k, m in zip(a[first].tolist(), b[first].tolist(), strict=True):
                    c, d = find(label[k]), find(label[m])
                    if c != d and _likely(members[k], members[m], n[k], n[m], similarity, bottom):
                        yield node[k], node[m]
                        if n[k] <= bottom and n[m] <= bottom:  # then the link is certain
                            joined[c] = d

    def run(batches):
        held: list[pa.RecordBatch] = []
        key = None

        def done():
            table = pa.Table.from_batches(held)
            tree, _, x, y = key
            wide = np.frombuffer(b"".join(table["wide"].to_pylist()), dtype=">u2").reshape(-1, TREES, DEPTH)
            narrow = np.frombuffer(b"".join(table["narrow"].to_pylist()), dtype=np.uint8).reshape(-1, VALUES)
            members = [np.frombuffer(m, "<u8") for m in table["members"].to_pylist()]
            own, node, n, comp = (table[c].to_numpy() for c in ("own", "node", "n", "comp"))
            pairs = list(search((tree, x, y, own, node, n, comp, wide, narrow, members)))
            if pairs:
                a, b = zip(*pairs, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            keys = list(zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True))
            at = 0
            while at < len(keys):
                end = at
                while end < len(keys) and keys[end] == keys[at]:
                    end += 1
                if keys[at] != key and held:
                    yield from done()
                    held = []
                key = keys[at]
                held.append(batch.slice(at, end - at))
                at = end
        if held:
            yield from done()

    placed = dealt.repartition(*group).sortWithinPartitions(*group)
    columns = [*group, "own", "node", "n", "comp", "wide", "narrow", "members"]
    return placed.select(*columns).mapInArrow(tidy(run), "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets have the similarity, computed on the whole sets."""
    percent = round(100 * similarity)

    def run(batches):
        for batch in (b.slice(at, 64) for b in batches for at in range(0, b.num_rows, 64)):
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = np.concatenate((x, y))
                both.sort()
                same = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * same >= percent * (len(both) - same))
            kept = batch.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], ["a", "b"])

    left = sets.select(F.col("node").alias("a"), F.col("members").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("members").alias("y"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return joined.mapInArrow(tidy(run), "a long, b long")


def node_sets(docs: DataFrame, asked: DataFrame, width: int) -> DataFrame:
    """(node, members): the sorted shingle hashes of the asked nodes (node, key), made again from the text.

    The texts are not shuffled: a table of bits, one per key hash, tells each task which sets to send on; its size follows the number
    of asked nodes up to ``MOST_BITS``, and the join on the whole key decides.
    """
    bits = 1 << 20
    while bits < min(16 * asked.count(), MOST_BITS):
        bits *= 2
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bit_table(asked.select(F.conv(F.hex(F.substring("key", 1, 7)), 16, 10).cast("long").alias("hash")), bits)))

    def run(batches):
        known = np.unpackbits(shared.value, count=bits).astype(bool)
        for batch in batches:
            for hashes, at in shingle_sets(batch.column(0), width):
                rows = []
                for i in range(len(at) - 1):
                    members = hashes[at[i] : at[i + 1]].astype("<u8").tobytes()
                    key = _key(members)
                    if known[int.from_bytes(key[:7], "big") & (bits - 1)]:
                        rows.append((members, key))
                if rows:
                    members, keys = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(members, pa.binary()), pa.array(keys, pa.binary())], ["members", "key"])

    return _texts(docs).select("text").mapInArrow(tidy(run), "members binary, key binary").join(asked, "key").select("node", "members").dropDuplicates(["node"])


def with_roots(rows: DataFrame, roots: DataFrame | None, name: str, out: str) -> DataFrame:
    """Adds the root of a node column; a node outside the components is its own."""
    if roots is None:
        return rows.withColumn(out, F.col(name))
    found = roots.select(F.col("node").alias(name), F.col("root").alias("_root"))
    return rows.join(found, name, "left").withColumn(out, F.coalesce("_root", name)).drop("_root")


def node_components(docs: DataFrame, nodes: DataFrame, width: int, similarity: float) -> DataFrame | None:
    """(node, root) of the nodes that have a link; None without any link."""
    pairs, run_rows = sorted_neighbours(orders(nodes))
    run_rows = written(run_rows, "run-rows")
    light = nodes.select("node", "n", "key", "wide", "narrow")
    shared = written(light.join(run_rows.select("node").distinct(), "node"), "shared-nodes")
    sets = written(node_sets(docs, shared.select("node", "key"), width), "sets")

    # every node tries the neighbour that agrees best: most runs then hold one component
    ends = pairs.select(F.col("a").alias("node"), "agree", "a", "b").union(pairs.select(F.col("b").alias("node"), "agree", "a", "b"))
    best = ends.groupBy("node").agg(F.max(F.struct("agree", "a", "b")).alias("p")).select("p.a", "p.b").distinct()
    links = written(confirmed(best, sets, similarity), "links")
    roots = connected_components(links)

    marked = with_roots(run_rows, roots, "node", "comp")
    runs = marked.groupBy("tree", "head").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    mixed = written(marked.join(runs.where("low <> high").select("tree", "head", "size"), ["tree", "head"]), "mixed-runs")
    known = sets.select("node", F.substring("members", 1, 8 * BOTTOM).alias("members"))
    rows = mixed.join(shared.drop("key"), "node").join(known, "node")
    across = written(pairs_across(rows, similarity).distinct(), "candidates")
    more = written(confirmed(across, sets, similarity), "links")
    return connected_components(links.union(more)) if not more.isEmpty() else roots


def components(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row; component_id is the smallest doc_id that links reach.

    The forest is laid out for a similarity of 0.8 or more; with less it would lose links, so that is refused.
    """
    if not LEAST_SIMILARITY <= similarity <= 1:
        raise ValueError(f"similarity must be from {LEAST_SIMILARITY} to 1, not {similarity}")
    rows = signed_rows(docs, width)
    groups = written(
        rows.where("n > 0").groupBy("key").agg(F.min("row").alias("node"), F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")),
        "groups",
    )
    nodes = written(
        rows.select(F.col("row").alias("node"), "doc_id", "n", "key", "wide", "narrow").join(groups.select("node"), "node"), "nodes"
    )
    roots = node_components(docs, nodes, width, similarity)
    rooted = with_roots(groups, roots, "node", "root")
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.sum("copies").alias("size")).where("size > 1")
    named = written(rooted.join(smallest, "root").select("key", "component_id"), "named")
    out = rows.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "key").join(named, "key", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
