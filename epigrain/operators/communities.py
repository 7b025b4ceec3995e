"""Communities of ego graphs (short random walks) and the escape potential derived from them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .network import ego_edges, vertices

# Fixed value: length of the random walks.
WALK_STEPS = 4


def walk_communities(weights: np.ndarray, steps: int = WALK_STEPS) -> np.ndarray:
    """Walktrap partition (Pons and Latapy, 2005) of a small weighted graph, cut at the best modularity.

    Agglomerative: the two adjacent communities whose merge least increases the squared walk distance
    are joined.  Every vertex gets a loop of its average edge weight, as in the paper.
    """
    n = len(weights)
    if n == 1:
        return np.zeros(1, dtype=int)
    degree = weights.sum(axis=1)
    neighbours = np.maximum((weights > 0).sum(axis=1), 1)
    looped = weights + np.diag(np.where(degree > 0, degree / neighbours, 1.0))
    strength = looped.sum(axis=1)
    walk = np.linalg.matrix_power(looped / strength[:, None], steps) / np.sqrt(strength)[None, :]
    size = np.ones(n)
    between = weights.astype(float).copy()
    total = degree.sum()
    share = degree / total if total else degree

    def costs(i, others: np.ndarray) -> np.ndarray:
        gap = ((walk[others] - walk[i]) ** 2).sum(axis=1)
        return size[i] * size[others] / (size[i] + size[others]) * gap / n

    cost = np.full((n, n), np.inf)
    i, near = np.nonzero(np.triu(between, 1) > 0)
    if near.size:
        cost[i, near] = cost[near, i] = costs(i, near)
    modularity = -(share**2).sum()
    merges, best, best_merges = [], modularity, 0
    while True:
        at = int(np.argmin(cost))
        i, j = divmod(at, n)
        if not np.isfinite(cost[i, j]):
            break
        i, j = min(i, j), max(i, j)
        modularity += 2 * (between[i, j] / total - share[i] * share[j])
        walk[i] = (size[i] * walk[i] + size[j] * walk[j]) / (size[i] + size[j])
        size[i] += size[j]
        share[i] += share[j]
        between[i] += between[j]
        between[:, i] += between[:, j]
        between[i, i] = 0.0
        between[j] = between[:, j] = 0.0
        merges.append((i, j))
        cost[j] = cost[:, j] = cost[i] = cost[:, i] = np.inf
        near = np.flatnonzero(between[i] > 0)
        if near.size:
            cost[i, near] = cost[near, i] = costs(i, near)
        if modularity > best + 1e-12:
            best, best_merges = modularity, len(merges)
    # a community is named by its smallest vertex, the one that others were merged into
    into = np.arange(n)
    for i, j in reversed(merges[:best_merges]):
        into[j] = into[i]
    return np.unique(into, return_inverse=True)[1]


CLUSTER_SCHEMA = "target string, peptide string, role string, cluster_id string"
#: Graphs of up to so many vertices are looked up among those already cut, and how many of them a task remembers.
KNOWN_VERTICES, KNOWN_GRAPHS = 16, 20_000


def _cluster_egos(batches):
    """The members and clusters of ego graphs that come as edges in order of their target; only the last, open one is held over."""
    known: dict[bytes, np.ndarray] = {}
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        got = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
        open_from = pc.index(got["target"], got["target"][-1]).as_py()
        held = got.slice(open_from)
        if open_from:
            yield _clustered(got.slice(0, open_from), known)
    if held is not None:
        yield _clustered(held, known)


def _clustered(edges: pa.Table, known: dict[bytes, np.ndarray]) -> pa.RecordBatch:
    """Whole ego graphs: vertices are numbered for all of them together, in order of their names."""
    m = edges.num_rows
    coded = pa.concat_arrays([c for name in ("aaseq1", "aaseq2", "target") for c in edges[name].chunks]).dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    names, codes = coded.dictionary.take(pa.array(order)), rank[coded.indices.to_numpy()]
    target, weight = codes[2 * m :], edges["weight"].to_numpy()
    first = np.flatnonzero(np.concatenate(([True], target[1:] != target[:-1])))
    ego = np.repeat(np.arange(len(first)), np.diff(np.append(first, m)))
    members, at = np.unique(np.tile(ego, 2) * len(order) + codes[: 2 * m], return_inverse=True)
    of, code = members // len(order), members % len(order)
    starts = np.searchsorted(of, np.arange(len(first) + 1))
    local = at - np.tile(starts[ego], 2)
    labels = np.empty(len(members), np.int64)
    for k, (begin, end) in enumerate(zip(first, np.append(first[1:], m))):
        n = starts[k + 1] - starts[k]
        # Parallel edges (both directions of a tie) add up.
        matrix = np.bincount(local[begin:end] * n + local[m + begin : m + end], weight[begin:end], n * n).reshape(n, n)
        labels[starts[k] : starts[k + 1]] = _known_communities(matrix + matrix.T, known)
    roles = pa.array(["Neighbor", "Target"]).take(pa.array((code == target[first][of]).astype(int)))
    clusters = pa.array([f"Cluster{k + 1}" for k in range(labels.max() + 1)]).take(pa.array(labels))
    columns = [names.take(pa.array(target[first][of])), names.take(pa.array(code)), roles, clusters]
    return pa.RecordBatch.from_arrays(columns, ["target", "peptide", "role", "cluster_id"])


def _known_communities(weights: np.ndarray, known: dict[bytes, np.ndarray]) -> np.ndarray:
    """:func:`walk_communities`; most ego graphs are small and have the same weights as others, and are cut once."""
    if len(weights) > KNOWN_VERTICES:
        return walk_communities(weights)
    key = weights.tobytes()
    if key not in known:
        if len(known) >= KNOWN_GRAPHS:
            known.pop(next(iter(known)))
        known[key] = walk_communities(weights)
    return known[key]


def ego_clusters(
    edges: DataFrame, scores: DataFrame, targets: DataFrame | None = None, weighted: bool = False
) -> DataFrame:
    """Cluster the ego graph of every target and attach scores: one row per (target, member).

    An ego graph has at most 19L + 20(L+1) + L vertices besides its target, so one group stays small however
    many peptides there are.  Pass ``targets`` to cluster only those; the default is every vertex.
    """
    weight = F.col("edge_weight") if weighted else F.lit(1.0)
    slim = edges.select("aaseq1", "aaseq2", weight.alias("weight"))
    # Spread by target first: by bytes alone the small ego graphs would be packed into very few tasks.
    graphs = spread(ego_edges(slim, targets).select("target", "aaseq1", "aaseq2", "weight"), "target")
    clustered = graphs.sortWithinPartitions("target").mapInArrow(_cluster_egos, CLUSTER_SCHEMA)
    return clustered.join(scores, "peptide", "left").select(
        "target", "peptide", "role", "cluster_id", *[c for c in scores.columns if c != "peptide"]
    )


def escape_potential(summary: DataFrame, score: str = "immunogenicity_score") -> DataFrame:
    """Per target: its cluster's mean score and the distances to other clusters and other members.

    With a single cluster both cluster differences are minus infinity.
    """
    is_target = F.col("role") == "Target"
    per_cluster = summary.groupBy("target", "cluster_id").agg(
        F.avg(score).alias("_avg"),
        F.max(score).alias("_max"),
        F.min(score).alias("_min"),
        F.bool_or(is_target).alias("_own"),
        F.max(F.when(is_target, F.col(score))).alias("_score"),
    )
    own = F.max(F.when(F.col("_own"), F.col("_avg")))
    other_max = F.coalesce(F.max(F.when(~F.col("_own"), F.col("_avg"))), F.lit(float("-inf")))
    other_min = F.coalesce(F.min(F.when(~F.col("_own"), F.col("_avg"))), F.lit(float("inf")))
    target_score = F.max("_score")
    return per_cluster.groupBy("target").agg(
        F.max(F.when(F.col("_own"), F.col("cluster_id"))).alias("cluster_id"),
        target_score.alias("immunogenicity_score"),
        own.alias("cluster_average"),
        (other_max - own).alias("cluster_diff_max"),
        (own - other_min).alias("cluster_diff_min"),
        (F.max("_max") - target_score).alias("diff_max"),
        (target_score - F.min("_min")).alias("diff_min"),
    ).withColumnRenamed("target", "peptide")


def isolated_count(peptides: DataFrame, edges: DataFrame) -> DataFrame:
    """How many peptides have no edge and therefore drop out of network results."""
    return peptides.join(vertices(edges), "peptide", "left_anti").agg(F.count("*").alias("n_isolated"))


def cluster_consensus(members: DataFrame, cluster: str = "cluster_id", threshold: float = 0.5) -> DataFrame:
    """Consensus of equal-length clusters: the one residue with a share of at least ``threshold``, else X.

    A cluster with one member is its own consensus.  Letters are counted per (cluster, position, residue), so the
    cluster's size does not matter.
    """
    letters = members.select(
        cluster, F.posexplode(F.split(F.col("peptide"), "")).alias("position", "residue")
    ).groupBy(cluster, "position", "residue").agg(F.count("*").alias("n"))
    sizes = members.groupBy(cluster).agg(F.count("*").alias("size"))
    frequent = F.col("n") >= F.col("size") * threshold
    symbols = letters.join(sizes, cluster).groupBy(cluster, "position").agg(
        F.when(F.count_if(frequent) == 1, F.max(F.when(frequent, F.col("residue")))).otherwise("X").alias("symbol"),
        F.max("size").alias("size"),
    )
    return symbols.groupBy(cluster).agg(
        F.max("size").alias("size"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("position", "symbol"))), lambda s: s["symbol"]), ""
        ).alias("consensus"),
    )


def aligned_consensus(members: DataFrame, keys: Sequence[str] = ("target",), threshold: float = 0.5) -> DataFrame:
    """Consensus of the members of each cluster, of equal lengths or not, aligned to a target that each differs from by one edit at most.

    ``members`` has ``keys``, ``target`` and ``peptide``. A member's alignment needs no search: it agrees with the target up to
    their first difference, where it has another residue, one more or one less. The profile has a column per target position and one
    before each position (or behind the last) where a member has a residue more; members without it have a gap there. A column
    becomes the one residue that has a share of at least ``threshold``, else X; so does a column of gaps. Counts are taken per
    (cluster, column, residue), so no cluster is gathered. Members further from the target than one edit are refused.
    """
    keys = list(dict.fromkeys([*keys, "target"]))
    rows = members.select(*keys, "peptide").where(F.col("target").isNotNull() & F.col("peptide").isNotNull())
    here, there = F.length("peptide"), F.length("target")
    differ = F.filter(F.sequence(F.lit(1), F.least(here, there)), lambda i: F.substring("peptide", i, F.lit(1)) != F.substring("target", i, F.lit(1)))
    agreed = F.coalesce(F.array_min(differ) - 1, F.least(here, there))
    rows = rows.withColumn("agreed", agreed).withColumn("more", here - there)
    tail = lambda c, skip: F.substring(c, F.col("agreed") + 1 + skip, F.length(c))
    fits = F.when(F.col("more") == 1, tail("peptide", 1) == tail("target", 0)).when(F.col("more") == -1, tail("peptide", 0) == tail("target", 1))
    fits = fits.otherwise((F.col("more") == 0) & (tail("peptide", 1) == tail("target", 1)))
    rows = rows.withColumn("fits", F.when(fits, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no single edit: "), "peptide", F.lit(" / "), "target")).cast("boolean"))).where("fits")
    # column 2i is target position i, column 2i + 1 lies behind it
    letters = F.transform(
        F.sequence(F.lit(1), here),
        lambda i: F.struct(
            F.when((F.col("more") == 1) & (i == F.col("agreed") + 1), 2 * i - 1)
            .when((F.col("more") == 1) & (i > F.col("agreed")), 2 * i - 2)
            .when((F.col("more") == -1) & (i > F.col("agreed")), 2 * i + 2)
            .otherwise(2 * i).alias("column"),
            F.substring("peptide", i, F.lit(1)).alias("residue"),
        ),
    )
    counted = rows.select(*keys, F.inline(letters)).groupBy(*keys, "column", "residue").agg(F.count(F.lit(1)).alias("n"))
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"), F.max(there).alias("length"))
    frequent = F.col("n") >= F.col("size") * threshold
    held = counted.join(sizes, keys).groupBy(*keys, "column").agg(
        F.max("size").alias("size"), F.sum("n").alias("present"), F.count_if(frequent).alias("many"), F.max(F.when(frequent, F.col("residue"))).alias("residue")
    )
    # gaps count as one more symbol of the column; a column that all members lack is one of gaps too
    gaps = (F.col("size") - F.col("present") >= F.col("size") * threshold).cast("int")
    symbol = F.when((F.col("many") == 1) & (gaps == 0), F.col("residue")).otherwise("X")
    own = held.select(*keys, F.struct("column", symbol.alias("symbol")).alias("c"))
    every = sizes.select(*keys, F.explode(F.transform(F.sequence(F.lit(1), "length"), lambda i: F.struct((2 * i).alias("column"), F.lit("X").alias("symbol")))).alias("c"))
    bare = every.join(own.select(*keys, F.col("c.column").alias("column")), [*[every[k] == own[k] for k in keys], every["c.column"] == F.col("column")], "left_anti")
    symbols = own.unionByName(bare).groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["symbol"]), "").alias("consensus"))
    return sizes.select(*keys, "size").join(symbols, keys)


def prioritize(scores: DataFrame, cluster_features: DataFrame, originals: DataFrame) -> DataFrame:
    """Original peptides ordered by score, then cluster average (both falling), then escape potential (rising)."""
    features = cluster_features.select(
        "peptide",
        F.col("cluster_average").alias("immunogenicity_score_cluster_average"),
        F.col("cluster_diff_min").alias("escape_potential"),
    )
    kept = scores.select("peptide", "immunogenicity_score").join(originals.select("peptide"), "peptide", "left_semi")
    return kept.join(features, "peptide").orderBy(
        F.desc_nulls_last("immunogenicity_score"),
        F.desc_nulls_last("immunogenicity_score_cluster_average"),
        F.asc_nulls_first("escape_potential"),
        F.asc("peptide"),
    )
