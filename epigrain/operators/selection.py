"""Feature selection: split, scaling, correlation filter, importances, feature sets.

A run is keyed by (library, fragment depth, seed) and carried as a :class:`Prepared` record.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import UnivariateFeatureSelector, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import seeded_hash
from ..functions.joins import join_groups
from ..functions.moments import column_moments, correlations, quoted
from ..functions.names import CPP, DESCRIPTOR, FeatureName, base_scale
from ..functions.ordered import hash_rank
from ..session import spread, stage
from .relational import inverse_columns

KEY_COLUMNS = ("data_type", "peptide", "immunogenicity", "cluster")
TRAIN_RATIO = 0.8


@dataclass
class Prepared:
    """A prepared feature table with what was learned from its Train rows."""

    dt: DataFrame
    scaling: dict[str, tuple[float, float | None]] | None = None
    correlation: np.ndarray | None = None
    importance: list[tuple[str, float]] = field(default_factory=list)
    removed: list[str] = field(default_factory=list)

    @property
    def features(self) -> list[str]:
        return [c for c in self.dt.columns if c not in KEY_COLUMNS]

    def keep(self, names: Iterable[str]) -> "Prepared":
        keys = [c for c in self.dt.columns if c in KEY_COLUMNS]
        names = list(names)
        removed = [c for c in self.features if c not in set(names)]
        return replace(self, dt=self.dt.selectExpr(*keys, *map(quoted, names)), removed=removed)

    def train(self) -> DataFrame:
        return self.dt.where(F.col("data_type") == "Train")


# --- split and scale --------------------------------------------------------------------------------------


def cluster_representative(metadata: DataFrame, seed: int) -> DataFrame:
    """One peptide per cluster: the rarer class first, then seeded-random; peptides unique."""
    sizes = metadata.groupBy("immunogenicity").agg(F.count("*").alias("_n"))
    # When the classes are equally frequent the negatives count as the rarer one.
    tie = F.when(F.col("immunogenicity") == "Negative", 0).otherwise(1)
    ranked = join_groups(metadata, sizes, ["immunogenicity"])
    order = F.struct(F.col("_n"), tie, seeded_hash(seed, F.col("peptide")), F.col("peptide"))
    payload = F.struct(*[c for c in metadata.columns if c != "cluster"])
    per_cluster = ranked.groupBy("cluster").agg(F.min_by(payload, order).alias("p"), F.min(order).alias("o"))
    rest = [c for c in metadata.columns if c not in ("cluster", "peptide")]
    flat = per_cluster.select("cluster", "p.*", "o")
    unique = flat.groupBy("peptide").agg(
        F.min_by(F.struct("cluster", *rest), F.struct("o", "cluster")).alias("p")
    )
    return unique.select("peptide", "p.*").select(*metadata.columns)


def stratified_split(
    metadata: DataFrame, seed: int, ratio: float = TRAIN_RATIO, label: str = "immunogenicity"
) -> DataFrame:
    """Add ``data_type``: the first ceil(ratio * n) rows of each class in seeded-hash order are Train."""
    ranked = hash_rank(metadata, seed, ["peptide"], [label], rank="_rank", size="_size")
    train = F.col("_rank") <= F.ceil(F.col("_size") * ratio)
    return ranked.withColumn("data_type", F.when(train, "Train").otherwise("Test")).drop("_rank", "_size")


def train_scaling(dt: DataFrame, names: Sequence[str]) -> dict[str, tuple[float, float | None]]:
    """Mean and standard deviation of each column over the Train rows; the deviation of fewer than two values is None."""
    m = column_moments(dt.where(F.col("data_type") == "Train"), list(names))
    return {
        name: (float(mean), math.sqrt(ss / (n - 1)) if n > 1 else None)
        for name, n, mean, ss in zip(names, m["n"], m["mean"], m["ss"])
        if n
    }


def apply_scaling(dt: DataFrame, scaling: Mapping[str, tuple[float, float | None]]) -> DataFrame:
    """Centre and scale with Train statistics; a constant column becomes 0."""
    columns = []
    for name in dt.columns:
        col = quoted(name)
        if name in scaling:
            mu, sd = scaling[name]
            col = (f"({col} - {mu!r}D) / {sd!r}D" if sd else f"{col} * 0D") + f" AS {col}"
        columns.append(col)
    return dt.selectExpr(*columns)


def preprocess(
    features: DataFrame, metadata: DataFrame, seed: int, legacy_split: bool = False
) -> Prepared:
    """Cluster de-duplication, stratified split, and scaling learned on Train; ``Peptide_*`` stay as they are.

    ``legacy_split`` splits all labelled peptides without de-duplication and keeps those without
    features (as rows of NULL features).
    """
    if legacy_split:
        split = stratified_split(metadata, seed)
    else:
        known = metadata.join(features.select("peptide"), "peptide", "left_semi")
        split = stratified_split(stage(cluster_representative(known, seed)), seed)
    names = [c for c in features.columns if c != "peptide"]
    keys = [c for c in KEY_COLUMNS if c in split.columns]
    dt = split.select(*keys).join(features, "peptide", "left").selectExpr(*keys, *map(quoted, names))
    # Read for every later step; by bytes alone it would be packed into very few tasks.
    dt = stage(spread(dt, "peptide"))
    scaled = [n for n in names if not n.startswith("Peptide_")]
    scaling = train_scaling(dt, scaled)
    return Prepared(apply_scaling(dt, scaling), scaling)


def preprocess_all(
    tables: Mapping[tuple[str, str], DataFrame], metadata: DataFrame, seeds: Sequence[int] = (1, 2, 3, 4, 5)
) -> dict[tuple[str, str, int], Prepared]:
    """Every (library, depth) table with every seed."""
    return {(*key, seed): preprocess(df, metadata, seed) for seed in seeds for key, df in tables.items()}


def inverse_order(runs: Mapping) -> dict:
    """Reverse the column order of every run's table."""
    return {k: replace(p, dt=inverse_columns(p.dt)) for k, p in runs.items()}


# --- correlation filter -----------------------------------------------------------------------------------


def _assembled(df: DataFrame, names: Sequence[str]) -> DataFrame:
    safe = [f"_f{i}" for i in range(len(names))]
    typed = df.select(
        *[c for c in df.columns if c not in set(names)],
        *[F.coalesce(F.col(f"`{n}`").cast("double"), F.lit(0.0)).alias(s) for n, s in zip(names, safe)],
    )
    return VectorAssembler(inputCols=safe, outputCol="_vector").transform(typed).drop(*safe)


def correlation_table(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The correlation matrix as rows (feature1, feature2, corr), made where its blocks lie."""
    texts = (n.replace("\\", "\\\\").replace("'", "\\'") for n in names)
    labels = F.expr("array(" + ", ".join(f"'{t}'" for t in texts) + ")")
    found = correlations(df, names)
    return found.select(F.get(labels, F.col("i")).alias("feature1"), F.get(labels, F.col("j")).alias("feature2"), "corr")


def correlation_matrix(df: DataFrame, names: Sequence[str]) -> np.ndarray:
    """Pearson correlations as a matrix on the driver: features squared in size."""
    got = correlations(df, names).toArrow()
    out = np.full((len(names), len(names)), np.nan)
    out[got["i"].to_numpy(), got["j"].to_numpy()] = got["corr"].to_numpy(zero_copy_only=False)
    return out


def correlated_features(matrix: np.ndarray, names: Sequence[str], cutoff: float) -> list[str]:
    """Greedy choice of features to drop so that no kept pair exceeds the cutoff.

    Features are visited by falling mean absolute correlation; of an offending pair the one with the larger
    mean correlation to the features still kept goes. Only pairs above the cutoff are visited, and the sums of the kept correlations
    of each feature are lowered when one goes, so the work grows with the square of their number.
    """
    absolute = np.abs(np.nan_to_num(matrix))
    np.fill_diagonal(absolute, 0.0)
    order = np.argsort(-absolute.sum(axis=1), kind="stable")
    ranked = absolute[np.ix_(order, order)]
    kept = np.ones(len(names), dtype=bool)
    sums, left = ranked.sum(axis=1), len(names)

    def drop(k: int) -> None:
        nonlocal left
        kept[k] = False
        sums[:] -= ranked[:, k]
        left -= 1

    for i in range(len(names) - 1):
        for j in np.flatnonzero(ranked[i, i + 1 :] > cutoff) + i + 1 if kept[i] else ():
            if not kept[j]:
                continue
            mean_i = sums[i] / (left - 1)
            mean_rest = (sums[kept].sum() - sums[j]) / (left - 1) ** 2
            if mean_i > mean_rest:
                drop(i)
                break
            drop(int(j))
    return [names[k] for k in order[~kept]]


def cor_filter(prepared: Prepared, threshold: float = 0.75) -> Prepared:
    """Drop correlated features, judged on Train rows; undefined correlations count as zero."""
    names = prepared.features
    matrix = np.nan_to_num(correlation_matrix(prepared.train(), names))
    dropped = set(correlated_features(matrix, names, threshold))
    return replace(prepared.keep([n for n in names if n not in dropped]), correlation=matrix)


# --- importance and selection -----------------------------------------------------------------------------


def with_class_weight(df: DataFrame, label: str = "immunogenicity") -> DataFrame:
    """Add numeric ``_label`` (1 positive) and the weight 1 / class size."""
    sizes = df.groupBy(label).agg((1.0 / F.count("*")).alias("_weight"))
    return join_groups(df, sizes, [label]).withColumn("_label", (F.col(label) == "Positive").cast("double"))


def forest_importance(df: DataFrame, names: Sequence[str], seed: int, n_trees: int = 100) -> list[tuple[str, float]]:
    """Class-weighted random-forest importances, rescaled to [0, 1], largest first."""
    data = _assembled(with_class_weight(df), names)
    forest = RandomForestClassifier(
        labelCol="_label", featuresCol="_vector", weightCol="_weight", numTrees=n_trees, seed=seed
    )
    raw = forest.fit(data).featureImportances.toArray()
    span = raw.max() - raw.min()
    scaled = (raw - raw.min()) / span if span > 0 else np.full(len(raw), 0.5)
    return sorted(zip(names, scaled.tolist()), key=lambda t: -t[1])


def importance(prepared: Prepared, seed: int, top: int | None = 100, n_trees: int = 100) -> Prepared:
    ranked = forest_importance(prepared.train(), prepared.features, seed, n_trees)
    return replace(prepared.keep([n for n, _ in ranked[:top]]), importance=ranked)


def importance_reduce(prepared: Prepared, top: int = 30) -> Prepared:
    return prepared.keep([n for n, _ in prepared.importance[:top]])


def importance_topk(table: DataFrame, keys: Sequence[str], top: int) -> DataFrame:
    """Rescale an importance table (keys, feature, value) per key and keep the first ``top`` of each.

    One row per feature and run: the ranked groups are as large as the feature list.
    """
    window = Window.partitionBy(*keys)
    low, high = F.min("value").over(window), F.max("value").over(window)
    scaled = F.when(high == low, F.lit(0.5)).otherwise((F.col("value") - low) / (high - low))
    position = F.row_number().over(window.orderBy(F.desc("importance"), F.asc("feature")))
    return table.withColumn("importance", scaled).withColumn("rank", position).where(F.col("rank") <= top)


def feature_select(prepared: Prepared, seed: int, top: int = 100, folds: int = 5, n_trees: int = 50) -> Prepared:
    """Univariate filter, then elimination by forest importance down to ``top`` features.

    The filter keeps features whose distribution differs between classes at the 5% level.  Elimination
    runs only when more than ``top`` features remain; the size (``top`` or all) with the better
    cross-validated kappa wins. Every fold filters, ranks and fits on its own rows, so no held-out label has a say in what it is
    predicted from.
    """
    picked = _differing(prepared.train(), prepared.features)
    filtered = prepared.keep(picked)
    if len(picked) <= top:
        return filtered
    kappas = _cv_kappas(prepared.train(), prepared.features, (None, top), seed, folds, n_trees)
    if kappas[top] < kappas[None]:
        return filtered
    return filtered.keep([n for n, _ in forest_importance(filtered.train(), picked, seed, n_trees)[:top]])


def _differing(train: DataFrame, names: Sequence[str]) -> list[str]:
    """Features whose distribution differs between the classes at the 5% level."""
    data = _assembled(with_class_weight(train), names)
    selector = UnivariateFeatureSelector(
        featuresCol="_vector", labelCol="_label", outputCol="_picked", selectionMode="fpr"
    ).setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(0.05)
    return [names[i] for i in sorted(selector.fit(data).selectedFeatures)]


def _cv_kappas(train: DataFrame, names: Sequence[str], sizes: Sequence[int | None], seed: int, folds: int, n_trees: int) -> dict:
    """Mean kappa over the folds for each number of features (None: all that pass the filter)."""
    from .scoring import kfold_assign

    folded = stage(spread(kfold_assign(train, seed, folds=folds, out="_fold"), "peptide"))
    totals = dict.fromkeys(sizes, 0.0)
    for k in range(1, folds + 1):
        rest, held = folded.where(F.col("_fold") != k), folded.where(F.col("_fold") == k)
        picked = _differing(rest, names)
        if not picked:
            continue  # nothing to tell the classes by: a kappa of 0
        ranked = [n for n, _ in forest_importance(rest, picked, seed, n_trees)]
        for size in sizes:
            totals[size] += _kappa(rest, held, ranked[:size], seed, n_trees)
    return {size: total / folds for size, total in totals.items()}


def _kappa(rest: DataFrame, held: DataFrame, names: Sequence[str], seed: int, n_trees: int) -> float:
    """Cohen's kappa, on the held rows, of a forest fitted to the rest."""
    model = RandomForestClassifier(
        labelCol="_label", featuresCol="_vector", weightCol="_weight", numTrees=n_trees, seed=seed
    ).fit(_assembled(with_class_weight(rest), names))
    truth, guess = (F.col("immunogenicity") == "Positive"), (F.col("prediction") == 1.0)
    row = model.transform(_assembled(held, names)).agg(
        F.count("*").alias("n"), F.count_if(truth & guess).alias("tp"), F.count_if(~truth & ~guess).alias("tn"),
        F.count_if(truth).alias("p"), F.count_if(guess).alias("g"),
    ).first()
    n = max(row["n"], 1)
    observed = (row["tp"] + row["tn"]) / n
    chance = (row["p"] * row["g"] + (n - row["p"]) * (n - row["g"])) / n**2
    return (observed - chance) / (1 - chance) if chance < 1 else 0.0


# --- feature sets -----------------------------------------------------------------------------------------


def combine_sets(sets: Sequence[Sequence[str]], criteria: str = "intersect") -> list[str]:
    """Reduce feature lists by intersection or union, in first-list order."""
    if criteria not in ("intersect", "union"):
        raise ValueError("criteria must be 'intersect' or 'union'")
    if criteria == "union":
        return list(dict.fromkeys(f for s in sets for f in s))
    common = set.intersection(*[set(s) for s in sets]) if sets else set()
    return [f for f in sets[0] if f in common] if sets else []


def feature_sets_table(memberships: DataFrame, criteria: str = "intersect") -> DataFrame:
    """Same as :func:`combine_sets` for a long (run, feature) table of any size."""
    per_feature = memberships.groupBy("feature").agg(F.count_distinct("run").alias("n_runs"))
    if criteria == "union":
        return per_feature.select("feature")
    n_runs = memberships.agg(F.count_distinct("run")).scalar()
    return per_feature.where(F.col("n_runs") == n_runs).select("feature")


def extract_features(runs: Mapping, criteria: str = "intersect") -> list[str]:
    return combine_sets([p.features for p in runs.values()], criteria)


def extract_parameters(runs: Mapping, criteria: str = "intersect") -> dict[str, list]:
    """Parameters encoded in the run keys and in the names of the common features."""
    features = extract_features(runs, criteria)
    decoded = [d for d in map(FeatureName.decode, features) if d is not None]
    return {
        "features": features,
        "aaindex_ids": sorted({base_scale(d.subject) for d in decoded if d.family == CPP}),
        "frag_lens": sorted({d.frag_len for d in decoded if d.family in (CPP, DESCRIPTOR)}),
        "frag_depths": list(dict.fromkeys(k[1] for k in runs)),
        "libraries": list(dict.fromkeys(k[0] for k in runs)),
        "seeds": list(dict.fromkeys(k[2] for k in runs)),
    }


def minimum_features(
    tables: Mapping[tuple[str, str], DataFrame],
    metadata: DataFrame,
    seeds: Sequence[int] = (1, 2, 3, 4, 5),
    threshold: float = 0.75,
    sizes: Sequence[int] = (100,),
    criteria: str = "intersect",
    n_trees: int = 100,
) -> dict[int, list[str]]:
    """Features chosen in every run, with columns in both orders; one list per requested size."""
    # Both column orders start from the same prepared rows: write them once.
    prepared = {k: replace(p, dt=stage(p.dt)) for k, p in preprocess_all(tables, metadata, seeds).items()}
    chosen = []
    for runs in (prepared, inverse_order(prepared)):
        chosen.append(
            {k: importance(cor_filter(p, threshold), k[2], sizes[0], n_trees) for k, p in runs.items()}
        )
    out = {}
    for size in sizes:
        lists = [
            extract_features({k: importance_reduce(p, size) for k, p in runs.items()}, criteria) for runs in chosen
        ]
        out[size] = combine_sets(lists, criteria)
    return out

