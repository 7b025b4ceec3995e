"""End to end: mutate, profile, score, connect, cluster, rank."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import CPP, DESCRIPTOR, FeatureName
from ..operators import communities, contact_profile, descriptors, network, scoring, sequences
from ..session import stage
from ..sources.features_io import resume, save_csv


@dataclass
class Settings:
    """Parameters of a prioritisation; ``feature_set=None`` means every feature."""

    lengths: Sequence[int] = tuple(range(8, 12))
    scale_ids: Sequence[str] | str = "all"
    frag_lens: Sequence[int] = tuple(range(3, 9))
    depth: int = 10_000
    library: str = "Weighted"
    feature_set: Sequence[str] | None = None
    seeds: Sequence[int] = (1, 2, 3, 4, 5)
    n_trees: int = 500
    max_depth: int | None = None
    all_targets: bool = True


def feature_table(
    peptides: DataFrame, library: DataFrame, scales: DataFrame, settings: Settings, residue_table=None, dipeptide_table=None
) -> DataFrame:
    """Descriptors and contact profiles of a peptide set, keyed by peptide."""
    wanted = settings.feature_set
    cpp_wanted = None if wanted is None else [f for f in wanted if f.startswith(f"{CPP}_")]
    described = descriptors.peptdesc_features(
        peptides, settings.frag_lens, residue_table, dipeptide_table, feature_set=wanted
    )
    if cpp_wanted is not None and not cpp_wanted:
        return described
    profiled = contact_profile.cpp_features(
        peptides, library, scales, settings.depth, settings.scale_ids, settings.frag_lens,
        [settings.library], settings.seeds, cpp_wanted,
    )
    return descriptors.features(described, profiled).drop("library", "frag_depth")


def needed_lengths(feature_set: Iterable[str]) -> list[int]:
    decoded = [FeatureName.decode(f) for f in feature_set]
    return sorted({d.frag_len for d in decoded if d is not None and d.family in (CPP, DESCRIPTOR)})


def prioritize_epitopes(
    train_features: DataFrame,
    metadata: DataFrame,
    originals: DataFrame,
    library: DataFrame,
    scales: DataFrame,
    settings: Settings | None = None,
    residue_table: DataFrame | None = None,
    dipeptide_table: DataFrame | None = None,
    out_dir: str | None = None,
) -> DataFrame:
    """Ranked original peptides with their cluster average and escape potential.

    Every peptide's ego graph is clustered; without ``all_targets`` only those of the originals are, which gives the same ranked
    rows.  With ``out_dir`` the feature table is resumable and the side tables are written there, cluster membership and cluster
    features with the type of each peptide.
    """
    cfg = settings or Settings()
    spark = originals.sparkSession
    originals = originals.select("peptide").distinct()
    mutants = stage(sequences.insilico_mutagenesis(originals, lengths=cfg.lengths))

    def build() -> DataFrame:
        return feature_table(mutants, library, scales, cfg, residue_table, dipeptide_table)

    if out_dir is None:
        table = build()
    else:
        # The peptide set is part of the identity of the stored table.
        digest = mutants.agg(F.count("*"), F.sum(F.xxhash64("peptide").cast("decimal(38,0)"))).first()
        table = resume(
            spark, out_dir, "features", build, peptides=[str(v) for v in digest], lengths=list(cfg.lengths),
            scales=cfg.scale_ids, frag_lens=list(cfg.frag_lens), depth=cfg.depth, library=cfg.library,
            features=cfg.feature_set, seeds=list(cfg.seeds),
        )
    forest, _ = scoring.train_models(
        train_features, metadata, cfg.feature_set, cfg.seeds, n_trees=cfg.n_trees, max_depth=cfg.max_depth
    )
    flagged = originals.withColumn("_original", F.lit(True))
    scores = stage(
        scoring.predict_external(forest, table)
        .join(flagged, "peptide", "left")
        .select(
            "peptide",
            "immunogenicity_score",
            "immunogenicity_score_cv",
            F.when(F.col("_original"), "Original").otherwise("InSilicoMutated").alias("peptide_type"),
        )
    )
    slim = scores.select("peptide", "immunogenicity_score")
    pairs = network.neighbor_pairs(slim.select("peptide"))
    edges = stage(network.neighbor_weighted(pairs, slim, score="immunogenicity_score"))
    targets = None if cfg.all_targets else originals
    clusters = communities.ego_clusters(edges, slim, targets)
    if out_dir is not None:
        clusters = stage(clusters)
    measured = stage(communities.escape_potential(clusters))
    ranked = communities.prioritize(scores, measured, originals)
    if out_dir is not None:
        save_csv(scores, f"{out_dir}/scores")
        edges.write.mode("overwrite").parquet(f"{out_dir}/neighbor_network")
        types = scores.select("peptide", "peptide_type")
        clusters.join(types, "peptide", "left").write.mode("overwrite").parquet(f"{out_dir}/clusters")
        save_csv(measured.join(types, "peptide", "left"), f"{out_dir}/cluster_features")
        save_csv(ranked, f"{out_dir}/summary")
    return ranked
