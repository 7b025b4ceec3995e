"""Neighbour network: peptides one residue edit apart, scored edges and ego graphs.

Edges are found with exact keys instead of by generating 41 * length mutants per peptide:

* Two sequences differ by one substitution iff they share a "position + sequence without that residue"
  key.  Rows carry one residue bit per key and combine with ``bit_or``, so a key's group is a 64-bit
  integer however many rows it came from.
* A deletion is an equi-join of the sequences against the strings left after removing the first residue
  of each run.  Different runs leave different strings, so every edge appears once, with the smallest
  position, and no de-duplication shuffle is needed.
* An insertion edge is a reversed deletion edge.  Residues are inserted before positions 1..length only,
  so the reverse of a deletion that is only possible at the end is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.alphabet import AMINO_ACIDS, positions

# Order of the mutation patterns, and the floor of an edge weight.
MUTATION_PATTERNS = ("Substitution", "Insertion", "Deletion")
MIN_EDGE_WEIGHT = 0.001

# One bit per symbol a sequence may hold; mutations introduce only the 20 standard residues.
_SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz*-."


def _standard(residue: Column) -> Column:
    return F.contains(F.lit(AMINO_ACIDS), residue)


def substitution_pairs(df: DataFrame, column: str = "peptide") -> DataFrame:
    """Both directions of every same-length pair one substitution apart (input distinct)."""
    seq = F.col(column)
    keyed = df.select(seq.alias("_s"), F.explode(positions(seq)).alias("pos")).select(
        "pos",
        F.expr("substring(_s, 1, pos - 1)").alias("_head"),
        F.expr("substring(_s, pos + 1)").alias("_tail"),
        F.instr(F.lit(_SYMBOLS), F.expr("substring(_s, pos, 1)")).alias("_slot"),
    )
    # A symbol outside the table must not be lost silently.
    bit = F.when(F.col("_slot") > 0, F.expr("shiftleft(1L, _slot - 1)")).otherwise(
        F.raise_error(F.lit("sequences may hold letters, '*', '-' and '.' only"))
    )
    groups = keyed.groupBy("pos", "_head", "_tail").agg(F.bit_or(bit).alias("_bits")).where(F.bit_count("_bits") > 1)
    present = F.expr(
        "filter(transform(sequence(1, %d), k -> if((_bits & shiftleft(1L, k - 1)) <> 0, substring('%s', k, 1), '')), "
        "c -> c <> '')" % (len(_SYMBOLS), _SYMBOLS)
    )
    members = groups.select("pos", "_head", "_tail", present.alias("_m"))
    pairs = members.select("*", F.explode("_m").alias("_a")).select("*", F.explode("_m").alias("_b"))
    pairs = pairs.where((F.col("_a") != F.col("_b")) & _standard(F.col("_b")))
    return pairs.select(
        F.concat("_head", "_a", "_tail").alias("aaseq1"),
        F.concat("_head", "_b", "_tail").alias("aaseq2"),
        F.lit("Substitution").alias("mut_pattern"),
        F.concat_ws("_", "_a", "pos", "_b").alias("mut_type"),
    )


def deletion_matches(df: DataFrame, column: str = "peptide") -> DataFrame:
    """(longer, shorter, pos, residue) for every pair one deletion apart, at the first position that works."""
    source = df.select(F.col(column).alias("longer"))
    run_starts = F.expr(
        "filter(sequence(1, length(longer)), i -> i = 1 or substring(longer, i, 1) <> substring(longer, i - 1, 1))"
    )
    cut = (
        source.where(F.length("longer") > 1)
        .select("longer", F.explode(run_starts).alias("pos"))
        .select(
            "longer",
            "pos",
            F.expr("substring(longer, pos, 1)").alias("residue"),
            F.expr("concat(substring(longer, 1, pos - 1), substring(longer, pos + 1))").alias("shorter"),
        )
    )
    return cut.join(df.select(F.col(column).alias("shorter")), "shorter").select("longer", "shorter", "pos", "residue")


def neighbor_pairs(df: DataFrame, column: str = "peptide") -> DataFrame:
    """All directed edit-distance-one pairs of a distinct peptide set: aaseq1, aaseq2, mut_pattern, mut_type."""
    matches = deletion_matches(df, column)
    edges = F.array(
        F.struct(
            F.col("longer").alias("aaseq1"),
            F.col("shorter").alias("aaseq2"),
            F.lit("Deletion").alias("mut_pattern"),
            F.concat_ws("_", "residue", "pos", F.lit("-")).alias("mut_type"),
        ),
        F.when(
            (F.col("pos") < F.length("longer")) & _standard(F.col("residue")),
            F.struct(
                F.col("shorter").alias("aaseq1"),
                F.col("longer").alias("aaseq2"),
                F.lit("Insertion").alias("mut_pattern"),
                F.concat_ws("_", F.lit("-"), "pos", "residue").alias("mut_type"),
            ),
        ),
    )
    indels = matches.select(F.explode(edges).alias("e")).where(F.col("e").isNotNull()).select("e.*")
    return substitution_pairs(df, column).unionByName(indels)


def neighbor_weighted(pairs: DataFrame, scores: DataFrame, column: str = "peptide", score: str = "score") -> DataFrame:
    """Keep edges whose score does not fall; add both scores, their ratio and the clamped edge weight.

    Equal scores keep both directions.  ``aaseq1`` is the source and ``aaseq2`` the target of an edge.
    """
    first = scores.select(F.col(column).alias("aaseq1"), F.col(score).alias("score1"))
    second = scores.select(F.col(column).alias("aaseq2"), F.col(score).alias("score2"))
    s1, s2 = F.col("score1"), F.col("score2")
    infinity, undefined = F.lit(float("inf")), F.lit(float("nan"))
    # Division by a zero score: infinite towards a higher score, undefined between two zeros.
    ratio = F.when(s1 != 0, s2 / s1).when(s2 > 0, infinity).otherwise(undefined)
    weight = F.when(s2 != 0, s1 / s2).when(s1 < 0, -infinity).otherwise(undefined)
    return (
        pairs.join(first, "aaseq1")
        .join(second, "aaseq2")
        .where(s2 >= s1)
        .select(
            "aaseq1",
            "aaseq2",
            "mut_pattern",
            "mut_type",
            "score1",
            "score2",
            ratio.alias("score_ratio"),
            F.when(weight < MIN_EDGE_WEIGHT, F.lit(MIN_EDGE_WEIGHT)).otherwise(weight).alias("edge_weight"),
        )
    )


def vertices(edges: DataFrame) -> DataFrame:
    """Peptides with at least one edge; peptides without any are not part of the network."""
    return edges.select(F.explode(F.array("aaseq1", "aaseq2")).alias("peptide")).distinct()


def ego_pairs(edges: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Edges touching each target; incoming ones get the inverse score ratio, sequences stay as they are."""
    touching = edges.select(
        "*",
        F.explode(
            F.array(
                F.struct(F.col("aaseq1").alias("target"), F.lit(True).alias("outgoing")),
                F.struct(F.col("aaseq2").alias("target"), F.lit(False).alias("outgoing")),
            )
        ).alias("_t"),
    ).select("_t.*", *edges.columns)
    if targets is not None:
        touching = touching.join(targets.select(F.col("peptide").alias("target")), "target", "left_semi")
    parts = F.split("mut_type", "_")
    return touching.withColumn(
        "score_ratio", F.when(F.col("outgoing"), F.col("score_ratio")).otherwise(F.coalesce(F.try_divide(F.lit(1.0), F.col("score_ratio")), F.lit(float("inf"))))
    ).select(
        "target",
        "outgoing",
        *[c for c in edges.columns if c != "mut_type"],
        F.element_at(parts, 1).alias("aa1"),
        F.element_at(parts, 2).cast("int").alias("pos"),
        F.element_at(parts, 3).alias("aa2"),
    )


def ego_members(edges: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """(target, node): the target and its direct neighbours.

    A peptide of length L has at most 19L substitution, 20(L+1) insertion and L deletion neighbours.
    """
    both = edges.select(
        F.explode(
            F.array(
                F.struct(F.col("aaseq1").alias("target"), F.col("aaseq2").alias("node")),
                F.struct(F.col("aaseq2").alias("target"), F.col("aaseq1").alias("node")),
                F.struct(F.col("aaseq1").alias("target"), F.col("aaseq1").alias("node")),
                F.struct(F.col("aaseq2").alias("target"), F.col("aaseq2").alias("node")),
            )
        ).alias("m")
    ).select("m.*")
    if targets is not None:
        both = both.join(targets.select(F.col("peptide").alias("target")), "target", "left_semi")
    return both.distinct()


def ego_edges(edges: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Induced subgraph of every target: edges with both ends among its ego members."""
    members = ego_members(edges, targets)
    starts = members.select("target", F.col("node").alias("aaseq1"))
    ends = members.select("target", F.col("node").alias("aaseq2"))
    return edges.join(starts, "aaseq1").join(ends, ["target", "aaseq2"], "left_semi").select("target", *edges.columns)
