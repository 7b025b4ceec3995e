"""Contact scales: wide matrix files, mirrored and rescaled to [0, 1] with their inverses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.alphabet import AMINO_ACIDS
from ..operators.relational import keep_first, rescale

# Documentation columns of a scale file.
DOC_COLUMNS = ("Description", "PMID", "Author", "Title", "Reference")


def read_pair_table(spark: SparkSession, path: str) -> DataFrame:
    """(aaindex_id, pair, value) from a wide CSV with one column per residue pair.

    Only the empty string is missing: ``NA`` is the asparagine-alanine pair, never a null marker.
    """
    wide = spark.read.option("header", True).option("nullValue", "").option("quote", '"').csv(path)
    pairs = [c for c in wide.columns if c not in DOC_COLUMNS and c != "AAIndexID"]
    typed = wide.select(F.col("AAIndexID").alias("aaindex_id"), *[F.col(p).cast("double").alias(p) for p in pairs])
    return typed.unpivot(["aaindex_id"], pairs, "pair", "value")


def contact_matrices(pairs: DataFrame) -> DataFrame:
    """(aaindex_id, aa1, aa2, value): mirrored, rescaled, plus ``<id>inv`` built from negated values.

    A pair given in both orientations keeps its own value; a missing orientation or an empty cell
    takes the other's.
    """
    pairs = pairs.where(F.col("value").isNotNull())
    given = pairs.select("aaindex_id", "pair", "value", F.lit(0).alias("_prio"))
    mirrored = pairs.select("aaindex_id", F.reverse("pair").alias("pair"), "value", F.lit(1).alias("_prio"))
    full = keep_first(given.unionByName(mirrored), ["aaindex_id", "pair"], ["_prio"])
    signed = full.select(
        F.explode(
            F.array(
                F.struct(F.col("aaindex_id"), F.col("value")),
                F.struct(F.concat("aaindex_id", F.lit("inv")).alias("aaindex_id"), (-F.col("value")).alias("value")),
            )
        ).alias("s"),
        "pair",
    ).select("s.*", "pair")
    scaled = rescale(signed, ["aaindex_id"], "value", "scaled")
    return scaled.select(
        "aaindex_id",
        F.substring("pair", 1, 1).alias("aa1"),
        F.substring("pair", 2, 1).alias("aa2"),
        F.col("scaled").alias("value"),
    )


def read_contact_matrices(spark: SparkSession, path: str) -> DataFrame:
    return contact_matrices(read_pair_table(spark, path))


def rule_scale(spark: SparkSession, scale_id: str = "SYN01", a: int = 7, b: int = 7, modulus: int = 20) -> DataFrame:
    """A documented made-up scale for trials: ((a*i + b*j + i*j) mod m) / (m - 1) over alphabet positions."""
    letters = F.lit(AMINO_ACIDS)
    cells = spark.range(400).select((F.col("id") / 20).cast("int").alias("i"), (F.col("id") % 20).cast("int").alias("j"))
    return cells.select(
        F.lit(scale_id).alias("aaindex_id"),
        F.concat(F.substring(letters, F.col("i") + 1, F.lit(1)), F.substring(letters, F.col("j") + 1, F.lit(1))).alias(
            "pair"
        ),
        ((a * F.col("i") + b * F.col("j") + F.col("i") * F.col("j")) % modulus / F.lit(float(modulus - 1))).alias("value"),
    )
