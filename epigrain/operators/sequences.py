"""Peptide sequence operators: filtering, windows, mutagenesis, letter dummies."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.alphabet import AMINO_ACIDS, positions, standard_pattern, windows
from ..session import spread


def words(df: DataFrame, text: str = "text", keep: Iterable[str] = ()) -> DataFrame:
    """Every run of ASCII letters of ``text``, upper-cased, one row each."""
    tokens = F.explode(F.regexp_extract_all(F.col(text), F.lit("[A-Za-z]+"), F.lit(0)))
    return df.select(*keep, tokens.alias("word")).withColumn("word", F.upper("word"))


def sequence_filter(
    df: DataFrame, column: str = "peptide", lengths: Iterable[int] = range(8, 12)
) -> DataFrame:
    """Upper-case and keep standard-residue sequences within the length range; duplicates stay."""
    lengths = list(lengths)
    pattern = standard_pattern(min(lengths), max(lengths))
    return df.withColumn(column, F.upper(column)).where(F.col(column).rlike(pattern))


def is_clean(column: Column, lengths: Iterable[int]) -> Column:
    """Condition used on ingest: already upper-case, standard residues only, length in the set."""
    lengths = sorted(set(lengths))
    return F.length(column).isin(lengths) & column.rlike(standard_pattern(lengths[0], lengths[-1]))


def sliding_window(df: DataFrame, column: str = "peptide", width: int = 3) -> DataFrame:
    """One row per window with its 1-based ``start``; short sequences yield no rows."""
    return df.select("*", F.posexplode(windows(F.col(column), width)).alias("start", "window")).withColumn(
        "start", F.col("start") + 1
    )


def sliding_window_fitted(df: DataFrame, column: str = "peptide", width: int = 3) -> DataFrame:
    """As :func:`sliding_window`, but the width shrinks to the shortest sequence when that is shorter."""
    shortest = df.select(F.min(F.length(column))).first()[0]
    return sliding_window(df, column, min(width, shortest) if shortest else width)


def reversed_sequence(column: Column) -> Column:
    return F.reverse(column)


def insilico_mutagenesis(
    df: DataFrame, column: str = "peptide", lengths: Iterable[int] = range(8, 12)
) -> DataFrame:
    """Distinct originals and single mutants whose length, after mutation, is within range.

    Substitutions by every residue, insertions before every position, deletions of every position.  Edits of one
    sequence that spell the same string are made once (an insertion next to an equal residue only in front of
    the run, a deletion only at its start) and edits leaving the length range are not made at all, so the
    final distinct, the only exchange, sees no repeats from within a row.
    """
    lengths = list(lengths)
    shortest, longest = min(lengths), max(lengths)
    n = F.length("_s")
    # Each row grows some 400-fold, so the rows are spread before they are edited, not after.
    inputs = spread(df.select(F.col(column).alias("_s")), "_s")
    source = inputs.select("_s", F.explode(positions(F.col("_s"))).alias("_i")).select(
        "_s",
        "_i",
        F.expr("substring(_s, 1, _i - 1)").alias("_head"),
        F.expr("substring(_s, _i, 1)").alias("_here"),
        F.expr("substring(_s, _i + 1)").alias("_tail"),
        F.expr("if(_i > 1, substring(_s, _i - 1, 1), '')").alias("_left"),
    )
    # The empty string stands for "no residue": it turns a substitution into a deletion.
    letters = F.explode(F.array(*[F.lit(a) for a in AMINO_ACIDS], F.lit(""))).alias("_a")
    edited = source.select("*", letters)
    same_length = n.between(shortest, longest)
    changes = F.array(
        F.when((F.col("_a") != "") & same_length & (F.col("_a") != F.col("_here")), F.concat("_head", "_a", "_tail")),
        F.when(
            (F.col("_a") != "") & (n + 1).between(shortest, longest) & (F.col("_a") != F.col("_left")),
            F.concat("_head", "_a", "_here", "_tail"),
        ),
        F.when(
            (F.col("_a") == "") & (n - 1).between(shortest, longest) & (F.col("_here") != F.col("_left")),
            F.concat("_head", "_tail"),
        ),
        F.when((F.col("_a") == "") & same_length & (F.col("_i") == 1), F.col("_s")),
    )
    return edited.select(F.explode(changes).alias(column)).where(F.col(column).isNotNull()).distinct()


def peptide_basic(df: DataFrame, column: str = "peptide") -> DataFrame:
    """Length and one presence dummy per standard residue."""
    dummies = [F.contains(F.col(column), F.lit(a)).cast("double").alias(f"Peptide_Contain{a}") for a in AMINO_ACIDS]
    return df.select(column, F.length(column).alias("Peptide_Length"), *dummies)
