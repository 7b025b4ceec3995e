"""The amino-acid alphabet and expressions over single residues."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the 20 standard amino acids, one-letter codes in alphabetical order.
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"


def standard_pattern(min_len: int = 1, max_len: int | None = None) -> str:
    """Regular expression for a string made of standard residues only."""
    upper = "" if max_len is None else str(max_len)
    return f"^[{AMINO_ACIDS}]{{{min_len},{upper}}}$"


def positions(sequence: Column) -> Column:
    """1..length as an array; an empty array for the empty string (``sequence(1, 0)`` would count down)."""
    n = F.length(sequence)
    return F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def windows(sequence: Column, width: int) -> Column:
    """All substrings of ``width`` residues, left to right; empty when the sequence is shorter."""
    count = F.length(sequence) - F.lit(width - 1)
    starts = F.when(count >= 1, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(sequence, i, F.lit(width)))
