"""Consolidating labelled peptide observations into one row per peptide."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sequences import is_clean

RAW_COLUMNS = (
    "peptide",
    "immunogenicity",
    "immunogenicity_evidence",
    "mhc",
    "mhc_evidence",
    "host",
    "organism",
    "dataset",
)

POSITIVE, NEGATIVE = "Positive", "Negative"


def label_from_text(measure: Column) -> Column:
    """Binary label of a free-text qualitative measure; NULL stays NULL."""
    return F.when(measure.isNull(), F.lit(None)).when(measure.contains(POSITIVE), POSITIVE).otherwise(NEGATIVE)


def to_raw(df: DataFrame, **columns: Column | str) -> DataFrame:
    """Project any frame to the raw observation schema; columns not given are NULL strings."""
    exprs = []
    for name in RAW_COLUMNS:
        source = columns.get(name)
        expr = F.lit(None) if source is None else (F.col(source) if isinstance(source, str) else source)
        exprs.append(expr.cast("string").alias(name))
    return df.select(*exprs)


def evidence_semi(df: DataFrame, whitelist: DataFrame, column: str = "immunogenicity_evidence") -> DataFrame:
    """Observations whose evidence is whitelisted."""
    return df.join(whitelist.select(F.col(whitelist.columns[0]).alias(column)), column, "left_semi")


def _joined(column: str) -> Column:
    return F.array_join(F.array_sort(F.collect_set(column)), "|")


def epitope_import(raw: DataFrame, lengths: Iterable[int] = range(8, 12)) -> DataFrame:
    """One row per peptide: resolved label, contradiction flag and ``|``-joined distinct annotations.

    Any positive observation makes a peptide positive; a peptide with no usable label is negative.  All
    aggregates combine map-side, so the shuffle carries one partial row per peptide and task.
    """
    lengths = list(lengths)
    positive = F.coalesce(F.bool_or(F.col("immunogenicity") == POSITIVE), F.lit(False))
    negative = F.coalesce(F.bool_or(F.col("immunogenicity") == NEGATIVE), F.lit(False))
    return (
        raw.where(is_clean(F.col("peptide"), lengths))
        .groupBy("peptide")
        .agg(
            F.when(positive, POSITIVE).otherwise(NEGATIVE).alias("immunogenicity"),
            (positive & negative).alias("immunogenicity_contradiction"),
            _joined("immunogenicity_evidence").alias("immunogenicity_evidence"),
            F.replace(_joined("mhc"), F.lit(", "), F.lit("|")).alias("mhc"),
            _joined("mhc_evidence").alias("mhc_evidence"),
            _joined("host").alias("host"),
            _joined("organism").alias("organism"),
            _joined("dataset").alias("dataset"),
        )
    )


def contradiction_summary(epitopes: DataFrame) -> DataFrame:
    """Counts and shares reported after import."""
    n = F.count("*")
    contradicting = F.count_if("immunogenicity_contradiction")
    positive = F.count_if(F.col("immunogenicity") == POSITIVE)
    return epitopes.agg(
        n.alias("n_peptides"),
        contradicting.alias("n_contradicting"),
        (contradicting / n).alias("share_contradicting"),
        positive.alias("n_positive"),
        (positive / n).alias("share_positive"),
    )
