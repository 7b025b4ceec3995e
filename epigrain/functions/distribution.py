"""Distribution statistics: eleven summary numbers of a score distribution, at any group size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .joins import null_safe_join
from .ordered import quantile_terms, running_totals, value_bucketizer, value_counts

# Consistency factor of the median absolute deviation, and the trimmed share per tail.
MAD_SCALE = 1.4826
TRIM = 0.1


def sample_skewness(value) -> Column:
    """Third central moment over the cubed sample standard deviation (population moments, n-1 deviation)."""
    n = F.count(value)
    return F.skewness(value) * F.pow((n - 1) / n, F.lit(1.5))


def sample_kurtosis(value) -> Column:
    """Fourth central moment over the fourth power of the sample standard deviation, minus three."""
    n = F.count(value)
    return (F.kurtosis(value) + 3) * F.pow((n - 1) / n, F.lit(2.0)) - 3


def moment_stats(value: str) -> list[Column]:
    return [
        F.count(value).alias("n"),
        F.avg(value).alias("Mean"),
        F.stddev_samp(value).alias("SD"),
        sample_skewness(value).alias("Skew"),
        sample_kurtosis(value).alias("Kurt"),
        (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("SE"),
        F.min(value).alias("Min"),
        F.max(value).alias("Max"),
    ]


def distribution_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per group: n, Mean, SD, Med, TrM, MAD, Skew, Kurt, SE, IQR, Q10, Q90, Min, Max.

    Moments are one map-side-combined aggregate.  Order statistics work on distinct values with
    multiplicities and bucketed running totals, so one group may hold any share of the rows.
    """
    keys = list(keys)
    moments = df.groupBy(*keys).agg(*moment_stats(value))
    counts = stage(value_counts(df, keys, value))
    ranked = running_totals(counts, keys, value, ["n"], value_bucketizer(counts, value))
    cut = F.floor(F.col("total_n") * F.lit(TRIM))
    kept = F.greatest(
        F.lit(0),
        F.least(F.col("before_n") + F.col("n"), F.col("total_n") - cut) - F.greatest(F.col("before_n"), cut),
    )
    q = quantile_terms(value, {"Med": 0.5, "Q10": 0.1, "Q25": 0.25, "Q75": 0.75, "Q90": 0.9})
    order = stage(
        ranked.groupBy(*keys).agg(
            *[c.alias(k) for k, c in q.items()], (F.sum(kept * F.col(value)) / F.sum(kept)).alias("TrM")
        )
    )
    deviations = (
        null_safe_join(counts, order.select(*keys, "Med"), keys)
        .withColumn("_dev", F.abs(F.col(value) - F.col("Med")))
        .groupBy(*keys, "_dev")
        .agg(F.sum("n").alias("n"))
    )
    mad = (
        running_totals(deviations, keys, "_dev", ["n"])
        .groupBy(*keys)
        .agg((quantile_terms("_dev", {"m": 0.5})["m"] * MAD_SCALE).alias("MAD"))
    )
    joined = null_safe_join(null_safe_join(moments, order, keys), mad, keys)
    return joined.withColumn("IQR", F.col("Q75") - F.col("Q25")).select(
        *keys, "n", "Mean", "SD", "Med", "TrM", "MAD", "Skew", "Kurt", "SE", "IQR", "Q10", "Q90", "Min", "Max"
    )
