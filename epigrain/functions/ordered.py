"""Ranks, running totals and exact quantiles over arbitrarily large ordered groups.

A window without a partition key, or with a key that covers a third of the rows, is sorted by one
task.  The functions here first cut the order into buckets (equal hash ranges, or value ranges taken
from approximate quantiles), run the window inside ``(group, bucket)``, and add the totals of the
preceding buckets.  Only the per-bucket totals, a fixed number of rows per group, are ordered
by group.  The results are exact; the approximate quantiles only decide how evenly work is spread.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .hashing import seeded_hash
from .joins import null_safe_join

HASH_BUCKET_BITS = 12
VALUE_BUCKETS = 512


def hash_rank(
    df: DataFrame,
    seed,
    order_keys: Sequence[str],
    partition: Sequence[str] = (),
    rank: str = "rank",
    size: str = "size",
) -> DataFrame:
    """Add the 1-based rank of each row in seeded-hash order within ``partition``, and the partition size.

    ``order_keys`` must identify a row; ties of the 32-bit hash are broken by them.
    """
    part = list(partition)
    hashed = df.withColumn("_h", seeded_hash(seed, *[F.col(k) for k in order_keys])).withColumn(
        "_b", F.shiftright("_h", 32 - HASH_BUCKET_BITS)
    )
    ordered = Window.partitionBy(*part).orderBy("_b")
    offsets = (
        hashed.groupBy(*part, "_b")
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.sum("_n").over(ordered) - F.col("_n"))
        .withColumn(size, F.sum("_n").over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .drop("_n")
    )
    local = hashed.withColumn(
        "_local", F.row_number().over(Window.partitionBy(*part, "_b").orderBy("_h", *order_keys))
    )
    joined = null_safe_join(local, offsets, [*part, "_b"])
    return joined.withColumn(rank, F.col("_before") + F.col("_local")).drop("_h", "_b", "_local", "_before")


def value_bucketizer(df: DataFrame, column: str, buckets: int = VALUE_BUCKETS):
    """A function adding a bucket column whose edges are approximate quantiles of ``column`` (one pass)."""
    probs = [i / buckets for i in range(1, buckets)]
    edges = df.select(F.percentile_approx(F.col(column).cast("double"), probs, 4 * buckets)).first()[0] or []
    splits = [float("-inf"), *sorted(set(edges)), float("inf")]

    def add(frame: DataFrame, name: str) -> DataFrame:
        if len(splits) < 3:
            return frame.withColumn(name, F.lit(0.0))
        cast = frame.withColumn("_as_double", F.col(column).cast("double"))
        return Bucketizer(splits=splits, inputCol="_as_double", outputCol=name).transform(cast).drop("_as_double")

    return add


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order_by: str,
    values: Sequence[str],
    add_bucket=None,
) -> DataFrame:
    """Add ``before_<v>`` (sum over strictly earlier rows of the group) and ``total_<v>`` for each value.

    ``df`` must hold one row per (keys, order_by); aggregate ties first.  ``add_bucket`` assigns a
    bucket that is monotone in ``order_by``; by default buckets are approximate quantile ranges of the
    input, which is written once because it is then read three times.
    """
    part = list(keys)
    if add_bucket is None:
        df = stage(df)
        add_bucket = value_bucketizer(df, order_by)
    bucketed = add_bucket(df, "_bucket")
    ordered = Window.partitionBy(*part).orderBy("_bucket")
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = bucketed.groupBy(*part, "_bucket").agg(*[F.sum(v).alias(f"_s_{v}") for v in values])
    for v in values:
        offsets = offsets.withColumn(f"_before_{v}", F.sum(f"_s_{v}").over(ordered) - F.col(f"_s_{v}")).withColumn(
            f"total_{v}", F.sum(f"_s_{v}").over(whole)
        )
    offsets = offsets.drop(*[f"_s_{v}" for v in values])
    inside = Window.partitionBy(*part, "_bucket").orderBy(order_by)
    for v in values:
        bucketed = bucketed.withColumn(f"_local_{v}", F.sum(v).over(inside) - F.col(v))
    joined = null_safe_join(bucketed, offsets, [*part, "_bucket"])
    for v in values:
        joined = joined.withColumn(f"before_{v}", F.col(f"_before_{v}") + F.col(f"_local_{v}"))
    return joined.drop("_bucket", *[f"_{p}_{v}" for v in values for p in ("before", "local")])


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, value, n): ties collapsed map-side before anything is shuffled or ordered."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))


def quantile_terms(value: str, probs: Mapping[str, float], weight: str = "n") -> dict[str, Column]:
    """Aggregates over ``running_totals`` rows giving linearly interpolated (type 7) quantiles.

    ``weight`` names the multiplicity column whose running totals were taken.
    """
    terms = {}
    before, total = F.col(f"before_{weight}"), F.col(f"total_{weight}")
    last = before + F.col(weight)
    for name, p in probs.items():
        h = (total - 1) * F.lit(float(p))
        low = F.floor(h)
        high = F.least(low + 1, total - 1)
        at_low = F.max(F.when((before <= low) & (low < last), F.col(value)))
        at_high = F.max(F.when((before <= high) & (high < last), F.col(value)))
        frac = F.max(h - low)
        terms[name] = at_low + (at_high - at_low) * frac
    return terms


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """Exact interpolated quantiles per group without collecting any group into one task."""
    ranked = running_totals(value_counts(df, keys, value), keys, value, ["n"])
    return ranked.groupBy(*keys).agg(*[c.alias(k) for k, c in quantile_terms(value, probs).items()])
