"""Join helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where NULL matches NULL; the key columns appear once, from the left."""
    renamed = right.select(*[F.col(c).alias(f"__r_{c}" if c in keys else c) for c in right.columns])
    condition = None
    for key in keys:
        term = F.col(key).eqNullSafe(F.col(f"__r_{key}"))
        condition = term if condition is None else condition & term
    joined = left.join(renamed, condition if condition is not None else F.lit(True), how)
    return joined.drop(*[f"__r_{k}" for k in keys])


#: Groups that may be sent to every executor (a few tens of bytes each).
BROADCAST_GROUPS = 200_000


def join_groups(df: DataFrame, groups: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join rows to a table with one row per group.

    Few groups means large groups: those are counted and broadcast, so the rows stay where they are and a group that holds a third
    of them is not moved to one task. With many groups the join is shuffled, and a partition that is still large is split at run time.
    """
    small = stage(groups)
    if small.count() <= BROADCAST_GROUPS:
        small = F.broadcast(small)
    return null_safe_join(df, small, keys, how)
