"""Seeded, engine-independent pseudo-random numbers.

Draws are a pure function of (seed, key): the same on every run, on every partitioning and after a
lost executor, unlike ``rand()`` whose values depend on how rows are partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_RANGE = 1 << 32


def seeded_hash(seed, *keys: Column) -> Column:
    """Uniform integer in [0, 2**32) derived from the seed and the key columns."""
    first = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    text = F.concat_ws("|", first, *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def uniform(seed, *keys: Column) -> Column:
    """Uniform double in [0, 1)."""
    return seeded_hash(seed, *keys) / F.lit(float(HASH_RANGE))
