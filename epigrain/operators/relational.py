"""Table idioms: keep-first, conditional update, compressed columns, set regions, group ordering, rescaling."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.joins import join_groups
from ..functions.ordered import exact_quantiles

MAX_VENN_SETS = 5
MAX_DUMMY_COLUMNS = 10_000


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First row per key in an explicit order, as a minimum that is taken before the shuffle and after it.

    A record has no fixed width, so both steps sort their rows by key; what is shuffled is one row per key and task.
    """
    order_key = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order_key).alias("_first"))
    return first.select(*keys, "_first.*").select(*df.columns)


def mutate_if(df: DataFrame, predicate: Column, **updates: Column) -> DataFrame:
    """Update existing columns on rows where ``predicate`` holds; a NULL predicate counts as not matched.

    The predicate is taken once on the input; later updates see the values set by earlier ones.
    """
    unknown = [c for c in updates if c not in df.columns]
    if unknown:
        raise ValueError(f"columns must exist before they can be updated: {unknown}")
    out = df.withColumn("_hit", F.coalesce(predicate, F.lit(False)))
    for name, expr in updates.items():
        out = out.withColumn(name, F.when(F.col("_hit"), expr).otherwise(F.col(name)))
    return out.drop("_hit")


def compressed_to_long(df: DataFrame, column: str) -> DataFrame:
    """One row per item of a ``|``-joined column; a NULL stays as one NULL row."""
    return df.withColumn(column, F.explode_outer(F.split(F.col(column), "\\|")))


def compressed_values(df: DataFrame, column: str) -> list[str]:
    """Distinct items of a compressed column (they become column names, so there are few)."""
    items = compressed_to_long(df, column).where(F.col(column).isNotNull()).select(column).distinct()
    rows = items.limit(MAX_DUMMY_COLUMNS + 1).collect()
    if len(rows) > MAX_DUMMY_COLUMNS:
        raise ValueError(f"{column} holds more than {MAX_DUMMY_COLUMNS} different items; use compressed_to_long")
    return sorted(r[0] for r in rows)


def compressed_to_dummy(df: DataFrame, column: str, values: Iterable[str] | None = None) -> DataFrame:
    """One 0/1 column per item of a compressed column; the compressed column is kept.

    A projection: no explode, pivot or join back.  Pass ``values`` to avoid the pass that finds them.
    """
    values = list(values) if values is not None else compressed_values(df, column)
    items = F.split(F.col(column), "\\|")
    dummies = [F.coalesce(F.array_contains(items, v).cast("double"), F.lit(0.0)).alias(v) for v in values]
    return df.select("*", *dummies)


def union_by_name(*frames: DataFrame) -> DataFrame:
    """Row-bind frames by column name, filling missing columns with NULL."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def sort_by_median(df: DataFrame, group: str, value: str, descending: bool = False) -> DataFrame:
    """All rows with their group's exact median, ordered by it."""
    medians = exact_quantiles(df, [group], value, {"group_median": 0.5})
    joined = join_groups(df, medians, [group])
    order = F.col("group_median").desc() if descending else F.col("group_median").asc()
    # the value spreads a large group over the ranges of the sort
    return joined.orderBy(order, group, value)


def fast_unique(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values."""
    return df.select(column).distinct().orderBy(column)


def venn_regions(df: DataFrame, item: str, set_name: str, sets: Sequence[str]) -> DataFrame:
    """Number of items in each exclusive region of up to five named sets (one membership bit per set)."""
    if len(sets) > MAX_VENN_SETS:
        raise ValueError("at most five sets are supported")
    bit = F.lit(0)
    for i, name in enumerate(sets):
        bit = F.when(F.col(set_name) == name, F.lit(1 << i)).otherwise(bit)
    masks = df.where(F.col(set_name).isin(list(sets))).groupBy(item).agg(F.bit_or(bit).alias("mask"))
    names = F.array_compact(
        F.array(*[F.when(F.col("mask").bitwiseAND(1 << i) != 0, F.lit(n)) for i, n in enumerate(sets)])
    )
    return masks.groupBy("mask").agg(F.count("*").alias("n_items")).withColumn("region", F.array_join(names, "&"))


def rescale(df: DataFrame, keys: Sequence[str], value: str, out: str = "rescaled") -> DataFrame:
    """Min-max rescale to [0, 1] within ``keys``; a constant group maps to 0.5."""
    spans = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    joined = join_groups(df, spans, list(keys))
    scaled = F.when(F.col("_hi") == F.col("_lo"), F.lit(0.5)).otherwise(
        (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    )
    return joined.withColumn(out, F.when(F.col(value).isNotNull(), scaled)).drop("_lo", "_hi")


def set_except(df: DataFrame, item: str, members: Column, others: Column) -> DataFrame:
    """Distinct items of the rows where ``members`` holds and of none where ``others`` does.

    One aggregate that combines before the shuffle; an anti-join would move every repeat of an item to one task.
    """
    seen = df.groupBy(item).agg(F.bool_or(members).alias("_in"), F.bool_or(others).alias("_out"))
    return seen.where(F.col("_in") & ~F.coalesce(F.col("_out"), F.lit(False))).select(item)


def semi_join(df: DataFrame, members: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows whose key is in ``members`` (set membership, no duplication)."""
    return df.join(members, on, "left_semi")


def anti_join(df: DataFrame, members: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows whose key is not in ``members``."""
    return df.join(members, on, "left_anti")


def parameter_grid(spark, **dimensions: Sequence) -> DataFrame:
    """Cartesian product of parameter vectors, built by exploding literal arrays."""
    grid = spark.range(1).drop("id")
    for name, values in dimensions.items():
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return grid


def select_matching(df: DataFrame, pattern: str, always: Sequence[str] = ()) -> DataFrame:
    """Columns whose name matches a regular expression, after the ``always`` columns."""
    import re

    return df.select(*always, *[F.col(f"`{c}`") for c in df.columns if c not in always and re.search(pattern, c)])


def inverse_columns(df: DataFrame) -> DataFrame:
    """Column order reversed (order decides which of two correlated features is dropped)."""
    return df.select(*[F.col(f"`{c}`") for c in reversed(df.columns)])
