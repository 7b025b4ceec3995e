"""Fragment library: window frequencies of receptor sequences and seeded samples from them."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.alphabet import AMINO_ACIDS, windows
from ..functions.hashing import seeded_hash, uniform
from ..functions.ordered import hash_rank, running_totals
from ..session import stage

LIBRARIES = ("Deduplicated", "Weighted", "Mock")


def fragment_freq(sequences: DataFrame, column: str = "cdr3b", frag_lens: Iterable[int] = range(3, 9)) -> DataFrame:
    """(frag_len, fragment, count, freq) over all windows and their reversals.

    A fragment and its reversal always have the same count, so one canonical string per pair is
    counted, which halves the shuffled keys, and the pair is restored afterwards.
    """
    per_length = F.array(
        *[F.struct(F.lit(n).alias("frag_len"), windows(F.col(column), n).alias("w")) for n in frag_lens]
    )
    exploded = sequences.select(F.explode(per_length).alias("p")).select(
        "p.frag_len", F.explode("p.w").alias("fragment")
    )
    counted = (
        exploded.select("frag_len", F.least("fragment", F.reverse("fragment")).alias("_key"))
        .groupBy("frag_len", "_key")
        .agg(F.count("*").alias("_n"))
    )
    both = counted.select(
        "frag_len",
        F.explode(F.array_distinct(F.array("_key", F.reverse("_key")))).alias("fragment"),
        F.when(F.col("_key") == F.reverse("_key"), F.col("_n") * 2).otherwise(F.col("_n")).alias("count"),
    )
    totals = both.groupBy("frag_len").agg(F.sum("count").alias("_total"))
    # One total per requested window length: a handful of rows, whatever the input size.
    return both.join(F.broadcast(totals), "frag_len").select(
        "frag_len", "fragment", "count", (F.col("count") / F.col("_total")).alias("freq")
    )


def _draws(spark, frag_lens: Sequence[int], seeds: Sequence[int], depth: int) -> DataFrame:
    return (
        spark.range(1, depth + 1)
        .withColumn("frag_len", F.explode(F.array(*[F.lit(n) for n in frag_lens])))
        .withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    )


def sample_deduplicated(freq: DataFrame, frag_lens, seeds, depth: int) -> DataFrame:
    """Uniform draws with replacement from the distinct fragments of each length.

    Fragments are numbered in hash order with bucketed ranks; a draw is an equi-join on that number.
    """
    ranked = hash_rank(
        freq.select("frag_len", "fragment"), "Deduplicated", ["fragment"], ["frag_len"], rank="_rank", size="_size"
    )
    sizes = freq.groupBy("frag_len").agg(F.count("*").alias("_size"))
    draws = (
        _draws(freq.sparkSession, frag_lens, seeds, depth)
        .join(F.broadcast(sizes), "frag_len")
        .withColumn(
            "_rank",
            F.floor(uniform(F.col("seed"), F.lit("Deduplicated"), F.col("frag_len"), F.col("id")) * F.col("_size")) + 1,
        )
    )
    picked = draws.join(ranked.drop("_size"), ["frag_len", "_rank"])
    return picked.select(F.lit("Deduplicated").alias("library"), "frag_len", "seed", "id", "fragment")


def sample_weighted(freq: DataFrame, frag_lens, seeds, depth: int) -> DataFrame:
    """Draws with replacement in proportion to frequency: inverse-CDF lookup as a binned range join.

    Each fragment owns an interval of the cumulative counts.  Intervals and draws meet in
    ``depth`` equal bins, so a bin holds about one draw per seed; a fragment that owns a third of the mass
    is listed in a third of the bins rather than meeting a third of the draws in one of them.
    """
    spark = freq.sparkSession

    def prefix_bucket(frame: DataFrame, name: str) -> DataFrame:
        # Monotone in the fragment: three leading residues, at most 8,000 buckets per length.
        return frame.withColumn(name, F.substring("fragment", 1, 3))

    cdf = running_totals(
        freq.select("frag_len", "fragment", "count"), ["frag_len"], "fragment", ["count"], prefix_bucket
    )
    totals = freq.groupBy("frag_len").agg(F.sum("count").alias("_total"))

    def bin_of(position, total):
        return F.floor(position / total * F.lit(float(depth))).cast("long")

    intervals = cdf.select(
        "frag_len",
        "fragment",
        F.col("before_count").alias("_lo"),
        (F.col("before_count") + F.col("count")).alias("_hi"),
        F.explode(
            F.sequence(
                bin_of(F.col("before_count"), F.col("total_count")),
                bin_of(F.col("before_count") + F.col("count") - 1, F.col("total_count")),
            )
        ).alias("_bin"),
    )
    draws = (
        _draws(spark, frag_lens, seeds, depth)
        .join(F.broadcast(totals), "frag_len")
        .withColumn(
            "_at",
            F.floor(uniform(F.col("seed"), F.lit("Weighted"), F.col("frag_len"), F.col("id")) * F.col("_total")).cast(
                "long"
            ),
        )
        .withColumn("_bin", bin_of(F.col("_at"), F.col("_total")))
    )
    hit = (F.col("_at") >= F.col("_lo")) & (F.col("_at") < F.col("_hi"))
    picked = draws.join(intervals, ["frag_len", "_bin"]).where(hit)
    return picked.select(F.lit("Weighted").alias("library"), "frag_len", "seed", "id", "fragment")


def sample_mock(spark, frag_lens, seeds, depth: int) -> DataFrame:
    """Random residue strings: each position is an independent seeded draw."""
    letter = lambda j: F.substring(
        F.lit(AMINO_ACIDS),
        (seeded_hash(F.col("seed"), F.lit("Mock"), F.col("frag_len"), F.col("id"), j) % 20 + 1).cast("int"),
        F.lit(1),
    )
    return _draws(spark, frag_lens, seeds, depth).select(
        F.lit("Mock").alias("library"),
        "frag_len",
        "seed",
        "id",
        F.array_join(F.transform(F.sequence(F.lit(1), F.col("frag_len")), letter), "").alias("fragment"),
    )


def fragment_library(
    sequences: DataFrame,
    column: str = "cdr3b",
    frag_lens: Sequence[int] = range(3, 9),
    depth: int = 100_000,
    seeds: Sequence[int] = (1, 2, 3, 4, 5),
    libraries: Sequence[str] = LIBRARIES,
) -> DataFrame:
    """Long library (library, frag_len, seed, id, fragment) with ``depth`` draws per (library, length, seed)."""
    freq = stage(fragment_freq(sequences, column, frag_lens))
    parts = []
    if "Deduplicated" in libraries:
        parts.append(sample_deduplicated(freq, frag_lens, seeds, depth))
    if "Weighted" in libraries:
        parts.append(sample_weighted(freq, frag_lens, seeds, depth))
    if "Mock" in libraries:
        parts.append(sample_mock(sequences.sparkSession, frag_lens, seeds, depth))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def library_sample(library: DataFrame, depth: int) -> DataFrame:
    """``depth`` fragments per (library, frag_len, seed) without replacement, in seeded-hash order."""
    ranked = hash_rank(library, F.col("seed"), ["library", "frag_len", "id"], ["library", "frag_len", "seed"])
    return ranked.where(F.col("rank") <= depth).drop("rank", "size")


def library_wide(library: DataFrame, libraries, frag_lens, seeds) -> DataFrame:
    """Export view: one row per id, one ``<library>_<len>_<seed>`` column per sample."""
    names = [f"{l}_{n}_{s}" for l in libraries for n in frag_lens for s in seeds]
    key = F.concat_ws("_", "library", F.col("frag_len").cast("string"), F.col("seed").cast("string"))
    return library.withColumn("_key", key).groupBy("id").pivot("_key", names).agg(F.first("fragment"))
