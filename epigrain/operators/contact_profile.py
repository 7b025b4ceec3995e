"""Contact-potential profiling: score every peptide against a fragment library, keep eleven statistics.

Scale values lie in [0, 1] and opening a gap costs 100, so for fragments no longer than the peptide the
best placement never has a gap: the score is the maximum over offsets of the summed residue contacts.

Plan: the sampled library holds at most lengths x seeds x libraries x ``depth`` rows, all of them parameters, so it has a size
bound that does not depend on the data and travels to the executors once.  Peptides are then profiled, averaged over seeds and
laid out wide inside one narrow Arrow-batched stage: no peptide-by-fragment row is ever written or shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.alphabet import AMINO_ACIDS
from ..functions.distribution import MAD_SCALE, TRIM
from ..functions.names import CPP, CPP_STATS, FeatureName, base_scale
from ..session import spread
from ..sources.features_io import resume
from .fragments import library_sample

MAX_SCALES = 2_000
# Scores worked on at once, and the spread below which scores count as equal.
CELLS = 1_000_000
CONSTANT_SPREAD = 1e-12

_CODE = np.full(256, 255, dtype=np.uint8)
for _i, _a in enumerate(AMINO_ACIDS):
    _CODE[ord(_a)] = _i


def encode(sequence: str) -> np.ndarray:
    codes = _CODE[np.frombuffer(sequence.encode("latin-1", "replace"), dtype=np.uint8)]
    if codes.size and codes.max() == 255:
        raise ValueError(f"not a standard amino-acid sequence: {sequence!r}")
    return codes


def scale_matrices(scales: DataFrame, ids: Iterable[str] | None = None) -> dict[str, np.ndarray]:
    """Contact scales (aaindex_id, aa1, aa2, value) as 20 x 20 matrices; 400 rows per scale."""
    if ids is not None:
        scales = scales.where(F.col("aaindex_id").isin(list(ids)))
    rows = scales.select("aaindex_id", "aa1", "aa2", "value").limit(400 * MAX_SCALES + 1).collect()
    if len(rows) > 400 * MAX_SCALES:
        raise ValueError("too many contact scales")
    out: dict[str, np.ndarray] = {}
    for name, a, b, value in rows:
        out.setdefault(name, np.full((20, 20), np.nan))[AMINO_ACIDS.index(a), AMINO_ACIDS.index(b)] = value
    return dict(sorted(out.items()))


def expand_scale_ids(ids: Iterable[str], available: Iterable[str]) -> list[str]:
    """Requested scales plus the inverse of each; ``Xinv`` does not bring ``X`` along."""
    wanted = {i for s in ids for i in (s, s if s.endswith("inv") else s + "inv")}
    return sorted(wanted & set(available))


def parameter_pairs(feature_set: Iterable[str]) -> list[tuple[str, int]]:
    """Distinct (scale, window length) pairs that a feature list needs."""
    decoded = [FeatureName.decode(f) for f in feature_set]
    return sorted({(d.subject, d.frag_len) for d in decoded if d is not None and d.family == CPP})


def gapless_scores(peptides: np.ndarray, fragments: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Best gap-free placement: peptides (n, L) and fragments (u, w) as codes -> scores (n, u)."""
    width = fragments.shape[1]
    offsets = peptides.shape[1] - width + 1
    table = matrix[:, peptides]
    n = len(peptides)
    total = None
    for j in range(0, width - 1, 2):
        # Two residues at a time: a 400-row table replaces two gathers by one.
        pair = table[:, None, :, j : j + offsets] + table[None, :, :, j + 1 : j + 1 + offsets]
        part = pair.reshape(400, n, offsets)[fragments[:, j].astype(np.intp) * 20 + fragments[:, j + 1]]
        total = part if total is None else total + part
    if width % 2:
        part = table[:, :, width - 1 : width - 1 + offsets][fragments[:, width - 1]]
        total = part if total is None else total + part
    return total.max(axis=2).T


def sorted_quantile(x: np.ndarray, p: float) -> np.ndarray:
    """Interpolated quantile along the last axis of sorted rows."""
    h = (x.shape[-1] - 1) * p
    low = int(h)
    high = min(low + 1, x.shape[-1] - 1)
    return x[..., low] + (x[..., high] - x[..., low]) * (h - low)


def sample_moments(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """mean, sd (n-1), skewness and excess kurtosis (n-1 deviation) along the last axis.

    A row whose values agree to rounding has deviation 0 and no skewness or kurtosis.
    """
    n = x.shape[-1]
    mean = x.mean(axis=-1)
    d = x - mean[..., None]
    d2 = d * d
    with np.errstate(divide="ignore", invalid="ignore"):
        sd = np.sqrt(d2.sum(axis=-1) / (n - 1)) if n > 1 else np.full(mean.shape, np.nan)
        constant = np.ptp(x, axis=-1) <= CONSTANT_SPREAD
        sd = np.where(constant & (n > 1), 0.0, sd)
        skew = np.where(constant, np.nan, (d2 * d).mean(axis=-1) / sd**3)
        kurt = np.where(constant, np.nan, (d2 * d2).mean(axis=-1) / sd**4 - 3.0)
    return mean, sd, skew, kurt


def describe_rows(x: np.ndarray) -> np.ndarray:
    """The statistics of ``CPP_STATS`` for each row of scores: (n, depth) -> (n, 11)."""
    n = x.shape[-1]
    mean, sd, skew, kurt = sample_moments(x)
    x = np.sort(x, axis=-1)
    median = sorted_quantile(x, 0.5)
    cut = int(n * TRIM)
    deviation = np.sort(np.abs(x - median[..., None]), axis=-1)
    return np.stack(
        [
            mean,
            sd,
            median,
            x[..., cut : n - cut].mean(axis=-1),
            MAD_SCALE * sorted_quantile(deviation, 0.5),
            skew,
            kurt,
            sd / np.sqrt(n),
            sorted_quantile(x, 0.75) - sorted_quantile(x, 0.25),
            sorted_quantile(x, 0.1),
            sorted_quantile(x, 0.9),
        ],
        axis=-1,
    )


class SampledLibrary:
    """Distinct fragments per length, and which of them each (library, seed) sample drew."""

    def __init__(self, rows: Iterable[tuple[str, int, int, str]]):
        drawn: dict[int, dict[tuple[str, int], list[str]]] = {}
        for library, frag_len, seed, fragment in rows:
            drawn.setdefault(frag_len, {}).setdefault((library, seed), []).append(fragment)
        self.codes: dict[int, np.ndarray] = {}
        self.draws: dict[int, dict[tuple[str, int], np.ndarray]] = {}
        for frag_len, groups in drawn.items():
            joined = np.frombuffer("".join(f for g in groups.values() for f in g).encode("ascii"), dtype=np.uint8)
            unique, where = np.unique(_CODE[joined].reshape(-1, frag_len), axis=0, return_inverse=True)
            stops = np.cumsum([len(g) for g in groups.values()])
            self.codes[frag_len] = unique
            self.draws[frag_len] = dict(sorted(zip(groups, np.split(where.ravel(), stops[:-1]))))

    def profile(self, sequences: pd.Series, pairs: Sequence[tuple[str, int]], matrices: dict[str, np.ndarray]):
        """Yield (rows, scale, frag_len, library, seed, stats): peptides of one length are scored together."""
        for length, rows in sequences.groupby(sequences.str.len()).indices.items():
            codes = np.stack([encode(s) for s in sequences.to_numpy()[rows]])
            for scale, frag_len in pairs:
                if frag_len > length or frag_len not in self.codes:
                    continue
                fragments, draws = self.codes[frag_len], self.draws[frag_len]
                deepest = max(len(d) for d in draws.values())
                step = max(1, CELLS // max(len(fragments) * (length - frag_len + 1), deepest))
                for start in range(0, len(rows), step):
                    scores = gapless_scores(codes[start : start + step], fragments, matrices[scale])
                    for (library, seed), drawn in draws.items():
                        yield rows[start : start + step], scale, frag_len, library, seed, describe_rows(scores[:, drawn])


def _prepare(library, scales, depth, libraries, seeds, scale_ids, frag_lens, feature_set):
    """Prune the parameter grid first, then sample only the fragments it needs."""
    if feature_set is not None:
        pairs = parameter_pairs(feature_set)
        matrices = scale_matrices(scales, {s for s, _ in pairs})
        pairs = [(s, n) for s, n in pairs if s in matrices]
    else:
        if scale_ids == "all":
            matrices = scale_matrices(scales)
        else:
            candidates = {i for s in scale_ids for i in (s, base_scale(s) + "inv")}
            matrices = scale_matrices(scales, candidates)
            matrices = {k: matrices[k] for k in expand_scale_ids(scale_ids, matrices)}
        pairs = [(s, n) for s in matrices for n in sorted(set(frag_lens))]
    needed = library.where(F.col("frag_len").isin(sorted({n for _, n in pairs})))
    if libraries is not None:
        needed = needed.where(F.col("library").isin(list(libraries)))
    if seeds is not None:
        needed = needed.where(F.col("seed").isin(list(seeds)))
    return pairs, matrices, library_sample(needed, depth)


def _collect_library(sample: DataFrame) -> SampledLibrary:
    """The sampled rows; their number is bounded by the sampling parameters."""
    return SampledLibrary(zip(*sample.select("library", "frag_len", "seed", "fragment").toArrow().to_pydict().values()))


STAT_SCHEMA = T.StructType(
    [
        T.StructField("peptide", T.StringType()),
        T.StructField("aaindex_id", T.StringType()),
        T.StructField("frag_len", T.IntegerType()),
        T.StructField("frag_depth", T.IntegerType()),
        T.StructField("library", T.StringType()),
        T.StructField("seed", T.IntegerType()),
        *[T.StructField(s, T.DoubleType()) for s in CPP_STATS],
    ]
)


def cpp_stats(
    peptides: DataFrame,
    library: DataFrame,
    scales: DataFrame,
    depth: int = 10_000,
    scale_ids: Sequence[str] | str = "all",
    frag_lens: Iterable[int] = range(3, 9),
    libraries: Sequence[str] | None = None,
    seeds: Sequence[int] | None = None,
    feature_set: Iterable[str] | None = None,
) -> DataFrame:
    """Eleven statistics per (peptide, scale, length, library, seed)."""
    pairs, matrices, sample = _prepare(library, scales, depth, libraries, seeds, scale_ids, frag_lens, feature_set)
    shared = peptides.sparkSession.sparkContext.broadcast((_collect_library(sample), matrices))

    def run(batches):
        lib, mats = shared.value
        for pdf in batches:
            sequences = pdf["peptide"]
            for rows, scale, n, name, seed, stats in lib.profile(sequences, pairs, mats):
                head = {"peptide": sequences.to_numpy()[rows], "aaindex_id": scale, "frag_len": n, "frag_depth": depth,
                        "library": name, "seed": seed}
                yield pd.DataFrame({**head, **{s: stats[:, i] for i, s in enumerate(CPP_STATS)}})

    long = spread(peptides.select("peptide"), "peptide").mapInPandas(run, STAT_SCHEMA)
    stats = [F.when(~F.isnan(s), F.col(s)).alias(s) for s in CPP_STATS]
    return long.select(*[c for c in long.columns if c not in CPP_STATS], *stats)


def cpp_feature_names(pairs: Iterable[tuple[str, int]], feature_set: Iterable[str] | None = None) -> list[str]:
    names = [FeatureName(CPP, s, stat, n).encode() for s, n in pairs for stat in CPP_STATS]
    if feature_set is not None:
        keep = set(feature_set)
        names = [n for n in names if n in keep]
    return sorted(names)


def cpp_features(
    peptides: DataFrame,
    library: DataFrame,
    scales: DataFrame,
    depth: int = 10_000,
    scale_ids: Sequence[str] | str = "all",
    frag_lens: Iterable[int] = range(3, 9),
    libraries: Sequence[str] | None = None,
    seeds: Sequence[int] | None = None,
    feature_set: Sequence[str] | None = None,
) -> DataFrame:
    """Wide table (peptide, frag_depth, library, CPP_*): statistics averaged over seeds.

    The average and the wide layout are made where the peptide is scored, so the melt, grouped mean
    and pivot that follow a long table are not needed and nothing is shuffled after scoring.
    """
    pairs, matrices, sample = _prepare(library, scales, depth, libraries, seeds, scale_ids, frag_lens, feature_set)
    names = cpp_feature_names(pairs, feature_set)
    slot = {name: i for i, name in enumerate(names)}
    shared = peptides.sparkSession.sparkContext.broadcast((_collect_library(sample), matrices))
    step = max(1, CELLS // max(1, len(names)))

    def run(batches):
        lib, mats = shared.value
        for sequences in (pdf["peptide"].iloc[i : i + step] for pdf in batches for i in range(0, len(pdf), step)):
            sums: dict[str, np.ndarray] = {}
            seen: dict[str, np.ndarray] = {}
            for rows, scale, n, name, _seed, stats in lib.profile(sequences, pairs, mats):
                total = sums.setdefault(name, np.zeros((len(sequences), len(names))))
                count = seen.setdefault(name, np.zeros((len(sequences), len(names)), dtype=np.int32))
                for i, stat in enumerate(CPP_STATS):
                    k = slot.get(f"{CPP}_{scale}_{stat}_{n}")
                    if k is not None:
                        total[rows, k] += stats[:, i]
                        count[rows, k] += 1
            for name, total in sorted(sums.items()):
                with np.errstate(divide="ignore", invalid="ignore"):
                    yield pd.DataFrame(
                        {"peptide": sequences, "library": name, "values": list(total / seen[name])}
                    )

    packed = spread(peptides.select("peptide"), "peptide").mapInPandas(
        run, "peptide string, library string, values array<double>"
    )
    value = F.col("values")
    return packed.select(
        "peptide",
        F.lit(depth).alias("frag_depth"),
        "library",
        *[F.when(~F.isnan(value[i]), value[i]).alias(name) for i, name in enumerate(names)],
    )


def cpp_features_resumed(peptides: DataFrame, library: DataFrame, scales: DataFrame, folder: str, seeds: Sequence[int], **options) -> DataFrame:
    """As :func:`cpp_features`, keeping what each seed adds to the averages below ``folder``.

    A seed's state is additive: per (peptide, library) the sum and the number of its values for every column. Seeds whose state is
    there are not scored again, so a run that was cut short, or one with further seeds, scores only what is missing. The state is keyed
    by the options and by a digest of the peptides, of the scales and of each seed's own part of the library: other input never picks
    it up.
    """
    spark = peptides.sparkSession

    def digest(df: DataFrame, *columns: str) -> str:
        row = df.select(F.xxhash64(*columns).alias("h"))
        return str(tuple(row.agg(F.count("h"), F.bit_xor("h"), F.sum(F.expr("cast(h AS decimal(38, 0))"))).first()))

    common = {"peptides": digest(peptides, "peptide"), "scales": digest(scales, "aaindex_id", "aa1", "aa2", "value"), **options}

    def one(seed: int) -> DataFrame:
        wide = cpp_features(peptides, library, scales, seeds=[seed], **options)
        names = wide.columns[3:]
        sums = F.array(*[F.coalesce(F.col(f"`{n}`"), F.lit(0.0)) for n in names])
        counts = F.array(*[F.col(f"`{n}`").isNotNull().cast("int") for n in names])
        return wide.select("peptide", "frag_depth", "library", sums.alias("sums"), counts.alias("counts"), F.array(*map(F.lit, names)).alias("names"))

    parts = None
    for seed in seeds:
        own = digest(library.where(F.col("seed") == seed), "library", "frag_len", "id", "fragment")
        part = resume(spark, folder, "cpp-seed", lambda s=seed: one(s), seed=seed, library=own, **common)
        parts = part if parts is None else parts.unionByName(part)
    head = parts.select("names").first()
    names = head.names if head else []
    columns = [F.try_divide(F.sum(F.col("sums")[i]), F.sum(F.col("counts")[i])).alias(n) for i, n in enumerate(names)]
    if not names:
        return parts.select("peptide", "frag_depth", "library")
    return parts.groupBy("peptide", "frag_depth", "library").agg(*columns)
