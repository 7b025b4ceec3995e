"""Single receptor-peptide profiles and their regressions on binding energy."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.factors import least_squares, triangle
from ..functions.moments import column_moments
from ..functions.names import SINGLE_CPP, SINGLE_CPP_STATS, FeatureName
from ..functions.ordered import quantile_terms, running_totals
from ..functions.special import f_upper_tail, f_upper_tail_array
from ..session import spread, stage
from .contact_profile import encode, sample_moments, scale_matrices
from .relational import keep_first

# Fixed value: scales used when none are named.
DEFAULT_SCALES = (
    "BETM990101inv",
    "KESO980102inv",
    "KOLA930101",
    "MICC010101",
    "SIMK990104",
    "VENM980101",
    "VENM980101inv",
)


#: Pairs that are profiled together at most.
PAIRS_AT_ONCE = 2_048


def _encode_equal(strings: pa.Array, length: int) -> np.ndarray:
    """Codes of standard-residue sequences of one length: (n, length)."""
    listed = strings.to_pylist()
    try:
        codes = encode("".join(listed))
    except ValueError:
        for sequence in listed:  # names the one that is not standard
            encode(sequence)
        raise
    return codes.astype(np.intp).reshape(len(listed), length)


def _pair_stats(peptides: pa.Array, receptors: pa.Array, lens, matrices):
    """Yield (rows, frag_len, scale, stats (n, 6)); pairs with equal lengths are profiled together.

    The contacts of every residue of the receptor with every residue of the peptide are looked up once per scale. A fragment's score at an
    offset is the sum along a diagonal of that table, and of the reversed fragment along a diagonal the other way.
    """
    sizes = [pc.fill_null(pc.utf8_length(a), -1).to_numpy(zero_copy_only=False) for a in (peptides, receptors)]
    for p_len, t_len in sorted(set(zip(*(s.tolist() for s in sizes)))):
        if min(p_len, t_len) < 0:
            continue  # nothing to profile
        alike = np.flatnonzero((sizes[0] == p_len) & (sizes[1] == t_len))
        for rows in (alike[i : i + PAIRS_AT_ONCE] for i in range(0, len(alike), PAIRS_AT_ONCE)):
            target = _encode_equal(peptides.take(pa.array(rows)), p_len)
            source = _encode_equal(receptors.take(pa.array(rows)), t_len)
            for scale, matrix in matrices.items():
                # pairs lie last, so that every step runs along them
                contact = np.ascontiguousarray(matrix[source.T[:, None], target.T[None]])
                for n in lens:
                    # A window wider than the receptor shrinks to the receptor.
                    width = min(n, t_len)
                    if width == 0 or width > p_len:
                        continue
                    starts, offsets = t_len - width + 1, p_len - width + 1
                    best = np.empty((2 * starts, len(rows)))
                    for way, steps in enumerate((range(width), range(width - 1, -1, -1))):
                        placed = sum(contact[i : i + starts, j : j + offsets] for j, i in enumerate(steps))
                        placed.max(axis=1, out=best[way * starts : (way + 1) * starts])
                    best = np.ascontiguousarray(best.T)
                    mean, sd, skew, kurt = sample_moments(best)
                    yield rows, n, scale, np.stack([best.max(axis=1), best.min(axis=1), mean, sd, skew, kurt], axis=1)


def scpp_stats(
    pairs: DataFrame, scales: DataFrame, scale_ids: Sequence[str] | None = DEFAULT_SCALES, frag_lens: Iterable[int] = range(3, 9)
) -> DataFrame:
    """Six statistics per (peptide, cdr3b, scale, length); each pair is profiled where its row is."""
    matrices = scale_matrices(scales, scale_ids)
    lens = sorted(set(frag_lens))

    def run(batches):
        for batch in batches:
            for rows, n, scale, stats in _pair_stats(batch.column(0), batch.column(1), lens, matrices):
                own, k = pa.array(rows), len(rows)
                head = [batch.column(0).take(own), batch.column(1).take(own), pa.array([scale]).take(pa.array(np.zeros(k, int))), pa.array(np.full(k, n, np.int32))]
                yield pa.RecordBatch.from_arrays([*head, *(pa.array(s) for s in stats.T.copy())], names)

    schema = "peptide string, cdr3b string, aaindex_id string, frag_len int, " + ", ".join(
        f"{s} double" for s in SINGLE_CPP_STATS
    )
    names = [c.split()[0] for c in schema.split(", ")]
    long = spread(pairs.select("peptide", "cdr3b"), "peptide", "cdr3b").mapInArrow(run, schema)
    return long.select(
        *long.columns[:4], *[F.when(~F.isnan(s), F.col(s)).alias(s) for s in SINGLE_CPP_STATS]
    )


def scpp_features(
    pairs: DataFrame, scales: DataFrame, scale_ids: Sequence[str] | None = DEFAULT_SCALES, frag_lens: Iterable[int] = range(3, 9)
) -> DataFrame:
    """Wide table (peptide, cdr3b, sCPP_*), laid out in the task that profiles the pair."""
    matrices = scale_matrices(scales, scale_ids)
    lens = sorted(set(frag_lens))
    names = sorted(FeatureName(SINGLE_CPP, s, t, n).encode() for s in matrices for t in SINGLE_CPP_STATS for n in lens)
    slot = {name: i for i, name in enumerate(names)}

    def run(batches):
        for batch in batches:
            values = np.full((batch.num_rows, len(names)), np.nan)
            for rows, n, scale, stats in _pair_stats(batch.column(0), batch.column(1), lens, matrices):
                for i, stat in enumerate(SINGLE_CPP_STATS):
                    values[rows, slot[f"{SINGLE_CPP}_{scale}_{stat}_{n}"]] = stats[:, i]
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(names))
            packed = pa.ListArray.from_arrays(ends, pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed], ["peptide", "cdr3b", "values"])

    packed = spread(pairs.select("peptide", "cdr3b").distinct(), "peptide", "cdr3b").mapInArrow(
        run, "peptide string, cdr3b string, values array<double>"
    )
    value = F.col("values")
    return packed.select(
        "peptide", "cdr3b", *[F.when(~F.isnan(value[i]), value[i]).alias(n) for i, n in enumerate(names)]
    )


# --- regressions ------------------------------------------------------------------------------------------


def univariate_regression(df: DataFrame, response: str, features: Sequence[str], p_values: bool = True) -> DataFrame:
    """Adjusted R squared, F statistic and p-value of one simple regression per feature.

    The moments of all features are taken together, whatever their number; a feature without spread has no statistics.
    """
    names = list(features)
    m = column_moments(df, names, response)
    with np.errstate(divide="ignore", invalid="ignore"):
        r2 = m["xy"] ** 2 / (m["ss"] * m["ss_y"])
    rows = [(name, float(x) if x == x else None, int(n)) for name, x, n in zip(names, r2, m["n"])]
    rows = df.sparkSession.createDataFrame(rows, "feature string, r2 double, n long")
    n, r2 = F.col("n"), F.col("r2")
    out = rows.select(
        "feature",
        F.when(F.split("feature", "_")[0] == SINGLE_CPP, F.split("feature", "_")[1]).alias("aaindex_id"),
        "n",
        (1 - (1 - r2) * (n - 1) / F.when(n > 2, n - 2)).alias("adj_r_sq"),
        (r2 * F.when(n > 2, n - 2) / F.when(r2 < 1, 1 - r2)).alias("f_stat"),
    )
    if not p_values:
        return out
    tail = f_upper_tail(F.col("f_stat"), F.lit(1.0), (F.col("n") - 2).cast("double"))
    return out.withColumn("p_value", F.when(F.col("f_stat").isNotNull(), tail)).orderBy(
        F.asc_nulls_last("p_value"), "feature"
    )


def univariate_select(
    table: DataFrame, scale_ids: Sequence[str], significance: float = 0.05, best_only: bool = True
) -> DataFrame:
    """Significant features of the named scales; by default only the best one per scale."""
    kept = table.where(F.col("p_value") < significance)
    if best_only:
        kept = keep_first(kept, ["aaindex_id"], ["p_value", "feature"])
    return kept.where(F.col("aaindex_id").isin(list(scale_ids))).orderBy("p_value", "feature")


def univariate_plot_data(df: DataFrame, response: str, feature: str, outliers: DataFrame | None = None):
    """Scatter points (with outliers marked), and the fit shown on the chart."""
    columns = [F.col(response), F.col(f"`{feature}`")]
    points = df.select(*columns, F.lit(False).alias("outlier"))
    if outliers is not None:
        points = points.unionByName(outliers.select(*columns, F.lit(True).alias("outlier")))
    return points, univariate_regression(df, response, [feature])


@dataclass
class LinearModel:
    """Ordinary least squares solved from a triangular factor of the centred columns."""

    response: str
    variables: list[str]
    intercept: float
    coefficients: list[float]
    n: int
    rss: float
    adj_r_sq: float
    p_value: float
    vif: dict[str, float]
    centres: list[float]
    level: float  #: prediction at the centres

    def prediction(self) -> Column:
        """From the centres, so that no digits are lost where variables lie far from zero."""
        out = F.lit(float(self.level))
        for name, beta, centre in zip(self.variables, self.coefficients, self.centres):
            out = out + (F.col(f"`{name}`") - F.lit(float(centre))) * F.lit(float(beta))
        return out


def _aic(n: float, rss: float, params: int) -> float:
    return n * math.log(max(rss, 1e-300) / n) + 2 * params


def fit_linear(df: DataFrame, response: str, variables: Sequence[str], stepwise: bool = True) -> LinearModel:
    """Least squares, by default with two-way stepwise selection by AIC starting from the full model.

    Columns are centred on their means and reduced to a triangular factor by a tree of tasks; selection steps on that factor. Rows in
    which a column is null or NaN are left out. Without any complete row the coefficients are zero and the statistics NaN.
    """
    variables = list(variables)
    columns = [*variables, response]
    known = [F.when(F.isnan(c), None).otherwise(c) for c in (F.col(f"`{c}`").cast("double") for c in columns)]
    complete = df.where(reduce(and_, [c.isNotNull() for c in known]))
    centres = [m or 0.0 for m in complete.agg(*[F.avg(c) for c in known]).first()]
    n, r = triangle(complete, columns, centres)
    chosen = list(range(len(variables)))
    beta, rss = least_squares(r, chosen)
    while stepwise and n:
        current = _aic(n, rss, len(chosen) + 1)
        moves = [[c for c in chosen if c != d] for d in chosen]
        moves += [sorted([*chosen, a]) for a in range(len(variables)) if a not in chosen]
        trials = [(_aic(n, least_squares(r, m)[1], len(m) + 1), m) for m in moves]
        if not trials or min(trials)[0] >= current - 1e-9:
            break
        chosen = min(trials)[1]
        beta, rss = least_squares(r, chosen)
    k = len(chosen)
    tss = least_squares(r, [])[1]
    r2 = 1 - rss / tss if tss > 0 else float("nan")
    free = n - k - 1
    adjusted = 1 - (1 - r2) * (n - 1) / free if free > 0 else float("nan")
    f_stat = (r2 / k) / ((1 - r2) / free) if k and free > 0 and r2 < 1 else float("inf")
    p = float(f_upper_tail_array(f_stat, k, free)) if k and free > 0 else float("nan")
    # without the ones, the factor of the chosen columns is that of their centred values
    own = np.linalg.qr(r[:, [0, *[c + 1 for c in chosen]]], mode="r")[1 : k + 1, 1:]
    length = np.linalg.norm(own, axis=0)
    scaled = own / np.where(length > 0, length, 1)
    inverse = np.linalg.pinv(scaled.T @ scaled) if k else np.zeros((0, 0))
    names = [variables[c] for c in chosen]
    intercept = beta[0] + centres[-1] - sum(b * centres[c] for b, c in zip(beta[1:], chosen))
    return LinearModel(
        response, names, float(intercept), [float(b) for b in beta[1:]], n, rss, adjusted, p,
        {name: float(inverse[i, i]) for i, name in enumerate(names)}, [centres[c] for c in chosen], float(beta[0] + centres[-1]),
    )


def multivariate_prediction(
    df: DataFrame, response: str, variables: Sequence[str], new: DataFrame | None = None
) -> DataFrame:
    """Rows of ``new`` (or ``df``) with the stepwise model's prediction."""
    model = fit_linear(df, response, variables)
    return (df if new is None else new).withColumn("prediction", model.prediction())


def multivariate_plot_data(
    df: DataFrame, response: str, variables: Sequence[str], outliers: DataFrame | None = None
) -> tuple[DataFrame, LinearModel]:
    """Observed against predicted values with their type, and the model (fit statistics, VIF)."""
    model = fit_linear(df, response, variables)
    rows = df.withColumn("type", F.lit("MVR"))
    if outliers is not None:
        rows = rows.unionByName(outliers.withColumn("type", F.lit("Outlier")), allowMissingColumns=True)
    return rows.withColumn("prediction", model.prediction()), model


# --- contact footprints -----------------------------------------------------------------------------------


def _footprint(column: str) -> Column:
    return F.transform(F.split(F.col(column), "\\|"), lambda s: s.try_cast("double"))


def footprint_sites(df: DataFrame, column: str = "weights", times: str | None = None) -> DataFrame:
    """(position, copies): contact sites relative to the weighted centre of each footprint, which counts ``times`` (once if not given)."""
    w = F.col("_w")
    often = F.lit(1) if times is None else F.col(times)
    usable = df.select(_footprint(column).alias("_w"), often.alias("_times")).where(~F.exists(w, lambda x: x.isNull()))
    total = F.aggregate(w, F.lit(0.0), lambda a, x: a + x)
    moment = F.aggregate(
        F.transform(w, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x
    )
    centred = usable.select("_w", "_times", (moment / F.when(total != 0, total)).alias("_c"))
    return centred.select("_c", "_times", F.posexplode("_w").alias("_i", "_x")).select(
        (F.col("_i") + 1 - F.col("_c")).alias("position"), (F.floor("_x") * F.col("_times")).alias("copies")
    ).where((F.col("copies") > 0) & F.col("position").isNotNull())


def contact_footprint(df: DataFrame, column: str = "weights") -> DataFrame:
    """Percent of contact mass within one site of the centre, within two (beyond one), and farther."""
    sites = footprint_sites(df, column)

    def share(limit: float) -> Column:
        inside = F.sum(F.when(F.abs("position") <= limit, F.col("copies")).otherwise(0))
        return inside / F.sum("copies") * 100

    one, two = share(1.0), share(2.0)
    return sites.agg(one.alias("within_1"), (two - one).alias("within_2"), (100 - two).alias("beyond_2"))


def footprint_density(df: DataFrame, column: str = "weights", points: int = 512) -> DataFrame:
    """Gaussian kernel density of the contact sites on an even grid (bandwidth by the usual rule of thumb).

    Equal footprints are taken apart once, and the sites are written, for they are read four times. Each task adds up the kernel over its
    own sites; only one partial sum per grid point is shuffled.
    """
    different = df.groupBy(column).agg(F.count("*").alias("_n"))
    sites = stage(footprint_sites(different, column, "_n").groupBy("position").agg(F.sum("copies").alias("copies")))
    row = sites.agg(
        F.sum("copies").alias("n"),
        F.sum(F.col("copies") * F.col("position")).alias("s1"),
        F.sum(F.col("copies") * F.col("position") * F.col("position")).alias("s2"),
        F.min("position").alias("lo"),
        F.max("position").alias("hi"),
    ).first()
    n = row["n"]
    sd = math.sqrt(max(row["s2"] - row["s1"] ** 2 / n, 0.0) / max(n - 1, 1))
    quartiles = _weighted_quartiles(sites)
    width = min(sd, (quartiles[1] - quartiles[0]) / 1.34) or sd or abs(row["lo"]) or 1.0
    bandwidth = 0.9 * width * n ** -0.2
    grid = np.linspace(row["lo"] - 3 * bandwidth, row["hi"] + 3 * bandwidth, points)

    def run(batches):
        total = np.zeros(points)
        for pdf in batches:
            x, c = pdf["position"].to_numpy(float), pdf["copies"].to_numpy(float)
            for start in range(0, len(x), 4096):
                z = (grid[None, :] - x[start : start + 4096, None]) / bandwidth
                total += (np.exp(-0.5 * z * z) * c[start : start + 4096, None]).sum(axis=0)
        yield pd.DataFrame({"point": np.arange(points), "x": grid, "mass": total})

    partial = spread(sites, "position").mapInPandas(run, "point int, x double, mass double")
    return partial.groupBy("point", "x").agg(
        (F.sum("mass") / F.lit(n * bandwidth * math.sqrt(2 * math.pi))).alias("y")
    )


def _weighted_quartiles(sites: DataFrame) -> tuple[float, float]:
    counts = sites.select("position", F.col("copies").alias("n"))
    terms = quantile_terms("position", {"a": 0.25, "b": 0.75})
    row = running_totals(counts, [], "position", ["n"]).agg(terms["a"].alias("a"), terms["b"].alias("b")).first()
    return row["a"], row["b"]
