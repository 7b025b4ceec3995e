import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from epigrain.functions import factors, moments
from epigrain.operators import selection, single_receptor


@pytest.mark.parametrize("shift", [0.0, 1e4, 1e8])
def test_shifted_regressors_keep_their_slopes(spark, shift):
    rng = np.random.default_rng(7)
    z = rng.normal(size=(2000, 2))
    y = 2 * z[:, 0] - z[:, 1] + 0.3 * rng.normal(size=2000)
    x = z + shift
    seen = x - shift  # what is left of the digits
    want = np.linalg.lstsq(np.column_stack([np.ones(2000), seen]), y, rcond=None)[0]
    df = spark.createDataFrame([(float(v), *map(float, r)) for v, r in zip(y, x)], "y double, a double, b double").repartition(40)
    for stepwise in (False, True):
        model = single_receptor.fit_linear(df, "y", ["a", "b"], stepwise)
        assert model.coefficients == pytest.approx(want[1:].tolist(), rel=1e-9)
        assert model.vif["a"] == pytest.approx(1 / (1 - np.corrcoef(z.T)[0, 1] ** 2), rel=1e-6)
    fitted = df.select((model.prediction() - F.col("y")).alias("e")).agg(F.sum(F.col("e") * F.col("e"))).first()[0]
    assert fitted == pytest.approx(model.rss, rel=1e-6)


def test_regressions_of_odd_tables(spark):
    rows = [(1.0, 2.0, 4.0), (2.0, 3.0, 6.0), (None, 1.0, 2.0), (3.0, float("nan"), 1.0), (4.0, 5.0, 10.0), (4.5, 7.0, 14.0)]
    df = spark.createDataFrame(rows, "y double, a double, twice double")
    model = single_receptor.fit_linear(df, "y", ["a", "twice"], stepwise=False)
    got = df.where("y IS NOT NULL AND NOT isnan(a)").select(model.prediction().alias("p"), "a", "y").toPandas()
    best = np.polyval(np.polyfit(got.a, got.y, 1), got.a)
    assert model.n == 4 and got.p.to_numpy() == pytest.approx(best)
    none = single_receptor.fit_linear(df.limit(0), "y", ["a"])
    assert none.n == 0 and none.coefficients == [0.0]


def test_triangle_is_that_of_the_whole_table(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(5000, 3))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double").repartition(50)
    n, r = factors.triangle(df, ["a", "b", "c"], [0.1, 0.0, 0.0])
    whole = np.column_stack([np.ones(5000), x - [0.1, 0, 0]])
    assert n == 5000 and r.T @ r == pytest.approx(whole.T @ whole)


def test_moments_and_correlations_match_numpy(spark, monkeypatch):
    monkeypatch.setattr(moments, "BLOCK", 3)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8)) + 1e6
    x[:, 7] = 5.0
    rows = [[None if k == 2 and i % 5 == 0 else float(v) for k, v in enumerate(r)] for i, r in enumerate(x)]
    names = [f"a.{k}" for k in range(8)]
    df = spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"`{n}` double" for n in names)).repartition(37)
    m = moments.column_moments(df, names, names[0])
    for k in range(8):
        seen = np.array([r[k] is not None for r in rows])
        a, b = x[seen, k], x[seen, 0]
        assert m["n"][k] == seen.sum() and m["mean"][k] == pytest.approx(a.mean()) and m["ss"][k] == pytest.approx(((a - a.mean()) ** 2).sum())
        assert m["xy"][k] == pytest.approx(((a - a.mean()) * (b - b.mean())).sum(), abs=1e-6)
    filled = np.array([[v or 0.0 for v in r] for r in rows])
    with np.errstate(invalid="ignore", divide="ignore"):
        want = np.corrcoef(filled.T)
    want[7, 7] = 1.0
    np.testing.assert_allclose(selection.correlation_matrix(df, names), want, atol=1e-9)
    assert selection.correlation_table(df, names).count() == 64


def test_thousands_of_columns_take_seconds(spark):
    names = [f"c{i}" for i in range(3000)]
    rows = [(float(np.cos(i)), *map(float, np.sin(i * np.arange(1, 3001)))) for i in range(200)]
    wide = spark.createDataFrame(rows, ["y", *names])
    start = time.perf_counter()
    out = single_receptor.univariate_regression(wide, "y", names, p_values=False)
    assert out.count() == 3000
    matrix = selection.correlation_matrix(wide, names)
    assert matrix.shape == (3000, 3000) and len(selection.correlated_features(matrix, names, 0.2)) > 0
    assert time.perf_counter() - start < 120


def naive(matrix, names, cutoff):
    """The same choice with every mean taken anew over the kept submatrix."""
    absolute = np.abs(np.nan_to_num(matrix))
    np.fill_diagonal(absolute, np.nan)
    order = np.argsort(-np.nanmean(absolute, axis=1), kind="stable")
    ranked, kept = absolute[np.ix_(order, order)], np.ones(len(names), bool)
    for i in range(len(names) - 1):
        for j in range(i + 1, len(names)):
            if not kept[i]:
                break
            if kept[j] and ranked[i, j] > cutoff:
                rest = kept & (np.arange(len(names)) != j)
                if np.nanmean(ranked[i, kept]) > np.nanmean(ranked[np.ix_(rest, kept)]):
                    kept[i] = False
                else:
                    kept[j] = False
    return [names[k] for k in order[~kept]]


def test_the_correlation_filter_makes_the_choice_of_whole_means(spark):
    rng = np.random.default_rng(3)
    for p in (1, 2, 12, 64):
        for mix in (0.2, 0.8):
            x = rng.normal(size=(60, p)) + mix * rng.normal(size=(60, 1)) * rng.integers(0, 2, p)
            matrix = np.atleast_2d(np.corrcoef(x.T))
            for cutoff in (0.1, 0.3, 0.6):
                names = [f"f{k}" for k in range(p)]
                assert selection.correlated_features(matrix, names, cutoff) == naive(matrix, names, cutoff)
