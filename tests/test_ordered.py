import numpy as np
import pytest
from pyspark.sql import functions as F

from epigrain.functions import ordered
from epigrain.functions.distribution import distribution_stats
from epigrain.functions.hashing import seeded_hash
from epigrain.operators.contact_profile import CPP_STATS, describe_rows


@pytest.fixture(scope="module")
def skewed(spark):
    """Two thirds of all rows in one group, many ties, a one-row group and a NULL group."""
    rng = np.random.default_rng(0)
    rows = [("hot", float(v)) for v in rng.integers(0, 40, 600)]
    rows += [("cold", float(v)) for v in rng.normal(size=299)]
    rows += [("one", 3.0), (None, 1.0), (None, 2.0)]
    return rows, spark.createDataFrame(rows, "g string, v double").repartition(7)


def test_quantiles_match_numpy(skewed):
    rows, df = skewed
    probs = {"a": 0.1, "m": 0.5, "z": 0.9}
    for r in ordered.exact_quantiles(df, ["g"], "v", probs).collect():
        x = [v for g, v in rows if g == r["g"]]
        for name, p in probs.items():
            assert r[name] == pytest.approx(np.quantile(x, p))


def test_running_totals_without_group(skewed):
    rows, df = skewed
    counts = df.groupBy("v").agg(F.count("*").alias("n"))
    got = {r["v"]: (r["before_n"], r["total_n"]) for r in ordered.running_totals(counts, [], "v", ["n"]).collect()}
    x = np.array([v for _, v in rows])
    assert got == {v: (int((x < v).sum()), len(x)) for v in set(x)}


def test_distribution_stats(skewed):
    rows, df = skewed
    for r in distribution_stats(df, ["g"], "v").collect():
        x = np.array([[v for g, v in rows if g == r["g"]]])
        want = describe_rows(x)[0]
        for name, value in zip(CPP_STATS, want):
            if np.isnan(value):
                assert r[name] is None or np.isnan(r[name])
            else:
                assert r[name] == pytest.approx(value, abs=1e-9), name


def test_describe_rows_by_hand():
    x = np.array([[1.0, 2.0, 3.0, 4.0, 100.0, 5.0, 6.0, 7.0, 8.0, 9.0]])
    s = dict(zip(CPP_STATS, describe_rows(x)[0]))
    assert s["Med"] == 5.5 and s["TrM"] == pytest.approx(np.mean([2, 3, 4, 5, 6, 7, 8, 9]))
    assert s["MAD"] == pytest.approx(1.4826 * 2.5) and s["IQR"] == pytest.approx(7.75 - 3.25)
    d = x[0] - x.mean()
    assert s["Skew"] == pytest.approx((d**3).mean() / x[0].std(ddof=1) ** 3)
    assert s["Kurt"] == pytest.approx((d**4).mean() / x[0].std(ddof=1) ** 4 - 3)


def test_hash_rank_is_a_permutation(spark):
    df = spark.range(5000).withColumn("g", F.when(F.col("id") < 4000, "big").otherwise("small"))
    out = ordered.hash_rank(df, 3, ["id"], ["g"]).withColumn("h", seeded_hash(3, F.col("id"))).collect()
    for g, n in (("big", 4000), ("small", 1000)):
        part = sorted((r["h"], r["id"], r["rank"], r["size"]) for r in out if r["g"] == g)
        assert [p[2] for p in part] == list(range(1, n + 1)) and {p[3] for p in part} == {n}


def test_hash_is_md5_based(spark):
    import hashlib

    got = spark.range(1).select(seeded_hash(7, F.lit("ACD")).alias("h")).first()["h"]
    assert got == int(hashlib.md5(b"7|ACD").hexdigest()[:8], 16)
