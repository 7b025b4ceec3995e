"""Queries over splits, folds, scaling, correlations, importances, scores and regressions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import scoring, selection, single_receptor
from ..operators.ingest import epitope_import
from ..session import checkpoint_dir, remove_at_end, stage
from .inputs import OBSERVATIONS_SQL, WORDS_SQL, hash_sql, observations, table, word_rows
from .registry import query, r, rnd, rounded

EPITOPES_SQL = (
    OBSERVATIONS_SQL
    + """,
epi AS (
  SELECT peptide, CASE WHEN bool_or(immunogenicity = 'Positive') THEN 'Positive' ELSE 'Negative' END AS immunogenicity,
         substr(peptide, 1, 3) AS cluster
  FROM raw WHERE regexp_full_match(peptide, '[ACDEFGHIKLMNPQRSTVWY]{8,11}') GROUP BY peptide)"""
)


def epitopes(spark, sf_dir):
    """Labelled peptides with their three leading residues as the similarity cluster."""
    rows = epitope_import(observations(spark, sf_dir))
    return rows.select("peptide", "immunogenicity", F.substring("peptide", 1, 3).alias("cluster"))


def _h(seed: int, key: str = "peptide") -> str:
    return hash_sql(f"'{seed}'", key)


@query(
    "class_weights",
    f"""WITH {EPITOPES_SQL}
SELECT immunogenicity, count(*) AS n, {r('1.0::DOUBLE / count(*)', 'weight', 12)} FROM epi GROUP BY 1""",
)
def q_class_weights(spark, sf_dir):
    return rounded(scoring.class_weights(epitopes(spark, sf_dir)), ["weight"], 12)


@query(
    "kfold_assign",
    f"""WITH {EPITOPES_SQL}
SELECT peptide, CAST(ntile(5) OVER (ORDER BY {_h(3)}, peptide) AS INTEGER) AS fold FROM epi""",
)
def q_kfold_assign(spark, sf_dir):
    return scoring.kfold_assign(stage(epitopes(spark, sf_dir).select("peptide")), 3)


@query(
    "stratified_split",
    f"""WITH {EPITOPES_SQL}
SELECT peptide, immunogenicity, CASE WHEN row_number() OVER (PARTITION BY immunogenicity ORDER BY {_h(5)}, peptide)
  <= ceil(0.8::DOUBLE * count(*) OVER (PARTITION BY immunogenicity)) THEN 'Train' ELSE 'Test' END AS data_type
FROM epi""",
)
def q_stratified_split(spark, sf_dir):
    return selection.stratified_split(stage(epitopes(spark, sf_dir).drop("cluster")), 5)


REPRESENTATIVE_SQL = f"""cls AS (SELECT immunogenicity, count(*) AS n FROM epi GROUP BY 1),
rep AS (SELECT peptide, immunogenicity, cluster FROM epi JOIN cls USING (immunogenicity)
  QUALIFY row_number() OVER (PARTITION BY cluster
    ORDER BY n, immunogenicity <> 'Negative', {_h(11)}, peptide) = 1)"""


@query("cluster_representative", f"WITH {EPITOPES_SQL}, {REPRESENTATIVE_SQL} SELECT * FROM rep")
def q_cluster_representative(spark, sf_dir):
    return selection.cluster_representative(epitopes(spark, sf_dir), 11)


@query(
    "cluster_sample",
    f"""WITH {EPITOPES_SQL}
SELECT peptide, cluster FROM epi QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY {_h(9)}, peptide) = 1""",
)
def q_cluster_sample(spark, sf_dir):
    return scoring.cluster_sample(epitopes(spark, sf_dir).select("peptide", "cluster"), 9)


@query(
    "score_summary",
    f"""SELECT l_partkey, {r('avg(l_quantity)', 'immunogenicity_score')},
       {r('stddev_samp(l_quantity) / avg(l_quantity)', 'immunogenicity_score_cv')} FROM lineitem GROUP BY l_partkey""",
)
def q_score_summary(spark, sf_dir):
    scores = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_quantity").alias("immunogenicity_score"))
    out = scoring.summarize_scores(scores, ["l_partkey"])
    return rounded(out, ["immunogenicity_score", "immunogenicity_score_cv"])


@query(
    "importance_topk",
    f"""WITH t AS (SELECT p_brand AS run, p_type AS feature, CAST(sum(p_size) AS DOUBLE) AS value FROM part GROUP BY 1, 2),
m AS (SELECT *, min(value) OVER (PARTITION BY run) AS lo, max(value) OVER (PARTITION BY run) AS hi FROM t),
k AS (SELECT run, feature, value, CASE WHEN hi = lo THEN 0.5 ELSE (value - lo) / (hi - lo) END AS importance FROM m)
SELECT run, feature, value, {r('importance', 'importance', 9)},
       CAST(row_number() OVER (PARTITION BY run ORDER BY importance DESC, feature) AS INTEGER) AS rank
FROM k QUALIFY row_number() OVER (PARTITION BY run ORDER BY k.importance DESC, feature) <= 3""",
)
def q_importance_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("run"), F.col("p_type").alias("feature")).agg(
        F.sum("p_size").cast("double").alias("value")
    )
    return rounded(selection.importance_topk(rows, ["run"], 3), ["importance"], 9)


@query(
    "feature_intersect",
    f"""WITH {WORDS_SQL}
SELECT word AS feature FROM w GROUP BY word
HAVING count(DISTINCT lang) = (SELECT count(DISTINCT lang) FROM w)""",
)
def q_feature_intersect(spark, sf_dir):
    rows = word_rows(spark, sf_dir).select(F.col("lang").alias("run"), F.col("word").alias("feature"))
    return selection.feature_sets_table(rows, "intersect")


@query("feature_union", f"WITH {WORDS_SQL} SELECT DISTINCT word AS feature FROM w")
def q_feature_union(spark, sf_dir):
    rows = word_rows(spark, sf_dir).select(F.col("lang").alias("run"), F.col("word").alias("feature"))
    return selection.feature_sets_table(rows, "union")


# --- numeric feature matrix: embeddings -------------------------------------------------------------------

N_FEATURES = 64
FEATURES = [f"f{i}" for i in range(N_FEATURES)]


def embedding_features(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(
        F.col("vec_id").cast("string").alias("peptide"),
        *[F.col("embedding")[i].cast("double").alias(f) for i, f in enumerate(FEATURES)],
    )


def embedding_metadata(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(
        F.col("vec_id").cast("string").alias("peptide"),
        F.when(F.col("label") < 5, "Positive").otherwise("Negative").alias("immunogenicity"),
        F.floor(F.col("vec_id") / 3).cast("string").alias("cluster"),
    )


_EMB_SQL = """epi AS (SELECT CAST(vec_id AS VARCHAR) AS peptide, embedding,
  CASE WHEN label < 5 THEN 'Positive' ELSE 'Negative' END AS immunogenicity,
  CAST(CAST(floor(vec_id / 3) AS BIGINT) AS VARCHAR) AS cluster FROM embeddings)"""


@query(
    "preprocess_scaled",
    f"""WITH {_EMB_SQL}, {REPRESENTATIVE_SQL},
sp AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY immunogenicity ORDER BY {_h(11)}, peptide)
  <= ceil(0.8::DOUBLE * count(*) OVER (PARTITION BY immunogenicity)) THEN 'Train' ELSE 'Test' END AS data_type FROM rep),
lng AS (SELECT data_type, sp.peptide, sp.immunogenicity, sp.cluster, i, CAST(embedding[i] AS DOUBLE) AS v
  FROM sp JOIN epi USING (peptide), (SELECT unnest(range(1, {N_FEATURES + 1})) AS i)),
m AS (SELECT i, avg(v) AS mu, stddev_samp(v) AS sd FROM lng WHERE data_type = 'Train' GROUP BY i)
SELECT data_type, peptide, immunogenicity, cluster,
  {", ".join(r(f"max((v - mu) / sd) FILTER (i = {i + 1})", f) for i, f in enumerate(FEATURES))}
FROM lng JOIN m USING (i) GROUP BY 1, 2, 3, 4""",
)
def q_preprocess_scaled(spark, sf_dir):
    prepared = selection.preprocess(embedding_features(spark, sf_dir), embedding_metadata(spark, sf_dir), 11)
    return rounded(prepared.dt, FEATURES)


@query(
    "correlation_matrix",
    f"""WITH e AS (SELECT vec_id, i, CAST(embedding[i + 1] AS DOUBLE) AS v
  FROM embeddings, (SELECT unnest(range(0, {N_FEATURES})) AS i))
SELECT 'f' || a.i AS feature1, 'f' || b.i AS feature2,
  CASE WHEN a.i = b.i THEN 1.0 ELSE {rnd('corr(a.v, b.v)')} END AS corr
FROM e a JOIN e b USING (vec_id) GROUP BY a.i, b.i""",
)
def q_correlation_matrix(spark, sf_dir):
    features = embedding_features(spark, sf_dir)
    return rounded(selection.correlation_table(features, FEATURES), ["corr"])


def _prepared(spark, sf_dir, seed=11):
    return selection.preprocess(embedding_features(spark, sf_dir), embedding_metadata(spark, sf_dir), seed)


@query("cor_filter")
def q_cor_filter(spark, sf_dir):
    return selection.cor_filter(_prepared(spark, sf_dir), 0.1).dt


@query("feature_importance")
def q_feature_importance(spark, sf_dir):
    ranked = selection.importance(_prepared(spark, sf_dir), 11, top=10, n_trees=20)
    return spark.createDataFrame(ranked.importance, "feature string, importance double")


@query("feature_select")
def q_feature_select(spark, sf_dir):
    return selection.feature_select(_prepared(spark, sf_dir), 11, top=5, n_trees=10).dt


@query("minimum_features")
def q_minimum_features(spark, sf_dir):
    tables = {("Weighted", "64"): embedding_features(spark, sf_dir)}
    chosen = selection.minimum_features(
        tables, embedding_metadata(spark, sf_dir), seeds=(1, 2), threshold=0.75, sizes=(30, 10), n_trees=10
    )
    rows = [(size, f) for size, names in chosen.items() for f in names]
    return spark.createDataFrame(rows, "size int, feature string")


#: Trees per model and seeds of the scores, as the scoring run takes them by default.
TREES, SEEDS = 500, (1, 2, 3, 4, 5)


@query("score_oof")
def q_score_oof(spark, sf_dir):
    metadata = embedding_metadata(spark, sf_dir).drop("cluster")
    return scoring.immunogenicity_score(embedding_features(spark, sf_dir), metadata, FEATURES, seeds=SEEDS, n_trees=TREES)


@query("score_cluster")
def q_score_cluster(spark, sf_dir):
    """One vector per cluster and seed is scored; the models of all seeds grow in one job."""
    metadata = embedding_metadata(spark, sf_dir)
    return scoring.immunogenicity_score_cluster(
        embedding_features(spark, sf_dir), metadata.drop("cluster"), metadata.select("peptide", "cluster"), FEATURES, seeds=SEEDS, n_trees=TREES
    )


@query("predict_external")
def q_predict_external(spark, sf_dir):
    """The trees are stored, loaded and then score every vector as an external one, by label."""
    metadata = embedding_metadata(spark, sf_dir).drop("cluster")
    path = f"{checkpoint_dir(spark)}/forest-{uuid.uuid4().hex}"
    remove_at_end(spark, path)
    scoring.train_models(embedding_features(spark, sf_dir), metadata, FEATURES, seeds=SEEDS, n_trees=TREES, path=path)
    external = table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("data"),
        F.col("vec_id").cast("string").alias("peptide"),
        *[F.col("embedding")[i].cast("double").alias(f) for i, f in enumerate(FEATURES)],
    )
    return scoring.predict_external(scoring.Forest.load(spark, path), external, "data")


# --- regressions ------------------------------------------------------------------------------------------

_PREDICTORS = ("l_quantity", "l_discount", "l_tax")


@query(
    "univariate_regression",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, CAST(NULL AS VARCHAR) AS aaindex_id, regr_count(l_extendedprice, {c}) AS n,
  {r(f'1 - (1 - regr_r2(l_extendedprice, {c})) * (count(*) - 1) / (count(*) - 2)', 'adj_r_sq')},
  {r(f'regr_r2(l_extendedprice, {c}) * (count(*) - 2) / (1 - regr_r2(l_extendedprice, {c}))', 'f_stat', 4)}
FROM lineitem"""
        for c in _PREDICTORS
    ),
)
def q_univariate_regression(spark, sf_dir):
    out = single_receptor.univariate_regression(
        table(spark, sf_dir, "lineitem"), "l_extendedprice", _PREDICTORS, p_values=False
    )
    return rounded(rounded(out, ["adj_r_sq"]), ["f_stat"], 4)


_TESTED = {"sCPP_SYN01_Mean_3": "l_quantity", "sCPP_SYN01_SD_3": "l_discount", "sCPP_SYN02_Mean_4": "l_tax"}


def _regression_table(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_extendedprice").alias("delta_g"), *[F.col(c).alias(n) for n, c in _TESTED.items()]
    )
    return single_receptor.univariate_regression(rows, "delta_g", list(_TESTED))


def _pvalues_sql() -> str:
    """Upper tails of F(1, n - 2) by Lentz's continued fraction of the incomplete beta function."""
    parts = " UNION ALL ".join(
        f"SELECT '{name}' AS feature, regr_count(l_extendedprice, {c}) AS n, regr_r2(l_extendedprice, {c}) AS r2 FROM lineitem"
        for name, c in _TESTED.items()
    )
    return f"""WITH RECURSIVE t AS ({parts}),
g AS MATERIALIZED (SELECT *, r2 * (n - 2) / (1 - r2) AS f, (n - 2) / 2.0::DOUBLE AS p, 0.5::DOUBLE AS q, 1 - r2 AS u FROM t),
h AS MATERIALIZED (SELECT *, u > (p + 1) / (p + q + 2) AS flip FROM g),
k AS MATERIALIZED (SELECT feature, n, r2, f, flip, CASE WHEN flip THEN q ELSE p END AS a, CASE WHEN flip THEN p ELSE q END AS b,
  CASE WHEN flip THEN 1 - u ELSE u END AS x FROM h),
l AS (SELECT feature, 0 AS i, 1.0::DOUBLE AS fr, 1.0::DOUBLE AS c, 0.0::DOUBLE AS d FROM k UNION ALL
  SELECT feature, i + 1, fr * ((1 + num / c) / (1 + num * d)), 1 + num / c, 1 / (1 + num * d)
  FROM (SELECT l.*, CASE WHEN i = 0 THEN 1.0::DOUBLE WHEN i % 2 = 0 THEN (i / 2) * (b - i / 2) * x / ((a + i - 1) * (a + i))
      ELSE -(a + (i - 1) / 2) * (a + b + (i - 1) / 2) * x / ((a + i - 1) * (a + i)) END AS num FROM l JOIN k USING (feature)
    WHERE i < 600)),
z AS (SELECT feature, arg_max(fr, i) AS fr FROM l GROUP BY feature),
v AS (SELECT k.*, exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * ln(x) + b * ln(1 - x)) * (fr - 1) / a AS ib FROM k JOIN z USING (feature))
SELECT feature, split_part(feature, '_', 2) AS aaindex_id, n, {r("1 - (1 - r2) * (n - 1) / (n - 2)", "adj_r_sq")}, {r("f", "f_stat", 4)},
  {r("CASE WHEN flip THEN 1 - ib ELSE ib END", "p_value", 7)} FROM v"""


@query("univariate_pvalues", _pvalues_sql())
def q_univariate_pvalues(spark, sf_dir):
    out = rounded(_regression_table(spark, sf_dir), ["adj_r_sq"])
    return rounded(rounded(out, ["f_stat"], 4), ["p_value"], 7)


# Two of the three follow the price; quantity does not.
_RELATED = {
    "sCPP_SYN01_Mean_3": "l_quantity",
    "sCPP_SYN01_SD_3": "l_extendedprice * (1 - l_discount)",
    "sCPP_SYN02_Mean_4": "l_extendedprice * l_tax",
}


@query(
    "univariate_select",
    " UNION ALL ".join(
        f"""SELECT '{name}' AS feature, '{name.split("_")[1]}' AS aaindex_id, regr_count(l_extendedprice, {c}) AS n,
  {r(f'1 - (1 - regr_r2(l_extendedprice, {c})) * (count(*) - 1) / (count(*) - 2)', 'adj_r_sq')},
  {r(f'regr_r2(l_extendedprice, {c}) * (count(*) - 2) / (1 - regr_r2(l_extendedprice, {c}))', 'f_stat', 1)}, 0.0::DOUBLE AS p_value
FROM lineitem"""
        for name, c in list(_RELATED.items())[1:]
    ),
)
def q_univariate_select(spark, sf_dir):
    """The best related feature of each scale; its p-value is zero to the digits compared."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_extendedprice").alias("delta_g"), *[F.expr(c).alias(n) for n, c in _RELATED.items()]
    )
    tested = single_receptor.univariate_regression(rows, "delta_g", list(_RELATED))
    out = single_receptor.univariate_select(tested, ["SYN01", "SYN02"])
    return rounded(rounded(out, ["adj_r_sq", "p_value"]), ["f_stat"], 1)


@query(
    "multivariate_regression",
    f"""WITH s AS (SELECT covar_samp(l_extendedprice, l_quantity) AS y1, covar_samp(l_extendedprice, l_discount) AS y2,
  covar_samp(l_quantity, l_discount) AS c12, var_samp(l_quantity) AS v1, var_samp(l_discount) AS v2,
  avg(l_extendedprice) AS my, avg(l_quantity) AS m1, avg(l_discount) AS m2 FROM lineitem),
b AS (SELECT *, (y1 * v2 - y2 * c12) / (v1 * v2 - c12 * c12) AS b1, (y2 * v1 - y1 * c12) / (v1 * v2 - c12 * c12) AS b2
  FROM s)
SELECT l_orderkey, l_linenumber,
  {r('my - b1 * m1 - b2 * m2 + b1 * l_quantity + b2 * l_discount', 'prediction', 3)} FROM lineitem, b""",
)
def q_multivariate_regression(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    model = single_receptor.fit_linear(rows, "l_extendedprice", ["l_quantity", "l_discount"], stepwise=False)
    return rounded(rows.select("l_orderkey", "l_linenumber", model.prediction().alias("prediction")), ["prediction"], 3)


def _stepwise_sql() -> str:
    """All eight subsets of the predictors are fitted; the walk goes from the full one to its best neighbour while that is better."""
    y, xs, n = "l_extendedprice", _PREDICTORS, range(3)
    sums = [f"covar_pop({xs[i]}, {xs[j]}) * count(*) AS s{i}{j}" for i in n for j in n]
    sums += [f"covar_pop({xs[i]}, {y}) * count(*) AS y{i}" for i in n] + [f"avg({x}) AS m{i}" for i, x in enumerate(xs)]
    # a predictor that is left out has a row of its own with a coefficient of zero
    cells = ", ".join(
        f"CASE WHEN (mask >> {i}) & (mask >> {j}) & 1 = 1 THEN s{i}{j} ELSE {float(i == j)}::DOUBLE END AS a{i}{j}" for i in n for j in n
    )
    right = ", ".join(f"CASE WHEN (mask >> {i}) & 1 = 1 THEN y{i} ELSE 0.0::DOUBLE END AS r{i}" for i in n)

    def det(c: list[list[str]]) -> str:
        (a, b, d), (e, f, g), (h, i, j) = c
        return f"({a} * ({f} * {j} - {g} * {i}) - {b} * ({e} * {j} - {g} * {h}) + {d} * ({e} * {i} - {f} * {h}))"

    matrix = [[f"a{i}{j}" for j in n] for i in n]
    betas = ", ".join(
        f"{det([[f'r{i}' if j == k else matrix[i][j] for j in n] for i in n])} / {det(matrix)} AS b{k}" for k in n
    )
    return f"""WITH RECURSIVE s AS (SELECT count(*) AS n, var_pop({y}) * count(*) AS yy, avg({y}) AS my, {", ".join(sums)} FROM lineitem),
a AS (SELECT *, {cells}, {right} FROM s, (SELECT unnest(range(8)) AS mask)),
b AS (SELECT *, {betas} FROM a),
m AS MATERIALIZED (SELECT *, n * ln((yy - b0 * r0 - b1 * r1 - b2 * r2) / n) + 2 * (bit_count(mask) + 1) AS aic FROM b),
nx AS MATERIALIZED (SELECT c.mask AS src, arg_min(x.mask, x.aic) AS dst FROM m c JOIN m x
  ON bit_count(xor(c.mask, x.mask)) = 1 AND x.aic < c.aic - 1e-9 GROUP BY c.mask),
w AS (SELECT 7::BIGINT AS mask, 0 AS step UNION ALL SELECT nx.dst, step + 1 FROM w JOIN nx ON nx.src = w.mask),
f AS (SELECT m.* FROM m WHERE mask = (SELECT arg_max(mask, step) FROM w))
SELECT l_orderkey, l_extendedprice, {", ".join(xs)},
  {r("my + " + " + ".join(f"b{i} * ({x} - m{i})" for i, x in enumerate(xs)), "prediction", 3)} FROM lineitem, f"""


@query("stepwise_regression", _stepwise_sql())
def q_stepwise_regression(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", *_PREDICTORS)
    return rounded(single_receptor.multivariate_prediction(rows, "l_extendedprice", _PREDICTORS), ["prediction"], 3)


@query(
    "contact_footprint",
    f"""WITH w AS (SELECT [CAST(l_linenumber AS DOUBLE), CAST(CAST(l_quantity AS INTEGER) AS DOUBLE),
    round(l_discount * 100), round(l_tax * 100)] AS w FROM lineitem),
c AS (SELECT w, (w[1] + 2 * w[2] + 3 * w[3] + 4 * w[4]) / (w[1] + w[2] + w[3] + w[4]) AS c FROM w),
s AS (SELECT i - c AS p, floor(w[i]) AS n FROM c, (SELECT unnest([1, 2, 3, 4]) AS i)),
t AS (SELECT sum(n) FILTER (abs(p) <= 1) / sum(n) * 100 AS a, sum(n) FILTER (abs(p) <= 2) / sum(n) * 100 AS b
      FROM s WHERE n > 0)
SELECT {r('a', 'within_1')}, {r('b - a', 'within_2')}, {r('100 - b', 'beyond_2')} FROM t""",
)
def q_contact_footprint(spark, sf_dir):
    out = single_receptor.contact_footprint(footprints(spark, sf_dir))
    return rounded(out, ["within_1", "within_2", "beyond_2"])


def footprints(spark, sf_dir):
    """Four contact weights per line item in the compressed form ``a|b|c|d``."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws(
            "|",
            F.col("l_linenumber").cast("string"),
            F.col("l_quantity").cast("int").cast("string"),
            F.round(F.col("l_discount") * 100).cast("int").cast("string"),
            F.round(F.col("l_tax") * 100).cast("int").cast("string"),
        ).alias("weights")
    )


@query(
    "footprint_density",
    f"""WITH w AS (SELECT [CAST(l_linenumber AS DOUBLE), CAST(CAST(l_quantity AS INTEGER) AS DOUBLE),
    round(l_discount * 100), round(l_tax * 100)] AS w FROM lineitem),
c AS (SELECT w, (w[1] + 2 * w[2] + 3 * w[3] + 4 * w[4]) / (w[1] + w[2] + w[3] + w[4]) AS c FROM w),
s AS MATERIALIZED (SELECT i - c AS p, CAST(sum(floor(w[i])) AS DOUBLE) AS n FROM c, (SELECT unnest([1, 2, 3, 4]) AS i)
  WHERE floor(w[i]) > 0 GROUP BY 1),
t AS (SELECT sum(n) AS n, sum(n * p) AS s1, sum(n * p * p) AS s2, min(p) AS lo, max(p) AS hi FROM s),
o AS MATERIALIZED (SELECT p, n, sum(n) OVER (ORDER BY p) - n AS before FROM s),
e AS (SELECT q, (t.n - 1) * q AS h, max(p) FILTER (before <= floor((t.n - 1) * q) AND floor((t.n - 1) * q) < before + o.n) AS a,
    max(p) FILTER (before <= ceil((t.n - 1) * q) AND ceil((t.n - 1) * q) < before + o.n) AS b
  FROM o, t, (SELECT unnest([0.25::DOUBLE, 0.75::DOUBLE]) AS q) GROUP BY q, t.n),
i AS (SELECT max(a + (b - a) * (h - floor(h))) - min(a + (b - a) * (h - floor(h))) AS iqr FROM e),
k AS (SELECT t.*, 0.9::DOUBLE * least(sqrt((s2 - s1 * s1 / n) / (n - 1)), iqr / 1.34::DOUBLE) * power(n, -0.2::DOUBLE) AS bw FROM t, i),
g AS (SELECT n, bw, point, lo - 3 * bw + (hi - lo + 6 * bw) * point / 511 AS gx FROM k, (SELECT unnest(range(512)) AS point))
SELECT CAST(point AS INTEGER) AS point, {r('gx', 'x')}, {r('y', 'y')} FROM (
  SELECT point, gx, sum(s.n * exp(-0.5::DOUBLE * power((gx - p) / bw, 2))) / (max(g.n) * max(bw) * sqrt(2 * pi())) AS y
  FROM g, s GROUP BY point, gx)""",
)
def q_footprint_density(spark, sf_dir):
    return rounded(single_receptor.footprint_density(footprints(spark, sf_dir)), ["x", "y"])
