"""Queries over classifier output: curves, AUC, calibration, cumulative gain."""

from __future__ import annotations

from ..operators import diagnostics
from .inputs import CLASSIFIED_SQL, classified
from .registry import query, r, rnd, rounded

CURVE_SQL = CLASSIFIED_SQL + """,
c AS (SELECT "group", prob, count(*) FILTER (truth = 'Positive') AS pos, count(*) FILTER (truth <> 'Positive') AS neg
      FROM cls GROUP BY 1, 2),
k AS (SELECT "group", prob,
        sum(pos) OVER o AS tp, sum(neg) OVER o AS fp, row_number() OVER o AS point,
        sum(pos) OVER (PARTITION BY "group") AS m, sum(neg) OVER (PARTITION BY "group") AS n
      FROM c WINDOW o AS (PARTITION BY "group" ORDER BY prob DESC))"""


@query(
    "roc_curve",
    f"""WITH {CURVE_SQL}
SELECT "group", {r('prob', 'threshold', 9)}, {r('fp / n * 100', 'fpr', 9)}, {r('tp / m * 100', 'tpr', 9)} FROM k
UNION ALL SELECT DISTINCT "group", CAST(NULL AS DOUBLE), 0.0, 0.0 FROM k""",
)
def q_roc_curve(spark, sf_dir):
    return rounded(diagnostics.roc_curve(classified(spark, sf_dir)), ["threshold", "fpr", "tpr"], 9)


@query(
    "prc_curve",
    f"""WITH {CURVE_SQL}
SELECT "group", {r('prob', 'threshold', 9)}, {r('tp / m * 100', 'recall', 9)},
       {r('tp / (tp + fp) * 100', '"precision"', 9)} FROM k
UNION ALL SELECT "group", NULL, 0.0, {r('tp / (tp + fp) * 100', '"precision"', 9)} FROM k WHERE point = 1""",
)
def q_prc_curve(spark, sf_dir):
    return rounded(diagnostics.prc_curve(classified(spark, sf_dir)), ["threshold", "recall", "precision"], 9)


GAIN_SQL = CURVE_SQL + """,
g AS (SELECT "group", prob AS threshold, point, (tp + fp) / (m + n) * 100 AS x, tp / m * 100 AS y FROM k
      UNION ALL SELECT DISTINCT "group", NULL, 0, 0.0, 0.0 FROM k)"""


@query(
    "cum_gain",
    f"""WITH {GAIN_SQL}
SELECT "group", {r('threshold', 'threshold', 9)}, CAST(point AS BIGINT) AS point, {r('x', 'cum_tested_pct', 9)},
       {r('y', 'cum_event_pct', 9)} FROM g""",
)
def q_cum_gain(spark, sf_dir):
    return rounded(
        diagnostics.cum_gain(classified(spark, sf_dir)), ["threshold", "cum_tested_pct", "cum_event_pct"], 9
    )


@query(
    "cum_gain_at",
    f"""WITH {GAIN_SQL},
near AS (SELECT "group", point AS p0 FROM g
         QUALIFY row_number() OVER (PARTITION BY "group" ORDER BY (y - 80) * (y - 80), point) = 1),
loc AS (SELECT "group", y, avg(x) AS x, count(*) AS n FROM g JOIN near USING ("group")
        WHERE abs(point - p0) <= 5 GROUP BY 1, 2),
e AS (SELECT "group", sum(n) AS n, max(y) FILTER (y <= 80) AS y0, max_by(x, y) FILTER (y <= 80) AS x0,
             min(y) FILTER (y >= 80) AS y1, min_by(x, y) FILTER (y >= 80) AS x1 FROM loc GROUP BY 1)
SELECT "group", 80.0::DOUBLE AS cum_event_pct,
       CASE WHEN n > 2 THEN {rnd('CASE WHEN y0 = y1 THEN x0 ELSE x0 + (x1 - x0) * (80 - y0) / (y1 - y0) END', 9)}
       END AS cum_tested_pct
FROM e""",
)
def q_cum_gain_at(spark, sf_dir):
    gain = diagnostics.cum_gain(classified(spark, sf_dir))
    return rounded(diagnostics.cum_gain_at(gain), ["cum_tested_pct"], 9)


@query(
    "calibration_bins",
    f"""WITH {CLASSIFIED_SQL},
b AS (SELECT "group", len(list_filter([i * 0.1::DOUBLE FOR i IN range(0, 11)], lambda e: e <= prob)) AS bucket,
             count(*) AS n, count(*) FILTER (truth = 'Positive') AS positive FROM cls GROUP BY 1, 2),
grid AS (SELECT "group", unnest(range(1, 11)) AS bucket FROM (SELECT DISTINCT "group" FROM cls))
SELECT "group", CAST(grid.bucket AS INTEGER) AS bucket, 5.0::DOUBLE + (grid.bucket - 1) * 10 AS percentage,
       coalesce(n, 0) AS n, coalesce(positive, 0) AS positive
FROM grid LEFT JOIN b USING ("group", bucket)""",
)
def q_calibration_bins(spark, sf_dir):
    return diagnostics.calibration_bins(classified(spark, sf_dir))


@query("calibration_bands")
def q_calibration_bands(spark, sf_dir):
    bands = [name for name, _ in diagnostics.CALIBRATION_BANDS]
    return rounded(diagnostics.calibration_bands(diagnostics.calibration_bins(classified(spark, sf_dir))), bands)


@query(
    "auc_delong",
    f"""WITH {CLASSIFIED_SQL},
c AS (SELECT "group", prob, count(*) FILTER (truth = 'Positive') AS pos, count(*) FILTER (truth <> 'Positive') AS neg
      FROM cls GROUP BY 1, 2),
k AS (SELECT *, sum(pos) OVER o - pos AS bp, sum(neg) OVER o - neg AS bn,
        sum(pos) OVER (PARTITION BY "group") AS m, sum(neg) OVER (PARTITION BY "group") AS n
      FROM c WINDOW o AS (PARTITION BY "group" ORDER BY prob)),
v AS (SELECT *, (bn + neg / 2) / n AS v10, (m - bp - pos / 2) / m AS v01 FROM k),
t AS (SELECT "group", sum(pos * v10) / max(m) AS theta FROM v GROUP BY 1),
s AS (SELECT "group", max(theta) AS theta,
        sum(pos * (v10 - theta) * (v10 - theta)) / (max(m) - 1) / max(m)
        + sum(neg * (v01 - theta) * (v01 - theta)) / (max(n) - 1) / max(n) AS var
      FROM v JOIN t USING ("group") GROUP BY 1),
d AS (SELECT "group", median(prob) FILTER (truth = 'Positive') AS mp, median(prob) FILTER (truth <> 'Positive') AS mn
      FROM cls GROUP BY 1),
a AS (SELECT "group", CASE WHEN mn > mp THEN 1 - theta ELSE theta END AS auc, 1.959963984540054 * sqrt(var) AS h
      FROM s JOIN d USING ("group"))
SELECT "group", {r('auc * 100', 'auc')}, {r('greatest(auc - h, 0) * 100', 'ci_lo')},
       {r('least(auc + h, 1) * 100', 'ci_up')} FROM a""",
)
def q_auc_delong(spark, sf_dir):
    return rounded(diagnostics.auc_delong(classified(spark, sf_dir)), ["auc", "ci_lo", "ci_up"])
