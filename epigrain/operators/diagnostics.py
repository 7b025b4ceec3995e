"""Classifier diagnostics as data frames: curve points, AUC with interval, calibration, cumulative gain.

Rows with equal scores are collapsed first; cumulative counts then come from bucketed running totals, so
neither an ungrouped data set nor a dominant group is ordered by a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.joins import join_groups, null_safe_join
from ..functions.ordered import quantile_terms, running_totals
from ..functions.special import beta_quantile

# Normal quantile of a 95% interval, calibration band probabilities, gain level and window.
Z95 = 1.959963984540054
CALIBRATION_BANDS = (("llb", 0.025), ("lb", 0.25), ("y", 0.5), ("ub", 0.75), ("uub", 0.965))
GAIN_LEVEL, GAIN_WINDOW = 80.0, 5
PLOT_TYPES = ("ROC", "PRC", "Calibration", "CumGain")


def _score_counts(df: DataFrame, truth: str, prob: str, group: str, descending: bool) -> DataFrame:
    order = -F.col(prob) if descending else F.col(prob)
    positive = F.col(truth) == "Positive"
    return (
        df.where(F.col(truth).isNotNull() & F.col(prob).isNotNull())
        .groupBy(F.col(group).alias("group"), order.alias("_order"))
        .agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))
        .withColumn("one", F.lit(1))
    )


def _cumulative(df: DataFrame, truth: str, prob: str, group: str) -> DataFrame:
    counts = _score_counts(df, truth, prob, group, descending=True)
    return (
        running_totals(counts, ["group"], "_order", ["pos", "neg", "one"])
        .withColumn("threshold", -F.col("_order"))
        .withColumn("tp", F.col("before_pos") + F.col("pos"))
        .withColumn("fp", F.col("before_neg") + F.col("neg"))
    )


def _with_origin(points: DataFrame, first: DataFrame) -> DataFrame:
    return points.unionByName(first, allowMissingColumns=True)


def roc_curve(df: DataFrame, truth: str = "truth", prob: str = "prob", group: str = "group") -> DataFrame:
    """ROC points in percent, from the origin: group, threshold (NULL at the origin), fpr, tpr."""
    c = _cumulative(df, truth, prob, group)
    points = c.select(
        "group",
        "threshold",
        (F.col("fp") / F.col("total_neg") * 100).alias("fpr"),
        (F.col("tp") / F.col("total_pos") * 100).alias("tpr"),
    )
    origin = c.where(F.col("before_one") == 0).select("group", F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return _with_origin(points, origin)


def prc_curve(df: DataFrame, truth: str = "truth", prob: str = "prob", group: str = "group") -> DataFrame:
    """Precision-recall points in percent; the curve starts at recall 0 with the first point's precision."""
    c = _cumulative(df, truth, prob, group)
    precision = (F.col("tp") / (F.col("tp") + F.col("fp")) * 100).alias("precision")
    points = c.select("group", "threshold", (F.col("tp") / F.col("total_pos") * 100).alias("recall"), precision)
    start = c.where(F.col("before_one") == 0).select("group", F.lit(0.0).alias("recall"), precision)
    return _with_origin(points, start)


def cum_gain(df: DataFrame, truth: str = "truth", prob: str = "prob", group: str = "group") -> DataFrame:
    """Cumulative gain points in percent, with their position ``point`` along the curve."""
    c = _cumulative(df, truth, prob, group)
    points = c.select(
        "group",
        "threshold",
        (F.col("before_one") + 1).alias("point"),
        ((F.col("tp") + F.col("fp")) / (F.col("total_pos") + F.col("total_neg")) * 100).alias("cum_tested_pct"),
        (F.col("tp") / F.col("total_pos") * 100).alias("cum_event_pct"),
    )
    origin = c.where(F.col("before_one") == 0).select(
        "group",
        F.lit(0).cast("long").alias("point"),
        F.lit(0.0).alias("cum_tested_pct"),
        F.lit(0.0).alias("cum_event_pct"),
    )
    return _with_origin(points, origin)


def cum_gain_at(gain: DataFrame, level: float = GAIN_LEVEL, window: int = GAIN_WINDOW) -> DataFrame:
    """Share of data examined to find ``level`` percent of targets.

    Linear interpolation among the points within ``window`` of the nearest one; equal heights are averaged.
    """
    distance = F.pow(F.col("cum_event_pct") - level, F.lit(2.0))
    nearest = gain.groupBy("group").agg(F.min_by("point", F.struct(distance, F.col("point"))).alias("_near"))
    local = join_groups(gain, nearest, ["group"]).where(F.abs(F.col("point") - F.col("_near")) <= window)
    heights = local.groupBy("group", "cum_event_pct").agg(
        F.avg("cum_tested_pct").alias("_x"), F.count("*").alias("_n")
    )
    y = F.col("cum_event_pct")
    ends = heights.groupBy("group").agg(
        F.sum("_n").alias("_points"),
        F.max(F.when(y <= level, y)).alias("_y0"),
        F.max_by("_x", F.when(y <= level, y)).alias("_x0"),
        F.min(F.when(y >= level, y)).alias("_y1"),
        F.min_by("_x", F.when(y >= level, y)).alias("_x1"),
    )
    between = F.when(F.col("_y0") == F.col("_y1"), F.col("_x0")).otherwise(
        F.col("_x0") + (F.col("_x1") - F.col("_x0")) * (level - F.col("_y0")) / (F.col("_y1") - F.col("_y0"))
    )
    return ends.select(
        "group",
        F.lit(level).alias("cum_event_pct"),
        F.when(F.col("_points") > 2, between).alias("cum_tested_pct"),
    )


def calibration_bins(df: DataFrame, truth: str = "truth", prob: str = "prob", group: str = "group") -> DataFrame:
    """Ten buckets [k/10, (k+1)/10) per group with size and positives; probability 1 is in no bucket."""
    edges = F.array(*[F.lit(i * 0.1) for i in range(11)])
    bucket = F.size(F.filter(edges, lambda e: e <= F.col(prob)))
    counted = df.groupBy(F.col(group).alias("group"), bucket.alias("bucket")).agg(
        F.count(prob).alias("n"), F.count_if(F.col(truth) == "Positive").alias("positive")
    )
    grid = counted.select("group").distinct().withColumn("bucket", F.explode(F.sequence(F.lit(1), F.lit(10))))
    return null_safe_join(grid, counted, ["group", "bucket"], "left").select(
        "group",
        "bucket",
        (F.lit(5.0) + (F.col("bucket") - 1) * 10).alias("percentage"),
        F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("positive", F.lit(0)).alias("positive"),
    )


def calibration_bands(bins: DataFrame) -> DataFrame:
    """Beta-smoothed true probability (percent) per bucket with its inner and outer bands."""
    a = F.lit(0.5) + F.col("positive")
    b = F.lit(0.5) + F.col("n") - F.col("positive")
    return bins.select("*", *[(beta_quantile(F.lit(p), a, b) * 100).alias(name) for name, p in CALIBRATION_BANDS])


def auc_delong(df: DataFrame, truth: str = "truth", prob: str = "prob", group: str = "group") -> DataFrame:
    """AUC and its DeLong 95% interval in percent, per group.

    The comparison direction follows the class medians: when negatives score higher, low scores count
    as positive evidence.
    """
    counts = _score_counts(df, truth, prob, group, descending=False)
    r = running_totals(counts, ["group"], "_order", ["pos", "neg"])
    m, n = F.max("total_pos"), F.max("total_neg")
    v10 = (F.col("before_neg") + F.col("neg") * 0.5) / F.col("total_neg")
    v01 = (F.col("total_pos") - F.col("before_pos") - F.col("pos") * 0.5) / F.col("total_pos")
    sums = r.groupBy("group").agg(
        m.cast("double").alias("_m"),
        n.cast("double").alias("_n"),
        F.sum(F.col("pos") * v10).alias("_s10"),
        # about a half, near which the placements of a weak classifier lie: sums of squares then keep their digits
        F.sum(F.col("pos") * (v10 - 0.5)).alias("_d10"),
        F.sum(F.col("pos") * (v10 - 0.5) * (v10 - 0.5)).alias("_q10"),
        F.sum(F.col("neg") * (v01 - 0.5)).alias("_d01"),
        F.sum(F.col("neg") * (v01 - 0.5) * (v01 - 0.5)).alias("_q01"),
        quantile_terms("_order", {"m": 0.5}, "pos")["m"].alias("_med_pos"),
        quantile_terms("_order", {"m": 0.5}, "neg")["m"].alias("_med_neg"),
    )
    theta = F.col("_s10") / F.col("_m")
    s10 = F.greatest(F.col("_q10") - F.col("_d10") * F.col("_d10") / F.col("_m"), F.lit(0.0)) / (F.col("_m") - 1)
    s01 = F.greatest(F.col("_q01") - F.col("_d01") * F.col("_d01") / F.col("_n"), F.lit(0.0)) / (F.col("_n") - 1)
    half = F.sqrt(s10 / F.col("_m") + s01 / F.col("_n")) * Z95
    auc = F.when(F.col("_med_neg") > F.col("_med_pos"), 1 - theta).otherwise(theta)

    def percent(value: Column) -> Column:
        return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)) * 100

    return sums.select(
        "group",
        (auc * 100).alias("auc"),
        percent(auc - half).alias("ci_lo"),
        percent(auc + half).alias("ci_up"),
    )


def auc_label(auc: DataFrame) -> DataFrame:
    """Caption text of the ROC chart."""
    return auc.withColumn(
        "label", F.format_string("AUC: %.1f%% [%.1f%%-%.1f%%]", F.col("auc"), F.col("ci_lo"), F.col("ci_up"))
    )


def classifier_diagnostics(
    df: DataFrame, truth: str = "truth", prob: str = "prob", group: str = "group", plot_types=PLOT_TYPES
) -> dict[str, DataFrame]:
    """Plot data of the requested diagnostics, keyed by plot type."""
    out: dict[str, DataFrame] = {}
    if "ROC" in plot_types:
        out["ROC"] = roc_curve(df, truth, prob, group)
        out["AUC"] = auc_label(auc_delong(df, truth, prob, group))
    if "PRC" in plot_types:
        out["PRC"] = prc_curve(df, truth, prob, group)
    if "Calibration" in plot_types:
        out["Calibration"] = calibration_bands(calibration_bins(df, truth, prob, group))
    if "CumGain" in plot_types:
        out["CumGain"] = cum_gain(df, truth, prob, group)
        out["CumGainLevel"] = cum_gain_at(out["CumGain"])
    return out
