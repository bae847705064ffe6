"""Composite scores from calibrated thresholds: optimal splits, WAS and WAS-c, usefulness, histograms.

Metric rows are (acq, cohort, vessel, representation, metric, beat, value).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsecohort.functions import robust, special


#: The panel of shape metrics that are calibrated.
PANEL = {
    "centroid_timing": "mu_t_over_T", "temporal_spread": "sigma_t_over_T", "temporal_skewness": "gamma_t", "t10_timing": "t10_over_T", "t25_timing": "t25_over_T",
    "t50_timing": "t50_over_T", "t75_timing": "t75_over_T", "t90_timing": "t90_over_T", "qt_width": "Q_t_width", "qt_skew": "Q_t_skew", "delta_dti": "Delta_DTI",
    "d10_fraction": "d10_over_D", "d25_fraction": "d25_over_D", "d50_fraction": "d50_over_D", "d75_fraction": "d75_over_D", "d90_fraction": "d90_over_D",
    "qd_width": "Q_d_width", "qd_skew": "Q_d_skew", "early_late_balance": "R_VTI", "stroke_fraction": "SF_VTI", "near_peak_crest_width": "W50_over_T",
    "summit_crest_width": "W80_over_T", "resistivity_index": "RI", "pulsatility_index": "PI", "crest_factor": "CF", "peak_timing": "t_max_over_T",
    "trough_timing": "t_min_over_T", "upstroke_steepness": "S_rise", "downstroke_steepness": "S_fall", "upstroke_timing": "t_rise_over_T",
    "downstroke_timing": "t_fall_over_T", "slope_energy": "E_slope", "late_cycle_mean_fraction": "v_end_over_vbar", "effective_duration": "N_eff_over_T",
    "entropic_duration": "N_t_over_T", "low_freq_spectral_ratio": "E_LF_over_E_HF", "reconstruction_fidelity": "eta_h",
}
TOP = 10


def per_file(rows: DataFrame, how: str = "median") -> DataFrame:
    """One value an acquisition, vessel, representation and metric over its finite beats."""
    f = {"median": F.median, "mean": F.avg, "max": F.max, "min": F.min}[how]
    ok = rows.where("value is not null and not isnan(value) and abs(value) < double('inf')")
    return ok.groupBy("acq", "cohort", "vessel", "representation", "metric").agg(f("value").alias("value"))


def two_cohorts(rows: DataFrame, control: str, pathology: str | None = None) -> DataFrame:
    """The rows of both cohorts, marked; an error unless there are exactly two or both are named."""
    if pathology is None:
        names = [r[0] for r in rows.select("cohort").distinct().limit(3).collect()]
        others = [n for n in names if n != control]
        if len(names) != 2 or len(others) != 1:
            raise ValueError(f"exactly two cohorts are needed, one of them {control!r}; found {sorted(names)}")
        pathology = others[0]
    return rows.where(F.col("cohort").isin(control, pathology)).withColumn("pathology", F.col("cohort") == pathology)


def splits(values: DataFrame, with_p: bool = True) -> DataFrame:
    """Optimal split, both AUCs, control deviation and the four p-values of each metric of two marked cohorts."""
    keys = ["vessel", "representation", "metric"]
    best = robust.best_threshold(values, keys, "value", "pathology", sentinels=True)
    r = robust.rank_statistics(values, keys, "value", "pathology")
    g = robust.two_groups(values, keys, "value", "pathology").drop("n_c", "n_g")
    out = best.join(r, keys).join(g, keys).withColumn("auc_greater", F.col("auc")).withColumn("auc_less", 1 - F.col("auc")).withColumn("separability_auc", F.greatest("auc", 1 - F.col("auc")))
    out = out.withColumn("balanced_accuracy", (F.col("sensitivity") + F.col("specificity")) / 2).withColumn("control_std", F.when(F.sqrt("var_c") > 0, F.sqrt("var_c")).otherwise(1.0))
    if with_p:
        n1, n2, v1, v2 = F.col("n_c"), F.col("n_g"), F.col("var_c"), F.col("var_g")
        gap = F.col("mean_g") - F.col("mean_c")
        pooled = ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)
        t = F.when((n1 >= 2) & (n2 >= 2), F.try_divide(gap, F.sqrt(pooled * (1 / n1 + 1 / n2))))
        se = v1 / n1 + v2 / n2
        welch = F.when((n1 >= 2) & (n2 >= 2), F.try_divide(gap, F.sqrt(se)))
        df = F.when((n1 >= 2) & (n2 >= 2), F.try_divide(se * se, F.pow(v1 / n1, 2) / F.nullif((n1 - 1).cast("double"), F.lit(0.0)) + F.pow(v2 / n2, 2) / F.nullif((n2 - 1).cast("double"), F.lit(0.0))))
        out = out.withColumns({
            "p_value_mannwhitney": special.mann_whitney(F.col("u"), n2, n1, F.col("ties")), "p_value_student": special.student_p(t, (n1 + n2 - 2).cast("double")),
            "p_value_welch": special.student_p(welch, df), "p_value_ks": special.ks_p(F.col("ks"), n1, n2),
        })
    return out.drop("u", "ties", "auc", "var_c", "var_g", "median_c", "median_g")


def top_by_auc(split: DataFrame, top: int = TOP) -> DataFrame:
    """The best metrics by separability, then Youden index, then balanced accuracy."""
    return split.orderBy(F.desc(F.round("separability_auc", 9)), F.desc(F.round("youden", 9)), F.desc(F.round("balanced_accuracy", 9)), "metric").limit(top)


def contributions(rows: DataFrame, panel: DataFrame) -> DataFrame:
    """z of each panel metric: the largest excess over beats past its threshold, in control deviations.

    ``panel`` is (vessel, representation, metric, threshold, direction,
    control_std). A metric without a finite beat has z 0; one without any row
    is absent here and voids the score.
    """
    excess = F.greatest(F.lit(0.0), F.col("direction") * (F.col("value") - F.col("threshold")) / F.col("control_std"))
    usable = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    joined = rows.join(panel, ["vessel", "representation", "metric"])
    out = joined.groupBy("acq", "cohort", "vessel", "representation", "metric", "threshold", "direction", "control_std").agg(F.coalesce(F.max(F.when(usable, excess)), F.lit(0.0)).alias("z"))
    return out.withColumn("z_capped", F.least(F.lit(1.0), F.col("z")))


def panel_scores(parts: DataFrame, size: int) -> DataFrame:
    """WAS and WAS-c of the acquisitions that have the whole panel."""
    keys = ["acq", "cohort", "vessel", "representation"]
    return parts.groupBy(*keys).agg(F.countDistinct("metric").alias("n"), F.sum("z").alias("z"), F.sum("z_capped").alias("zc")).where(F.col("n") == size).select(
        *keys, (10.0 / size * F.col("z")).alias("was"), (10.0 / size * F.col("zc")).alias("was_c")
    )


def usefulness(parts: DataFrame, size: int) -> DataFrame:
    """How often and how much each metric contributes, for each cohort and for ALL, by grouping sets."""
    rows = parts.withColumn("was_points", 10.0 / size * F.col("z")).withColumn("was_c_points", 10.0 / size * F.col("z_capped"))
    by = ["vessel", "representation", "metric"]
    sets = rows.groupingSets([["cohort", *by], by], "cohort", *by)
    active = F.sum(F.when(F.col("z") > 0, 1).otherwise(0))
    return sets.agg(
        F.grouping("cohort").alias("_all"), F.count(F.lit(1)).alias("n_subjects"), active.alias("n_active"), (active / F.count(F.lit(1))).alias("active_fraction"),
        F.avg("z").alias("mean_z"), F.median("z").alias("median_z"), F.sum("z").alias("sum_z"), F.avg("z_capped").alias("mean_z_capped"), F.sum("z_capped").alias("sum_z_capped"),
        F.avg("was_points").alias("mean_was_points"), F.sum("was_points").alias("sum_was_points"), F.avg("was_c_points").alias("mean_was_c_points"), F.sum("was_c_points").alias("sum_was_c_points"),
    ).withColumn("cohort", F.when(F.col("_all") == 1, "ALL").otherwise(F.col("cohort"))).drop("_all")


def ordered_usefulness(useful: DataFrame, split: DataFrame) -> DataFrame:
    """With its split beside each row, ALL first, most active first."""
    out = useful.join(split.select("vessel", "representation", "metric", "youden", "separability_auc"), ["vessel", "representation", "metric"], "left")
    return out.orderBy(F.col("cohort") != "ALL", "cohort", "vessel", "representation", F.desc("active_fraction"), F.desc("sum_was_c_points"), F.desc(F.coalesce("youden", F.lit(0.0))))


def with_split(rows: DataFrame, split: DataFrame) -> DataFrame:
    """Contributions with their metric's split beside them; a panel is some ten rows."""
    keys = ["vessel", "representation", "metric"]
    return rows.join(F.broadcast(split.select(*keys, "youden", "sensitivity", "specificity", "separability_auc")), keys, "left")


def histogram(scored: DataFrame) -> DataFrame:
    """WAS-c in ten bins of width one by cohort; the last is closed above."""
    return scored.groupBy("cohort", F.least(F.floor("was_c"), F.lit(9)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def panel_frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "vessel string, representation string, metric string, threshold double, direction int, control_std double")


def ratio(numerator: str, denominator: str):
    """numerator / denominator, null where the latter is null or zero."""
    return F.try_divide(F.col(numerator), F.nullif(F.col(denominator), F.lit(0.0)))

