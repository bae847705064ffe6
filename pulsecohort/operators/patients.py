"""Evaluation of acquisitions against fixed thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Metric, threshold, direction (1: at or above is abnormal).
FIXED_PANEL = (
    ("SF_VTI", 0.48, 1), ("t50_over_T", 0.36, -1), ("E_low_over_E_total", 0.76, 1), ("v_end_over_vbar", 0.59, -1),
    ("N_eff_over_T", 0.90, -1), ("RI", 0.70, 1), ("PI", 1.30, 1), ("W50_over_T", 0.60, -1),
)
#: The panel of the short scorer: the same thresholds without the spectral fraction.
SHORT_PANEL = tuple(p for p in FIXED_PANEL if p[0] != "E_low_over_E_total")
#: Upper ends of the label bands.
BANDS = ((0.33, "low"), (0.67, "intermediate"), (1.01, "high"))


def panel(spark: SparkSession, rows: tuple = FIXED_PANEL, weight: float = 1.0, control_std: float | None = None) -> DataFrame:
    return spark.createDataFrame([(m, t, d, weight, control_std) for m, t, d in rows], "metric string, threshold double, direction int, weight double, control_std double")


def evaluate_metrics(values: DataFrame, fixed: DataFrame) -> DataFrame:
    """One row an acquisition and panel metric: deviation, abnormal, z and its weighted share; a missing metric says so.

    ``values`` is (acq, metric, value), one row each; the panel is a fixed few rows.
    """
    wanted = values.select("acq").distinct().withColumn("p", F.lit(1)).join(F.broadcast(fixed.agg(F.collect_list(F.struct(*fixed.columns)).alias("panel")).withColumn("p", F.lit(1))), "p").select("acq", F.explode("panel").alias("m")).select("acq", "m.*")
    out = wanted.join(values.select("acq", "metric", "value"), ["acq", "metric"], "left")
    ok = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    out = out.withColumn("available", F.coalesce(ok, F.lit(False))).withColumn("value", F.when(F.col("available"), F.col("value")))
    deviation = F.col("direction") * (F.col("value") - F.col("threshold"))
    out = out.withColumn("abnormal", F.coalesce(deviation >= 0, F.lit(False)))
    z = F.when(~F.col("available"), F.lit(None)).when(~F.col("abnormal"), 0.0).when(F.col("control_std") > 0, deviation / F.col("control_std")).otherwise(1.0)
    out = out.withColumn("z", z.cast("double")).withColumn("z_capped", F.when(F.col("z").isNotNull(), F.least(F.lit(1.0), F.col("z")))).withColumn("weighted_contribution", F.col("weight") * F.col("z_capped"))
    return out.withColumn("message", F.when(~F.col("available"), F.format_string("metric %s is missing or not finite", F.col("metric"))).otherwise(""))


def label(index: Column) -> Column:
    out = F.lit(None).cast("string")
    for top, name in reversed(BANDS):
        out = F.when(index < top, name).otherwise(out)
    return F.when(index.isNull(), "not available").otherwise(out)


def evaluate(metrics: DataFrame) -> DataFrame:
    """Pathology index, coverage and label of each acquisition over the metrics that it has."""
    have = F.col("available")
    weight = F.sum(F.when(have, F.col("weight")).otherwise(0.0))
    out = metrics.groupBy("acq").agg(
        F.count(F.lit(1)).alias("n_metrics_configured"), F.sum(have.cast("int")).alias("n_metrics_available"), F.sum(F.col("abnormal").cast("int")).alias("n_metrics_abnormal"),
        F.try_divide(F.sum("weighted_contribution"), F.nullif(weight, F.lit(0.0))).alias("pathology_index"), F.try_divide(F.sum(F.col("weight") * F.col("z")), F.nullif(weight, F.lit(0.0))).alias("z_index"),
    )
    index = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("pathology_index")))
    out = out.withColumn("pathology_index", F.when(F.col("pathology_index").isNotNull(), index))
    return out.select(
        "acq", "n_metrics_configured", "n_metrics_available", "n_metrics_abnormal", "pathology_index", (100 * F.col("pathology_index")).alias("pathology_index_percent"),
        (10 * F.col("z_index")).alias("was"), (10 * F.col("pathology_index")).alias("was_c_equivalent"), F.try_divide(F.col("n_metrics_abnormal"), F.nullif("n_metrics_available", F.lit(0))).alias("abnormal_fraction"),
        (F.col("n_metrics_available") / F.col("n_metrics_configured")).alias("coverage_fraction"), label(F.col("pathology_index")).alias("evaluation_label"),
    )


def patient_ids(files: DataFrame, name: str = "file_name") -> DataFrame:
    """Sanitised ids, made unique in file order by _2, _3 and so on."""
    base = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(name), r"\.[^.]*$", ""), r"[^A-Za-z0-9_-]+", "_"), r"^_+|_+$", "")
    out = files.withColumn("_b", F.when(base == "", "patient").otherwise(base))
    k = F.row_number().over(Window.partitionBy("_b").orderBy(name))
    return out.withColumn("patient_id", F.when(k == 1, F.col("_b")).otherwise(F.concat_ws("_", "_b", k.cast("string")))).drop("_b")


def case_ids(files: DataFrame, path: str = "path", position: str = "position") -> DataFrame:
    """group_name (the folder that holds the file, "root" without one), its case number in order of position, a label and a file stem."""
    clean = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: ~p.isin("", ".", ".."))
    group = F.coalesce(F.get(clean, F.size(clean) - 2), F.lit("root"))
    k = F.row_number().over(Window.partitionBy("group_name").orderBy(position, path))
    out = files.withColumn("group_name", group).withColumn("group_case_index", k)
    bare = F.regexp_replace(F.regexp_replace("group_name", r"[^A-Za-z0-9._-]+", "_"), r"^[._-]+|[._-]+$", "")
    safe = F.substring(F.when(bare == "", "group").otherwise(bare), 1, 40)
    return out.withColumns({"display_label": F.format_string("%s #%d", "group_name", "group_case_index"), "file_stem": F.format_string("%s_%03d", safe, "group_case_index")})
