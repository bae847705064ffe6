"""Frames behind the reports, and writers for the small ones."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsecohort.functions import robust
from pulsecohort.operators import shape


def file_summary(rows: DataFrame) -> DataFrame:
    """median and population std of each metric of a file, one column pair a vessel."""
    g = rows.groupBy("acq", "metric").pivot("vessel", ["artery", "vein"])
    return g.agg(F.median("value").alias("median"), F.stddev_pop("value").alias("std"))


def group_stats(files: DataFrame) -> DataFrame:
    """mean, sample std and n over the files of a cohort, of each file's median."""
    return files.groupBy("cohort", "vessel", "metric").agg(F.avg("value").alias("mean"), robust.std1("value").alias("std"), F.median("value").alias("median"), F.count("value").alias("n"))


def representative(files: DataFrame) -> DataFrame:
    """The file nearest to its cohort's median, the smallest id if tied."""
    centre = files.groupBy("cohort", "metric").agg(F.median("value").alias("m"))
    gap = -F.round(F.abs(F.col("value") - F.col("m")), 9)
    return files.join(centre, ["cohort", "metric"]).groupBy("cohort", "metric").agg(F.max_by("acq", F.struct(gap, -F.col("acq"))).alias("acq"), F.max("m").alias("median"))


#: The metrics that a comparison of groups shows.
SELECTED_METRICS = (
    "mu_t_over_T", "RI", "PI", "R_VTI", "SF_VTI", "sigma_t_over_T", "W50_over_T", "W80_over_T", "E_LF_over_E_HF", "t_max_over_T", "t_min_over_T", "S_rise", "S_fall", "t_rise_over_T",
    "t_fall_over_T", "CF", "Delta_DTI", "gamma_t", "N_eff_over_T", "N_t_over_T", "Q_t_skew", "Q_t_width", "Q_d_skew", "Q_d_width", "v_end_over_vbar", "E_slope", "t50_over_T", "eta_h",
)


def selected(rows: DataFrame) -> DataFrame:
    """The rows of the metrics that a comparison shows."""
    return rows.where(F.col("metric").isin(*SELECTED_METRICS))


def dictionary(spark: SparkSession) -> DataFrame:
    """metric, unit, family of every shape metric: a table of fixed size."""
    families = {"timing": shape.TIMING, "quantiles": [*shape.T_QUANTILES, *shape.D_QUANTILES], "widths": shape.WIDTHS, "pulsatility": shape.PULSATILITY, "integrals": shape.VTI, "kinetics": shape.KINETICS, "spectral": shape.SPECTRAL, "support": shape.SUPPORT, "slope": shape.SLOPE}
    return spark.createDataFrame([(m, "s" if m in ("mu_t", "sigma_t") else "1", f) for f, names in families.items() for m in names], "metric string, unit string, family string")


def with_dictionary(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """Each metric row with its unit and family, null for one that the dictionary lacks."""
    return rows.join(F.broadcast(entries), "metric", "left")


def univariate(split: DataFrame) -> DataFrame:
    """One row a metric: sizes, means and medians of both groups, AUC, the best rule and how it does. ``split`` has the columns of ``scoring.splits`` and ``two_groups``."""
    correct = F.col("sensitivity") * F.col("n_g") + F.col("specificity") * F.col("n_c")
    return split.select(
        "metric", F.col("n_c").alias("n_control"), F.col("n_g").alias("n_pathology"), F.col("mean_c").alias("mean_control"), F.col("mean_g").alias("mean_pathology"), F.col("median_c").alias("median_control"), F.col("median_g").alias("median_pathology"),
        F.col("auc_greater").alias("auc_raw"), F.col("separability_auc").alias("auc_corrected"), F.when(F.col("auc_greater") >= 0.5, "greater").otherwise("less").alias("auc_direction"),
        "threshold", F.when(F.col("direction") == 1, ">=").otherwise("<=").alias("rule"), "sensitivity", "specificity", (F.col("sensitivity") + F.col("specificity") - 1).alias("youden"),
        (correct / (F.col("n_c") + F.col("n_g"))).alias("accuracy"), "balanced_accuracy", (2 * F.abs(F.col("auc_greater") - 0.5)).alias("separability"),
    )


def slice_axes(rows: DataFrame, axes: list[str], at: dict[str, int], value: str) -> DataFrame:
    """Two axes of an array held as rows, the others fixed."""
    for axis, i in at.items():
        rows = rows.where(F.col(axis) == i)
    return rows.select(*axes, value)


def manifest(rows: DataFrame) -> DataFrame:
    """Per file its pipelines, how many metric paths each has, and the sorted paths, as JSON."""
    each = rows.groupBy("acq", "pipeline").agg(F.sort_array(F.collect_set("path")).alias("paths"))
    whole = each.groupBy("acq").agg(F.sort_array(F.collect_list(F.struct("pipeline", F.size("paths").alias("count"), "paths"))).alias("pipelines"))
    return whole.select("acq", F.size("pipelines").alias("n_pipelines"), F.to_json(F.struct("acq", "pipelines")).alias("manifest"))


def write_csv(df: DataFrame, path: str) -> None:
    """One file with a header, for a report's few rows."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def to_latex(df: DataFrame, most: int = 10_000) -> str:
    """A report's rows as a tabular; refused above ``most`` rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    cell = lambda x: "NA" if x is None else (f"{x:.4g}" if isinstance(x, float) else str(x)).replace("\\", r"\textbackslash{}").replace("_", r"\_").replace("%", r"\%").replace("&", r"\&")
    lines = [" & ".join(map(cell, r)) + r" \\" for r in [df.columns, *rows]]
    return "\n".join([r"\begin{tabular}{" + "l" * len(df.columns) + "}", lines[0], r"\hline", *lines[1:], r"\end{tabular}"])


def to_html(df: DataFrame, title: str, most: int = 10_000) -> str:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    cells = lambda tag, r: "<tr>" + "".join(f"<{tag}>{html.escape('' if x is None else str(x))}</{tag}>" for x in r) + "</tr>"
    return f"<!DOCTYPE html><html><head><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><table>{cells('th', df.columns)}{''.join(cells('td', r) for r in rows)}</table></body></html>"
