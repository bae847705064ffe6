"""Variability and heterogeneity of segment metrics: descriptors, scores, rankings, contrasts, separation.

Input rows are (acq, cohort, metric, beat, branch, radius, value); the cohort
``control`` is compared with every other one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsecohort.functions import robust, special
from pulsecohort.functions.robust import EPS

SPATIAL = ["STD_seg_medbeat", "IQR_seg_medbeat", "MAD_seg_medbeat", "CV_seg_medbeat"]
TEMPORAL = ["STD_beat_medseg", "IQR_beat_medseg", "MAD_beat_medseg", "CV_beat_medseg"]
LEVEL = "MED_seg_medbeat"
TOP = 10
FILE = ["acq", "cohort", "metric"]


def finite(rows: DataFrame) -> DataFrame:
    return rows.where("value is not null and not isnan(value) and abs(value) < double('inf')")


def higher_metrics(rows: DataFrame) -> DataFrame:
    """Nine descriptors of each acquisition and metric: over segments then beats, and over beats then segments."""
    segment = ["branch", "radius"]
    blocks = finite(rows).groupingSets([[*FILE, "beat"], [*FILE, *segment]], *FILE, "beat", *segment).agg(F.grouping("beat").alias("_over_beats"), *robust.block_statistics("value"))
    of = lambda c, over_beats: F.median(F.when(F.col("_over_beats") == over_beats, F.col(c)))
    names = ["std", "iqr", "mad", "cv"]
    spatial = [of("median", 0).alias(LEVEL), *[of(c, 0).alias(f"{c.upper()}_seg_medbeat") for c in names]]
    return blocks.groupBy(*FILE).agg(*spatial, *[of(c, 1).alias(f"{c.upper()}_beat_medseg") for c in names])


def prefer(rows: DataFrame, order: list[str], source: str = "source") -> DataFrame:
    """Of the sources that have an acquisition's metric the first in ``order``: whole, not value by value."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col(source))
    best = rows.where(rank > 0).groupBy("acq", "metric").agg(F.min(rank).alias("_best"))
    return rows.join(best, ["acq", "metric"]).where(rank == F.col("_best")).drop("_best")


def normalised(higher: DataFrame, descriptors: list[str]) -> DataFrame:
    """Each descriptor over the level's size; a coefficient of variation as it is."""
    size = F.abs(LEVEL) + EPS
    return higher.select(*FILE, *[(F.col(d) if d.startswith("CV") else F.col(d) / size).alias(d) for d in descriptors])


def scores(higher: DataFrame, descriptors: list[str]) -> DataFrame:
    """Mean of an acquisition's normalised descriptors that are there."""
    n = normalised(higher, descriptors)
    have = F.filter(F.array(*[F.col(d) for d in descriptors]), lambda x: x.isNotNull())
    mean = F.try_divide(F.aggregate(have, F.lit(0.0), lambda a, x: a + x), F.size(have))
    return n.select(*FILE, mean.alias("value")).where("value is not null")


def long_descriptors(higher: DataFrame, descriptors: list[str]) -> DataFrame:
    return normalised(higher, descriptors).unpivot(FILE, descriptors, "descriptor", "value").where("value is not null")


def group_table(higher: DataFrame, descriptors: list[str]) -> DataFrame:
    """mean, std and n of each descriptor by cohort and metric."""
    rows = higher.unpivot(FILE, [LEVEL, *descriptors], "descriptor", "value")
    return rows.groupBy("cohort", "metric", "descriptor").agg(F.avg("value").alias("mean"), robust.std1("value").alias("std"), F.count("value").alias("n"))


def paired_medians(scored: DataFrame, control: str = "control") -> DataFrame:
    """(cohort, metric, control median, group median) of every cohort but the control."""
    m = scored.groupBy("cohort", "metric").agg(F.median("value").alias("m"))
    c = m.where(F.col("cohort") == control).select("metric", F.col("m").alias("control_median"))
    return m.where(F.col("cohort") != control).join(c, "metric").select("cohort", "metric", "control_median", F.col("m").alias("group_median"))


def _top(df: DataFrame, order: list, top: int | None = TOP) -> DataFrame:
    out = df.withColumn("rank", F.row_number().over(Window.partitionBy("cohort").orderBy(*order, "metric")))
    return out if top is None else out.where(F.col("rank") <= top)


def ranking(scored: DataFrame, ascending: bool = False, top: int = TOP) -> DataFrame:
    """The most (or least) variable metrics by the mean of both medians."""
    m = paired_medians(scored).withColumn("overall", (F.col("control_median") + F.col("group_median")) / 2)
    key = F.round("overall", 9)
    return _top(m, [key.asc() if ascending else key.desc()], top)


def contrast(scored: DataFrame, top: int = TOP) -> DataFrame:
    """The metrics whose medians differ most as a ratio."""
    m = paired_medians(scored)
    a, b = F.abs("control_median"), F.abs("group_median")
    m = m.where((a >= EPS) | (b >= EPS)).withColumn("ratio", F.greatest(a, b) / (F.least(a, b) + EPS))
    m = m.withColumn("more_variable", F.when(F.col("group_median") >= F.col("control_median"), F.col("cohort")).otherwise("control"))
    return _top(m, [F.round("ratio", 6).desc()], top)


def against_control(rows: DataFrame, keys: list[str], control: str = "control") -> DataFrame:
    """Rows of each other cohort beside the control's, marked by ``pathology``; keys get the cohort."""
    others = rows.where(F.col("cohort") != control).withColumn("pathology", F.lit(True))
    # cohorts are few (folder names), so the controls are repeated by an array of them and not by a join
    names = others.agg(F.collect_set("cohort").alias("cohorts")).withColumn("pathology", F.lit(False))
    mine = rows.where(F.col("cohort") == control).drop("cohort").withColumn("pathology", F.lit(False))
    mine = mine.join(F.broadcast(names), "pathology").withColumn("cohort", F.explode("cohorts"))
    return others.unionByName(mine.select(*others.columns))


def separation(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Twelve estimators of how far each cohort's values lie from the control's, by cohort and ``keys``."""
    both = against_control(rows, keys)
    by = ["cohort", *keys]
    g = robust.two_groups(both, by, "value", "pathology")
    r = robust.rank_statistics(both, by, "value", "pathology").select(*by, "u", "ties", "auc")
    t = robust.best_threshold(both, by, "value", "pathology").select(*by, "threshold", "direction", "sensitivity", "specificity")
    low, high = robust.difference_ci95()
    out = g.join(r, by, "left").join(t, by, "left").withColumn("d", robust.cohen_d())
    p = special.mann_whitney(F.col("u"), F.col("n_g"), F.col("n_c"), F.col("ties"))
    return out.select(
        *by, "n_c", "n_g", F.col("median_c").alias("control_median"), F.col("median_g").alias("group_median"),
        F.when(F.col("median_g") > F.col("median_c"), F.col("cohort")).otherwise("control").alias("more_variable"), p.alias("p_mann_whitney"), F.col("d").alias("cohen_d"),
        low.alias("ci_low"), high.alias("ci_high"), F.greatest("auc", 1 - F.col("auc")).alias("auc_separability"), "sensitivity", "specificity", special.overlap(F.col("d")).alias("overlap"),
    )


def separation_table(separated: DataFrame, metrics: list[str]) -> DataFrame:
    """One row an estimator, one column a metric."""
    names = ["n_c", "n_g", "control_median", "group_median", "p_mann_whitney", "cohen_d", "ci_low", "ci_high", "auc_separability", "sensitivity", "specificity", "overlap"]
    long = separated.select("cohort", "metric", *[F.col(n).cast("double").alias(n) for n in names]).unpivot(["cohort", "metric"], names, "estimator", "value")
    return long.groupBy("cohort", "estimator").pivot("metric", metrics).agg(F.first("value"))


def auc_ranking(separated: DataFrame) -> DataFrame:
    return _top(separated.where("auc_separability is not null"), [F.round("auc_separability", 9).desc()], None)


def mann_whitney_ranking(separated: DataFrame) -> DataFrame:
    out = separated.where("p_mann_whitney is not null").withColumn("median_difference", F.col("group_median") - F.col("control_median"))
    return _top(out, [F.round("p_mann_whitney", 9).asc()], None).select("cohort", "metric", "n_c", "n_g", "control_median", "group_median", "median_difference", "p_mann_whitney", "rank")


def descriptor_pvalues(higher: DataFrame, descriptors: list[str]) -> DataFrame:
    """p of each descriptor and of their mean score, one column each."""
    rows = long_descriptors(higher, descriptors).unionByName(scores(higher, descriptors).withColumn("descriptor", F.lit("score")))
    p = separation(rows, ["metric", "descriptor"]).select("cohort", "metric", "descriptor", "p_mann_whitney")
    return p.groupBy("cohort", "metric").pivot("descriptor", [*descriptors, "score"]).agg(F.first("p_mann_whitney"))


def formatted(mean: str, std: str, digits: int = 3):
    return F.format_string(f"%.{digits}g ± %.{digits}g", F.col(mean), F.col(std))
