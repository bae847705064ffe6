"""Batch runs: selected pipelines over waveforms, then postprocesses, with failures as rows and not as an end."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsecohort.functions import wave
from pulsecohort.operators import absolute, filters, harmonic, lowrank, patients, reports, scoring, shape, variability, windkessel, womersley
from pulsecohort.plans import registry
from pulsecohort.plans.registry import pipeline, postprocess
from pulsecohort.sources import scratch

LONG = ["acq", "cohort", "vessel", "representation", "beat", "branch", "radius"]


@pipeline("waveform_shape_metrics", "39 shape metrics of each waveform")
def _shape(waveforms: DataFrame) -> DataFrame:
    return shape.long_form(shape.shape_metrics(waveforms), shape.METRICS)


@pipeline("waveform_shape_metrics_denoised", "the same of denoised waveforms")
def _denoised(waveforms: DataFrame) -> DataFrame:
    return shape.long_form(shape.shape_metrics(filters.denoise(waveforms).where("status_code = 0").select(*waveforms.columns)), shape.METRICS)


@pipeline("waveform_shape_metrics_filter_sweep", "six metrics under six filters")
def _sweep(waveforms: DataFrame) -> DataFrame:
    wide = filters.filter_sweep(waveforms).withColumnRenamed("config", "representation")
    return shape.long_form(wide, filters.SWEEP_METRICS)


@pipeline("absolute_waveform_metrics", "74 absolute metrics of each waveform")
def _absolute(waveforms: DataFrame) -> DataFrame:
    return shape.long_form(absolute.absolute_metrics(waveforms), absolute.METRICS)


@pipeline("waveform_harmonic_organization", "coherence, phase locking and spread of normalised harmonics")
def _harmonic(waveforms: DataFrame) -> DataFrame:
    o = harmonic.organisation(harmonic.normalised(waveforms), harmonic.OVER_LOCATIONS)
    names = ["coherence", "plv", "spread", "occupancy"]
    wide = o.withColumn("cohort", F.lit(None).cast("string")).withColumn("branch", F.lit(None).cast("int")).withColumn("radius", F.lit(None).cast("int"))
    return wide.unpivot([*LONG, "h"], names, "metric", "value").withColumn("metric", F.concat_ws("_h", "metric", "h")).drop("h")


@pipeline("lowrank_pulsatility_metrics", "energy shares of the pulsatility modes")
def _lowrank(waveforms: DataFrame) -> DataFrame:
    m = lowrank.pulsatility_modes(waveforms)
    wide = m.withColumn("cohort", F.lit(None).cast("string")).withColumns({c: F.lit(None).cast("int") for c in ("beat", "branch", "radius")})
    return wide.unpivot(LONG, ["eta1", "eta2", "eta3", "eta23", "effective_rank", "participation_ratio"], "metric", "value")


def _long(wide: DataFrame, names: list[str]) -> DataFrame:
    """Rows of the long form of a table that has some of its keys; the others are null."""
    kinds = {"cohort": "string", "beat": "int", "branch": "int", "radius": "int"}
    for k, t in kinds.items():
        if k not in wide.columns:
            wide = wide.withColumn(k, F.lit(None).cast(t))
    return wide.select(*LONG, *[F.col(n).cast("double").alias(n) for n in names]).unpivot(LONG, names, "metric", "value")


@pipeline("waveform_harmonic_summary", "energy, rolloff and phase organisation of each waveform's harmonics")
def _summary(waveforms: DataFrame) -> DataFrame:
    return shape.long_form(shape.harmonic_summary(waveforms), [*shape.ENERGY, *shape.ROLLOFF, *shape.PHASE])


@pipeline("waveform_harmonic_organization_SVD", "leading complex mode, its heterogeneity, and the rank-one tensor")
def _svd(waveforms: DataFrame) -> DataFrame:
    n = harmonic.normalised(waveforms)
    modes = lowrank.rank_one(n)
    scores = lowrank.score_heterogeneity(lowrank.rank_one_scores(n, modes))
    out = _long(modes, ["sigma1", "eta1", "rank_participation"]).unionByName(_long(scores, ["H_b", "H_kr"]))
    return out.unionByName(_long(lowrank.tensor_modes(n).withColumnsRenamed({"lambda": "tensor_lambda", "eta": "tensor_eta"}), ["tensor_lambda", "tensor_eta"]))


@pipeline("Windkessel_RC", "delay and time constant between artery and vein by three methods, and their consensus")
def _windkessel(waveforms: DataFrame) -> DataFrame:
    keys = ["acq", "cohort", "representation", "beat", "branch", "radius"]
    a = waveforms.where("vessel = 'artery'").select(*keys, "T", F.col("v").alias("qa"))
    v = waveforms.where("vessel = 'vein'").select(*keys, F.col("v").alias("qv"))
    agreed = windkessel.consensus(windkessel.fits(a.join(v, keys).where("size(qa) = size(qv)")))
    return _long(agreed.withColumn("vessel", F.lit("artery to vein")), ["tau_consensus_median", "delay_consensus_median", "tau_intermethod_range", "methods_valid_count"])


@pipeline("ProfileAnalysis", "parabola through each profile, and relaxation of its peak along a branch")
def _profiles(waveforms: DataFrame) -> DataFrame:
    keys = ["acq", "vessel", "representation", "beat", "branch", "radius"]
    fitted = womersley.parabola(waveforms, keys, "v")
    lines = womersley.relaxation(fitted, ["acq", "vessel", "representation", "beat"])
    return _long(fitted, ["A", "x0", "y0"]).unionByName(_long(lines, ["slope", "intercept", "r2"]))


@pipeline("WomersleyModeling", "wall motion of the profiles of a segment over its beats")
def _womersley(waveforms: DataFrame) -> DataFrame:
    frames = waveforms.where("vessel = 'artery'").select("acq", "branch", "radius", F.col("beat").alias("t"), F.col("v").alias("profile"))
    found = womersley.womersley(frames).withColumn("vessel", F.lit("artery")).withColumn("representation", F.lit("raw"))
    return _long(found, ["r0", "jump_share"])


@pipeline("modal_analysis", "singular values of a movie's beats, radius being the mode; takes frames (acq, t, m0, m2)")
def _modal(frames: DataFrame) -> DataFrame:
    m = lowrank.modal_movie(frames).withColumn("vessel", F.lit(None).cast("string")).withColumn("representation", F.lit("movie"))
    return _long(m.withColumn("radius", F.col("mode")), ["sigma"])


@postprocess("Fixed thresholds", "evaluation against the fixed panel", after=[["waveform_shape_metrics"], ["waveform_harmonic_summary"]])
def _fixed(metrics: DataFrame) -> dict[str, DataFrame]:
    values = metrics.where(F.col("pipeline").isin("waveform_shape_metrics", "waveform_harmonic_summary")).groupBy("acq", "metric").agg(F.median("value").alias("value"))
    rows = patients.evaluate_metrics(values, patients.panel(metrics.sparkSession))
    return {"metrics": rows, "patients": patients.evaluate(rows)}


@postprocess("Group comparison", "statistics of the shown metrics by cohort, and the file nearest to each median", after=[["waveform_shape_metrics", "waveform_shape_metrics_denoised"]])
def _groups(metrics: DataFrame) -> dict[str, DataFrame]:
    values = reports.selected(scoring.per_file(metrics))
    return {"groups": reports.group_stats(values), "representative": reports.representative(values.select("acq", "cohort", "metric", "value"))}


@postprocess("Metrics manifest", "what each file has", after=[])
def _manifest(metrics: DataFrame) -> dict[str, DataFrame]:
    return {"manifest": reports.manifest(metrics.select("acq", "pipeline", F.concat_ws("/", "vessel", "representation", "metric").alias("path")))}


@postprocess("HTML summary", "median and deviation of each metric of a file by vessel", after=[])
def _html(metrics: DataFrame) -> dict[str, DataFrame]:
    return {"files": reports.file_summary(metrics)}


@postprocess("Variability and heterogeneity", "rankings, contrasts and separation of segment metrics", after=[["waveform_shape_metrics", "waveform_shape_metrics_denoised"]])
def _variability(metrics: DataFrame) -> dict[str, DataFrame]:
    rows = variability.prefer(metrics.withColumn("source", F.col("pipeline")), ["waveform_shape_metrics_denoised", "waveform_shape_metrics"])
    higher = variability.higher_metrics(rows)
    scored = variability.scores(higher, variability.SPATIAL)
    return {"groups": variability.group_table(higher, variability.SPATIAL), "most": variability.ranking(scored), "least": variability.ranking(scored, True), "contrast": variability.contrast(scored), "auc": variability.auc_ranking(variability.separation(scored, ["metric"]))}


@postprocess("Composite Scoring", "optimal splits and composite scores of two cohorts", after=[["waveform_shape_metrics"]])
def _scoring(metrics: DataFrame, control: str = "control") -> dict[str, DataFrame]:
    rows = metrics.where("pipeline = 'waveform_shape_metrics'")
    values = scoring.two_cohorts(scoring.per_file(rows), control)
    split = scoring.splits(values)
    top = scoring.top_by_auc(split)
    panel = top.select("vessel", "representation", "metric", "threshold", "direction", "control_std")
    parts = scoring.contributions(rows, panel)
    size = scoring.TOP
    return {"splits": split, "top": top, "contributions": parts, "scores": scoring.panel_scores(parts, size), "usefulness": scoring.ordered_usefulness(scoring.usefulness(parts, size), split)}


@dataclass
class Run:
    metrics: DataFrame | None = None
    reports: dict[str, dict[str, DataFrame]] = field(default_factory=dict)
    failures: list[tuple[str, str]] = field(default_factory=list)
    #: Waveforms that nothing could be computed on, a row each.
    refused: DataFrame | None = None
    seconds: dict[str, float] = field(default_factory=dict)


def usable(waveforms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Waveforms that can be computed on, and a failure row for each of the rest: one bad row doesn't end a run."""
    why = F.when(F.col("v").isNull() | (F.size("v") == 0), "no samples").when(~F.coalesce((F.col("T") > 0) & ~F.isnan("T"), F.lit(False)), "bad period").when(wave.count(wave.clean(F.col("v"))) == 0, "no finite sample")
    marked = waveforms.withColumn("_why", why)
    return marked.where("_why is null").drop("_why"), marked.where("_why is not null").select("acq", "beat", "branch", "radius", F.col("_why").alias("message"))


def isolated(df: DataFrame, f, schema: str) -> DataFrame:
    """mapInArrow of a function of one row (dict to dict): a row that raises gives nulls and its message in ``error``."""

    def run(batches):
        for b in batches:
            out, errors = [], []
            for row in b.to_pylist():
                try:
                    out.append(f(row))
                    errors.append(None)
                except Exception as e:
                    out.append({})
                    errors.append(f"{type(e).__name__}: {e}")
            names = [c.split()[0] for c in schema.split(", ")]
            arrays = [pa.array([r.get(n) for r in out]) for n in names]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(errors, pa.string())], names=[*names, "error"])

    return df.mapInArrow(run, f"{schema}, error string")


def run(waveforms: DataFrame, pipelines: list[str], postprocesses: list[str] = (), settle=scratch.settle) -> Run:
    """Run pipelines, then postprocesses over what they gave; unknown names and unmet requirements are refused before anything runs.

    Waveforms that can't be used become rows of ``refused``. A pipeline's rows,
    and a report's, are computed and written by ``settle`` before the next one
    begins, so that what fails while it runs is a failure of that one alone.
    """
    unknown = [n for n in (*pipelines, *postprocesses) if n not in registry.PIPELINES and n not in registry.POSTPROCESSES]
    if unknown:
        raise ValueError(f"unknown: {', '.join(unknown)}")
    for p in postprocesses:
        if registry.unmet(p, set(pipelines)):
            raise ValueError(f"{p} needs one of {registry.unmet(p, set(pipelines))[0]}")
    out = Run()
    framed = "v" not in waveforms.columns
    good, out.refused = (waveforms, None) if framed else usable(waveforms)
    for name in pipelines:
        began = time.time()
        try:
            rows = settle(registry.PIPELINES[name](good).withColumn("pipeline", F.lit(name)))
            out.metrics = rows if out.metrics is None else out.metrics.unionByName(rows)
        except Exception as e:
            out.failures.append((name, f"{type(e).__name__}: {e}"))
        out.seconds[name] = time.time() - began
    for name in postprocesses:
        began = time.time()
        try:
            out.reports[name] = {k: settle(df) for k, df in registry.POSTPROCESSES[name](out.metrics).items()}
        except Exception as e:
            out.failures.append((name, f"{type(e).__name__}: {e}"))
        out.seconds[name] = time.time() - began
    return out
