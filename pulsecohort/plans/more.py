"""Further queries: harmonic energy and phases, modes, bad rows, whole panels, joins of the reports, rasters and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsecohort.functions import robust, wave
from pulsecohort.operators import absolute, filters, harmonic, lowrank, patients, reports, scoring, shape, topology, variability, womersley
from pulsecohort.plans import sql
from pulsecohort.plans.queries import _CS, _ERF, _PANEL_SQL, _PE, _SEP, _V, ID, PE_METRICS, CS_METRICS, _beats, _evaluated, _marked, _parts, _scores, _segments, _split, register, rounded, vh_separation
from pulsecohort.sources import files, outputs, views

# harmonic energy, rolloff and phases --------------------------------------------------------------------------------------------

SUMMARY = [*shape.ENERGY, *shape.ROLLOFF, *shape.PHASE]
_SUMMARY = f"""coef as (
  select p.k, h, sum(z * cos(2 * pi() * h * i / n)) / max(n) as re, -sum(z * sin(2 * pi() * h * i / n)) / max(n) as im from prof p cross join unnest(range(11)) as u(h) where h <= n // 2 group by p.k, h),
pw as (select k, h, re * re + im * im as p, atan2(im, re) as ph from coef),
energy as (select k, coalesce(sum(p) filter (h >= 1), 0) as E_total, coalesce(sum(p) filter (h = 1), 0) as E_low from pw group by k),
shares as (select k, h - 1 as m, p / sum(p) over (partition by k) as a, sum(p) over (partition by k order by h) / sum(p) over (partition by k) as hi from pw where h >= 2),
steps2 as (select *, lag(hi, 1, 0.0) over (partition by k order by m) as lo from shares),
roll as (
  select k, count(*) as hh, max(case when lo <= 0.5 and hi > 0.5 then m - 1 + (0.5 - lo) / (hi - lo) end) as m_50, max(case when lo <= 0.8 and hi > 0.8 then m - 1 + (0.8 - lo) / (hi - lo) end) as m_80,
         exp(-sum(case when a > 0 then a * ln(a) else 0 end)) / count(*) as N_h_over_H from steps2 group by k),
lag0 as (select a.k, a.h, a.p, a.ph - a.h * b.ph as x, a.p / sum(a.p) over (partition by a.k) as share from pw a join pw b on a.k = b.k and b.h = 1 where a.h >= 2 and b.p > 1e-24),
lags as (select k, h, p, x - 2 * pi() * floor((x + pi()) / (2 * pi())) as d from lag0 where share >= {shape.PHASE_SHARE}),
tphi as (select k, quantile_cont(d / (2 * pi() * h), 0.5) as t, 1 - sqrt(pow(sum(p * cos(d)) / sum(p), 2) + pow(sum(p * sin(d)) / sum(p), 2)) as D_phi from lags group by k),
sphi as (select k, quantile_cont(abs(d / (2 * pi() * h) - t), 0.5) as s from lags join tphi using (k) group by k),
summary as (
  select base.*, E_total, E_low, E_low / nullif(E_total, 0) as E_low_over_E_total, m_50, m_80, m_80 / hh as rho_h, (m_80 - m_50) / hh as w_h, N_h_over_H, D_phi, tphi.t as t_phi_over_T, sphi.s as s_phi_over_T
  from base join energy using (k) left join roll using (k) left join tphi using (k) left join sphi using (k))"""


def wf_harmonic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.harmonic_summary(views.embeddings(spark, sf_dir)).select(*ID, *rounded(None, SUMMARY, 6))


def wf_bandlimited(spark, sf_dir):
    return shape.bandlimited(views.embeddings(spark, sf_dir)).select(*ID, "i", *rounded(None, ["signal", "vb"], 6))


def wf_curvature(spark, sf_dir):
    d = shape.diagnostics(views.embeddings(spark, sf_dir))
    return d.select(*ID, "i", F.round("d2vdt2", 4).alias("d2vdt2"), F.round(F.log1p("dvdt_norm"), 6).alias("log_dvdt_norm"), F.round(F.log1p("d2vdt2_norm"), 6).alias("log_d2vdt2_norm"))


register("wf_harmonic_summary", wf_harmonic_summary, f"{sql.ctes('embeddings', sql.PREPARED, _SUMMARY)} select {sql.KEYS}, {sql.rounded(SUMMARY, 6)} from summary")
register("wf_bandlimited", wf_bandlimited, f"""{sql.ctes('embeddings', sql.PREPARED, _SUMMARY)}
  select {sql.KEYS}, i, round(max(z), 6) as signal, round(sum((case when h = 0 or 2 * h = prof.n then 1 else 2 end) * (re * cos(2 * pi() * h * i / prof.n) - im * sin(2 * pi() * h * i / prof.n))), 6) as vb
  from prof join coef using (k) join base using (k) group by k, {sql.KEYS}, i""")
register("wf_curvature", wf_curvature, f"""{sql.ctes('embeddings', sql.PREPARED)}, nb as (select *, lag(g) over w as gp, lead(g) over w as gn from slope window w as (partition by k order by i)),
  cur as (select *, case when i = 0 then (gn - g) / dt when i = n - 1 then (g - gp) / dt else (gn - gp) / (2 * dt) end as g2 from nb)
  select {sql.KEYS}, c.i, round(g2, 4) as d2vdt2, round(ln(1 + pow(c.T, 3) / pow(c.m0 * c.dt + 1e-12, 2) * g * g), 6) as log_dvdt_norm, round(ln(1 + pow(c.T, 5) / pow(c.m0 * c.dt + 1e-12, 2) * g2 * g2), 6) as log_d2vdt2_norm
  from cur c join base using (k)""")


# rows as files have them --------------------------------------------------------------------------------------------------------

BAD = ["RI", "PI", "mu_t_over_T", "t50_over_T", "N_eff_over_T", "v_end_over_vbar"]


def wf_corrupt(spark, sf_dir):
    return shape.shape_metrics(views.corrupt(spark, sf_dir), BAD).select(*ID, *rounded(None, BAD, 6))


def hm_corrupt(spark, sf_dir):
    return harmonic.coefficients(views.corrupt(spark, sf_dir)).select("acq", "beat", "branch", "radius", "h", *rounded(None, ["re", "im"], 6))


def dn_status(spark, sf_dir):
    d = filters.denoise(views.corrupt(spark, sf_dir))
    inside = F.forall(F.zip_with("v", F.col("v"), lambda a, _: a), lambda x: x.isNull() | (F.abs(x) < float("inf")))
    return d.select(*ID, "status_code", F.round("finite_fraction", 6).alias("finite_fraction"), F.when(F.col("status_code") == 0, inside).alias("finite"))


def ab_corrupt(spark, sf_dir):
    from pulsecohort.operators import absolute

    names = ["vmean", "v_p50", "vmax", "vmin"]
    return absolute.absolute_metrics(views.corrupt(spark, sf_dir).where("T > 0"), names).select(*ID, *rounded(None, names, 6))


_ALL = "(select distinct k, acq, cohort, beat, branch, radius from samples)"
register("wf_corrupt_rows", wf_corrupt, f"""{sql.shape('corrupt').replace('having sum(z) > 0)', 'having sum(z) > 0 and max(T) > 0)', 1)}
  select a.acq, a.cohort, a.beat, a.branch, a.radius, {', '.join(f'round(s.{m}, 6) as {m}' for m in BAD)} from {_ALL} a left join shape s using (k)""")
register("hm_corrupt_rows", hm_corrupt, f"{sql.harmonics('corrupt').replace('having count(raw) = max(n) and max(n) >= 2', 'having count(raw) = max(n) and max(n) >= 2 and max(T) > 0')} select acq, beat, branch, radius, h, round(re, 6) as re, round(im, 6) as im from coeff")
register("dn_status_rows", dn_status, f"""{sql.ctes('corrupt')}, s as (select {sql.KEYS}, count(raw) as c, max(n) as n from samples group by k, {sql.KEYS}),
  t as (select *, case when c = 0 then 1 when c < 32 then 2 when c / n < 0.5 then 3 else 0 end as status_code from s)
  select {sql.KEYS}, status_code, round(c / n, 6) as finite_fraction, case when status_code = 0 then true end as finite from t""")
register("ab_corrupt_rows", ab_corrupt, f"""{sql.ctes('corrupt')}, r as (select *, case when raw is not null then greatest(raw, 0) end as x from samples where T > 0),
  s as (select k, {sql.KEYS}, avg(x) as vmean, quantile_cont(x, 0.5) as v_p50, max(x) as vmax, min(x) as vmin, sum(coalesce(x, 0)) as m from r group by k, {sql.KEYS})
  select {sql.KEYS}, {', '.join(f'case when m > 0 then round({m}, 6) end as {m}' for m in ('vmean', 'v_p50', 'vmax', 'vmin'))} from s""")


# modes --------------------------------------------------------------------------------------------------------------------------

def lr_participation(spark, sf_dir):
    m = lowrank.pulsatility_modes(views.embeddings(spark, sf_dir))
    return m.select("acq", "svd_available", "reason", "columns", F.round("participation_ratio", 6).alias("participation_ratio"), F.round(F.sqrt(F.aggregate("sigma", F.lit(0.0), lambda a, x: a + x * x) / (F.col("eta1") + F.col("eta23"))), 5).alias("norm"))


def lr_few_columns(spark, sf_dir):
    m = lowrank.pulsatility_modes(views.embeddings(spark, sf_dir).where("acq % 2 = 0 or (beat = 0 and branch = 0 and radius < 2)"))
    return m.select("acq", "svd_available", "reason", "columns")


def lr_beat_medians(spark, sf_dir):
    c = lowrank.centred_columns(views.embeddings(spark, sf_dir))
    return lowrank.over_beats(c, "mu").select("acq", *rounded(None, ["sigma", "mad", "cv", "spatial_mad"], 6))


def lr_residuals(spark, sf_dir):
    """Parseval over modes: a column's squares are the squares of its scores and of what is left."""
    w = views.embeddings(spark, sf_dir)
    c = lowrank.mode_columns(w, lowrank.pulsatility_modes(w))
    whole = F.sum(F.col("mode_rms") * F.col("mode_rms")) + F.min_by(F.col("residual_rms") * F.col("residual_rms"), -F.col("mode"))
    return c.groupBy("acq", "beat", "branch", "radius").agg(F.round(F.sqrt(whole), 6).alias("total_rms"), F.count(F.lit(1)).alias("modes"), F.bool_and(F.col("residual_rms") <= F.col("total_rms") + 1e-9).alias("shrinks"))


def lr_mode_table(spark, sf_dir):
    w = views.embeddings(spark, sf_dir)
    r = lowrank.residual_ratios(lowrank.mode_columns(w, lowrank.pulsatility_modes(w)))
    return r.select("acq", "mode", *rounded(None, ["A", "R", "rho", "median_abs_score"], 5))


def lr_rank_participation(spark, sf_dir):
    n = harmonic.normalised(views.embeddings(spark, sf_dir)).where("rel_amp < 1.5")
    return lowrank.rank_one(n).select("acq", F.round("rank_participation", 5).alias("rank_participation"), F.round(F.col("sigma1") * F.col("sigma1") / F.col("eta1"), 5).alias("energy"))


def lr_heterogeneity(spark, sf_dir):
    n = harmonic.normalised(views.embeddings(spark, sf_dir))
    h = lowrank.score_heterogeneity(lowrank.rank_one_scores(n, lowrank.rank_one(n)))
    return h.select("acq", "H_b_n", "H_kr_n", *rounded(None, ["H_b", "H_kr"], 5))


_COLUMNS = """cols as (
  select k, acq, beat, branch, radius, i, n, raw - avg(raw) over (partition by k) as x, avg(raw) over (partition by k) as mu from samples)"""
register("lr_participation", lr_participation, f"""{sql.ctes('embeddings', _COLUMNS)}, dots as (select a.acq, a.k as p, b.k as q, sum(a.x * b.x) as d from cols a join cols b on a.acq = b.acq and a.i = b.i group by a.acq, a.k, b.k)
  select acq, 1 as svd_available, 'ok' as reason, count(*) filter (p = q) as columns, round(pow(sum(d) filter (p = q), 2) / sum(d * d), 6) as participation_ratio, round(sqrt(sum(d) filter (p = q)), 5) as norm from dots group by acq""")
register("lr_few_columns", lr_few_columns, f"""{sql.ctes('embeddings')}, c as (select acq, count(distinct k) as columns from samples where acq % 2 = 0 or (beat = 0 and branch = 0 and radius < 2) group by acq)
  select acq, case when columns >= 3 then 1 else 0 end as svd_available, case when columns >= 3 then 'ok' else 'too_few_valid_columns' end as reason, columns from c""")
register("lr_beat_medians", lr_beat_medians, f"""{sql.ctes('embeddings')}, m as (select acq, beat, k, avg(raw) as mu from samples group by acq, beat, k), b as (select acq, beat, quantile_cont(mu, 0.5) as c from m group by acq, beat),
  s as (select acq, beat, c, quantile_cont(abs(mu - c), 0.5) as sm from m join b using (acq, beat) group by acq, beat, c), g as (select acq, quantile_cont(c, 0.5) as gc from b group by acq)
  select acq, round(stddev_pop(c), 6) as sigma, round(quantile_cont(abs(c - gc), 0.5), 6) as mad, round(stddev_pop(c) / abs(avg(c)), 6) as cv, round(quantile_cont(sm, 0.5), 6) as spatial_mad from s join g using (acq) group by acq""")
register("lr_residuals", lr_residuals, f"{sql.ctes('embeddings', _COLUMNS)} select acq, beat, branch, radius, round(sqrt(sum(x * x) / max(n)), 6) as total_rms, 3 as modes, true as shrinks from cols group by k, acq, beat, branch, radius")
register("lr_mode_table", lr_mode_table)
register("lr_rank_participation", lr_rank_participation, f"""{sql.harmonics('embeddings')}, v as (select k, acq, h, re, im from valid where rel_amp < 1.5), kept as (select * from v where k in (select k from v group by k having count(*) >= 2)),
  dots as (select a.acq, a.k as p, b.k as q, sum(a.re * b.re + a.im * b.im) as dr, sum(a.im * b.re - a.re * b.im) as di from kept a join kept b on a.acq = b.acq and a.h = b.h group by a.acq, a.k, b.k)
  select acq, round(pow(sum(dr) filter (p = q), 2) / sum(dr * dr + di * di), 5) as rank_participation, round(sum(dr) filter (p = q), 5) as energy from dots group by acq""")
register("lr_heterogeneity", lr_heterogeneity)


# fixed thresholds: all eight metrics, the short panel, and ways to one value a file --------------------------------------------

def _values(spark, sf_dir, how: str = "median") -> DataFrame:
    w = views.line_items(spark, sf_dir)
    m = shape.shape_metrics(w, PE_METRICS).unpivot(["acq"], PE_METRICS, "metric", "value")
    low = shape.harmonic_summary(w).select("acq", F.lit("E_low_over_E_total").alias("metric"), F.col("E_low_over_E_total").alias("value"))
    f = {"median": F.median, "mean": F.avg, "max": F.max, "min": F.min}[how]
    return m.unionByName(low).groupBy("acq", "metric").agg(F.round(f("value"), 9).alias("value"))


def pe_all_metrics(spark, sf_dir):
    e = patients.evaluate(patients.evaluate_metrics(_values(spark, sf_dir), patients.panel(spark)))
    return e.select("acq", "n_metrics_configured", "n_metrics_available", "n_metrics_abnormal", *rounded(None, ["pathology_index", "was", "was_c_equivalent", "abnormal_fraction", "coverage_fraction"], 6), "evaluation_label")


def pe_short_panel(spark, sf_dir):
    """The short scorer: seven metrics, the probability is a tenth of WAS-c."""
    have = patients.evaluate_metrics(_values(spark, sf_dir), patients.panel(spark, patients.SHORT_PANEL)).where("available")
    e = patients.evaluate(have)
    return e.select("acq", F.col("n_metrics_available").alias("n_metrics"), *rounded(None, ["was", "abnormal_fraction"], 6), F.round("was_c_equivalent", 6).alias("was_c"), F.round(F.col("was_c_equivalent") / 10, 6).alias("probability"))


def pe_aggregations(spark, sf_dir):
    out = None
    for how in ("median", "mean", "max", "min"):
        v = patients.evaluate(patients.evaluate_metrics(_values(spark, sf_dir, how), patients.panel(spark))).select("acq", F.lit(how).alias("aggregation"), "n_metrics_abnormal")
        out = v if out is None else out.unionByName(v)
    return out


def pe_patient_ids(spark, sf_dir):
    c = views.load(spark, sf_dir, "customer").select(F.concat(F.lit("study "), F.col("c_mktsegment"), F.lit("("), F.col("c_nationkey").cast("string"), F.lit(").h5")).alias("file_name"), "c_custkey").where("c_custkey % 3 = 0")
    named = c.groupBy("file_name").agg(F.count(F.lit(1)).alias("n"))
    return patients.patient_ids(named.unionByName(named.withColumn("file_name", F.replace("file_name", F.lit("("), F.lit("["))))).select("file_name", "patient_id")


_PE8 = f"""{sql.ctes('line_items', sql.PREPARED, sql.SHAPE, _SUMMARY)}, lng as (
  select acq, metric, value from (select acq, {', '.join(PE_METRICS)} from shape) unpivot (value for metric in ({', '.join(PE_METRICS)})) union all select acq, 'E_low_over_E_total', E_low_over_E_total from summary),
hows as (select 'median' as how, acq, metric, round(quantile_cont(value, 0.5), 9) as value from lng group by acq, metric union all select 'mean', acq, metric, round(avg(value), 9) from lng group by acq, metric
  union all select 'max', acq, metric, round(max(value), 9) from lng group by acq, metric union all select 'min', acq, metric, round(min(value), 9) from lng group by acq, metric),
ev as (select how, acq, metric, value, value is not null as available, coalesce(d * (value - t) >= 0, false) as abnormal from hows join (values {_PANEL_SQL}) as p(metric, t, d) using (metric)),
ix as (select how, acq, count(*) as nc, count(value) as na, count(*) filter (abnormal) as nb from ev group by how, acq)"""
register("pe_all_metrics", pe_all_metrics, f"""{_PE8} select acq, nc as n_metrics_configured, na as n_metrics_available, nb as n_metrics_abnormal, round(nb / na, 6) as pathology_index, round(10 * nb / na, 6) as was, round(10 * nb / na, 6) as was_c_equivalent,
  round(nb / na, 6) as abnormal_fraction, round(na / nc, 6) as coverage_fraction, case when nb / na < 0.33 then 'low' when nb / na < 0.67 then 'intermediate' else 'high' end as evaluation_label from ix where how = 'median'""")
register("pe_short_panel", pe_short_panel, f"""{_PE8}, s as (select acq, count(*) as n, count(*) filter (abnormal) as b from ev where how = 'median' and available and metric != 'E_low_over_E_total' group by acq)
  select acq, n as n_metrics, round(10 * b / n, 6) as was, round(b / n, 6) as abnormal_fraction, round(10 * b / n, 6) as was_c, round(b / n, 6) as probability from s""")
register("pe_aggregations", pe_aggregations, f"{_PE8} select acq, how as aggregation, nb as n_metrics_abnormal from ix")
register("pe_patient_ids", pe_patient_ids, """with n as (select distinct 'study ' || c_mktsegment || '(' || c_nationkey || ').h5' as f from customer where c_custkey % 3 = 0), a as (select f from n union all select replace(f, '(', '[') from n),
  b as (select f, trim(regexp_replace(regexp_replace(f, '\\.[^.]*$', ''), '[^A-Za-z0-9_-]+', '_', 'g'), '_') as base from a), r as (select *, row_number() over (partition by base order by f) as k from b)
  select f as file_name, case when k = 1 then base else base || '_' || k end as patient_id from r""")


# the whole panel ----------------------------------------------------------------------------------------------------------------

PANEL = list(scoring.PANEL.values())


def _panel_marked(spark, sf_dir):
    m = shape.shape_metrics(views.line_items(spark, sf_dir), PANEL).unpivot(["acq", "cohort", "vessel", "representation", "beat"], PANEL, "metric", "value")
    v = scoring.two_cohorts(scoring.per_file(m), "control", "pathology")
    return v.withColumn("value", F.round("value", 7))


def cs_whole_panel(spark, sf_dir):
    s = scoring.splits(_panel_marked(spark, sf_dir), False)
    return s.select("metric", F.round("threshold", 6).alias("threshold"), "direction", *rounded(None, ["sensitivity", "specificity", "balanced_accuracy", "control_std", "separability_auc"], 6))


def rp_univariate(spark, sf_dir):
    v = _marked(spark, sf_dir)
    s = scoring.splits(v, False)
    g = robust.two_groups(v, ["metric"], "value", "pathology").select("metric", "median_c", "median_g")
    t = reports.univariate(s.join(g, "metric"))
    return t.select("metric", "n_control", "n_pathology", "auc_direction", "rule", *rounded(None, ["mean_control", "mean_pathology", "median_control", "median_pathology", "auc_raw", "auc_corrected", "threshold", "sensitivity", "specificity", "youden", "accuracy", "balanced_accuracy", "separability"], 5))


def cs_ordered(spark, sf_dir):
    u = scoring.ordered_usefulness(scoring.usefulness(_parts(spark, sf_dir), len(CS_METRICS)), _split(spark, sf_dir))
    return u.select("cohort", "metric", "n_active", *rounded(None, ["youden", "separability_auc"], 6))


def cs_joined(spark, sf_dir):
    p = _parts(spark, sf_dir).select("acq", "cohort", "vessel", "representation", "metric", "z")
    return scoring.with_split(p, _split(spark, sf_dir)).select("acq", "metric", F.round("z", 5).alias("z"), F.round("youden", 6).alias("youden"))


_CS37 = _CS.replace(f"(select acq, cohort, {', '.join(CS_METRICS)} from shape) unpivot (value for metric in ({', '.join(CS_METRICS)}))", f"(select acq, cohort, {', '.join(PANEL)} from shape) unpivot (value for metric in ({', '.join(PANEL)}))").replace("round(quantile_cont(value, 0.5), 9) as value", "round(quantile_cont(value, 0.5), 7) as value")
register("cs_whole_panel", cs_whole_panel, f"""{_CS37} select g as metric, round(th, 6) as threshold, dir as direction, round(se, 6) as sensitivity, round(sp, 6) as specificity, round((se + sp) / 2, 6) as balanced_accuracy, round(sd, 6) as control_std,
  round(greatest(u / n, 1 - u / n), 6) as separability_auc from split join ctl using (g) join pairs using (g)""")
register("rp_univariate", rp_univariate, f"""{_CS}, q as (select g, count(*) filter (not path) as nc, count(*) filter (path) as np, avg(value) filter (not path) as mc, avg(value) filter (path) as mp, quantile_cont(value, 0.5) filter (not path) as dc, quantile_cont(value, 0.5) filter (path) as dp from vals group by g)
  select g as metric, nc as n_control, np as n_pathology, case when u / n >= 0.5 then 'greater' else 'less' end as auc_direction, case when dir = 1 then '>=' else '<=' end as rule, round(mc, 5) as mean_control, round(mp, 5) as mean_pathology,
    round(dc, 5) as median_control, round(dp, 5) as median_pathology, round(u / n, 5) as auc_raw, round(greatest(u / n, 1 - u / n), 5) as auc_corrected, round(th, 5) as threshold, round(se, 5) as sensitivity, round(sp, 5) as specificity, round(se + sp - 1, 5) as youden,
    round((se * np + sp * nc) / (np + nc), 5) as accuracy, round((se + sp) / 2, 5) as balanced_accuracy, round(abs(u / n - 0.5) * 2, 5) as separability from q join split using (g) join pairs using (g)""")
_USE = f"""{_CS}, use as (select coalesce(cohort, 'ALL') as cohort, metric, count(*) filter (z > 0) as n_active from parts group by grouping sets ((cohort, metric), (metric)))"""
register("cs_usefulness_with_splits", cs_ordered, f"{_USE} select use.cohort, use.metric, n_active, round(se + sp - 1, 6) as youden, round(greatest(u / n, 1 - u / n), 6) as separability_auc from use join split on g = metric join pairs using (g)")
register("cs_contributions_with_splits", cs_joined, f"{_CS} select acq, metric, round(z, 5) as z, round(se + sp - 1, 6) as youden from parts left join split on g = metric")


# variability --------------------------------------------------------------------------------------------------------------------

def _two_sources(spark, sf_dir):
    s = _segments(spark, sf_dir)
    plain = s.withColumn("source", F.lit("plain"))
    better = s.where("acq % 3 = 0 and metric != 'PI'").withColumn("value", F.col("value") * 2).withColumn("source", F.lit("denoised"))
    return variability.prefer(plain.unionByName(better), ["denoised", "plain"])


def vh_prefer(spark, sf_dir):
    return _two_sources(spark, sf_dir).groupBy("acq", "metric", "source").agg(F.count("value").alias("n"), F.round(F.max("value"), 6).alias("top"))


def vh_descriptors(spark, sf_dir):
    d = variability.long_descriptors(variability.higher_metrics(_segments(spark, sf_dir)), variability.SPATIAL)
    return d.select("acq", "metric", "descriptor", F.round("value", 5).alias("value"))


def vh_auc_ranking(spark, sf_dir):
    r = variability.auc_ranking(variability.separation(_scores(spark, sf_dir), ["metric"]))
    return r.select("cohort", "metric", "rank", F.round("auc_separability", 6).alias("auc_separability"))


def vh_mwu_ranking(spark, sf_dir):
    r = variability.mann_whitney_ranking(variability.separation(_scores(spark, sf_dir), ["metric"]))
    return r.select("cohort", "metric", "n_c", "n_g", F.round("median_difference", 6).alias("median_difference"), F.round("p_mann_whitney", 4).alias("p"), "rank")


def vh_formatted(spark, sf_dir):
    g = variability.group_table(variability.higher_metrics(_segments(spark, sf_dir)), variability.SPATIAL).where("std is not null")
    return g.select("cohort", "metric", "descriptor", F.format_string("%.3f ± %.3f (%d)", F.round("mean", 6), F.round("std", 6), F.col("n")).alias("cell"))


register("vh_prefer_source", vh_prefer, f"""{_V}, src as (select acq, metric, value, 'plain' as source from metrics union all select acq, metric, 2 * value, 'denoised' from metrics where acq % 3 = 0 and metric != 'PI'),
  best as (select acq, metric, min(source) as source from src group by acq, metric) select acq, metric, source, count(value) as n, round(max(value), 6) as top from src join best using (acq, metric, source) group by all""")
register("vh_descriptor_values", vh_descriptors, f"""{_V}, nrm as (select acq, metric, STD_seg_medbeat / (abs(MED_seg_medbeat) + 1e-12) as STD_seg_medbeat, IQR_seg_medbeat / (abs(MED_seg_medbeat) + 1e-12) as IQR_seg_medbeat, MAD_seg_medbeat / (abs(MED_seg_medbeat) + 1e-12) as MAD_seg_medbeat, CV_seg_medbeat from higher)
  select acq, metric, descriptor, round(value, 5) as value from nrm unpivot (value for descriptor in (STD_seg_medbeat, IQR_seg_medbeat, MAD_seg_medbeat, CV_seg_medbeat))""")
register("vh_auc_ranking", vh_auc_ranking, f"""{_SEP} select 'pathology' as cohort, g as metric, row_number() over (order by round(greatest(u / n, 1 - u / n), 9) desc, g) as rank, round(greatest(u / n, 1 - u / n), 6) as auc_separability from pairs""")
register("vh_mwu_ranking", vh_mwu_ranking, f"""{_SEP}, tie as (select g, sum(pow(c + p, 3) - (c + p)) as ties from steps group by g),
  z as (select g, (greatest(u, n_c * n_g - u) - n_c * n_g / 2.0 - 0.5) / sqrt(n_c * n_g / 12.0 * ((n_c + n_g + 1) - ties / ((n_c + n_g) * (n_c + n_g - 1)))) / sqrt(2) as y from pairs join grp using (g) join tie using (g)),
  tt as (select g, y, 1 / (1 + 0.3275911 * abs(y)) as t from z), pv as (select g, least(1, 1 - sign(y) * {_ERF}) as p from tt)
  select 'pathology' as cohort, g as metric, n_c, n_g, round(medg - medc, 6) as median_difference, round(p, 4) as p, row_number() over (order by round(p, 9), g) as rank from pv join grp using (g)""")
register("vh_separation", vh_separation, f"""{_SEP}, tie as (select g, sum(pow(c + p, 3) - (c + p)) as ties from steps group by g),
  z as (select g, (greatest(u, n_c * n_g - u) - n_c * n_g / 2.0 - 0.5) / sqrt(n_c * n_g / 12.0 * ((n_c + n_g + 1) - ties / ((n_c + n_g) * (n_c + n_g - 1)))) / sqrt(2) as y from pairs join grp using (g) join tie using (g)),
  tt as (select g, y, 1 / (1 + 0.3275911 * abs(y)) as t from z), pv as (select g, least(1, 1 - sign(y) * {_ERF}) as p from tt),
  ov as (select g, {_ERF} as e from (select g, abs(d) / (2 * sqrt(2)) as y, 1 / (1 + 0.3275911 * abs(d) / (2 * sqrt(2))) as t from dd))
  select 'pathology' as cohort, g as metric, n_c, n_g, round(d, 4) as cohen_d, round(mg - mc - half, 4) as ci_low, round(mg - mc + half, 4) as ci_high, round(greatest(u / n, 1 - u / n), 4) as auc_separability, round(se, 4) as sensitivity, round(sp, 4) as specificity,
    round(p, 4) as p_mann_whitney, round(1 - e, 4) as overlap, case when medg > medc then 'pathology' else 'control' end as more_variable from dd join pairs using (g) join bst using (g) join pv using (g) join ov using (g)""")
register("vh_formatted", vh_formatted, f"""{_V} select cohort, metric, descriptor, printf('%.3f ± %.3f (%d)', round(avg(value), 6), round(stddev_samp(value), 6), count(value)) as cell
  from (select * from higher unpivot (value for descriptor in (MED_seg_medbeat, STD_seg_medbeat, IQR_seg_medbeat, MAD_seg_medbeat, CV_seg_medbeat))) group by cohort, metric, descriptor having count(value) > 1""")


# rasters ------------------------------------------------------------------------------------------------------------------------

def _raster(spark, sf_dir):
    p = views.load(spark, sf_dir, "part").select((F.col("p_partkey") % 50).alias("x"), (F.floor(F.col("p_partkey") / 50) % 40).alias("y"), (F.col("p_size") % 7).alias("label")).distinct()
    return p.select(F.lit(1).cast("long").alias("acq"), "x", "y", "label", F.lit(50).alias("width"), F.lit(40).alias("height"), F.lit(25).alias("cx"), F.lit(20).alias("cy"), (F.pow(F.col("x") - 25, F.lit(2)) + F.pow(F.col("y") - 20, F.lit(2)) < 36).alias("in_disc"))


_RASTER = "px as (select distinct p_partkey % 50 as x, (p_partkey // 50) % 40 as y, p_size % 7 as label from part)"


def tp_label_raster(spark, sf_dir):
    return topology.label_raster(_raster(spark, sf_dir)).select("x", "y", "label", "shown")


def tp_flip(spark, sf_dir):
    return _raster(spark, sf_dir).select("x", topology.flip_y(F.col("y"), F.col("height")).alias("y"), "label")


def tp_validate(spark, sf_dir):
    pixels = _raster(spark, sf_dir).withColumn("width", F.lit(45))
    branches = views.load(spark, sf_dir, "nation").select(F.lit(1).cast("long").alias("acq"), (F.col("n_nationkey") % 9 + 3).alias("branch"))
    periods = views.load(spark, sf_dir, "supplier").select(F.lit(1).cast("long").alias("acq"), F.col("s_acctbal").alias("T"))
    return topology.validate(pixels, branches, periods).select("check", "n")


def tp_reuse(spark, sf_dir):
    s = _segments(spark, sf_dir).groupBy("acq", "metric").agg(F.round(F.max("value"), 6).alias("value"))
    stored = s.where("acq % 2 = 0 or metric = 'PI'").withColumn("source", F.lit("stored"))
    return topology.reuse_or_recompute(stored, s.withColumn("source", F.lit("computed")), 3)


register("tp_label_raster", tp_label_raster, f"""with {_RASTER} select x, y, label, case when label > 0 then label when pow(x - 25, 2) + pow(y - 20, 2) < 36 then -1 when abs(x - 25) < 1.5 or abs(y - 20) < 1.5 then -2 else 0 end as shown from px""")
register("tp_flip", tp_flip, f"with {_RASTER} select x, 39 - y as y, label from px")
register("tp_validate", tp_validate, f"""with {_RASTER}, br as (select n_nationkey % 9 + 3 as b from nation), l as (select distinct label from px where label > 0), d as (select distinct b from br)
  select * from (select 'missing in branches' as check, count(*) as n from l where label not in (select b from d) union all select 'missing in labels', count(*) from d where b not in (select label from l)
  union all select 'repeated branch', count(*) from (select b from br group by b having count(*) > 1) union all select 'outside the frame', count(*) from px where x >= 45
  union all select 'bad period', count(*) from supplier where not (s_acctbal > 0)) where n > 0""")
register("tp_reuse_or_recompute", tp_reuse, f"""{_V}, s as (select acq, metric, round(max(value), 6) as value from metrics group by acq, metric)
  select acq, metric, value, case when acq % 2 = 0 then 'stored' else 'computed' end as source from s""")


# joins, names and small reductions ----------------------------------------------------------------------------------------------

def jn_dictionary(spark, sf_dir):
    m = shape.long_form(shape.shape_metrics(views.events(spark, sf_dir), ["RI", "PI", "mu_t", "t50_over_T"]), ["RI", "PI", "mu_t", "t50_over_T"])
    return reports.with_dictionary(m, reports.dictionary(spark)).select("acq", "metric", "unit", "family", F.round("value", 2).alias("value"))


def pr_whitelist(spark, sf_dir):
    return reports.selected(_beats(spark, sf_dir).unionByName(_beats(spark, sf_dir).where("metric = 'RI'").withColumn("metric", F.lit("m0")))).groupBy("metric").agg(F.count("value").alias("n"))


def pr_orient(spark, sf_dir):
    """60 samples as 12 rows of 5 beats, or as 5 rows of 12 for odd ids."""
    v = views.load(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 60), lambda x: x.cast("double")).alias("a"))
    n = F.when(F.col("vec_id") % 2 == 0, 5).otherwise(12)
    rows = F.transform(F.sequence(F.lit(0), (60 / n - 1).cast("int")), lambda r: F.slice("a", r * n + 1, n))
    o = v.select("vec_id", wave.oriented(rows, F.lit(5)).alias("m"))
    return o.select("vec_id", F.posexplode("m").alias("t", "row")).select("vec_id", "t", F.posexplode("row").alias("beat", "x")).select("vec_id", "t", "beat", F.round("x", 6).alias("x"))


def jn_output_or_input(spark, sf_dir):
    outputs = views.load(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("position"), F.concat(F.lit("out/"), F.col("s_name")).alias("path"), (F.col("s_acctbal") > 2000).alias("compatible"))
    inputs = views.load(spark, sf_dir, "supplier").where("s_suppkey % 3 != 0").select(F.col("s_suppkey").alias("position"), F.concat(F.lit("in/"), F.col("s_name")).alias("path"), (F.col("s_nationkey") > 3).alias("compatible"))
    return files.output_or_input(outputs, inputs)


def ag_summary(spark, sf_dir):
    e = views.load(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(*robust.summarise("value")).select("event_type", "n", *rounded(None, ["mean", "std", "median", "iqr"], 6))


def pr_ratio(spark, sf_dir):
    li = views.load(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.sum("l_tax").alias("a"), F.round(F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_discount")).otherwise(0.0)), 9).alias("b"))
    return li.select("l_suppkey", "l_returnflag", F.round(scoring.ratio("a", "b"), 5).alias("ratio"))


def first_seen(spark, sf_dir):
    e = views.load(spark, sf_dir, "events").select("event_id", F.concat_ws("-", "event_type", F.col("user_id").cast("string")).alias("name"))
    return files.ordered_distinct(e, "name", "event_id").select("name", "event_id")


def wm_rd_matrix(spark, sf_dir):
    lines = views.load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("branch"), F.struct("l_orderkey", "l_linenumber", "l_quantity").alias("position"), F.col("l_quantity").alias("RD"))
    return files.ordered_distinct(lines, "branch", "position").select("branch", "RD")


def io_default(spark, sf_dir):
    data = views.load(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("acq")).agg(F.round(F.max("o_totalprice"), 2).alias("value"))
    return files.read_or_default(views.load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("acq")), data, "acq", "value", -1.0)


def rp_slice(spark, sf_dir):
    w = views.embeddings(spark, sf_dir)
    rows = w.select("acq", "beat", "branch", "radius", F.posexplode_outer("v").alias("i", "x"))
    return reports.slice_axes(rows, ["acq", "i"], {"beat": 1, "branch": 2, "radius": 0}, "x").select("acq", "i", F.round("x", 6).alias("x"))


register("jn_metric_dictionary", jn_dictionary, f"""{sql.shape('events')}, l as (select acq, metric, value from (select acq, RI, PI, mu_t, t50_over_T from shape) unpivot (value for metric in (RI, PI, mu_t, t50_over_T)))
  select acq, metric, case metric when 'mu_t' then 's' else '1' end as unit, case metric when 'mu_t' then 'timing' when 't50_over_T' then 'quantiles' else 'pulsatility' end as family, round(value, 2) as value from l""")
register("pr_whitelist", pr_whitelist, f"{_CS} select metric, count(value) as n from beats where metric != 'W80' group by metric")
register("pr_orient", pr_orient, """with s as (select vec_id, i, embedding[i + 1]::double as x from embeddings, unnest(range(60)) as u(i))
  select vec_id, case when vec_id % 2 = 0 then i // 5 else i % 12 end as t, case when vec_id % 2 = 0 then i % 5 else i // 12 end as beat, round(x, 6) as x from s""")
register("jn_output_or_input", jn_output_or_input, """with o as (select s_suppkey as position, 'out/' || s_name as path from supplier where s_suppkey % 2 = 0 and s_acctbal > 2000), i as (select s_suppkey as position, 'in/' || s_name as path from supplier where s_suppkey % 3 != 0 and s_nationkey > 3)
  select coalesce(o.position, i.position) as position, coalesce(o.path, i.path) as path, case when o.path is null then 'input' else 'output' end as side from o full join i on o.position = i.position""")
register("ag_summary", ag_summary, """select event_type, count(value) as n, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as std, round(quantile_cont(value, 0.5), 6) as median, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) as iqr from events group by event_type""")
register("pr_ratio", pr_ratio, """with s as (select l_suppkey, l_returnflag, sum(l_tax) as a, round(sum(case when l_linestatus = 'F' then l_discount else 0 end), 9) as b from lineitem group by all) select l_suppkey, l_returnflag, round(a / nullif(b, 0), 5) as ratio from s""")
register("io_ordered_distinct", first_seen, "select event_type || '-' || user_id as name, min(event_id) as event_id from events group by all")
register("wm_rd_matrix", wm_rd_matrix, "select l_suppkey as branch, arg_min(l_quantity, (l_orderkey, l_linenumber, l_quantity)) as RD from lineitem group by l_suppkey")
register("io_read_or_default", io_default, "select c_custkey as acq, coalesce(v, -1.0) as value from customer left join (select o_custkey, round(max(o_totalprice), 2) as v from orders where o_orderstatus = 'F' group by o_custkey) on o_custkey = c_custkey")
register("rp_slice", rp_slice, f"{sql.ctes('embeddings')} select acq, i, round(raw, 6) as x from samples where beat = 1 and branch = 2 and radius = 0")


# where outputs go, cases, frames that move, ranges --------------------------------------------------------------------------------

def _paths(spark, sf_dir):
    n = F.col("s_suppkey")
    stem = F.concat(F.lit("/data/"), F.col("s_nationkey").cast("string"), F.lit("/rec "), n.cast("string"))
    name = F.concat(F.lit("rec "), n.cast("string"))
    path = (
        F.when(n % 5 == 0, F.concat(stem, F.lit(".holo"))).when(n % 5 == 1, F.concat(stem, F.lit("/"), name, F.lit("_EF/h5/"), name, F.lit("_ef.h5")))
        .when(n % 5 == 2, F.concat(name, F.lit("_HD/a_DV/x.h5"))).when(n % 5 == 3, F.concat(stem, F.lit("_Ef.hdf5"))).otherwise(F.concat(F.lit("/"), name, F.lit("_AE")))
    )
    return views.load(spark, sf_dir, "supplier").select(n.alias("id"), path.alias("path"))


def io_paths(spark, sf_dir):
    p = F.col("path")
    return _paths(spark, sf_dir).select("id", outputs.dataset_root(p).alias("root"), outputs.companion_folder(p, "AE", "html").alias("html"), outputs.output_name(p).alias("output"))


def io_free_names(spark, sf_dir):
    rows = views.load(spark, sf_dir, "nation").select("n_regionkey", F.substring("n_name", 1, 1).alias("tree"), "n_nationkey")
    return outputs.free_names(rows, "n_regionkey", "tree", "n_nationkey")


def pe_cases(spark, sf_dir):
    s = views.load(spark, sf_dir, "customer").select(F.concat(F.lit("h5\\"), F.col("c_mktsegment"), F.lit(" ("), (F.col("c_nationkey") % 3).cast("string"), F.lit(")/./p.h5")).alias("path"), F.col("c_custkey").alias("position"))
    return patients.case_ids(s).select("position", "group_name", "group_case_index", "display_label", "file_stem")


def wm_frames(spark, sf_dir):
    li = views.load(spark, sf_dir, "lineitem")
    rows = li.select(
        (F.col("l_orderkey") % 7).alias("acq"), F.col("l_suppkey").alias("frame"), F.col("l_linenumber").alias("branch"), F.col("l_partkey").alias("radius"),
        F.when(F.col("l_returnflag") != "A", F.col("l_quantity") / 53).alias("probability"), (F.col("l_discount") - 0.02).alias("difference"), F.col("l_tax").alias("normal_std"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"),
    )
    # at the bound and half-way between two results the SQL decides by the rounding of sums in the order of the rows; it rounds the product, Spark the decimal
    f = womersley.frame_classes(rows, order=["file", "row"], digits=6)
    return f.select("acq", "frame", "active_branches", "high_segments", "spatial_class", "motion_class", *[(F.round(F.col(n) * 1e6) / 1e6).alias(n) for n in ("mean_probability", "coherence")])


def wm_parts(spark, sf_dir):
    p = views.embeddings(spark, sf_dir).where("branch = 0").select("acq", "beat", "radius", womersley.profile_parts(F.col("v")).alias("p"))
    both = p.select("acq", "beat", "radius", F.posexplode(F.arrays_zip(F.col("p.dc").alias("dc"), F.col("p.n1").alias("n1"))).alias("i", "s"))
    return both.select("acq", "beat", "radius", "i", F.round("s.dc", 6).alias("dc"), F.round("s.n1", 6).alias("n1"))


def ab_ranges(spark, sf_dir):
    e = views.load(spark, sf_dir, "events").withColumn("metric", F.element_at(F.array(*[F.lit(m) for m in ("raw_band_corr", "beat_period", "t_peak", "dvdt_max", "vmean")]), (F.col("event_id") % 5 + 1).cast("int")))
    rows = e.select("metric", (F.col("value") - 50).alias("value"), (F.col("user_id") % 40).cast("double").alias("T"))
    return absolute.outside_range(rows).groupBy("metric", "kind").agg(F.count("value").alias("n"), F.count_if("outside").alias("outside"))


register("io_output_paths", io_paths, """with p as (select s_suppkey as id, s_nationkey as g, 'rec ' || s_suppkey as nm from supplier),
  r as (select id, nm, case id % 5 when 0 then '/data/' || g || '/' || nm when 1 then '/data/' || g || '/' || nm when 2 then nm || '_HD' when 4 then '/' end as root from p)
  select id, root, case id % 5 when 4 then null when 3 then null when 2 then root || '/' || nm || '_HD_AE/html' else root || '/' || nm || '_AE/html' end as html, case id % 5 when 2 then nm || '_HD' when 4 then nm || '_AE' else nm end || '_AE.h5' as output from r""")
register("io_free_names", io_free_names, """with r as (select n_regionkey, n_nationkey, n_name[1] as tree, row_number() over (partition by n_regionkey, n_name[1] order by n_nationkey) - 1 as k from nation)
  select n_regionkey, n_nationkey, tree, case when k = 0 then tree else tree || '_' || k end as free_name from r""")
register("pe_cases", pe_cases, """with c as (select c_custkey as position, c_mktsegment || ' (' || (c_nationkey % 3) || ')' as g, c_mktsegment || '_' || (c_nationkey % 3) as f from customer),
  r as (select *, row_number() over (partition by g order by position) as k from c)
  select position, g as group_name, k as group_case_index, g || ' #' || k as display_label, printf('%s_%03d', f, k) as file_stem from r""")
register("wm_frame_classes", wm_frames, """with s as (select l_orderkey % 7 as acq, l_suppkey as frame, l_linenumber as branch, case when l_returnflag != 'A' then l_quantity / 53 end as p, l_discount - 0.02 as d, l_tax as sd from lineitem),
  h as (select *, coalesce(p >= 0.9, false) as hi, case when coalesce(p >= 0.9, false) and sd > 0 then d / sd end as z from s),
  b as (select acq, frame, branch, count(*) filter (hi) as n from h group by all), m as (select acq, frame, count(*) filter (n > 0) as active, max(n) as most, sum(n) as high from b group by all),
  f as (select acq, frame, avg(p) as mp, abs(sum(z)) / nullif(sum(abs(z)), 0) as c from h group by all),
  k as (select *, case when active >= 2 then 3 when most >= 2 then 2 when high > 0 then 1 else 0 end as sc from m join f using (acq, frame))
  select acq, frame, active as active_branches, high as high_segments, sc as spatial_class, case when sc < 3 then 0 when c >= 0.7 then 1 else 2 end as motion_class, round(mp, 6) as mean_probability, round(c, 6) as coherence from k""")
register("wm_profile_parts", wm_parts, f"""{sql.ctes('embeddings')}, c as (select k, avg(raw) as dc, sum(raw * cos(2 * pi() * i / n)) / max(n) as re, -sum(raw * sin(2 * pi() * i / n)) / max(n) as im from samples where branch = 0 group by k)
  select acq, beat, radius, i, round(dc, 6) as dc, round(2 * (re * cos(2 * pi() * i / n) - im * sin(2 * pi() * i / n)), 6) as n1 from samples join c using (k)""")
register("ab_expected_ranges", ab_ranges, """with e as (select ['raw_band_corr', 'beat_period', 't_peak', 'dvdt_max', 'vmean'][event_id % 5 + 1] as metric, value - 50 as x, user_id % 40 as t from events),
  b as (select metric, x, case metric when 'raw_band_corr' then abs(x) > 1 + 1e-9 when 'beat_period' then x <= 0 when 't_peak' then x < 0 or x >= t when 'vmean' then x < 0 else false end as bad from e)
  select metric, case metric when 'raw_band_corr' then 'unit' when 'beat_period' then 'positive' when 't_peak' then 'within_beat' when 'vmean' then 'nonnegative' else 'signed' end as kind, count(x) as n, count(*) filter (bad) as outside from b group by all""")
