"""Every operator as a query of (spark, sf_dir), with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsecohort.operators import absolute, shape
from pulsecohort.plans import sql
from pulsecohort.sources import scratch, views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
ID = ["acq", "cohort", "beat", "branch", "radius"]


def register(name: str, query: Query, oracle: str | None = None) -> None:
    """Add a query and its SQL; neither side gives a negative zero."""

    def unsigned(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = query(spark, sf_dir)
        return df.select(*[(F.col(f"`{c}`") + 0.0).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])

    QUERIES[name] = unsigned
    if oracle is not None:
        ORACLE[name] = sql.unsigned(oracle)


def rounded(df: DataFrame, names: list[str], digits) -> list:
    return [F.round(F.col(n), digits(n) if callable(digits) else digits).alias(n) for n in names]


def _view(view: str) -> Query:
    return getattr(views, view)


# shape metrics ------------------------------------------------------------------------------------------------------------------

def _shape_digits(name: str) -> int:
    return 2 if name in ("mu_t", "sigma_t") else 6


def _shape(view: str, names: list[str]) -> None:
    def run(spark, sf_dir):
        return shape.shape_metrics(_view(view)(spark, sf_dir), names).select(*ID, *rounded(None, names, _shape_digits))

    return run, f"{sql.shape(view)} select {sql.KEYS}, {sql.rounded(names, _shape_digits)} from shape"


FAMILIES = {
    "wf_mu_t": shape.TIMING, "wf_t_quantiles": shape.T_QUANTILES, "wf_widths": shape.WIDTHS, "wf_pulsatility": shape.PULSATILITY, "wf_vti_ratios": shape.VTI,
    "wf_d_quantiles": shape.D_QUANTILES, "wf_kinetics": shape.KINETICS, "wf_spectral_ratio": shape.SPECTRAL, "wf_support": shape.SUPPORT, "wf_slope_energy": shape.SLOPE,
}
for _name, _metrics in FAMILIES.items():
    register(_name, *_shape("events", _metrics))
for _v in ("embeddings", "line_items"):
    register(f"wf_all_{_v}", *_shape(_v, shape.METRICS))


def rollup(spark, sf_dir):
    m = shape.shape_metrics(views.line_items(spark, sf_dir), ["RI", "PI", "t50_over_T"])
    return shape.roll_up(m, ["RI", "PI", "t50_over_T"]).select("acq", "cohort", "beat", "branch", "scope", *rounded(None, ["RI", "PI", "t50_over_T"], 6))


_ROLL = "round(quantile_cont(RI, 0.5), 6) as RI, round(quantile_cont(PI, 0.5), 6) as PI, round(quantile_cont(t50_over_T, 0.5), 6) as t50_over_T"
register(
    "wf_rollup_branch_global", rollup,
    f"{sql.shape('line_items')} select acq, cohort, beat, branch, 'branch' as scope, {_ROLL} from shape group by all "
    f"union all select acq, cohort, beat, null, 'global', {_ROLL} from shape group by acq, cohort, beat",
)


def diagnostics(spark, sf_dir):
    d = shape.diagnostics(views.embeddings(spark, sf_dir))
    return d.select(*ID, "i", *rounded(None, ["tau", "signal", "cumulative", "delta_dti_curve", "dvdt"], 6))


register(
    "wf_diagnostics", diagnostics,
    f"{sql.ctes('embeddings', sql.PREPARED)} select {sql.KEYS}, s.i, round(s.i / s.n, 6) as tau, round(s.z, 6) as signal, round(coalesce(lag(d1) over (partition by s.k order by s.i), 0), 6) as cumulative, "
    "round(coalesce(lag(d1) over (partition by s.k order by s.i), 0) - s.i / s.n, 6) as delta_dti_curve, round(g, 6) as dvdt from slope s join base using (k)",
)


def harmonic_diagnostics(spark, sf_dir):
    d = shape.harmonic_diagnostics(views.embeddings(spark, sf_dir))
    return d.select(*ID, "h", *rounded(None, ["magnitude", "energy_weight", "amplitude_weight", "rolloff"], 6))


register(
    "wf_harmonic_diagnostics", harmonic_diagnostics,
    f"""{sql.ctes('embeddings', sql.PREPARED)}, c as (
      select p.k, h, sqrt(pow(sum(z * cos(2 * pi() * h * i / n)) / max(n), 2) + pow(sum(z * sin(2 * pi() * h * i / n)) / max(n), 2)) as magnitude
      from prof p cross join unnest(range(1, 11)) as u(h) where h <= n // 2 group by p.k, h)
    select {sql.KEYS}, h, round(magnitude, 6) as magnitude, round(magnitude * magnitude / sum(magnitude * magnitude) over (partition by k), 6) as energy_weight,
      round(magnitude / sum(magnitude) over (partition by k), 6) as amplitude_weight,
      round(case when h >= 2 then sum(case when h >= 2 then magnitude * magnitude end) over (partition by k order by h) / sum(case when h >= 2 then magnitude * magnitude end) over (partition by k) end, 6) as rolloff
    from c join base using (k)""",
)


# absolute metrics ---------------------------------------------------------------------------------------------------------------

def _absolute(view: str, names: list[str], digits: int):
    def run(spark, sf_dir):
        return absolute.absolute_metrics(_view(view)(spark, sf_dir), names).select(*ID, *rounded(None, names, digits))

    return run, f"{sql.absolute(view)} select {sql.KEYS}, {sql.rounded(names, digits)} from absolute"


ABSOLUTE_FAMILIES = {
    "ab_levels": absolute.LEVELS, "ab_percentiles": absolute.ORDER, "ab_vti": absolute.INTEGRALS, "ab_windows": absolute.WINDOWED, "ab_pulsatile": absolute.PULSATILE,
    "ab_events": absolute.EVENTS, "ab_derivative": absolute.DERIVATIVE, "ab_harmonics": absolute.HARMONIC, "ab_energy": absolute.ENERGY,
}
for _name, _metrics in ABSOLUTE_FAMILIES.items():
    register(_name, *_absolute("embeddings", _metrics, 6))
register("ab_gaps_line_items", *_absolute("line_items", [*absolute.LEVELS, *absolute.ORDER, *absolute.INTEGRALS, *absolute.EVENTS, "dvdt_max", "dvdt_abs_mean", "total_variation"], 6))


def harmonic_arrays(spark, sf_dir):
    m = absolute.absolute_metrics(views.embeddings(spark, sf_dir), absolute.ARRAYS)
    rows = m.select(*ID, F.posexplode_outer(F.arrays_zip(F.col("harmonic_coeff_abs").alias("a"), F.col("harmonic_power").alias("p"))).alias("h", "s"))
    return rows.groupBy("acq", "beat", "h").agg(F.round(F.median("s.a"), 6).alias("coeff_abs"), F.round(F.median("s.p"), 6).alias("power"))


register(
    "ab_harmonic_arrays_global", harmonic_arrays,
    f"""{sql.ctes('embeddings', sql.PREPARED)}, c as (
      select p.k, h, sqrt(pow(sum(z * cos(2 * pi() * h * i / n)) / max(n), 2) + pow(sum(z * sin(2 * pi() * h * i / n)) / max(n), 2)) as a
      from prof p cross join unnest(range(0, 11)) as u(h) where h <= n // 2 group by p.k, h)
    select acq, beat, h, round(quantile_cont(a, 0.5), 6) as coeff_abs, round(quantile_cont(a * a, 0.5), 6) as power from c join base using (k) group by acq, beat, h""",
)


def band_qc(rectify: bool):
    def run(spark, sf_dir):
        pairs = views.with_bandlimited(views.embeddings(spark, sf_dir))
        return absolute.band_qc(pairs, rectify).select(*ID, *rounded(None, absolute.QC, 6))

    fix = (lambda c: f"greatest({c}, 0)") if rectify else (lambda c: c)
    oracle = f"""{sql.harmonics('embeddings')}, band as (
      select s.k, s.acq, s.cohort, s.beat, s.branch, s.radius, s.i, s.n, s.T, s.raw, sum((case when h = 0 or 2 * h = n then 1 else 2 end) * (re * cos(2 * pi() * h * i / n) - im * sin(2 * pi() * h * i / n))) as band
      from samples s join coeff c using (k) group by all),
    e as (select *, {fix('raw')} as a, {fix('band')} as b, {fix('raw')} - {fix('band')} as d, T / n as dt from band)
    select {sql.KEYS}, round(avg(d), 6) as raw_minus_band_mean, round(sum(d) * max(dt) / max(T), 6) as raw_minus_band_bias, round(sqrt(avg(d * d)), 6) as raw_minus_band_rms, round(avg(abs(d)), 6) as raw_minus_band_mae,
      round(max(abs(d)), 6) as raw_minus_band_max_abs, round(sum(d * d) * max(dt), 6) as raw_minus_band_energy, round(sum(abs(d)) * max(dt), 6) as raw_minus_band_vti_abs,
      round(sum(d) * max(dt), 6) as raw_band_vti_difference, round(corr(a, b), 6) as raw_band_corr from e group by k, {sql.KEYS}"""
    return run, oracle


register("ab_qc", *band_qc(False))
register("ab_qc_rectified", *band_qc(True))


# harmonics ----------------------------------------------------------------------------------------------------------------------

from pulsecohort.operators import harmonic  # noqa: E402

SEG = ["acq", "beat", "branch", "radius", "h"]


def hm_coeffs(spark, sf_dir):
    return harmonic.coefficients(views.embeddings(spark, sf_dir)).select(*SEG, *rounded(None, ["re", "im"], 6))


def hm_norm(spark, sf_dir):
    n = harmonic.normalised(views.embeddings(spark, sf_dir))
    return n.select(*SEG, *rounded(None, ["re", "im", "rel_amp"], 5), "valid")


def _organised(keys: list[str], columns: list[str]):
    def run(spark, sf_dir):
        o = harmonic.organisation(harmonic.normalised(views.embeddings(spark, sf_dir)), keys)
        return o.select(*[k for k in keys if k not in ("vessel", "representation")], "n", *rounded(None, columns, 6))

    names = ", ".join(k for k in keys if k not in ("vessel", "representation"))
    parts = {
        "mean_re": "avg(re)", "mean_im": "avg(im)", "coherence": "sqrt(pow(sum(re), 2) + pow(sum(im), 2)) / sum(size)", "plv": "sqrt(pow(avg(cos(phase)), 2) + pow(avg(sin(phase)), 2))",
        "amplitude": "quantile_cont(size, 0.5)", "effective_number": "exp(-sum(share * ln(share)))", "occupancy": "exp(-sum(share * ln(share))) / count(*)",
        "spread": "sqrt(sum(pow(re - mre, 2) + pow(im - mim, 2)) / sum(size * size))",
    }
    oracle = f"""{sql.harmonics('embeddings')}, v as (
      select *, size / sum(size) over (partition by {names}) as share, avg(re) over (partition by {names}) as mre, avg(im) over (partition by {names}) as mim from valid)
      select {names}, count(*) as n, {", ".join(f"round({parts[c]}, 6) as {c}" for c in columns)} from v group by {names}"""
    return run, oracle


register("hm_coeffs", hm_coeffs, f"{sql.harmonics('embeddings')} select acq, beat, branch, radius, h, round(re, 6) as re, round(im, 6) as im from coeff")
register("hm_norm", hm_norm, f"{sql.harmonics('embeddings')} select acq, beat, branch, radius, h, case when rel_amp > 0.05 then round(re, 5) end as re, case when rel_amp > 0.05 then round(im, 5) end as im, round(rel_amp, 5) as rel_amp, rel_amp > 0.05 as valid from norm")
register("hm_means", *_organised(harmonic.OVER_BEATS, ["mean_re", "mean_im"]))
register("hm_coherence", *_organised(harmonic.OVER_BEATS, ["coherence"]))
register("hm_coherence_locations", *_organised(harmonic.OVER_LOCATIONS, ["coherence"]))
register("hm_plv", *_organised(harmonic.OVER_BEATS, ["plv"]))
register("hm_plv_locations", *_organised(harmonic.OVER_LOCATIONS, ["plv"]))
register("hm_spread", *_organised(harmonic.OVER_LOCATIONS, ["spread"]))
register("hm_occupancy", *_organised(harmonic.OVER_LOCATIONS, ["amplitude", "effective_number", "occupancy"]))


def hm_summaries(spark, sf_dir):
    o = harmonic.organisation(harmonic.normalised(views.embeddings(spark, sf_dir)), harmonic.OVER_LOCATIONS)
    s = harmonic.summaries(o, ["acq", "h"], ["coherence", "plv"])
    return s.select("acq", "h", *rounded(None, ["coherence_median", "coherence_std", "plv_median", "plv_std"], 6), "coherence_n", "plv_n")


register("hm_summaries", hm_summaries, f"""{sql.harmonics('embeddings')}, o as (
  select acq, beat, h, sqrt(pow(sum(re), 2) + pow(sum(im), 2)) / sum(size) as coherence, sqrt(pow(avg(cos(phase)), 2) + pow(avg(sin(phase)), 2)) as plv from valid group by acq, beat, h)
  select acq, h, round(quantile_cont(coherence, 0.5), 6) as coherence_median, round(stddev_pop(coherence), 6) as coherence_std, round(quantile_cont(plv, 0.5), 6) as plv_median,
    round(stddev_pop(plv), 6) as plv_std, count(coherence) as coherence_n, count(plv) as plv_n from o group by acq, h""")


# low rank -----------------------------------------------------------------------------------------------------------------------

from pulsecohort.operators import filters, lowrank, patients, qc, reports, scoring, topology, variability, windkessel, womersley  # noqa: E402


def lr_rank_one(spark, sf_dir):
    m = lowrank.rank_one(harmonic.normalised(views.embeddings(spark, sf_dir)))
    return m.select("acq", *rounded(None, ["sigma1", "eta1", "rank_participation"], 6))


def lr_tensor(spark, sf_dir):
    return lowrank.tensor_modes(harmonic.normalised(views.embeddings(spark, sf_dir))).select("acq", F.round("lambda", 4).alias("lambda"), F.round("eta", 4).alias("eta"))


def lr_energy(spark, sf_dir):
    m = lowrank.pulsatility_modes(views.embeddings(spark, sf_dir))
    return m.select("acq", "svd_available", "columns", *rounded(None, ["eta1", "eta2", "eta3", "eta23", "effective_rank", "participation_ratio"], 6))


def lr_centred(spark, sf_dir):
    return lowrank.centred_columns(views.line_items(spark, sf_dir)).select(*ID, *rounded(None, ["mu", "rms_x"], 6))


register("lr_rank_one", lr_rank_one)
register("lr_tensor", lr_tensor)
register("lr_energy", lr_energy)
register("lr_centred_columns", lr_centred, f"{sql.ctes('line_items')} select {sql.KEYS}, round(avg(raw), 6) as mu, round(stddev_pop(raw) * sqrt(count(raw) / max(n)), 6) as rms_x from samples group by k, {sql.KEYS} having count(raw) / max(n) >= 0.95")


# artery and vein ----------------------------------------------------------------------------------------------------------------

PAIR = ["acq", "cohort", "beat", "radius"]


def _pairs(spark, sf_dir):
    return views.vessel_pairs(views.embeddings(spark, sf_dir))


def wk_freq_fit(spark, sf_dir):
    f = windkessel.fits(_pairs(spark, sf_dir))
    return f.select(*PAIR, "freq.accepted", F.round("freq.Deltat", 4).alias("Deltat"), F.round("freq.tau", 5).alias("tau"), F.round("freq.residual_norm", 5).alias("residual_norm"))


def wk_arx(spark, sf_dir):
    f = windkessel.fits(_pairs(spark, sf_dir))
    return f.select(*PAIR, "arx.accepted", F.round("arx.Deltat", 4).alias("Deltat"), F.round("arx.tau", 5).alias("tau"), "arx.rows_used")


def wk_time_integral(spark, sf_dir):
    f = windkessel.fits(_pairs(spark, sf_dir))
    return f.select(*PAIR, "time_integral.accepted", F.round("time_integral.Deltat", 4).alias("Deltat"), F.round("time_integral.tau", 5).alias("tau"))


def wk_consensus(spark, sf_dir):
    c = windkessel.consensus(windkessel.fits(_pairs(spark, sf_dir)))
    return c.select(*PAIR, "methods_valid_count", *rounded(None, ["tau_consensus_median", "delay_consensus_median", "tau_intermethod_range"], 5), "tau_consensus_available")


def wk_harmonic(spark, sf_dir):
    from pulsecohort.functions import wave

    p = _pairs(spark, sf_dir).select(*PAIR, F.explode(F.sequence(F.lit(1), F.lit(3))).alias("h"), wave.filled(F.col("qa")).alias("qa"))
    return p.withColumn("c", wave.dft(F.col("qa"), F.col("h"))).select(*PAIR, "h", F.round("c.re", 6).alias("re"), F.round("c.im", 6).alias("im"))


def jn_pairs(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    return p.select(*PAIR, F.size("qa").alias("n"), F.round(F.aggregate(F.zip_with("qa", "qv", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x), 6).alias("dot"))


register("wk_freq_fit", wk_freq_fit)
register("wk_arx", wk_arx)
register("wk_time_integral", wk_time_integral)
register("wk_consensus", wk_consensus)
register("wk_harmonic", wk_harmonic, f"""{sql.ctes('embeddings')} select a.acq, a.cohort, a.beat, a.radius, h, round(sum(a.raw * cos(2 * pi() * h * a.i / a.n)) / max(a.n), 6) as re,
  round(-sum(a.raw * sin(2 * pi() * h * a.i / a.n)) / max(a.n), 6) as im
  from samples a join (select distinct acq, cohort, beat, radius from samples where branch = 1) b using (acq, cohort, beat, radius) cross join unnest([1, 2, 3]) as u(h) where a.branch = 0 group by all""")
register("jn_vessel_pairs", jn_pairs, f"""{sql.ctes('embeddings')} select a.acq, a.cohort, a.beat, a.radius, count(*) as n, round(sum(a.raw * b.raw), 6) as dot
  from samples a join samples b using (acq, cohort, beat, radius, i) where a.branch = 0 and b.branch = 1 group by all""")


# windowed filters ---------------------------------------------------------------------------------------------------------------

def _filtered(f, digits: int = 6):
    def run(spark, sf_dir):
        v = f(views.embeddings(spark, sf_dir))
        return v.select(*ID, F.posexplode_outer("v").alias("i", "x")).select(*ID, "i", F.round("x", digits).alias("x"))

    return run


def _kernel_sql(kernel: list[float]) -> str:
    r = len(kernel) // 2
    weights = ", ".join(f"({k - r}, {w!r})" for k, w in enumerate(kernel))
    return f"""{sql.ctes('embeddings')} select s.acq, s.cohort, s.beat, s.branch, s.radius, s.i, round(sum(w * t.raw), 6) as x from samples s cross join (values {weights}) as kern(o, w)
      join samples t on t.k = s.k and t.i = case when s.i + o < 0 then -(s.i + o) when s.i + o >= s.n then 2 * (s.n - 1) - (s.i + o) else s.i + o end group by all"""


_NEAR = """near as (
  select s.k, s.acq, s.cohort, s.beat, s.branch, s.radius, s.i, s.raw, t.raw as y from samples s join samples t on t.k = s.k and abs(t.i - s.i) <= 3),
centre as (select k, i, quantile_cont(y, 0.5) as m from near group by k, i),
local as (select * from near join centre using (k, i)),
scaled as (select k, acq, cohort, beat, branch, radius, i, raw, m, 1.4826 * quantile_cont(abs(y - m), 0.5) as s from local group by all)"""
_REFLECTED = """refl as (
  select s.k, s.acq, s.cohort, s.beat, s.branch, s.radius, s.i, s.raw, t.raw as y from samples s cross join unnest([-3, -2, -1, 0, 1, 2, 3]) as u(o)
  join samples t on t.k = s.k and t.i = case when s.i + o < 0 then -(s.i + o) when s.i + o >= s.n then 2 * (s.n - 1) - (s.i + o) else s.i + o end),
stats as (select k, acq, cohort, beat, branch, radius, i, raw, avg(y) as m, var_pop(y) as v from refl group by all),
diffs as (select k, raw - lag(raw) over (partition by k order by i) as d from samples),
dm as (select k, quantile_cont(d, 0.5) as m from diffs where d is not null group by k),
noise as (select k, pow(1.4826 * quantile_cont(abs(d - m), 0.5) / sqrt(2), 2) as p from diffs join dm using (k) where d is not null group by k)"""
register("dn_hampel", _filtered(lambda w: filters.hampel(w, "v")), f"{sql.ctes('embeddings', _NEAR)} select {sql.KEYS}, i, round(case when s > 1e-12 and abs(raw - m) > 3 * s then m else raw end, 6) as x from scaled")
register("dn_wiener", _filtered(lambda w: filters.wiener(w, "v")), f"{sql.ctes('embeddings', _REFLECTED)} select {sql.KEYS}, i, round(m + greatest(v - p, 0) / (v + 1e-12) * (raw - m), 6) as x from stats join noise using (k)")
register("dn_savgol", _filtered(lambda w: w.withColumn("v", filters.savgol(F.col("v")))), _kernel_sql(filters.savgol_kernel()))
register("dn_gauss", _filtered(lambda w: w.withColumn("v", filters.gaussian(F.col("v")))), _kernel_sql(filters.gaussian_kernel()))
register("dn_harmonic_lowpass", _filtered(lambda w: w.withColumn("v", filters.harmonic_lowpass(F.col("v")))), f"""{sql.ctes('embeddings')}, c as (
  select k, h, sum(raw * cos(2 * pi() * h * i / n)) / max(n) as re, -sum(raw * sin(2 * pi() * h * i / n)) / max(n) as im from samples cross join unnest(range(13)) as u(h) group by k, h)
  select {sql.KEYS}, i, round(sum((case when h = 0 then 1 else 2 end) * (re * cos(2 * pi() * h * i / n) - im * sin(2 * pi() * h * i / n))), 6) as x from samples join c using (k) group by k, {sql.KEYS}, i""")


def dn_gap_fill(spark, sf_dir):
    v = views.line_items(spark, sf_dir)
    return v.withColumn("v", filters.gap_fill(F.col("v"))).select(*ID, F.posexplode_outer("v").alias("i", "x")).select(*ID, "i", F.round("x", 4).alias("x"))


register("dn_gap_fill", dn_gap_fill, f"""{sql.ctes('line_items')}, e as (
  select *, max(case when raw is not null then i end) over (partition by k order by i) as l, min(case when raw is not null then i end) over (partition by k order by i rows between current row and unbounded following) as r from samples)
  select e.acq, e.cohort, e.beat, e.branch, e.radius, e.i, round(coalesce(e.raw, a.raw + (b.raw - a.raw) * (e.i - l) / (r - l), a.raw, b.raw), 4) as x
  from e left join samples a on a.k = e.k and a.i = l left join samples b on b.k = e.k and b.i = r""")


def dn_denoise(spark, sf_dir):
    d = filters.denoise(views.embeddings(spark, sf_dir))
    return d.select(*ID, "status_code", F.round("finite_fraction", 6).alias("finite_fraction"), F.round("original_vs_filtered_corr", 4).alias("corr"))


def dn_despike(spark, sf_dir):
    v = filters.despike(views.embeddings(spark, sf_dir), "v")
    return v.select(*ID, F.posexplode_outer("v").alias("i", "x")).select(*ID, "i", F.round("x", 6).alias("x"))


def dn_filter_sweep(spark, sf_dir):
    return filters.filter_sweep(views.embeddings(spark, sf_dir)).select(*ID, "config", *rounded(None, filters.SWEEP_METRICS, 5))


register("dn_denoise", dn_denoise)
register("dn_despike", dn_despike, f"""{sql.ctes('embeddings')}, df as (select k, i, raw - lag(raw) over (partition by k order by i) as d from samples),
  dm as (select k, quantile_cont(d, 0.5) as m from df where d is not null group by k), ds as (select k, m, 1.4826 * quantile_cont(abs(d - m), 0.5) as s from df join dm using (k) where d is not null group by k, m),
  jump as (select k, i, abs(d - m) > 4 * s as j from df join ds using (k) where d is not null),
  hit as (select k, i from jump where j union select k, i - 1 from jump where j),
  med as (select s.k, s.i, quantile_cont(t.raw, 0.5) as m from samples s join hit using (k, i) cross join unnest([-2, -1, 0, 1, 2]) as u(o)
    join samples t on t.k = s.k and t.i = case when s.i + o < 0 then -(s.i + o) when s.i + o >= s.n then 2 * (s.n - 1) - (s.i + o) else s.i + o end group by s.k, s.i)
  select {sql.KEYS}, i, round(coalesce(m, raw), 6) as x from samples left join med using (k, i)""")
register("dn_filter_sweep", dn_filter_sweep)


# profiles -----------------------------------------------------------------------------------------------------------------------

def _parabolas(spark, sf_dir):
    return womersley.parabola(views.embeddings(spark, sf_dir), ["acq", "beat", "branch", "radius"], "v")


_PARABOLA = """fit as (
  select acq, beat, branch, radius, count(*) as n, avg(i) as m from samples group by all),
sums as (
  select acq, beat, branch, radius, max(f.n) as n, max(m) as m, sum(pow(i - m, 2)) as s2, sum(pow(i - m, 3)) as s3, sum(pow(i - m, 4)) as s4, sum(raw) as t0, sum((i - m) * raw) as t1, sum(pow(i - m, 2) * raw) as t2
  from samples join fit f using (acq, beat, branch, radius) group by all),
lead as (select *, (n * (s2 * t2 - s3 * t1) - s2 * s2 * t0) / (n * (s2 * s4 - s3 * s3) - s2 * s2 * s2) as A from sums),
lin as (select *, (t1 - A * s3) / s2 as b, (t0 - A * s2) / n as c from lead),
para as (select acq, beat, branch, radius, A, m - b / (2 * A) as x0, c - b * b / (4 * A) as y0 from lin)"""


def wm_parabola(spark, sf_dir):
    return _parabolas(spark, sf_dir).select("acq", "beat", "branch", "radius", F.round("A", 8).alias("A"), F.round("y0", 4).alias("y0"))


def wm_relaxation(spark, sf_dir):
    # beat and radius stay apart in the fit: from radius 10 on, two of them have one circle number
    lines = womersley.parabola(views.embeddings(spark, sf_dir), ["acq", "beat", "branch", "radius"], "v").withColumn("circle", F.col("beat") * 10 + F.col("radius"))
    return womersley.relaxation(lines.withColumn("y0", F.round("y0", 4)), ["acq"], circle="circle").select("acq", "branch", "circles", F.round("slope", 5).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 5).alias("r2"), "rank")


register("wm_parabola", wm_parabola, f"{sql.ctes('embeddings', _PARABOLA)} select acq, beat, branch, radius, round(A, 8) as A, round(y0, 4) as y0 from para")
register("wm_relaxation_topk", wm_relaxation, f"""{sql.ctes('embeddings', _PARABOLA)}, r as (
  select acq, branch, count(*) as circles, regr_slope(round(y0, 4), beat * 10 + radius) as slope, regr_intercept(round(y0, 4), beat * 10 + radius) as intercept, regr_r2(round(y0, 4), beat * 10 + radius) as r2 from para group by acq, branch having count(*) >= 5)
  select * from (select acq, branch, circles, round(slope, 5) as slope, round(intercept, 4) as intercept, round(r2, 5) as r2, row_number() over (partition by acq order by r2 desc, branch) as rank from r) where rank <= 3""")


def wm_symmetry(spark, sf_dir):
    e = views.embeddings(spark, sf_dir)
    from pulsecohort.functions import wave

    s, a = womersley.symmetric(F.col("v")), womersley.antisymmetric(F.col("v"))
    return e.select(*ID, F.round(wave.total_of(s, lambda x: x * x), 6).alias("symmetric"), F.round(wave.total_of(a, lambda x: x * x), 6).alias("antisymmetric"))


register("wm_symmetry", wm_symmetry, f"""{sql.ctes('embeddings')} select a.acq, a.cohort, a.beat, a.branch, a.radius, round(sum(pow((a.raw + b.raw) / 2, 2)), 6) as symmetric, round(sum(pow((a.raw - b.raw) / 2, 2)), 6) as antisymmetric
  from samples a join samples b on a.k = b.k and b.i = a.n - 1 - a.i group by a.k, a.acq, a.cohort, a.beat, a.branch, a.radius""")


def wm_womersley(spark, sf_dir):
    frames = views.embeddings(spark, sf_dir).withColumn("t", F.col("beat")).select("acq", "branch", "radius", "t", F.col("v").alias("profile"))
    return womersley.womersley(frames).select("acq", "branch", "radius", "motion", F.round("r0", 8).alias("r0"), F.round("jump_share", 6).alias("jump_share"))


register("wm_model", wm_womersley)


# topology -----------------------------------------------------------------------------------------------------------------------

def _pixels(spark, sf_dir):
    """A pixel for each part: 64 x 64 by key arithmetic, its brand's number as the branch."""
    p = views.load(spark, sf_dir, "part")
    label = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    return p.select(F.lit(0).cast("long").alias("acq"), ((F.col("p_partkey") * 37) % 64).cast("int").alias("x"), (F.floor(F.col("p_partkey") * 37 / 64) % 64).cast("int").alias("y"), label.alias("label"), F.lit(32).alias("cx"), F.lit(32).alias("cy"))


_PIXELS = """with px as (
  select cast((p_partkey * 37) % 64 as integer) as x, cast((p_partkey * 37 // 64) % 64 as integer) as y, cast(regexp_extract(p_brand, '(\\d+)', 1) as integer) as label from part),
q as (select label, (case when y < 32 then 'S' else 'N' end) || (case when x < 32 then 'W' else 'E' end) as quadrant from px),
cnt as (select label, quadrant, count(*) as n from q group by label, quadrant),
best as (select label, quadrant, n as pixels from (select *, row_number() over (partition by label order by n desc, list_position(['NE', 'NW', 'SW', 'SE'], quadrant)) as r from cnt) where r = 1)"""


def tp_quadrant(spark, sf_dir):
    return topology.quadrant_majority(_pixels(spark, sf_dir)).select("label", "quadrant", "pixels")


def tp_regions(spark, sf_dir):
    """Suppliers' returns as the metric of brand-like branches: branch = key modulo 3 of the segments."""
    placed = topology.regions(topology.quadrant_majority(_pixels(spark, sf_dir)).withColumn("branch", F.col("label") % 3)).select("branch", "region").distinct()
    m = shape.shape_metrics(views.line_items(spark, sf_dir), ["RI", "PI"])
    placed = m.select("acq", "branch").distinct().join(placed, "branch")
    return topology.region_medians(m, placed, ["RI", "PI"]).select("acq", "region", "beat", *rounded(None, ["RI", "PI"], 6))


def tp_unmatched(spark, sf_dir):
    a = views.load(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("branch"))
    b = views.load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("branch"))
    return topology.unmatched(a, b, ["branch"])


register("tp_quadrant_majority", tp_quadrant, f"{_PIXELS} select label, quadrant, pixels from best")
register("tp_region_median", tp_regions, f"""{sql.shape('line_items').replace('with ', _PIXELS + ', ', 1)}, reg as (select distinct label % 3 as branch, unnest([quadrant, quadrant[1], quadrant[2]]) as region from best)
  select acq, region, beat, round(quantile_cont(RI, 0.5), 6) as RI, round(quantile_cont(PI, 0.5), 6) as PI from shape join reg using (branch) group by acq, region, beat""")
register("jn_both_way_anti", tp_unmatched, """select distinct o_custkey as branch, 'branches' as missing_in from orders where o_custkey not in (select c_custkey from customer)
  union all select distinct c_custkey, 'labels' from customer where c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT')""")


# variability --------------------------------------------------------------------------------------------------------------------

def _segments(spark, sf_dir):
    names = ["RI", "PI", "SF_VTI"]
    return shape.shape_metrics(views.line_items(spark, sf_dir), names).unpivot(["acq", "cohort", "beat", "branch", "radius"], names, "metric", "value")


HIGHER = [variability.LEVEL, *variability.SPATIAL, *variability.TEMPORAL]


def vh_higher(spark, sf_dir):
    return variability.higher_metrics(_segments(spark, sf_dir)).select("acq", "cohort", "metric", *rounded(None, HIGHER, 6))


def _scores(spark, sf_dir):
    return variability.scores(variability.higher_metrics(_segments(spark, sf_dir)), variability.SPATIAL)


def vh_score(spark, sf_dir):
    return _scores(spark, sf_dir).select("acq", "cohort", "metric", F.round("value", 6).alias("value"))


def vh_group_table(spark, sf_dir):
    g = variability.group_table(variability.higher_metrics(_segments(spark, sf_dir)), variability.SPATIAL)
    return g.select("cohort", "metric", "descriptor", *rounded(None, ["mean", "std"], 6), "n")


def vh_ranking(spark, sf_dir):
    return variability.ranking(_scores(spark, sf_dir)).select("cohort", "metric", *rounded(None, ["control_median", "group_median", "overall"], 6), "rank")


def vh_contrast(spark, sf_dir):
    return variability.contrast(_scores(spark, sf_dir)).select("cohort", "metric", "more_variable", F.round("ratio", 5).alias("ratio"), "rank")


def vh_separation(spark, sf_dir):
    s = variability.separation(_scores(spark, sf_dir), ["metric"])
    return s.select("cohort", "metric", "n_c", "n_g", *rounded(None, ["cohen_d", "ci_low", "ci_high", "auc_separability", "sensitivity", "specificity", "p_mann_whitney", "overlap"], 4), "more_variable")


def vh_pivot(spark, sf_dir):
    s = variability.separation(_scores(spark, sf_dir), ["metric"])
    t = variability.separation_table(s, ["PI", "RI", "SF_VTI"]).where("estimator in ('n_c', 'n_g', 'control_median', 'group_median', 'cohen_d', 'auc_separability')")
    return t.select("cohort", "estimator", *rounded(None, ["PI", "RI", "SF_VTI"], 5))


def vh_descriptor_p(spark, sf_dir):
    h = variability.higher_metrics(_segments(spark, sf_dir))
    return variability.descriptor_pvalues(h, variability.SPATIAL).select("cohort", "metric", *rounded(None, [*variability.SPATIAL, "score"], 4))


_V = sql.variability()
_SEP = f"""{_V}, vals as (select metric as g, value, cohort != 'control' as path from score), {sql.RANKS},
grp as (select g, count(*) filter (not path) as n_c, count(*) filter (path) as n_g, avg(value) filter (not path) as mc, avg(value) filter (path) as mg, var_samp(value) filter (not path) as vc, var_samp(value) filter (path) as vg,
  quantile_cont(value, 0.5) filter (not path) as medc, quantile_cont(value, 0.5) filter (path) as medg from vals group by g),
dd as (select *, (mg - mc) / sqrt(((n_c - 1) * vc + (n_g - 1) * vg) / (n_c + n_g - 2)) as d, 1.96 * sqrt(vc / n_c + vg / n_g) as half from grp),
sens as (select c.g, case when medg >= medc then (pa - pt) / pa else pt / pa end as se, case when medg >= medc then ct / ca else (ca - ct) / ca end as sp, (value + nxt) / 2 as th from cum c join grp using (g) where nxt is not null),
bst as (select g, se, sp from (select *, row_number() over (partition by g order by round(se + sp - 1, 12) desc, th) as r from sens) where r = 1)"""
register("vh_higher_metrics", vh_higher, f"{_V} select acq, cohort, metric, {sql.rounded(HIGHER, 6)} from higher")
register("vh_score", vh_score, f"{_V} select acq, cohort, metric, round(value, 6) as value from score")
register("vh_group_table", vh_group_table, f"""{_V} select cohort, metric, descriptor, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as std, count(value) as n
  from (select * from higher unpivot (value for descriptor in (MED_seg_medbeat, STD_seg_medbeat, IQR_seg_medbeat, MAD_seg_medbeat, CV_seg_medbeat))) group by cohort, metric, descriptor""")
register("vh_ranking", vh_ranking, f"""{_V} select 'pathology' as cohort, metric, round(control_median, 6) as control_median, round(group_median, 6) as group_median, round((control_median + group_median) / 2, 6) as overall,
  row_number() over (order by (control_median + group_median) desc, metric) as rank from medians""")
register("vh_contrast", vh_contrast, f"""{_V} select 'pathology' as cohort, metric, case when group_median >= control_median then 'pathology' else 'control' end as more_variable,
  round(greatest(abs(control_median), abs(group_median)) / (least(abs(control_median), abs(group_median)) + 1e-12), 5) as ratio,
  row_number() over (order by greatest(abs(control_median), abs(group_median)) / least(abs(control_median), abs(group_median)) desc, metric) as rank from medians""")
register("vh_separation_pivot", vh_pivot, f"""{_SEP}, est as (select dd.g as metric, n_c::double as n_c, n_g::double as n_g, medc as control_median, medg as group_median, d as cohen_d, greatest(u / n, 1 - u / n) as auc_separability from dd join pairs using (g)),
  long as (select * from est unpivot (v for estimator in (n_c, n_g, control_median, group_median, cohen_d, auc_separability)))
  select 'pathology' as cohort, estimator, round(max(v) filter (metric = 'PI'), 5) as PI, round(max(v) filter (metric = 'RI'), 5) as RI, round(max(v) filter (metric = 'SF_VTI'), 5) as SF_VTI from long group by estimator""")
register("vh_descriptor_pvalues", vh_descriptor_p)
register("ag_cohen_d", lambda s, d: variability.separation(_scores(s, d), ["metric"]).select("metric", F.round("cohen_d", 6).alias("cohen_d")), f"{_SEP} select g as metric, round(d, 6) as cohen_d from dd")
register("ag_ci95", lambda s, d: variability.separation(_scores(s, d), ["metric"]).select("metric", *rounded(None, ["ci_low", "ci_high"], 6)), f"{_SEP} select g as metric, round(mg - mc - half, 6) as ci_low, round(mg - mc + half, 6) as ci_high from dd")
register("ag_threshold_sweep", lambda s, d: variability.separation(_scores(s, d), ["metric"]).select("metric", *rounded(None, ["sensitivity", "specificity"], 6)), f"{_SEP} select g as metric, round(se, 6) as sensitivity, round(sp, 6) as specificity from bst")


def ag_mwu(spark, sf_dir):
    return variability.separation(_scores(spark, sf_dir), ["metric"]).select("metric", F.round("p_mann_whitney", 4).alias("p"))


# the same normal tail, by the same published approximation of erf
_ERF = "(1 - (0.254829592 * t + -0.284496736 * t * t + 1.421413741 * t * t * t + -1.453152027 * pow(t, 4) + 1.061405429 * pow(t, 5)) * exp(-y * y))"
register("ag_mwu_p", ag_mwu, f"""{_SEP}, tie as (select g, sum(pow(c + p, 3) - (c + p)) as ties from steps group by g),
  z as (select g, (greatest(u, n_c * n_g - u) - n_c * n_g / 2.0 - 0.5) / sqrt(n_c * n_g / 12.0 * ((n_c + n_g + 1) - ties / ((n_c + n_g) * (n_c + n_g - 1)))) / sqrt(2) as y from pairs join grp using (g) join tie using (g)),
  tt as (select g, y, 1 / (1 + 0.3275911 * abs(y)) as t from z)
  select g as metric, round(least(1, 1 - sign(y) * {_ERF}), 4) as p from tt""")


def ag_axis_stats(spark, sf_dir):
    from pulsecohort.functions import robust

    rows = views.load(spark, sf_dir, "events").select("event_type", "user_id", "value")
    return robust.axis_statistics(rows, ["event_type", "user_id"], "value").select("event_type", "user_id", *rounded(None, ["median", "std", "iqr", "mad", "cv"], 6))


register("ag_axis_stats", ag_axis_stats, """with c as (select event_type, user_id, quantile_cont(value, 0.5) as med from events group by event_type, user_id), m as (select * from events join c using (event_type, user_id))
  select event_type, user_id, round(quantile_cont(value, 0.5), 6) as median, round(case when count(*) = 1 then 0 else stddev_samp(value) end, 6) as std, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) as iqr,
    round(quantile_cont(abs(value - med), 0.5), 6) as mad, round(case when count(*) = 1 then 0 else stddev_samp(value) end / (abs(avg(value)) + 1e-12), 6) as cv from m group by event_type, user_id""")


def ag_reductions(spark, sf_dir):
    from pulsecohort.functions import robust

    rows = views.load(spark, sf_dir, "lineitem")
    x = "l_extendedprice"
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.avg(x), 4).alias("mean"), F.round(F.median(x), 4).alias("median"), F.round(F.stddev_pop(x), 4).alias("std0"), F.round(F.stddev_samp(x), 4).alias("std1"), F.round(F.coalesce(F.sum(x), F.lit(0.0)), 2).alias("total"),
        F.min(x).alias("low"), F.max(x).alias("high"), F.round(F.percentile(x, 0.9), 4).alias("p90"), F.round(robust.iqr(x), 4).alias("iqr"), F.round(robust.cv(x), 8).alias("cv"), robust.arg(x, "l_orderkey").alias("argmax"), robust.arg(x, "l_orderkey", False).alias("argmin"),
    )


register("ag_reductions", ag_reductions, """select l_returnflag, l_linestatus, round(avg(l_extendedprice), 4) as mean, round(quantile_cont(l_extendedprice, 0.5), 4) as median, round(stddev_pop(l_extendedprice), 4) as std0,
  round(stddev_samp(l_extendedprice), 4) as std1, round(sum(l_extendedprice), 2) as total, min(l_extendedprice) as low, max(l_extendedprice) as high, round(quantile_cont(l_extendedprice, 0.9), 4) as p90,
  round(quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25), 4) as iqr, round(stddev_pop(l_extendedprice) / abs(avg(l_extendedprice)), 8) as cv,
  arg_min(l_orderkey, (-l_extendedprice, l_orderkey)) as argmax, arg_min(l_orderkey, (l_extendedprice, l_orderkey)) as argmin from lineitem group by all""")


# composite scoring --------------------------------------------------------------------------------------------------------------

CS_METRICS = ["RI", "PI", "CF", "SF_VTI", "t50_over_T", "W50_over_T"]


def _beats(spark, sf_dir):
    m = shape.shape_metrics(views.line_items(spark, sf_dir), CS_METRICS)
    return m.unpivot(["acq", "cohort", "vessel", "representation", "beat"], CS_METRICS, "metric", "value")


def _marked(spark, sf_dir, beats=None):
    v = scoring.per_file(beats if beats is not None else _beats(spark, sf_dir)).withColumn("value", F.round("value", 9))
    return v.withColumn("pathology", F.col("cohort") == "pathology")


_CS = f"""{sql.shape('line_items')}, beats as (select acq, cohort, metric, value from (select acq, cohort, {', '.join(CS_METRICS)} from shape) unpivot (value for metric in ({', '.join(CS_METRICS)}))),
vals as (select metric as g, acq, cohort, cohort = 'pathology' as path, round(quantile_cont(value, 0.5), 9) as value from beats group by metric, acq, cohort), {sql.RANKS},
ends as (select g, min(value) as lo, max(value) as hi, max(ca) as ca, max(pa) as pa from cum group by g),
cand as (select g, (value + nxt) / 2 as th, ct, pt, ca, pa from cum where nxt is not null union all select g, lo - 1, 0, 0, ca, pa from ends union all select g, hi + 1, ca, pa, ca, pa from ends),
way as (select g, th, dir, case when dir = 1 then (pa - pt) / pa else pt / pa end as se, case when dir = 1 then ct / ca else (ca - ct) / ca end as sp from cand cross join (values (1), (-1)) as v(dir)),
split as (select g, th, dir, se, sp from (select *, row_number() over (partition by g order by round(se + sp - 1, 12) desc, round((se + sp) / 2, 12) desc, dir desc, th) as r from way) where r = 1),
ctl as (select g, case when stddev_samp(value) > 0 then stddev_samp(value) else 1 end as sd from vals where not path group by g),
parts as (select acq, cohort, metric, greatest(0, max(dir * (value - th) / sd)) as z from beats join split on g = metric join ctl using (g) group by acq, cohort, metric)"""


def _split(spark, sf_dir, with_p=False, beats=None):
    return scoring.splits(_marked(spark, sf_dir, beats), with_p)


def cs_split(spark, sf_dir):
    return _split(spark, sf_dir).select("metric", F.round("threshold", 6).alias("threshold"), "direction", *rounded(None, ["sensitivity", "specificity", "control_std"], 6))


def cs_auc(spark, sf_dir):
    return _split(spark, sf_dir).select("metric", *rounded(None, ["auc_greater", "auc_less", "separability_auc", "ks"], 6))


def cs_top(spark, sf_dir):
    s = _split(spark, sf_dir)
    return scoring.top_by_auc(s, 3).select("metric", F.round("separability_auc", 6).alias("separability_auc"))


def cs_p_values(spark, sf_dir):
    return _split(spark, sf_dir, True).select("metric", *rounded(None, ["p_value_mannwhitney", "p_value_student", "p_value_welch", "p_value_ks"], 4))


def _parts(spark, sf_dir):
    beats = scratch.settle(_beats(spark, sf_dir))  # read for the split and again for the contributions
    panel = _split(spark, sf_dir, beats=beats).select("vessel", "representation", "metric", "threshold", "direction", "control_std")
    return scoring.contributions(beats, panel)


def cs_was(spark, sf_dir):
    return scoring.panel_scores(_parts(spark, sf_dir), len(CS_METRICS)).select("acq", "cohort", *rounded(None, ["was", "was_c"], 5))


def cs_contributions(spark, sf_dir):
    return _parts(spark, sf_dir).select("acq", "cohort", "metric", *rounded(None, ["z", "z_capped"], 5))


def cs_usefulness(spark, sf_dir):
    u = scoring.usefulness(_parts(spark, sf_dir), len(CS_METRICS))
    return u.select("cohort", "metric", "n_subjects", "n_active", *rounded(None, ["active_fraction", "mean_z", "median_z", "sum_was_points"], 4))


def cs_hist(spark, sf_dir):
    s = scoring.panel_scores(_parts(spark, sf_dir), len(CS_METRICS)).withColumn("was_c", F.round("was_c", 9))
    return scoring.histogram(s)


_N = len(CS_METRICS)
register("cs_split", cs_split, f"{_CS} select g as metric, round(th, 6) as threshold, dir as direction, round(se, 6) as sensitivity, round(sp, 6) as specificity, round(sd, 6) as control_std from split join ctl using (g)")
register("cs_auc", cs_auc, f"""{_CS} select g as metric, round(u / n, 6) as auc_greater, round(1 - u / n, 6) as auc_less, round(greatest(u / n, 1 - u / n), 6) as separability_auc, round(k, 6) as ks
  from pairs join (select g, max(abs(ct / ca - pt / pa)) as k from cum group by g) using (g)""")
register("cs_top_auc", cs_top, f"""{_CS} select g as metric, round(greatest(u / n, 1 - u / n), 6) as separability_auc from pairs join split using (g)
  order by round(greatest(u / n, 1 - u / n), 9) desc, round(se + sp - 1, 9) desc, g limit 3""")
register("cs_p_values", cs_p_values)
register("cs_was", cs_was, f"{_CS} select acq, cohort, round(10.0 / {_N} * sum(z), 5) as was, round(10.0 / {_N} * sum(least(1, z)), 5) as was_c from parts group by acq, cohort having count(*) = {_N}")
register("cs_contributions", cs_contributions, f"{_CS} select acq, cohort, metric, round(z, 5) as z, round(least(1, z), 5) as z_capped from parts")
register("cs_usefulness_grouping_sets", cs_usefulness, f"""{_CS} select coalesce(cohort, 'ALL') as cohort, metric, count(*) as n_subjects, count(*) filter (z > 0) as n_active, round(count(*) filter (z > 0) / count(*), 4) as active_fraction,
  round(avg(z), 4) as mean_z, round(quantile_cont(z, 0.5), 4) as median_z, round(sum(10.0 / {_N} * z), 4) as sum_was_points from parts group by grouping sets ((cohort, metric), (metric))""")
register("cs_was_hist", cs_hist, f"""{_CS}, w as (select acq, cohort, round(10.0 / {_N} * sum(least(1, z)), 9) as w from parts group by acq, cohort having count(*) = {_N})
  select cohort, cast(least(floor(w), 9) as integer) as bin, count(*) as n from w group by all""")


# fixed thresholds ---------------------------------------------------------------------------------------------------------------

PE_METRICS = ["SF_VTI", "t50_over_T", "v_end_over_vbar", "N_eff_over_T", "RI", "PI", "W50_over_T"]


def _evaluated(spark, sf_dir):
    m = shape.shape_metrics(views.line_items(spark, sf_dir), PE_METRICS).unpivot(["acq"], PE_METRICS, "metric", "value")
    values = m.groupBy("acq", "metric").agg(F.round(F.median("value"), 9).alias("value"))
    return patients.evaluate_metrics(values, patients.panel(spark))


def pe_index(spark, sf_dir):
    e = patients.evaluate(_evaluated(spark, sf_dir))
    return e.select("acq", "n_metrics_configured", "n_metrics_available", "n_metrics_abnormal", *rounded(None, ["pathology_index", "was_c_equivalent", "abnormal_fraction", "coverage_fraction"], 6))


def pe_labels(spark, sf_dir):
    return patients.evaluate(_evaluated(spark, sf_dir)).groupBy("evaluation_label").agg(F.count(F.lit(1)).alias("n"))


def pe_metrics(spark, sf_dir):
    return _evaluated(spark, sf_dir).select("acq", "metric", "available", "abnormal", F.round("value", 6).alias("value"), F.round("weighted_contribution", 6).alias("weighted_contribution"))


_PANEL_SQL = ", ".join(f"('{m}', {t}, {d})" for m, t, d in patients.FIXED_PANEL)
_PE = f"""{sql.shape('line_items')}, val as (select acq, metric, round(quantile_cont(value, 0.5), 9) as value from (select acq, {', '.join(PE_METRICS)} from shape) unpivot (value for metric in ({', '.join(PE_METRICS)})) group by acq, metric),
ev as (select a.acq, p.metric, v.value, v.value is not null as available, coalesce(d * (v.value - t) >= 0, false) as abnormal from (select distinct acq from val) a cross join (values {_PANEL_SQL}) as p(metric, t, d) left join val v on v.acq = a.acq and v.metric = p.metric),
ix as (select acq, count(*) as nc, count(value) as na, count(*) filter (abnormal) as nb, count(*) filter (abnormal) / count(value) as idx from ev group by acq)"""
register("pe_index", pe_index, f"""{_PE} select acq, nc as n_metrics_configured, na as n_metrics_available, nb as n_metrics_abnormal, round(idx, 6) as pathology_index, round(10 * idx, 6) as was_c_equivalent,
  round(nb / na, 6) as abnormal_fraction, round(na / nc, 6) as coverage_fraction from ix""")
register("pe_labels", pe_labels, f"{_PE} select case when idx < 0.33 then 'low' when idx < 0.67 then 'intermediate' else 'high' end as evaluation_label, count(*) as n from ix group by all")
register("pe_metrics", pe_metrics, f"{_PE} select acq, metric, available, abnormal, round(value, 6) as value, case when available then case when abnormal then 1.0 else 0.0 end end as weighted_contribution from ev")


# checks and reports -------------------------------------------------------------------------------------------------------------

def _summary(spark, sf_dir):
    return windkessel.summaries(windkessel.consensus(windkessel.fits(_pairs(spark, sf_dir))), ["acq"])


def qc_flags(spark, sf_dir):
    return qc.flags(_summary(spark, sf_dir)).select("acq", "status", F.array_join("flags", ",").alias("flags"))


def rp_group_stats(spark, sf_dir):
    v = scoring.per_file(_beats(spark, sf_dir))
    return reports.group_stats(v).select("cohort", "vessel", "metric", *rounded(None, ["mean", "std", "median"], 6), "n")


def rp_representative(spark, sf_dir):
    v = scoring.per_file(_beats(spark, sf_dir)).withColumn("value", F.round("value", 9))
    return reports.representative(v.select("acq", "cohort", "metric", "value")).select("cohort", "metric", "acq", F.round("median", 6).alias("median"))


def rp_file_summary(spark, sf_dir):
    m = _beats(spark, sf_dir).where("metric in ('RI', 'PI')").withColumn("vessel", F.when(F.col("beat") % 2 == 0, "artery").otherwise("vein"))
    s = reports.file_summary(m)
    return s.select("acq", "metric", *rounded(None, ["artery_median", "artery_std", "vein_median", "vein_std"], 6))


register("qc_flags", qc_flags)
register("rp_group_stats", rp_group_stats, f"{_CS} select cohort, 'artery' as vessel, g as metric, round(avg(v), 6) as mean, round(stddev_samp(v), 6) as std, round(quantile_cont(v, 0.5), 6) as median, count(*) as n from (select metric as g, acq, cohort, quantile_cont(value, 0.5) as v from beats group by all) group by cohort, g")
register("rp_representative", rp_representative, f"""{_CS}, m as (select g, cohort, quantile_cont(value, 0.5) as m from vals group by g, cohort)
  select cohort, g as metric, acq, round(m, 6) as median from (select v.cohort, v.g, v.acq, m.m, row_number() over (partition by v.cohort, v.g order by round(abs(v.value - m.m), 9), v.acq) as r from vals v join m on m.g = v.g and m.cohort = v.cohort) where r = 1""")
register("rp_file_summary", rp_file_summary, f"""{sql.shape('line_items')}, b as (select acq, metric, value, case when beat % 2 = 0 then 'artery' else 'vein' end as vessel from (select acq, beat, RI, PI from shape) unpivot (value for metric in (RI, PI)))
  select acq, metric, round(quantile_cont(value, 0.5) filter (vessel = 'artery'), 6) as artery_median, round(stddev_pop(value) filter (vessel = 'artery'), 6) as artery_std,
    round(quantile_cont(value, 0.5) filter (vessel = 'vein'), 6) as vein_median, round(stddev_pop(value) filter (vessel = 'vein'), 6) as vein_std from b group by acq, metric""")


# sources ------------------------------------------------------------------------------------------------------------------------

from pulsecohort.sources import files  # noqa: E402


def io_manifest(spark, sf_dir):
    rows = views.load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("acq"), F.col("l_returnflag").alias("pipeline"), F.concat_ws("/", F.col("l_linestatus"), F.col("l_linenumber").cast("string")).alias("path"))
    m = reports.manifest(rows)
    return m.select("acq", "n_pipelines", F.size(F.from_json("manifest", "acq long, pipelines array<struct<pipeline:string,count:int,paths:array<string>>>")["pipelines"][0]["paths"]).alias("first_paths"))


def io_aliases(spark, sf_dir):
    data = views.load(spark, sf_dir, "events").groupBy(F.col("user_id").alias("acq"), F.col("event_type").alias("path")).agg(F.max("event_id").alias("value"))
    aliases = spark.createDataFrame([("signal", "purchase", 1), ("signal", "click", 2), ("signal", "view", 3)], "signal string, path string, priority int")
    return files.resolve_aliases(data, aliases)


def io_missing(spark, sf_dir):
    data = views.load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("acq"), F.col("o_orderpriority").alias("path")).distinct()
    return files.missing_paths(data, spark.createDataFrame([("1-URGENT",), ("2-HIGH",)], "path string"))


def pr_names(spark, sf_dir):
    c = views.load(spark, sf_dir, "customer")
    return c.select("c_custkey", files.safe_key(F.col("c_name")).alias("key"), files.cohort_of(F.concat(F.lit("h5/"), F.col("c_mktsegment"), F.lit("/"), F.col("c_name"))).alias("cohort"))


register("io_manifest", io_manifest, """with p as (select l_suppkey as acq, l_returnflag as pipeline, count(distinct l_linestatus || '/' || l_linenumber) as n from lineitem group by all)
  select acq, count(*) as n_pipelines, arg_min(n, pipeline) as first_paths from p group by acq""")
register("io_alias_resolution", io_aliases, """with d as (select user_id as acq, event_type as path, max(event_id) as value from events group by all), a as (select * from (values ('signal', 'purchase', 1), ('signal', 'click', 2), ('signal', 'view', 3)) as v(signal, path, priority))
  select acq, signal, path, value from (select acq, signal, path, value, row_number() over (partition by acq, signal order by priority) as r from d join a using (path)) where r = 1""")
register("io_missing_paths", io_missing, """select acq, path from (select distinct o_custkey as acq from orders) cross join (values ('1-URGENT'), ('2-HIGH')) as v(path)
  where not exists (select 1 from orders where o_custkey = acq and o_orderpriority = path)""")
register("pr_names", pr_names, "select c_custkey, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '_', 'g'), '_') as key, c_mktsegment as cohort from customer")

from pulsecohort.plans import more  # noqa: E402, F401
