"""DuckDB SQL fragments over the driver's tables: the sample rows of each waveform view, and metrics from them by windows."""

from __future__ import annotations

EPS = "1e-12"

#: Each view as CTEs that end in ``samples``: k, acq, cohort, beat, branch, radius, i, n, T, raw.
VIEWS = {
    "embeddings": """
ranked as (select *, row_number() over (partition by label order by vec_id) - 1 as r from embeddings),
samples as (
  select r * 1000 + label as k, cast(label as bigint) as acq, case when label < 5 then 'control' else 'pathology' end as cohort, r % 5 as beat, (r // 5) % 3 as branch, r // 15 as radius,
         i, len(embedding) as n, 1.0::double as T, embedding[i + 1]::double as raw
  from ranked, unnest(range(len(embedding))) as u(i))""",
    "events": """
spans as (select user_id, count(*) as n, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 as T from events group by user_id),
samples as (
  select user_id as k, user_id as acq, case when user_id % 2 = 0 then 'control' else 'pathology' end as cohort, 0 as beat, 0 as branch, 0 as radius,
         row_number() over (partition by user_id order by ts, event_id) - 1 as i, n, T, value as raw
  from events join spans using (user_id))""",
    "line_items": """
months as (
  select l_suppkey, year(l_shipdate) as y, l_returnflag as f, l_linestatus as s, month(l_shipdate) as m, sum(l_extendedprice) as x
  from lineitem group by all),
waves as (select l_suppkey, y, f, s, row_number() over (order by l_suppkey, y, f, s) as k from (select distinct l_suppkey, y, f, s from months)),
samples as (
  select w.k, w.l_suppkey as acq, case when w.l_suppkey % 2 = 0 then 'control' else 'pathology' end as cohort, w.y as beat,
         case w.f when 'A' then 0 when 'N' then 1 else 2 end as branch, case w.s when 'F' then 0 else 1 end as radius, i, 12 as n, 1.0::double as T, x as raw
  from waves w cross join unnest(range(12)) as u(i)
  left join months o on o.l_suppkey = w.l_suppkey and o.y = w.y and o.f = w.f and o.s = w.s and o.m = i + 1)""",
}
KEYS = "acq, cohort, beat, branch, radius"

#: The embeddings with rows as files have them: a period of zero, a sample that isn't finite (null here), no sample at all.
VIEWS["corrupt"] = VIEWS["embeddings"].replace("samples as (", "sound as (", 1) + """,
samples as (
  select k, acq, cohort, beat, branch, radius, i, n, case when beat = 0 then 0.0 else T end as T,
         case when beat in (1, 2) and i = 3 then null when beat = 3 and branch = 0 then null else raw end as raw
  from sound)"""

#: From samples to rectified ones, whole-wave sums, gradients and profile points.
PREPARED = f"""
rect as (select *, case when raw is not null then greatest(raw, 0) end as x, coalesce(case when raw is not null then greatest(raw, 0) end, 0) as z, T / n as dt from samples),
base as (
  select k, {KEYS}, max(n) as n, max(T) as T, max(dt) as dt, sum(z) as m0, max(x) as vmax, min(x) as vmin, avg(x) as vbar, sum(z * z) as sq, avg(x * x) as ms, count(x) as nx
  from rect group by k, {KEYS} having sum(z) > 0),
prof as (
  select r.k, r.i, r.z, r.x, b.n, b.T, b.dt, b.m0, b.vbar, b.vmax, b.vmin, sum(z) over w / b.m0 as d1, lag(z) over w as zp, lead(z) over w as zn
  from rect r join base b using (k) window w as (partition by k order by i)),
slope as (
  select *, case when n < 2 then null when i = 0 then (zn - z) / dt when i = n - 1 then (z - zp) / dt else (zn - zp) / (2 * dt) end as g from prof),
points as (
  select k, j, d, n, lead(d) over (partition by k order by j) as dn
  from (select k, 0 as j, 0.0::double as d, n from base union all select k, i + 1, d1, n from prof))"""

_T = "\n".join(f"max(case when q = {q} then t end) as t{int(q * 100)}_over_T, max(case when q = {q} then dq end) as d{int(q * 100)}_over_D," for q in (0.10, 0.25, 0.50, 0.75, 0.90))
_H = "\n".join(
    f"sum(z * cos(2 * pi() * {h} * i / n)) / max(n) as c{h}, sum(z * sin(2 * pi() * {h} * i / n)) / max(n) as s{h}," for h in range(1, 11)
)
_KEPT = " + ".join(f"(case when {h} * 2 > n then 0 when {h} * 2 = n then 1 else 2 end) * (c{h} * c{h} + s{h} * s{h})" for h in range(1, 11))

SHAPE = f"""
quant as (
  select k, q, max(case when d <= q and dn > q then (j + (q - d) / (dn - d)) / n end) as t, max(case when j = floor(q * n + 1e-12) then d + (q * n - j) * (dn - d) end) as dq
  from points cross join (values (0.10), (0.25), (0.50), (0.75), (0.90)) as v(q) group by k, q),
quants as (select k, {_T} 0 as zero from quant group by k),
spectrum as (
  select k, max(n) as n, {_H}
         sum(z * cos(pi() * i)) / max(n) as ny, sum(pow(z - m0 / n, 2)) / max(n) as var
  from prof group by k),
moments as (select k, sum(z * i * dt) / max(m0) as mu from prof group by k),
spread as (select k, sqrt(sum(z * pow(i * dt - mu, 2)) / max(m0) + {EPS}) as sigma from prof join moments using (k) group by k),
skew as (select k, sum(z * pow((i * dt - mu) / (sigma + {EPS}), 3)) / (max(m0) + {EPS}) as gamma from prof join moments using (k) join spread using (k) group by k),
sums as (
  select k, sum(case when x >= 0.5 * vmax then 1 else 0 end) as w50, sum(case when x >= 0.8 * vmax then 1 else 0 end) as w80,
         sum(case when i < ceil(n / 2.0) then z else 0 end) * max(dt) as a1, sum(case when i >= ceil(n / 2.0) then z else 0 end) * max(dt) as a2,
         sum(case when i < ceil(n / 3.0) then z else 0 end) * max(dt) as b1, sum(case when i >= ceil(n / 3.0) then z else 0 end) * max(dt) as b2,
         sum(case when i + 1 < n then d1 - (i + 1.0) / n else 0 end) / max(n) as dti,
         min(case when x = vmax then i end) as imax, min(case when x = vmin then i end) as imin,
         avg(case when i >= floor(0.75 * n + 1e-12) and i < ceil(0.90 * n - 1e-12) then x end) as late,
         exp(-sum(case when z > 0 then z / m0 * ln(n * z / m0) else 0 end)) as nt
  from prof group by k),
grads as (select k, max(g) as gmax, min(g) as gmin, sum(g * g) as gg, arg_min(i, (-round(g, 12), i)) as irise, arg_min(i, (round(g, 12), i)) as ifall from slope group by k),
shape as (
  select base.*, mu as mu_t, mu / base.T as mu_t_over_T, sigma as sigma_t, sigma / base.T as sigma_t_over_T, gamma as gamma_t,
         t10_over_T, t25_over_T, t50_over_T, t75_over_T, t90_over_T, t75_over_T - t25_over_T as Q_t_width,
         ((t90_over_T - t50_over_T) - (t50_over_T - t10_over_T)) / (t90_over_T - t10_over_T + {EPS}) as Q_t_skew,
         w50 / base.n as W50_over_T, w80 / base.n as W80_over_T, greatest(0, least(1, 1 - vmin / vmax)) as RI, (vmax - vmin) / vbar as PI, vmax / sqrt(ms) as CF,
         a1 / (a2 + {EPS}) as R_VTI, b1 / (b1 + b2 + {EPS}) as SF_VTI, dti as Delta_DTI,
         d10_over_D, d25_over_D, d50_over_D, d75_over_D, d90_over_D, d75_over_D - d25_over_D as Q_d_width,
         ((d90_over_D - d50_over_D) - (d50_over_D - d10_over_D)) / (d90_over_D - d10_over_D + {EPS}) as Q_d_skew,
         imax / base.n as t_max_over_T, imin / base.n as t_min_over_T, base.T * gmax / (vbar + {EPS}) as S_rise, base.T * abs(gmin) / (vbar + {EPS}) as S_fall,
         irise / base.n as t_rise_over_T, ifall / base.n as t_fall_over_T, late / (vbar + {EPS}) as v_end_over_vbar,
         (c1 * c1 + s1 * s1) / ((var + case when base.n % 2 = 0 then ny * ny else 0 end) / 2 - (c1 * c1 + s1 * s1)) as E_LF_over_E_HF,
         case when var > 0 then 1 - (case when base.n > 20 then var - ({_KEPT.replace('> n', '> base.n').replace('= n', '= base.n')}) else 0 end) / var end as eta_h,
         m0 * m0 / (base.n * sq) as N_eff_over_T, nt as N_t_over_T, case when base.n >= 3 then pow(base.T, 3) * gg * dt / pow(m0 * dt + {EPS}, 2) end as E_slope
  from base join quants using (k) join spectrum using (k) join moments using (k) join spread using (k) join skew using (k) join sums using (k) join grads using (k))"""


def unsigned(text: str) -> str:
    """Every round(...) with 0 added, which turns a negative zero into zero."""
    out, at = [], 0
    while (start := text.find("round(", at)) >= 0:
        if start and (text[start - 1].isalnum() or text[start - 1] == "_"):
            out.append(text[at : start + 6])
            at = start + 6
            continue
        depth, end = 1, start + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        out.append(f"{text[at:start]}(round({unsigned(text[start + 6 : end - 1])}) + 0)")
        at = end
    return "".join(out) + text[at:]


def ctes(view: str, *parts: str) -> str:
    return "with " + ",".join([VIEWS[view], *parts])


def shape(view: str) -> str:
    return ctes(view, PREPARED, SHAPE)


def rounded(names, digits) -> str:
    return ", ".join(f"round({n}, {digits(n) if callable(digits) else digits}) as {n}" for n in names)

#: Absolute metrics, from ``rect``, ``base`` and ``prof``.
ABSOLUTE = f"""
gaps as (
  select k, i, x, n, dt, lag(i) over w as il, lag(x) over w as xl, lead(i) over w as ir, lead(x) over w as xr
  from prof where x is not null window w as (partition by k order by i)),
deriv as (
  select k, i, dt, case when il is null and ir is null then null when il is null then (xr - x) / (ir - i) when ir is null then (x - xl) / (i - il)
    else ((i - il) * (i - il) * xr + ((ir - i) * (ir - i) - (i - il) * (i - il)) * x - (ir - i) * (ir - i) * xl) / ((i - il) * (ir - i) * (ir - il)) end / dt as g
  from gaps),
dsum as (
  select k, max(g) as dvdt_max, min(g) as dvdt_min, abs(min(g)) as dvdt_fall_abs_max, sqrt(avg(g * g)) as dvdt_rms, avg(abs(g)) as dvdt_abs_mean, stddev_pop(g) as dvdt_std,
         sum(g * g) * max(dt) as dvdt_energy, sum(abs(g)) * max(dt) as total_variation, sum(greatest(g, 0)) * max(dt) as positive_variation, sum(greatest(-g, 0)) * max(dt) as negative_variation,
         arg_min(i, (-round(g, 9), i)) * max(dt) as t_upstroke_max, arg_min(i, (round(g, 9), i)) * max(dt) as t_downstroke_max
  from deriv where g is not null group by k),
med as (select k, quantile_cont(x, 0.5) as m from prof group by k),
spec as (select k, max(n) as n, sum(z) / max(n) as c0, {_H} 0 as zero from prof group by k),
asum as (
  select p.k, quantile_cont(x, 0.05) as v_p05, quantile_cont(x, 0.10) as v_p10, quantile_cont(x, 0.25) as v_p25, quantile_cont(x, 0.5) as v_p50, quantile_cont(x, 0.75) as v_p75,
         quantile_cont(x, 0.90) as v_p90, quantile_cont(x, 0.95) as v_p95, quantile_cont(abs(x - m), 0.5) as v_mad, stddev_pop(x) as vstd, sum(x) * max(dt) as vti_total,
         sum(pow(x - vbar, 2)) as dev, sum(abs(x - vbar)) as adev, count(x) as nx, sum(x * x) as sqx,
         {", ".join(f"coalesce(sum(case when i >= {a} and i < {b} then x end), 0) * max(dt) as {m}" for m, a, b in [
            ("vti_0_10", "0", "ceil(n * 0.1 - 1e-12)"), ("vti_0_25", "0", "ceil(n * 0.25 - 1e-12)"), ("vti_0_33", "0", "ceil(n / 3.0 - 1e-12)"), ("vti_0_50", "0", "ceil(n * 0.5 - 1e-12)"),
            ("vti_0_75", "0", "ceil(n * 0.75 - 1e-12)"), ("vti_75_90", "floor(n * 0.75 + 1e-12)", "ceil(n * 0.9 - 1e-12)"), ("vti_90_100", "floor(n * 0.9 + 1e-12)", "n"), ("vti_late_half", "floor(n * 0.5 + 1e-12)", "n")])},
         sum(x - vmin) * max(dt) as vti_above_min, sum(greatest(x - vbar, 0)) * max(dt) as vti_above_mean_pos, sum(greatest(vbar - x, 0)) * max(dt) as vti_below_mean_abs,
         {", ".join(f"avg(case when i >= {a} and i < {b} then x end) as {m}" for m, a, b in [
            ("v_start_mean", "0", "ceil(n * 0.1 - 1e-12)"), ("v_early_mean", "0", "ceil(n / 3.0 - 1e-12)"), ("v_mid_mean", "floor(n / 3.0 + 1e-12)", "ceil(n * 2 / 3.0 - 1e-12)"),
            ("v_late_mean", "floor(n * 2 / 3.0 + 1e-12)", "n"), ("vend_mean", "floor(n * 0.75 + 1e-12)", "ceil(n * 0.9 - 1e-12)"), ("v_final_mean", "floor(n * 0.9 + 1e-12)", "n")])},
         max(case when i < ceil(n / 3.0 - 1e-12) then x end) as v_early_max, min(case when i >= floor(n * 0.5 + 1e-12) then x end) as v_late_min,
         min(case when x = vmax then i end) as imax, min(case when x = vmin then i end) as imin
  from prof p join med using (k) group by p.k),
absolute as (
  select base.*, vbar as vmean, v_p50 as vmedian, sqrt(sqx / asum.nx) as vrms, vmax - vmin as v_range, vmax - vbar as v_peak_above_mean, vbar - vmin as v_mean_above_min,
         asum.* exclude (k, nx), v_p75 - v_p25 as v_iqr, sqrt(dev / asum.nx) as v_ac_rms, adev / asum.nx as v_ac_abs_mean, adev * base.dt as v_ac_abs_integral,
         vti_above_mean_pos as v_positive_pulsatile_integral, vti_below_mean_abs as v_negative_pulsatile_integral, vmax - vmin as v_peak_to_peak,
         imax * base.dt as t_vmax, imin * base.dt as t_vmin, dsum.* exclude (k),
         case when imin != imax then ((imin - imax + base.n) % base.n) * base.dt end as peak_to_trough_time, base.T as beat_period,
         c0 as dc_level, {", ".join(f"case when {h} * 2 <= base.n then sqrt(c{h} * c{h} + s{h} * s{h}) * (case when {h} * 2 = base.n then 1 else 2 end) end as {m}" for h, m in ((1, "fundamental_amp"), (2, "second_harmonic_amp"), (3, "third_harmonic_amp")))},
         {" + ".join(f"(case when {h} * 2 <= base.n then c{h} * c{h} + s{h} * s{h} else 0 end)" for h in range(1, 11))} as pulsatile_harmonic_power,
         {" + ".join(f"(case when {h} * 2 <= base.n then c{h} * c{h} + s{h} * s{h} else 0 end)" for h in range(2, 11))} as higher_harmonic_power,
         c1 * c1 + s1 * s1 as low_harmonic_power, sqrt({_KEPT.replace('> n', '> base.n').replace('= n', '= base.n')}) as bandlimited_ac_rms_from_harmonics,
         sqx * base.dt as signal_energy, sqx / asum.nx as signal_mean_square, dev * base.dt as pulsatile_energy, dev / asum.nx as pulsatile_mean_square,
         adev * base.dt as absolute_deviation_energy, pow(vti_total, 2) / base.T as vti_squared_over_T
  from base join asum using (k) left join dsum using (k) join spec using (k))"""


def absolute(view: str) -> str:
    return ctes(view, PREPARED, ABSOLUTE)


#: Complex coefficients 0 .. 10 of every waveform without a missing sample, and normalised ones.
HARMONICS = f"""
whole as (select k from samples group by k having count(raw) = max(n) and max(n) >= 2),
coeff as (
  select s.k, {KEYS}, h, sum(raw * cos(2 * pi() * h * i / n)) / max(n) as re, -sum(raw * sin(2 * pi() * h * i / n)) / max(n) as im
  from samples s join whole using (k) cross join unnest(range(11)) as u(h) where h <= n // 2 group by s.k, {KEYS}, h),
norm as (
  select c.k, c.acq, c.cohort, c.beat, c.branch, c.radius, c.h, (c.re * o.re + c.im * o.im) / (o.re * o.re + o.im * o.im) as re, (c.im * o.re - c.re * o.im) / (o.re * o.re + o.im * o.im) as im,
         sqrt(c.re * c.re + c.im * c.im) / (sqrt(o.re * o.re + o.im * o.im) + {EPS}) as rel_amp
  from coeff c join coeff o on o.k = c.k and o.h = 1 where c.h >= 2),
valid as (select *, sqrt(re * re + im * im) as size, atan2(im, re) as phase from norm where rel_amp > 0.05)"""


def harmonics(view: str) -> str:
    return ctes(view, HARMONICS)


#: Long rows of three shape metrics of the line items, as segment metrics.
SEGMENTS = f"""
metrics as (
  select acq, cohort, beat, branch, radius, metric, value from (select {KEYS}, RI, PI, SF_VTI from shape) unpivot (value for metric in (RI, PI, SF_VTI)))"""

VARIABILITY = f"""
ofbeat as (select acq, metric, beat, quantile_cont(value, 0.5) as mb from metrics where value is not null group by acq, metric, beat),
ofseg as (select acq, metric, branch, radius, quantile_cont(value, 0.5) as ms from metrics where value is not null group by acq, metric, branch, radius),
cell as (select m.*, mb, ms from metrics m join ofbeat using (acq, metric, beat) join ofseg using (acq, metric, branch, radius) where value is not null),
overseg as (
  select acq, cohort, metric, beat, quantile_cont(value, 0.5) as med, case when count(*) = 1 then 0 else stddev_samp(value) end as std, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) as iqr,
         quantile_cont(abs(value - mb), 0.5) as mad, case when count(*) = 1 then 0 else stddev_samp(value) end / (abs(avg(value)) + {EPS}) as cv
  from cell group by all),
overbeat as (
  select acq, cohort, metric, branch, radius, case when count(*) = 1 then 0 else stddev_samp(value) end as std, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) as iqr,
         quantile_cont(abs(value - ms), 0.5) as mad, case when count(*) = 1 then 0 else stddev_samp(value) end / (abs(avg(value)) + {EPS}) as cv
  from cell group by all),
higher as (
  select * from (
    select acq, cohort, metric, quantile_cont(med, 0.5) as MED_seg_medbeat, quantile_cont(std, 0.5) as STD_seg_medbeat, quantile_cont(iqr, 0.5) as IQR_seg_medbeat,
           quantile_cont(mad, 0.5) as MAD_seg_medbeat, quantile_cont(cv, 0.5) as CV_seg_medbeat from overseg group by all)
  join (
    select acq, cohort, metric, quantile_cont(std, 0.5) as STD_beat_medseg, quantile_cont(iqr, 0.5) as IQR_beat_medseg, quantile_cont(mad, 0.5) as MAD_beat_medseg,
           quantile_cont(cv, 0.5) as CV_beat_medseg from overbeat group by all) using (acq, cohort, metric)),
score as (
  select acq, cohort, metric, (STD_seg_medbeat / (abs(MED_seg_medbeat) + {EPS}) + IQR_seg_medbeat / (abs(MED_seg_medbeat) + {EPS}) + MAD_seg_medbeat / (abs(MED_seg_medbeat) + {EPS}) + CV_seg_medbeat) / 4 as value from higher),
medians as (
  select metric, quantile_cont(value, 0.5) filter (cohort = 'control') as control_median, quantile_cont(value, 0.5) filter (cohort != 'control') as group_median from score group by metric)"""


def variability() -> str:
    return ctes("line_items", PREPARED, SHAPE, SEGMENTS, VARIABILITY)


#: Rank statistics and cumulative sweeps of ``vals`` (g: group keys as one text, value, path boolean).
RANKS = """
steps as (
  select g, value, sum(case when path then 0 else 1 end) as c, sum(case when path then 1 else 0 end) as p from vals where value is not null group by g, value),
cum as (
  select *, sum(c) over w as ct, sum(p) over w as pt, sum(c) over (partition by g) as ca, sum(p) over (partition by g) as pa, lead(value) over (partition by g order by value) as nxt
  from steps window w as (partition by g order by value rows unbounded preceding)),
pairs as (select a.g, sum(case when b.value > a.value then 1.0 when b.value = a.value then 0.5 else 0 end) as u, count(*) as n from vals a join vals b on a.g = b.g and not a.path and b.path group by a.g)"""
