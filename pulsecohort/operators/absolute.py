"""Absolute metrics of a waveform: levels, integrals, events, derivatives, harmonics, energies and raw-against-band checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsecohort.functions import wave
from pulsecohort.functions.wave import EPS
from pulsecohort.operators.shape import prepared
from pulsecohort.sources.views import KEYS

HIGHEST = 10
LOW_HIGHEST = 1
PERCENTILES = (5, 10, 25, 50, 75, 90, 95)

LEVELS = ["vmax", "vmin", "vmean", "vmedian", "vrms", "vstd", "v_range", "v_peak_above_mean", "v_mean_above_min"]
ORDER = [*(f"v_p{q:02d}" for q in PERCENTILES), "v_iqr", "v_mad"]
INTEGRALS = ["vti_total", "vti_0_10", "vti_0_25", "vti_0_33", "vti_0_50", "vti_0_75", "vti_75_90", "vti_90_100", "vti_late_half", "vti_above_min", "vti_above_mean_pos", "vti_below_mean_abs"]
WINDOWED = ["v_start_mean", "v_early_mean", "v_mid_mean", "v_late_mean", "vend_mean", "v_final_mean", "v_early_max", "v_late_min"]
PULSATILE = ["v_ac_rms", "v_ac_abs_mean", "v_ac_abs_integral", "v_positive_pulsatile_integral", "v_negative_pulsatile_integral", "v_peak_to_peak"]
EVENTS = ["t_vmax", "t_vmin", "t_upstroke_max", "t_downstroke_max", "peak_to_trough_time", "beat_period"]
DERIVATIVE = ["dvdt_max", "dvdt_min", "dvdt_fall_abs_max", "dvdt_rms", "dvdt_abs_mean", "dvdt_std", "dvdt_energy", "total_variation", "positive_variation", "negative_variation"]
HARMONIC = ["dc_level", "fundamental_amp", "second_harmonic_amp", "third_harmonic_amp", "pulsatile_harmonic_power", "higher_harmonic_power", "low_harmonic_power", "bandlimited_ac_rms_from_harmonics"]
ARRAYS = ["harmonic_coeff_abs", "harmonic_amp", "harmonic_power"]
ENERGY = ["signal_energy", "signal_mean_square", "pulsatile_energy", "pulsatile_mean_square", "absolute_deviation_energy", "vti_squared_over_T"]
METRICS = [*LEVELS, *ORDER, *INTEGRALS, *WINDOWED, *PULSATILE, *EVENTS, *DERIVATIVE, *HARMONIC, *ENERGY]
QC = ["raw_minus_band_mean", "raw_minus_band_bias", "raw_minus_band_rms", "raw_minus_band_mae", "raw_minus_band_max_abs", "raw_minus_band_energy", "raw_minus_band_vti_abs", "raw_band_vti_difference", "raw_band_corr"]

#: Windows of the beat, as fractions, by metric.
VTI_WINDOWS = {"vti_0_10": (0, 0.10), "vti_0_25": (0, 0.25), "vti_0_33": (0, 1 / 3), "vti_0_50": (0, 0.50), "vti_0_75": (0, 0.75), "vti_75_90": (0.75, 0.90), "vti_90_100": (0.90, 1.0), "vti_late_half": (0.50, 1.0)}
LEVEL_WINDOWS = {"v_start_mean": (0, 0.10), "v_early_mean": (0, 1 / 3), "v_mid_mean": (1 / 3, 2 / 3), "v_late_mean": (2 / 3, 1.0), "vend_mean": (0.75, 0.90), "v_final_mean": (0.90, 1.0)}


def true_gradient(i: Column, x: Column) -> Column:
    """Derivative at present samples whose positions ``i`` may leave gaps: second order inside, one-sided at the ends."""
    n = F.size(x)

    def slope(_, k):
        a, b, c = wave.at(x, k - 1), wave.at(x, k), wave.at(x, k + 1)
        left, right = wave.at(i, k) - wave.at(i, k - 1), wave.at(i, k + 1) - wave.at(i, k)
        inner = (left * left * c + (right * right - left * left) * b - right * right * a) / (left * right * (left + right))
        return F.when(k == 0, (c - b) / right).when(k == n - 1, (b - a) / left).otherwise(inner)

    return F.when(n >= 2, F.transform(x, slope))


def with_parts(waveforms: DataFrame) -> DataFrame:
    """``prepared`` with present samples x, their positions at, deviations ac, derivative gd and harmonics c."""
    base = prepared(waveforms)
    base = base.withColumn("x", wave.present(F.col("p")))
    base = base.withColumn("at", F.filter(F.transform("p", lambda x, i: F.when(x.isNotNull(), i)), lambda i: i.isNotNull()))
    base = base.withColumn("ac", F.transform("x", lambda x: x - F.col("vbar")))
    base = base.withColumn("gd", F.transform(true_gradient(F.col("at"), F.col("x")), lambda s: s / F.col("dt")))
    size = lambda c: F.sqrt(wave.power(c))
    twice = lambda h: wave.multiplicity(h, F.col("n"))
    return base.withColumn("c", F.transform(wave.spectrum(F.col("z"), HIGHEST), lambda c, h: F.struct(c["re"].alias("re"), size(c).alias("abs"), (size(c) * twice(h)).alias("amp"), wave.power(c).alias("power"), twice(h).alias("twice"))))


def expressions() -> dict[str, Column]:
    x, p, ac, gd, c = (F.col(k) for k in ("x", "p", "ac", "gd", "c"))
    n, dt, t, vbar = F.col("n"), F.col("dt"), F.col("T"), F.col("vbar")
    k = F.size(x)
    top, low = F.array_max(x), F.array_min(x)
    square = wave.total_of(x, lambda v: v * v)
    dev = wave.total_of(ac, lambda v: v * v)
    absdev = wave.total_of(ac, F.abs)
    top_h = F.size(c) - 1
    power = lambda f: wave.total(F.transform(c, lambda v, h: F.when(f(h), v["power"]).otherwise(0.0)))
    ac_power = wave.total(F.transform(c, lambda v, h: F.when(h >= 1, v["power"] * v["twice"]).otherwise(0.0)))
    amp = lambda h: wave.at(c, F.lit(h))["amp"]
    mean = lambda v: F.try_divide(wave.total(v), F.size(v))
    imax, imin = wave.argmax(p), wave.argmin(p)
    gap = F.pmod(imin - imax, n)
    gmean = mean(gd)
    return {
        "vmax": top, "vmin": low, "vmean": vbar, "vmedian": wave.median(x), "vrms": F.sqrt(square / k), "vstd": F.sqrt(dev / k), "v_range": top - low,
        "v_peak_above_mean": top - vbar, "v_mean_above_min": vbar - low,
        **{f"v_p{q:02d}": wave.percentile(x, q / 100) for q in PERCENTILES},
        "v_iqr": wave.percentile(x, 0.75) - wave.percentile(x, 0.25),
        "v_mad": wave.median(F.transform(x, lambda v: F.abs(v - F.col("v_p50")))),
        "vti_total": wave.total(x) * dt,
        **{m: wave.total(wave.window(p, *w)) * dt for m, w in VTI_WINDOWS.items()},
        "vti_above_min": wave.total_of(x, lambda v: v - F.col("vmin")) * dt,
        "vti_above_mean_pos": wave.total_of(ac, lambda v: F.greatest(v, F.lit(0.0))) * dt,
        "vti_below_mean_abs": wave.total_of(ac, lambda v: F.greatest(-v, F.lit(0.0))) * dt,
        **{m: wave.mean(wave.window(p, *w)) for m, w in LEVEL_WINDOWS.items()},
        "v_early_max": F.array_max(wave.window(p, 0, 1 / 3)), "v_late_min": F.array_min(wave.window(p, 0.5, 1.0)),
        "v_ac_rms": F.sqrt(dev / k), "v_ac_abs_mean": absdev / k, "v_ac_abs_integral": absdev * dt,
        "v_positive_pulsatile_integral": wave.total_of(ac, lambda v: F.greatest(v, F.lit(0.0))) * dt,
        "v_negative_pulsatile_integral": wave.total_of(ac, lambda v: F.greatest(-v, F.lit(0.0))) * dt, "v_peak_to_peak": top - low,
        "t_vmax": imax * dt, "t_vmin": imin * dt,
        "t_upstroke_max": wave.at(F.col("at"), wave.argmax(gd)) * dt, "t_downstroke_max": wave.at(F.col("at"), wave.argmin(gd)) * dt,
        "peak_to_trough_time": F.when(gap != 0, gap * dt), "beat_period": t,
        "dvdt_max": F.array_max(gd), "dvdt_min": F.array_min(gd), "dvdt_fall_abs_max": F.abs(F.array_min(gd)),
        "dvdt_rms": F.sqrt(mean(F.transform(gd, lambda v: v * v))), "dvdt_abs_mean": mean(F.transform(gd, F.abs)),
        "dvdt_std": F.sqrt(mean(F.transform(gd, lambda v: F.pow(v - gmean, 2)))), "dvdt_energy": F.when(gd.isNotNull(), wave.total_of(gd, lambda v: v * v) * dt),
        "total_variation": F.when(k >= 2, wave.total_of(gd, F.abs) * dt), "positive_variation": F.when(k >= 2, wave.total_of(gd, lambda v: F.greatest(v, F.lit(0.0))) * dt),
        "negative_variation": F.when(k >= 2, wave.total_of(gd, lambda v: F.greatest(-v, F.lit(0.0))) * dt),
        "dc_level": wave.at(c, F.lit(0))["re"], "fundamental_amp": amp(1), "second_harmonic_amp": amp(2), "third_harmonic_amp": amp(3),
        "pulsatile_harmonic_power": F.when(top_h >= 1, power(lambda h: h >= 1)), "higher_harmonic_power": F.when(top_h >= 2, power(lambda h: h >= 2)),
        "low_harmonic_power": F.when(top_h >= 1, power(lambda h: (h >= 1) & (h <= LOW_HIGHEST))),
        "bandlimited_ac_rms_from_harmonics": F.when(top_h >= 1, F.sqrt(ac_power)),
        "signal_energy": square * dt, "signal_mean_square": square / k, "pulsatile_energy": dev * dt, "pulsatile_mean_square": dev / k,
        "absolute_deviation_energy": absdev * dt, "vti_squared_over_T": F.pow(wave.total(x) * dt, 2) / t,
        "harmonic_coeff_abs": F.transform(c, lambda v: v["abs"]), "harmonic_amp": F.slice(F.transform(c, lambda v: v["amp"]), F.lit(2), F.lit(HIGHEST)),
        "harmonic_power": F.transform(c, lambda v: v["power"]),
    }


def absolute_metrics(waveforms: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """The waveform's keys and the metrics asked for (all scalars by default)."""
    wanted = METRICS if metrics is None else metrics
    every = expressions()
    base = with_parts(waveforms)
    order = [m for m in (*METRICS, *ARRAYS) if m in wanted or (m == "v_p50" and "v_mad" in wanted) or (m == "vmin" and "vti_above_min" in wanted)]
    for name in order:
        base = base.withColumn(name, F.when(F.col("ok"), every[name]))
    return base.select(*[k for k in KEYS if k in waveforms.columns], *wanted)


def band_qc(pairs: DataFrame, rectify: bool = False) -> DataFrame:
    """Agreement of each raw waveform (raw) with its band-limited one (band), over samples that both have."""
    fix = wave.rectified if rectify else (lambda v: v)
    both = F.filter(F.arrays_zip(fix(wave.clean(F.col("raw"))).alias("a"), fix(wave.clean(F.col("band"))).alias("b")), lambda s: s["a"].isNotNull() & s["b"].isNotNull())
    base = pairs.withColumn("s", both).withColumn("k", F.size("s")).withColumn("dt", F.try_divide("T", F.size("raw")))
    base = base.withColumn("e", F.transform("s", lambda s: s["a"] - s["b"]))
    e, k, dt = F.col("e"), F.col("k"), F.col("dt")
    side = lambda c: F.transform("s", lambda s: s[c])
    ma, mb = wave.total(side("a")) / k, wave.total(side("b")) / k
    base = base.withColumn("ma", F.when(k > 0, ma)).withColumn("mb", F.when(k > 0, mb))
    va = wave.total(F.transform("s", lambda s: F.pow(s["a"] - F.col("ma"), 2)))
    vb = wave.total(F.transform("s", lambda s: F.pow(s["b"] - F.col("mb"), 2)))
    cov = wave.total(F.transform("s", lambda s: (s["a"] - F.col("ma")) * (s["b"] - F.col("mb"))))
    ss = wave.total_of(e, lambda x: x * x)
    out = {
        "raw_minus_band_mean": wave.total(e) / k, "raw_minus_band_bias": wave.total(e) * dt / F.col("T"), "raw_minus_band_rms": F.sqrt(ss / k), "raw_minus_band_mae": wave.total_of(e, F.abs) / k,
        "raw_minus_band_max_abs": F.array_max(F.transform(e, F.abs)), "raw_minus_band_energy": ss * dt, "raw_minus_band_vti_abs": wave.total_of(e, F.abs) * dt,
        "raw_band_vti_difference": wave.total(e) * dt, "raw_band_corr": F.when((F.sqrt(va / k) > EPS) & (F.sqrt(vb / k) > EPS), cov / F.sqrt(va * vb)),
    }
    return base.select(*[c for c in KEYS if c in pairs.columns], *[F.when(k > 0, f).alias(m) for m, f in out.items()])


def expected_range(metric: Column) -> Column:
    """Mathematical range of a metric by its name, not a physiological one: unit, positive, within_beat, signed or nonnegative."""
    signed = ["dvdt_max", "dvdt_min", "raw_minus_band_mean", "raw_minus_band_bias", "raw_band_vti_difference"]
    return (
        F.when(metric == "raw_band_corr", "unit").when(metric == "beat_period", "positive").when(metric.startswith("t_") | (metric == "peak_to_trough_time"), "within_beat")
        .when(metric.isin(signed), "signed").otherwise("nonnegative")
    )


def outside_range(rows: DataFrame, period: str = "T") -> DataFrame:
    """Rows of (metric, value, period) with ``kind`` and whether the value leaves its range; a null value never does."""
    x, t = F.col("value"), F.col(period)
    out = rows.withColumn("kind", expected_range(F.col("metric")))
    bad = F.when(F.col("kind") == "unit", F.abs(x) > 1 + 1e-9).when(F.col("kind") == "positive", x <= 0).when(F.col("kind") == "within_beat", (x < 0) | (x >= t)).when(F.col("kind") == "nonnegative", x < 0)
    return out.withColumn("outside", F.coalesce(bad, F.lit(False)))
