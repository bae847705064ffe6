"""Shape metrics of a waveform: 39 scalars that a gain does not change, and diagnostics.

All work on the rectified waveform (negative samples are zero, missing ones
count as zero in sums). A waveform without positive area, or with a period that
isn't finite and positive, has null metrics.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsecohort.functions import wave
from pulsecohort.functions.wave import EPS
from pulsecohort.sources.views import KEYS

QUANTILES = (10, 25, 50, 75, 90)
LATE = (0.75, 0.90)
HIGHEST = 10
LOW_HIGHEST = 1

TIMING = ["mu_t", "mu_t_over_T", "sigma_t", "sigma_t_over_T", "gamma_t"]
T_QUANTILES = [*(f"t{q}_over_T" for q in QUANTILES), "Q_t_width", "Q_t_skew"]
WIDTHS = ["W50_over_T", "W80_over_T"]
PULSATILITY = ["RI", "PI", "CF"]
VTI = ["R_VTI", "SF_VTI", "Delta_DTI"]
D_QUANTILES = [*(f"d{q}_over_D" for q in QUANTILES), "Q_d_width", "Q_d_skew"]
KINETICS = ["t_max_over_T", "t_min_over_T", "S_rise", "S_fall", "t_rise_over_T", "t_fall_over_T", "v_end_over_vbar"]
SPECTRAL = ["E_LF_over_E_HF", "eta_h"]
SUPPORT = ["N_eff_over_T", "N_t_over_T"]
SLOPE = ["E_slope"]
METRICS = [*TIMING, *T_QUANTILES, *WIDTHS, *PULSATILITY, *VTI, *D_QUANTILES, *KINETICS, *SPECTRAL, *SUPPORT, *SLOPE]


def prepared(waveforms: DataFrame) -> DataFrame:
    """The parts that several metrics share, each computed once: p, z, m0, n, d, g."""
    v = wave.rectified(wave.clean(F.col("v")))
    out = waveforms.withColumn("p", v).withColumn("z", wave.filled(F.col("p"))).withColumn("m0", wave.total(F.col("z"))).withColumn("n", F.size("z").cast("double"))
    ok = (F.col("n") > 0) & (F.col("T") > 0) & (F.col("T") < float("inf")) & (F.col("m0") > 0)
    out = out.withColumn("ok", F.coalesce(ok, F.lit(False)))
    out = out.withColumn("d", F.transform(wave.cumulative(F.col("z")), lambda x: F.try_divide(x, F.col("m0"))))
    return out.withColumn("dt", F.try_divide("T", "n")).withColumn("g", F.when(F.col("ok"), wave.gradient(F.col("z"), F.col("dt")))).withColumn("vbar", wave.mean(F.col("p")))


def quantile_time(q: float) -> Column:
    """Phase at which the cumulative profile passes q: from the last point at or under it, linearly."""
    j = F.size(F.filter("d", lambda x: x <= q)) - 1
    low, high = wave.at(F.col("d"), j), wave.at(F.col("d"), j + 1)
    return j / F.col("n") + F.try_divide(q - low, high - low) / F.col("n")


def profile_at(q: float) -> Column:
    """The cumulative profile at a phase."""
    x = F.lit(q) * F.col("n")
    j = F.floor(x + EPS)
    low = wave.at(F.col("d"), j)
    return low + (x - j) * (wave.at(F.col("d"), j + 1) - low)


def _half(share: Column) -> tuple[Column, Column]:
    k = F.ceil(share - EPS)
    first = wave.weighted(F.col("z"), lambda x, i: F.when(i < k, x).otherwise(0.0))
    return first, F.col("m0") - first


def expressions() -> dict[str, Column]:
    """Metric name to column, over the columns of ``prepared``."""
    z, p, n, t, m0, dt, g = (F.col(c) for c in ("z", "p", "n", "T", "m0", "dt", "g"))
    mu, sigma, vbar = F.col("mu_t"), F.col("sigma_t"), F.col("vbar")
    top, low = F.array_max(p), F.array_min(p)
    square = wave.total_of(z, lambda x: x * x)
    r1, r2 = _half(n / 2)
    s1, s2 = _half(n / 3)
    slopes = wave.total_of(g, lambda x: x * x)
    var = wave.total_of(z, lambda x: F.pow(x - m0 / n, 2)) / n
    first = wave.power(wave.dft(z, 1))
    nyquist = F.when(n % 2 == 0, wave.power(wave.dft(z, n / 2))).otherwise(0.0)
    high = (var + nyquist) / 2 - F.when(n >= 2, first)
    kept = wave.total(F.transform(wave.spectrum(z, HIGHEST), lambda c, h: F.when(h > 0, wave.power(c) * wave.multiplicity(h, n)).otherwise(0.0)))
    out = {
        "mu_t": wave.weighted(z, lambda x, i: x * i * dt) / m0,
        "mu_t_over_T": mu / t,
        "sigma_t": F.sqrt(wave.weighted(z, lambda x, i: x * F.pow(i * dt - mu, 2)) / m0 + EPS),
        "sigma_t_over_T": sigma / t,
        "gamma_t": wave.weighted(z, lambda x, i: x * F.pow((i * dt - mu) / (sigma + EPS), 3)) / (m0 + EPS),
        **{f"t{q}_over_T": quantile_time(q / 100) for q in QUANTILES},
        "Q_t_width": F.col("t75_over_T") - F.col("t25_over_T"),
        "Q_t_skew": ((F.col("t90_over_T") - F.col("t50_over_T")) - (F.col("t50_over_T") - F.col("t10_over_T"))) / (F.col("t90_over_T") - F.col("t10_over_T") + EPS),
        **{f"W{a}_over_T": F.size(F.filter(p, lambda x: x >= a / 100 * top)) / n for a in (50, 80)},
        "RI": F.when(top > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - low / top))),
        "PI": F.try_divide(top - low, vbar),
        "CF": F.try_divide(top, F.sqrt(F.try_divide(wave.total_of(p, lambda x: x * x), wave.count(p)))),
        "R_VTI": r1 * dt / (r2 * dt + EPS),
        "SF_VTI": s1 * dt / (s1 * dt + s2 * dt + EPS),
        "Delta_DTI": wave.total(F.transform(F.slice("d", F.lit(2), F.greatest(n.cast("int") - 1, F.lit(0))), lambda x, i: x - (i + 1) / n)) / n,
        **{f"d{q}_over_D": profile_at(q / 100) for q in QUANTILES},
        "Q_d_width": F.col("d75_over_D") - F.col("d25_over_D"),
        "Q_d_skew": ((F.col("d90_over_D") - F.col("d50_over_D")) - (F.col("d50_over_D") - F.col("d10_over_D"))) / (F.col("d90_over_D") - F.col("d10_over_D") + EPS),
        "t_max_over_T": wave.argmax(p) / n,
        "t_min_over_T": wave.argmin(p) / n,
        "S_rise": t * F.array_max(g) / (vbar + EPS),
        "S_fall": t * F.abs(F.array_min(g)) / (vbar + EPS),
        "t_rise_over_T": F.when(g.isNotNull(), wave.argmax(g) / n),
        "t_fall_over_T": F.when(g.isNotNull(), wave.argmin(g) / n),
        "v_end_over_vbar": wave.mean(wave.window(p, *LATE)) / (vbar + EPS),
        "E_LF_over_E_HF": F.when(high > EPS * first, first / high),
        "eta_h": F.when(var > 0, 1 - F.when(n > 2 * HIGHEST, var - kept).otherwise(0.0) / var),
        "N_eff_over_T": F.try_divide(m0 * m0, n * square),
        "N_t_over_T": F.exp(-wave.total_of(z, lambda x: F.when(x > 0, x / m0 * F.log(n * x / m0)).otherwise(0.0))),
        "E_slope": F.when(n >= 3, F.pow(t, 3) * slopes * dt / F.pow(m0 * dt + EPS, 2)),
    }
    return out


def shape_metrics(waveforms: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """The waveform's keys, T and the metrics asked for (all by default), one row a waveform."""
    wanted = METRICS if metrics is None else metrics
    every = expressions()
    needs = {"mu_t_over_T": ["mu_t"], "sigma_t": ["mu_t"], "sigma_t_over_T": ["mu_t", "sigma_t"], "gamma_t": ["mu_t", "sigma_t"]}
    for k in ("t", "d"):
        unit = "T" if k == "t" else "D"
        needs |= {f"Q_{k}_width": [f"{k}{q}_over_{unit}" for q in (25, 75)], f"Q_{k}_skew": [f"{k}{q}_over_{unit}" for q in (10, 50, 90)]}
    base = prepared(waveforms)
    order = list(dict.fromkeys(x for m in wanted for x in [*needs.get(m, []), m]))
    for name in sorted(order, key=METRICS.index):
        base = base.withColumn(name, F.when(F.col("ok"), every[name]))
    return base.select(*[c for c in (*KEYS, "T") if c in waveforms.columns], *wanted)


def long_form(metrics: DataFrame, names: list[str]) -> DataFrame:
    """Keys, metric and value: one row a metric."""
    keys = [c for c in KEYS if c in metrics.columns]
    return metrics.select(*keys, *names).unpivot(keys, names, "metric", "value")


def roll_up(metrics: DataFrame, names: list[str]) -> DataFrame:
    """Per beat the median over radii of a branch, and over all segments (not the median of medians).

    scope is branch or global; branch is null for global. One pass, by grouping sets.
    """
    keys = ["acq", "cohort", "vessel", "representation", "beat"]
    sets = metrics.groupingSets([[*keys, "branch"], keys], *keys, "branch")
    out = sets.agg(F.grouping("branch").alias("_all"), *[F.median(m).alias(m) for m in names])
    return out.select(*keys, "branch", F.when(F.col("_all") == 1, "global").otherwise("branch").alias("scope"), *names)


def harmonic_diagnostics(waveforms: DataFrame, highest: int = HIGHEST) -> DataFrame:
    """Per harmonic 1 .. highest: magnitude, phase, energy, shares and the rolloff of the higher ones."""
    keys = [c for c in KEYS if c in waveforms.columns]
    base = prepared(waveforms).where("ok").withColumn("c", wave.spectrum(F.col("z"), highest))
    rows = base.select(*keys, F.posexplode_outer("c").alias("h", "c")).where("h > 0")
    rows = rows.withColumn("magnitude", F.sqrt(wave.power(F.col("c")))).withColumn("energy", wave.power(F.col("c"))).withColumn("phase", F.atan2("c.im", "c.re"))
    from pyspark.sql import Window

    whole = Window.partitionBy(*keys)
    run = whole.orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    higher = F.when(F.col("h") >= 2, F.col("magnitude"))
    rows = rows.withColumn("energy_weight", F.try_divide("energy", F.sum("energy").over(whole))).withColumn("amplitude_weight", F.try_divide("magnitude", F.sum("magnitude").over(whole)))
    rows = rows.withColumn("rolloff", F.when(F.col("h") >= 2, F.try_divide(F.sum(higher * higher).over(run), F.sum(higher * higher).over(whole))))
    first = F.max(F.when(F.col("h") == 1, F.col("phase"))).over(whole)
    turned = F.pmod(F.col("phase") - F.col("h") * first + math.pi, F.lit(2 * math.pi)) - math.pi
    return rows.withColumn("phase_lag", turned).drop("c")


ENERGY = ["E_total", "E_low", "E_low_over_E_total"]
ROLLOFF = ["m_50", "m_80", "rho_h", "w_h", "N_h_over_H"]
PHASE = ["D_phi", "t_phi_over_T", "s_phi_over_T"]
#: Share of the higher harmonics' power from which a harmonic's phase counts.
PHASE_SHARE = 0.02


def harmonic_summary(waveforms: DataFrame, highest: int = HIGHEST) -> DataFrame:
    """Per waveform the energy of its harmonics, the rolloff and support of the higher ones, and how their phases are organised.

    m_q is where the cumulative share of the energy of harmonics 2 .. H passes
    q; N_h is the exponential of its entropy. A phase lag is what a harmonic's
    phase differs from h times the fundamental's, wrapped; only harmonics with
    ``PHASE_SHARE`` of the higher power count. Null where there are no higher
    harmonics or no power in them.
    """
    keys = [c for c in KEYS if c in waveforms.columns]
    c = prepared(waveforms).where("ok").withColumn("c", wave.spectrum(F.col("z"), highest)).where("c is not null").select(*keys, "c")
    c = c.withColumn("p", F.transform("c", wave.power)).withColumn("first", F.get("c", F.lit(1)))
    c = c.withColumn("E_total", wave.total(F.slice("p", F.lit(2), F.greatest(F.size("p") - 1, F.lit(0))))).withColumn("E_low", wave.total(F.slice("p", F.lit(2), F.least(F.size("p") - 1, F.lit(LOW_HIGHEST)))))
    c = c.withColumn("E_low_over_E_total", F.try_divide("E_low", F.nullif("E_total", F.lit(0.0))))
    count = F.greatest(F.size("p") - 2, F.lit(0))
    c = c.withColumn("high", F.slice("p", F.lit(3), count)).withColumn("power", wave.total(F.col("high")))
    c = c.withColumn("share", F.when(F.col("power") > 0, F.transform("high", lambda x: x / F.col("power")))).withColumn("A", wave.cumulative(F.col("share")))

    def passes(q: float) -> Column:
        j = F.size(F.filter("A", lambda x: x <= q)) - 1
        low, up = wave.at(F.col("A"), j), wave.at(F.col("A"), j + 1)
        return F.when(F.col("share").isNotNull(), j + F.try_divide(q - low, up - low))

    higher = F.size("share").cast("double")
    c = c.withColumn("m_50", passes(0.5)).withColumn("m_80", passes(0.8)).withColumn("rho_h", F.col("m_80") / higher).withColumn("w_h", (F.col("m_80") - F.col("m_50")) / higher)
    entropy = wave.total_of(F.col("share"), lambda a: F.when(a > 0, -a * F.log(a)).otherwise(0.0))
    c = c.withColumn("N_h_over_H", F.when(F.col("share").isNotNull(), F.exp(entropy) / higher))

    def lag(x: Column, k: Column) -> Column:
        h = (k + 2).cast("double")
        turned = F.atan2(x["im"], x["re"]) - h * F.atan2(F.col("first.im"), F.col("first.re"))
        wrapped = F.pmod(turned + math.pi, F.lit(2 * math.pi)) - math.pi
        return F.struct(h.alias("h"), wrapped.alias("lag"), wave.power(x).alias("w"))

    lags = F.filter(F.transform(F.slice("c", F.lit(3), count), lag), lambda s: (s["w"] >= PHASE_SHARE * F.col("power")) & (s["w"] > 0))
    usable = (F.sqrt(wave.power(F.col("first"))) > EPS) & (F.col("power") > 0)
    c = c.withColumn("lags", F.when(usable, lags))
    turn = lambda f: wave.total(F.transform("lags", lambda s: s["w"] * f(s["lag"])))
    weight = wave.total(F.transform("lags", lambda s: s["w"]))
    c = c.withColumn("D_phi", F.when(F.size("lags") > 0, 1 - F.sqrt(F.pow(turn(F.cos) / weight, 2) + F.pow(turn(F.sin) / weight, 2))))
    c = c.withColumn("delays", F.transform("lags", lambda s: s["lag"] / (2 * math.pi * s["h"]))).withColumn("t_phi_over_T", wave.median(F.col("delays")))
    c = c.withColumn("s_phi_over_T", wave.median(F.transform("delays", lambda x: F.abs(x - F.col("t_phi_over_T")))))
    return c.select(*keys, *ENERGY, *ROLLOFF, *PHASE)


def bandlimited(waveforms: DataFrame, highest: int = HIGHEST) -> DataFrame:
    """Per sample the rectified waveform beside what its harmonics up to ``highest`` make of it."""
    keys = [c for c in KEYS if c in waveforms.columns]
    base = prepared(waveforms).where("ok").withColumn("vb", wave.reconstruct(wave.spectrum(F.col("z"), highest), F.size("z")))
    return base.select(*keys, F.posexplode_outer(F.arrays_zip(F.col("z").alias("signal"), F.col("vb").alias("vb"))).alias("i", "s")).select(*keys, "i", "s.signal", "s.vb")


def diagnostics(waveforms: DataFrame) -> DataFrame:
    """Per sample: tau, the rectified signal, cumulative profile, its excess over tau, first and second derivative."""
    keys = [c for c in KEYS if c in waveforms.columns]
    base = prepared(waveforms).where("ok").withColumn("g2", wave.gradient(F.col("g"), F.col("dt")))
    rows = base.select(*keys, "T", "n", "m0", "dt", "d", "g", "g2", F.posexplode_outer("z").alias("i", "signal"))
    tau = F.col("i") / F.col("n")
    scale = F.pow(F.col("m0") * F.col("dt") + EPS, 2)
    d, g, g2 = (wave.at(F.col(c), F.col("i")) for c in ("d", "g", "g2"))
    return rows.select(
        *keys, "i", tau.alias("tau"), "signal", d.alias("cumulative"), (d - tau).alias("delta_dti_curve"), g.alias("dvdt"), g2.alias("d2vdt2"),
        (F.pow("T", F.lit(3)) / scale * g * g).alias("dvdt_norm"), (F.pow("T", F.lit(5)) / scale * g2 * g2).alias("d2vdt2_norm"),
    )
