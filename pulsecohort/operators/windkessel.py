"""Artery-vein delay and RC constant of a beat by three estimators, their consensus and plausibility.

The three fits of one beat are small least squares over a fixed grid: they run
in Arrow batches, a beat a row, with no shuffle. Consensus, plausibility and
summaries are columns.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPS = 1e-12
#: Fixed values of the estimators.
HARMONICS = (1, 2, 3)
DELAYS = np.arange(-0.150, 0.150 + 0.001, 0.002)
A_MIN, A_MAX = 1e-4, 0.9999
ARX_SHARE = 0.25
LEAST_FINITE = 0.80
MAX_DELAY, MAX_TAU, LEAST_METHODS = 0.300, 5.0, 2

_FIT = {"accepted": "int", "Deltat": "double", "tau": "double", "residual": "double", "residual_norm": "double"}
FIELDS = {
    "freq": _FIT | {"k": "double", "harmonics_used": "int", "tau_phase_median": "double", "tau_amp_median": "double"},
    "time_integral": _FIT,
    "arx": _FIT | {"a": "double", "b": "double", "rows_used": "int", "stability_margin": "double"},
}
SCHEMA = ", ".join(f"{m} struct<{', '.join(f'{k}:{t}' for k, t in fields.items())}>" for m, fields in FIELDS.items())
METHODS = ("freq", "time_integral", "arx")


def prepare(x) -> np.ndarray | None:
    """A beat with its gaps filled linearly, flat at the ends; None if too much is missing."""
    x = np.array([np.nan if v is None else v for v in x], float)
    ok = np.isfinite(x)
    if not len(x) or ok.mean() < LEAST_FINITE:
        return None
    at = np.arange(len(x))
    return np.interp(at, at[ok], x[ok])


def unit_mean(x: np.ndarray) -> np.ndarray | None:
    m = x.mean()
    return x / m if abs(m) > EPS else None


def frequency_fit(qa: np.ndarray, qv: np.ndarray, period: float) -> dict | None:
    """Delay, tau and gain that bring k / (1 + i w tau) nearest to the ratio of harmonics, over the delay grid and its tau candidates."""
    n = len(qa)
    turn = np.exp(-2j * np.pi * np.outer(HARMONICS, np.arange(n)) / n)
    a, v = turn @ (qa - qa.mean()) / n, turn @ (qv - qv.mean()) / n
    use = np.abs(a) > EPS
    if use.sum() < 2:
        return None
    w, omega, h = np.abs(a[use]) ** 2, 2 * np.pi * np.array(HARMONICS)[use] / period, v[use] / a[use]
    shifted = h * np.exp(1j * omega * DELAYS[:, None])
    slope = 1j * omega * shifted
    size = (w * np.abs(slope) ** 2).sum(axis=1)
    if not (size > EPS).any():
        return None
    closed = np.maximum(0, (w * (slope.conj() * (1 - shifted)).real).sum(axis=1) / np.maximum(size, EPS))
    taus = np.sort(np.maximum(0, np.stack([0 * closed, closed, closed * 0.5, closed * 1.5, closed + 0.005, closed - 0.005], 1)), axis=1)
    model = 1 / (1 + 1j * omega * taus[..., None])
    gain = np.maximum(0, (w * (shifted[:, None] * model.conj()).real).sum(axis=2) / np.maximum((w * np.abs(model) ** 2).sum(axis=2), EPS))
    res = (w * np.abs(shifted[:, None] - gain[..., None] * model) ** 2).sum(axis=2)
    res[size <= EPS] = np.inf
    i, j = np.unravel_index(np.argmin(res), res.shape)
    k, tau = gain[i, j], taus[i, j]
    fixed = shifted[i] / k if k > EPS else shifted[i]
    phase = np.maximum(0, np.tan(-np.angle(fixed)) / omega)
    size_ok = (np.abs(fixed) > 0) & (np.abs(fixed) <= 1)
    amp = np.sqrt(1 / np.abs(fixed[size_ok]) ** 2 - 1) / omega[size_ok]
    return {
        "accepted": 1, "Deltat": DELAYS[i], "tau": tau, "residual": res[i, j], "residual_norm": res[i, j] / max((w * np.abs(h) ** 2).sum(), EPS), "k": k,
        "harmonics_used": int(use.sum()), "tau_phase_median": np.median(phase), "tau_amp_median": np.median(amp) if len(amp) else None,
    }


def running_integral(x: np.ndarray, dt: float) -> np.ndarray:
    return np.concatenate([np.zeros((*x.shape[:-1], 1)), np.cumsum((x[..., 1:] + x[..., :-1]) * dt / 2, axis=-1)], axis=-1)


def time_integral_fit(qa: np.ndarray, qv: np.ndarray, period: float) -> dict | None:
    """Delay and tau for which the running inflow less outflow is nearest to tau (qv - qv0); the shift is periodic."""
    qa, qv = unit_mean(qa), unit_mean(qv)
    if qa is None or qv is None or len(qa) < 3:
        return None
    n = len(qa)
    f = np.fft.rfftfreq(n, d=period / n)
    moved = np.fft.irfft(np.fft.rfft(qa) * np.exp(-2j * np.pi * DELAYS[:, None] * f), n=n, axis=1)
    y = running_integral(moved, period / n) - running_integral(qv, period / n)
    x = qv - qv[0]
    size = (x * x).sum()
    if size <= EPS:
        return None
    tau = np.maximum(0, y @ x / size)
    res = ((y - tau[:, None] * x) ** 2).sum(axis=1)
    i = int(np.argmin(res))
    return {"accepted": 1, "Deltat": DELAYS[i], "tau": tau[i], "residual": res[i], "residual_norm": res[i] / size}


def arx_fit(qa: np.ndarray, qv: np.ndarray, period: float) -> dict | None:
    """qv[i] = a qv[i-1] + b qa[i-d]: the delay d whose clipped least squares leave least."""
    qa, qv = unit_mean(qa), unit_mean(qv)
    if qa is None or qv is None or len(qa) < 5:
        return None
    n = len(qa)
    dt, most, best = period / n, max(1, int(ARX_SHARE * n)), None
    for d in range(-most, most + 1):
        at = np.arange(max(1, d), min(n, n + d))
        if len(at) < 3:
            continue
        rows, y = np.stack([qv[at - 1], qa[at - d]], 1), qv[at]
        theta = np.linalg.lstsq(rows, y, rcond=None)[0]
        a = float(np.clip(theta[0], A_MIN, A_MAX))
        res = float(((y - rows @ (a, theta[1])) ** 2).sum())
        if best is None or res < best["residual"]:
            best = {
                "accepted": 1, "Deltat": d * dt, "tau": -dt / np.log(a), "residual": res, "residual_norm": res / max((y * y).sum(), EPS), "a": a, "b": float(theta[1]),
                "rows_used": len(at), "stability_margin": min(a - A_MIN, A_MAX - a),
            }
    return best


def fits(pairs: DataFrame) -> DataFrame:
    """``pairs`` (keys, T, qa, qv) with a struct of each estimator's fit; a beat that cannot be fitted has accepted 0."""

    @F.pandas_udf(SCHEMA)
    def fit(period: pd.Series, qa: pd.Series, qv: pd.Series) -> pd.DataFrame:
        out = []
        for t, x, y in zip(period, qa, qv):
            a, v = prepare(x), prepare(y)
            usable = a is not None and v is not None and t is not None and np.isfinite(t) and t > 0
            row = {m: (f(a, v, t) if usable else None) or {"accepted": 0} for m, f in (("freq", frequency_fit), ("time_integral", time_integral_fit), ("arx", arx_fit))}
            out.append(row)
        return pd.DataFrame({m: [{k: r[m].get(k) for k in FIELDS[m]} for r in out] for m in METHODS})

    return pairs.withColumn("fit", fit("T", "qa", "qv")).select(*[c for c in pairs.columns if c not in ("qa", "qv")], "fit.*")


def consensus(fitted: DataFrame, prefix: str = "") -> DataFrame:
    """Median tau and delay over the methods, their ranges, how many are valid, and each method's plausibility flags."""
    from pulsecohort.functions import wave

    tau = F.filter(F.array(*[F.col(f"{m}.tau") for m in METHODS]), lambda x: x.isNotNull())
    delay = F.filter(F.array(*[F.col(f"{m}.Deltat") for m in METHODS]), lambda x: x.isNotNull())
    span = lambda a: F.when(F.size(a) >= 2, F.array_max(a) - F.array_min(a))
    out = fitted.withColumn("_t", tau).withColumn("_d", delay)
    flags = []
    for m in METHODS:
        flags += [
            F.coalesce((F.col(f"{m}.tau") > 0) & (F.col(f"{m}.tau") <= MAX_TAU), F.lit(False)).cast("int").alias(f"{m}_tau_reasonable"),
            F.coalesce(F.abs(f"{m}.Deltat") <= MAX_DELAY, F.lit(False)).cast("int").alias(f"{m}_delay_reasonable"),
        ]
    return out.select(
        *[c for c in fitted.columns], F.size("_t").alias("methods_valid_count"), wave.median(F.col("_t")).alias("tau_consensus_median"), wave.median(F.col("_d")).alias("delay_consensus_median"),
        span(F.col("_t")).alias("tau_intermethod_range"), (span(F.col("_t")) / F.greatest(F.abs(wave.median(F.col("_t"))), F.lit(EPS))).alias("tau_intermethod_rel_range"),
        span(F.col("_d")).alias("delay_intermethod_range"), (F.size("_t") >= LEAST_METHODS).cast("int").alias("tau_consensus_available"), *flags,
    )


def summaries(agreed: DataFrame, keys: list[str]) -> DataFrame:
    """Fractions and medians over the beats of an acquisition, one column each."""
    mean = lambda c: F.avg(c).alias(f"{c}_fraction")
    return agreed.groupBy(*keys).agg(
        *[mean(f"{m}_{w}_reasonable") for m in METHODS for w in ("tau", "delay")], F.avg("tau_consensus_available").alias("consensus_available_fraction"),
        F.median("tau_intermethod_rel_range").alias("tau_intermethod_rel_range_median"), F.median("delay_intermethod_range").alias("delay_intermethod_range_median"),
        F.median("methods_valid_count").alias("methods_valid_count_median"),
        *[f(F.col(f"{m}.{c}")).alias(f"{m}_{c}_{n}") for m in METHODS for c in ("tau", "Deltat") for f, n in ((F.median, "median"), (F.avg, "mean"), (F.stddev_pop, "std"), (F.count, "n_valid"))],
        *[F.median(f"{m}.residual_norm").alias(f"{m}_residual_norm_median") for m in METHODS],
    )
