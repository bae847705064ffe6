"""Windowed filters of a waveform as columns, the robust Whittaker smoother in Arrow batches, and their compositions."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsecohort.functions import wave
from pulsecohort.functions.wave import EPS

#: Scale that makes the median absolute deviation of a normal sample its standard deviation.
MAD_SCALE = 1.4826
LEAST_SAMPLES, LEAST_SHARE = 32, 0.5
HARMONICS = 12


def gap_fill(v: Column) -> Column:
    """Linear between the neighbours that are there, flat outside them."""
    i = F.transform(v, lambda x, i: F.when(x.isNotNull(), i))

    def fill(x, k):
        left = F.array_max(F.slice(i, F.lit(1), k + 1))
        right = F.array_min(F.slice(i, k + 1, F.size(v)))
        a, b = wave.at(v, left), wave.at(v, right)
        line = a + (b - a) * (k - left) / F.nullif((right - left).cast("double"), F.lit(0.0))
        return F.coalesce(x, line, a, b)

    return F.transform(v, fill)


def differences(v: Column) -> Column:
    return F.transform(F.slice(v, F.lit(2), F.greatest(F.size(v) - 1, F.lit(0))), lambda x, i: x - wave.at(v, i))


def mad_scale(v: Column) -> Column:
    m = wave.median(v)
    return MAD_SCALE * wave.median(F.transform(v, lambda x: F.abs(x - m)))


def despike(df: DataFrame, v: str, threshold: float = 4.0, window: int = 5) -> DataFrame:
    """Samples at a jump of more than ``threshold`` scaled deviations become the median of their reflected neighbourhood."""
    d = df.withColumn("_d", differences(F.col(v))).withColumn("_m", wave.median(F.col("_d"))).withColumn("_s", MAD_SCALE * wave.median(F.transform("_d", lambda x: F.abs(x - F.col("_m")))))
    jump = lambda i: F.coalesce(F.abs(wave.at(F.col("_d"), i) - F.col("_m")) > threshold * F.col("_s"), F.lit(False))
    local = lambda i: wave.median(wave.around(F.col(v), i, window // 2, True))
    out = F.transform(v, lambda x, i: F.when(jump(i - 1) | jump(i), local(i)).otherwise(x))
    usable = (F.size(v) >= 5) & (F.col("_s") > EPS)
    return d.withColumn(v, F.when(usable, out).otherwise(F.col(v))).drop("_d", "_m", "_s")


def hampel(df: DataFrame, v: str, window: int = 7, sigmas: float = 3.0) -> DataFrame:
    """A sample farther than ``sigmas`` scaled deviations from the median of its neighbourhood, cut at the ends, becomes that median."""
    near = F.transform(v, lambda x, i: wave.around(F.col(v), i, window // 2, False))
    d = df.withColumn("_near", near).withColumn("_m", F.transform("_near", wave.median))
    d = d.withColumn("_s", F.zip_with("_near", "_m", lambda a, m: MAD_SCALE * wave.median(F.transform(a, lambda x: F.abs(x - m)))))
    out = F.transform(v, lambda x, i: F.when((wave.at(F.col("_s"), i) > EPS) & (F.abs(x - wave.at(F.col("_m"), i)) > sigmas * wave.at(F.col("_s"), i)), wave.at(F.col("_m"), i)).otherwise(x))
    return d.withColumn(v, out).drop("_near", "_m", "_s")


def wiener(df: DataFrame, v: str, window: int = 7) -> DataFrame:
    """Each sample shrunk to its local mean by the share of the local variance that isn't noise; noise from the differences."""
    near = F.transform(v, lambda x, i: wave.around(F.col(v), i, window // 2, True))
    d = df.withColumn("_near", near).withColumn("_mean", F.transform("_near", wave.mean))
    d = d.withColumn("_var", F.zip_with("_near", "_mean", lambda a, m: wave.mean(F.transform(a, lambda x: (x - m) * (x - m)))))
    d = d.withColumn("_d", differences(F.col(v)))
    sigma = mad_scale(F.col("_d")) / math.sqrt(2)
    d = d.withColumn("_noise", F.when(sigma > EPS, sigma * sigma).otherwise(wave.median(F.col("_var"))))
    gain = lambda i: F.greatest(wave.at(F.col("_var"), i) - F.col("_noise"), F.lit(0.0)) / (wave.at(F.col("_var"), i) + EPS)
    out = F.transform(v, lambda x, i: wave.at(F.col("_mean"), i) + gain(i) * (x - wave.at(F.col("_mean"), i)))
    return d.withColumn(v, F.when((F.size(v) >= window) & (F.col("_noise") > 0), out).otherwise(F.col(v))).drop("_near", "_mean", "_var", "_d", "_noise")


def gaussian_kernel(sigma: float = 1.25) -> list[float]:
    radius = max(1, math.ceil(3 * sigma))
    k = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return (k / k.sum()).tolist()


def savgol_kernel(window: int = 9, order: int = 2) -> list[float]:
    """Weights of the least-squares polynomial's value at the middle."""
    at = np.arange(window) - window // 2
    return np.linalg.pinv(np.vander(at, order + 1, increasing=True))[0].tolist()


def gaussian(v: Column, sigma: float = 1.25) -> Column:
    return wave.correlate(v, gaussian_kernel(sigma))


def savgol(v: Column, window: int = 9, order: int = 2) -> Column:
    return F.when(F.size(v) >= window, wave.correlate(v, savgol_kernel(window, order))).otherwise(v)


def harmonic_lowpass(v: Column, highest: int = HARMONICS) -> Column:
    return wave.reconstruct(wave.spectrum(wave.filled(v), highest), F.size(v))


def clip_to_input(v: Column, original: Column) -> Column:
    """Within the original's range, widened by a twentieth of its span."""
    low, high = F.array_min(original), F.array_max(original)
    margin = 0.05 * F.greatest(high - low, F.lit(EPS))
    return F.transform(v, lambda x: F.when(x.isNotNull(), F.greatest(low - margin, F.least(high + margin, x))))


def preserve_area(v: Column, original: Column) -> Column:
    """Scaled so that the positive area is the original's."""
    area = lambda a: wave.total_of(a, lambda x: F.greatest(x, F.lit(0.0)))
    ratio = area(original) / area(v)
    return F.when((area(original) > EPS) & (area(v) > EPS), F.transform(v, lambda x: x * ratio)).otherwise(v)


def correlation(a: Column, b: Column) -> Column:
    """Pearson over the positions that both have, three at least."""
    both = F.filter(F.arrays_zip(a.alias("a"), b.alias("b")), lambda s: s["a"].isNotNull() & s["b"].isNotNull())
    xa, xb = F.transform(both, lambda s: s["a"]), F.transform(both, lambda s: s["b"])
    ma, mb = wave.mean(xa), wave.mean(xb)
    cov = wave.total(F.transform(both, lambda s: (s["a"] - ma) * (s["b"] - mb)))
    return F.when(F.size(both) >= 3, F.try_divide(cov, F.sqrt(wave.total_of(xa, lambda x: (x - ma) * (x - ma)) * wave.total_of(xb, lambda x: (x - mb) * (x - mb)))))


def whittaker_1d(y: np.ndarray, smooth: float = 100.0, rounds: int = 5, cut: float = 3.0) -> np.ndarray:
    """Smoothest curve near y with second-difference penalty, reweighted so that large residuals count less; missing stay missing."""
    ok = np.isfinite(y)
    n = len(y)
    if n < 5:
        return y.copy()
    if ok.sum() < 5:
        return np.full(n, np.nan)
    at = np.arange(n)
    filled = np.interp(at, at[ok], y[ok])
    d = np.diff(np.eye(n), 2, axis=0)
    penalty = smooth * d.T @ d
    w, z = np.ones(n), filled
    for _ in range(rounds):
        z = np.linalg.solve(np.diag(w) + penalty, w * filled)
        r = filled - z
        s = MAD_SCALE * np.median(np.abs(r - np.median(r)))
        if not s > EPS:
            break
        w = np.where(ok, 1 / (1 + (np.abs(r) / (s + EPS) / cut) ** 2), 0)
    return np.where(ok, z, np.nan)


def whittaker(df: DataFrame, v: str) -> DataFrame:
    """``df`` with the waveform in ``v`` smoothed, in Arrow batches."""
    at = df.columns.index(v)

    def run(batches):
        for b in batches:
            out = []
            for x in b.column(at).to_pylist():
                y = None if x is None else whittaker_1d(np.array([np.nan if s is None else s for s in x], float))
                out.append(None if y is None else [None if np.isnan(s) else float(s) for s in y])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.float64())) if i == at else c for i, c in enumerate(b.columns)], names=b.schema.names)

    return df.mapInArrow(run, df.schema)


def denoise(waveforms: DataFrame) -> DataFrame:
    """Despiked, smoothed and area-preserving waveform, last of all kept within the input's range, with status and diagnostics.

    status_code: 0 filtered, 1 no sample, 2 too few samples, 3 too small a share of them; only 0 has a waveform.
    """
    v = waveforms.withColumn("v", wave.clean(F.col("v"))).withColumn("finite_fraction", F.try_divide(wave.count(F.col("v")), F.size("v")))
    k = wave.count(F.col("v"))
    status = F.when(k == 0, 1).when(k < LEAST_SAMPLES, 2).when(F.col("finite_fraction") < LEAST_SHARE, 3).otherwise(0)
    v = v.withColumn("status_code", status).withColumn("original", F.col("v")).withColumn("v", gap_fill(F.col("v")))
    d = whittaker(despike(v, "v"), "v")
    d = d.withColumn("v", clip_to_input(preserve_area(F.col("v"), gap_fill(F.col("original"))), F.col("original")))
    d = d.withColumn("v", F.when(F.col("status_code") == 0, F.zip_with("v", "original", lambda a, b: F.when(b.isNotNull(), a))))
    return d.withColumn("original_vs_filtered_corr", F.when(F.col("status_code") == 0, correlation(F.col("original"), F.col("v")))).drop("original")


SWEEP_METRICS = ["RI", "PI", "t50_over_T", "N_eff_over_T", "N_t_over_T", "Q_t_width"]


def filter_sweep(waveforms: DataFrame) -> DataFrame:
    """Six metrics of every waveform under six filters: raw, hampel, with Savitzky-Golay 7 or 9, with 8 harmonics, and a 70/30 blend."""
    from pulsecohort.operators.shape import shape_metrics

    base = waveforms.withColumn("raw", gap_fill(wave.clean(F.col("v")))).withColumn("h", F.col("raw"))
    base = hampel(base, "h")
    variants = {
        "raw": F.col("raw"), "hampel": F.col("h"), "hampel_savgol_7": savgol(F.col("h"), 7), "hampel_savgol_9": savgol(F.col("h"), 9),
        "hampel_harmonic_8": harmonic_lowpass(F.col("h"), 8), "blend_70_30": F.zip_with(F.col("raw"), savgol(F.col("h"), 9), lambda a, b: 0.7 * b + 0.3 * a),
    }
    each = base.withColumn("s", F.explode(F.array(*[F.struct(F.lit(k).alias("config"), v.alias("v")) for k, v in variants.items()])))
    given = each.select(*[c for c in waveforms.columns if c not in ("v", "representation")], F.col("s.config").alias("representation"), F.col("s.v").alias("v"))
    return shape_metrics(given, SWEEP_METRICS).withColumnRenamed("representation", "config")
