"""Harmonic organisation of a segment tensor: normalised harmonics, coherence, phase locking, spread, occupancy.

Rows are (acq, vessel, representation, beat, branch, radius, h). Complex values
are the two columns re and im.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsecohort.functions import wave

HIGHEST = 10
LEAST_RELATIVE = 0.05
EPS = 1e-12
#: A waveform with all its samples and a period.
USABLE = "size(v) >= 2 and not exists(v, x -> x is null) and T > 0 and not isnan(T) and T < double('inf')"
GROUP = ["acq", "vessel", "representation"]
SEGMENT = [*GROUP, "beat", "branch", "radius"]
#: What is summed over: the beats of a location, or the locations of a beat.
OVER_BEATS = [*GROUP, "branch", "radius", "h"]
OVER_LOCATIONS = [*GROUP, "beat", "h"]


def coefficients(waveforms: DataFrame, highest: int = HIGHEST) -> DataFrame:
    """Harmonics 0 .. min(highest, n / 2) of every waveform without a missing sample and with a period."""
    v = wave.clean(F.col("v"))
    whole = waveforms.withColumn("v", v).where(USABLE)
    return whole.select(*SEGMENT, F.posexplode_outer(wave.spectrum(F.col("v"), highest)).alias("h", "c")).select(*SEGMENT, "h", F.col("c.re").alias("re"), F.col("c.im").alias("im"))


def normalised(waveforms: DataFrame, highest: int = HIGHEST) -> DataFrame:
    """c = V_h / V_1 for h >= 2, its relative amplitude, and whether it counts; null where it doesn't."""
    first = wave.at(F.col("c"), F.lit(1))
    v = waveforms.withColumn("v", wave.clean(F.col("v"))).where(USABLE).withColumn("c", wave.spectrum(F.col("v"), highest))
    rows = v.select(*SEGMENT, first.alias("one"), F.posexplode_outer("c").alias("h", "c")).where("h >= 2")
    one = wave.power(F.col("one"))
    size = F.sqrt(wave.power(F.col("c")))
    rows = rows.withColumn("rel_amp", size / (F.sqrt(one) + EPS)).withColumn("valid", (F.col("rel_amp") > LEAST_RELATIVE) & (F.sqrt(one) > EPS))
    re = (F.col("c.re") * F.col("one.re") + F.col("c.im") * F.col("one.im")) / one
    im = (F.col("c.im") * F.col("one.re") - F.col("c.re") * F.col("one.im")) / one
    return rows.select(*SEGMENT, "h", F.when(F.col("valid"), re).alias("re"), F.when(F.col("valid"), im).alias("im"), "rel_amp", "valid")


def organisation(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Complex mean, count, coherence, phase locking and occupancy over what ``keys`` leave out, of the valid rows.

    One pass: all are sums with map-side combination.
    """
    size = F.hypot("re", "im")
    phase = F.atan2("im", "re")
    v = rows.where("valid")
    out = v.groupBy(*keys).agg(
        F.avg("re").alias("mean_re"), F.avg("im").alias("mean_im"), F.count(F.lit(1)).alias("n"),
        F.try_divide(F.hypot(F.sum("re"), F.sum("im")), F.sum(size)).alias("coherence"),
        F.hypot(F.avg(F.cos(phase)), F.avg(F.sin(phase))).alias("plv"), F.median(size).alias("amplitude"),
        F.sum(size).alias("_s"), F.sum(F.when(size > 0, size * F.log(size)).otherwise(0.0)).alias("_sl"), F.sum(size * size).alias("_q"),
        (F.count(F.lit(1)) * (F.var_pop("re") + F.var_pop("im"))).alias("_d"),
    )
    # exp of the entropy of shares size / sum; the squared deviation from the mean from central moments, which doesn't cancel
    number = F.exp(F.log("_s") - F.col("_sl") / F.col("_s"))
    spread = F.sqrt(F.try_divide("_d", "_q"))
    return out.withColumn("effective_number", number).withColumn("occupancy", number / F.col("n")).withColumn("spread", spread).drop("_s", "_sl", "_q", "_d")


def summaries(organised: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """median, population std and count of organised columns by ``keys``."""
    return organised.groupBy(*keys).agg(*[f(F.col(c)).alias(f"{c}_{n}") for c in columns for f, n in ((F.median, "median"), (F.stddev_pop, "std"), (F.count, "n"))])
