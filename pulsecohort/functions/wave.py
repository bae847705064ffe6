"""Columns over one waveform held as array<double>: no shuffle, no Python.

A missing sample is null; ``clean`` makes NaN and infinities null once, at
ingest. Positions count from zero. Results for which a waveform is too short
or has no finite sample are null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Guard inside several denominators; part of the definitions.
EPS = 1e-12


def let(value: Column, f) -> Column:
    """f(value) with the value computed once.

    A column that a lambda refers to may be put in its place by the optimiser
    and then be computed for every element; a lambda's own variable is not.
    """
    return F.element_at(F.transform(F.array(value), f), 1)


def clean(v: Column) -> Column:
    return F.transform(v, lambda x: F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), x.cast("double")))


def rectified(v: Column) -> Column:
    return F.transform(v, lambda x: F.when(x.isNotNull(), F.greatest(x, F.lit(0.0))))


def filled(v: Column, value: float = 0.0) -> Column:
    return F.transform(v, lambda x: F.coalesce(x, F.lit(value)))


def present(v: Column) -> Column:
    return F.filter(v, lambda x: x.isNotNull())


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))


def count(v: Column) -> Column:
    return F.size(present(v))


def mean(v: Column) -> Column:
    return F.try_divide(total(v), count(v))


def total_of(v: Column, f) -> Column:
    """Sum of f(x) over the samples that are there."""
    return total(F.transform(v, f))


def weighted(v: Column, f) -> Column:
    """Sum of f(x, i) over positions."""
    return total(F.transform(v, lambda x, i: f(x, i.cast("double"))))


def cumulative(v: Column) -> Column:
    """0 and the running sums: one element more than v."""
    start = F.array(F.lit(0.0))
    return F.aggregate(v, start, lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.coalesce(x, F.lit(0.0)))))


def at(v: Column, i: Column) -> Column:
    """The sample at a position; null outside."""
    return F.get(v, i.cast("int"))


def argmax(v: Column) -> Column:
    """First position of the greatest sample; -1 if there is none."""
    return F.coalesce(F.array_position(v, F.array_max(v)).cast("int") - 1, F.lit(-1))


def argmin(v: Column) -> Column:
    return F.coalesce(F.array_position(v, F.array_min(v)).cast("int") - 1, F.lit(-1))


def gradient(v: Column, step: Column) -> Column:
    """Central differences, one-sided at the ends; null under two samples."""


    def slopes(w):
        n = F.size(w)

        def slope(_, i):
            return F.when(i == 0, (at(w, i + 1) - at(w, i)) / step).when(i == n - 1, (at(w, i) - at(w, i - 1)) / step).otherwise((at(w, i + 1) - at(w, i - 1)) / (2 * step))

        return F.when(n >= 2, F.transform(w, slope))

    return let(v, slopes)


def oriented(rows: Column, beats: Column) -> Column:
    """A matrix as rows of samples by beats: turned if its rows and not its columns number the beats, else as it is."""
    width = F.size(F.get(rows, F.lit(0)))
    turned = F.transform(F.sequence(F.lit(0), width - 1), lambda c: F.transform(rows, lambda r: F.get(r, c)))
    return F.when((F.size(rows) == beats) & (width != beats), turned).otherwise(rows)


def window(v: Column, start: float, stop: float) -> Column:
    """Samples of [floor(start n), ceil(stop n)), one at least."""
    n = F.size(v)
    low = F.least(F.floor(F.lit(start) * n + EPS).cast("int"), n - 1)
    high = F.greatest(F.least(F.ceil(F.lit(stop) * n - EPS).cast("int"), n), low + 1)
    return F.when(n > 0, F.slice(v, low + 1, high - low))


def dft(v: Column, h: int | Column) -> Column:
    """Normalised coefficient of harmonic h: struct(re, im); missing samples count as 0."""
    n = F.size(v).cast("double")
    turn = lambda i: F.lit(2 * math.pi) * h * i / n
    return F.struct(
        F.try_divide(weighted(v, lambda x, i: x * F.cos(turn(i))), n).alias("re"),
        F.try_divide(weighted(v, lambda x, i: -x * F.sin(turn(i))), n).alias("im"),
    )


def power(c: Column) -> Column:
    return c["re"] * c["re"] + c["im"] * c["im"]


def spectrum(v: Column, highest: int) -> Column:
    """Coefficients 0 .. min(highest, n / 2)."""

    def coefficients(w):
        top = F.least(F.lit(highest), F.floor(F.size(w) / 2).cast("int"))
        return F.when(F.size(w) >= 2, F.transform(F.sequence(F.lit(0), top), lambda h: dft(w, h)))

    return let(v, coefficients)


def multiplicity(h: Column, n: Column) -> Column:
    """How often a one-sided coefficient counts: once at 0 and at Nyquist, else twice."""
    return F.when((h == 0) | (2 * h == n), F.lit(1.0)).otherwise(F.lit(2.0))


def reconstruct(coefficients: Column, n: Column) -> Column:
    """The waveform of n samples that has these one-sided coefficients."""
    size = n.cast("double")

    def samples(all_):
        def sample(i):
            def term(c, h):
                turn = F.lit(2 * math.pi) * h * i / size
                return multiplicity(h, n) * (c["re"] * F.cos(turn) - c["im"] * F.sin(turn))

            return total(F.transform(all_, term))

        return F.transform(F.sequence(F.lit(0), n - 1), sample)

    return let(coefficients, samples)


def percentile(v: Column, q: float) -> Column:
    """Linear interpolation between order statistics of the samples that are there."""

    def between(s):
        x = F.lit(q) * (F.size(s) - 1)
        low = F.floor(x + EPS)
        a, b = at(s, low), at(s, F.least(low + 1, F.size(s) - 1))
        return F.when(F.size(s) > 0, a + (x - low) * (b - a))

    return let(F.array_sort(present(v)), between)


def median(v: Column) -> Column:
    return percentile(v, 0.5)


def reflect_index(i: Column, n: Column) -> Column:
    """Position under reflection about the end samples, which are not repeated."""
    period = F.greatest(2 * (n - 1), F.lit(1))
    j = F.pmod(i, period)
    return F.when(n <= 1, F.lit(0)).otherwise(F.least(j, period - j))


def around(v: Column, i: Column, radius: int, reflect: bool) -> Column:
    """The samples within ``radius`` of a position, cut at the ends or reflected about them."""
    n = F.size(v)
    if reflect:
        return F.transform(F.sequence(F.lit(-radius), F.lit(radius)), lambda k: at(v, reflect_index(i + k, n)))
    low, high = F.greatest(i - radius, F.lit(0)), F.least(i + radius, n - 1)
    return F.slice(v, low + 1, high - low + 1)


def correlate(v: Column, kernel: list[float]) -> Column:
    """Weighted sum of the neighbourhood with reflected ends."""
    radius = len(kernel) // 2

    def smoothed(x):
        def sample(_, i):
            out = F.lit(0.0)
            for k, w in enumerate(kernel):
                out = out + F.lit(float(w)) * at(x, reflect_index(i + (k - radius), F.size(x)))
            return out

        return F.transform(x, sample)

    return let(v, smoothed)
