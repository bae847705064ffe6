"""Velocity profiles: parabola fits, relaxation distance, resampling, symmetry, and the pulsatile model of a segment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsecohort.functions import wave
from pulsecohort.functions.special import bessel_series

#: Fixed values of the model: viscosity, density, base frequency, harmonics, grid sizes, largest radius.
NU, RHO, F0, HARMONICS, T_POINTS, X_POINTS, MOST_RADIUS = 3.5e-6, 1060.0, 1.2, 10, 128, 16, 1e-4
PIXEL = 20e-6
LEAST_CIRCLES, TOP_BRANCHES = 5, 3


def parabola(profiles: DataFrame, keys: list[str], v: str = "profile") -> DataFrame:
    """y = A (x - x0)^2 + y0 by least squares over positions: sums, then the closed form."""
    rows = profiles.select(*keys, F.posexplode(wave.clean(F.col(v))).alias("x", "y")).where("y is not null").withColumn("x", F.col("x").cast("double"))
    # centred powers keep the normal equations well conditioned
    centre = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"))
    c = rows.join(centre, keys).withColumn("u", F.col("x") - F.col("m"))
    u, y = F.col("u"), F.col("y")
    s = c.groupBy(*keys, "n", "m").agg(F.sum(u * u).alias("s2"), F.sum(F.pow(u, 3)).alias("s3"), F.sum(F.pow(u, 4)).alias("s4"), F.sum(y).alias("y0s"), F.sum(u * y).alias("y1"), F.sum(u * u * y).alias("y2"))
    n, s2, s3, s4, y0, y1, y2 = (F.col(k) for k in ("n", "s2", "s3", "s4", "y0s", "y1", "y2"))
    det = n * (s2 * s4 - s3 * s3) - s2 * s2 * s2
    a = F.try_divide(n * (s2 * y2 - s3 * y1) - s2 * s2 * y0, det)
    b = F.try_divide(y1 - a * s3, s2)
    k = (y0 - a * s2) / n
    x0 = F.try_divide(-b, 2 * a)
    return s.where("n >= 3").select(*keys, a.alias("A"), (F.col("m") + x0).alias("x0"), (k - F.try_divide(b * b, 4 * a)).alias("y0"))


def relaxation(fits: DataFrame, keys: list[str], branch: str = "branch", circle: str = "radius") -> DataFrame:
    """Regression of y0 on the circle number by branch with five circles or more, relaxation distance, and the three branches of best R^2."""
    x, y = F.col(circle), F.col("y0")
    g = fits.where("y0 is not null").groupBy(*keys, branch).agg(F.count(y).alias("circles"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))
    g = g.where(F.col("circles") >= LEAST_CIRCLES).withColumn("relaxation_distance", F.try_divide("intercept", F.col("slope") / (10 * PIXEL * T_POINTS)))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last("r2"), branch))
    return g.withColumn("rank", rank).where(F.col("rank") <= TOP_BRANCHES)


def symmetric(v: Column) -> Column:
    return F.zip_with(v, F.reverse(v), lambda a, b: (a + b) / 2)


def antisymmetric(v: Column) -> Column:
    return F.zip_with(v, F.reverse(v), lambda a, b: (a - b) / 2)


def resample(x: np.ndarray, points: int, least: int) -> np.ndarray | None:
    """Linear resampling between the first and the last finite sample."""
    ok = np.flatnonzero(np.isfinite(x))
    if len(ok) < least:
        return None
    return np.interp(np.linspace(ok[0], ok[-1], points), ok, x[ok])


def abel_matrix(n: int) -> np.ndarray:
    """Projection of a radial profile on n shells to chords through it: path length of each chord in each shell."""
    r = np.arange(n + 1)
    y = np.arange(n) + 0.5
    edge = np.sqrt(np.clip(r[None, :] ** 2 - y[:, None] ** 2, 0, None))
    return 2 * np.diff(edge, axis=1)


def projected_parabola(y: np.ndarray) -> tuple[float, float, float, float]:
    """A <= 0, x0, y0 >= 0 and r0 = sqrt(-y0 / A) of a profile, the centre held at the middle of the grid."""
    x0 = (len(y) - 1) / 2
    u = (np.arange(len(y)) - x0) ** 2
    a, b = np.polyfit(u, y, 1)
    a, b = min(a, 0.0), max(b, 0.0)
    return a, x0, b, float(np.sqrt(-b / a)) if a < 0 else float("nan")


def basis(n: int, r: np.ndarray, radius: float) -> np.ndarray:
    """Velocity shape of harmonic n across a tube: 1 - J0(k r) / J0(k R), zero outside."""
    k = np.sqrt(-1j * 2 * np.pi * F0 * n / NU)
    b = 1 - bessel_series(0, k * r) / bessel_series(0, np.array([k * radius]))[0]
    return np.where(np.abs(r) <= radius, b, 0)


def model_segment(profile: np.ndarray) -> dict | None:
    """Coefficient, flow and wall shear of each harmonic of one segment's profile [t, x]; None where the radius is no vessel's."""
    rows = [resample(p, X_POINTS, 9) for p in profile]
    if any(r is None for r in rows):
        return None
    columns = [resample(x, T_POINTS, 2) for x in np.stack(rows).T] if rows else [None]
    if any(c is None for c in columns):
        return None
    v = np.stack(columns, 1)
    a, x0, y0, r0 = projected_parabola(v.mean(axis=0))
    radius = r0 * PIXEL * profile.shape[1] / X_POINTS
    if not np.isfinite(radius) or radius <= 0 or radius > MOST_RADIUS:
        return None
    x = (np.arange(X_POINTS) - x0) * PIXEL * profile.shape[1] / X_POINTS
    spectrum = np.fft.rfft(v, axis=0) / len(v)
    out = {"radius": radius, "c": [], "q": [], "shear": []}
    for n in range(1, HARMONICS + 1):
        b = basis(n, x, radius)
        size = (np.abs(b) ** 2).sum()
        c = (b.conj() * spectrum[n]).sum() / size if size > 0 else 0j
        k = np.sqrt(-1j * 2 * np.pi * F0 * n / NU)
        j0, j1 = bessel_series(0, np.array([k * radius]))[0], bessel_series(1, np.array([k * radius]))[0]
        out["c"].append(abs(c))
        out["q"].append(abs(c * np.pi * radius**2 * (1 - 2 * j1 / (k * radius * j0))))
        out["shear"].append(abs(c * RHO * NU * k * j1 / j0))
    return out


def displacement(profile: np.ndarray) -> np.ndarray:
    """Shift of the vessel by frame, from the antisymmetric part along the mean profile's slope, scaled to a largest of one."""
    mean = np.nanmean(profile, axis=0)
    slope = np.gradient(mean)
    out = []
    for p in profile:
        odd = (p - p[::-1]) / 2
        ok = np.isfinite(odd) & np.isfinite(slope)
        size = (slope[ok] ** 2).sum()
        out.append(-(slope[ok] * odd[ok]).sum() / size if ok.sum() >= 3 and size > 0 else np.nan)
    out = np.array(out)
    top = np.nanmax(np.abs(out)) if np.isfinite(out).any() else np.nan
    return out / top if top and np.isfinite(top) else out


def mixture(x: np.ndarray, rounds: int = 200, floor: float = 1e-9) -> tuple[np.ndarray, float, float, float]:
    """Zero-mean mixture of a narrow and a wide normal: posterior of the wide one, both deviations and its share."""
    s = max(floor, float(np.std(x)))
    narrow, wide, share = s / 2, 2 * s, 0.2
    post = np.zeros(len(x))
    for _ in range(rounds):
        a = (1 - share) / narrow * np.exp(-0.5 * (x / narrow) ** 2)
        b = share / wide * np.exp(-0.5 * (x / wide) ** 2)
        new = b / np.maximum(a + b, 1e-300)
        if np.abs(new - post).max(initial=0) < 1e-9:
            break
        post = new
        share = float(np.clip(post.mean(), 1e-6, 1 - 1e-6))
        narrow = max(floor, float(np.sqrt(((1 - post) * x**2).sum() / max((1 - post).sum(), 1e-12))))
        wide = max(floor, float(np.sqrt((post * x**2).sum() / max(post.sum(), 1e-12))))
    return post, narrow, wide, share


def motion(x: np.ndarray, harmonics: int = 3, jump: float = 0.5) -> tuple[np.ndarray, str]:
    """Jump posterior of each frame after a harmonic fit of the displacement, and whether the segment is still, periodic or jumping."""
    t = np.arange(len(x)) / max(1, len(x))
    design = np.stack([np.ones_like(t), *[f(2 * np.pi * k * t) for k in range(1, harmonics + 1) for f in (np.cos, np.sin)]], 1)
    ok = np.isfinite(x)
    beta = np.linalg.lstsq(design[ok], x[ok], rcond=None)[0] if ok.sum() > design.shape[1] else np.zeros(design.shape[1])
    rest = np.where(ok, x - design @ beta, 0.0)
    post = mixture(rest)[0]
    periodic = ok.any() and np.var((design @ beta)[ok]) > np.var(rest[ok])
    return post, "jumping" if (post > jump).mean() > 0.05 else "periodic" if periodic else "still"


#: A jump from this posterior on, frames that move together from this coherence on, and what rounding can make of a coherence at most.
JUMP, COHERENT, ROUNDING = 0.9, 0.7, 1e-9


def frame_classes(segments: DataFrame, jump: float = JUMP, coherent: float = COHERENT, order: list[str] | None = None, digits: int = 6) -> DataFrame:
    """How far a jump spreads in each frame, from rows of (acq, frame, branch, radius, probability, difference, normal_std).

    spatial_class: 0 no segment jumps, 1 some do, 2 two or more of one branch, 3 two branches or more. Coherence is the
    size of the sum of the jumping segments' scaled differences over the sum of their sizes, null where that is 0.
    motion_class of a frame of class 3: 1 coherent, 2 not; else 0. A null probability is no jump and isn't in the mean.
    A coherence that is the bound but for rounding reaches it, in whatever order it was summed; where the columns
    ``order`` are named, the sums of such a frame are added up row by row in that order instead, and decide. So are
    those of a frame whose coherence or mean is half-way between two numbers of ``digits`` digits but for rounding.
    """
    high = F.coalesce(F.col("probability") >= jump, F.lit(False))
    scaled = F.when(high & (F.col("normal_std") > 0), F.col("difference") / F.col("normal_std"))
    branches = segments.groupBy("acq", "frame", "branch").agg(
        F.sum("probability").alias("p"), F.count("probability").alias("n"), F.sum(high.cast("long")).alias("high"), F.sum(scaled).alias("signed"), F.sum(F.abs(scaled)).alias("size")
    )
    frames = branches.groupBy("acq", "frame").agg(
        F.try_divide(F.sum("p"), F.sum("n")).alias("mean_probability"), F.sum((F.col("high") > 0).cast("long")).alias("active_branches"), F.sum("high").alias("high_segments"),
        F.max("high").alias("_most"), F.try_divide(F.abs(F.sum("signed")), F.sum("size")).alias("coherence"), F.sum("n").alias("_n"),
    )
    spatial = F.when(F.col("active_branches") >= 2, 3).when(F.col("_most") >= 2, 2).when(F.col("high_segments") > 0, 1).otherwise(0)
    whole = frames.withColumn("spatial_class", spatial).drop("_most")
    reached = F.col("coherence") >= coherent - ROUNDING
    if order:
        names = ["mean_probability", "coherence"]
        # two orders of n additions are apart by 4 n / 2**53 at most: few frames but those that tie are left, so their rows alone are shuffled
        apart = (F.col("_n") + 1) * 1e-15
        halves = [F.abs(F.pmod(F.col(n) * 10.0**digits, F.lit(1.0)) - 0.5) <= apart * 10.0**digits for n in names]
        bound = (F.col("spatial_class") == 3) & (F.abs(F.col("coherence") - coherent) <= apart)
        open_ = whole.where(F.coalesce(halves[0], F.lit(False)) | F.coalesce(halves[1], F.lit(False)) | F.coalesce(bound, F.lit(False))).select("acq", "frame")
        # a row with a scaled difference has a probability
        rows = segments.select("acq", "frame", *order, "probability", scaled.alias("z")).where("probability is not null").join(F.broadcast(open_), ["acq", "frame"])
        so_far = Window.partitionBy("acq", "frame").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = rows.select("acq", "frame", *[f.over(so_far).alias(k) for k, f in {"at": F.count("probability"), "p": F.sum("probability"), "signed": F.sum("z"), "size": F.sum(F.abs("z"))}.items()])
        ratios = sums.select("acq", "frame", "at", F.try_divide("p", "at").alias("_mean_probability"), F.try_divide(F.abs("signed"), F.col("size")).alias("_coherence"))
        added = ratios.groupBy("acq", "frame").agg(*[F.max_by(f"_{n}", "at").alias(f"_{n}") for n in names])
        whole = whole.join(added, ["acq", "frame"], "left").withColumns({n: F.coalesce(f"_{n}", n) for n in names})
        reached = F.col("coherence") >= coherent
    return whole.withColumn("motion_class", F.when(F.col("spatial_class") < 3, 0).when(reached, 1).otherwise(2)).drop("_n", "_mean_probability", "_coherence")


def profile_parts(v: Column) -> Column:
    """What the mean (dc) and the first spatial harmonic (n1) make of a whole profile; null where a sample is missing."""
    whole = F.when(F.forall(v, lambda x: x.isNotNull()) & (F.size(v) >= 3), v)

    def parts(w):
        none = F.struct(F.lit(0.0).alias("re"), F.lit(0.0).alias("im"))
        n, c0, c1 = F.size(w), wave.dft(w, F.lit(0)), wave.dft(w, F.lit(1))
        return wave.let(F.struct(c0.alias("c0"), c1.alias("c1")), lambda c: F.struct(F.transform(w, lambda _: c["c0"]["re"]).alias("dc"), wave.reconstruct(F.array(none, c["c1"]), n).alias("n1")))

    return F.when(whole.isNotNull(), wave.let(whole, parts))


def womersley(profiles: DataFrame) -> DataFrame:
    """Model of each segment: ``profiles`` is (acq, branch, radius, t, profile array); a segment's frames are one group."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        m = np.array([[np.nan if s is None else s for s in p] for p in pdf.profile], float)
        out = pdf[["acq", "branch", "radius"]].iloc[:1].copy()
        found = model_segment(m)
        post, kind = motion(displacement(m))
        for k in ("c", "q", "shear"):
            out[k] = [found[k] if found else None]
        out["r0"], out["motion"], out["jump_share"] = found["radius"] if found else np.nan, kind, float((post > 0.5).mean())
        return out

    return profiles.groupBy("acq", "branch", "radius").applyInPandas(solve, "acq long, branch int, radius int, c array<double>, q array<double>, shear array<double>, r0 double, motion string, jump_share double")
