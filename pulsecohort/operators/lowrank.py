"""Low-rank structure: complex rank-one modes, rank-one tensors, and pulsatility modes of centred columns.

What Spark gathers for one acquisition is its Gram matrix or its tensor of
harmonics, both of a size fixed by beats x branches x radii; the algebra of one
acquisition is small and dense.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsecohort.functions import robust, wave
from pulsecohort.operators.harmonic import GROUP

EPS = 1e-12
LEAST_COLUMNS = 3
LEAST_FINITE = 0.95


SEGMENT = [*GROUP, "beat", "branch", "radius"]
NAMED = "acq long, vessel string, representation string"


def rank_one_rows(rows: DataFrame) -> DataFrame:
    """Segments with two valid harmonics or more: c, an array of (h, re, im); harmonics that aren't valid count as 0."""
    return rows.where("valid").groupBy(*SEGMENT).agg(F.sort_array(F.collect_list(F.struct("h", "re", "im"))).alias("c")).where("size(c) >= 2")


def rank_one(rows: DataFrame) -> DataFrame:
    """sigma1, eta1, participation and the right vector q1 (array of h, re, im) of the leading complex mode.

    ``rows`` are normalised harmonics. The Gram matrix over harmonics (at most
    9 x 9) is summed by Spark; eigenvectors follow from it.
    """
    kept = rank_one_rows(rows)
    pairs = kept.select(*GROUP, F.explode("c").alias("a"), "c").select(*GROUP, "a", F.explode("c").alias("b"))
    gram = pairs.groupBy(*GROUP, F.col("a.h").alias("i"), F.col("b.h").alias("j")).agg(
        F.sum(F.col("a.re") * F.col("b.re") + F.col("a.im") * F.col("b.im")).alias("re"), F.sum(F.col("a.re") * F.col("b.im") - F.col("a.im") * F.col("b.re")).alias("im")
    )

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        hs = sorted(set(pdf.i))
        m = np.zeros((len(hs), len(hs)), complex)
        at = {h: k for k, h in enumerate(hs)}
        for r in pdf.itertuples():
            m[at[r.i], at[r.j]] = r.re + 1j * r.im
        values, vectors = np.linalg.eigh((m + m.conj().T) / 2)
        values, q = np.clip(values[::-1], 0, None), vectors[:, -1]
        total = values.sum()
        out = pdf[GROUP].iloc[:1].copy()
        out["sigma1"], out["eta1"] = float(np.sqrt(values[0])), float(values[0] / total) if total > 0 else None
        out["rank_participation"] = float(total**2 / (values**2).sum()) if total > 0 else None
        out["q1"] = [[{"h": int(h), "re": float(x.real), "im": float(x.imag)} for h, x in zip(hs, q)]]
        return out

    return gram.groupBy(*GROUP).applyInPandas(solve, f"{NAMED}, sigma1 double, eta1 double, rank_participation double, q1 array<struct<h:int,re:double,im:double>>")


def rank_one_scores(rows: DataFrame, modes: DataFrame) -> DataFrame:
    """Score of each segment on the leading mode, its row times q1: re, im and size. ``modes`` is of ``rank_one``.

    Scores are known up to one turn an acquisition, which sizes, means' sizes and shares don't see.
    """
    both = rank_one_rows(rows).join(modes.select(*GROUP, F.map_from_entries(F.transform("q1", lambda x: F.struct(x["h"], x))).alias("q")), GROUP)
    q = lambda x: F.try_element_at("q", x["h"])
    total = lambda f: F.aggregate(F.transform("c", f), F.lit(0.0), lambda a, x: a + x)
    re = total(lambda x: x["re"] * q(x)["re"] - x["im"] * q(x)["im"])
    im = total(lambda x: x["re"] * q(x)["im"] + x["im"] * q(x)["re"])
    return both.select(*SEGMENT, re.alias("re"), im.alias("im")).withColumn("size", F.hypot("re", "im"))


def score_heterogeneity(scores: DataFrame) -> DataFrame:
    """H over beats (of each beat's mean over locations) and H over locations: population deviation of sizes over their mean; null for one."""

    def over(keys: list[str], name: str) -> DataFrame:
        means = scores.groupBy(*GROUP, *keys).agg(F.hypot(F.avg("re"), F.avg("im")).alias("m"))
        ok = (F.count("m") > 1) & (F.avg("m") > EPS)
        return means.groupBy(*GROUP).agg(F.when(ok, F.stddev_pop("m") / (F.avg("m") + EPS)).alias(name), F.count("m").alias(f"{name}_n"))

    return over(["beat"], "H_b").join(over(["branch", "radius"], "H_kr"), GROUP)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x)
    return x / n if n > EPS else np.full(len(x), 1 / np.sqrt(max(1, len(x))), complex)


def cp_rank_one(tensor: np.ndarray, mask: np.ndarray, rounds: int = 100, tolerance: float = 1e-7) -> tuple[float, float, list[float]]:
    """lambda, explained share and residuals of the masked rank-one tensor by alternating least squares from unfolded leading vectors."""
    x = np.where(mask, tensor, 0)
    factors = []
    for axis in range(x.ndim):
        flat = np.moveaxis(x, axis, 0).reshape(x.shape[axis], -1)
        u, s, _ = np.linalg.svd(flat, full_matrices=False)
        factors.append(_unit(u[:, 0] if len(s) and s[0] > EPS else np.ones(x.shape[axis], complex)))
    letters = "abcd"[: x.ndim]
    power = float((np.abs(x) ** 2).sum())
    lam, history = 0j, []
    for _ in range(rounds):
        for axis in range(x.ndim):
            others = [k for k in range(x.ndim) if k != axis]
            sub = ",".join([letters, *(letters[k] for k in others)]) + "->" + letters[axis]
            top = np.einsum(sub, x, *[factors[k].conj() for k in others])
            low = np.einsum(sub, mask.astype(float), *[np.abs(factors[k]) ** 2 for k in others])
            factors[axis] = _unit(np.where(low > EPS, top / np.maximum(low, EPS), 0))
        model = factors[0]
        for f in factors[1:]:
            model = np.multiply.outer(model, f)
        m = np.where(mask, model, 0)
        size = float((np.abs(m) ** 2).sum())
        lam = (np.vdot(m, x) / size) if size > EPS else 0j
        history.append(float((np.abs(x - lam * m) ** 2).sum()))
        if len(history) > 1 and abs(history[-2] - history[-1]) <= tolerance * max(power, EPS):
            break
    return float(abs(lam)), 1 - history[-1] / power if power > EPS else float("nan"), history


def tensor_modes(rows: DataFrame) -> DataFrame:
    """lambda and explained share of the rank-one tensor over (h, beat, branch, radius) of each acquisition."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        axes = [np.unique(pdf[c]) for c in ("h", "beat", "branch", "radius")]
        shape = tuple(map(len, axes))
        x, mask = np.zeros(shape, complex), np.zeros(shape, bool)
        at = tuple(np.searchsorted(a, pdf[c]) for a, c in zip(axes, ("h", "beat", "branch", "radius")))
        x[at] = pdf.re.to_numpy() + 1j * pdf.im.to_numpy()
        mask[at] = True
        lam, eta, history = cp_rank_one(x, mask)
        out = pdf[GROUP].iloc[:1].copy()
        out["lambda"], out["eta"], out["rounds"] = lam, eta, len(history)
        return out

    return rows.where("valid").groupBy(*GROUP).applyInPandas(solve, "acq long, vessel string, representation string, lambda double, eta double, rounds int")


def centred_columns(waveforms: DataFrame) -> DataFrame:
    """Columns with enough samples and a usable period: mean mu, deviations x (a gap is the mean) and rms_x."""
    v = waveforms.withColumn("v", wave.clean(F.col("v")))
    ok = v.where((wave.count(F.col("v")) / F.size("v") >= LEAST_FINITE) & (F.col("T") > 0))
    out = ok.withColumn("mu", wave.mean(F.col("v"))).withColumn("x", F.transform("v", lambda s: F.coalesce(s - F.col("mu"), F.lit(0.0))))
    return out.withColumn("rms_x", F.sqrt(wave.total_of(F.col("x"), lambda s: s * s) / F.size("x")))


def _gram_sums(columns: DataFrame) -> DataFrame:
    """Sums of x x' by acquisition and length, each task adding up what it reads: (GROUP, n, columns, gram)."""

    def run(batches):
        held: dict[tuple, list] = {}

        def done():
            keys = list(held)
            cols = [pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string(), pa.int32()))]
            out = pa.RecordBatch.from_arrays([*cols, pa.array([held[k][0] for k in keys], pa.int64()), pa.array([held[k][1].tobytes() for k in keys], pa.binary())], names=[*GROUP, "n", "columns", "gram"])
            held.clear()
            return out

        for b in batches:
            frame = b.to_pandas()
            frame["n"] = frame.x.map(len)
            for key, part in frame.groupby([*GROUP, "n"], dropna=False):
                x = np.stack(part.x.to_numpy()) if key[3] else np.zeros((len(part), 0))
                count, total = held.get(key, (0, np.zeros((key[3], key[3]))))
                held[key] = [count + len(part), total + x.T @ x]
            if sum(v[1].size for v in held.values()) > 1 << 22:
                yield done()
        yield done()

    return columns.select(*GROUP, "x").mapInArrow(run, f"{NAMED}, n int, columns long, gram binary")


def pulsatility_modes(waveforms: DataFrame, keep: int = 3) -> DataFrame:
    """Energy shares, effective rank, participation and the first ``keep`` modes of each acquisition's columns.

    With fewer than three columns, or columns of unequal length, svd_available
    is 0, reason says why and the rest is null.
    """
    sums = _gram_sums(centred_columns(waveforms))
    numbers = ["eta1", "eta2", "eta3", "eta23", "effective_rank", "participation_ratio"]
    schema = f"{NAMED}, svd_available int, reason string, columns long, {', '.join(f'{x} double' for x in numbers)}, sigma array<double>, modes array<array<double>>"

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf[GROUP].iloc[:1].copy()
        n, k = int(pdf.n.iloc[0]), int(pdf["columns"].sum())
        reason = "unequal_lengths" if pdf.n.nunique() > 1 else "too_few_valid_columns" if k < LEAST_COLUMNS else "ok"
        out["svd_available"], out["reason"], out["columns"] = int(reason == "ok"), reason, k
        if reason != "ok":
            return out.assign(**dict.fromkeys(numbers, np.nan), sigma=None, modes=None)
        m = sum(np.frombuffer(g).reshape(n, n) for g in pdf.gram)
        values, vectors = np.linalg.eigh(m)
        e = np.clip(values[::-1], 0, None)
        p = np.append(e, [0, 0, 0]) / max(e.sum(), EPS)
        found = [p[0], p[1], p[2], p[1] + p[2], float(np.exp(-(p * np.log(p + EPS)).sum())), float(1 / max((p**2).sum(), EPS))]
        top = min(keep, n, k)
        return out.assign(**dict(zip(numbers, found)), sigma=[np.sqrt(e[:top]).tolist()], modes=[vectors[:, ::-1][:, :top].T.tolist()])

    return sums.groupBy(*GROUP).applyInPandas(solve, schema)


def mode_columns(waveforms: DataFrame, modes: DataFrame) -> DataFrame:
    """Per column and mode (from 1): score, mode_rms, residual_rms after the modes so far, and total_rms.

    A mode's sign makes the median of its acquisition's scores at least 0.
    """
    cols = centred_columns(waveforms).select(*SEGMENT, "x", F.col("rms_x").alias("total_rms"))
    dot = lambda u: F.aggregate(F.zip_with("x", u, lambda a, b: a * b), F.lit(0.0), lambda s, y: s + y)
    each = cols.join(modes.where("svd_available = 1").select(*GROUP, "modes"), GROUP).withColumn("s", F.transform("modes", dot))
    square = F.aggregate("x", F.lit(0.0), lambda s, y: s + y * y)
    left = F.transform("s", lambda _, k: square - F.aggregate(F.slice("s", F.lit(1), k + 1), F.lit(0.0), lambda a, y: a + y * y))
    rows = each.select(*SEGMENT, "total_rms", F.size("x").alias("n"), F.posexplode(F.arrays_zip(F.col("s").alias("score"), left.alias("left"))).alias("k", "m"))
    rows = rows.select(*SEGMENT, (F.col("k") + 1).alias("mode"), "total_rms", "n", "m.score", F.sqrt(F.greatest("m.left", F.lit(0.0)) / F.col("n")).alias("residual_rms"))
    sign = rows.groupBy(*GROUP, "mode").agg(F.when(F.median("score") < 0, -1.0).otherwise(1.0).alias("sign"))
    signed = rows.join(sign, [*GROUP, "mode"]).withColumn("score", F.col("score") * F.col("sign"))
    return signed.withColumn("mode_rms", F.abs("score") / F.sqrt("n")).drop("sign", "n")


def residual_ratios(columns: DataFrame) -> DataFrame:
    """Per acquisition and mode rho, the median residual over the median total, and the medians A and R."""
    rho = F.when(F.median("total_rms") > EPS, F.median("residual_rms") / (F.median("total_rms") + EPS))
    return columns.groupBy(*GROUP, "mode").agg(F.median("mode_rms").alias("A"), F.median("residual_rms").alias("R"), rho.alias("rho"), F.median(F.abs("score")).alias("median_abs_score"))


def over_beats(columns: DataFrame, name: str) -> DataFrame:
    """Of a column's value: its median and MAD over the locations of each beat, then deviation, MAD and CV of the medians over beats."""
    beats = robust.axis_statistics(columns, [*GROUP, "beat"], name).select(*GROUP, "beat", F.col("median").alias("by_beat"), F.col("mad").alias("spatial_mad"))
    centre = robust.with_deviation(beats, GROUP, "by_beat", "gap")
    return centre.groupBy(*GROUP).agg(F.stddev_pop("by_beat").alias("sigma"), F.median("gap").alias("mad"), robust.cv("by_beat").alias("cv"), F.median("spatial_mad").alias("spatial_mad"))


def modal_movie(frames: DataFrame, modes: int = 20, samples: int = 200) -> DataFrame:
    """Singular values of the per-beat resampled movie sqrt(m2 / m0) of each acquisition.

    ``frames`` is (acq, t, m0 array, m2 array), a row a frame. Beats are found
    at the brightest pixel: median filter of 7, smoothing, and peaks of the
    slope at least 40 frames apart. The frame width is taken from the data.
    """

    def beats(x: np.ndarray) -> np.ndarray:
        pad = np.pad(x, 3, mode="edge")
        med = np.median(np.lib.stride_tricks.sliding_window_view(pad, 7), axis=1)
        w = min(21, len(med) - (len(med) + 1) % 2)
        if w >= 5:
            off = np.arange(w) - w // 2
            kernel = np.linalg.pinv(np.vander(off, 4, increasing=True))[0]
            med = np.convolve(np.pad(med, w // 2, mode="edge"), kernel[::-1], mode="valid")
        slope = np.diff(med)
        order = np.argsort(-slope, kind="stable")
        found: list[int] = []
        for i in order:
            if 0 < i < len(slope) - 1 and slope[i] >= slope[i - 1] and slope[i] >= slope[i + 1] and slope[i] > slope.std() and all(abs(i - j) >= 40 for j in found):
                found.append(int(i))
        return np.array(sorted(found))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        m0, m2 = np.stack(pdf.m0), np.stack(pdf.m2)
        x = np.sqrt(np.clip(np.divide(m2, m0, out=np.zeros_like(m2, float), where=m0 > 0), 0, None))
        marks = beats(m0[:, m0.mean(axis=0).argmax()].astype(float))
        if len(marks) >= 2:
            parts = [x[a:b] for a, b in zip(marks, marks[1:])]
            x = np.mean([np.stack([np.interp(np.linspace(0, len(p) - 1, samples), np.arange(len(p)), c) for c in p.T], 1) for p in parts], axis=0)
        s = np.linalg.svd(x - x.mean(axis=0), compute_uv=False)[:modes]
        return pd.DataFrame({"acq": pdf.acq.iloc[0], "beats": max(0, len(marks) - 1), "mode": np.arange(len(s)), "sigma": s})

    return frames.groupBy("acq").applyInPandas(solve, "acq long, beats int, mode int, sigma double")
