"""Operators against NumPy or by hand, where SQL does not reach."""

import json
import math
import zipfile

import numpy as np
from pyspark.sql import functions as F

from pulsecohort.functions import special, wave
from pulsecohort.operators import filters, lowrank, patients, reports, scoring, shape, topology, windkessel, womersley
from pulsecohort.plans import registry, runner
from pulsecohort.sources import files, outputs
from pulsecohort.streaming import arrivals

WAVE = "acq long, cohort string, vessel string, representation string, beat int, branch int, radius int, T double, v array<double>"


def waves(spark, vs, period=1.0):
    return spark.createDataFrame([(i, "control", "artery", "raw", 0, 0, 0, period, v) for i, v in enumerate(vs)], WAVE)


def test_shape_is_gain_invariant_and_bounded(spark):
    g = np.random.default_rng(1)
    v = g.random(40).tolist()
    a, b = shape.shape_metrics(waves(spark, [v, [3 * x for x in v]])).orderBy("acq").collect()
    for m in shape.METRICS:
        assert abs(a[m] - b[m]) < 1e-6 * max(1, abs(a[m])), m
    assert 0 <= a["RI"] <= 1


def test_invalid_waveforms_have_null_metrics(spark):
    bad = [[], [0.0, 0.0], [float("nan"), None], [-1.0, -2.0], [1.0]]
    rows = shape.shape_metrics(waves(spark, bad), ["RI", "eta_h", "E_slope"]).orderBy("acq").collect()
    assert all(r["RI"] is None for r in rows[:4])
    assert shape.shape_metrics(waves(spark, [[1.0, 2.0, 3.0]], -1.0), ["PI"]).first()["PI"] is None
    assert shape.shape_metrics(waves(spark, []), ["PI"]).count() == 0


def test_gradient_percentile_and_dft(spark):
    g = np.random.default_rng(2)
    x = g.random(17)
    df = spark.createDataFrame([(x.tolist(),)], "v array<double>")
    r = df.select(wave.gradient(F.col("v"), F.lit(0.5)).alias("g"), wave.percentile(F.col("v"), 0.3).alias("p"), wave.dft(F.col("v"), 3).alias("c"), wave.reconstruct(wave.spectrum(F.col("v"), 8), F.size("v")).alias("r")).first()
    assert np.allclose(r["g"], np.gradient(x, 0.5))
    assert np.isclose(r["p"], np.percentile(x, 30))
    c = np.fft.rfft(x)[3] / 17
    assert np.allclose([r["c"]["re"], r["c"]["im"]], [c.real, c.imag])
    assert np.allclose(r["r"], x)


def test_mann_whitney_exact_by_enumeration():
    from itertools import combinations

    n1, n2 = 4, 5
    us = [sum(r > s for r in c for s in set(range(9)) - set(c)) for c in combinations(range(9), n1)]
    for u in range(n1 * n2 + 1):
        top = max(u, n1 * n2 - u)
        assert abs(special.mann_whitney_exact(u, n1, n2) - min(1, 2 * np.mean(np.array(us) >= top))) < 1e-12


def test_tails():
    assert abs(special.t_two_sided(2.0, 10) - 0.0733880) < 1e-6
    assert abs(special.t_two_sided(0.5, 3) - 0.6514479) < 1e-6
    assert abs(special.kolmogorov_p(0.5, 20, 20) - 0.0135) < 1e-3
    assert np.allclose(special.bessel_series(0, np.array([1.0]))[0], 0.7651976866)


def test_whittaker_and_denoise_keep_area(spark):
    t = np.arange(64)
    v = 2 + np.sin(2 * np.pi * t / 64)
    v[20] = 30
    out = filters.denoise(waves(spark, [v.tolist(), [1.0] * 10])).orderBy("acq").collect()
    assert out[0]["status_code"] == 0 and out[1]["status_code"] == 2 and out[1]["v"] is None
    assert max(out[0]["v"]) < 10
    assert np.allclose(filters.whittaker_1d(np.arange(10.0)), np.arange(10.0))


def test_time_shift_is_found_by_the_frequency_fit():
    t = np.arange(100) / 100
    qa = 2 + np.sin(2 * np.pi * t) + 0.5 * np.sin(4 * np.pi * t) + 0.3 * np.cos(6 * np.pi * t)
    f = np.fft.rfftfreq(100, 0.01)
    qv = np.fft.irfft(np.fft.rfft(qa) * np.exp(-2j * np.pi * f * 0.02) / (1 + 2j * np.pi * f * 0.1), n=100)
    fit = windkessel.frequency_fit(qa, qv, 1.0)
    assert abs(fit["Deltat"] - 0.02) < 1e-9 and abs(fit["tau"] - 0.1) < 1e-3
    arx = windkessel.arx_fit(qa, qv, 1.0)
    assert arx["accepted"] and windkessel.time_integral_fit(qa, qv, 1.0)["accepted"]


def test_rank_one_tensor_is_recovered():
    g = np.random.default_rng(3)
    a, b, c = (g.standard_normal(n) + 1j * g.standard_normal(n) for n in (3, 4, 5))
    x = np.einsum("i,j,k->ijk", a, b, c)
    _, eta, history = lowrank.cp_rank_one(x, np.ones(x.shape, bool))
    assert eta > 1 - 1e-9 and all(p >= q - 1e-9 for p, q in zip(history, history[1:]))


def test_quadrant_tie_goes_to_ne(spark):
    px = spark.createDataFrame([(0, 7, x, y, 2, 2) for x, y in ((0, 0), (4, 0), (0, 4), (4, 4))], "acq long, label int, x int, y int, cx int, cy int")
    assert topology.quadrant_majority(px).first()["quadrant"] == "NE"


def test_projected_parabola_and_symmetry():
    u = (np.arange(16) - 7.5) ** 2
    a, x0, y0, r0 = womersley.projected_parabola(10 - 0.2 * u)
    assert np.allclose([a, x0, y0, r0], [-0.2, 7.5, 10, np.sqrt(50)])


def test_two_cohorts_are_required(spark):
    import pytest

    rows = spark.createDataFrame([("control",), ("a",), ("b",)], "cohort string")
    with pytest.raises(ValueError):
        scoring.two_cohorts(rows, "control")


def test_missing_metrics_lower_coverage(spark):
    values = spark.createDataFrame([(1, "RI", 0.9), (1, "PI", 1.0), (2, "RI", float("nan"))], "acq long, metric string, value double")
    rows = {r["acq"]: r for r in patients.evaluate(patients.evaluate_metrics(values, patients.panel(spark))).collect()}
    assert rows[1]["pathology_index"] == 0.5 and rows[1]["coverage_fraction"] == 0.25
    assert rows[2]["pathology_index"] is None and rows[2]["evaluation_label"] == "not available"


def test_archives_and_names(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("h5/x/1.h5", "one")
        z.writestr("../evil.h5", "no")
    rows = files.archive_members(spark, str(tmp_path), content=True).collect()
    assert [(r["member"], bytes(r["content"])) for r in rows] == [("h5/x/1.h5", b"one")]
    df = spark.createDataFrame([("h5/Ctrl/a.h5",), ("a.h5",), ("B/c/d.h5",)], "p string")
    assert [r[0] for r in df.select(files.cohort_of(F.col("p"))).collect()] == ["Ctrl", "all", "B"]
    v = spark.createDataFrame([('{"up":"1"}',), (None,)], "j string").select(files.version_stamp(F.col("j"), "me", "2").alias("j")).collect()
    assert [json.loads(r["j"]) for r in v] == [{"up": "1", "me": "2"}, {"me": "2"}]


def test_runner_records_failures_and_refuses_unmet_needs(spark):
    import pytest

    t = np.arange(32)
    w = waves(spark, [(2 + np.sin(t / 5 + k)).tolist() for k in range(4)])
    with pytest.raises(ValueError):
        runner.run(w, ["absolute_waveform_metrics"], ["Composite Scoring"])
    out = runner.run(w, ["waveform_shape_metrics"])
    assert out.metrics.count() == 4 * len(shape.METRICS) and not out.failures
    good, bad = runner.usable(w.unionByName(waves(spark, [[]])))
    assert good.count() == 4 and bad.count() == 1
    assert ("waveform_shape_metrics", "39 shape metrics of each waveform", True) in registry.catalog()


def test_a_pipeline_that_fails_while_it_runs_is_a_failure_row(spark):
    t = np.arange(32)
    w = waves(spark, [(2 + np.sin(t / 5 + k)).tolist() for k in range(4)]).unionByName(waves(spark, [[], [float("nan")] * 4]))

    @registry.pipeline("raises", "")
    def raises(waveforms):
        return waveforms.select(F.raise_error(F.lit("no")).cast("double").alias("value"))

    try:
        out = runner.run(w, ["raises", "waveform_shape_metrics", "waveform_harmonic_summary"], ["Fixed thresholds", "Group comparison", "Metrics manifest", "HTML summary"])
    finally:
        del registry.PIPELINES["raises"]
    assert [f[0] for f in out.failures] == ["raises"] and out.refused.count() == 2
    assert out.reports["Fixed thresholds"]["patients"].first()["coverage_fraction"] == 1.0
    assert out.reports["Group comparison"]["groups"].count() == len(set(reports.SELECTED_METRICS))
    assert len(registry.PIPELINES) >= 11


def test_all_pipelines_run(spark):
    t = np.arange(48)
    rows = [(k, "control", vessel, "raw", b, 0, r, 1.0, (3 + np.sin(t / 6 + k + 0.1 * b) + 0.3 * np.cos(t / 3) + 0.1 * r + 0.05 * (vessel == "vein")).tolist()) for k in range(2) for vessel in ("artery", "vein") for b in range(3) for r in range(2)]
    names = [n for n in registry.PIPELINES if n != "modal_analysis"]
    out = runner.run(spark.createDataFrame(rows, WAVE), names)
    assert not out.failures and {r[0] for r in out.metrics.select("pipeline").distinct().collect()} == set(names)


def test_exact_mann_whitney_of_any_size():
    # more than 20,000 pairs: against the normal approximation, and whole numbers against doubles
    p = special.mann_whitney_exact(8 * 3000 * 0.7, 8, 3000)
    z = (8 * 3000 * 0.2 - 0.5) / np.sqrt(8 * 3000 * 3009 / 12)
    assert abs(p - 2 * (1 - 0.5 * (1 + math.erf(z / np.sqrt(2))))) < 0.01
    assert special.mann_whitney_exact(20_001, 1, 20_001) == 2 / 20_002
    counts = special._arrangements(6, 40)
    assert counts.dtype == np.int64 and counts.sum() == math.comb(46, 6) and (counts == counts[::-1]).all()
    big = special._arrangements(8, 4000)
    assert big.dtype == np.float64 and abs(big.sum() / math.comb(4008, 8) - 1) < 1e-6 and np.allclose(big, big[::-1], rtol=1e-3)


def test_denoised_stays_in_range(spark):
    g = np.random.default_rng(4)
    vs = [(g.normal(0.02, 1, 64) * 10 ** g.integers(0, 3)).tolist() for _ in range(9)]
    for r, v in zip(filters.denoise(waves(spark, vs)).orderBy("acq").collect(), vs):
        margin = 0.05 * (max(v) - min(v)) + 1e-9
        assert r["status_code"] == 0 and min(v) - margin <= min(r["v"]) and max(r["v"]) <= max(v) + margin


def test_modes_against_numpy(spark):
    g = np.random.default_rng(5)
    x = g.standard_normal((12, 20)) + np.outer(np.sin(np.arange(12)), 3 + g.standard_normal(20))
    w = spark.createDataFrame([(0, "control", "artery", "raw", i // 4, i % 4, 0, 1.0, x[:, i].tolist()) for i in range(20)], WAVE)
    c = lowrank.mode_columns(w, lowrank.pulsatility_modes(w))
    table = {r["mode"]: r for r in lowrank.residual_ratios(c).collect()}
    x = x - x.mean(axis=0)
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    total = np.sqrt((x**2).mean(axis=0))
    for m in (1, 2, 3):
        left = np.sqrt(((x - u[:, :m] @ np.diag(s[:m]) @ vt[:m]) ** 2).mean(axis=0))
        assert np.isclose(table[m]["rho"], np.median(left) / np.median(total)) and np.isclose(table[m]["A"], np.median(np.abs(s[m - 1] * vt[m - 1])) / np.sqrt(12))
        assert np.median([r["score"] for r in c.where(F.col("mode") == m).collect()]) >= 0
    few = lowrank.pulsatility_modes(w.where("branch = 0 and beat < 2")).first()
    assert few["svd_available"] == 0 and few["reason"] == "too_few_valid_columns"


def test_rank_one_scores_against_numpy(spark):
    g = np.random.default_rng(6)
    x = g.standard_normal((24, 4)) + 1j * g.standard_normal((24, 4))
    rows = [(0, "artery", "raw", i // 6, i % 3, i // 3 % 2, h + 2, float(x[i, h].real), float(x[i, h].imag), 1.0, True) for i in range(24) for h in range(4)]
    n = spark.createDataFrame(rows, "acq long, vessel string, representation string, beat int, branch int, radius int, h int, re double, im double, rel_amp double, valid boolean")
    modes = lowrank.rank_one(n)
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    assert np.isclose(modes.first()["sigma1"], s[0]) and np.isclose(modes.first()["eta1"], s[0] ** 2 / (s**2).sum())
    scores = lowrank.rank_one_scores(n, modes)
    assert np.allclose(sorted(r["size"] for r in scores.collect()), sorted(np.abs(x @ vt[0].conj())))
    h = lowrank.score_heterogeneity(scores).first()
    xi = np.abs((x @ vt[0].conj()).reshape(4, 6).mean(axis=1))
    assert np.isclose(h["H_b"], xi.std() / (xi.mean() + 1e-12)) and h["H_b_n"] == 4


def test_name_lists():
    assert files.name_list("a\n# no\n\n b \na") == ["a", "b"] and files.name_list("['x', y,x]") == ["x", "y"] and files.name_list("") == []


def test_arriving_files_are_processed_once(spark, tmp_path):
    waves(spark, [[1.0, 2.0, 3.0]]).write.parquet(str(tmp_path / "in"))
    q = arrivals.process(arrivals.arriving(spark, str(tmp_path / "in")), lambda d: shape.shape_metrics(d, ["RI"]), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_free_names_are_taken_in_order(spark):
    given = [("f", 0, "a"), ("f", 1, "a_1"), ("f", 2, "a"), ("f", 3, "a"), ("f", 4, "a_1"), ("f", 5, None), ("g", 0, "a")]
    got = outputs.free_names(spark.createDataFrame(given, "file string, at int, tree string"), "file", "tree", "at").orderBy("file", "at").collect()
    taken, want = {}, []
    for file, _, name in given:
        used, tries = taken.setdefault(file, set()), [name or "tree"] + [f"{name or 'tree'}_{i}" for i in range(1, 9)]
        want.append(next(t for t in tries if t not in used))
        used.add(want[-1])
    assert [r["free_name"] for r in got] == want
    assert outputs.free_names(spark.createDataFrame([], "file string, at int, tree string"), "file", "tree", "at").count() == 0


def test_archives_are_read_back(spark, tmp_path):
    rows = [("x", "b/2.csv", b"two"), ("x", "a.csv", b"one"), ("y", "c", None)]
    got = outputs.archives(spark.createDataFrame(rows, "study string, path string, content binary"), "study").orderBy("study").collect()
    assert [(r["study"], r["members"]) for r in got] == [("x", 2), ("y", 1)]
    for r in got:
        (tmp_path / f"{r['study']}.zip").write_bytes(bytes(r["archive"]))
    back = files.archive_members(spark, str(tmp_path), content=True).select("member", "content").orderBy("member").collect()
    assert [(r["member"], bytes(r["content"])) for r in back] == [("a.csv", b"one"), ("b/2.csv", b"two"), ("c", b"")]


def test_input_plans(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in ("a.h5", "b.HDF5", "c.txt"):
        (tmp_path / "in" / n).write_bytes(b"x")
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("q/a.h5", b"x")
        z.writestr("q/n.txt", b"x")
    plan = lambda *p: (lambda k, d: (k, d.count()))(*outputs.input_plan(spark, [str(x) for x in p]))
    assert plan() == ("folder", 0) and plan(tmp_path / "in" / "a.h5") == ("file", 1) and plan(tmp_path / "in") == ("folder", 2) and plan(tmp_path / "z.zip") == ("zip", 1)
    assert plan(tmp_path / "in" / "a.h5", tmp_path / "in" / "b.HDF5") == ("file", 2)
    try:
        plan(tmp_path / "in" / "a.h5", tmp_path / "in" / "c.txt")
        raise AssertionError("a text was taken")
    except ValueError as e:
        assert "c.txt" in str(e)


def test_profile_parts_need_whole_profiles(spark):
    d = spark.createDataFrame([([1.0, 2.0, 4.0, 1.0],), ([1.0, None, 2.0],), ([],), (None,)], "v array<double>").select(womersley.profile_parts(F.col("v")).alias("p")).collect()
    c = np.fft.rfft([1.0, 2.0, 4.0, 1.0])
    assert np.allclose(d[0]["p"]["n1"], np.fft.irfft(c * [0, 1, 0])) and np.allclose(d[0]["p"]["dc"], 2.0)
    assert all(r["p"] is None for r in d[1:])
