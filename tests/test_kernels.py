"""Numpy kernels and normal expressions against known values and definitions."""

import tracemalloc
from statistics import NormalDist

import numpy as np
import pytest
from seriesforge.functions import kernels
from seriesforge.functions.normal import norm_cdf, norm_ppf

rng = np.random.default_rng(42)


def test_normal_expressions(spark):
    points = [1e-12, 1e-6, 0.01, 0.02425, 0.3, 0.5, 0.7, 0.975, 0.999999]
    rows = spark.createDataFrame([(p,) for p in points], "p double").select("p", norm_ppf("p").alias("x")).withColumn("back", norm_cdf("x")).collect()
    for r in rows:
        assert r["x"] == pytest.approx(NormalDist().inv_cdf(r["p"]), rel=2e-9, abs=2e-9)
        assert r["back"] == pytest.approx(r["p"], rel=2e-8)
    wide = spark.createDataFrame([(x / 4,) for x in range(-36, 37)], "x double").select("x", norm_cdf("x").alias("p")).collect()
    assert all(r["p"] == pytest.approx(NormalDist().cdf(r["x"]), abs=1e-14) for r in wide)


def test_chi2():
    assert kernels.chi2_ppf(0.975, 34) == pytest.approx(51.966, abs=1e-3)
    assert kernels.chi2_ppf(0.025, 34) == pytest.approx(19.806, abs=1e-3)


def test_tapers_are_orthonormal():
    t = kernels.dpss(540, 1.5, 2)
    assert np.allclose(t @ t.T, np.eye(2), atol=1e-10)


def test_long_tapers_equal_the_dense_problem():
    n, t = 600, np.arange(600)
    off = t[1:] * (n - t[1:]) / 2.0
    matrix = np.diag(((n - 1 - 2 * t) / 2.0) ** 2 * np.cos(2 * np.pi * 2.5 / n)) + np.diag(off, 1) + np.diag(off, -1)
    dense = np.linalg.eigh(matrix)[1][:, ::-1][:, :4].T
    own = kernels.dpss(n, 2.5, 4)
    assert np.allclose(np.abs((own * dense).sum(axis=1)), 1, atol=1e-9) and np.allclose(own @ own.T, np.eye(4), atol=1e-9)
    long = kernels.dpss(6000, 1.5, 2)
    assert np.allclose(long @ long.T, np.eye(2), atol=1e-9) and long[0].min() > 0 and (np.diff(np.sign(long[1])) != 0).sum() == 1


def test_peaks_and_plateaus():
    x = np.array([0.0, 1, 3, 3, 1, 2, 0, 5, 0, 4.5, 4.4, 4.6, 0])
    assert kernels.find_peaks(x, 0.5) == [(2, 3.0), (5, 1.0), (7, 5.0), (11, 4.6)]
    assert (9, pytest.approx(0.1)) in [(i, p) for i, p in kernels.find_peaks(x, 0.05)]


def test_surrogates_follow_their_noise():
    noise = np.stack([kernels.counter_normals(50, s, 7) for s in (1, 2)])
    many, y = kernels.ar1_surrogates(noise, 0.5), [0.0]
    for e in noise[1][1:]:
        y.append(0.5 * y[-1] + e)
    assert np.allclose(many[1], y)
    draws = kernels.counter_normals(20_000, 3, 7)
    assert abs(draws.mean()) < 0.03 and abs(draws.std() - 1) < 0.02 and np.array_equal(draws[:50], kernels.counter_normals(50, 3, 7))


def test_planted_cycle():
    t = np.arange(540)
    x = np.sin(2 * np.pi * t / 144) + 0.5 * np.random.default_rng(0).normal(size=540)
    f, p = kernels.multitaper(x, 12.0)
    assert kernels.band_variance(f, p, 8, 20) == pytest.approx(0.4972, abs=0.01)


def test_periodogram_holds_the_variance():
    x = rng.normal(size=540)
    f, p = kernels.periodogram(x, 12.0)
    assert p.sum() * (f[1] - f[0]) == pytest.approx(x.var(), rel=1e-12)


def test_welch_matches_its_definition():
    x = rng.normal(size=200)
    f, p, n_segments = kernels.welch(x, 12.0, 60)
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(60) / 60)
    spectra = [np.abs(np.fft.rfft((x[s : s + 60] - x[s : s + 60].mean()) * w)) ** 2 for s in range(0, 141, 30)]
    want = np.mean(spectra, axis=0) / (12 * (w**2).sum())
    want[1:-1] *= 2
    assert len(spectra) == 5 and np.allclose(p, want)


def test_members_have_unit_variance_and_do_not_depend_on_order():
    f, p, _ = kernels.welch(rng.normal(size=540), 12.0, 60)
    amplitude = kernels.amplitudes(f, p, 1200, 12.0, None)
    g = kernels.synthesize(amplitude, 1200, kernels.sequential_phases(601, 3, 5))
    assert g.var() == pytest.approx(1, abs=1e-10) and abs(g.mean()) < 1e-10
    stream = np.random.default_rng(3)
    for _ in range(6):
        phases = stream.uniform(-np.pi, np.pi, 601)
    phases[0] = phases[-1] = 0
    x = np.fft.irfft(amplitude * np.exp(1j * phases), 1200)
    assert np.allclose(g, x / x.std())


def test_bands_compose_by_product():
    f, p = np.linspace(0, 6, 31), np.ones(31)
    a = kernels.amplitudes(f, p, 1200, 12.0, [(0.8, 1.5, 4.0), (1.0, 2.0, 2.0)]) ** 2 / (1200 * 6)
    grid = np.fft.rfftfreq(1200, 1 / 12)
    assert a[np.isclose(grid, 0.8)] == pytest.approx(8) and a[np.isclose(grid, 1.1)] == pytest.approx(4) and a[np.isclose(grid, 3)] == pytest.approx(1)


def test_adf_tells_noise_from_a_random_walk():
    noise = rng.normal(size=540)
    assert kernels.adf_test(noise)[1] < 0.01
    assert kernels.adf_test(np.cumsum(noise))[1] > 0.05


def test_ar1():
    x = np.zeros(4000)
    e = rng.normal(size=4000)
    for i in range(1, 4000):
        x[i] = 0.5 * x[i - 1] + np.sqrt(0.75) * e[i]
    phi, sigma = kernels.ar1_fit(x)
    assert phi == pytest.approx(0.5, abs=0.05) and sigma == pytest.approx(np.sqrt(0.75), abs=0.05)


def test_peaks_with_plateau():
    assert kernels.find_peaks(np.array([0, 1, 0, 3, 3, 3, 1, 2, 0.0]), 0.5) == [(1, 1.0), (4, 3.0), (7, 1.0)]


def test_members_without_unit_variance_keep_the_spectrum():
    rng = np.random.default_rng(5)
    freqs, psd, n, fs = np.linspace(0, 6, 13), rng.uniform(1, 2, 13), 240, 12.0
    amplitude = kernels.amplitudes(freqs, psd, n, fs, None, offset=True)
    x = kernels.synthesize(amplitude, n, rng.uniform(-np.pi, np.pi, n // 2 + 1), unit=False)
    f, p = kernels.periodogram(x, fs)
    assert x.mean() == pytest.approx(np.sqrt(psd[0] * fs * n / 2) / n)
    assert np.asarray(p)[1:-1] == pytest.approx(np.interp(f, freqs, psd)[1:-1], rel=1e-9)


def test_tapers_of_long_records_do_not_pile_up():
    for n in (40_000, 40_002):
        tracemalloc.start()
        tapers = kernels.dpss(n, 1.5, 2)
        assert tracemalloc.get_traced_memory()[1] < 160 * n, "bytes while tapers are made"
        tracemalloc.stop()
    assert tapers is kernels.dpss(40_002, 1.5, 2) and kernels._last_tapers.cache_info().currsize == 1 and kernels._kept_tapers.cache_info().maxsize * 8 * 2 * kernels.KEPT < 2**24
