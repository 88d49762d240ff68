"""Records cut into blocks give what whole records give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesforge.functions import kernels
from seriesforge.operators import bands, blocks, preprocess, spectral, stats

K = ["series_id"]
rng = np.random.default_rng(8)


def table(spark, records, gaps=()):
    rows = [(name, 3 * t - 7, None if t in gaps else float(v)) for name, x in records.items() for t, v in enumerate(x)]
    return spark.createDataFrame(rows, "series_id string, t int, value double")


@pytest.fixture(scope="module")
def records():
    walk = np.cumsum(rng.normal(size=301))
    red = np.zeros(240)
    for i in range(1, 240):
        red[i] = 0.7 * red[i - 1] + rng.normal()
    return {"walk": walk, "red": red, "white": rng.normal(5, 1, 97), "short": rng.normal(size=9)}


@pytest.mark.parametrize("block", [16, 50, 4096])
def test_positions_number_each_series(spark, records, block):
    out = blocks.positions(table(spark, records, gaps=(4, 5)), K, block).orderBy("series_id", "pos").collect()
    for name, x in records.items():
        mine, kept = [r for r in out if r["series_id"] == name], np.delete(x, [4, 5])
        assert [r["pos"] for r in mine] == list(range(len(kept))) and np.allclose([r["value"] for r in mine], kept)
        assert {r["n"] for r in mine} == {len(kept)} and mine[0]["mean"] == pytest.approx(kept.mean())


@pytest.mark.parametrize("nperseg, block", [(24, 24), (24, 60), (25, 7), (24, 1000)])
def test_welch_of_blocks(spark, records, nperseg, block):
    got = {(r["series_id"], r["k"]): (r["freq"], r["psd"], r["n_segments"]) for r in blocks.welch(table(spark, records), K, nperseg, block=block).collect()}
    for name, x in records.items():
        f, p, n = kernels.welch(x, 12.0, nperseg)
        mine = [got.pop((name, k)) for k in range(len(f))]
        assert np.allclose([m[0] for m in mine], f) and np.allclose([m[1] for m in mine], p) and {m[2] for m in mine} == {n}
    assert not got


@pytest.mark.parametrize("block", [1, 64, 4096])
def test_autocorrelation_of_blocks(spark, records, block):
    lags, gaps = 20, {3, 4, 50}
    rows = [(name, t, float(v)) for name, x in records.items() for t, v in enumerate(x) if t not in gaps]
    series = spark.createDataFrame(rows, "series_id string, t int, value double")
    got = {(r["series_id"], r["lag"]): r["acf"] for r in blocks.autocorrelation(series, K, lags, block).collect()}
    for name, x in records.items():
        known = np.array([t not in gaps for t in range(len(x))])
        y = np.where(known, x - x[known].mean(), 0.0)
        for lag in range(lags + 1):
            pairs = known[: len(x) - lag] & known[lag:] if lag < len(x) else np.zeros(0, bool)
            if pairs.any():
                assert got.pop((name, lag)) == pytest.approx((y[: len(x) - lag] * y[lag:]).sum() / (y * y).sum(), abs=1e-12)
    assert not got


@pytest.mark.parametrize("block", [32, 100, 65536])
def test_dickey_fuller_of_blocks(spark, records, block):
    constant = {"constant": np.full(40, 2.5), "two": np.array([1.0, 2.0])}
    got = {r["series_id"]: r for r in blocks.adf(table(spark, records | constant), K, block=block).collect()}
    for name, x in records.items():
        statistic, p, lag = kernels.adf_test(x)
        assert got[name]["statistic"] == pytest.approx(statistic, rel=1e-7) and got[name]["p_value"] == pytest.approx(p, abs=1e-7) and got[name]["lags"] == lag
        assert got[name]["stationary"] == (p < 0.05)
    assert all(got[n]["statistic"] is None and got[n]["p_value"] is None and not got[n]["stationary"] for n in constant)


def test_nothing_in_nothing_out(spark):
    none = spark.createDataFrame([], "series_id string, t int, value double")
    nulls = spark.createDataFrame([("a", 1, None), ("a", 2, None)], "series_id string, t int, value double")
    for df in (none, nulls):
        assert blocks.welch(df, K).count() == blocks.autocorrelation(df, K, 3).count() == blocks.adf(df, K).count() == 0
        assert preprocess.fit_polynomial(df, K, 2).count() == 0 and stats.refined_percentiles(df, K, "value", [0.5]).count() == 0


@pytest.mark.parametrize("accuracy", [20, 1000])
def test_percentiles_are_exact(spark, accuracy):
    values = {"spread": rng.normal(size=5000), "ties": rng.integers(0, 4, 3000), "hot": np.where(rng.random(4000) < 0.4, 1.5, rng.random(4000)), "one": np.array([3.0]), "two": np.array([1.0, 2.0])}
    rows = spark.createDataFrame([(k, float(v)) for k, x in values.items() for v in x] + [("one", None)], "series_id string, value double")
    at = [0.0, 0.001, 0.25, 0.5, 0.975, 1.0]
    got = {(r["series_id"], r["p"]): r["value"] for r in stats.refined_percentiles(rows, K, "value", at, accuracy).collect()}
    assert got == {(k, p): pytest.approx(float(np.quantile(x, p)), rel=1e-12, abs=1e-12) for k, x in values.items() for p in at}
    whole = {r["p"]: r["value"] for r in stats.refined_percentiles(rows, [], "value", [0.5]).collect()}
    assert whole[0.5] == pytest.approx(float(np.quantile(np.concatenate(list(values.values())), 0.5)))


def test_polynomials_of_far_away_times(spark):
    t = np.arange(200) + 1_000_000
    y = 3.0 - 0.02 * (t - 1_000_100) + 1e-4 * (t - 1_000_100) ** 2 + 0.1 * np.sin(t)
    rows = [("a", int(i), float(v)) for i, v in zip(t, y)] + [("b", 1, 1.0), ("b", 1, 2.0)] + [("c", i, 2.0 + 3.0 * i) for i in range(3)]
    out = {r["series_id"]: r["coefficients"] for r in preprocess.fit_polynomial(spark.createDataFrame(rows, "series_id string, t int, value double"), K, 2).collect()}
    want = np.polyval(np.polyfit(t - 1_000_100.0, y, 2), t - 1_000_100.0)
    assert np.abs(np.polyval(out["a"], t.astype(float)) - want).max() < 1e-2  # power coefficients of such times hold no more digits
    assert out["b"] is None and np.allclose(out["c"], [0.0, 3.0, 2.0], atol=1e-9)


def test_spectra_without_peaks(spark):
    falling = [("falling", k, k / 10, 1.0 / (k + 1)) for k in range(20)]
    one = falling + [("peak", k, k / 10, 10.0 if k == 9 else 1.0 / (k + 1)) for k in range(20)]
    schema = "series_id string, k long, freq double, psd double"
    assert bands.find_peaks(spark.createDataFrame(falling, schema), K).collect() == []
    assert bands.suggest_scalings(bands.find_peaks(spark.createDataFrame(falling, schema), K)).count() == 0
    assert {r["series_id"] for r in bands.find_peaks(spark.createDataFrame(one, schema), K).collect()} == {"peak"}


def test_whole_records_and_blocks_agree(spark, records):
    series = table(spark, records)
    whole = {(r["series_id"], r["k"]): r["psd"] for r in spectral.welch(series, K, 24).collect()}
    cut = {(r["series_id"], r["k"]): r["psd"] for r in blocks.welch(series, K, 24, block=48).select("series_id", "k", F.col("psd")).collect()}
    assert cut == {k: pytest.approx(v) for k, v in whole.items()}
