"""Properties of the series operators on records with known parts."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from seriesforge.functions import kernels
from seriesforge.operators import bands, field, gaussian, preprocess, significance, spectral, stats, synthesis, validation
from seriesforge.plans import suite
from seriesforge.plans.experiments import Experiment, experiments_table
from seriesforge.plans.registry import QUERIES
from seriesforge.sources import frames
from seriesforge.sources.catalog import Catalog

K = ["series_id"]


@pytest.fixture(scope="module")
def record(spark):
    rng = np.random.default_rng(42)
    t = np.arange(540)
    value = 0.04 + 5e-5 * t + 0.03 * np.sin(2 * np.pi * (t % 12 + 1 - 3) / 12) + rng.normal(0, 0.02, 540)
    rows = [("a", int(i), int(i % 12 + 1), float(v)) for i, v in enumerate(value)]
    return spark.createDataFrame(rows, "series_id string, t int, month int, value double").withColumn("ts", F.expr("add_months(date'1979-01-01', t)")).cache()


@pytest.fixture(scope="module")
def model(record):
    return synthesis.fit_generator(record, K, 60)


def column(df, name="value"):
    return np.array([r[name] for r in df.orderBy("t").collect()])


def test_residuals_have_no_trend_and_no_season(record, model):
    r = model.residuals
    by_month = r.groupBy("month").agg(F.avg("value").alias("m")).collect()
    assert max(abs(x["m"]) for x in by_month) < 1e-10
    slope = preprocess.fit_trend(r, K, preprocess.STEP).first()["slope"]
    assert abs(slope) < 1e-5


def test_round_trip(record, model):
    back = preprocess.inverse_transform(model.residuals, model.decomposition, add_trend=True)
    assert np.allclose(column(back), column(record), atol=1e-10)


def test_gaussian_transform(model):
    checks = gaussian.validate_transform(model.residuals, K).first()
    assert checks["d"] < 0.002 and checks["round_trip"] < 1e-6 and checks["splice_gap"] < 1e-10 and checks["passed"]


def test_tails_grow_with_the_scores(spark, model):
    spread = []
    for scale in (1.0, 2.0, 10.0):
        g = model.scores.select("series_id", "t", (F.col("value") * scale).alias("g"))
        spread.append(column(gaussian.inverse_gaussianize(g, model.quantiles)).std())
    assert spread[0] < spread[1] < spread[2]


def test_spectra_equal_direct_transforms(spark, model):
    x = column(model.residuals)
    n = len(x)
    dft = lambda y: np.abs(np.exp(-2j * np.pi * np.outer(np.arange(len(y) // 2 + 1), np.arange(len(y))) / len(y)) @ y) ** 2
    double = lambda p: p * np.r_[1.0, np.full(len(p) - 2, 2.0), 1.0]
    psd = lambda df: np.array([r["psd"] for r in df.orderBy("k").collect()])
    assert psd(spectral.periodogram(model.residuals, K)) == pytest.approx(double(dft(x - x.mean())) / (12 * n), rel=1e-6, abs=1e-12)
    tapers = kernels.dpss(n, 1.5, 2)
    assert psd(spectral.multitaper(model.residuals, K)) == pytest.approx(double(np.mean([dft(w * (x - x.mean())) for w in tapers], axis=0)) / 12, rel=1e-6, abs=1e-12)
    short = spectral.welch(model.residuals.where("t < 40"), K, 60, alpha=0.05).collect()  # one segment of its own length
    assert {r["n_segments"] for r in short} == {1} and len(short) == 21 and max(r["freq"] for r in short) == pytest.approx(6.0)


def test_welch_segments_and_bounds(model):
    psd = spectral.welch(model.scores, K, 60, alpha=0.05).collect()
    assert {r["n_segments"] for r in psd} == {17} and all(r["ci_lower"] < r["psd"] < r["ci_upper"] for r in psd)
    assert psd[3]["ci_upper"] / psd[3]["ci_lower"] == pytest.approx(2.6237, abs=1e-3)


def test_ensembles(model, record):
    base, wide = Experiment.baseline(n_years=50, n_members=4), Experiment.scaled("wide", (0.8, 1.5), 10.0, n_years=50, n_members=4)
    ens = synthesis.generate(model, [base, wide]).cache()
    sizes = {(r["experiment"], r["member"]): r["n"] for r in ens.groupBy("experiment", "member").agg(F.count("*").alias("n")).collect()}
    assert set(sizes.values()) == {600} and len(sizes) == 8
    observed = record.agg(F.avg("value")).first()[0]
    for r in ens.groupBy("experiment", "member").agg(F.avg("value").alias("m"), F.var_pop("g").alias("v")).collect():
        assert r["m"] == pytest.approx(observed, abs=1e-9) and r["v"] == pytest.approx(1, abs=1e-9)
    again = synthesis.generate(model, [base]).where("member = 2").orderBy("t").collect()
    assert [r["value"] for r in again] == [r["value"] for r in ens.where("experiment = 'baseline' and member = 2").orderBy("t").collect()]
    metrics = {r["experiment"]: r for r in validation.compute_metrics(record, ens, K, 60).collect()}
    assert metrics["baseline"]["mean_ratio"] == pytest.approx(1, abs=0.05) and metrics["baseline"]["seasonal_rmse"] < 0.005
    resid = ens.withColumn("value", F.col("resid"))
    ratio = suite.band_variance_ratio(resid.where("experiment = 'baseline'"), resid.where("experiment = 'wide'"), K, (0.8, 1.5)).first()
    assert ratio["in_band"] > 1.5 > 1 > ratio["out_of_band"]


def test_white_control_lifts_the_variance(model):
    base = synthesis.generate(model, [Experiment.baseline(n_years=50, n_members=3)]).cache()
    noisy = synthesis.white_control(base, K, 2.0)
    v = [df.agg(F.var_pop("value")).first()[0] for df in (base, noisy)]
    assert v[1] / v[0] == pytest.approx(2, abs=0.15)


def test_synthesis_checks(model):
    assert synthesis.validate_synthesis(model, 8, 50).first()["passed"]


def test_significance_and_verdict(model):
    row = significance.survey(model.residuals, K, 60).first()
    assert row["verdict"] == "white" and 0 <= row["annual_p_ar1"] <= 100
    assert significance.white_expectation_pct(8, 20) == pytest.approx(1.25) and significance.white_expectation_pct(0.8, 1.5) == pytest.approx(9.72, abs=0.01)


def test_invert_curve(spark):
    curve = spark.createDataFrame([("a", g, g * 2.0) for g in (1.0, 2.0, 4.0)], "s string, gamma double, delivered double")
    targets = spark.createDataFrame([("a", x) for x in (1.0, 3.0, 8.0)], "s string, target double")
    got = {r["target"]: r["gamma"] for r in bands.invert_curve(curve, targets, ["s"]).collect()}
    assert got == {1.0: 1.0, 3.0: 1.5, 8.0: None}


def test_bands_do_not_count_a_bin_twice(spark):
    psd = spark.createDataFrame([("a", k, k / 8.0, 1.0) for k in range(20)], "series_id string, k long, freq double, psd double")
    rows = bands.variance_by_band(psd, K, bands.band_table(spark, (0.5, 1.0, 2.0, 8.0))).collect()
    assert sum(r["n_bins"] for r in rows) == len([k for k in range(1, 20) if 1 / 8 <= k / 8 < 2])
    assert [r["label"] for r in sorted(rows, key=lambda r: r["band"])] == ["inter-annual", "annual", "sub-annual"]


@pytest.fixture(scope="module")
def patterned(spark):
    rng = np.random.default_rng(99)
    n, p = 60, 30
    pattern = np.linalg.qr(rng.normal(size=(p, 3)))[0]
    scores = rng.normal(size=(n, 3)) * np.array([3, 2, 1.0])
    scores -= scores.mean(axis=0)
    x = scores @ pattern.T + 0.01 * rng.normal(size=(n, p))
    cells = spark.createDataFrame([(c, -75.0 + c * 0.2) for c in range(p)], "cell_id int, lat double")
    rows = [(c, t, t % 12 + 1, float(x[t, c])) for c in range(p) for t in range(n)]
    return spark.createDataFrame(rows, "cell_id int, t int, month int, value double").cache(), cells, x


def test_eofs(patterned):
    frame, cells, x = patterned
    eofs, pcs, spectrum = field.fit_eofs(frame, cells, 3)
    weights = np.sqrt(np.cos(np.radians(75.0 - np.arange(30) * 0.2)))
    s = np.linalg.svd(x * weights, compute_uv=False)
    rows = spectrum.orderBy("mode").collect()
    assert np.allclose([r["s"] for r in rows], s[:3], rtol=1e-6) and np.allclose([r["expvar"] for r in rows], s[:3] ** 2 / (s**2).sum(), rtol=1e-6)
    own = {(r["mode"], r["t"]): r["value"] for r in pcs.collect()}
    assert all(r["value"] == pytest.approx(own[(r["mode"], r["t"])], abs=1e-6) for r in field.project(frame, cells, eofs).collect())
    back = {(r["cell_id"], r["t"]): r["value"] for r in field.reconstruct(pcs, eofs, cells).collect()}
    assert max(abs(back[(c, t)] - x[t, c]) for c in range(30) for t in range(60)) < 0.2
    assert all(r["l"] > 0 for r in eofs.groupBy("mode").agg(F.min_by("loading", "cell_id").alias("l")).collect())
    assert field.modes_for(spectrum, 0.5) == 1 and field.modes_for(spectrum, 1.1) == 3


def test_polygons(spark):
    cells = spark.createDataFrame([(0, 0.5, 0.5), (1, 1.5, 0.5), (2, 0.5, 2.5)], "cell_id int, lon double, lat double")
    ring = spark.createDataFrame([("b", 0, i, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (1.0, 0.0), (1.0, 3.0), (0.0, 3.0), (0.0, 0.0)])], "basin string, ring_id int, seq int, x double, y double")
    assert {r["cell_id"] for r in frames.points_in_polygons(cells, ring).collect()} == {0, 2}


def test_loader_rules(spark, record):
    with pytest.raises(ValueError):
        frames.validate_series(record.limit(5), K)
    with pytest.raises(ValueError):
        frames.validate_series(record.withColumn("value", F.when(F.col("t") != 3, F.col("value"))), K)
    assert frames.validate_series(record, K) is record
    with pytest.raises(ValueError):
        frames.drop_constant_dimensions(record, ["t"])
    with pytest.raises(ValueError):
        frames.find_column(record, ("nothing",))


def test_sinks(spark, record, model, tmp_path):
    suite_ = [Experiment.baseline(n_years=2, n_members=2), Experiment.decadal_enhanced(n_years=2, n_members=2)]
    ens = synthesis.generate(model, suite_)
    frames.write_ensemble(ens, str(tmp_path / "e"), experiments_table(spark, suite_))
    one = frames.read_ensemble(spark, str(tmp_path / "e"), "decadal_enhanced")
    assert one.count() == 48 and "PartitionFilters: [isnotnull(experiment" in one._jdf.queryExecution().toString()
    frames.write_table_csv(record.limit(3), str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 3
    frames.write_basins(record.withColumn("basin", F.lit("b")), str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b")).where("basin = 'b'").count() == 540


def test_catalog(spark):
    c = Catalog.from_rows(spark, [("k1", "/a", "West", "Amundsen", None), ("k2", "/b", None, "nan", "Two")])
    assert len(c) == 2 and "k1" in c and list(c) == ["k1", "k2"] and c.path("k2") == "/b" and c.entry("k1")["name"] == "k1" and c.entry("k2")["subregion"] is None
    c = c.register(spark.createDataFrame([("k1", None, None, None, "One")], "key string, path string, region string, subregion string, name string"))
    assert tuple(c.entry("k1")) == ("k1", "/a", "West", "Amundsen", "One")
    assert [r["key"] for r in c.select(region="wES", names=["ONE", "x"]).collect()] == ["k1"]
    with pytest.raises(KeyError):
        c.path("none")


@pytest.mark.parametrize("bad", [{"n_years": 0}, {"n_members": 0}, {"seed": -1}, {"seasonal_scale": -1}, {"band_scales": ((2, 1, 1),)}, {"band_scales": ((1, 2),)}, {"band_scales": ((1, 2, -1),)}])
def test_experiment_rules(bad):
    with pytest.raises(ValueError):
        Experiment(**bad)


def test_experiments():
    suite_ = Experiment.standard_suite(n_years=10, n_members=2)
    assert [e.name for e in suite_] == ["baseline", "annual_enhanced", "annual_suppressed", "decadal_enhanced", "decadal_suppressed"]
    assert suite_[1].seasonal_scale == 10 and suite_[3].seasonal_scale == 1 and suite_[0].n_months == 120 and not suite_[0].has_band_scaling
    assert all(Experiment.from_dict(e.to_dict()) == e for e in suite_)
    assert suite_[0].rng().random() == suite_[0].rng().random()


def test_convergence_uses_prefixes(model, record):
    ens = synthesis.generate(model, [Experiment.baseline(n_years=10, n_members=5)]).cache()
    rows = {r["n_members"]: r for r in validation.convergence(record, ens, K, [2, 5]).collect()}
    alone = synthesis.generate(model, [Experiment.baseline(n_years=10, n_members=2)]).agg(F.var_pop("value")).first()[0]
    assert rows[2]["variance_ratio"] * record.agg(F.var_pop("value")).first()[0] == pytest.approx(alone)


def test_percentile_rules(spark):
    df = spark.createDataFrame([(float(i),) for i in range(4)], "v double")
    assert stats.percentile_of(df, [], "v", F.lit(2.0)).first()[0] == 50 and stats.percentile_of(df, [], "v", F.lit(2.0), False).first()[0] == 75


def test_eofs_from_either_side_agree(patterned, monkeypatch):
    f, cells = patterned[:2]
    one = [df.orderBy("mode").collect() for df in (field.fit_eofs(f, cells, 3)[2],)]
    by_time = {(r["mode"], r["t"]): r["value"] for r in field.fit_eofs(f, cells, 3)[1].collect()}
    n_cells = f.select("cell_id").distinct().count()
    assert n_cells < 60
    monkeypatch.setattr(field, "MOST", n_cells)
    eofs, pcs, spectrum = field.fit_eofs(f, cells, 3)
    assert [r["s"] for r in spectrum.orderBy("mode").collect()] == pytest.approx([r["s"] for r in one[0]], rel=1e-6)
    got = {(r["mode"], r["t"]): r["value"] for r in pcs.collect()}
    assert got.keys() == by_time.keys() and max(abs(got[k] - by_time[k]) for k in got) < 1e-6 * max(map(abs, got.values()))
    monkeypatch.setattr(field, "MOST", 5)  # both sides are longer: block power iteration
    spectrum = field.fit_eofs(f, cells, 3)[2]
    assert [r["s"] for r in spectrum.orderBy("mode").collect()] == pytest.approx([r["s"] for r in one[0]], rel=1e-8)


def test_survey_says_why_a_series_fails(spark):
    rng = np.random.default_rng(5)
    rows = [("good", t, float(v)) for t, v in enumerate(rng.normal(size=240))] + [("gap", t, None if t == 7 else float(t % 5)) for t in range(60)] + [("flat", t, 1.0) for t in range(60)] + [("short", t, float(t)) for t in range(10)]
    out = {r["series_id"]: r["verdict"] for r in significance.survey(spark.createDataFrame(rows, "series_id string, t int, value double"), K, 50).collect()}
    assert out.pop("good") in ("white", "red", "band-structured")
    assert out == {"gap": "ERROR: missing values", "flat": "ERROR: no variance", "short": "ERROR: fewer than 24 steps"}


def test_added_noise_does_not_depend_on_partitions(spark):
    base = spark.range(2400).selectExpr("'a' AS series_id", "cast(id div 600 AS int) AS member", "cast(id % 600 AS int) AS t", "sin(id) AS value")
    one, two = (synthesis.white_control(df, K, 2.0).orderBy("member", "t").collect() for df in (base.repartition(1), base.repartition(7)))
    assert [r["value"] for r in one] == pytest.approx([r["value"] for r in two])
    x = np.array([r["value"] for r in one])
    assert x.var() == pytest.approx(2 * 0.5, rel=0.1)


def test_months_that_the_fit_lacks_keep_their_rows(spark):
    rows = [("a", t, t % 12 + 1, float(t % 12)) for t in range(36)]
    s = spark.createDataFrame(rows, "series_id string, t int, month int, value double").withColumn("ts", F.expr("add_months(date'2000-01-01', t)"))
    fitted = preprocess.fit(s.where("month != 12"), K, preprocess.STEP)
    assert preprocess.transform(s, fitted).count() == 36


def test_generator_needs_a_whole_series_in_the_file(spark, tmp_path):
    from seriesforge.operators import synthesis
    from seriesforge.sources import netcdf

    rows = [(t, 0, 0, float(t % 12 + (t * 7) % 5)) for t in range(60)]
    columns = "t int, rlat int, rlon int, value double"
    netcdf.write_grid(spark.createDataFrame(rows, columns), str(tmp_path / "a"), 1, 1, "smb")
    model = synthesis.fit_from_path(spark, str(tmp_path / "a"), "smb", 24)
    assert model.mean.first()["mean"] == pytest.approx(sum(r[3] for r in rows) / 60) and model.psd.count() == 13
    model.release()
    netcdf.write_grid(spark.createDataFrame(rows[:20] + rows[21:], columns), str(tmp_path / "b"), 1, 1, "smb")
    with pytest.raises(ValueError, match="without a value"):
        synthesis.fit_from_path(spark, str(tmp_path / "b"), "smb")
    netcdf.write_grid(spark.createDataFrame(rows, columns), str(tmp_path / "c"), 1, 2, "smb")
    with pytest.raises(ValueError, match="a series of dated"):
        synthesis.fit_from_path(spark, str(tmp_path / "c"), "smb")


def test_spectra_of_long_records_come_in_batches(spark, capsys):
    n = 150_001
    series = spark.range(n).select(F.lit("a").alias("series_id"), (n - F.col("id")).alias("t"), (F.abs(F.hash("id")) % 1000).alias("value"))
    psd = spectral.periodogram(series, ["series_id"])
    psd.explain()
    assert "FlatMapGroupsInArrow" in capsys.readouterr().out
    got = psd.orderBy("k").toPandas()
    x = series.orderBy("t").toPandas()["value"].to_numpy(float)
    f, p = kernels.periodogram(x, 12.0)
    assert list(got["k"]) == list(range(len(f))) and got["freq"].to_numpy() == pytest.approx(f) and got["psd"].to_numpy() == pytest.approx(p)


def test_customers_are_dealt_out_and_the_series_is_read_once(spark, sf_dir):
    """A task's memory does not grow with the customers, nor with the times that a plan names the series."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for source in (frames.region_month_series, frames.nation_month_field):
        joined = plan(source(spark, sf_dir))
        assert "ShuffledHashJoin [o_custkey" in joined and "BroadcastHashJoin [o_custkey" not in joined
    assert "o_custkey" not in plan(QUERIES["diag_preprocess"](spark, sf_dir))
