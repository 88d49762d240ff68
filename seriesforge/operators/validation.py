"""How well ensembles match what they were fitted to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesforge.operators import field as fields
from seriesforge.operators import gaussian, preprocess, spectral, stats, synthesis
from seriesforge.plans.experiments import Experiment


def monthly_mean(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys, "month").agg(F.avg("value").alias("v"))


def compute_metrics(observed: DataFrame, ensemble: DataFrame, keys: list[str], nperseg: int = 30, fs: float = 12.0) -> DataFrame:
    """Per experiment and series: mean and variance ratio, KS distance, PSD, ACF and season errors.

    The Kolmogorov-Smirnov distance uses the whole ensemble; spectrum and
    autocorrelation use member 0.
    """
    by = ["experiment", *keys]
    obs = observed.groupBy(*keys).agg(F.avg("value").alias("_om"), F.var_pop("value").alias("_ov"))
    syn = ensemble.groupBy(*by).agg(F.avg("value").alias("_sm"), F.var_pop("value").alias("_sv"))
    base = syn.join(obs, keys).select(*by, F.try_divide("_sm", "_om").alias("mean_ratio"), F.try_divide("_sv", "_ov").alias("variance_ratio"))
    names = ensemble.select(*by).distinct()
    both = ensemble.select(*by, "value", F.lit(1).alias("second")).unionByName(observed.select(*keys, "value").join(names, keys).select(*by, "value", F.lit(0).alias("second")))
    ks = gaussian.ks_two_sample(both, by).select(*by, F.col("d").alias("ks_distance"))
    first = ensemble.where("member = 0")
    obs_psd = spectral.fft_spectra(observed, keys, fs, "welch", nperseg).select(*keys, "k", F.col("psd").alias("_o"))
    syn_psd = spectral.fft_spectra(first, by, fs, "welch", nperseg)
    psd = stats.rms_difference(syn_psd.where("k > 0").join(obs_psd, [*keys, "k"]), by, F.log10("psd"), F.log10("_o")).withColumnRenamed("rms", "psd_rms")
    acf_o = stats.autocorrelation(observed, keys, 12).where("lag in (1, 12)").select(*keys, "lag", F.col("acf").alias("_o"))
    acf = stats.autocorrelation(first, by, 12).join(acf_o, [*keys, "lag"]).groupBy(*by).agg(*(F.max(F.when(F.col("lag") == lag, F.abs(F.col("acf") - F.col("_o")))).alias(f"acf_lag{lag}_error") for lag in (1, 12)))
    season = stats.rms_difference(monthly_mean(ensemble, by).join(monthly_mean(observed, keys).withColumnRenamed("v", "_o"), [*keys, "month"]), by, F.col("v"), F.col("_o")).withColumnRenamed("rms", "seasonal_rmse")
    out = base
    for part in (ks, psd, acf, season):
        out = out.join(part, by)
    return out


def suite_metrics(series: DataFrame, keys: list[str], suite: list[Experiment] | None = None, nperseg: int = 60) -> DataFrame:
    """Fit, generate the suite and score it, for all series at once: one row per experiment and series."""
    model = synthesis.fit_generator(series, keys, nperseg)
    return compute_metrics(series, synthesis.generate(model, suite or Experiment.standard_suite()), keys, nperseg)


def metrics_table(metrics: DataFrame, experiment: str = "baseline") -> DataFrame:
    """The scores of one experiment, a row for each series."""
    return metrics.where(F.col("experiment") == experiment).drop("experiment")


def convergence(observed: DataFrame, ensemble: DataFrame, keys: list[str], counts: list[int]) -> DataFrame:
    """Ratios for the first n members; members do not depend on how many there are."""
    table = ensemble.sparkSession.createDataFrame([(c,) for c in counts], "n_members int")
    obs = observed.groupBy(*keys).agg(F.avg("value").alias("_om"), F.var_pop("value").alias("_ov"))
    syn = ensemble.join(F.broadcast(table), F.col("member") < F.col("n_members")).groupBy(*keys, "n_members").agg(F.avg("value").alias("_sm"), F.var_pop("value").alias("_sv"))
    return syn.join(obs, keys).select(*keys, "n_members", F.try_divide("_sm", "_om").alias("mean_ratio"), F.try_divide("_sv", "_ov").alias("variance_ratio"))


def calibration_split(series: DataFrame, keys: list[str], n_members: int = 5, n_years: int = 50, nperseg: int = 12, seed: int = 0) -> DataFrame:
    """Fit on each half, score on the other."""
    halves = stats.split_halves(series, keys)
    out = None
    for half in (0, 1):
        model = synthesis.fit_generator(halves.where(F.col("half") == half).drop("half"), keys, nperseg)
        ensemble = synthesis.generate(model, [Experiment(n_years, n_members, seed)])
        syn = ensemble.groupBy(*keys).agg(F.avg("value").alias("_sm"), F.var_pop("value").alias("_sv"))
        obs = halves.where(F.col("half") == 1 - half).groupBy(*keys).agg(F.avg("value").alias("_om"), F.var_pop("value").alias("_ov"))
        part = syn.join(obs, keys).select(*keys, F.lit(half).alias("fitted_half"), F.try_divide("_sm", "_om").alias("mean_ratio"), F.try_divide("_sv", "_ov").alias("variance_ratio"))
        out = part if out is None else out.unionByName(part)
    return out


def map_metrics(observed: DataFrame, ensemble: DataFrame) -> DataFrame:
    """Correlation of mean and variance maps, and pooled ratios, over cells."""
    o = observed.groupBy("cell_id").agg(F.avg("value").alias("om"), F.var_pop("value").alias("ov"))
    s = ensemble.groupBy("cell_id").agg(F.avg("value").alias("sm"), F.var_pop("value").alias("sv"))
    return o.join(s, "cell_id").agg(F.corr("om", "sm").alias("mean_corr"), F.corr("ov", "sv").alias("variance_corr"), F.try_divide(F.avg("sm"), F.avg("om")).alias("mean_ratio"), F.try_divide(F.avg("sv"), F.avg("ov")).alias("variance_ratio"), F.avg(F.try_divide("sv", "ov")).alias("map_ratio"))


def validate_generator(model: synthesis.FittedGenerator, n_check: int = 20, n_years: int = 100) -> DataFrame:
    """All checks of a fitted generator: its transform, its synthesis, and that what it fits is stationary."""
    keys = model.keys
    transform = gaussian.validate_transform(model.residuals, keys).select(*keys, "d", "round_trip", F.col("passed").alias("transform_passed"))
    synthetic = synthesis.validate_synthesis(model, n_check, n_years).select(*keys, "coverage", "mean_variance", F.col("passed").alias("synthesis_passed"))
    out = transform.join(synthetic, keys).join(preprocess.stationarity(model.residuals, keys).select(*keys, "p_value", "stationary"), keys)
    return out.withColumn("passed", F.col("transform_passed") & F.col("synthesis_passed") & F.col("stationary"))


def field_halves(field: DataFrame) -> DataFrame:
    """The field with ``half``: 0 for the first half of its times, 1 for the rest."""
    n = field.agg(F.max("t").alias("_n"))
    return field.crossJoin(F.broadcast(n)).withColumn("half", (F.col("t") >= F.expr("(_n + 1) div 2")).cast("int")).drop("_n")  # one row


def against_other_half(halves: DataFrame, ensemble: Callable[[int], DataFrame]) -> DataFrame:
    """``map_metrics`` of what is made from each half, against the other one."""
    parts = [map_metrics(halves.where(F.col("half") == 1 - half), ensemble(half)).withColumn("fitted_half", F.lit(half)) for half in (0, 1)]
    return parts[0].unionByName(parts[1])


def field_calibration_split(field: DataFrame, cells: DataFrame, n_members: int = 10, n_years: int = 50, n_modes: int = 4, nperseg: int = 12, seed: int = 0) -> DataFrame:
    """Fit fields on each half, score on the other."""
    halves = field_halves(field)

    def made(half: int) -> DataFrame:
        part = halves.where(F.col("half") == half)
        first = part.agg(F.min("t")).first()[0]
        return fields.generate_field(part.drop("half").withColumn("t", F.col("t") - first), cells, Experiment(n_years, n_members, seed), n_modes, nperseg)

    return against_other_half(halves, made)


def component_metrics(residuals: DataFrame, cells: DataFrame, n_modes: int = 4, nperseg: int = 30, fs: float = 12.0) -> DataFrame:
    """Per mode: share of the variance alone and with those before, and the distance of its spectra.

    The distance is that of the Gaussianised component's Welch spectrum (60
    steps, half the record at most) from the one it is synthesised from, both
    on the bins of the former.
    """
    _, pcs, spectrum = fields.fit_eofs(residuals, cells, n_modes)
    n = pcs.agg(F.max("t")).first()[0] + 1
    scores = gaussian.gaussianize(pcs, ["mode"]).select("mode", "t", F.col("g").alias("value"))
    observed = spectral.welch(scores, ["mode"], min(60, n // 2), fs)
    used = spectral.interpolate_psd(spectral.welch(scores, ["mode"], nperseg, fs), ["mode"], min(60, n // 2), fs).select("mode", "k", F.col("psd").alias("_used"))
    rms = stats.rms_difference(observed.where("k > 0").join(used, ["mode", "k"]), ["mode"], F.log10("psd"), F.log10("_used")).withColumnRenamed("rms", "psd_rms")
    run = Window.orderBy("mode").rowsBetween(Window.unboundedPreceding, 0)  # a row per mode
    return spectrum.withColumn("eof_cumvar", F.sum("expvar").over(run)).join(rms, "mode").select("mode", "expvar", "eof_cumvar", "psd_rms")


def validate_fields(observed: DataFrame, cells: DataFrame, experiment, n_modes: int = 4) -> DataFrame:
    return map_metrics(observed, fields.generate_field(observed, cells, experiment, n_modes))
