"""Synthetic ensembles: fit once, generate members in parallel."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seriesforge.functions import kernels, philox
from seriesforge.operators import gaussian, preprocess, spectral
from seriesforge.plans.experiments import Experiment, experiments_table
from seriesforge.sources import frames, netcdf
from seriesforge.sources.intermediate import removed, written


@dataclass(frozen=True)
class FittedGenerator:
    """All that a series' ensembles need; every part is a small table."""

    keys: list[str]
    mean: DataFrame
    start: DataFrame
    decomposition: preprocess.Decomposition
    residuals: DataFrame
    scores: DataFrame
    quantiles: gaussian.QuantileModel
    psd: DataFrame
    fs: float

    def release(self) -> None:
        """Delete the fitted tables, when nothing reads them any more."""
        removed(self.mean, self.start, self.residuals, self.quantiles.knots, self.quantiles.tail, self.psd, self.decomposition.season, self.decomposition.trend)


def fit_generator(series: DataFrame, keys: list[str], nperseg: int = 60, fs: float = 12.0, kind: str = preprocess.DAY) -> FittedGenerator:
    mean = written(series.groupBy(*keys).agg(F.avg("value").alias("mean")), "mean")
    start = written(series.groupBy(*keys).agg(F.min(F.year("ts")).alias("start_year")), "start")
    model = preprocess.fit(series, keys, kind)
    # Fitted tables are small and read many times: they are written, and what reads them has short plans.
    model = replace(model, mean=mean, season=written(model.season, "season"), trend=written(model.trend, "trend"))
    residuals = written(preprocess.transform(series, model).select(*keys, "ts", "t", "month", "value"), "residuals")
    scores = gaussian.gaussianize(residuals, keys).select(*keys, "t", F.col("g").alias("value"))
    quantiles = gaussian.fit_quantiles(residuals, keys)
    quantiles = gaussian.QuantileModel(keys, written(quantiles.knots, "knots"), written(quantiles.tail, "tail"))
    psd = written(spectral.welch(scores, keys, nperseg, fs), "psd")
    return FittedGenerator(keys, mean, start, model, residuals, scores, quantiles, psd, fs)


def fit_from_path(spark: SparkSession, path: str, variable: str, nperseg: int = 60, fs: float = 12.0, kind: str = preprocess.DAY) -> FittedGenerator:
    """The generator of a series in gridded files; its key ``series_id`` is the variable's name.

    A field, a series of under a year or one with gaps is an error.
    """
    loaded = netcdf.load_variable(spark, path, variable)
    if set(loaded.columns) != {"t", "ts", "value"}:
        raise ValueError(f"a series of dated steps is needed; {variable} has {loaded.columns}")
    months = F.month(F.max("ts")) - F.month(F.min("ts")) + 12 * (F.year(F.max("ts")) - F.year(F.min("ts")))
    span = loaded.agg(F.min("t"), F.max("t"), F.count("*"), months).first()
    if span[0] is None or span[1] - span[0] + 1 != span[2] or (fs == 12 and span[3] is not None and span[3] + 1 != span[2]):
        raise ValueError(f"steps without a value in {variable}")
    series = loaded.select(F.lit(variable).alias("series_id"), "ts", "t", F.month("ts").alias("month"), "value")
    return fit_generator(frames.validate_series(series, ["series_id"]), ["series_id"], nperseg, fs, kind)


def reassemble(residuals: DataFrame, mean: Column, trend: tuple[Column, Column] | None = None) -> DataFrame:
    """Residuals of members plus a mean and, on request, a line (its value at the first step, its slope a step)."""
    line = F.lit(0.0) if trend is None else trend[0] + trend[1] * F.col("t")
    return residuals.withColumn("value", F.col("value") + mean + line)


def synthesize(psd: DataFrame, keys: list[str], suite: list[Experiment], fs: float = 12.0, seed: Column | None = None, sequential: bool = False, unit: bool = True) -> DataFrame:
    """(experiment, keys, member, t, g): unit-variance members with the scaled spectra.

    A task makes one member of one series: spectra are small arrays, members
    are exploded, and each phase is drawn at its bin and member with the seed as
    key. With ``sequential`` the phases are those of a generator that makes one
    member after the other. With ``seed``, an expression over the plan, the keys
    and the member, each member has a stream of its own instead. Without ``unit``
    members keep the variance that the spectrum gives them, and its offset.
    """
    spectra = psd.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("freq", "psd"))).alias("spectrum"))
    plan = experiments_table(psd.sparkSession, suite).select("name", "n_years", "n_members", "seed", "band_scales")
    work = spectra.crossJoin(F.broadcast(plan)).withColumn("member", F.explode(F.expr("sequence(0, n_members - 1)")))
    work = work.withColumn("_stream", F.col("member") if seed is None else F.lit(0))
    work = work if seed is None else work.withColumn("seed", seed)
    work = work.repartition(max(8, psd.sparkSession.sparkContext.defaultParallelism), *keys, "name", "member")
    types = ", ".join(f"{k} {psd.schema[k].dataType.simpleString()}" for k in keys)

    phases = kernels.sequential_phases if sequential else kernels.counter_phases

    def run(batches):
        for batch in batches:
            for row in batch.to_dict("records"):
                freqs, power = np.array([p["freq"] for p in row["spectrum"]]), np.array([p["psd"] for p in row["spectrum"]])
                n = round(row["n_years"] * fs)
                bands = [(b["pmin"], b["pmax"], b["factor"]) for b in (row["band_scales"] if row["band_scales"] is not None else ())]
                g = kernels.synthesize(kernels.amplitudes(freqs, power, n, fs, bands, not unit), n, phases(n // 2 + 1, row["seed"], row["_stream"]), unit)
                yield pd.DataFrame({"experiment": row["name"], **{k: row[k] for k in keys}, "member": row["member"], "t": np.arange(n, dtype=np.int32), "g": g})

    return work.mapInPandas(run, f"experiment string, {types}, member int, t int, g double")


def generate(model: FittedGenerator, suite: list[Experiment]) -> DataFrame:
    """Ensembles with scores ``g``, residuals ``resid`` and values ``value``.

    The mean is added once, the seasonal cycle scaled by the experiment's
    amplitude factor, the trend never.
    """
    keys = model.keys
    g = synthesize(model.psd, keys, suite, model.fs)
    resid = gaussian.inverse_gaussianize(g, model.quantiles, ["experiment", *keys, "member"]).withColumnRenamed("value", "resid")
    scale = F.broadcast(experiments_table(g.sparkSession, suite).select(F.col("name").alias("experiment"), F.sqrt("seasonal_scale").alias("_a")))
    dated = resid.join(scale, "experiment").join(model.start, keys).withColumn("ts", F.expr("add_months(make_date(start_year, 1, 1), t)")).withColumn("month", F.month("ts"))
    season = preprocess.inverse_transform(dated.withColumn("value", F.col("resid")), model.decomposition, season_scale=F.col("_a"))
    out = season.join(model.mean, keys).withColumn("value", F.col("value") + F.col("mean"))
    return out.select("experiment", *keys, "member", "t", "ts", "month", "g", "resid", "value")


def white_control(baseline: DataFrame, keys: list[str], ratio: float, seed: int = 0) -> DataFrame:
    """The baseline plus white noise that lifts its total variance by the ratio.

    A step's noise comes from two uniform numbers (Box-Muller) drawn at the step
    and the member; the key is made of the seed and the series.
    """
    total = baseline.groupBy(*keys).agg(F.var_pop("value").alias("_v"))
    rows = baseline.join(total, keys).withColumn("_key", F.expr(philox.key_sql(f"concat_ws('|', {', '.join(f'`{k}`' for k in keys)})", seed, philox.SPARK)))
    for i in (0, 1):
        rows = philox.with_uniform(rows, f"_u{i}", F.col("t") * 2 + i, F.col("member"), F.col("_key"))
    normal = F.sqrt(-2.0 * F.log("_u0")) * F.cos(2.0 * np.pi * F.col("_u1"))
    noisy = rows.withColumn("_e", F.sqrt(F.lit(max(0.0, ratio - 1)) * F.col("_v")) * normal).drop("_key", "_u0", "_u1")
    own = F.avg("_e").over(Window.partitionBy(*keys, "member"))
    return noisy.withColumn("value", F.col("value") + F.col("_e") - own).drop("_v", "_e")


def delivered_band_variance(ensemble: DataFrame, keys: list[str], band: tuple[float, float], fs: float = 12.0) -> DataFrame:
    """Mean over members of the periodogram's power in a band."""
    schema = ", ".join([f"experiment string, {', '.join(f'{k} {ensemble.schema[k].dataType.simpleString()}' for k in keys)}, member int, v double"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        f, p = kernels.periodogram(pdf.sort_values("t")["value"].to_numpy(float), fs)
        return pd.DataFrame([[*pdf[["experiment", *keys, "member"]].iloc[0], kernels.band_variance(f, p, *band)]], columns=["experiment", *keys, "member", "v"])

    each = ensemble.select("experiment", *keys, "member", "t", "value").groupBy("experiment", *keys, "member").applyInPandas(run, schema)
    return each.groupBy("experiment", *keys).agg(F.avg("v").alias("delivered"))


def calibrate(model: FittedGenerator, band: tuple[float, float], gammas: list[float], n_years: int, n_members: int, seasonal: bool = False, seed: int = 0) -> DataFrame:
    """(keys, gamma, delivered): what each factor gives, all factors in one job."""
    suite = [Experiment(n_years, n_members, seed, ((*band, g),), f"gamma={g!r}", seasonal_scale=g if seasonal else 1.0) for g in gammas]
    table = model.psd.sparkSession.createDataFrame([(e.name, float(g)) for e, g in zip(suite, gammas)], "experiment string, gamma double")
    return delivered_band_variance(generate(model, suite), model.keys, band, model.fs).join(F.broadcast(table), "experiment").select(*model.keys, "gamma", "delivered")


def validate_synthesis(model: FittedGenerator, n_check: int = 20, n_years: int = 100) -> DataFrame:
    """Unit variance and spectral coverage of members against the chi-squared bounds."""
    keys = model.keys
    members = synthesize(model.psd, keys, [Experiment(n_years, n_check, 0)], model.fs)
    spread = members.groupBy(*keys, "member").agg(F.var_pop("g").alias("v")).groupBy(*keys).agg(F.avg("v").alias("mean_variance"), F.stddev_pop("v").alias("std_variance"))
    nperseg = 2 * (model.psd.agg(F.max("k")).first()[0])
    power = spectral.fft_spectra(members.withColumn("value", F.col("g")), [*keys, "member"], model.fs, "welch", nperseg).groupBy(*keys, "k").agg(F.avg("psd").alias("_p"))
    bounds = spectral.with_bounds(model.psd)
    covered = bounds.join(power, [*keys, "k"]).where("k > 0").groupBy(*keys).agg(F.avg(F.col("_p").between(F.col("ci_lower"), F.col("ci_upper")).cast("double")).alias("coverage"))
    out = spread.join(covered, keys)
    return out.withColumn("passed", (F.col("coverage") > 0.5) & (F.abs(F.col("mean_variance") - 1) < 0.05) & (F.col("std_variance") < 0.1))
