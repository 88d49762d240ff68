"""Monte-Carlo significance of spectral bands, and the survey built on it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesforge.functions import kernels, philox

NULLS = ("white", "ar1")
BANDS = {"decadal": (8.0, 20.0), "annual": (0.8, 1.5)}


def white_expectation_pct(low: float, high: float, fs: float = 12.0) -> float:
    """Share that white noise has in a band, in per cent."""
    return 100.0 * (1 / low - 1 / high) / (fs / 2)


def resolution_bandwidth(n: int, nw: float = 1.5, fs: float = 12.0) -> float:
    return 2 * nw / (n / fs)


def surrogate_bands(series: DataFrame, keys: list[str], bands: dict[str, tuple[float, float]] = BANDS, n_surrogates: int = 500, fs: float = 12.0, nw: float = 1.5, seed: int = 0, block: int = 50) -> DataFrame:
    """(keys, band, null, surrogate, variance): band variances of noise like the series.

    Surrogates are made in blocks, a task each; tapers are made once a block.
    Each value is drawn at its step and surrogate, with a key made of the seed,
    the null and the series.
    """
    stats = series.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("t", "value"))).alias("points"))  # one series
    text = lambda null: f"concat_ws('|', '{null}', {', '.join(f'`{k}`' for k in keys)})"
    stats = stats.select("*", *(F.expr(philox.key_sql(text(null), seed, philox.SPARK)).alias(f"_{null}") for null in NULLS))
    work = stats.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit((n_surrogates - 1) // block))))
    work = work.repartition(max(series.sparkSession.sparkContext.defaultParallelism, int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys, "block")
    types = ", ".join(f"{k} {series.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        for batch in batches:
            for row in batch.to_dict("records"):
                x = np.array([p["value"] for p in row["points"]], float)
                phi, sigma = kernels.ar1_fit(x)
                tapers = kernels.dpss(len(x), nw, max(1, int(2 * nw - 1)))
                numbers = range(row["block"] * block, min(n_surrogates, (row["block"] + 1) * block))
                whites, reds = (np.stack([kernels.counter_normals(len(x), s, row[f"_{null}"]) for s in numbers]) for null in NULLS)
                out = []
                for null, records in (("white", x.std() * whites), ("ar1", kernels.ar1_surrogates(sigma * reds, phi))):
                    for s, y in zip(numbers, records):
                        f, p = kernels.multitaper(y, fs, nw, tapers)
                        out += [(*(row[k] for k in keys), name, null, s, kernels.band_variance(f, p, *band)) for name, band in bands.items()]
                yield pd.DataFrame(out, columns=[*keys, "band", "null", "surrogate", "variance"])

    return work.mapInPandas(run, f"{types}, band string, `null` string, surrogate int, variance double")


def observed_bands(series: DataFrame, keys: list[str], bands: dict[str, tuple[float, float]] = BANDS, fs: float = 12.0, nw: float = 1.5) -> DataFrame:
    types = ", ".join(f"{k} {series.schema[k].dataType.simpleString()}" for k in keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("t")["value"].to_numpy(float)
        f, p = kernels.multitaper(x, fs, nw)
        total = p.sum() * (f[1] - f[0])
        rows = [(*pdf[keys].iloc[0], name, v := kernels.band_variance(f, p, *band), 100 * v / total if total else 0.0) for name, band in bands.items()]
        return pd.DataFrame(rows, columns=[*keys, "band", "observed", "share_pct"])

    return series.select(*keys, "t", "value").groupBy(*keys).applyInPandas(run, f"{types}, band string, observed double, share_pct double")


def against_null(observed: DataFrame, null: DataFrame, keys: list[str]) -> DataFrame:
    """Median and 95th percentile of each null, and the observed value's percentile.

    ``observed``: keys, band, observed, share_pct; ``null``: keys, band, null, variance.
    """
    return null.join(observed, [*keys, "band"]).groupBy(*keys, "band", "null").agg(
        F.max("observed").alias("observed"), F.max("share_pct").alias("share_pct"), F.percentile("variance", F.lit(0.5)).alias("median"), F.percentile("variance", F.lit(0.95)).alias("p95"),
        F.avg(F.when(F.col("variance") < F.col("observed"), 100.0).otherwise(0.0)).alias("percentile"),
    )


def monte_carlo(series: DataFrame, keys: list[str], **options) -> DataFrame:
    """``against_null`` for surrogates of each series."""
    observed = observed_bands(series, keys, options.get("bands", BANDS))
    return against_null(observed, surrogate_bands(series, keys, **options), keys)


def classify(phi: Column, decadal_pct: Column, decadal_white: Column, decadal_ar1: Column, annual_pct: Column, annual_white: Column, annual_ar1: Column) -> Column:
    """band-structured, red or white."""
    big_d = decadal_pct >= 2 * white_expectation_pct(*BANDS["decadal"])
    big_a = annual_pct >= 2 * white_expectation_pct(*BANDS["annual"])
    structured = (big_d & (decadal_ar1 >= 95)) | (big_a & (annual_ar1 >= 95))
    red = (F.abs(phi) >= 0.2) | (big_d & (decadal_white >= 95)) | (big_a & (annual_white >= 95))
    return F.when(structured, "band-structured").when(red, "red").otherwise("white")


def verdict(tests: DataFrame, keys: list[str]) -> DataFrame:
    """Significant if any null is beaten at 95 %, relevant from 5 % of the variance."""
    return tests.groupBy(*keys, "band").agg(F.max(F.col("percentile") >= 95).alias("significant"), (F.max("share_pct") >= 5).alias("relevant"))


def surveyed(tests: DataFrame, residuals: DataFrame, keys: list[str]) -> DataFrame:
    """One row per series from its tests: moments, memory, band shares, percentiles and verdict."""
    from seriesforge.operators.stats import lag1

    pick = lambda band, null, column: F.max(F.when((F.col("band") == band) & (F.col("null") == null), F.col(column)))
    wide = tests.groupBy(*keys).agg(*(pick(b, n, "percentile").alias(f"{b}_p_{n}") for b in BANDS for n in ("white", "ar1")), *(pick(b, "white", "share_pct").alias(f"{b}_pct") for b in BANDS))
    base = residuals.groupBy(*keys).agg(F.count("*").alias("n_obs"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.var_pop("value").alias("resid_var"))
    out = base.join(lag1(residuals, keys).drop("sigma"), keys).join(wide, keys)
    c = F.col
    return out.withColumn("verdict", classify(c("phi"), c("decadal_pct"), c("decadal_p_white"), c("decadal_p_ar1"), c("annual_pct"), c("annual_p_white"), c("annual_p_ar1")))


def unusable(series: DataFrame, keys: list[str], least: int = 24) -> DataFrame:
    """(keys, n_obs, verdict) of the series that cannot be surveyed: ``ERROR:`` and why."""
    finite = F.col("value").isNotNull() & ~F.isnan("value")
    checks = series.groupBy(*keys).agg(F.count("*").alias("n_obs"), F.sum(finite.cast("long")).alias("_finite"), F.countDistinct(F.when(finite, F.col("value"))).alias("_values"))
    why = F.when(F.col("_finite") < F.col("n_obs"), "missing values").when(F.col("n_obs") < least, f"fewer than {least} steps").when(F.col("_values") < 2, "no variance")
    return checks.where(why.isNotNull()).select(*keys, "n_obs", F.concat(F.lit("ERROR: "), why).alias("verdict"))


def survey(residuals: DataFrame, keys: list[str], n_surrogates: int = 500, seed: int = 0) -> DataFrame:
    """``surveyed`` with surrogates of each series; one that fails gives a row that says why, not a failed job."""
    failed = unusable(residuals, keys)
    good = residuals.join(failed.select(*keys), keys, "left_anti")
    out = surveyed(monte_carlo(good, keys, n_surrogates=n_surrogates, seed=seed), good, keys)
    return out.unionByName(failed, allowMissingColumns=True)
