"""Spectral bands: variance by band, peaks, suggested scalings, calibration."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesforge.functions import kernels
from seriesforge.operators.blocks import with_keys

# Default edges in years.
PERIOD_EDGES = (0.1, 0.8, 1.5, 8.0, 20.0, 100.0)


def auto_label(period: Column) -> Column:
    return (
        F.when(period < 0.5, "sub-seasonal").when(period < 0.9, "sub-annual").when(period < 1.5, "annual").when(period < 4, "biennial").when(period < 8, "inter-annual").when(period < 20, "decadal").otherwise("multi-decadal")
    )


def band_table(spark, edges: tuple[float, ...] = PERIOD_EDGES, labels: list[str] | None = None) -> DataFrame:
    """(band, low, high, label), from long periods to short ones."""
    pairs = list(zip(edges[:-1], edges[1:]))[::-1]
    rows = [(i, a, b, labels[i] if labels else None) for i, (a, b) in enumerate(pairs)]
    table = spark.createDataFrame(rows, "band int, low double, high double, label string")
    return table.withColumn("label", F.coalesce("label", auto_label(F.sqrt(F.col("low") * F.col("high")))))


def variance_by_band(psd: DataFrame, keys: list[str], bands: DataFrame, half_open: bool = True) -> DataFrame:
    """Variance, share and running share of each band.

    A bin on a shared edge belongs to the band of shorter periods; with
    ``half_open=False`` to both.
    """
    step = psd.groupBy(*keys).agg(F.max(F.when(F.col("k") == 1, F.col("freq"))).alias("_df"), F.sum(F.when(F.col("k") > 0, F.col("psd"))).alias("_all"))
    upper = F.col("freq") < 1 / F.col("low") if half_open else F.col("freq") <= 1 / F.col("low")
    inside = (F.col("freq") >= 1 / F.col("high")) & upper
    crossed = psd.where("k > 0").select(*keys, "freq", "psd").join(F.broadcast(bands), inside)  # a handful of bands
    sums = crossed.groupBy(*keys, "band").agg(F.sum("psd").alias("_s"), F.count("*").alias("n_bins"))
    every = step.crossJoin(F.broadcast(bands)).join(sums, [*keys, "band"], "left")
    out = every.withColumn("variance", F.coalesce("_s", F.lit(0.0)) * F.col("_df")).withColumn("variance_frac", F.try_divide(F.coalesce("_s", F.lit(0.0)), "_all"))
    run = Window.partitionBy(*keys).orderBy("band").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("cumulative_frac", F.sum("variance_frac").over(run)).select(*keys, "band", "label", "low", "high", F.coalesce("n_bins", F.lit(0)).alias("n_bins"), "variance", "variance_frac", "cumulative_frac")


def bands_explaining(shares: DataFrame, keys: list[str], threshold: float = 0.8) -> DataFrame:
    """How many bands, largest first, reach the threshold; all if none do."""
    order = Window.partitionBy(*keys).orderBy(F.desc("variance_frac"), "band")
    ranked = shares.withColumn("rank", F.row_number().over(order)).withColumn("_c", F.sum("variance_frac").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return ranked.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("_c") >= threshold, F.col("rank"))), F.max("rank")).cast("long").alias("n_bands"))


def smooth_log_psd(psd: DataFrame, keys: list[str]) -> DataFrame:
    """Centred mean of three of log10 PSD without the zero bin; edges are reflected."""
    w = Window.partitionBy(*keys).orderBy("k")
    logs = psd.where("k > 0").withColumn("_l", F.log10("psd"))
    return logs.withColumn("smooth", (F.coalesce(F.lag("_l").over(w), "_l") + F.col("_l") + F.coalesce(F.lead("_l").over(w), "_l")) / 3.0).drop("_l")


def find_peaks(psd: DataFrame, keys: list[str], least_prominence: float = 0.3, min_period: float = 0.5, max_period: float = 50.0) -> DataFrame:
    """Peaks with their half-power band, one bin wider on each side, ranked by share of variance.

    A spectrum's bins meet in one group, where its peaks are found in one pass.
    """
    smooth = smooth_log_psd(psd, keys).select(*keys, "k", "freq", "psd", "smooth")
    types = ", ".join(f"`{k}` {psd.schema[k].dataType.simpleString()}" for k in keys)
    columns = ["k", "freq_peak", "psd_peak", "prominence", "pmin", "pmax", "variance", "variance_frac"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        freq, power, rows = pdf["freq"].to_numpy(float), pdf["psd"].to_numpy(float), []
        for i, prominence in kernels.find_peaks(pdf["smooth"].to_numpy(float), least_prominence):
            if not 1 / max_period <= freq[i] <= 1 / min_period:
                continue
            weak = np.flatnonzero(power < power[i] / 2)
            left, right = weak[weak < i], weak[weak > i]
            lo, hi = (left[-1] if len(left) else 0), (right[0] if len(right) else len(power) - 1)
            inside = power[lo : hi + 1].sum()
            rows.append((int(pdf["k"].iloc[i]), freq[i], power[i], prominence, 1 / freq[hi], 1 / freq[lo], inside * freq[0], inside / power.sum()))
        return with_keys(pdf, keys, pd.DataFrame(rows, columns=columns).astype({"k": "int64"} | dict.fromkeys(columns[1:], "float64")))

    found = smooth.groupBy(*keys).applyInPandas(run, f"{types}, k long, {', '.join(f'{c} double' for c in columns[1:])}")
    ranked = found.withColumn("period_peak", 1 / F.col("freq_peak")).withColumn("label", auto_label(1 / F.col("freq_peak")))
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("variance_frac"), "k")).cast("long"))


def suggest_scalings(peaks: DataFrame, n_bands: int = 3, enhance: float = 10.0, suppress: float = 0.1) -> DataFrame:
    """For each of the top bands a strengthening and a weakening factor."""
    return peaks.where(F.col("rank") <= n_bands).withColumn("factor", F.explode(F.array(F.lit(enhance), F.lit(suppress)))).drop("psd_peak", "prominence")


def compare_bands(shares: DataFrame, key: str) -> DataFrame:
    """Share per key and band, a column for each band label."""
    return shares.groupBy(key).pivot("label").agg(F.first("variance_frac"))


def invert_curve(curve: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Setting at which ``delivered`` reaches a target.

    At or below the least delivered value: the grid's floor; at or above the
    greatest: null (infeasible); between: on the line of the neighbours.
    ``curve``: keys, gamma, delivered; ``targets``: keys, target.
    """
    w = Window.partitionBy(*keys).orderBy("delivered", "gamma")
    steps = curve.withColumn("_d", F.lead("delivered").over(w)).withColumn("_g", F.lead("gamma").over(w))
    ends = curve.groupBy(*keys).agg(F.min("delivered").alias("_lo"), F.max("delivered").alias("_hi"), F.min_by("gamma", F.struct("delivered", "gamma")).alias("_floor"))
    joined = targets.join(ends, keys).join(steps, keys)
    here = (F.col("target") >= F.col("delivered")) & (F.col("target") < F.col("_d"))
    line = F.col("gamma") + (F.col("target") - F.col("delivered")) / (F.col("_d") - F.col("delivered")) * (F.col("_g") - F.col("gamma"))
    found = joined.groupBy(*keys, "target").agg(F.max("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.max("_floor").alias("_floor"), F.max(F.when(here, line)).alias("_line"))
    gamma = F.when(F.col("target") <= F.col("_lo"), F.col("_floor")).when(F.col("target") >= F.col("_hi"), F.lit(None).cast("double")).otherwise(F.col("_line"))
    return found.select(*keys, "target", gamma.alias("gamma"))
