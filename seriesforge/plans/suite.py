"""The calibrated suite, the spatial diagnostics and what reads their results."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesforge.functions import kernels
from seriesforge.operators import bands, field, significance, spectral, synthesis
from seriesforge.plans.experiments import ANNUAL, DECADAL, Experiment
from seriesforge.sources.intermediate import written

# The default plan.
MATCHED_RATIOS = (2.0, 3.0)
SEASONAL_LADDER = (2.0, 5.0, 10.0)
SUPPRESSION = 0.5


def target_rows() -> list[tuple[str, str, str, float | None]]:
    """(label, kind, group, ratio to the baseline's annual variance) of the plan."""
    rows = [(f"annual_{r:g}x", "annual", f"matched_{r:g}", r) for r in MATCHED_RATIOS] + [(f"decadal_{r:g}x", "decadal", f"matched_{r:g}", r) for r in MATCHED_RATIOS]
    rows += [(f"annual_{SUPPRESSION:g}x", "annual", "suppression", SUPPRESSION)] + [(f"seasonal_{r:g}x", "seasonal", f"seasonal_{r:g}", r) for r in SEASONAL_LADDER]
    return [*rows, ("decadal_max", "decadal", "max", None)]  # as much as the grid of factors gives


def suite_targets(baseline: DataFrame, keys: list[str]) -> DataFrame:
    """(label, kind, group, keys, target): band variances that experiments are to deliver."""
    plan = baseline.sparkSession.createDataFrame(target_rows(), "label string, kind string, `group` string, ratio double")
    base = baseline.select(*keys, "annual")  # both partners of a matched pair aim at the same annual change
    return plan.crossJoin(base).withColumn("target", F.col("annual") * F.col("ratio")).select("label", "kind", "group", *keys, "target")


def calibrated_suite(model: synthesis.FittedGenerator, gammas: list[float], n_years: int = 20, n_members: int = 3, seed: int = 0) -> DataFrame:
    """(label, kind, group, keys, target, gamma): factors that deliver the targets; null if none does.

    A row without target takes the grid's largest factor.
    """
    keys = model.keys
    base = synthesis.delivered_band_variance(synthesis.generate(model, [Experiment(n_years, n_members, seed)]), keys, ANNUAL, model.fs).select(*keys, F.col("delivered").alias("annual"))
    targets = suite_targets(base, keys)
    curves = [
        synthesis.calibrate(model, band, gammas, n_years, n_members, seasonal, seed).withColumn("kind", F.lit(kind))
        for kind, band, seasonal in (("annual", ANNUAL, False), ("seasonal", ANNUAL, True), ("decadal", DECADAL, False))
    ]
    curve = written(curves[0].unionByName(curves[1]).unionByName(curves[2]), "curves")
    found = bands.invert_curve(curve, targets.select("kind", *keys, "target").distinct(), ["kind", *keys])
    gamma = F.when(F.col("target").isNull(), F.lit(float(max(gammas)))).otherwise(F.col("gamma")).alias("gamma")
    return targets.join(found, ["kind", *keys, "target"], "left").select("label", "kind", "group", *keys, "target", gamma)


def matched_pairs(summary: DataFrame, keys: list[str]) -> DataFrame:
    """The annual and the decadal row of a group: how far what they inject differs, and their total ratios.

    ``summary``: label, kind, group, keys, injected, total_ratio.
    """
    side = lambda kind: summary.where(F.col("kind") == kind).select("group", *keys, F.col("injected").alias(f"{kind}_injected"), F.col("total_ratio").alias(f"{kind}_total"))
    both = side("annual").join(side("decadal"), ["group", *keys])
    return both.withColumn("difference", F.try_divide(F.abs(F.col("annual_injected") - F.col("decadal_injected")), F.abs("annual_injected")))


def means_preserved(summary: DataFrame, keys: list[str], baseline: str = "baseline", tolerance: float = 1e-4) -> DataFrame:
    """Per series: whether every experiment's mean is the baseline's. ``summary``: label, keys, mean."""
    base = summary.where(F.col("label") == baseline).select(*keys, F.col("mean").alias("_m"))
    near = F.abs(F.col("mean") - F.col("_m")) <= 1e-8 + tolerance * F.abs("_m")
    return summary.join(base, keys).groupBy(*keys).agg(F.bool_and(near).alias("mean_preserved"), F.sum((~near).cast("long")).alias("n_off"))


def with_white_controls(summary: DataFrame, keys: list[str]) -> DataFrame:
    """Each seasonal row beside the control of its group."""
    seasonal = summary.where("kind = 'seasonal'")
    control = summary.where("kind = 'control'").select("group", *keys, F.col("label").alias("control"), F.col("total_ratio").alias("control_ratio"))
    return seasonal.join(control, ["group", *keys], "left")


def suite_summary(ensembles: DataFrame, keys: list[str], baseline: str = "baseline", fs: float = 12.0) -> DataFrame:
    """Band and total variances of each experiment, with ratios to the baseline."""
    annual = synthesis.delivered_band_variance(ensembles, keys, ANNUAL, fs).withColumnRenamed("delivered", "v_annual")
    decadal = synthesis.delivered_band_variance(ensembles, keys, DECADAL, fs).withColumnRenamed("delivered", "v_decadal")
    total = ensembles.groupBy("experiment", *keys).agg(F.var_pop("value").alias("v_total"), F.avg("value").alias("mean"))
    every = total.join(annual, ["experiment", *keys]).join(decadal, ["experiment", *keys])
    base = every.where(F.col("experiment") == baseline).select(*keys, *(F.col(c).alias(f"_{c}") for c in ("v_annual", "v_decadal", "v_total")))
    ratio = lambda c: (F.col(f"v_{c}") / F.when(F.col(f"_v_{c}") != 0, F.col(f"_v_{c}"))).alias(f"{c}_ratio")
    return every.join(base, keys).select("experiment", *keys, "v_annual", "v_decadal", "v_total", "mean", ratio("annual"), ratio("decadal"), ratio("total"))


def band_variance_ratio(base: DataFrame, scaled: DataFrame, keys: list[str], band: tuple[float, float], nperseg: int = 60, fs: float = 12.0) -> DataFrame:
    """Change of Welch power inside and outside a band; ensembles need a member column."""

    def power(ensemble: DataFrame, name: str) -> DataFrame:
        psd = spectral.fft_spectra(ensemble, [*keys, "member"], fs, "welch", nperseg).where("k > 0")
        inside = spectral.in_band(F.col("freq"), *band)
        return psd.groupBy(*keys).agg(F.sum(F.when(inside, F.col("psd")).otherwise(0.0)).alias(f"in_{name}"), F.sum(F.when(inside, 0.0).otherwise(F.col("psd"))).alias(f"out_{name}"))

    both = power(base, "a").join(power(scaled, "b"), keys)
    return both.select(*keys, (F.col("in_b") / F.when(F.col("in_a") != 0, F.col("in_a"))).alias("in_band"), F.try_divide("out_b", "out_a").alias("out_of_band"))


def spatial_diagnostic(residuals: DataFrame, fs: float = 12.0) -> DataFrame:
    """Per band: variance of cells and of their mean, suppression and effective coherence.

    Each cell's spectrum is made once and summed into all bands.
    """

    def band_powers(pdf: pd.DataFrame) -> pd.DataFrame:
        f, p = kernels.multitaper(pdf.sort_values("t")["value"].to_numpy(float), fs)
        return pd.DataFrame([(name, kernels.band_variance(f, p, *band)) for name, band in significance.BANDS.items()], columns=["band", "v"])

    n = residuals.agg(F.countDistinct("cell_id").alias("n_cells"))
    cells = residuals.select("cell_id", "t", "value").groupBy("cell_id").applyInPandas(band_powers, "band string, v double").groupBy("band").agg(F.avg("v").alias("cell_variance"))
    # The mean over cells is one record, as long as any cell's.
    mean = residuals.groupBy("t").agg(F.avg("value").alias("value")).groupBy().applyInPandas(band_powers, "band string, v double").withColumnRenamed("v", "mean_variance")
    out = cells.join(mean, "band").crossJoin(n)  # one row
    kept = F.try_divide("mean_variance", "cell_variance")
    return out.withColumn("suppression", kept).withColumn("coherence", F.try_divide(F.col("n_cells") * kept - 1, F.col("n_cells") - 1))


def component_survey(residuals: DataFrame, cells: DataFrame, n_modes: int = 4, n_surrogates: int = 500) -> DataFrame:
    """Whiteness of each principal component, its share and whether it is separable."""
    _, pcs, spectrum = field.fit_eofs(residuals, cells, n_modes)
    n = pcs.agg(F.max("t")).first()[0] + 1
    rows = significance.survey(pcs, ["mode"], n_surrogates).select("mode", "phi", "decadal_pct", "annual_pct", "verdict")
    return rows.join(field.north_rule(spectrum, n).select("mode", "expvar", "separable"), "mode")
