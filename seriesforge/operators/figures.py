"""What figures of observed and synthetic series show, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesforge.operators import spectral, stats

BINS = 45


def spectrum_panel(observed: DataFrame, ensemble: DataFrame, keys: list[str], nperseg: int = 60, alpha: float = 0.05) -> DataFrame:
    """(keys, k, freq, observed, ci_lower, ci_upper, synthetic): Welch spectra, the members' averaged."""
    mine = spectral.welch(observed, keys, nperseg, alpha=alpha).where("k > 0")
    made = spectral.welch(ensemble, [*keys, "member"], nperseg).groupBy(*keys, "k").agg(F.avg("psd").alias("synthetic"))
    return mine.join(made, [*keys, "k"]).select(*keys, "k", "freq", F.col("psd").alias("observed"), "ci_lower", "ci_upper", "synthetic")


def density_panel(observed: DataFrame, ensemble: DataFrame, keys: list[str], bins: int = BINS) -> DataFrame:
    """(keys, bin, low, observed, synthetic): densities on equal bins over the range of both; the last bin holds its right end."""
    both = observed.select(*keys, "value", F.lit(0).alias("made")).unionByName(ensemble.select(*keys, "value", F.lit(1).alias("made"))).where("value is not null")
    span = both.groupBy(*keys).agg(F.min("value").alias("_lo"), (F.max("value") - F.min("value")).alias("_w"), F.sum(1 - F.col("made")).alias("_n0"), F.sum("made").alias("_n1"))
    place = F.least(F.floor(F.try_divide(F.col("value") - F.col("_lo"), F.col("_w")) * bins), F.lit(bins - 1))
    counts = both.join(span, keys).groupBy(*keys, "_lo", "_w", "_n0", "_n1", place.cast("int").alias("bin")).agg(F.sum(1 - F.col("made")).alias("_a"), F.sum("made").alias("_b"))
    width = F.col("_w") / bins
    return counts.select(*keys, "bin", (F.col("_lo") + F.col("bin") * width).alias("low"), F.try_divide("_a", F.col("_n0") * width).alias("observed"), F.try_divide("_b", F.col("_n1") * width).alias("synthetic"))


def autocorrelation_panel(observed: DataFrame, ensemble: DataFrame, keys: list[str], lags: int = 36) -> DataFrame:
    """(keys, lag, observed, synthetic): the members' averaged."""
    mine = stats.autocorrelation(observed, keys, lags).withColumnRenamed("acf", "observed")
    made = stats.autocorrelation(ensemble, [*keys, "member"], lags).groupBy(*keys, "lag").agg(F.avg("acf").alias("synthetic"))
    return mine.join(made, [*keys, "lag"])


def season_panel(observed: DataFrame, ensemble: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, month, observed, synthetic, low, high): monthly means; 5th and 95th percentile of the members' means."""
    mine = observed.groupBy(*keys, "month").agg(F.avg("value").alias("observed"))
    each = ensemble.groupBy(*keys, "member", "month").agg(F.avg("value").alias("_v"), F.count("value").alias("_n"), F.sum("value").alias("_s"))
    made = each.groupBy(*keys, "month").agg((F.sum("_s") / F.sum("_n")).alias("synthetic"), F.percentile("_v", F.lit(0.05)).alias("low"), F.percentile("_v", F.lit(0.95)).alias("high"))
    return mine.join(made, [*keys, "month"])


def window_panel(observed: DataFrame, ensemble: DataFrame, keys: list[str], years: int) -> DataFrame:
    """(keys, statistic, observed, p5, median, p95, percentile): statistics of overlapping windows of annual means against the observed record's.

    ``observed`` and ``ensemble`` hold t and value; years are twelve steps.
    """
    yearly = lambda df, by: stats.annual(df, by, calendar=False, complete=True)
    shape = [F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), (F.max("value") - F.min("value")).alias("range")]
    mine = yearly(observed, keys).groupBy(*keys).agg(*shape)
    windows = stats.overlapping_windows(yearly(ensemble, [*keys, "member"]), [*keys, "member"], years)
    long = lambda df, name: df.unpivot([c for c in df.columns if c not in ("mean", "std", "range")], ["mean", "std", "range"], "statistic", name)
    joined = long(windows, "_v").join(long(mine, "observed"), [*keys, "statistic"])
    at = [F.percentile("_v", F.lit(p)).alias(n) for p, n in ((0.05, "p5"), (0.5, "median"), (0.95, "p95"))]
    return joined.groupBy(*keys, "statistic").agg(F.max("observed").alias("observed"), *at, (100 * F.avg((F.col("_v") < F.col("observed")).cast("double"))).alias("percentile"))


def return_panel(observed: DataFrame, ensemble: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, member, year, value, rank, return_period): annual means by rank; the observed record is member -1."""
    both = ensemble.select(*keys, "member", "t", "value").unionByName(observed.select(*keys, F.lit(-1).alias("member"), "t", "value"))
    return stats.return_periods(stats.annual(both, [*keys, "member"], calendar=False, complete=True), [*keys, "member"])


def band_panel(ensembles: DataFrame, keys: list[str], bands: dict[str, tuple[float, float]], nperseg: int = 60) -> DataFrame:
    """(experiment, keys, k, freq, psd, band): mean spectra of experiments, each bin with the band that holds it."""
    psd = spectral.welch(ensembles, ["experiment", *keys, "member"], nperseg).where("k > 0").groupBy("experiment", *keys, "k").agg(F.max("freq").alias("freq"), F.avg("psd").alias("psd"))
    band = F.coalesce(*(F.when(spectral.in_band(F.col("freq"), low, high), F.lit(name)) for name, (low, high) in bands.items()), F.lit("none"))
    return psd.withColumn("band", band)


def excerpts(ensembles: DataFrame, keys: list[str], steps: int, member: int = 0) -> DataFrame:
    """The first steps of one member of each experiment, less the member's mean."""
    own = Window.partitionBy("experiment", *keys)
    return ensembles.where(F.col("member") == member).withColumn("value", F.col("value") - F.avg("value").over(own)).where(F.col("t") < steps).select("experiment", *keys, "t", "value")
