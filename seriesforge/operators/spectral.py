"""Power spectra of many series, and what is done with them.

A series is transformed by an FFT where its rows meet: Spark groups the rows by
series, and each group is one record. What follows (bands, bounds,
interpolation) are aggregates and equality joins on the spectra.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesforge.functions import kernels

#: Rows of a spectrum that leave a task at once.
BATCH_ROWS = 1 << 16


def segment_count(n: int, nperseg: int) -> int:
    """Half-overlapping segments in n steps (true hop, also for odd lengths)."""
    return 1 + (n - nperseg) // (nperseg - nperseg // 2)


def segments(series: DataFrame, nperseg: int) -> DataFrame:
    """Each sample in every segment that holds it: adds ``segment`` and its place ``_j``."""
    hop = nperseg - nperseg // 2
    first = F.greatest(F.lit(0), F.ceil((F.col("t") - (nperseg - 1)) / F.lit(hop)).cast("int"))
    last = F.least(F.floor((F.col("_len") - nperseg) / F.lit(hop)).cast("int"), F.floor(F.col("t") / F.lit(hop)).cast("int"))
    return series.where(F.col("_len") >= nperseg).where(last >= first).withColumn("segment", F.explode(F.sequence(first, last))).withColumn("_j", (F.col("t") - F.col("segment") * hop).cast("long"))


def fft_spectra(series: DataFrame, keys: list[str], fs: float = 12.0, method: str = "periodogram", nperseg: int = 60, nw: float = 1.5) -> DataFrame:
    """(keys, k, freq, psd, n_segments) of each series; a record's length is its own.

    Rows without a value are left out; a series without any has no spectrum.
    """
    schema = ", ".join([*(f"`{k}` {series.schema[k].dataType.simpleString()}" for k in keys), "k long, freq double, psd double, n_segments long"])

    names = [*keys, "k", "freq", "psd", "n_segments"]

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A record comes and its spectrum goes in batches; only numbers are held."""
        t, x = zip(*((np.array(b.column("t")), np.array(b.column("value"), float)) for b in batches))
        t = np.argsort(np.concatenate(t), kind="stable")
        x = np.concatenate(x)[t]
        del t
        n_segments = 1
        if method == "welch":
            f, p, n_segments = kernels.welch(x, fs, nperseg)
        elif method == "multitaper":
            f, p = kernels.multitaper(x, fs, nw)
        else:
            f, p = kernels.periodogram(x, fs)
        for at in range(0, len(f), BATCH_ROWS):
            n = min(BATCH_ROWS, len(f) - at)
            columns = [np.arange(at, at + n), f[at : at + n], p[at : at + n], np.full(n, n_segments)]
            yield pa.RecordBatch.from_arrays([*(pa.repeat(v, n) for v in key), *map(pa.array, columns)], names=names)

    return series.select(*keys, "t", F.col("value").cast("double").alias("value")).where("value is not null").groupBy(*keys).applyInArrow(run, schema)


def periodogram(series: DataFrame, keys: list[str], fs: float = 12.0) -> DataFrame:
    """(keys, k, freq, psd) of the whole record; the last bin is never doubled."""
    return fft_spectra(series, keys, fs).drop("n_segments")


def welch(series: DataFrame, keys: list[str], nperseg: int = 60, fs: float = 12.0, alpha: float | None = None) -> DataFrame:
    """Averaged periodic-Hann spectra (keys, k, freq, psd, n_segments), with bounds on request.

    A record shorter than ``nperseg`` is one segment of its own length.
    """
    out = fft_spectra(series, keys, fs, "welch", nperseg)
    return out if alpha is None else with_bounds(out, alpha)


def with_bounds(psd: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Chi-squared bounds with two degrees of freedom a segment.

    The quantiles are constants of the segment counts that occur, which record
    lengths bound.
    """
    counts = [r[0] for r in psd.select("n_segments").distinct().collect()]
    table = psd.sparkSession.createDataFrame([(int(k), kernels.chi2_ppf(1 - alpha / 2, 2 * int(k)), kernels.chi2_ppf(alpha / 2, 2 * int(k))) for k in counts] or [(0, 1.0, 1.0)], "n_segments long, _hi double, _lo double")
    nu = 2 * F.col("n_segments")
    return psd.join(table, "n_segments").withColumn("ci_lower", F.col("psd") * nu / F.col("_hi")).withColumn("ci_upper", F.col("psd") * nu / F.col("_lo")).drop("_hi", "_lo")


def multitaper(series: DataFrame, keys: list[str], fs: float = 12.0, nw: float = 1.5) -> DataFrame:
    """Mean of tapered periodograms (keys, k, freq, psd), of the whole record."""
    return fft_spectra(series, keys, fs, "multitaper", nw=nw).drop("n_segments")


def interpolate_psd(psd: DataFrame, keys: list[str], n: int, fs: float = 12.0, bands: list[tuple[float, float, float]] | None = None) -> DataFrame:
    """Spectrum on the grid of a record of n steps, bands scaled by product.

    A series' known bins are equally spaced: the bin below is found by
    arithmetic and joined as an equality; beyond the last bin its value holds.
    """
    top = psd.groupBy(*keys).agg(F.max("k").alias("_top"), F.max("freq").alias("_last"))
    grid = top.withColumn("k_out", F.explode(F.expr(f"sequence(0L, {n // 2}L)"))).withColumn("freq", F.col("k_out") * (fs / n))
    place = F.least(F.col("freq") * F.col("_top") / F.col("_last"), F.col("_top").cast("double"))
    low = grid.withColumn("_at", place).withColumn("k", F.least(F.floor("_at"), F.col("_top") - 1))
    nxt = psd.select(*keys, (F.col("k") - 1).alias("k"), F.col("psd").alias("_next"))
    joined = low.join(psd.select(*keys, "k", F.col("psd").alias("_here")), [*keys, "k"]).join(nxt, [*keys, "k"])
    out = joined.select(*keys, F.col("k_out").alias("k"), "freq", (F.col("_here") + (F.col("_at") - F.col("k")) * (F.col("_next") - F.col("_here"))).alias("psd"))
    return scale_bands(out, bands or [])


def in_band(freq: Column, low_period: float, high_period: float) -> Column:
    """Both ends count."""
    return freq.between(1 / high_period, 1 / low_period)


def frequency_grid(lengths: DataFrame, keys: list[str], fs: float = 12.0) -> DataFrame:
    """(keys, n, k, freq): bins of records of ``n`` steps."""
    bins = lengths.select(*keys, F.col("n").cast("long").alias("n"), F.explode(F.expr("sequence(0L, cast(n as long) div 2)")).alias("k"))
    return bins.withColumn("freq", F.col("k") * (fs / F.col("n")))


def bandpass(grid: DataFrame, low_period: float, high_period: float) -> DataFrame:
    """The bins of a band."""
    return grid.where(in_band(F.col("freq"), low_period, high_period))


def scale_bands(psd: DataFrame, bands: list[tuple[float, float, float]]) -> DataFrame:
    factor = F.lit(1.0)
    for low, high, by in bands:
        factor = factor * F.when(in_band(F.col("freq"), low, high), by).otherwise(1.0)
    return psd.withColumn("psd", F.col("psd") * factor)


def amplitudes(psd: DataFrame, n: int, fs: float = 12.0) -> DataFrame:
    return psd.withColumn("amplitude", F.when(F.col("k") == 0, 0.0).otherwise(F.sqrt(F.col("psd") * (n * fs / 2))))


def band_variance(psd: DataFrame, keys: list[str], low_period: float, high_period: float) -> DataFrame:
    """Power in a band and its number of bins."""
    inside = in_band(F.col("freq"), low_period, high_period)
    step = F.max(F.when(F.col("k") == 1, F.col("freq")))
    return psd.groupBy(*keys).agg((F.sum(F.when(inside, F.col("psd")).otherwise(0.0)) * step).alias("variance"), F.sum(inside.cast("long")).alias("n_bins"))


def parseval(psd: DataFrame, series: DataFrame, keys: list[str]) -> DataFrame:
    """Share of the variance that the spectrum holds."""
    power = psd.groupBy(*keys).agg((F.sum("psd") * F.max(F.when(F.col("k") == 1, F.col("freq")))).alias("_p"))
    return power.join(series.groupBy(*keys).agg(F.var_pop("value").alias("_v")), keys).select(*keys, F.try_divide("_p", "_v").alias("share"))


def nearest(psd: DataFrame, keys: list[str], freq: float) -> DataFrame:
    """The bin next to a frequency; of two as near, the lower."""
    return psd.groupBy(*keys).agg(F.min_by(F.struct("k", "freq", "psd"), F.struct(F.abs(F.col("freq") - freq), F.col("k"))).alias("_b")).select(*keys, "_b.*")
