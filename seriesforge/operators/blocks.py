"""Long records cut into blocks that several tasks work on.

A row goes to its own block and, near a block's end, to the neighbour that needs
it too (the halo). What tasks give for their blocks are partial sums, which
Spark adds. So no series has to fit a task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesforge.functions import kernels

BLOCK = 1 << 16  # steps


def types_of(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def with_keys(group: pd.DataFrame, keys: list[str], rows: pd.DataFrame) -> pd.DataFrame:
    """The rows with the group's keys in front, of the group's types even where there are no rows."""
    return pd.concat([group[keys].iloc[np.zeros(len(rows), int)].reset_index(drop=True), rows.reset_index(drop=True)], axis=1)


def positions(series: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """(keys, value, pos, n, mean): place of each value in its series by t, from 0, and the series' length and mean.

    Rows without a value are left out. Values are numbered within stretches of
    ``block`` steps and the stretches' counts are added up, so no window holds a
    whole series.
    """
    rows = series.where("value is not null").select(*keys, "t", "value", F.floor(F.col("t") / block).alias("_stretch"))
    counts = rows.groupBy(*keys, "_stretch").agg(F.count("*").alias("_c"), F.sum("value").alias("_s"))
    every = Window.partitionBy(*keys)  # a row for each stretch
    before = every.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "_stretch", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"), F.sum("_c").over(every).alias("n"), (F.sum("_s").over(every) / F.sum("_c").over(every)).alias("mean"))
    number = F.row_number().over(Window.partitionBy(*keys, "_stretch").orderBy("t", "value")) - 1
    return rows.join(starts, [*keys, "_stretch"]).select(*keys, "value", (F.col("_start") + number).alias("pos"), "n", "mean")


def with_halo(rows: DataFrame, at: Column, block: int, ahead: int | Column = 0, behind: int | Column = 0) -> DataFrame:
    """Adds ``block``: a row's own, and those whose end it follows by less than ``ahead`` or whose start it precedes by ``behind`` at most.

    Neither reaches further than one block.
    """
    own = F.floor(at / block)
    inside = at - own * block
    ahead, behind = (x if isinstance(x, Column) else F.lit(x) for x in (ahead, behind))
    places = F.array(own, F.when(inside < ahead, own - 1), F.when(inside >= block - behind, own + 1))
    return rows.withColumn("block", F.explode(F.array_compact(places)))


def welch(series: DataFrame, keys: list[str], nperseg: int = 60, fs: float = 12.0, block: int = BLOCK) -> DataFrame:
    """Averaged periodic-Hann spectra (keys, k, freq, psd, n_segments) of records of any length.

    A task transforms the segments that start in its block; their sums are added
    up. As for whole records, one shorter than ``nperseg`` is one segment.
    """
    hop = nperseg - nperseg // 2
    many = max(1, block // hop)  # segments of a block
    rows = with_halo(positions(series, keys, block), F.col("pos"), many * hop, ahead=nperseg - hop)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        n, first = int(pdf["n"].iloc[0]), int(pdf["block"].iloc[0]) * many
        length = min(nperseg, n)
        count = min(many, 1 + (n - length) // hop - first)
        if count < 1 or first < 0:
            return with_keys(pdf, keys, pd.DataFrame({"k": np.zeros(0, int), "freq": np.zeros(0), "total": np.zeros(0), "m": np.zeros(0, int)}))
        x = pdf["value"].to_numpy(float)[: (count - 1) * hop + length]
        power = kernels.segment_powers(x, fs, length, hop)
        f = np.fft.rfftfreq(length, 1 / fs)
        return with_keys(pdf, keys, pd.DataFrame({"k": np.arange(len(f)), "freq": f, "total": power.sum(axis=0), "m": len(power)}))

    parts = rows.groupBy(*keys, "block").applyInPandas(run, f"{types_of(series, keys)}, k long, freq double, total double, m long")
    return parts.groupBy(*keys, "k").agg(F.max("freq").alias("freq"), (F.sum("total") / F.sum("m")).alias("psd"), F.sum("m").alias("n_segments"))


def autocorrelation(series: DataFrame, keys: list[str], lags: int, block: int = BLOCK) -> DataFrame:
    """Biased: lagged products over all squares, for the lags from 0 that have a pair of values.

    By padded transforms of blocks with a halo of ``lags`` steps; steps without
    a value add nothing.
    """
    block = max(block, 2 * lags + 2)
    means = series.groupBy(*keys).agg(F.avg("value").alias("_mean"))
    x = series.where("value is not null").join(means, keys).select(*keys, F.col("t").cast("long").alias("t"), (F.col("value") - F.col("_mean")).alias("x"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        start = int(pdf["block"].iloc[0]) * block
        at, value = pdf["t"].to_numpy() - start, pdf["x"].to_numpy(float)
        own = at < block
        if not own.any():
            return with_keys(pdf, keys, pd.DataFrame({"lag": np.zeros(0, int), "s": np.zeros(0)}))
        size = int(at.max()) + 1
        reach = min(lags, size - 1)
        m = 1 << (2 * size - 1).bit_length()

        def lagged(weights: np.ndarray) -> np.ndarray:
            every, mine = np.zeros(size), np.zeros(size)
            np.add.at(every, at, weights)
            np.add.at(mine, at[own], weights[own])
            return np.fft.irfft(np.conj(np.fft.rfft(mine, m)) * np.fft.rfft(every, m), m)[: reach + 1]

        met = np.rint(lagged(np.ones(len(at)))) > 0
        return with_keys(pdf, keys, pd.DataFrame({"lag": np.flatnonzero(met), "s": lagged(value)[met]}))

    parts = with_halo(x, F.col("t"), block, ahead=lags).groupBy(*keys, "block").applyInPandas(run, f"{types_of(series, keys)}, lag int, s double")
    sums = parts.groupBy(*keys, "lag").agg(F.sum("s").alias("s"))
    return sums.join(sums.where("lag = 0").select(*keys, F.col("s").alias("_all")), keys).select(*keys, "lag", F.try_divide("s", "_all").alias("acf"))


# --- Augmented Dickey-Fuller


HEAD = 1 << 30  # places from here on hold the first values of a series


def most_lags(n: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.ceil(12.0 * F.pow(n / 100.0, F.lit(0.25))), F.floor(n / 2) - 2)).cast("int")


def lagged_moments(series: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """(keys, n, most, place, value): sums of products of a step's regression row, as ``a * size + b`` with a <= b.

    The row is 1, the last ``most`` differences (nearest first), the level before
    the step (less the series' mean), the step's difference. The first values
    follow at ``HEAD``: regressions on fewer lags use their steps, too.
    """
    rows = positions(series, keys, block).withColumn("most", most_lags(F.col("n")))
    rows = with_halo(rows, F.col("pos"), block, behind=F.col("most") + 1)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        n, most, start = int(pdf["n"].iloc[0]), int(pdf["most"].iloc[0]), int(pdf["block"].iloc[0]) * block
        pos, x = pdf["pos"].to_numpy(), pdf["value"].to_numpy(float) - pdf["mean"].to_numpy(float)
        size = most + 3
        steps = np.arange(max(start, most + 1), min(start + block, n)) - int(pos[0])
        a, b = np.triu_indices(size)
        place, value = a * size + b, np.zeros(len(a))
        if len(steps) and pos[-1] >= start:
            dx = np.append(0.0, np.diff(x))
            table = np.stack([np.ones(len(steps)), *(dx[steps - j] for j in range(1, most + 1)), x[steps - 1], dx[steps]], axis=1)
            value = (table.T @ table)[a, b]
        if start == 0:
            head = x[: most + 1]
            place, value = np.append(place, HEAD + np.arange(len(head))), np.append(value, head)
        return with_keys(pdf, keys, pd.DataFrame({"n": n, "most": most, "place": place, "value": value}))

    parts = rows.groupBy(*keys, "block").applyInPandas(run, f"{types_of(series, keys)}, n long, most int, place long, value double")
    return parts.groupBy(*keys, "n", "most", "place").agg(F.sum("value").alias("value"))


def _after(moments: np.ndarray, pivots: int) -> np.ndarray:
    """The moments that are left when the first variables are regressed out of the others."""
    m = moments.copy()
    for i in range(pivots):
        if m[i, i] > 0:
            m[i + 1 :, i + 1 :] -= np.outer(m[i + 1 :, i], m[i, i + 1 :]) / m[i, i]
    return m[-2:, -2:]


def _left_over(m: np.ndarray) -> float:
    return float(m[1, 1] - (m[0, 1] ** 2 / m[0, 0] if m[0, 0] > 0 else 0.0))


def adf(series: DataFrame, keys: list[str], level: float = 0.05, block: int = BLOCK) -> DataFrame:
    """Augmented Dickey-Fuller with constant: statistic, p_value, lags (by AIC) and stationary.

    Tasks sum the products of regression rows of their blocks. One matrix per
    series serves all lags: regressing out one difference after the other gives
    the nested fits. A series without variance or of fewer than six values has
    no statistic.
    """

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        n, most = int(pdf["n"].iloc[0]), int(pdf["most"].iloc[0])
        size = most + 3
        place, value = pdf["place"].to_numpy(), pdf["value"].to_numpy(float)
        m, at = np.zeros((size, size)), place < HEAD
        m[place[at] // size, place[at] % size] = value[at]
        m = np.triu(m) + np.triu(m, 1).T
        head = np.zeros(most + 1)
        head[place[~at] - HEAD] = value[~at]
        steps, best, lag = n - 1 - most, math.inf, 0
        for p in range(most + 1):
            kept = [*range(p + 1), size - 2, size - 1]
            score = steps * math.log(max(_left_over(_after(m[np.ix_(kept, kept)], p + 1)), 1e-300) / max(steps, 1)) + 2 * (p + 2)
            if score < best:
                best, lag = score, p
        kept = [*range(lag + 1), size - 2, size - 1]
        m = m[np.ix_(kept, kept)]
        for i in range(lag + 1, min(most + 1, n)):  # steps that have this many lags, but not ``most``
            row = np.array([1.0, *(head[i - j] - head[i - j - 1] for j in range(1, lag + 1)), head[i - 1], head[i] - head[i - 1]])
            m += np.outer(row, row)
        rest = _after(m, lag + 1)
        statistic = p_value = None
        if n >= 6 and rest[0, 0] > 1e-12 * m[-2, -2] and rest[0, 0] > 0:
            sigma2 = max(_left_over(rest), 0.0) / max(1, n - 1 - lag - (lag + 2))
            if sigma2 > 0:
                statistic = float(rest[0, 1] / rest[0, 0] / math.sqrt(sigma2 / rest[0, 0]))
                p_value = kernels.adf_p_value(statistic)
        out = pd.DataFrame({"statistic": [statistic], "p_value": [p_value], "lags": [lag], "stationary": [p_value is not None and p_value < level]}).astype({"statistic": "float64", "p_value": "float64"})
        return with_keys(pdf, keys, out)

    found = lagged_moments(series, keys, block).groupBy(*keys).applyInPandas(test, f"{types_of(series, keys)}, statistic double, p_value double, lags int, stationary boolean")
    return found.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("statistic", "p_value")})
