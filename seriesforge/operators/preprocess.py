"""Trend and seasonal cycle: fitted as small tables, applied by joins.

``keys`` name a series: a basin, a grid cell or a principal component. Three
variants of the fit are explicit options: the trend on the calendar's day
number or on the step number, the seasonal mean by calendar month or by
position, and that mean with or without its own mean.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesforge.operators import blocks

DAY = "day"
STEP = "step"


def axis(kind: str) -> Column:
    """Time axis of the trend."""
    if kind == DAY:
        return F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")).cast("double")
    return F.col("t").cast("double")


@dataclass(frozen=True)
class Decomposition:
    """Fitted tables: mean (keys, mean), trend (keys, slope, intercept), season (keys, phase, season)."""

    keys: list[str]
    mean: DataFrame
    trend: DataFrame
    season: DataFrame
    axis: str = DAY
    positional: bool = False
    centre: bool = False

    @property
    def phase(self) -> Column:
        return F.expr("t % 12").cast("int") if self.positional else F.col("month").cast("int")


def fit_trend(series: DataFrame, keys: list[str], kind: str = DAY) -> DataFrame:
    """Least-squares line of each series."""
    x = series.withColumn("_x", axis(kind))
    return x.groupBy(*keys).agg(F.regr_slope("value", "_x").alias("slope"), F.regr_intercept("value", "_x").alias("intercept"))


def fit_polynomial(series: DataFrame, keys: list[str], degree: int) -> DataFrame:
    """(keys, coefficients): least squares on t, highest power first; null for fewer different steps than coefficients.

    The moments of Chebyshev polynomials on each series' span are aggregates, and
    well conditioned; a row for each series is solved.
    """
    known = series.where("value is not null and not isnan(value)").select(*keys, F.col("t").cast("double").alias("_t"), "value")
    span = known.groupBy(*keys).agg(((F.max("_t") + F.min("_t")) / 2).alias("_mid"), F.greatest((F.max("_t") - F.min("_t")) / 2, F.lit(1e-300)).alias("_half"), F.countDistinct("_t").alias("_steps"))
    z = (F.col("_t") - F.col("_mid")) / F.col("_half")
    work = known.join(span, keys).withColumn("_p0", F.lit(1.0)).withColumn("_p1", z)
    for i in range(2, degree + 1):
        work = work.withColumn(f"_p{i}", 2 * F.col("_p1") * F.col(f"_p{i - 1}") - F.col(f"_p{i - 2}"))
    basis = [f"_p{i}" for i in range(degree + 1)]
    sums = [F.sum(F.col(a) * F.col(b)) for i, a in enumerate(basis) for b in [*basis[i:], "value"]]
    moments = work.groupBy(*keys, "_mid", "_half", "_steps").agg(F.array(*sums).alias("_sums"))
    schema = ", ".join([*(f"`{k}` {series.schema[k].dataType.simpleString()}" for k in keys), "coefficients array<double>"])

    def solve(batches):
        for pdf in batches:
            found = []
            for mid, half, steps, sums in zip(pdf["_mid"], pdf["_half"], pdf["_steps"], pdf["_sums"]):
                m, y, place = np.zeros((degree + 1, degree + 1)), np.zeros(degree + 1), 0
                for i in range(degree + 1):
                    m[i, i:] = m[i:, i] = sums[place : place + degree + 1 - i]
                    y[i] = sums[place + degree + 1 - i]
                    place += degree + 2 - i
                if steps <= degree:
                    found.append(None)
                    continue
                powers = np.polynomial.Chebyshev(np.linalg.solve(m, y), domain=[mid - half, mid + half]).convert(kind=np.polynomial.Polynomial, domain=[-1, 1], window=[-1, 1])
                found.append(np.pad(powers.coef, (0, degree + 1 - len(powers.coef)))[::-1].tolist())
            yield pdf[keys].assign(coefficients=found)

    return moments.select(*keys, "_mid", "_half", "_steps", "_sums").mapInPandas(solve, schema)


def detrend(series: DataFrame, trend: DataFrame, keys: list[str], kind: str = DAY) -> DataFrame:
    line = F.col("slope") * axis(kind) + F.col("intercept")
    return series.join(trend, keys).withColumn("trend", line).withColumn("value", F.col("value") - F.col("trend")).drop("slope", "intercept")


def climatology(series: DataFrame, keys: list[str], phase: Column) -> DataFrame:
    return series.groupBy(*keys, phase.alias("phase")).agg(F.avg("value").alias("season"))


def fit(series: DataFrame, keys: list[str], kind: str = DAY, remove_trend: bool = True, remove_season: bool = True, centre: bool = False, positional: bool = False, recentre_season: bool = False) -> Decomposition:
    """Mean, line and cycle; the cycle is that of the detrended series."""
    mean = series.groupBy(*keys).agg(F.avg("value").alias("mean"))
    work = series.join(mean, keys).withColumn("value", F.col("value") - F.col("mean")).drop("mean") if centre else series
    trend = fit_trend(work, keys, kind)
    if not remove_trend:
        trend = trend.select(*keys, F.lit(0.0).alias("slope"), F.lit(0.0).alias("intercept"))
    model = Decomposition(keys, mean, trend, mean, kind, positional, centre)
    season = climatology(detrend(work, trend, keys, kind), keys, model.phase)
    if not remove_season:
        season = season.withColumn("season", F.lit(0.0))
    elif recentre_season:
        middle = season.groupBy(*keys).agg(F.avg("season").alias("_m"))
        season = season.join(middle, keys).select(*keys, "phase", (F.col("season") - F.col("_m")).alias("season"))
    return Decomposition(keys, mean, trend, season, kind, positional, centre)


def transform(series: DataFrame, model: Decomposition) -> DataFrame:
    """Residuals, also of another stretch of time than the one fitted.

    A month that the fitted stretch lacks has no seasonal value to remove.
    """
    keys = model.keys
    if model.centre:
        series = series.join(model.mean, keys).withColumn("value", F.col("value") - F.col("mean")).drop("mean")
    flat = detrend(series, model.trend, keys, model.axis).withColumn("phase", model.phase)
    return flat.join(model.season, [*keys, "phase"], "left").withColumn("value", F.col("value") - F.coalesce("season", F.lit(0.0))).drop("phase", "season", "trend")


def inverse_transform(residuals: DataFrame, model: Decomposition, add_trend: bool = False, season_scale: float | Column = 1.0, add_mean: bool = False) -> DataFrame:
    """Seasonal cycle back, scaled; trend and mean only on request."""
    keys = model.keys
    scale = season_scale if isinstance(season_scale, Column) else F.lit(float(season_scale))
    out = residuals.withColumn("phase", model.phase).join(model.season, [*keys, "phase"], "left").withColumn("value", F.col("value") + scale * F.coalesce("season", F.lit(0.0))).drop("phase", "season")
    if add_trend:
        out = out.join(model.trend, keys).withColumn("value", F.col("value") + F.col("slope") * axis(model.axis) + F.col("intercept")).drop("slope", "intercept")
    if add_mean:
        out = out.join(model.mean, keys).withColumn("value", F.col("value") + F.col("mean")).drop("mean")
    return out


def summarize(model: Decomposition, series: DataFrame) -> DataFrame:
    """One row per series: steps, line, and range of the seasonal cycle."""
    season = model.season.groupBy(*model.keys).agg(F.min("season").alias("season_low"), F.max("season").alias("season_high"))
    out = series.groupBy(*model.keys).agg(F.count("*").alias("n_obs")).join(model.trend, model.keys).join(season, model.keys)
    return out.withColumn("season_range", F.col("season_high") - F.col("season_low"))


def fill_gaps(series: DataFrame, keys: list[str]) -> DataFrame:
    """Missing values on the line between their neighbours; ends take the nearest."""
    from pyspark.sql import Window

    back = Window.partitionBy(*keys).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    on = Window.partitionBy(*keys).orderBy("t").rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col("value").isNotNull() & ~F.isnan("value"), F.struct("t", "value"))
    s = series.withColumn("_a", F.last(known, True).over(back)).withColumn("_b", F.first(known, True).over(on))
    share = (F.col("t") - F.col("_a.t")) / (F.col("_b.t") - F.col("_a.t"))
    line = F.col("_a.value") + share * (F.col("_b.value") - F.col("_a.value"))
    filled = F.when(F.col("_a.t") == F.col("_b.t"), F.col("_a.value")).otherwise(F.coalesce(line, F.col("_a.value"), F.col("_b.value")))
    return series.select("*").join(s.select(*keys, "t", filled.alias("_f")), [*keys, "t"]).withColumn("value", F.col("_f")).drop("_f")


def stationarity(series: DataFrame, keys: list[str], level: float = 0.05) -> DataFrame:
    """Augmented Dickey-Fuller per series, from moments summed over blocks of it."""
    return blocks.adf(series, keys, level)
