"""Rank-based Gaussian transform and its semi-parametric inverse."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesforge.functions.normal import norm_cdf, norm_ppf

CLIP = 1e-15


@dataclass(frozen=True)
class QuantileModel:
    """knots(keys, i, p, x, x_next) and tail(keys, n, loc, scale, low_offset, high_offset)."""

    keys: list[str]
    knots: DataFrame
    tail: DataFrame


def hazen(series: DataFrame, keys: list[str]) -> DataFrame:
    """Rank (ties by time) and plotting position (rank - 1/2) / n."""
    order, every = Window.partitionBy(*keys).orderBy("value", "t"), Window.partitionBy(*keys)
    return series.withColumn("rank", F.row_number().over(order).cast("long")).withColumn("n", F.count("*").over(every)).withColumn("p", (F.col("rank") - 0.5) / F.col("n"))


def gaussianize(series: DataFrame, keys: list[str]) -> DataFrame:
    """Each series to standard normal scores of its own ranks."""
    return hazen(series, keys).withColumn("g", norm_ppf("p"))


def fit_quantiles(series: DataFrame, keys: list[str], least: int = 10) -> QuantileModel:
    """Empirical knots, and a normal tail shifted to meet the first and last knot.

    A series of fewer than ``least`` values is an error, which the job raises.
    """
    enough = F.when(F.col("n") >= least, F.col("n")).otherwise(F.raise_error(F.lit(f"a series has fewer than {least} values")).cast("long"))
    ranked = hazen(series.select(*keys, "t", "value"), keys).withColumn("n", enough)
    knots = ranked.select(*keys, F.col("rank").alias("i"), "n", "p", F.col("value").alias("x")).withColumn("x_next", F.lead("x").over(Window.partitionBy(*keys).orderBy("i")))
    moments = ranked.groupBy(*keys).agg(F.max("n").alias("n"), F.avg("value").alias("loc"), F.stddev_pop("value").alias("scale"), F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    ends = moments.withColumn("_p1", 0.5 / F.col("n")).withColumn("_pn", (F.col("n") - 0.5) / F.col("n"))
    tail = ends.withColumn("low_offset", F.col("_lo") - (F.col("loc") + F.col("scale") * norm_ppf("_p1"))).withColumn("high_offset", F.col("_hi") - (F.col("loc") + F.col("scale") * norm_ppf("_pn")))
    return QuantileModel(keys, knots.drop("n"), tail.select(*keys, "n", "loc", "scale", "low_offset", "high_offset"))


def inverse_gaussianize(scores: DataFrame, model: QuantileModel, recentre_by: list[str] | None = None) -> DataFrame:
    """Normal scores ``g`` back to values.

    Knots stand at (i - 1/2) / n, so the knot below u is found by arithmetic
    and joined as an equality; beyond the ends the shifted normal tail applies.
    With ``recentre_by`` the mean of each group of outputs is taken off.
    """
    keys = model.keys
    u = scores.withColumn("u", norm_cdf("g")).withColumn("u", F.least(F.greatest("u", F.lit(CLIP)), F.lit(1 - CLIP)))
    at = u.join(model.tail, keys).withColumn("_place", F.col("u") * F.col("n") + 0.5).withColumn("i", F.least(F.greatest(F.floor("_place"), F.lit(1)), F.col("n")))
    joined = at.join(model.knots.select(*keys, "i", "x", "x_next"), [*keys, "i"])
    normal = F.col("loc") + F.col("scale") * norm_ppf("u")
    inner = F.col("x") + (F.col("_place") - F.col("i")) * (F.coalesce("x_next", "x") - F.col("x"))
    value = F.when(F.col("_place") < 1, normal + F.col("low_offset")).when(F.col("_place") > F.col("n"), normal + F.col("high_offset")).otherwise(inner)
    out = joined.withColumn("value", value).drop("u", "n", "loc", "scale", "low_offset", "high_offset", "_place", "i", "x", "x_next")
    if recentre_by:
        out = out.withColumn("value", F.col("value") - F.avg("value").over(Window.partitionBy(*recentre_by)))
    return out


def empirical_inverse(scores: DataFrame, model: QuantileModel) -> DataFrame:
    """As above without tails: values stay between the least and the greatest knot."""
    keys = model.keys
    at = scores.withColumn("u", norm_cdf("g")).join(model.tail.select(*keys, "n"), keys).withColumn("_place", F.least(F.greatest(F.col("u") * F.col("n") + 0.5, F.lit(1.0)), F.col("n").cast("double"))).withColumn("i", F.floor("_place"))
    joined = at.join(model.knots.select(*keys, "i", "x", "x_next"), [*keys, "i"])
    return joined.withColumn("value", F.col("x") + (F.col("_place") - F.col("i")) * (F.coalesce("x_next", "x") - F.col("x"))).drop("u", "n", "_place", "i", "x", "x_next")


def ks_normal(series: DataFrame, keys: list[str], column: str = "g") -> DataFrame:
    """Kolmogorov-Smirnov distance to the standard normal, and its asymptotic p."""
    ranked = hazen(series.withColumn("value", F.col(column)), keys).withColumn("_f", norm_cdf("value"))
    d = F.max(F.greatest(F.abs(F.col("rank") / F.col("n") - F.col("_f")), F.abs((F.col("rank") - 1) / F.col("n") - F.col("_f"))))
    return ranked.groupBy(*keys).agg(F.max("n").alias("n"), d.alias("d")).withColumn("p_value", kolmogorov_p(F.sqrt("n") * F.col("d")))


def kolmogorov_p(z):
    terms = sum((F.lit(2.0 * (-1) ** (k - 1)) * F.exp(F.lit(-2.0 * k * k) * z * z) for k in range(1, 40)), F.lit(0.0))
    return F.when(z < 0.2, 1.0).otherwise(F.least(F.greatest(terms, F.lit(0.0)), F.lit(1.0)))


def ks_two_sample(both: DataFrame, keys: list[str], flag: str = "second") -> DataFrame:
    """Distance of two samples told apart by a 0/1 column, exact with ties."""
    counts = both.groupBy(*keys, "value").agg(F.sum(1 - F.col(flag)).alias("_a"), F.sum(flag).alias("_b"))
    run, every = Window.partitionBy(*keys).orderBy("value"), Window.partitionBy(*keys)
    steps = counts.withColumn("_fa", F.sum("_a").over(run) / F.sum("_a").over(every)).withColumn("_fb", F.sum("_b").over(run) / F.sum("_b").over(every))
    return steps.groupBy(*keys).agg(F.max(F.abs(F.col("_fa") - F.col("_fb"))).alias("d"), F.sum("_a").alias("n_first"), F.sum("_b").alias("n_second"))


def validate_transform(series: DataFrame, keys: list[str]) -> DataFrame:
    """Normality, round trip, moments and tail continuity of the fitted transform."""
    model = fit_quantiles(series, keys)
    g = gaussianize(series, keys).select(*keys, "t", F.col("value").alias("original"), "g")
    back = inverse_gaussianize(g, model)
    trip = back.groupBy(*keys).agg(F.max(F.abs(F.col("value") - F.col("original"))).alias("round_trip"), F.avg("g").alias("g_mean"), F.stddev_pop("g").alias("g_std"))
    ends = model.tail.withColumn("_p1", 0.5 / F.col("n")).withColumn("splice", F.abs(F.col("loc") + F.col("scale") * norm_ppf("_p1") + F.col("low_offset")))
    lowest = model.knots.where("i = 1").select(*keys, F.abs("x").alias("_x"))
    gap = ends.join(lowest, keys).select(*keys, F.abs(F.col("splice") - F.col("_x")).alias("splice_gap"))
    out = ks_normal(g.withColumn("t", F.col("t")), keys).join(trip, keys).join(gap, keys)
    return out.withColumn("passed", (F.col("p_value") > 0.05) & (F.abs("g_mean") < 0.05) & (F.abs(F.col("g_std") - 1) < 0.05) & (F.col("splice_gap") < 1e-6))
