"""Aggregates and windows over series and ensembles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesforge.operators.blocks import autocorrelation as autocorrelation


def moments(series: DataFrame, keys: list[str]) -> DataFrame:
    """Population moments; kurtosis is the excess."""
    return series.groupBy(*keys).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.skewness("value").alias("skew"), F.kurtosis("value").alias("kurtosis"))


def annual(series: DataFrame, keys: list[str], how: str = "mean", calendar: bool = True, complete: bool = False) -> DataFrame:
    """By calendar year, or by twelve steps from the start; ``complete`` drops short years."""
    year = F.year("ts") if calendar else F.expr("t div 12").cast("int")
    total = F.avg("value") if how == "mean" else F.sum("value")
    out = series.groupBy(*keys, year.alias("year")).agg(total.alias("value"), F.count("*").alias("_n"))
    return (out.where("_n = 12") if complete else out).drop("_n")


def percentiles(df: DataFrame, keys: list[str], column: str, at: list[float]) -> DataFrame:
    """Exact percentiles on the line between order statistics."""
    return df.groupBy(*keys).agg(*(F.percentile(column, F.lit(p)).alias(f"p{round(p * 100)}") for p in at))


def refined_percentiles(df: DataFrame, keys: list[str], column: str, at: list[float], accuracy: int = 10_000) -> DataFrame:
    """(keys, p, value): exact percentiles as ``percentiles`` gives them, of groups that fit no task.

    A mergeable rank sketch brackets each percentile; a second pass counts what
    lies below the bracket and the few distinct values in it, and the order
    statistics are read from running counts. A group whose bracket should miss
    its percentile fails the job.
    """
    rows = df.where(F.col(column).isNotNull()).select(*keys, F.col(column).cast("double").alias("_v"))
    margin = 4.0 / accuracy
    ends = [min(1.0, max(0.0, p + d)) for p in at for d in (-margin, margin)]
    sketch = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), F.percentile_approx("_v", ends, accuracy).alias("_q"))
    few = F.col("_n") <= 2 * accuracy  # where a rank may be more than the margin
    low = lambda i, p: F.when(few | F.lit(p <= margin), F.col("_min")).otherwise(F.col("_q")[2 * i])
    high = lambda i, p: F.when(few | F.lit(p >= 1 - margin), F.col("_max")).otherwise(F.col("_q")[2 * i + 1])
    brackets = F.array(*(F.struct(F.lit(p).alias("p"), low(i, p).alias("low"), high(i, p).alias("high")) for i, p in enumerate(at)))
    sketch = sketch.select(*keys, "_n", brackets.alias("_brackets"))
    rows = rows.join(sketch, keys) if keys else rows.crossJoin(F.broadcast(sketch))  # one row
    placed = rows.select(*keys, "_n", "_v", F.explode(F.filter("_brackets", lambda b: F.col("_v") <= b["high"])).alias("_b"))
    counts = placed.groupBy(*keys, "_n", F.col("_b.p").alias("p"), F.when(F.col("_v") >= F.col("_b.low"), F.col("_v")).alias("_v")).agg(F.count("*").alias("_c"))
    run = Window.partitionBy(*keys, "p").orderBy(F.asc_nulls_first("_v"))  # the values of a bracket
    reached = counts.withColumn("_run", F.sum("_c").over(run))
    place = F.col("p") * (F.col("_n") - 1)
    found = lambda rank: F.min(F.when(F.col("_run") > rank, F.struct(F.col("_v").isNotNull().alias("inside"), F.col("_v").alias("v"))))
    out = reached.withColumn("_place", place).groupBy(*keys, "p").agg(F.max("_place").alias("_place"), found(F.floor("_place")).alias("_a"), found(F.ceil("_place")).alias("_b"))
    checked = F.when(F.col("_a.inside") & F.col("_b.inside"), F.col("_a.v") + (F.col("_place") - F.floor("_place")) * (F.col("_b.v") - F.col("_a.v"))).otherwise(F.raise_error(F.lit("a percentile outside of its bracket")).cast("double"))
    return out.select(*keys, "p", checked.alias("value"))


def percentile_of(df: DataFrame, keys: list[str], column: str, observed: Column, strict: bool = True) -> DataFrame:
    """Share, in per cent, of values under (or up to) an observed one."""
    under = F.col(column) < observed if strict else F.col(column) <= observed
    return df.groupBy(*keys).agg(F.avg(F.when(under, 100.0).otherwise(0.0)).alias("percentile"))


def density(df: DataFrame, keys: list[str], column: str, low: float, high: float, bins: int) -> DataFrame:
    """Density histogram on fixed edges; the last bin includes its right end."""
    width = (high - low) / bins
    place = F.when(F.col(column) == high, bins - 1).otherwise(F.floor((F.col(column) - low) / width)).cast("int")
    inside = df.where(F.col(column).between(low, high)).groupBy(*keys, place.alias("bin")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1)))
    return inside.withColumn("density", F.col("n") / (total * width))


def lag1(series: DataFrame, keys: list[str]) -> DataFrame:
    """AR(1) fit: clipped lag-one Pearson correlation, innovation spread and memory."""
    w = Window.partitionBy(*keys).orderBy("t")
    pairs = series.withColumn("_y", F.lead("value").over(w))
    raw = pairs.groupBy(*keys).agg(F.corr("value", "_y").alias("_r"), F.stddev_pop("value").alias("_s"))
    phi = F.least(F.greatest("_r", F.lit(-0.99)), F.lit(0.99))
    out = raw.withColumn("phi", phi).withColumn("sigma", F.col("_s") * F.sqrt(F.greatest(1 - F.col("phi") * F.col("phi"), F.lit(1e-12))))
    return out.withColumn("efold_months", F.when((F.col("phi") > 0) & (F.col("phi") < 1), -1 / F.log(F.abs("phi"))).otherwise(0.0)).drop("_r", "_s")


def return_periods(values: DataFrame, keys: list[str], weibull: bool = True) -> DataFrame:
    """Rank from the top; period (n + 1) / rank, or n / rank."""
    order, every = Window.partitionBy(*keys).orderBy(F.desc("value"), "year"), Window.partitionBy(*keys)
    ranked = values.withColumn("rank", F.row_number().over(order).cast("long")).withColumn("_n", F.count("*").over(every))
    return ranked.withColumn("return_period", (F.col("_n") + (1 if weibull else 0)) / F.col("rank")).drop("_n")


def rolling_std(values: DataFrame, keys: list[str], order: str, width: int, stride: int = 1) -> DataFrame:
    """Population spread of each full window that starts on a multiple of the stride."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(0, width - 1)
    out = values.withColumn("std", F.stddev_pop("value").over(w)).withColumn("_n", F.count("*").over(w)).withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)
    return out.where((F.col("_n") == width) & (F.col("_i") % stride == 0)).drop("_n", "_i", "value")


def window_stats(series: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Windows side by side: mean, spread and range of the positional month means."""
    at = F.expr(f"t div {width}").cast("int").alias("window")
    complete = series.groupBy(*keys, at).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("*").alias("_n")).where(F.col("_n") == width).drop("_n")
    by_month = series.groupBy(*keys, at, F.expr("t % 12").alias("_m")).agg(F.avg("value").alias("_v"))
    spread = by_month.groupBy(*keys, "window").agg((F.max("_v") - F.min("_v")).alias("seasonal_range"))
    return complete.join(spread, [*keys, "window"])


def overlapping_windows(values: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Windows of ``width`` years that start every quarter of it: mean, spread, range."""
    stride = max(1, width // 4)
    first, last = F.greatest(F.lit(0), F.ceil((F.col("_i") - width + 1) / stride)), F.floor(F.col("_i") / stride)
    placed = values.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy("year")) - 1).where(last >= first)
    each = placed.withColumn("window", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    out = each.groupBy(*keys, "window").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), (F.max("value") - F.min("value")).alias("range"), F.count("*").alias("_n"))
    return out.where(F.col("_n") == width).drop("_n")


def split_halves(series: DataFrame, keys: list[str]) -> DataFrame:
    """Position in time order under n // 2 is half 0, the rest half 1."""
    order, every = Window.partitionBy(*keys).orderBy("t"), Window.partitionBy(*keys)
    half = (F.row_number().over(order) - 1 >= F.floor(F.count("*").over(every) / 2)).cast("int")
    return series.withColumn("half", half)


def rms_difference(pairs: DataFrame, keys: list[str], a: Column, b: Column) -> DataFrame:
    return pairs.groupBy(*keys).agg(F.sqrt(F.avg((a - b) * (a - b))).alias("rms"))


def ratio_to_baseline(psd: DataFrame, keys: list[str], baseline: str) -> DataFrame:
    """Each experiment's spectrum over the baseline's, bin by bin."""
    base = psd.where(F.col("experiment") == baseline).select(*keys, "k", F.col("psd").alias("_b"))
    return psd.join(base, [*keys, "k"]).select("experiment", *keys, "k", "freq", F.try_divide("psd", "_b").alias("ratio"))
