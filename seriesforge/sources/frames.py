"""Series and fields as long DataFrames, and what checks and prepares them.

A series is ``series_id, ts, t, month, value``; a field adds ``cell_id``, with
``cells(cell_id, rlat, rlon, lat, lon, area)`` beside it. Cells outside a basin
are absent rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_LENGTH = 12
# Names that files use for the variable, in order of preference.
VALUE_ALIASES = ("smbgl", "smb", "SMB", "smb_rec", "value")
MASS_UNITS = ("kg m-2", "kg m-2 yr-1")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def find_column(df: DataFrame, aliases: tuple[str, ...] = VALUE_ALIASES) -> str:
    """The first alias that the table has."""
    for name in aliases:
        if name in df.columns:
            return name
    raise ValueError(f"none of {aliases} in {df.columns}")


def convert_units(value: Column, units: Column) -> Column:
    """kg per square metre to metres of water; other units pass unchanged."""
    mass = F.lower(F.trim(units)).rlike(r"kg.*m(\^|\*\*)?-2")
    return F.when(mass, value / 1000.0).otherwise(value)


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def drop_constant_dimensions(df: DataFrame, dimensions: list[str]) -> DataFrame:
    """Drop dimension columns of one value; raise if one has more."""
    counts = df.agg(*(F.countDistinct(d).alias(d) for d in dimensions)).first()
    if wide := [d for d in dimensions if counts[d] > 1]:
        raise ValueError(f"not a single value in {wide}")
    return df.drop(*dimensions)


def series_checks(series: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Per series: rows, missing values, and whether it can be used."""
    missing = F.sum((F.col(value).isNull() | F.isnan(value)).cast("long"))
    out = series.groupBy(*keys).agg(F.count("*").alias("n"), missing.alias("n_missing"))
    return out.withColumn("usable", (F.col("n") >= MIN_LENGTH) & (F.col("n_missing") == 0))


def validate_series(series: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """The series unchanged; ValueError if one is short or has gaps."""
    bad = series_checks(series, keys, value).where(~F.col("usable")).limit(5).collect()
    if bad:
        raise ValueError(f"series that can't be used: {bad}")
    return series


def summarize(series: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    return series.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), F.max(F.col(value).isNull()).alias("has_null")
    )


def calendar_spine(sums: DataFrame, keys: list[str], ts: str = "ts", fill: float = 0.0) -> DataFrame:
    """Every key at every month between the first and the last of the table."""
    bounds = sums.agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    months = bounds.select("_lo", F.explode(F.expr("sequence(_lo, _hi, interval 1 month)")).alias(ts))
    spine = sums.select(*keys).distinct().crossJoin(F.broadcast(months))  # keys x months: the result's own size
    joined = spine.join(sums, [*keys, ts], "left")
    t = (F.year(ts) - F.year("_lo")) * 12 + F.month(ts) - F.month("_lo")
    return joined.select(*keys, ts, t.alias("t"), F.month(ts).alias("month"), F.coalesce("value", F.lit(fill)).alias("value"))


def _nation_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c_nationkey, ts, p): order totals of each nation and month.

    Customers are dealt out by their key: sent whole to every task, they would
    grow its memory with the table.
    """
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.trunc("o_orderdate", "month").alias("ts"), F.col("o_totalprice").cast("decimal(18,2)").alias("p"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").hint("shuffle_hash")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", "ts").agg(F.sum("p").alias("p"))


def region_month_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly order totals, in thousands, of each region."""
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    sums = _nation_months(spark, sf_dir).join(nations, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("r_name").alias("series_id"), "ts").agg((F.sum("p").cast("double") / 1000.0).alias("value"))
    return calendar_spine(sums, ["series_id"])


def nation_month_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly order totals, in thousands, of each nation: a field of 25 cells."""
    sums = _nation_months(spark, sf_dir).select(F.col("c_nationkey").alias("cell_id"), "ts", (F.col("p").cast("double") / 1000.0).alias("value"))
    return calendar_spine(sums, ["cell_id"])


def nation_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 5 x 5 grid of the nations, longitudes from 0 to 360."""
    key = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        key.alias("cell_id"),
        F.expr("n_nationkey div 5").cast("int").alias("rlat"),
        (key % 5).alias("rlon"),
        (F.lit(-80.0) + F.expr("n_nationkey div 5") * F.lit(2.5)).alias("lat"),
        (F.lit(168.0) + (key % 5) * F.lit(6.0)).alias("lon"),
        (F.lit(100.0) + (key % 7) * F.lit(10.0)).alias("area"),
        F.col("n_name").alias("name"),
        F.col("n_regionkey").alias("region_key"),
    )


def wrap_longitude(lon: Column) -> Column:
    return F.when(lon > 180, lon - 360).otherwise(lon)


def mesh_grid(lat: DataFrame, lon: DataFrame) -> DataFrame:
    """Axis tables (rlat, lat) and (rlon, lon) to one row per cell."""
    return lat.crossJoin(F.broadcast(lon)).withColumn("lon", wrap_longitude(F.col("lon")))


def clean_name(name: Column) -> Column:
    """Trimmed, blanks to underscores, slashes to hyphens; empty is null."""
    text = F.translate(F.trim(name), " /\\", "_--")
    return F.when(text != "", text)


def mask_cells(field: DataFrame, cells: DataFrame) -> DataFrame:
    """Rows of cells that the basin holds."""
    return field.join(F.broadcast(cells.select("cell_id").distinct()) if cells.limit(200_001).count() <= 200_000 else cells.select("cell_id").distinct(), "cell_id", "left_semi")


def mean_over_basin(field: DataFrame, cells: DataFrame) -> DataFrame:
    """(t, value): plain mean over the basin's cells, or over all cells where the basin holds none."""
    basin = cells.select("cell_id").distinct()
    size = basin.agg(F.count("*").alias("_n"))  # one row
    marked = field.join(basin.withColumn("_in", F.lit(True)), "cell_id", "left").crossJoin(F.broadcast(size))
    return marked.where(F.col("_in") | (F.col("_n") == 0)).groupBy("t").agg(F.avg("value").alias("value"))


def crop_to_cells(cells: DataFrame, basin: DataFrame, pad: int = 2) -> DataFrame:
    """Cells in the bounding box of the basin's cells, widened by ``pad``."""
    box = basin.agg(F.min("rlat").alias("a"), F.max("rlat").alias("b"), F.min("rlon").alias("c"), F.max("rlon").alias("d"))
    inside = F.col("rlat").between(F.col("a") - pad, F.col("b") + pad) & F.col("rlon").between(F.col("c") - pad, F.col("d") + pad)
    return cells.crossJoin(F.broadcast(box)).where(inside).drop("a", "b", "c", "d")


def valid_cells(field: DataFrame, n_time: int) -> DataFrame:
    """Cells with a finite value at every time."""
    finite = F.col("value").isNotNull() & ~F.isnan("value")
    return field.groupBy("cell_id").agg(F.sum(finite.cast("long")).alias("n")).where(F.col("n") == n_time).select("cell_id")


def coarsen(cells: DataFrame, n: int, rows: int, columns: int) -> DataFrame:
    """Complete n x n blocks: mean value and position, summed area."""
    block = cells.where((F.col("rlat") < rows // n * n) & (F.col("rlon") < columns // n * n)).groupBy(F.expr(f"rlat div {n}").cast("int").alias("rlat"), F.expr(f"rlon div {n}").cast("int").alias("rlon"), *(["t"] if "t" in cells.columns else []))
    return block.agg(F.avg("value").alias("value"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.sum("area").alias("area"))


def points_in_polygons(cells: DataFrame, polygons: DataFrame) -> DataFrame:
    """(cell_id, basin) of cell centres inside a polygon; polygons of a basin are united.

    ``polygons``: basin, ring_id, seq, x, y with closed rings, and a column
    polygon_id where polygons have several rings (else each ring is one). A ray
    to the east crosses the edges of a polygon's rings an odd number of times
    from inside, so a ring within another is a hole. The join is on
    the edge's latitude range: whole degrees first, as an equality.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("basin", "polygon_id", "ring_id").orderBy("seq")
    polygons = polygons if "polygon_id" in polygons.columns else polygons.withColumn("polygon_id", F.col("ring_id"))
    edges = polygons.select("basin", "polygon_id", F.col("x").alias("x1"), F.col("y").alias("y1"), F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2")).where("y2 is not null and y1 != y2")
    low, high = F.floor(F.least("y1", "y2")), F.floor(F.greatest("y1", "y2"))
    by_degree = edges.withColumn("deg", F.explode(F.sequence(low, high)))
    points = cells.select("cell_id", F.col("lon").alias("px"), F.col("lat").alias("py"), F.floor("lat").alias("deg"))
    crosses = ((F.col("y1") > F.col("py")) != (F.col("y2") > F.col("py"))) & (F.col("px") < (F.col("x2") - F.col("x1")) * (F.col("py") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1"))
    hits = points.join(by_degree, "deg").where(crosses).groupBy("cell_id", "basin", "polygon_id").agg(F.count("*").alias("n"))
    return hits.where("n % 2 = 1").select("cell_id", "basin").distinct()


def basin_means(field: DataFrame, cells: DataFrame, cell_basin: DataFrame) -> DataFrame:
    """Area-weighted mean per basin and time; plain where a cell has no area."""
    joined = field.join(cells.select("cell_id", "area"), "cell_id").join(cell_basin, "cell_id")
    weighted = F.try_divide(F.sum(F.col("value") * F.col("area")), F.sum(F.when(F.col("value").isNotNull(), F.col("area"))))
    return joined.groupBy("basin", "t").agg(F.coalesce(weighted, F.avg("value")).alias("value"), F.countDistinct("cell_id").alias("n_cells"))


def sample_cells(cells: DataFrame, most: int = 500, seed: int = 0) -> DataFrame:
    """At most ``most`` cells without replacement, the same ones for a seed in any order of rows."""
    return cells.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("cell_id").cast("string"))), "cell_id").limit(most)


def split_by_membership(df: DataFrame, column: str, targets: list[str]) -> DataFrame:
    """All rows, with ``is_target``: whether they belong to the named ones or to the background."""
    return df.withColumn("is_target", F.coalesce(F.col(column).isin(targets), F.lit(False)))


def write_ensemble(ensemble: DataFrame, path: str, experiments: DataFrame | None = None) -> None:
    """Ensembles by experiment, so that one of them is read without the others."""
    ensemble.write.mode("overwrite").partitionBy("experiment").parquet(f"{path}/ensemble")
    if experiments is not None:
        experiments.write.mode("overwrite").parquet(f"{path}/experiments")


def read_ensemble(spark: SparkSession, path: str, experiment: str | None = None) -> DataFrame:
    out = spark.read.parquet(f"{path}/ensemble")
    return out.where(F.col("experiment") == experiment) if experiment else out


def write_basins(means: DataFrame, path: str) -> None:
    means.write.mode("overwrite").partitionBy("basin").parquet(path)


def write_table_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
