"""Queries on loading, catalog, selection, aggregation and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesforge.operators import preprocess, stats
from seriesforge.plans.sql import FIELD, RESID, SERIES, with_
from seriesforge.sources import frames
from seriesforge.sources.catalog import Catalog, clean, first_per_name
from seriesforge.sources.frames import nation_cells, nation_month_field, region_month_series, table

K = ["series_id"]
QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df, digits: int = 4, **special: int):
    """Doubles rounded, so that the last bits of sums do not matter."""
    return df.select(*((F.round(c, special.get(c, digits)) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def residuals(spark, sf_dir):
    s = region_month_series(spark, sf_dir)
    return preprocess.transform(s, preprocess.fit(s, K)).select("series_id", "ts", "t", "month", "value")


@query(with_(SERIES, "SELECT series_id, count(*) AS n, count(*) FILTER (value IS NULL) AS n_missing, count(*) >= 12 AND count(*) FILTER (value IS NULL) = 0 AS usable FROM s GROUP BY 1"))
def load_validate(spark, sf_dir):
    return frames.series_checks(region_month_series(spark, sf_dir), K)


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_returnflag = 'R' THEN l_extendedprice / 1000e0 ELSE l_extendedprice END, 6) AS value FROM lineitem")
def unit_convert(spark, sf_dir):
    units = F.when(F.col("l_returnflag") == "R", "kg m-2 yr-1").otherwise("m w.e.")
    return rounded(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", frames.convert_units(F.col("l_extendedprice"), units).alias("value")), 6)


@query(
    with_(SERIES, "SELECT series_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, round(min(value), 4) AS min, round(max(value), 4) AS max, bool_or(value IS NULL) AS has_null FROM s GROUP BY 1")
)
def series_summary(spark, sf_dir):
    return rounded(frames.summarize(region_month_series(spark, sf_dir), K))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem")
def squeeze_dimension(spark, sf_dir):
    one = table(spark, sf_dir, "lineitem").withColumn("height", F.lit(1))
    return frames.drop_constant_dimensions(one, ["height"]).select("l_orderkey", "l_linenumber", frames.find_column(one, ("missing", "l_partkey")))


@query(with_(FIELD, "SELECT a.rlat, o.rlon, a.lat, CASE WHEN o.lon > 180 THEN o.lon - 360 ELSE o.lon END AS lon FROM (SELECT DISTINCT rlat, lat FROM cells) a CROSS JOIN (SELECT DISTINCT rlon, lon FROM cells) o"))
def lon_wrap_grid(spark, sf_dir):
    c = nation_cells(spark, sf_dir)
    return frames.mesh_grid(c.select("rlat", "lat").distinct(), c.select("rlon", "lon").distinct()).select("rlat", "rlon", "lat", "lon")


@query("SELECT p_partkey, translate(trim(p_type || ' / ' || p_brand), ' /', '_-') AS name FROM part")
def clean_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", frames.clean_name(F.concat_ws(" / ", "p_type", "p_brand")).alias("name"))


def _catalog(spark, sf_dir) -> Catalog:
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = nation.select(F.concat(F.lit("N"), F.col("n_nationkey")).alias("key"), F.concat(F.lit("/data/"), "n_nationkey", F.lit(".nc")).alias("path"), F.when(F.col("n_nationkey") % 6 != 0, F.col("r_name")).alias("region"), F.when(F.col("n_nationkey") % 2 == 0, "even").otherwise("  ").alias("subregion"), F.when(F.col("n_nationkey") % 4 != 0, F.col("n_name")).alias("name"))
    return Catalog(spark.createDataFrame([], rows.schema)).register(rows)


CATALOG = """cat AS (SELECT 'N' || n_nationkey AS key, '/data/' || n_nationkey || '.nc' AS path, CASE WHEN n_nationkey % 6 != 0 THEN r_name END AS region,
  CASE WHEN n_nationkey % 2 = 0 THEN 'even' END AS subregion, CASE WHEN n_nationkey % 4 != 0 THEN n_name ELSE 'N' || n_nationkey END AS name FROM nation JOIN region ON n_regionkey = r_regionkey)"""


@query(with_(CATALOG, "SELECT * FROM cat"))
def catalog_register(spark, sf_dir):
    return _catalog(spark, sf_dir).entries


@query(with_(CATALOG, "SELECT * FROM cat WHERE lower(region) LIKE '%a%' AND lower(subregion) LIKE '%ev%'"))
def catalog_filter(spark, sf_dir):
    return _catalog(spark, sf_dir).select(region="A", subregion="EV")


@query(with_(CATALOG, "SELECT key, key IN (SELECT 'N' || s_nationkey FROM supplier) AS available FROM cat"))
def catalog_available(spark, sf_dir):
    c = _catalog(spark, sf_dir)
    files = table(spark, sf_dir, "supplier").select(F.concat(F.lit("/data/"), "s_nationkey", F.lit(".nc")).alias("path"))
    return c.available(files).select("key", F.lit(True).alias("available")).unionByName(c.missing(files).select("key", F.lit(False).alias("available")))


@query(with_(CATALOG, "SELECT coalesce(region, 'Unknown') AS region, list_sort(list(key)) AS keys FROM cat GROUP BY 1"))
def catalog_by_region(spark, sf_dir):
    return _catalog(spark, sf_dir).by_region()


@query(with_(CATALOG, "SELECT DISTINCT subregion FROM cat WHERE subregion IS NOT NULL"))
def catalog_subregions(spark, sf_dir):
    return _catalog(spark, sf_dir).subregions()


@query(with_(CATALOG, "SELECT region, subregion, count(*) AS n, CAST(grouping(region, subregion) AS BIGINT) AS level FROM cat GROUP BY ROLLUP (region, subregion)"))
def region_rollup(spark, sf_dir):
    return _catalog(spark, sf_dir).summary()


@query(
    with_(
        CATALOG + ", mean AS (SELECT CASE WHEN n_nationkey % 4 != 0 THEN n_name ELSE 'N' || n_nationkey END AS name, count(*) AS n, avg(c_acctbal) AS mean FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey != 3 GROUP BY 1)",
        "SELECT key, name, n, round(mean, 4) AS mean, CASE WHEN mean IS NULL THEN 'missing' WHEN substr(key, 2, 1) = '1' THEN 'no expectation' WHEN mean BETWEEN 4000 AND 5000 THEN 'ok' ELSE 'out of range' END AS status FROM cat LEFT JOIN mean USING (name)",
    )
)
def catalog_expectations(spark, sf_dir):
    c = _catalog(spark, sf_dir)
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("N"), "n_nationkey").alias("key"))
    means = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).where("n_nationkey != 3").groupBy("key").agg(F.count("*").alias("n"), F.avg("c_acctbal").alias("mean")).join(c.entries.select("key", "name"), "key").select("name", "n", "mean")
    expected = c.entries.where("substr(key, 2, 1) != '1'").select("name", F.lit(4000.0).alias("low"), F.lit(5000.0).alias("high"))
    return rounded(c.check(means, expected))


POLYGONS = [("square", 0, [(170.0, -80.5), (181.0, -80.5), (181.0, -74.0), (170.0, -74.0), (170.0, -80.5)]), ("triangle", 0, [(165.0, -79.0), (195.0, -79.0), (180.0, -68.0), (165.0, -79.0)]), ("triangle", 1, [(190.0, -71.0), (194.0, -71.0), (194.0, -69.0), (190.0, -69.0), (190.0, -71.0)])]
EDGES = "edges(basin, ring_id, x1, y1, x2, y2) AS (VALUES " + ", ".join(f"('{b}', {r}, {x1!r}e0, {y1!r}e0, {x2!r}e0, {y2!r}e0)" for b, r, p in POLYGONS for (x1, y1), (x2, y2) in zip(p, p[1:])) + ")"
IN_BASIN = f"""{FIELD}, {EDGES},
inside AS (SELECT DISTINCT cell_id, basin FROM (SELECT cell_id, basin, ring_id, count(*) AS n FROM cells JOIN edges ON (y1 > lat) != (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY 1, 2, 3) WHERE n % 2 = 1)"""


def _inside(spark, sf_dir):
    rows = [(b, r, i, x, y) for b, r, p in POLYGONS for i, (x, y) in enumerate(p)]
    return frames.points_in_polygons(nation_cells(spark, sf_dir), spark.createDataFrame(rows, "basin string, ring_id int, seq int, x double, y double"))


@query(with_(IN_BASIN, "SELECT cell_id, basin FROM inside"))
def mask_polygon(spark, sf_dir):
    return _inside(spark, sf_dir)


@query(with_(IN_BASIN, "SELECT cell_id, t, round(value, 6) AS value FROM f WHERE cell_id IN (SELECT cell_id FROM inside WHERE basin = 'square')"))
def masked_field(spark, sf_dir):
    return rounded(frames.mask_cells(nation_month_field(spark, sf_dir), _inside(spark, sf_dir).where("basin = 'square'")).select("cell_id", "t", "value"), 6)


@query(with_(IN_BASIN, "SELECT basin, t, round(sum(value * area) / sum(area), 4) AS value, count(DISTINCT cell_id) AS n_cells FROM f JOIN cells USING (cell_id) JOIN inside USING (cell_id) GROUP BY 1, 2"))
def area_weighted_mean(spark, sf_dir):
    return rounded(frames.basin_means(nation_month_field(spark, sf_dir), nation_cells(spark, sf_dir), _inside(spark, sf_dir)))


@query(with_(FIELD, "SELECT cell_id FROM f WHERE value > 0 GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT t) FROM f)"))
def valid_cells(spark, sf_dir):
    f = nation_month_field(spark, sf_dir)
    n = f.agg(F.countDistinct("t")).first()[0]
    return frames.valid_cells(f.withColumn("value", F.when(F.col("value") > 0, F.col("value"))), n)


@query(with_(FIELD + ", box AS (SELECT min(rlat) - 1 AS a, max(rlat) + 1 AS b, min(rlon) - 1 AS c, max(rlon) + 1 AS d FROM cells WHERE region_key = 4)", "SELECT cell_id, rlat, rlon FROM cells, box WHERE rlat BETWEEN a AND b AND rlon BETWEEN c AND d"))
def bbox_crop(spark, sf_dir):
    c = nation_cells(spark, sf_dir)
    return frames.crop_to_cells(c, c.where("region_key = 4"), 1).select("cell_id", "rlat", "rlon")


@query(with_(FIELD, "SELECT CAST(rlat // 2 AS INTEGER) AS rlat, CAST(rlon // 2 AS INTEGER) AS rlon, t, round(avg(value), 7) AS value, round(avg(lat), 4) AS lat, round(avg(lon), 4) AS lon, round(sum(area), 4) AS area FROM f JOIN cells USING (cell_id) WHERE rlat < 4 AND rlon < 4 GROUP BY 1, 2, 3"))
def coarsen(spark, sf_dir):
    return rounded(frames.coarsen(nation_month_field(spark, sf_dir).join(nation_cells(spark, sf_dir), "cell_id"), 2, 5, 5), value=7)


@query("SELECT p_name AS name, min(p_partkey) AS p_partkey FROM part GROUP BY 1")
def dissolve_metadata(spark, sf_dir):
    return first_per_name(table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), "p_partkey"), "p_partkey")


@query("SELECT p_brand, nullif(trim(CASE WHEN p_size % 5 = 0 THEN '' WHEN p_size % 5 = 1 THEN 'nan' ELSE p_type END), '') IS NULL OR p_size % 5 = 1 AS dropped, count(*) AS n FROM part GROUP BY 1, 2")
def clean_missing(spark, sf_dir):
    raw = F.when(F.col("p_size") % 5 == 0, "").when(F.col("p_size") % 5 == 1, "nan").otherwise(F.col("p_type"))
    return table(spark, sf_dir, "part").groupBy("p_brand", clean(raw).isNull().alias("dropped")).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)")
def requested_minus_available(spark, sf_dir):
    rich = table(spark, sf_dir, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("n_nationkey"))
    return table(spark, sf_dir, "nation").select("n_nationkey").distinct().join(rich, "n_nationkey", "left_anti")


@query("SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(sum(pow(value - m, 3)) / count(*) / pow(stddev_pop(value), 3), 6) AS skew, round(sum(pow(value - m, 4)) / count(*) / pow(var_pop(value), 2) - 3, 6) AS kurtosis FROM (SELECT *, avg(value) OVER (PARTITION BY event_type) AS m FROM events) GROUP BY 1")
def moments(spark, sf_dir):
    return rounded(stats.moments(table(spark, sf_dir, "events"), ["event_type"]), 6)


@query(with_(SERIES, "SELECT series_id, CAST(year(ts) AS INTEGER) AS year, round(avg(value), 4) AS value FROM s GROUP BY 1, 2"))
def annual_mean(spark, sf_dir):
    return rounded(stats.annual(region_month_series(spark, sf_dir), K))


@query(with_(SERIES, "SELECT series_id, CAST(year(ts) AS INTEGER) AS year, round(sum(value), 3) AS value FROM s GROUP BY 1, 2"))
def annual_sum(spark, sf_dir):
    return rounded(stats.annual(region_month_series(spark, sf_dir), K, "sum"), 3)


@query(with_(SERIES, "SELECT series_id, CAST(t // 12 AS INTEGER) AS year, round(avg(value), 4) AS value FROM s GROUP BY 1, 2 HAVING count(*) = 12"))
def annual_positional(spark, sf_dir):
    return rounded(stats.annual(region_month_series(spark, sf_dir), K, calendar=False, complete=True))


@query(with_(FIELD, "SELECT t, round(quantile_cont(value, 0.16), 4) AS p16, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.84), 4) AS p84, round(quantile_cont(value, 0.95), 4) AS p95 FROM f GROUP BY 1"))
def ensemble_percentiles(spark, sf_dir):
    return rounded(stats.percentiles(nation_month_field(spark, sf_dir), ["t"], "value", [0.16, 0.5, 0.84, 0.95]))


@query("WITH o AS (SELECT event_type, avg(value) AS v FROM events GROUP BY 1) SELECT event_type, round(avg(CASE WHEN value < v THEN 100e0 ELSE 0e0 END), 6) AS percentile FROM events JOIN o USING (event_type) GROUP BY 1")
def percentile_of_observed(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return rounded(stats.percentile_of(e.join(e.groupBy("event_type").agg(F.avg("value").alias("v")), "event_type"), ["event_type"], "value", F.col("v")), 6)


@query("SELECT event_type, CAST(CASE WHEN value = 100 THEN 9 ELSE floor(value / 10) END AS INTEGER) AS bin, count(*) AS n, round(count(*) / (sum(count(*)) OVER (PARTITION BY event_type) * 10e0), 8) AS density FROM events WHERE value BETWEEN 0 AND 100 GROUP BY 1, 2")
def histogram_density(spark, sf_dir):
    return rounded(stats.density(table(spark, sf_dir, "events"), ["event_type"], "value", 0.0, 100.0, 10), 8)


@query(with_(SERIES + ", a AS (SELECT series_id, CAST(year(ts) AS INTEGER) AS year, avg(value) AS value FROM s GROUP BY 1, 2)", "SELECT series_id, year, round(value, 4) AS value, row_number() OVER w AS rank, round((count(*) OVER (PARTITION BY series_id) + 1) / CAST(row_number() OVER w AS DOUBLE), 6) AS return_period FROM a WINDOW w AS (PARTITION BY series_id ORDER BY value DESC, year)"))
def return_period_weibull(spark, sf_dir):
    return rounded(stats.return_periods(stats.annual(region_month_series(spark, sf_dir), K), K), return_period=6)


@query(with_(SERIES + ", a AS (SELECT series_id, CAST(t // 12 AS INTEGER) AS year, avg(value) AS value FROM s GROUP BY 1, 2 HAVING count(*) = 12)", "SELECT series_id, year, round(value, 4) AS value, row_number() OVER w AS rank, round(count(*) OVER (PARTITION BY series_id) / CAST(row_number() OVER w AS DOUBLE), 6) AS return_period FROM a WINDOW w AS (PARTITION BY series_id ORDER BY value DESC, year)"))
def return_period_fig(spark, sf_dir):
    return rounded(stats.return_periods(stats.annual(region_month_series(spark, sf_dir), K, calendar=False, complete=True), K, weibull=False), return_period=6)


@query(with_(SERIES, "SELECT series_id, t, round(std, 4) AS std FROM (SELECT series_id, t, stddev_pop(value) OVER w AS std, count(*) OVER w AS n FROM s WINDOW w AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING)) WHERE n = 24 AND t % 12 = 0"))
def rolling_std(spark, sf_dir):
    return rounded(stats.rolling_std(region_month_series(spark, sf_dir).select("series_id", "t", "value"), K, "t", 24, 12))


@query(
    with_(
        SERIES + ", w AS (SELECT series_id, CAST(t // 24 AS INTEGER) AS w, avg(value) AS mean, stddev_pop(value) AS std FROM s GROUP BY 1, 2 HAVING count(*) = 24), q AS (SELECT series_id, w, max(v) - min(v) AS rg FROM (SELECT series_id, CAST(t // 24 AS INTEGER) AS w, t % 12 AS mm, avg(value) AS v FROM s GROUP BY 1, 2, 3) GROUP BY 1, 2)",
        'SELECT series_id, w AS "window", round(mean, 4) AS mean, round(std, 4) AS std, round(rg, 4) AS seasonal_range FROM w JOIN q USING (series_id, w)',
    )
)
def window_stats(spark, sf_dir):
    return rounded(stats.window_stats(region_month_series(spark, sf_dir), K, 24))


@query(
    with_(
        SERIES + ", a AS (SELECT series_id, CAST(t // 12 AS INTEGER) AS year, avg(value) AS value FROM s GROUP BY 1, 2 HAVING count(*) = 12), wn AS (SELECT unnest(range(0, 100)) AS w)",
        'SELECT series_id, CAST(w AS INTEGER) AS "window", round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, round(max(value) - min(value), 4) AS "range" FROM a JOIN wn ON year BETWEEN w AND w + 3 GROUP BY 1, 2 HAVING count(*) = 4',
    )
)
def overlapping_windows(spark, sf_dir):
    return rounded(stats.overlapping_windows(stats.annual(region_month_series(spark, sf_dir), K, calendar=False, complete=True), K, 4))


@query(with_(SERIES, "SELECT series_id, half, count(*) AS n, round(avg(value), 4) AS mean FROM (SELECT *, CAST(row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 >= count(*) OVER (PARTITION BY series_id) // 2 AS INTEGER) AS half FROM s) GROUP BY 1, 2"))
def split_halves(spark, sf_dir):
    return rounded(stats.split_halves(region_month_series(spark, sf_dir), K).groupBy("series_id", "half").agg(F.count("*").alias("n"), F.avg("value").alias("mean")))


@query(with_(RESID + ", c AS (SELECT series_id, t, value - avg(value) OVER (PARTITION BY series_id) AS x FROM r)", "SELECT a.series_id, CAST(lag AS INTEGER) AS lag, round(sum(a.x * b.x) / any_value(v), 6) AS acf FROM c a CROSS JOIN range(0, 13) l(lag) JOIN c b ON a.series_id = b.series_id AND b.t = a.t + lag JOIN (SELECT series_id, sum(x * x) AS v FROM c GROUP BY 1) q ON q.series_id = a.series_id GROUP BY 1, 2"))
def autocorrelation(spark, sf_dir):
    return rounded(stats.autocorrelation(residuals(spark, sf_dir), K, 12), 6)


@query(with_(RESID + ", c AS (SELECT series_id, greatest(least(corr(value, y), 99e-2), -99e-2) AS phi, stddev_pop(value) AS sd FROM (SELECT *, lead(value) OVER (PARTITION BY series_id ORDER BY t) AS y FROM r) GROUP BY 1)", "SELECT series_id, round(phi, 6) AS phi, round(sd * sqrt(greatest(1 - phi * phi, 1e-12)), 4) AS sigma, round(CASE WHEN phi > 0 AND phi < 1 THEN -1 / ln(abs(phi)) ELSE 0e0 END, 5) AS efold_months FROM c"))
def ar1_fit(spark, sf_dir):
    return rounded(stats.lag1(residuals(spark, sf_dir), K), phi=6, efold_months=5)
