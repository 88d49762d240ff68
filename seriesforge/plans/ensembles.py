"""Queries on ensembles, nulls and summaries read from the tables.

What synthesis and surrogates feed into (summaries, metrics, verdicts) is run
here on ensembles that the tables hold: the nations of a region are the members
of its experiment. So their results have SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesforge.functions import kernels
from seriesforge.operators import field, preprocess, significance, spectral, stats, validation
from seriesforge.plans import suite
from seriesforge.plans.experiments import ANNUAL, DECADAL
from seriesforge.plans.relational import CATALOG, K, _catalog, query, residuals, rounded
from seriesforge.plans.spectra import FRESID, NPERSEG, ORACLE_SQL, PATTERNS, _field_residuals, _patterns
from seriesforge.plans.synthetic import _model
from seriesforge.plans.sql import FIELD, PERIODOGRAM, RESID, SERIES, dft, welch, with_
from seriesforge.sources import frames
from seriesforge.sources.catalog import reference_first
from seriesforge.sources.frames import nation_cells, nation_month_field, region_month_series, table

MEMBERS = f"""{FIELD}, mem AS (SELECT n_nationkey AS cell_id, r_name AS experiment, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS member FROM nation JOIN region ON n_regionkey = r_regionkey),
en AS (SELECT experiment, 'orders' AS series_id, member, f.ts, t, month, value FROM f JOIN mem USING (cell_id)), ob AS (SELECT 'orders' AS series_id, t, month, avg(value) AS value FROM f GROUP BY 1, 2, 3)"""


def _members(spark, sf_dir) -> DataFrame:
    """(experiment, series_id, member, ts, t, month, value): each nation a member of its region's experiment."""
    from pyspark.sql import Window

    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    number = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1
    names = nation.select(F.col("n_nationkey").alias("cell_id"), F.col("r_name").alias("experiment"), number.alias("member"))
    return nation_month_field(spark, sf_dir).join(names, "cell_id").select("experiment", F.lit("orders").alias("series_id"), "member", "ts", "t", "month", "value")


def _band(low: float, high: float, freq: str = "freq") -> str:
    return f"{freq} BETWEEN {1 / high!r}e0 AND {1 / low!r}e0"


POWER = f"""{MEMBERS}, ec AS (SELECT experiment, member, CAST(t AS BIGINT) AS j, value - avg(value) OVER (PARTITION BY experiment, member) AS x, count(*) OVER (PARTITION BY experiment, member) AS len FROM en),
ep AS (SELECT experiment, member, k, k * 12e0 / n AS freq, CASE WHEN k = 0 OR k = n // 2 THEN 1e0 ELSE 2e0 END * power / (12e0 * n) AS psd FROM {dft('ec', 'experiment, member', 'len')}),
eb AS (SELECT experiment, member, sum(CASE WHEN {_band(*ANNUAL)} THEN psd ELSE 0e0 END) * max(CASE WHEN k = 1 THEN freq END) AS va, sum(CASE WHEN {_band(*DECADAL)} THEN psd ELSE 0e0 END) * max(CASE WHEN k = 1 THEN freq END) AS vd FROM ep GROUP BY 1, 2),
su AS (SELECT experiment, avg(va) AS va, avg(vd) AS vd FROM eb GROUP BY 1), st AS (SELECT experiment, var_pop(value) AS vt, avg(value) AS m FROM en GROUP BY 1)"""


@query(with_(POWER + ", z AS (SELECT su.va AS a0, su.vd AS d0, vt AS t0 FROM su JOIN st USING (experiment) WHERE experiment = 'ASIA')", "SELECT experiment, 'orders' AS series_id, round(va, 2) AS v_annual, round(vd, 2) AS v_decadal, round(vt, 2) AS v_total, round(m, 4) AS mean, round(va / nullif(a0, 0), 6) AS annual_ratio, round(vd / nullif(d0, 0), 6) AS decadal_ratio, round(vt / nullif(t0, 0), 6) AS total_ratio FROM su JOIN st USING (experiment), z"))
def suite_summary_nations(spark, sf_dir):
    return rounded(suite.suite_summary(_members(spark, sf_dir), K, "ASIA"), 6, v_annual=2, v_decadal=2, v_total=2, mean=4)


@query(
    with_(
        MEMBERS + ", o AS (SELECT series_id, avg(value) AS om, var_pop(value) AS ov FROM s GROUP BY 1)".replace("FROM s GROUP", "FROM rs GROUP") + f", x AS (SELECT experiment, n, avg(value) AS sm, var_pop(value) AS sv FROM en JOIN (VALUES (1), (2), (3), (5)) c(n) ON member < n GROUP BY 1, 2)",
        "SELECT experiment AS series_id, n AS n_members, round(sm / om, 6) AS mean_ratio, round(sv / ov, 6) AS variance_ratio FROM x JOIN o ON o.series_id = experiment",
    ).replace("WITH ", f"WITH {SERIES.strip()}, rs AS (SELECT * FROM s), ", 1)
)
def convergence_nations(spark, sf_dir):
    ensemble = _members(spark, sf_dir).drop("series_id").withColumnRenamed("experiment", "series_id")
    return rounded(validation.convergence(region_month_series(spark, sf_dir), ensemble, K, [1, 2, 3, 5]), 6)


def _side(name: str, experiment: str) -> str:
    return f"""{name} AS (SELECT sum(CASE WHEN {_band(*ANNUAL)} THEN psd ELSE 0e0 END) AS inn, sum(CASE WHEN {_band(*ANNUAL)} THEN 0e0 ELSE psd END) AS outt FROM wp WHERE k > 0 AND experiment = '{experiment}')"""


@query(with_(welch("en", MEMBERS, NPERSEG, "experiment, member") + f", {_side('a', 'ASIA')}, {_side('e', 'EUROPE')}", "SELECT 'orders' AS series_id, round(e.inn / nullif(a.inn, 0), 6) AS in_band, round(e.outt / a.outt, 6) AS out_of_band FROM a, e"))
def band_variance_ratio_nations(spark, sf_dir):
    e = _members(spark, sf_dir)
    return rounded(suite.band_variance_ratio(e.where("experiment = 'ASIA'"), e.where("experiment = 'EUROPE'"), K, ANNUAL, NPERSEG), 6)


_OBSERVED = welch("ob", "x AS (SELECT 1)", NPERSEG).split(",\nwc AS", 1)[1]
for _name in ("wc", "ws", "wt", "we", "wp"):
    _OBSERVED = _OBSERVED.replace(f"{_name} AS (", f"o{_name} AS (").replace(f"FROM {_name})", f"FROM o{_name})").replace(f"FROM {_name} ", f"FROM o{_name} ").replace(f"JOIN {_name} ", f"JOIN o{_name} ")
METRICS = (
    welch("(SELECT * FROM en WHERE member = 0)", MEMBERS, NPERSEG, "experiment")
    + ",\nowc AS" + _OBSERVED.removeprefix(" AS")
    + """,
om AS (SELECT avg(value) AS m, var_pop(value) AS v FROM ob), em AS (SELECT experiment, avg(value) AS m, var_pop(value) AS v FROM en GROUP BY 1),
bo AS (SELECT experiment, value, 1 AS second FROM en UNION ALL SELECT experiment, value, 0 FROM ob, (SELECT DISTINCT experiment FROM en)), bc AS (SELECT experiment, value, sum(1 - second) AS a, sum(second) AS b2 FROM bo GROUP BY 1, 2),
bk AS (SELECT experiment, max(abs(fa - fb)) AS ks FROM (SELECT experiment, sum(a) OVER w / sum(a) OVER (PARTITION BY experiment) AS fa, sum(b2) OVER w / sum(b2) OVER (PARTITION BY experiment) AS fb FROM bc WINDOW w AS (PARTITION BY experiment ORDER BY value)) GROUP BY 1),
pr AS (SELECT experiment, sqrt(avg(pow(log10(wp.psd) - log10(owp.psd), 2))) AS rms FROM wp JOIN owp USING (k) WHERE k > 0 GROUP BY 1),
ax AS (SELECT experiment, t, value - avg(value) OVER (PARTITION BY experiment) AS x FROM (SELECT experiment, t, value FROM en WHERE member = 0 UNION ALL SELECT 'observed', t, value FROM ob)),
aa AS (SELECT a.experiment, lag, sum(a.x * b.x) / any_value(v) AS acf FROM ax a CROSS JOIN (VALUES (1), (12)) l(lag) JOIN ax b ON a.experiment = b.experiment AND b.t = a.t + lag JOIN (SELECT experiment, sum(x * x) AS v FROM ax GROUP BY 1) q ON q.experiment = a.experiment GROUP BY 1, 2),
ae AS (SELECT e.experiment, max(CASE WHEN lag = 1 THEN abs(e.acf - o.acf) END) AS e1, max(CASE WHEN lag = 12 THEN abs(e.acf - o.acf) END) AS e12 FROM aa e JOIN aa o USING (lag) WHERE o.experiment = 'observed' AND e.experiment != 'observed' GROUP BY 1),
sm AS (SELECT experiment, sqrt(avg(pow(e.v - o.v, 2))) AS rmse FROM (SELECT experiment, month, avg(value) AS v FROM en GROUP BY 1, 2) e JOIN (SELECT month, avg(value) AS v FROM ob GROUP BY 1) o USING (month) GROUP BY 1)"""
)


@query(with_(METRICS, "SELECT experiment, 'orders' AS series_id, round(em.m / om.m, 6) AS mean_ratio, round(em.v / om.v, 6) AS variance_ratio, round(ks, 6) AS ks_distance, round(rms, 6) AS psd_rms, round(e1, 6) AS acf_lag1_error, round(e12, 6) AS acf_lag12_error, round(rmse, 4) AS seasonal_rmse FROM em JOIN bk USING (experiment) JOIN pr USING (experiment) JOIN ae USING (experiment) JOIN sm USING (experiment), om"))
def ensemble_metrics_nations(spark, sf_dir):
    observed = nation_month_field(spark, sf_dir).groupBy("t", "month").agg(F.avg("value").alias("value")).withColumn("series_id", F.lit("orders"))
    return rounded(validation.compute_metrics(observed, _members(spark, sf_dir), K, NPERSEG), 6, seasonal_rmse=4)


@query(with_(MEMBERS + ", a AS (SELECT experiment, member, CAST(year(ts) AS INTEGER) AS year, avg(value) AS value FROM en GROUP BY 1, 2, 3), w AS (SELECT experiment, member, year, stddev_pop(value) OVER q AS std, count(*) OVER q AS n FROM a WINDOW q AS (PARTITION BY experiment, member ORDER BY year ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING))", "SELECT experiment, year, round(quantile_cont(std, 16e-2), 4) AS p16, round(quantile_cont(std, 5e-1), 4) AS p50, round(quantile_cont(std, 84e-2), 4) AS p84 FROM w WHERE n = 3 GROUP BY 1, 2"))
def rolling_spread(spark, sf_dir):
    by = ["experiment", "member"]
    spread = stats.rolling_std(stats.annual(_members(spark, sf_dir), by), by, "year", 3)
    return rounded(stats.percentiles(spread, ["experiment", "year"], "std", [0.16, 0.5, 0.84]))


# --- significance against nulls that are tables

NULLS = f"""{PERIODOGRAM}, {FIELD.strip()}, {FRESID.split(FIELD, 1)[1].strip().removeprefix(',').strip()},
bd(band, low, high) AS (VALUES ('decadal', 8e0, 20e0), ('annual', 8e-1, 15e-1)),
ov AS (SELECT series_id, band, sum(CASE WHEN freq BETWEEN 1 / high AND 1 / low THEN psd ELSE 0e0 END) * max(CASE WHEN k = 1 THEN freq END) AS observed, 100 * sum(CASE WHEN freq BETWEEN 1 / high AND 1 / low THEN psd ELSE 0e0 END) / sum(psd) AS share FROM pg, bd GROUP BY 1, 2),
nc AS (SELECT cell_id, CAST(t AS BIGINT) AS j, value - avg(value) OVER (PARTITION BY cell_id) AS x, count(*) OVER (PARTITION BY cell_id) AS len FROM fr),
np AS (SELECT cell_id, k, k * 12e0 / n AS freq, CASE WHEN k = 0 OR k = n // 2 THEN 1e0 ELSE 2e0 END * power / (12e0 * n) AS psd FROM {dft('nc', 'cell_id', 'len')}),
nv AS (SELECT cell_id, band, 25e0 * sum(CASE WHEN freq BETWEEN 1 / high AND 1 / low THEN psd ELSE 0e0 END) * max(CASE WHEN k = 1 THEN freq END) AS variance FROM np, bd GROUP BY 1, 2),
nu AS (SELECT r_name AS series_id, band, CASE WHEN n_regionkey = r_regionkey THEN 'white' ELSE 'ar1' END AS "null", variance FROM nv JOIN nation ON n_nationkey = cell_id, region),
te AS (SELECT nu.series_id, nu.band, "null", max(observed) AS observed, max(share) AS share_pct, quantile_cont(variance, 5e-1) AS median, quantile_cont(variance, 95e-2) AS p95, avg(CASE WHEN variance < observed THEN 1e2 ELSE 0e0 END) AS percentile FROM nu JOIN ov ON ov.series_id = nu.series_id AND ov.band = nu.band GROUP BY 1, 2, 3)"""


def _band_rows(psd: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, band, observed, share_pct) of both bands."""
    bands = [psd.groupBy(*keys).agg((F.sum(F.when(spectral.in_band(F.col("freq"), *limits), F.col("psd")).otherwise(0.0)) * F.max(F.when(F.col("k") == 1, F.col("freq")))).alias("observed"), (100 * F.sum(F.when(spectral.in_band(F.col("freq"), *limits), F.col("psd")).otherwise(0.0)) / F.sum("psd")).alias("share_pct")).withColumn("band", F.lit(name)) for name, limits in significance.BANDS.items()]
    return bands[0].unionByName(bands[1])


def _tests(spark, sf_dir) -> DataFrame:
    """Each region against two nulls: 25 times its own nations (as white), and all others (as AR(1))."""
    observed = _band_rows(spectral.periodogram(residuals(spark, sf_dir), K), K)
    cells = _band_rows(spectral.periodogram(_field_residuals(spark, sf_dir), ["cell_id"]), ["cell_id"]).select("cell_id", "band", (25.0 * F.col("observed")).alias("variance"))
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    pairs = nation.crossJoin(F.broadcast(region)).select(F.col("n_nationkey").alias("cell_id"), F.col("r_name").alias("series_id"), F.when(F.col("n_regionkey") == F.col("r_regionkey"), "white").otherwise("ar1").alias("null"))  # nations x regions
    return significance.against_null(observed, cells.join(F.broadcast(pairs), "cell_id"), K)


@query(with_(NULLS, 'SELECT series_id, band, "null", round(observed, 2) AS observed, round(share_pct, 6) AS share_pct, round(median, 2) AS median, round(p95, 2) AS p95, round(percentile, 6) AS percentile FROM te'))
def null_percentiles(spark, sf_dir):
    return rounded(_tests(spark, sf_dir), 2, share_pct=6, percentile=6)


@query(with_(NULLS, "SELECT series_id, band, max(percentile) >= 95 AS significant, max(share_pct) >= 5 AS relevant FROM te GROUP BY 1, 2"))
def band_verdicts(spark, sf_dir):
    return significance.verdict(_tests(spark, sf_dir), K)


_PICK = ", ".join(f"max(CASE WHEN band = '{b}' AND \"null\" = '{n}' THEN percentile END) AS {b}_p_{n}" for b in significance.BANDS for n in ("white", "ar1"))
SURVEYED = f"""{NULLS}, tw AS (SELECT series_id, {_PICK}, max(CASE WHEN band = 'decadal' THEN share_pct END) AS decadal_pct, max(CASE WHEN band = 'annual' THEN share_pct END) AS annual_pct FROM te GROUP BY 1),
ph AS (SELECT series_id, corr(value, y) AS phi FROM (SELECT *, lead(value) OVER (PARTITION BY series_id ORDER BY t) AS y FROM r) GROUP BY 1),
bs AS (SELECT series_id, count(*) AS n_obs, stddev_pop(value) AS std FROM r GROUP BY 1),
sv AS (SELECT *, decadal_pct >= {2 * significance.white_expectation_pct(8, 20)!r}e0 AS bd2, annual_pct >= {2 * significance.white_expectation_pct(0.8, 1.5)!r}e0 AS ba2 FROM tw JOIN ph USING (series_id) JOIN bs USING (series_id))"""


@query(with_(SURVEYED, "SELECT series_id, n_obs, round(std, 4) AS std, round(phi, 6) AS phi, round(decadal_pct, 6) AS decadal_pct, round(annual_pct, 6) AS annual_pct, round(decadal_p_white, 6) AS decadal_p_white, round(annual_p_ar1, 6) AS annual_p_ar1, CASE WHEN (bd2 AND decadal_p_ar1 >= 95) OR (ba2 AND annual_p_ar1 >= 95) THEN 'band-structured' WHEN abs(phi) >= 2e-1 OR (bd2 AND decadal_p_white >= 95) OR (ba2 AND annual_p_white >= 95) THEN 'red' ELSE 'white' END AS verdict FROM sv"))
def survey_of_nulls(spark, sf_dir):
    rows = significance.surveyed(_tests(spark, sf_dir), residuals(spark, sf_dir), K)
    return rounded(rows.select("series_id", "n_obs", "std", "phi", "decadal_pct", "annual_pct", "decadal_p_white", "annual_p_ar1", "verdict"), 6, std=4)


@query(with_(SERIES + ", x AS (SELECT series_id, CASE WHEN series_id = 'ASIA' AND t % 9 = 4 THEN NULL WHEN series_id = 'EUROPE' THEN 1e0 ELSE value END AS value FROM s WHERE series_id != 'AFRICA' OR t < 20)", "SELECT series_id, count(*) AS n_obs, CASE WHEN count(value) < count(*) THEN 'ERROR: missing values' WHEN count(*) < 24 THEN 'ERROR: fewer than 24 steps' ELSE 'ERROR: no variance' END AS verdict FROM x GROUP BY 1 HAVING count(value) < count(*) OR count(*) < 24 OR count(DISTINCT value) < 2"))
def survey_failures(spark, sf_dir):
    value = F.when((F.col("series_id") == "ASIA") & (F.col("t") % 9 == 4), F.lit(None)).when(F.col("series_id") == "EUROPE", 1.0).otherwise(F.col("value"))
    s = region_month_series(spark, sf_dir).where("series_id != 'AFRICA' or t < 20").withColumn("value", value)
    return significance.unusable(s, K)


# --- fields


def _diagnostic_sql(n: int = 80) -> str:
    rows = ", ".join(f"({i}, {j}, {float(v)!r}::DOUBLE)" for i, row in enumerate(kernels.dpss(n, 1.5, 2)) for j, v in enumerate(row))
    ctes = f"""{FRESID}, tp(taper, j, w) AS (VALUES {rows}), al AS (SELECT CAST(cell_id AS BIGINT) AS cell_id, t, value FROM fr UNION ALL SELECT -1, t, avg(value) FROM fr GROUP BY t),
dc AS (SELECT cell_id, CAST(t AS BIGINT) AS j, value - avg(value) OVER (PARTITION BY cell_id) AS x FROM al), dt AS (SELECT cell_id, taper, j, x * w AS x FROM dc JOIN tp USING (j)),
dp AS (SELECT cell_id, k, k * (12e0 / {n}) AS freq, avg(power * CASE WHEN k = 0 OR k = {n // 2} THEN 1e0 ELSE 2e0 END) / 12e0 AS psd FROM {dft('dt', 'cell_id, taper', str(n))} GROUP BY 1, 2),
bd(band, low, high) AS (VALUES ('decadal', 8e0, 20e0), ('annual', 8e-1, 15e-1)), db AS (SELECT cell_id, band, sum(CASE WHEN freq BETWEEN 1 / high AND 1 / low THEN psd ELSE 0e0 END) * {12 / n!r}e0 AS v FROM dp, bd GROUP BY 1, 2),
dd AS (SELECT band, avg(CASE WHEN cell_id >= 0 THEN v END) AS cv, max(CASE WHEN cell_id < 0 THEN v END) AS mv, count(*) - 1 AS n FROM db GROUP BY 1)"""
    return with_(ctes, "SELECT band, round(cv, 2) AS cell_variance, round(mv, 2) AS mean_variance, n AS n_cells, round(mv / nullif(cv, 0), 6) AS suppression, round((n * mv / nullif(cv, 0) - 1) / (n - 1), 6) AS coherence FROM dd")


ORACLE_SQL["spatial_diagnostic"] = _diagnostic_sql()

SHARE = f"{PATTERNS}, ex AS (SELECT CAST(mode - 1 AS INTEGER) AS mode, sum(value * value) / sum(sum(value * value)) OVER () AS expvar FROM pj GROUP BY mode), eu AS (SELECT mode, expvar, sum(expvar) OVER (ORDER BY mode) AS c FROM ex)"


@query(with_(SHARE, "SELECT x AS threshold, CAST(coalesce((SELECT min(mode) + 1 FROM eu WHERE c >= x), (SELECT max(mode) + 1 FROM eu)) AS INTEGER) AS n_modes FROM (VALUES (3e-1), (8e-1), (2e0)) v(x)"))
def suggest_modes(spark, sf_dir):
    scores = field.project(_field_residuals(spark, sf_dir), nation_cells(spark, sf_dir), _patterns(spark, sf_dir)).groupBy((F.col("mode") - 1).alias("mode")).agg(F.sum(F.col("value") * F.col("value")).alias("v"))
    spectrum = scores.crossJoin(F.broadcast(scores.agg(F.sum("v").alias("all")))).select("mode", (F.col("v") / F.col("all")).alias("expvar"))  # one row
    return spark.createDataFrame([(x, field.modes_for(spectrum, x)) for x in (0.3, 0.8, 2.0)], "threshold double, n_modes int")


@query(with_(FIELD, "SELECT cell_id, rlat, rlon FROM cells ORDER BY md5('7:' || cell_id), cell_id LIMIT 10"))
def cell_sample(spark, sf_dir):
    return frames.sample_cells(nation_cells(spark, sf_dir), 10, 7).select("cell_id", "rlat", "rlon")


HOLED = "pg(basin, polygon_id, ring_id, x0, y0, x1, y1) AS (VALUES ('south', 1, 1, 165e0, -81e0, 195e0, -69e0), ('south', 1, 2, 173e0, -78e0, 187e0, -74e0), ('south', 2, 1, 179e0, -76e0, 181e0, -74e0))"


@query(with_(FIELD + ", " + HOLED + ", h AS (SELECT cell_id, basin, polygon_id, count(*) AS n FROM cells, pg WHERE lon BETWEEN x0 AND x1 AND lat BETWEEN y0 AND y1 GROUP BY 1, 2, 3)", "SELECT DISTINCT cell_id, basin FROM h WHERE n % 2 = 1"))
def polygon_holes(spark, sf_dir):
    boxes = [("south", 1, 1, 165.0, -81.0, 195.0, -69.0), ("south", 1, 2, 173.0, -78.0, 187.0, -74.0), ("south", 2, 1, 179.0, -76.0, 181.0, -74.0)]
    corners = [(b, p, r, i, x, y) for b, p, r, x0, y0, x1, y1 in boxes for i, (x, y) in enumerate([(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)])]
    return frames.points_in_polygons(nation_cells(spark, sf_dir), spark.createDataFrame(corners, "basin string, polygon_id int, ring_id int, seq int, x double, y double"))


@query(with_(FIELD + ", fh AS (SELECT cell_id, t, value, CAST(t >= 40 AS INTEGER) AS half FROM f), hm AS (SELECT cell_id, half, avg(value) AS m, var_pop(value) AS v FROM fh GROUP BY 1, 2)", "SELECT a.half AS fitted_half, round(corr(o.m, a.m), 6) AS mean_corr, round(corr(o.v, a.v), 6) AS variance_corr, round(avg(a.m) / avg(o.m), 6) AS mean_ratio, round(avg(a.v) / avg(o.v), 6) AS variance_ratio, round(avg(a.v / o.v), 6) AS map_ratio FROM hm a JOIN hm o ON a.cell_id = o.cell_id AND a.half = 1 - o.half GROUP BY 1"))
def half_map_metrics(spark, sf_dir):
    halves = validation.field_halves(nation_month_field(spark, sf_dir))
    return rounded(validation.against_other_half(halves, lambda half: halves.where(F.col("half") == half)), 6)


# --- selection


@query(with_(CATALOG, "SELECT r.region, s.subregion FROM (SELECT DISTINCT region FROM cat WHERE region IS NOT NULL) r JOIN (SELECT DISTINCT region, subregion FROM cat WHERE subregion IS NOT NULL) s USING (region)"))
def catalog_regions(spark, sf_dir):
    return _catalog(spark, sf_dir).region_tree()


@query("SELECT n_name, CAST(row_number() OVER (ORDER BY n_name != 'PERU', n_name) AS BIGINT) AS place FROM nation")
def reference_order(spark, sf_dir):
    ordered = reference_first(table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")), "PERU")
    return ordered.coalesce(1).select(F.col("name").alias("n_name"), (F.monotonically_increasing_id() + 1).alias("place"))


@query("SELECT s_suppkey, s_nationkey, coalesce(n_name IN ('CHINA', 'PERU', 'KENYA'), false) AS is_target FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def target_split(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return frames.split_by_membership(rows, "n_name", ["CHINA", "PERU", "KENYA"]).select("s_suppkey", "s_nationkey", "is_target")


@query(with_(RESID + ", q AS (SELECT series_id, count(*) AS n_obs, max(season) AS hi, min(season) AS lo FROM r GROUP BY 1)", "SELECT series_id, n_obs, round(slope, 7) AS slope, round(intercept, 3) AS intercept, round(lo, 4) AS season_low, round(hi, 4) AS season_high, round(hi - lo, 4) AS season_range FROM q JOIN tr USING (series_id)"))
def preprocess_summary(spark, sf_dir):
    s = region_month_series(spark, sf_dir)
    return rounded(preprocess.summarize(preprocess.fit(s, K), s), slope=7, intercept=3)


@query(
    with_(
        "x AS (SELECT o_orderpriority AS label, CASE WHEN o_orderstatus = 'F' THEN 'seasonal' WHEN o_orderstatus = 'O' THEN 'control' ELSE 'annual' END AS kind, left(o_orderpriority, 1) AS \"group\", year(o_orderdate) AS series_id, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS v FROM orders GROUP BY 1, 2, 3, 4), y AS (SELECT label, kind, \"group\", CAST(series_id AS VARCHAR) AS series_id, CAST(v AS DOUBLE) / 1e6 AS total_ratio FROM x)",
        "SELECT a.label, a.\"group\", a.series_id, round(a.total_ratio, 6) AS total_ratio, b.label AS control, round(b.total_ratio, 6) AS control_ratio FROM (SELECT * FROM y WHERE kind = 'seasonal') a LEFT JOIN (SELECT * FROM y WHERE kind = 'control') b USING (\"group\", series_id)",
    )
)
def white_control_pairs(spark, sf_dir):
    kind = F.when(F.col("o_orderstatus") == "F", "seasonal").when(F.col("o_orderstatus") == "O", "control").otherwise("annual")
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("label"), kind.alias("kind"), F.substring("o_orderpriority", 1, 1).alias("group"), F.year("o_orderdate").cast("string").alias("series_id"))
    summary = rows.agg((F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double") / 1e6).alias("total_ratio"))
    return rounded(suite.with_white_controls(summary, K).select("label", "group", "series_id", "total_ratio", "control", "control_ratio"), 6)


SUMMARY = "x AS (SELECT o_orderpriority AS label, CASE WHEN o_orderstatus = 'F' THEN 'annual' WHEN o_orderstatus = 'O' THEN 'decadal' ELSE 'seasonal' END AS kind, left(o_orderpriority, 1) AS \"group\", CAST(year(o_orderdate) AS VARCHAR) AS series_id, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / 1e6 AS injected, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS mean FROM orders GROUP BY 1, 2, 3, 4)"


def _summary(spark, sf_dir) -> DataFrame:
    kind = F.when(F.col("o_orderstatus") == "F", "annual").when(F.col("o_orderstatus") == "O", "decadal").otherwise("seasonal")
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("label"), kind.alias("kind"), F.substring("o_orderpriority", 1, 1).alias("group"), F.year("o_orderdate").cast("string").alias("series_id"))
    total = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
    return rows.agg((total / 1e6).alias("injected"), (total / F.count("*")).alias("mean")).withColumn("total_ratio", F.col("injected") / 10.0)


@query(with_(SUMMARY, 'SELECT a."group", a.series_id, round(a.injected, 6) AS annual_injected, round(a.injected / 10, 6) AS annual_total, round(d.injected, 6) AS decadal_injected, round(d.injected / 10, 6) AS decadal_total, round(abs(a.injected - d.injected) / abs(a.injected), 6) AS difference FROM x a JOIN x d ON a."group" = d."group" AND a.series_id = d.series_id WHERE a.kind = \'annual\' AND d.kind = \'decadal\''))
def matched_pair_checks(spark, sf_dir):
    return rounded(suite.matched_pairs(_summary(spark, sf_dir), K), 6)


@query(with_(SUMMARY, "SELECT series_id, bool_and(abs(y.mean - m) <= 1e-8 + 1e-1 * abs(m)) AS mean_preserved, count(*) FILTER (NOT abs(y.mean - m) <= 1e-8 + 1e-1 * abs(m)) AS n_off FROM x y JOIN (SELECT series_id, mean AS m FROM x WHERE label = '1-URGENT' AND kind = 'annual') b USING (series_id) WHERE kind = 'annual' GROUP BY 1"))
def mean_checks(spark, sf_dir):
    return suite.means_preserved(_summary(spark, sf_dir).where("kind = 'annual'"), K, "1-URGENT", 0.1)


@query(with_(FIELD, "SELECT 'none' AS basin, t, round(avg(value), 6) AS value FROM f GROUP BY 2 UNION ALL SELECT 'south', t, round(avg(value), 6) FROM f JOIN cells USING (cell_id) WHERE lat < -75 GROUP BY 2"))
def basin_or_all(spark, sf_dir):
    f, cells = nation_month_field(spark, sf_dir), nation_cells(spark, sf_dir)
    parts = [frames.mean_over_basin(f, cells.where(where)).select(F.lit(name).alias("basin"), "t", "value") for name, where in (("none", "lat > 0"), ("south", "lat < -75"))]
    return rounded(parts[0].unionByName(parts[1]), 6)
