"""Queries on records that several tasks share: blocks with halos, partial moments, refined percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesforge.functions import kernels
from seriesforge.functions.normal import norm_cdf_sql
from seriesforge.operators import blocks, preprocess, spectral, stats, validation
from seriesforge.plans.relational import K, ORACLE_SQL, query, residuals, rounded
from seriesforge.plans.sql import RESID, SERIES, dft, welch, with_
from seriesforge.plans.synthetic import _model
from seriesforge.sources.frames import region_month_series, table

#: Small enough that the tables' records are cut.
BLOCK = 4096


def adf_sql(ctes: str, source: str, most: int, level: float = 0.05) -> str:
    """Augmented Dickey-Fuller of ``source`` (series_id, t, value) with at most ``most`` lags: regressing out one variable after the other.

    Variables: 0 the constant, 1 to ``most`` the lagged differences, then the level and the difference.
    """
    x, y = most + 1, most + 2

    def steps(start: str, pivots: int, chosen: str = "") -> str:
        """Each step takes variable i out of those behind it (where ``chosen`` says so)."""
        out, was = [], start
        for i in range(pivots):
            now = f"{start}_{i}"
            when = f"CASE WHEN {i} <= m.lag THEN m.v - a.v * b.v / p.v ELSE m.v END" if chosen else "m.v - a.v * b.v / p.v"
            keep = ", m.lag" if chosen else ""
            out.append(
                f"{now} AS MATERIALIZED (SELECT m.series_id, m.a, m.b, {when} AS v{keep} FROM {was} m JOIN {was} p ON p.series_id = m.series_id AND p.a = {i} AND p.b = {i}"
                f" JOIN {was} a ON a.series_id = m.series_id AND a.a = m.a AND a.b = {i} JOIN {was} b ON b.series_id = m.series_id AND b.a = {i} AND b.b = m.b WHERE m.a > {i} AND m.b > {i})"
            )
            was = now
        return ", ".join(out)

    def left_over(table: str) -> str:
        return f"(SELECT series_id, max(CASE WHEN a = {x} AND b = {x} THEN v END) AS xx, max(CASE WHEN a = {x} AND b = {y} THEN v END) AS xy, max(CASE WHEN a = {y} AND b = {y} THEN v END) AS yy FROM {table} GROUP BY 1)"

    scores = " UNION ALL ".join(f"SELECT series_id, {p} AS p, steps * ln((yy - xy * xy / xx) / steps) + 2 * ({p} + 2) AS aic FROM {left_over(f'fm_{p}')} JOIN le USING (series_id) WHERE {p} <= most" for p in range(most + 1))
    polynomial = lambda c: " + ".join(f"({v!r}e0) * pow(stat, {i})" for i, v in enumerate(c))
    z = f"CASE WHEN stat <= {kernels.ADF_STAR!r}e0 THEN {polynomial(kernels.ADF_SMALL)} ELSE {polynomial(kernels.ADF_LARGE)} END"
    p_value = f"CASE WHEN stat > {kernels.ADF_MAX!r}e0 THEN 1e0 WHEN stat < {kernels.ADF_MIN!r}e0 THEN 0e0 ELSE {norm_cdf_sql('z')} END"
    return with_(
        f"""{ctes}, ax AS (SELECT series_id, row_number() OVER w - 1 AS i, value - avg(value) OVER (PARTITION BY series_id) AS x FROM {source} WINDOW w AS (PARTITION BY series_id ORDER BY t)),
le AS (SELECT series_id, n, most, n - 1 - most AS steps FROM (SELECT series_id, count(*) AS n, CAST(least(ceil(12e0 * pow(count(*) / 1e2, 25e-2)), count(*) // 2 - 2) AS BIGINT) AS most FROM ax GROUP BY 1)),
dx AS (SELECT b.series_id, b.i, b.x - a.x AS d FROM ax b JOIN ax a ON a.series_id = b.series_id AND a.i = b.i - 1),
va AS MATERIALIZED (SELECT series_id, i, 0 AS j, 1e0 AS v FROM ax UNION ALL SELECT series_id, i + l AS i, l AS j, d AS v FROM dx, range(1, {most + 1}) q(l) UNION ALL SELECT series_id, i + 1, {x}, x FROM ax UNION ALL SELECT series_id, i, {y}, d FROM dx),
fm AS MATERIALIZED (SELECT p.series_id, p.j AS a, q.j AS b, sum(p.v * q.v) AS v FROM va p JOIN va q ON p.series_id = q.series_id AND p.i = q.i JOIN le ON le.series_id = p.series_id WHERE p.i > most AND p.i < n AND (p.j <= most OR p.j > {most}) AND (q.j <= most OR q.j > {most}) GROUP BY 1, 2, 3),
{steps('fm', most + 1)},
ai AS (SELECT series_id, min(p) AS lag FROM (SELECT *, min(aic) OVER (PARTITION BY series_id) AS least FROM ({scores})) WHERE aic = least GROUP BY 1),
fs AS MATERIALIZED (SELECT p.series_id, p.j AS a, q.j AS b, sum(p.v * q.v) AS v, any_value(lag) AS lag FROM va p JOIN va q ON p.series_id = q.series_id AND p.i = q.i JOIN le ON le.series_id = p.series_id JOIN ai ON ai.series_id = p.series_id WHERE p.i > lag AND p.i < n AND (p.j <= lag OR p.j > {most}) AND (q.j <= lag OR q.j > {most}) GROUP BY 1, 2, 3
  UNION ALL SELECT series_id, j, j, 1e0, lag FROM ai, range(1, {most + 1}) r(j) WHERE j > lag
  UNION ALL SELECT series_id, a, b, 0e0, lag FROM ai, range(0, {y + 1}) r(a), range(0, {y + 1}) s(b) WHERE a != b AND (a BETWEEN lag + 1 AND {most} OR b BETWEEN lag + 1 AND {most})),
{steps('fs', most + 1, 'lag')},
st AS (SELECT series_id, lag, (xy / xx) / sqrt((yy - xy * xy / xx) / (n - 1 - lag - (lag + 2)) / xx) AS stat FROM {left_over(f'fs_{most}')} JOIN ai USING (series_id) JOIN le USING (series_id))""",
        f"SELECT series_id, round(stat, 5) AS statistic, round({p_value}, 5) AS p_value, CAST(lag AS INTEGER) AS lags, {p_value} < {level!r}e0 AS stationary FROM (SELECT *, {z} AS z FROM st)",
    )


@query(adf_sql(RESID, "r", 12))
def adf(spark, sf_dir):
    return rounded(preprocess.stationarity(residuals(spark, sf_dir), K), 5)


DAILY = "da AS (SELECT o_orderpriority AS series_id, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS t, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / 1000e0 AS value FROM orders GROUP BY 1, 2)"


def _daily(spark, sf_dir) -> DataFrame:
    """(series_id, t, value): what was ordered on each day, by priority; days without orders are absent."""
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("long")
    total = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double") / 1000.0
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("series_id"), day.alias("t")).agg(total.alias("value"))


@query(
    f"SELECT series_id, d, round_trip, a.passed AS transform_passed, coverage, mean_variance, b.passed AS synthesis_passed, c.p_value, stationary, a.passed AND b.passed AND stationary AS passed FROM ({ORACLE_SQL['gaussian_checks']}) a JOIN ({ORACLE_SQL['synth_checks']}) b USING (series_id) JOIN ({ORACLE_SQL['adf']}) c USING (series_id)"
)
def generator_checks(spark, sf_dir):
    return rounded(validation.validate_generator(_model(spark, sf_dir)), 6, p_value=5)


@query(adf_sql(DAILY, "da", 27))
def adf_daily(spark, sf_dir):
    """Some 2,400 steps and 27 lags, in blocks."""
    return rounded(blocks.adf(_daily(spark, sf_dir), K, block=512), 5)


def _acf_sql(ctes: str, source: str, lags: int) -> str:
    return with_(
        f"{ctes}, ac AS (SELECT series_id, t, value - avg(value) OVER (PARTITION BY series_id) AS x FROM {source}), al AS (SELECT series_id, sum(x * x) AS v FROM ac GROUP BY 1), sh AS MATERIALIZED (SELECT series_id, lag, t + lag AS t, x FROM ac CROSS JOIN range(0, {lags + 1}) l(lag))",
        f"SELECT a.series_id, CAST(lag AS INTEGER) AS lag, round(sum(a.x * b.x) / any_value(v), 6) + 0e0 AS acf FROM sh a JOIN ac b ON a.series_id = b.series_id AND a.t = b.t JOIN al ON al.series_id = a.series_id GROUP BY 1, 2",
    )


@query(_acf_sql(RESID, "r", 79))
def autocorrelation_all_lags(spark, sf_dir):
    return rounded(stats.autocorrelation(residuals(spark, sf_dir), K, 79), 6)


@query(_acf_sql(DAILY, "da", 730))
def autocorrelation_daily(spark, sf_dir):
    """Two years of lags over days with gaps, in blocks."""
    return rounded(blocks.autocorrelation(_daily(spark, sf_dir), K, 730, block=1), 6)


LINES = "li AS (SELECT l_linestatus AS series_id, row_number() OVER (PARTITION BY l_linestatus ORDER BY l_orderkey, l_linenumber, l_extendedprice) - 1 AS t, l_extendedprice / 1000e0 AS value FROM lineitem)"


def _lines(spark, sf_dir) -> DataFrame:
    """(series_id, t, value): two records that hold all lines; t grows by order and line and has gaps."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("series_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("t"), (F.col("l_extendedprice") / 1000.0).alias("value"))


@query(with_(welch("li", LINES, 60), "SELECT series_id, k, round(freq, 8) AS freq, round(psd, 4) AS psd, n_segments FROM wp"))
def welch_long_record(spark, sf_dir):
    return rounded(blocks.welch(_lines(spark, sf_dir), K, 60, block=BLOCK), 4, freq=8)


@query("SELECT l_returnflag, p, round(quantile_cont(l_extendedprice, p), 4) AS value FROM lineitem CROSS JOIN (VALUES (0e0), (1e-2), (16e-2), (5e-1), (84e-2), (95e-2), (1e0)) q(p) GROUP BY 1, 2".replace("quantile_cont(l_extendedprice, p)", "CASE p " + " ".join(f"WHEN {p} THEN quantile_cont(l_extendedprice, {p})" for p in ("0e0", "1e-2", "16e-2", "5e-1", "84e-2", "95e-2", "1e0")) + " END"))
def exact_percentiles(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice")
    return rounded(stats.refined_percentiles(rows, ["l_returnflag"], "l_extendedprice", [0.0, 0.01, 0.16, 0.5, 0.84, 0.95, 1.0], accuracy=500))


def _cubic_sql(degree: int = 3) -> str:
    """Normal equations in u = t / 40 - 1, solved by elimination in rows."""
    n = degree + 1
    sums = ", ".join([*(f"sum(pow(u, {i})) AS s{i}" for i in range(2 * degree + 1)), *(f"sum(pow(u, {i}) * value) AS y{i}" for i in range(n))])
    ctes, cells = [f"{SERIES.strip()}, ma AS (SELECT series_id, {sums} FROM (SELECT series_id, t / 40e0 - 1 AS u, value FROM s) GROUP BY 1)"], {(i, j): f"s{i + j}" for i in range(n) for j in range(n)} | {(i, n): f"y{i}" for i in range(n)}
    ctes.append("g0 AS (SELECT series_id, " + ", ".join(f"{v} AS m{i}_{j}" for (i, j), v in cells.items()) + " FROM ma)")
    for k in range(n):
        pick = ", ".join(f"m{i}_{j} / m{k}_{k} AS m{i}_{j}" if i == k else f"m{i}_{j} - m{i}_{k} * m{k}_{j} / m{k}_{k} AS m{i}_{j}" for i in range(n) for j in range(n + 1))
        ctes.append(f"g{k + 1} AS (SELECT series_id, {pick} FROM g{k})")
    return with_(", ".join(ctes), f"SELECT s.series_id, t, round({' + '.join(f'm{i}_{n} * pow(t / 40e0 - 1, {i})' for i in range(n))}, 4) AS fitted FROM s JOIN g{n} USING (series_id)")


@query(_cubic_sql())
def cubic_trend(spark, sf_dir):
    """Values of the fitted third-degree polynomial of each series."""
    s = region_month_series(spark, sf_dir)
    fitted = s.join(preprocess.fit_polynomial(s, K, 3), K)
    value = F.aggregate("coefficients", F.lit(0.0), lambda total, c: total * F.col("t") + c)
    return rounded(fitted.select("series_id", "t", value.alias("fitted")))


# --- many series and long ones


def _line_series(spark, sf_dir, key: str, count: int) -> DataFrame:
    """(series_id, t, value): the lines of a part or supplier in the order of their shipment."""
    from pyspark.sql import Window

    lines = table(spark, sf_dir, "lineitem").select((F.col(key) % count).alias("series_id"), "l_shipdate", "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("value"))
    order = Window.partitionBy("series_id").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "value")
    return lines.select("series_id", (F.row_number().over(order) - 1).alias("t"), "value")


def _line_sql(key: str, count: int) -> str:
    order = "PARTITION BY l_{0} % {1} ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice".format(key, count)
    return f"ls AS (SELECT l_{key} % {count} AS series_id, row_number() OVER ({order}) - 1 AS t, l_extendedprice AS value, count(*) OVER (PARTITION BY l_{key} % {count}) AS n FROM lineitem)"


ANY_WELCH = f"""{_line_sql('partkey', 10_000)}, lw AS (SELECT *, least({24}, n) AS p, least({24}, n) - least({24}, n) // 2 AS hop FROM ls),
lg AS (SELECT *, t - segment * hop AS j FROM (SELECT *, unnest(range(0, (n - p) // hop + 1)) AS segment FROM lw) WHERE t BETWEEN segment * hop AND segment * hop + p - 1),
lt AS (SELECT series_id, segment, p, j, (value - avg(value) OVER (PARTITION BY series_id, segment)) * (5e-1 - 5e-1 * cos(6.283185307179586e0 * j / p)) AS x FROM lg),
lp AS (SELECT series_id, segment, p, k, pow(sum(x * cos(6.283185307179586e0 * ((k * j) % p) / p)), 2) + pow(sum(x * sin(6.283185307179586e0 * ((k * j) % p) / p)), 2) AS power FROM (SELECT *, unnest(range(0, p // 2 + 1)) AS k FROM lt) GROUP BY 1, 2, 3, 4),
ln2 AS (SELECT p, sum(pow(5e-1 - 5e-1 * cos(6.283185307179586e0 * i / p), 2)) AS energy FROM (SELECT DISTINCT p FROM lw), range(0, 24) q(i) WHERE i < p GROUP BY 1)"""


@query(with_(ANY_WELCH, "SELECT series_id, k, round(k * (12e0 / p), 8) AS freq, round(avg(power * CASE WHEN k = 0 OR 2 * k = p THEN 1e0 ELSE 2e0 END) / (12e0 * any_value(energy)), 0) + 0e0 AS psd, count(*) AS n_segments FROM lp JOIN ln2 USING (p) WHERE p > 1 GROUP BY 1, 2, p"))
def welch_many_series(spark, sf_dir):
    """Thousands of series of some sixty steps at sf0.1; those of one step hold no spectrum."""
    psd = spectral.welch(_line_series(spark, sf_dir, "l_partkey", 10_000), K, 24)
    return rounded(psd.where("not isnan(psd)"), 0, freq=8)


@query()
def multitaper_long_series(spark, sf_dir):
    """Fifty series, of twelve thousand steps at sf0.1."""
    return spectral.multitaper(_line_series(spark, sf_dir, "l_suppkey", 50), K)


@query(with_(_line_sql("suppkey", 50) + ", lc AS (SELECT series_id, t AS j, value - avg(value) OVER (PARTITION BY series_id) AS x, n AS len FROM ls)", f"SELECT series_id, k, round(k * 12e0 / n, 8) AS freq, round(CASE WHEN k = 0 OR k = n // 2 THEN 1e0 ELSE 2e0 END * power / (12e0 * n), 0) + 0e0 AS psd FROM {dft('lc', 'series_id', 'len')}"))
def periodogram_long_series(spark, sf_dir):
    return rounded(spectral.periodogram(_line_series(spark, sf_dir, "l_suppkey", 50), K), 0, freq=8)
