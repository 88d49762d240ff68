"""Monte-Carlo queries: surrogates drawn by counters, so that SQL draws the same ones."""

from __future__ import annotations

import numpy as np

from seriesforge.functions import kernels, philox
from seriesforge.operators import significance
from seriesforge.plans import suite
from seriesforge.plans.grids import NORTH, eofs_sql
from seriesforge.plans.relational import K, query, residuals, rounded
from seriesforge.plans.spectra import _field_residuals
from seriesforge.plans.sql import RESID, TWO_PI, dft, with_
from seriesforge.sources.frames import nation_cells

SURROGATES = 500


def tests_sql(ctes: str, source: str, n: int = 80, seed: int = 0) -> str:
    """CTEs up to ``te`` (series_id, band, null, observed, share_pct, median, p95, percentile) of ``source`` (series_id, t, value), records of n steps."""
    bands = ", ".join(f"('{name}', {1 / high!r}e0, {1 / low!r}e0)" for name, (low, high) in significance.BANDS.items())
    tapers = ", ".join(f"({i}, {j}, {float(v)!r}::DOUBLE)" for i, row in enumerate(kernels.dpss(n, 1.5, 2)) for j, v in enumerate(row))
    first = philox.uniform_sql(f"(SELECT series_id, nul, surrogate, j, {philox.key_sql(chr(39) + chr(39) + ' || nul || ' + chr(39) + '|' + chr(39) + ' || series_id', seed)} AS key FROM (SELECT DISTINCT series_id FROM sx), (VALUES ('white'), ('ar1')) v(nul), range(0, {SURROGATES}) q(surrogate), range(0, {n}) p(j))", "series_id, nul, surrogate, j, key", "u0", "2 * j", "surrogate", "key")
    second = philox.uniform_sql(first, "series_id, nul, surrogate, j, key, u0", "u1", "2 * j + 1", "surrogate", "key")

    def powers(points: str, by: str) -> str:
        """Multitaper power in each band, and over all bins, from records without their mean."""
        return f"""(SELECT {by}, band, sum(CASE WHEN k * (12e0 / {n}) BETWEEN lo AND hi THEN psd ELSE 0e0 END) * (12e0 / {n}) AS v, sum(psd) * (12e0 / {n}) AS total FROM (
  SELECT {by}, k, avg(power * CASE WHEN k = 0 OR k = {n // 2} THEN 1e0 ELSE 2e0 END) / 12e0 AS psd FROM {dft(f'(SELECT {by}, taper, p.j, x * w AS x FROM {points} p JOIN tp ON tp.j = p.j)', f'{by}, taper', str(n))} GROUP BY {by}, k), ba GROUP BY {by}, band)"""

    return f"""{ctes}, sx AS (SELECT CAST(series_id AS VARCHAR) AS series_id, CAST(t AS BIGINT) AS t, value FROM {source}), ba(band, lo, hi) AS (VALUES {bands}), tp(taper, j, w) AS (VALUES {tapers}),
sp AS (SELECT series_id, stddev_pop(value) AS sd, least(greatest(corr(value, y), -99e-2), 99e-2) AS phi FROM (SELECT *, lead(value) OVER (PARTITION BY series_id ORDER BY t) AS y FROM sx) GROUP BY 1),
dr AS MATERIALIZED (SELECT series_id, nul, surrogate, j, sqrt(-2e0 * ln(u0)) * cos({TWO_PI} * u1) AS e FROM {second}),
su AS MATERIALIZED (SELECT series_id, nul, surrogate, j, e * sd AS x FROM dr JOIN sp USING (series_id) WHERE nul = 'white'
  UNION ALL SELECT series_id, nul, surrogate, i AS j, sum(pow(phi, i - j) * e * sd * sqrt(greatest(1 - phi * phi, 1e-12))) AS x FROM dr JOIN sp USING (series_id), range(1, {n}) q(i) WHERE nul = 'ar1' AND j BETWEEN 1 AND i GROUP BY 1, 2, 3, 4
  UNION ALL SELECT series_id, nul, surrogate, 0, 0e0 FROM dr WHERE nul = 'ar1' AND j = 0),
sc AS (SELECT series_id, nul, surrogate, CAST(j AS BIGINT) AS j, x - avg(x) OVER (PARTITION BY series_id, nul, surrogate) AS x FROM su),
sv AS {powers('sc', 'series_id, nul, surrogate')},
oc AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS j, value - avg(value) OVER (PARTITION BY series_id) AS x FROM sx),
ov AS {powers('oc', 'series_id')},
te AS (SELECT sv.series_id, band, nul AS "null", any_value(ov.v) AS observed, any_value(100 * ov.v / ov.total) AS share_pct, quantile_cont(sv.v, 5e-1) AS median, quantile_cont(sv.v, 95e-2) AS p95, 100 * avg(CASE WHEN sv.v < ov.v THEN 1e0 ELSE 0e0 END) AS percentile FROM sv JOIN ov USING (series_id, band) GROUP BY 1, 2, 3)"""


def survey_sql(ctes: str, source: str) -> str:
    """CTEs up to ``sy``: one row per series from its tests."""
    white = {b: 2 * significance.white_expectation_pct(*r) for b, r in significance.BANDS.items()}
    pick = ", ".join([*(f"max(CASE WHEN band = '{b}' AND \"null\" = '{n}' THEN percentile END) AS {b}_p_{n}" for b in significance.BANDS for n in significance.NULLS), *(f"max(CASE WHEN band = '{b}' AND \"null\" = 'white' THEN share_pct END) AS {b}_pct" for b in significance.BANDS)])
    structured = " OR ".join(f"({b}_pct >= {w!r}e0 AND {b}_p_ar1 >= 95)" for b, w in white.items())
    red = " OR ".join(["abs(phi) >= 2e-1", *(f"({b}_pct >= {w!r}e0 AND {b}_p_white >= 95)" for b, w in white.items())])
    return f"""{tests_sql(ctes, source)}, wi AS (SELECT series_id, {pick} FROM te GROUP BY 1),
mo AS (SELECT series_id, count(*) AS n_obs, avg(value) AS mean, stddev_pop(value) AS std, var_pop(value) AS resid_var FROM sx GROUP BY 1),
sy AS (SELECT *, CASE WHEN phi > 0 AND phi < 1 THEN -1 / ln(abs(phi)) ELSE 0e0 END AS efold_months, CASE WHEN {structured} THEN 'band-structured' WHEN {red} THEN 'red' ELSE 'white' END AS verdict FROM wi JOIN mo USING (series_id) JOIN sp USING (series_id))"""


@query(with_(tests_sql(RESID, "r"), 'SELECT series_id, band, "null", round(observed, 2) AS observed, round(share_pct, 5) AS share_pct, round(median, 2) AS median, round(p95, 2) AS p95, round(percentile, 5) AS percentile FROM te'))
def monte_carlo(spark, sf_dir):
    return rounded(significance.monte_carlo(residuals(spark, sf_dir), K, n_surrogates=SURROGATES), 2, share_pct=5, percentile=5)


PERCENTILES = ", ".join(f"round({b}_p_{n}, 5) AS {b}_p_{n}" for b in significance.BANDS for n in significance.NULLS)


@query(with_(survey_sql(RESID, "r"), f"SELECT series_id, n_obs, round(mean, 4) + 0e0 AS mean, round(std, 4) AS std, round(resid_var, 2) AS resid_var, round(phi, 5) AS phi, round(efold_months, 5) AS efold_months, {PERCENTILES}, round(decadal_pct, 5) AS decadal_pct, round(annual_pct, 5) AS annual_pct, verdict FROM sy"))
def survey(spark, sf_dir):
    return rounded(significance.survey(residuals(spark, sf_dir), K, SURROGATES), 5, mean=4, std=4, resid_var=2)


@query(with_(survey_sql(eofs_sql(3) + NORTH, "(SELECT CAST(mode AS VARCHAR) AS series_id, t, value FROM pj)"), "SELECT CAST(mode AS INTEGER) AS mode, round(phi, 5) AS phi, round(decadal_pct, 5) AS decadal_pct, round(annual_pct, 5) AS annual_pct, verdict, round(lam / total, 6) AS expvar, gap > error AS separable FROM nr JOIN sy ON CAST(nr.mode AS VARCHAR) = series_id, tl"))
def component_survey(spark, sf_dir):
    return rounded(suite.component_survey(_field_residuals(spark, sf_dir), nation_cells(spark, sf_dir), 3, SURROGATES), 5, expvar=6)
