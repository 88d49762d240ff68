"""Queries on decomposition, ranks, spectra, bands, synthesis and fields."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from seriesforge.functions import kernels
from seriesforge.functions.normal import norm_cdf_sql, norm_ppf_sql
from seriesforge.operators import bands, field, gaussian, preprocess, significance, spectral, stats, synthesis, validation
from seriesforge.plans import suite
from seriesforge.plans.experiments import Experiment
from seriesforge.plans.relational import ORACLE_SQL, QUERIES, K, query, residuals, rounded
from seriesforge.plans.sql import FIELD, PERIODOGRAM, RANKED, RESID, SERIES, TWO_PI, dft, welch, with_
from seriesforge.sources.frames import nation_cells, nation_month_field, region_month_series
from seriesforge.sources.intermediate import written

__all__ = ["QUERIES", "ORACLE_SQL"]
NPERSEG = 24


# --- decomposition


@query(with_(RESID, "SELECT series_id, round(slope, 7) AS slope, round(intercept, 3) AS intercept FROM tr"))
def trend_fit(spark, sf_dir):
    return rounded(preprocess.fit_trend(region_month_series(spark, sf_dir), K), slope=7, intercept=3)


@query(with_(RESID, "SELECT DISTINCT series_id, month AS phase, round(season, 4) AS season FROM r"))
def climatology(spark, sf_dir):
    return rounded(preprocess.fit(region_month_series(spark, sf_dir), K).season)


@query(with_(RESID, "SELECT series_id, ts, t, month, round(value, 4) AS value FROM r"))
def residual_series(spark, sf_dir):
    return rounded(residuals(spark, sf_dir))


@query(with_(SERIES, "SELECT series_id, t, round(value, 6) AS value FROM s"))
def inverse_roundtrip(spark, sf_dir):
    s = region_month_series(spark, sf_dir)
    model = preprocess.fit(s, K)
    return rounded(preprocess.inverse_transform(preprocess.transform(s, model), model, add_trend=True).select("series_id", "t", "value"), 6)


@query(with_(RESID, "SELECT series_id, t, round(value + 2e0 * season, 4) AS value FROM r"))
def seasonal_rescale(spark, sf_dir):
    s = region_month_series(spark, sf_dir)
    model = preprocess.fit(s, K)
    return rounded(preprocess.inverse_transform(preprocess.transform(s, model), model, season_scale=2.0).select("series_id", "t", "value"))


@query(
    with_(
        SERIES
        + ", c AS (SELECT *, value - avg(value) OVER (PARTITION BY series_id) AS cv FROM s), l AS (SELECT series_id, regr_slope(cv, t) AS a, regr_intercept(cv, t) AS b FROM c GROUP BY 1), e AS (SELECT c.series_id, c.t, cv - (a * t + b) AS v FROM c JOIN l USING (series_id)), q AS (SELECT *, avg(v) OVER (PARTITION BY series_id, t % 12) AS m FROM e), z AS (SELECT series_id, avg(m) AS mm FROM (SELECT DISTINCT series_id, t % 12, m FROM q) GROUP BY 1)",
        "SELECT series_id, t, round(v - (m - mm), 4) AS value FROM q JOIN z USING (series_id)",
    )
)
def diag_preprocess(spark, sf_dir):
    s = written(region_month_series(spark, sf_dir), "series")  # read a dozen times
    model = preprocess.fit(s, K, preprocess.STEP, centre=True, positional=True, recentre_season=True)
    return rounded(preprocess.transform(s, model).select("series_id", "t", "value"))


@query(with_(RESID + ", a AS (SELECT series_id, month, avg(value) AS v FROM s GROUP BY 1, 2), o AS (SELECT series_id, month, avg(value) AS v FROM s WHERE t < 40 GROUP BY 1, 2)", "SELECT series_id, round(sqrt(avg(pow(a.v - o.v, 2))), 4) AS rms FROM a JOIN o USING (series_id, month) GROUP BY 1"))
def seasonal_rmse(spark, sf_dir):
    s = region_month_series(spark, sf_dir)
    a, o = validation.monthly_mean(s, K), validation.monthly_mean(s.where("t < 40"), K).withColumnRenamed("v", "_o")
    return rounded(stats.rms_difference(a.join(o, ["series_id", "month"]), K, F.col("v"), F.col("_o")))


@query(
    with_(
        SERIES + ", gap AS (SELECT series_id, t, CASE WHEN t % 7 NOT IN (3, 4) THEN value END AS v FROM s), e AS (SELECT series_id, t, v, max(CASE WHEN v IS NOT NULL THEN t END) OVER (PARTITION BY series_id ORDER BY t) AS ta, min(CASE WHEN v IS NOT NULL THEN t END) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS tb FROM gap)",
        "SELECT e.series_id, e.t, round(coalesce(e.v, a.v + (e.t - ta) * (z.v - a.v) / (tb - ta), a.v, z.v), 6) AS value FROM e LEFT JOIN gap a ON a.series_id = e.series_id AND a.t = ta LEFT JOIN gap z ON z.series_id = e.series_id AND z.t = tb",
    )
)
def fill_gaps(spark, sf_dir):
    s = region_month_series(spark, sf_dir).withColumn("value", F.when(~(F.col("t") % 7).isin(3, 4), F.col("value")))
    return rounded(preprocess.fill_gaps(s, K).select("series_id", "t", "value"), 6)


# --- ranks and quantiles


@query(with_(RANKED, "SELECT series_id, t, rank, round(p, 8) AS p FROM hp"))
def hazen_rank(spark, sf_dir):
    return rounded(gaussian.hazen(residuals(spark, sf_dir), K).select("series_id", "t", "rank", "p"), 8)


@query(with_(RANKED, "SELECT series_id, t, round(g, 6) AS g FROM g"))
def gaussianize(spark, sf_dir):
    return rounded(gaussian.gaussianize(residuals(spark, sf_dir), K).select("series_id", "t", "g"), 6)


TAIL = f"""{RANKED}, q AS (SELECT series_id, max(n) AS n, avg(value) AS loc, stddev_pop(value) AS scale, min(value) AS lo, max(value) AS hi FROM hp GROUP BY 1),
q2 AS (SELECT *, 5e-1 / n AS p1, (n - 5e-1) / n AS pn FROM q),
tail AS (SELECT series_id, n, loc, scale, lo - (loc + scale * ({norm_ppf_sql('p1')})) AS low_offset, hi - (loc + scale * ({norm_ppf_sql('pn')})) AS high_offset FROM q2)"""


@query(with_(TAIL, "SELECT series_id, n, round(loc, 4) + 0e0 AS loc, round(scale, 4) AS scale, round(low_offset, 4) AS low_offset, round(high_offset, 4) AS high_offset FROM tail"))
def quantile_tail(spark, sf_dir):
    return rounded(gaussian.fit_quantiles(residuals(spark, sf_dir), K).tail)


@query(with_(RANKED, "SELECT series_id, rank AS i, round(p, 8) AS p, round(value, 4) AS x FROM hp"))
def quantile_knots(spark, sf_dir):
    return rounded(gaussian.fit_quantiles(residuals(spark, sf_dir), K).knots.select("series_id", "i", "p", "x"), p=8)


INVERSE = f"""{TAIL}, sc AS (SELECT series_id, t, 3e0 * sin(t * 7e-1) AS g FROM s),
u0 AS (SELECT series_id, t, greatest(least({norm_cdf_sql('g')}, 1e0 - 1e-15), 1e-15) AS u FROM sc),
u1 AS (SELECT u0.*, n, loc, scale, low_offset, high_offset, u * n + 5e-1 AS place FROM u0 JOIN tail USING (series_id)),
u2 AS (SELECT *, CAST(least(greatest(floor(place), 1), n) AS BIGINT) AS i FROM u1),
kn AS (SELECT series_id, rank AS i, value AS x, lead(value) OVER (PARTITION BY series_id ORDER BY rank) AS x_next FROM hp)"""


@query(
    with_(
        INVERSE,
        f"SELECT series_id, t, round(CASE WHEN place < 1 THEN loc + scale * ({norm_ppf_sql('u')}) + low_offset WHEN place > n THEN loc + scale * ({norm_ppf_sql('u')}) + high_offset ELSE x + (place - i) * (coalesce(x_next, x) - x) END, 3) AS value FROM u2 JOIN kn USING (series_id, i)",
    )
)
def inverse_cdf(spark, sf_dir):
    r = residuals(spark, sf_dir)
    scores = r.select("series_id", "t", (F.sin(F.col("t") * 0.7) * 3.0).alias("g"))
    return rounded(gaussian.inverse_gaussianize(scores, gaussian.fit_quantiles(r, K)).select("series_id", "t", "value"), 3)


@query(with_(INVERSE, "SELECT series_id, t, round(x + (place - i) * (coalesce(x_next, x) - x), 3) AS value FROM (SELECT series_id, t, least(greatest(place, 1e0), n) AS place, i FROM u2) JOIN kn USING (series_id, i)"))
def empirical_inverse_cdf(spark, sf_dir):
    r = residuals(spark, sf_dir)
    scores = r.select("series_id", "t", (F.sin(F.col("t") * 0.7) * 3.0).alias("g"))
    return rounded(gaussian.empirical_inverse(scores, gaussian.fit_quantiles(r, K)).select("series_id", "t", "value"), 3)


@query(with_(RANKED + f", z AS (SELECT series_id, rank, n, {norm_cdf_sql('g')} AS f FROM g)", "SELECT series_id, max(n) AS n, round(max(greatest(abs(rank / CAST(n AS DOUBLE) - f), abs((rank - 1) / CAST(n AS DOUBLE) - f))), 7) AS d FROM z GROUP BY 1"))
def ks_normal(spark, sf_dir):
    return rounded(gaussian.ks_normal(gaussian.gaussianize(residuals(spark, sf_dir), K).select("series_id", "t", "g"), K).drop("p_value"), 7)


@query(
    with_(
        RESID + ", c AS (SELECT series_id, value, sum(CAST(t < 40 AS INTEGER)) AS a, sum(CAST(t >= 40 AS INTEGER)) AS b2 FROM r GROUP BY 1, 2), e AS (SELECT series_id, sum(a) OVER w / sum(a) OVER (PARTITION BY series_id) AS fa, sum(b2) OVER w / sum(b2) OVER (PARTITION BY series_id) AS fb, a, b2 FROM c WINDOW w AS (PARTITION BY series_id ORDER BY value))",
        "SELECT series_id, round(max(abs(fa - fb)), 8) AS d, CAST(sum(a) AS BIGINT) AS n_first, CAST(sum(b2) AS BIGINT) AS n_second FROM e GROUP BY 1",
    )
)
def ks_two_sample(spark, sf_dir):
    r = residuals(spark, sf_dir).withColumn("second", (F.col("t") >= 40).cast("int"))
    return rounded(gaussian.ks_two_sample(r, K), 8)


CHECKS = f"""{TAIL}, sc AS (SELECT series_id, t, g, value AS original FROM g), u1 AS (SELECT sc.*, n, loc, scale, low_offset, high_offset, u * n + 5e-1 AS place FROM (SELECT *, greatest(least({norm_cdf_sql('g')}, 1e0 - 1e-15), 1e-15) AS u FROM sc) sc JOIN tail USING (series_id)),
u2 AS (SELECT *, CAST(least(greatest(floor(place), 1), n) AS BIGINT) AS i FROM u1), kn AS (SELECT series_id, rank AS i, value AS x, lead(value) OVER (PARTITION BY series_id ORDER BY rank) AS x_next FROM hp),
bk AS (SELECT series_id, original, g, CASE WHEN place < 1 THEN loc + scale * ({norm_ppf_sql('u')}) + low_offset WHEN place > n THEN loc + scale * ({norm_ppf_sql('u')}) + high_offset ELSE x + (place - i) * (coalesce(x_next, x) - x) END AS value FROM u2 JOIN kn USING (series_id, i)),
tr2 AS (SELECT series_id, max(abs(value - original)) AS round_trip, avg(g) AS g_mean, stddev_pop(g) AS g_std FROM bk GROUP BY 1),
sp AS (SELECT q2.series_id, abs(abs(tail.loc + tail.scale * ({norm_ppf_sql('p1')}) + low_offset) - abs(lo)) AS splice_gap FROM q2 JOIN tail USING (series_id)),
ks AS (SELECT series_id, max(n) AS n, max(greatest(abs(rank / CAST(n AS DOUBLE) - f), abs((rank - 1) / CAST(n AS DOUBLE) - f))) AS d FROM (SELECT series_id, rank, n, {norm_cdf_sql('g')} AS f FROM g) GROUP BY 1),
kp AS (SELECT *, CASE WHEN sqrt(n) * d < 2e-1 THEN 1e0 ELSE least(greatest(list_sum(list_transform(range(1, 40), lambda k: 2e0 * pow(-1, k - 1) * exp(-2e0 * k * k * n * d * d))), 0e0), 1e0) END AS p_value FROM ks)"""


@query(with_(CHECKS, "SELECT series_id, n, round(d, 6) AS d, round(p_value, 6) AS p_value, round(round_trip, 6) AS round_trip, round(g_mean, 6) + 0e0 AS g_mean, round(g_std, 6) AS g_std, round(splice_gap, 6) AS splice_gap, p_value > 5e-2 AND abs(g_mean) < 5e-2 AND abs(g_std - 1) < 5e-2 AND splice_gap < 1e-6 AS passed FROM kp JOIN tr2 USING (series_id) JOIN sp USING (series_id)"))
def gaussian_checks(spark, sf_dir):
    return rounded(gaussian.validate_transform(residuals(spark, sf_dir), K), 6)


# --- spectra


@query(with_(PERIODOGRAM, "SELECT series_id, k, round(freq, 8) AS freq, round(psd, 2) AS psd FROM pg"))
def periodogram(spark, sf_dir):
    return rounded(spectral.periodogram(residuals(spark, sf_dir), K), 2, freq=8)


WELCH_R = welch("r", RESID, NPERSEG)
WELCH_G = welch("(SELECT series_id, t, g AS value FROM g)", RANKED, NPERSEG)


@query(with_(WELCH_R, "SELECT series_id, k, round(freq, 8) AS freq, round(psd, 2) AS psd, n_segments FROM wp"))
def welch_psd(spark, sf_dir):
    return rounded(spectral.welch(residuals(spark, sf_dir), K, NPERSEG), 2, freq=8)


def _bounds_sql() -> str:
    n = spectral.segment_count(80, NPERSEG)
    hi, lo = kernels.chi2_ppf(0.975, 2 * n), kernels.chi2_ppf(0.025, 2 * n)
    return with_(WELCH_R, f"SELECT series_id, k, round(psd, 2) AS psd, round(psd * 2 * n_segments / {hi!r}e0, 2) AS ci_lower, round(psd * 2 * n_segments / {lo!r}e0, 2) AS ci_upper FROM wp")


@query(_bounds_sql())
def welch_ci(spark, sf_dir):
    return rounded(spectral.welch(residuals(spark, sf_dir), K, NPERSEG, alpha=0.05).select("series_id", "k", "psd", "ci_lower", "ci_upper"), 2)


def _multitaper_sql(n: int = 80) -> str:
    rows = ", ".join(f"({i}, {j}, {float(v)!r}::DOUBLE)" for i, row in enumerate(kernels.dpss(n, 1.5, 2)) for j, v in enumerate(row))
    ctes = f"""{PERIODOGRAM}, tp(taper, j, w) AS (VALUES {rows}), mt AS (SELECT series_id, taper, pc.j, x * w AS x FROM pc JOIN tp USING (j)),
mp AS (SELECT series_id, k, k * (12e0 / {n}) AS freq, avg(power * CASE WHEN k = 0 OR k = {n // 2} THEN 1e0 ELSE 2e0 END) / 12e0 AS psd FROM {dft('mt', 'series_id, taper', str(n))} GROUP BY 1, 2)"""
    return with_(ctes, "SELECT series_id, k, round(freq, 8) AS freq, round(psd, 2) AS psd FROM mp")


@query(_multitaper_sql())
def multitaper(spark, sf_dir):
    return rounded(spectral.multitaper(residuals(spark, sf_dir), K), 2, freq=8)


@query(with_(PERIODOGRAM, f"SELECT series_id, round(sum(CASE WHEN freq BETWEEN {1 / 1.5!r}e0 AND {1 / 0.8!r}e0 THEN psd ELSE 0e0 END) * max(CASE WHEN k = 1 THEN freq END), 3) AS variance, count(*) FILTER (freq BETWEEN {1 / 1.5!r}e0 AND {1 / 0.8!r}e0) AS n_bins FROM pg GROUP BY 1"))
def band_variance(spark, sf_dir):
    return rounded(spectral.band_variance(spectral.periodogram(residuals(spark, sf_dir), K), K, 0.8, 1.5), 3)


@query(with_(PERIODOGRAM + ", vv AS (SELECT series_id, var_pop(value) AS v FROM r GROUP BY 1)", "SELECT series_id, round(sum(psd) * max(CASE WHEN k = 1 THEN freq END) / any_value(v), 6) AS share FROM pg JOIN vv USING (series_id) GROUP BY 1"))
def parseval(spark, sf_dir):
    r = residuals(spark, sf_dir)
    return rounded(spectral.parseval(spectral.periodogram(r, K), r, K), 6)


@query(with_(PERIODOGRAM, "SELECT series_id, k, round(freq, 8) AS freq, round(psd, 2) AS psd FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY abs(freq - 1), k) AS i FROM pg) WHERE i = 1"))
def nearest_frequency(spark, sf_dir):
    return rounded(spectral.nearest(spectral.periodogram(residuals(spark, sf_dir), K), K, 1.0), 2, freq=8)


INTERPOLATED = f"""{WELCH_G}, gr AS (SELECT DISTINCT series_id, unnest(range(0, 601)) AS ko FROM wp), ga AS (SELECT series_id, ko, ko * 1e-2 AS freq, least(ko * 1e-2 / 5e-1, {NPERSEG // 2}e0) AS pos FROM gr),
gi AS (SELECT *, CAST(least(floor(pos), {NPERSEG // 2 - 1}) AS BIGINT) AS k FROM ga),
ip AS (SELECT gi.series_id, ko AS k, gi.freq, (a.psd + (pos - gi.k) * (z.psd - a.psd)) * CASE WHEN gi.freq BETWEEN {1 / 1.5!r}e0 AND {1 / 0.8!r}e0 THEN 10e0 ELSE 1e0 END * CASE WHEN gi.freq BETWEEN 5e-1 AND 1e0 THEN 2e0 ELSE 1e0 END AS psd
       FROM gi JOIN wp a ON a.series_id = gi.series_id AND a.k = gi.k JOIN wp z ON z.series_id = gi.series_id AND z.k = gi.k + 1)"""


def _interpolated(spark, sf_dir):
    scores = gaussian.gaussianize(residuals(spark, sf_dir), K).select("series_id", "t", F.col("g").alias("value"))
    return spectral.interpolate_psd(spectral.welch(scores, K, NPERSEG), K, 1200, 12.0, [(0.8, 1.5, 10.0), (1.0, 2.0, 2.0)])


@query(with_(INTERPOLATED, "SELECT series_id, k, round(freq, 6) AS freq, round(psd, 6) AS psd FROM ip"))
def interp_psd(spark, sf_dir):
    return rounded(_interpolated(spark, sf_dir), 6)


@query(with_(INTERPOLATED, "SELECT series_id, k, round(CASE WHEN k = 0 THEN 0e0 ELSE sqrt(psd * 7200e0) END, 5) AS amplitude FROM ip"))
def spectral_amplitudes(spark, sf_dir):
    return rounded(spectral.amplitudes(_interpolated(spark, sf_dir), 1200).select("series_id", "k", "amplitude"), 5)


BAND_ROWS = ", ".join(f"({i}, {a!r}e0, {b!r}e0)" for i, (a, b) in enumerate(list(zip(bands.PERIOD_EDGES[:-1], bands.PERIOD_EDGES[1:]))[::-1]))
SHARES = f"""{PERIODOGRAM}, bt(band, low, high) AS (VALUES {BAND_ROWS}), al AS (SELECT series_id, max(CASE WHEN k = 1 THEN freq END) AS df, sum(CASE WHEN k > 0 THEN psd END) AS total FROM pg GROUP BY 1),
sh AS (SELECT al.series_id, bt.band, bt.low, bt.high, count(pg.k) AS n_bins, coalesce(sum(psd), 0e0) * any_value(df) AS variance, coalesce(sum(psd), 0e0) / any_value(total) AS variance_frac
  FROM al CROSS JOIN bt LEFT JOIN pg ON pg.series_id = al.series_id AND pg.k > 0 AND freq >= 1 / high AND freq < 1 / low GROUP BY 1, 2, 3, 4)"""


def _shares(spark, sf_dir):
    return bands.variance_by_band(spectral.periodogram(residuals(spark, sf_dir), K), K, bands.band_table(spark))


@query(with_(SHARES, "SELECT series_id, CAST(band AS INTEGER) AS band, low, high, n_bins, round(variance, 3) AS variance, round(variance_frac, 6) AS variance_frac, round(sum(variance_frac) OVER (PARTITION BY series_id ORDER BY band), 6) AS cumulative_frac FROM sh"))
def band_fractions(spark, sf_dir):
    return rounded(_shares(spark, sf_dir).drop("label"), 6, variance=3)


@query(with_(SHARES + ", rk AS (SELECT *, row_number() OVER w AS rank, sum(variance_frac) OVER w AS c FROM sh WINDOW w AS (PARTITION BY series_id ORDER BY variance_frac DESC, band))", "SELECT series_id, coalesce(min(CASE WHEN c >= 8e-1 THEN rank END), max(rank)) AS n_bands FROM rk GROUP BY 1"))
def explained_at(spark, sf_dir):
    return bands.bands_explaining(_shares(spark, sf_dir), K, 0.8)


@query(with_(SHARES, 'SELECT series_id, round(max(CASE WHEN band = 0 THEN variance_frac END), 6) AS "multi-decadal", round(max(CASE WHEN band = 1 THEN variance_frac END), 6) AS decadal, round(max(CASE WHEN band = 2 THEN variance_frac END), 6) AS biennial, round(max(CASE WHEN band = 3 THEN variance_frac END), 6) AS annual, round(max(CASE WHEN band = 4 THEN variance_frac END), 6) AS "sub-seasonal" FROM sh GROUP BY 1'))
def compare_bands(spark, sf_dir):
    wide = bands.compare_bands(_shares(spark, sf_dir), "series_id")
    return wide.select("series_id", *((F.round(f"`{c}`", 6) + 0.0).alias(c) for c in wide.columns if c != "series_id"))


SMOOTH = f"""{RESID},
pc AS (SELECT series_id, CAST(t AS BIGINT) AS j, dv - avg(dv) OVER (PARTITION BY series_id) AS x, count(*) OVER (PARTITION BY series_id) AS len FROM d),
pg AS (SELECT series_id, k, k * 12e0 / n AS freq, CASE WHEN k = 0 OR k = n // 2 THEN 1e0 ELSE 2e0 END * power / (12e0 * n) AS psd FROM {dft('pc', 'series_id', 'len')}), lg AS (SELECT series_id, k, freq, psd, log10(psd) AS l FROM pg WHERE k > 0),
sm AS (SELECT series_id, k, freq, psd, (coalesce(lag(l) OVER w, l) + l + coalesce(lead(l) OVER w, l)) / 3e0 AS smooth FROM lg WINDOW w AS (PARTITION BY series_id ORDER BY k))"""


def _detrended_psd(spark, sf_dir):
    s = region_month_series(spark, sf_dir)
    return spectral.periodogram(preprocess.detrend(s, preprocess.fit_trend(s, K), K), K)


@query(with_(SMOOTH, "SELECT series_id, k, round(smooth, 6) AS smooth FROM sm"))
def smooth_psd(spark, sf_dir):
    return rounded(bands.smooth_log_psd(_detrended_psd(spark, sf_dir), K).select("series_id", "k", "smooth"), 6)


PEAKS = f"""{SMOOTH}, pk AS (SELECT series_id, k, freq, psd, smooth FROM (SELECT *, lag(smooth) OVER w AS a, lead(smooth) OVER w AS z FROM sm WINDOW w AS (PARTITION BY series_id ORDER BY k)) WHERE smooth > a AND smooth > z),
wl AS (SELECT p.series_id, p.k, max(CASE WHEN o.k < p.k AND o.smooth > p.smooth THEN o.k END) AS l, min(CASE WHEN o.k > p.k AND o.smooth > p.smooth THEN o.k END) AS rr FROM pk p JOIN sm o USING (series_id) GROUP BY 1, 2),
pr AS (SELECT p.series_id, p.k, p.freq, p.psd, p.smooth - greatest(min(CASE WHEN o.k <= p.k AND o.k > coalesce(l, -1) THEN o.smooth END), min(CASE WHEN o.k >= p.k AND o.k < coalesce(rr, 1000000) THEN o.smooth END)) AS prominence
  FROM pk p JOIN wl ON wl.series_id = p.series_id AND wl.k = p.k JOIN sm o ON o.series_id = p.series_id GROUP BY p.series_id, p.k, p.freq, p.psd, p.smooth),
pp AS (SELECT * FROM pr WHERE prominence >= 2e-1 AND freq BETWEEN 2e-2 AND 2e0),
ed AS (SELECT p.series_id, p.k, coalesce(max(CASE WHEN o.psd < p.psd / 2 AND o.k < p.k THEN o.k END), min(o.k)) AS l, coalesce(min(CASE WHEN o.psd < p.psd / 2 AND o.k > p.k THEN o.k END), max(o.k)) AS rr FROM pp p JOIN sm o USING (series_id) GROUP BY 1, 2),
pf AS (SELECT p.series_id, p.k, p.freq, p.psd, p.prominence, sum(CASE WHEN o.k BETWEEN l AND rr THEN o.psd END) AS inn, sum(o.psd) AS total, min(CASE WHEN o.k BETWEEN l AND rr THEN o.freq END) AS fl, max(CASE WHEN o.k BETWEEN l AND rr THEN o.freq END) AS fr, min(o.freq) AS df
  FROM pp p JOIN ed ON ed.series_id = p.series_id AND ed.k = p.k JOIN sm o ON o.series_id = p.series_id GROUP BY ALL),
pz AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY inn / total DESC, k) AS rank FROM pf)"""


def _peaks(spark, sf_dir):
    return bands.find_peaks(_detrended_psd(spark, sf_dir), K, 0.2)


@query(with_(PEAKS, "SELECT series_id, k, rank, round(freq, 6) AS freq_peak, round(prominence, 6) AS prominence, round(1 / fr, 6) AS pmin, round(1 / fl, 6) AS pmax, round(inn * df, 3) AS variance, round(inn / total, 6) AS variance_frac FROM pz"))
def peaks(spark, sf_dir):
    return rounded(_peaks(spark, sf_dir).select("series_id", "k", "rank", "freq_peak", "prominence", "pmin", "pmax", "variance", "variance_frac"), 6, variance=3)


@query(with_(PEAKS, "SELECT series_id, rank, round(1 / fr, 6) AS pmin, round(1 / fl, 6) AS pmax, factor FROM pz CROSS JOIN (VALUES (10e0), (1e-1)) x(factor) WHERE rank <= 2"))
def suggest_scales(spark, sf_dir):
    return rounded(bands.suggest_scalings(_peaks(spark, sf_dir), 2).select("series_id", "rank", "pmin", "pmax", "factor"), 6)


CURVE = f"{SERIES}, cv AS (SELECT series_id, CAST(t AS DOUBLE) AS gamma, sum(value) OVER (PARTITION BY series_id ORDER BY t) AS delivered FROM s), ta AS (SELECT series_id, delivered_max * x AS target FROM (SELECT series_id, max(delivered) AS delivered_max FROM cv GROUP BY 1) CROSS JOIN (VALUES (1e-9), (31e-2), (7e-1), (1e0)) v(x)), st AS (SELECT *, lead(delivered) OVER w AS d, lead(gamma) OVER w AS g FROM cv WINDOW w AS (PARTITION BY series_id ORDER BY delivered, gamma)), en AS (SELECT series_id, min(delivered) AS lo, max(delivered) AS hi, arg_min(gamma, delivered) AS fl FROM cv GROUP BY 1)"


@query(with_(CURVE, "SELECT series_id, round(target, 3) AS target, round(CASE WHEN target <= any_value(lo) THEN any_value(fl) WHEN target >= any_value(hi) THEN NULL ELSE max(CASE WHEN target >= delivered AND target < d THEN gamma + (target - delivered) / (d - delivered) * (g - gamma) END) END, 6) AS gamma FROM ta JOIN en USING (series_id) JOIN st USING (series_id) GROUP BY series_id, target"))
def invert_curve(spark, sf_dir):
    from pyspark.sql import Window

    s = region_month_series(spark, sf_dir)
    curve = s.select("series_id", F.col("t").cast("double").alias("gamma"), F.sum("value").over(Window.partitionBy("series_id").orderBy("t")).alias("delivered"))
    targets = curve.groupBy("series_id").agg(F.max("delivered").alias("m")).select("series_id", F.explode(F.array(*(F.lit(x) for x in (1e-9, 0.31, 0.7, 1.0)))).alias("x"), "m").select("series_id", (F.col("m") * F.col("x")).alias("target"))
    return rounded(bands.invert_curve(curve, targets, K), 6, target=3)


@query(with_(welch("r", RESID, NPERSEG) + ", w2 AS (SELECT series_id, k, log10(psd) AS l FROM wp WHERE k > 0), av AS (SELECT k, avg(l) AS m FROM w2 GROUP BY 1)", "SELECT series_id, round(sqrt(avg(pow(l - m, 2))), 6) AS rms FROM w2 JOIN av USING (k) GROUP BY 1"))
def psd_rms(spark, sf_dir):
    w = spectral.welch(residuals(spark, sf_dir), K, NPERSEG).where("k > 0").withColumn("l", F.log10("psd"))
    return rounded(stats.rms_difference(w.join(w.groupBy("k").agg(F.avg("l").alias("m")), "k"), K, F.col("l"), F.col("m")), 6)


@query(with_(WELCH_R, "SELECT a.series_id AS experiment, a.k, round(a.freq, 8) AS freq, round(a.psd / z.psd, 6) AS ratio FROM wp a JOIN wp z ON a.k = z.k AND z.series_id = 'ASIA'"))
def psd_ratio_to_baseline(spark, sf_dir):
    psd = spectral.welch(residuals(spark, sf_dir), K, NPERSEG).withColumnRenamed("series_id", "experiment")
    return rounded(stats.ratio_to_baseline(psd, [], "ASIA"), 6, freq=8)


# --- significance


CLASSIFY = f"""{PERIODOGRAM}, q AS (SELECT series_id, 100 * sum(CASE WHEN freq BETWEEN 5e-2 AND 125e-3 THEN psd END) / sum(psd) AS dp, 100 * sum(CASE WHEN freq BETWEEN {1 / 1.5!r}e0 AND {1 / 0.8!r}e0 THEN psd END) / sum(psd) AS ap FROM pg GROUP BY 1),
ph AS (SELECT series_id, corr(value, y) AS phi FROM (SELECT *, lead(value) OVER (PARTITION BY series_id ORDER BY t) AS y FROM r) GROUP BY 1),
cl AS (SELECT series_id, phi, coalesce(dp, 0e0) AS dp, coalesce(ap, 0e0) AS ap, CASE WHEN (coalesce(dp, 0e0) >= {2 * significance.white_expectation_pct(8, 20)!r}e0) OR (coalesce(ap, 0e0) >= {2 * significance.white_expectation_pct(0.8, 1.5)!r}e0) THEN 'band-structured' WHEN abs(phi) >= 2e-1 THEN 'red' ELSE 'white' END AS verdict FROM q JOIN ph USING (series_id))"""


@query(with_(CLASSIFY, "SELECT series_id, round(phi, 6) AS phi, verdict FROM cl"))
def classify(spark, sf_dir):
    r = residuals(spark, sf_dir)
    pg = spectral.periodogram(r, K)
    total = pg.groupBy("series_id").agg(F.sum("psd").alias("all"), *(F.coalesce(F.sum(F.when(spectral.in_band(F.col("freq"), *b), F.col("psd"))), F.lit(0.0)).alias(n) for n, b in significance.BANDS.items()))
    joined = total.join(stats.lag1(r, K), "series_id")
    d, a, hit = 100 * F.col("decadal") / F.col("all"), 100 * F.col("annual") / F.col("all"), F.lit(100.0)
    return rounded(joined.select("series_id", "phi", significance.classify(F.col("phi"), d, hit, hit, a, hit, hit).alias("verdict")), 6)


@query(with_(CLASSIFY, "SELECT verdict, count(*) AS n FROM cl GROUP BY 1"))
def verdict_counts(spark, sf_dir):
    return classify(spark, sf_dir).groupBy("verdict").agg(F.count("*").alias("n"))


# --- fields


FRESID = f"""{FIELD}, fc AS (SELECT *, value - avg(value) OVER (PARTITION BY cell_id) AS cv FROM f), ft AS (SELECT cell_id, regr_slope(cv, t) AS a, regr_intercept(cv, t) AS b FROM fc GROUP BY 1),
fd AS (SELECT fc.cell_id, fc.t, fc.month, cv - (a * t + b) AS dv FROM fc JOIN ft USING (cell_id)), fr AS (SELECT cell_id, t, month, dv - avg(dv) OVER (PARTITION BY cell_id, month) AS value FROM fd),
cw AS (SELECT cell_id, sqrt(cos(radians(abs(lat)))) AS weight FROM cells), fw AS (SELECT cell_id, t, value, weight FROM fr JOIN cw USING (cell_id))"""


def _field_residuals(spark, sf_dir):
    f = nation_month_field(spark, sf_dir)
    return preprocess.transform(f, preprocess.fit(f, ["cell_id"], preprocess.STEP, centre=True)).select("cell_id", "ts", "t", "month", "value")


@query(with_(FRESID, "SELECT cell_id, t, round(value, 3) AS value FROM fr"))
def field_preprocess(spark, sf_dir):
    return rounded(_field_residuals(spark, sf_dir).select("cell_id", "t", "value"), 3)


@query(with_(FRESID, "SELECT cell_id, round(var_pop(value), 2) AS variance FROM fr GROUP BY 1"))
def variance_map(spark, sf_dir):
    return rounded(_field_residuals(spark, sf_dir).groupBy("cell_id").agg(F.var_pop("value").alias("variance")), 2)


@query(with_(FRESID, "SELECT a.t AS t1, z.t AS t2, round(sum(a.value * a.weight * z.value * z.weight), 1) AS dot FROM fw a JOIN fw z ON a.cell_id = z.cell_id AND a.t <= z.t GROUP BY 1, 2"))
def gram_matrix(spark, sf_dir):
    return rounded(field.gram_matrix(_field_residuals(spark, sf_dir), nation_cells(spark, sf_dir)), 1)


PATTERNS = f"{FRESID}, eo AS (SELECT CAST(m AS INTEGER) AS mode, cell_id, sqrt(8e-2) * cos({TWO_PI} * m * (cell_id + 5e-1) / 50e0) AS loading FROM (SELECT DISTINCT cell_id FROM fr) CROSS JOIN range(1, 4) x(m)), pj AS (SELECT mode, t, sum(value * weight * loading) AS value FROM fw JOIN eo USING (cell_id) GROUP BY 1, 2)"


def _patterns(spark, sf_dir):
    c = nation_cells(spark, sf_dir).select("cell_id").withColumn("mode", F.explode(F.sequence(F.lit(1), F.lit(3))))
    return c.select("mode", "cell_id", (float(np.sqrt(0.08)) * F.cos(2 * np.pi * F.col("mode") * (F.col("cell_id") + 0.5) / 50.0)).alias("loading"))


@query(with_(PATTERNS, "SELECT mode, t, round(value, 4) AS value FROM pj"))
def eof_project(spark, sf_dir):
    return rounded(field.project(_field_residuals(spark, sf_dir), nation_cells(spark, sf_dir), _patterns(spark, sf_dir)))


@query(with_(PATTERNS, "SELECT cell_id, t, round(sum(pj.value * loading) / any_value(weight), 4) AS value FROM pj JOIN eo USING (mode) JOIN cw USING (cell_id) GROUP BY 1, 2"))
def eof_reconstruct(spark, sf_dir):
    cells, e = nation_cells(spark, sf_dir), _patterns(spark, sf_dir)
    return rounded(field.reconstruct(field.project(_field_residuals(spark, sf_dir), cells, e), e, cells))


@query(with_(PATTERNS + ", lm AS (SELECT mode, sqrt(sum(value * value)) AS sv FROM pj GROUP BY 1), nr AS (SELECT mode, sv, sv * sv AS l, lag(sv * sv) OVER (ORDER BY mode) AS p, lead(sv * sv) OVER (ORDER BY mode) AS q FROM lm)", f"SELECT mode, round(l * {float(np.sqrt(2 / 80))!r}e0, 1) AS error, round(least(coalesce(p - l, 1e300), coalesce(l - q, 1e300)), 1) > round(l * {float(np.sqrt(2 / 80))!r}e0, 1) AS separable FROM nr"))
def north_rule(spark, sf_dir):
    s = field.project(_field_residuals(spark, sf_dir), nation_cells(spark, sf_dir), _patterns(spark, sf_dir)).groupBy("mode").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("s"))
    return rounded(field.north_rule(s, 80).select("mode", "error", "separable"), 1)


@query(with_(FRESID + ", cc AS (SELECT count(*) AS n, avg(v) AS cv FROM (SELECT cell_id, var_pop(value) AS v FROM fr GROUP BY 1)), mm AS (SELECT var_pop(m) AS mv FROM (SELECT t, avg(value) AS m FROM fr GROUP BY 1))", "SELECT n AS n_cells, round(cv, 2) AS cell_variance, round(mv, 2) AS mean_variance, round(mv / cv, 6) AS suppression, round((n * mv / cv - 1) / (n - 1), 6) AS coherence FROM cc, mm"))
def coherence(spark, sf_dir):
    return rounded(field.coherence_table(_field_residuals(spark, sf_dir)), 6, cell_variance=2, mean_variance=2)


@query(with_(FIELD + ", o AS (SELECT cell_id, avg(value) AS om, var_pop(value) AS ov FROM f WHERE t < 40 GROUP BY 1), p AS (SELECT cell_id, avg(value) AS sm, var_pop(value) AS sv FROM f WHERE t >= 40 GROUP BY 1)", "SELECT round(corr(om, sm), 6) AS mean_corr, round(corr(ov, sv), 6) AS variance_corr, round(avg(sm) / avg(om), 6) AS mean_ratio, round(avg(sv) / avg(ov), 6) AS variance_ratio, round(avg(sv / ov), 6) AS map_ratio FROM o JOIN p USING (cell_id)"))
def map_correlation(spark, sf_dir):
    f = nation_month_field(spark, sf_dir)
    return rounded(validation.map_metrics(f.where("t < 40"), f.where("t >= 40")), 6)


@query()
def spatial_diagnostic(spark, sf_dir):
    return rounded(suite.spatial_diagnostic(_field_residuals(spark, sf_dir)), 6, cell_variance=2, mean_variance=2)


@query(with_(RESID, "SELECT series_id, round(var_pop(value), 2) AS residual_variance, count(*) AS n FROM r GROUP BY 1"))
def flagship(spark, sf_dir):
    return rounded(residuals(spark, sf_dir).groupBy("series_id").agg(F.var_pop("value").alias("residual_variance"), F.count("*").alias("n")), 2)
