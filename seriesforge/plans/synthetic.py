"""Queries on synthetic ensembles, and the SQL that draws and makes the same ones.

Phases are drawn by counters, so SQL draws each of them alone: an ensemble is a
grid of bins, a draw for each bin and member, and a sum of cosines.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from seriesforge.functions import kernels, philox
from seriesforge.functions.normal import norm_cdf_sql, norm_ppf_sql
from seriesforge.operators import figures, spectral, synthesis, validation
from seriesforge.plans import suite
from seriesforge.plans.experiments import ANNUAL, DECADAL, Experiment
from seriesforge.plans.relational import K, query, rounded
from seriesforge.plans.spectra import NPERSEG, TAIL
from seriesforge.plans.sql import SERIES, TWO_PI, welch, with_
from seriesforge.sources import netcdf
from seriesforge.sources.frames import region_month_series
from seriesforge.sources.intermediate import shared_dir

#: A thousand steps a member and more, as tests of generators use them; the defaults are 1000 years and 30 members.
SIZES = {"n_years": 100, "n_members": 10}
GAMMAS = [0.5, 1.0, 2.0, 5.0]


def _model(spark, sf_dir) -> synthesis.FittedGenerator:
    return synthesis.fit_generator(region_month_series(spark, sf_dir), K, NPERSEG)


def members_sql(experiments: list[Experiment], nperseg: int = NPERSEG, ctes: str = TAIL, by_mode: bool = False) -> str:
    """CTEs up to ``gs`` (experiment, series_id, member, t, g): ranked series, their spectra and the members made from these.

    ``by_mode``: series are modes, and each mode and member has a stream of its own.
    """

    def factor(e: Experiment) -> str:
        return " * ".join(f"CASE WHEN freq BETWEEN {1 / high!r}e0 AND {1 / low!r}e0 THEN {float(by)!r}e0 ELSE 1e0 END" for low, high, by in e.band_scales or ()) or "1e0"

    plan = ", ".join(f"('{e.name}', {e.n_months}, {e.n_members}, {e.seed}, {e.seasonal_amplitude!r}e0)" for e in experiments)
    scales = " ".join(f"WHEN experiment = '{e.name}' THEN {factor(e)}" for e in experiments)
    streams = "n, seed, member"
    if by_mode:
        streams = "n, seed, members, series_id, member"
        places = f"(SELECT {streams}, unnest(range(0, n // 2 + 1)) AS k FROM (SELECT DISTINCT n, seed, members, series_id, unnest(range(0, members)) AS member FROM ex CROSS JOIN tp))"
        draws = philox.uniform_sql(places, f"{streams}, k", "u", "k", "0", "seed + member + CAST(series_id AS BIGINT) * (members + 1)")
    else:
        places = f"(SELECT {streams}, unnest(range(0, n // 2 + 1)) AS k FROM (SELECT DISTINCT n, seed, unnest(range(0, members)) AS member FROM ex))"
        draws = philox.uniform_sql(places, f"{streams}, k", "u", "k", "member", "seed")
    joined = "n, seed, members, series_id, k" if by_mode else "n, seed, k"
    return f"""{welch("(SELECT series_id, t - min(t) OVER (PARTITION BY series_id) AS t, g AS value FROM g)", ctes, nperseg)},
ex(experiment, n, members, seed, amp) AS (VALUES {plan}),
tp AS (SELECT series_id, max(k) AS top, max(freq) AS last FROM wp GROUP BY 1),
gk AS (SELECT experiment, series_id, n, k, k * (12e0 / n) AS freq, least(k * (12e0 / n) * top / last, CAST(top AS DOUBLE)) AS pos, top FROM (SELECT *, unnest(range(0, n // 2 + 1)) AS k FROM ex) CROSS JOIN tp),
gi AS (SELECT *, CAST(least(floor(pos), top - 1) AS BIGINT) AS lo FROM gk),
am AS (SELECT gi.experiment, gi.series_id, gi.n, gi.k, sqrt((a.psd + (pos - lo) * (z.psd - a.psd)) * (CASE {scales} END) * n * 6e0) AS a
  FROM (SELECT * FROM gi) gi JOIN (SELECT series_id, k, psd FROM wp) a ON a.series_id = gi.series_id AND a.k = lo JOIN (SELECT series_id, k, psd FROM wp) z ON z.series_id = gi.series_id AND z.k = lo + 1 WHERE gi.k > 0),
ph AS (SELECT {streams}, k, CASE WHEN 2 * k = n THEN 0e0 ELSE {TWO_PI} * u - {TWO_PI} / 2 END AS phi FROM {draws}),
cf AS (SELECT experiment, series_id, member, n, k, CASE WHEN 2 * k = n THEN 1e0 ELSE 2e0 END * a * cos(phi) / n AS re, CASE WHEN 2 * k = n THEN 1e0 ELSE 2e0 END * a * sin(phi) / n AS im FROM am JOIN ex USING (experiment, n) JOIN ph USING ({joined}) WHERE member < members),
xs AS (SELECT experiment, series_id, member, t, sum(re * cos({TWO_PI} * ((k * t) % n) / n) - im * sin({TWO_PI} * ((k * t) % n) / n)) AS x FROM (SELECT *, unnest(range(0, n)) AS t FROM cf) GROUP BY 1, 2, 3, 4),
gs AS (SELECT experiment, series_id, member, t, x / stddev_pop(x) OVER (PARTITION BY experiment, series_id, member) AS g FROM xs)"""


def residuals_sql(experiments: list[Experiment], nperseg: int = NPERSEG, ctes: str = TAIL, by_mode: bool = False) -> str:
    """CTEs up to ``rs`` (experiment, series_id, member, t, month, g, resid)."""
    u = f"greatest(least({norm_cdf_sql('g')}, 1e0 - 1e-15), 1e-15)"
    normal = f"loc + scale * ({norm_ppf_sql('u')})"
    return f"""{members_sql(experiments, nperseg, ctes, by_mode)},
iu AS (SELECT gs.*, n, loc, scale, low_offset, high_offset, u * n + 5e-1 AS place FROM (SELECT *, {u} AS u FROM gs) gs JOIN tail USING (series_id)),
ii AS (SELECT *, CAST(least(greatest(floor(place), 1), n) AS BIGINT) AS i FROM iu),
kn AS (SELECT series_id, rank AS i, value AS x, lead(value) OVER (PARTITION BY series_id ORDER BY rank) AS x_next FROM hp),
iv AS (SELECT experiment, series_id, member, t, g, CASE WHEN place < 1 THEN {normal} + low_offset WHEN place > n THEN {normal} + high_offset ELSE x + (place - i) * (coalesce(x_next, x) - x) END AS v FROM ii JOIN kn USING (series_id, i)),
rs AS (SELECT *, v - avg(v) OVER (PARTITION BY experiment, series_id, member) AS resid, CAST(t % 12 + 1 AS INTEGER) AS month FROM iv)""".replace("SELECT gs.*, n, loc", "SELECT gs.experiment, gs.series_id, member, t, g, u, n, loc")


def ensemble_sql(experiments: list[Experiment], nperseg: int = NPERSEG, ctes: str = TAIL) -> str:
    """CTEs up to ``en`` (experiment, series_id, member, t, month, g, resid, value)."""
    return f"""{residuals_sql(experiments, nperseg, ctes)},
sn AS (SELECT series_id, month, any_value(season) AS season FROM r GROUP BY 1, 2), me AS (SELECT series_id, avg(value) AS mean FROM s GROUP BY 1),
en AS (SELECT experiment, series_id, member, t, month, g, resid, resid + amp * coalesce(season, 0e0) + mean AS value FROM rs JOIN ex USING (experiment) JOIN me USING (series_id) LEFT JOIN sn USING (series_id, month))"""


def renamed_welch(source: str, nperseg: int, by: str, mark: str) -> str:
    """CTEs of Welch spectra whose names start with ``mark``, beside others."""
    out = welch(source, "", nperseg, by).lstrip(",\n")
    for name in ("wc", "ws", "wt", "we", "wp"):
        out = out.replace(f"{name} AS (", f"{mark}{name} AS (").replace(f"FROM {name})", f"FROM {mark}{name})").replace(f"FROM {name} ", f"FROM {mark}{name} ").replace(f"JOIN {name} ", f"JOIN {mark}{name} ")
    return out


def band_power_sql(low: float, high: float, name: str = "bp", source: str = "en") -> str:
    """CTE (experiment, series_id, member, v): periodogram power in a band, from the band's bins alone."""
    return f"""{name} AS (SELECT experiment, series_id, member, sum((c * c + s * s) * CASE WHEN 2 * k = n THEN 1e0 ELSE 2e0 END) / (n * CAST(n AS DOUBLE)) AS v FROM (
  SELECT experiment, series_id, member, n, k, sum(x * cos({TWO_PI} * ((k * t) % n) / n)) AS c, sum(x * sin({TWO_PI} * ((k * t) % n) / n)) AS s
  FROM (SELECT *, unnest(list_filter(range(1, n // 2 + 1), lambda k: k * (12e0 / n) >= {1 / high!r}e0 AND k * (12e0 / n) <= {1 / low!r}e0)) AS k
    FROM (SELECT experiment, series_id, member, t, value - avg(value) OVER q AS x, count(*) OVER q AS n FROM {source} WINDOW q AS (PARTITION BY experiment, series_id, member))) GROUP BY 1, 2, 3, 4, 5) GROUP BY experiment, series_id, member, n)"""


BASELINE = Experiment.baseline(**SIZES)
ROWS = "SELECT experiment, series_id, CAST(member AS INTEGER) AS member, CAST(t AS INTEGER) AS t, CAST(make_date(year(lo), 1, 1) + to_months(CAST(t AS INTEGER)) AS DATE) AS ts, month, round(g, 6) + 0e0 AS g, round(resid, 2) + 0e0 AS resid, round(value, 2) AS value FROM en, b"


@query(with_(ensemble_sql([BASELINE]), ROWS))
def synth_baseline(spark, sf_dir):
    return rounded(synthesis.generate(_model(spark, sf_dir), [BASELINE]), 2, g=6)


@query()
def synth_default_sizes(spark, sf_dir):
    """The default experiment: 30 members of 12,000 steps for each series."""
    return synthesis.generate(_model(spark, sf_dir), [Experiment.baseline()])


BY_MEMBER = "SELECT experiment, series_id, CAST(member AS INTEGER) AS member, count(*) AS n, round(avg(value), 4) AS mean, round(var_pop(value), 2) AS variance, round(var_pop(g), 6) AS g_variance FROM en GROUP BY 1, 2, 3"


@query(with_(ensemble_sql(Experiment.standard_suite(**SIZES)), BY_MEMBER))
def synth_suite(spark, sf_dir):
    ens = synthesis.generate(_model(spark, sf_dir), Experiment.standard_suite(**SIZES))
    by_member = ens.groupBy("experiment", "series_id", "member").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("variance"), F.var_pop("g").alias("g_variance"))
    return rounded(by_member, 4, variance=2, g_variance=6)


def _checks_sql(n_check: int = 20, n_years: int = 100) -> str:
    n = 1 + (80 - NPERSEG) // (NPERSEG - NPERSEG // 2)
    quantiles = ", ".join(f"({k}, {kernels.chi2_ppf(0.975, 2 * k)!r}e0, {kernels.chi2_ppf(0.025, 2 * k)!r}e0)" for k in range(1, n + 3))
    made = members_sql([Experiment(n_years, n_check, 0)])
    spectra = renamed_welch("(SELECT series_id, member, t, g AS value FROM gs)", NPERSEG, "series_id, member", "m")
    return with_(
        f"""{made}, {spectra}, qu(n_segments, hi, lo) AS (VALUES {quantiles}), sp AS (SELECT series_id, avg(v) AS mean_variance, stddev_pop(v) AS std_variance FROM (SELECT series_id, member, var_pop(g) AS v FROM gs GROUP BY 1, 2) GROUP BY 1),
mp AS (SELECT series_id, k, avg(psd) AS p FROM mwp GROUP BY 1, 2),
co AS (SELECT series_id, avg(CASE WHEN p BETWEEN psd * 2 * n_segments / hi AND psd * 2 * n_segments / lo THEN 1e0 ELSE 0e0 END) AS coverage FROM wp JOIN qu USING (n_segments) JOIN mp USING (series_id, k) WHERE k > 0 GROUP BY 1)""",
        "SELECT series_id, round(mean_variance, 6) AS mean_variance, round(std_variance, 6) AS std_variance, round(coverage, 6) AS coverage, coverage > 5e-1 AND abs(mean_variance - 1) < 5e-2 AND std_variance < 1e-1 AS passed FROM sp JOIN co USING (series_id)",
    )


@query(_checks_sql())
def synth_checks(spark, sf_dir):
    return rounded(synthesis.validate_synthesis(_model(spark, sf_dir)), 6)


def _white_sql(ratio: float = 2.0, seed: int = 0) -> str:
    places = f"(SELECT series_id, member, t, {philox.key_sql('series_id', seed)} AS key FROM en)"
    one = philox.uniform_sql(places, "series_id, member, t, key", "u0", "2 * t", "member", "key")
    two = philox.uniform_sql(one, "series_id, member, t, key, u0", "u1", "2 * t + 1", "member", "key")
    return with_(
        f"""{ensemble_sql([BASELINE])}, tv AS (SELECT series_id, var_pop(value) AS v FROM en GROUP BY 1),
no AS (SELECT series_id, member, t, sqrt({ratio - 1!r}e0 * v) * sqrt(-2e0 * ln(u0)) * cos({TWO_PI} * u1) AS e FROM {two} JOIN tv USING (series_id)),
nv AS (SELECT series_id, member, value + e - avg(e) OVER (PARTITION BY series_id, member) AS value FROM en JOIN no USING (series_id, member, t))""",
        "SELECT series_id, CAST(member AS INTEGER) AS member, round(avg(value), 4) AS mean, round(var_pop(value), 2) AS variance FROM nv GROUP BY 1, 2",
    )


@query(_white_sql())
def white_control(spark, sf_dir):
    base = synthesis.generate(_model(spark, sf_dir), [BASELINE])
    return rounded(synthesis.white_control(base, K, 2.0).groupBy("series_id", "member").agg(F.avg("value").alias("mean"), F.var_pop("value").alias("variance")), 4, variance=2)


CURVE_SUITE = [Experiment(**SIZES, name=f"gamma={g!r}", band_scales=((*ANNUAL, g),)) for g in GAMMAS]


@query(with_(ensemble_sql(CURVE_SUITE) + ", " + band_power_sql(*ANNUAL), "SELECT series_id, CAST(substr(experiment, 7) AS DOUBLE) AS gamma, round(avg(v), 2) AS delivered FROM bp GROUP BY 1, 2"))
def calibrate_curve(spark, sf_dir):
    return rounded(synthesis.calibrate(_model(spark, sf_dir), ANNUAL, GAMMAS, SIZES["n_years"], SIZES["n_members"]), 2, gamma=6)


SUMMARY_SUITE = Experiment.standard_suite(**SIZES)


@query(
    with_(
        f"{ensemble_sql(SUMMARY_SUITE)}, {band_power_sql(*ANNUAL, 'pa')}, {band_power_sql(*DECADAL, 'pd')}, su AS (SELECT experiment, series_id, avg(pa.v) AS va, avg(pd.v) AS vd FROM pa JOIN pd USING (experiment, series_id, member) GROUP BY 1, 2), vt AS (SELECT experiment, series_id, var_pop(value) AS vt, avg(value) AS m FROM en GROUP BY 1, 2), z AS (SELECT series_id, va AS a0, vd AS d0, vt AS t0 FROM su JOIN vt USING (experiment, series_id) WHERE experiment = 'baseline')",
        "SELECT experiment, series_id, round(va, 2) AS v_annual, round(vd, 2) AS v_decadal, round(vt, 2) AS v_total, round(m, 4) AS mean, round(va / a0, 6) AS annual_ratio, round(vd / d0, 6) AS decadal_ratio, round(vt / t0, 6) AS total_ratio FROM su JOIN vt USING (experiment, series_id) JOIN z USING (series_id)",
    )
)
def suite_summary(spark, sf_dir):
    return rounded(suite.suite_summary(synthesis.generate(_model(spark, sf_dir), SUMMARY_SUITE), K), 6, v_annual=2, v_decadal=2, v_total=2, mean=4)


RATIO_PAIR = [BASELINE, Experiment.scaled("annual", ANNUAL, 10.0, **SIZES)]


def _ratio_sql() -> str:
    spectra = renamed_welch("en", NPERSEG, "experiment, series_id, member", "m")
    inside = f"freq BETWEEN {1 / ANNUAL[1]!r}e0 AND {1 / ANNUAL[0]!r}e0"
    ctes = f"{ensemble_sql(RATIO_PAIR)}, {spectra}, po AS (SELECT experiment, series_id, sum(CASE WHEN {inside} THEN psd ELSE 0e0 END) AS i, sum(CASE WHEN {inside} THEN 0e0 ELSE psd END) AS o FROM mwp WHERE k > 0 GROUP BY 1, 2)"
    return with_(ctes, "SELECT series_id, round(z.i / nullif(a.i, 0), 6) AS in_band, round(z.o / a.o, 6) AS out_of_band FROM (SELECT * FROM po WHERE experiment = 'baseline') a JOIN (SELECT * FROM po WHERE experiment = 'annual') z USING (series_id)")


@query(_ratio_sql())
def band_variance_ratio(spark, sf_dir):
    model = _model(spark, sf_dir)
    base, scaled = (synthesis.generate(model, [e]) for e in RATIO_PAIR)
    return rounded(suite.band_variance_ratio(base, scaled, K, ANNUAL, NPERSEG), 6)


COUNTS = [1, 2, 5, 10]


@query(
    with_(
        f"{ensemble_sql([BASELINE])}, ob AS (SELECT series_id, avg(value) AS om, var_pop(value) AS ov FROM s GROUP BY 1), cn AS (SELECT series_id, n, avg(value) AS sm, var_pop(value) AS sv FROM en JOIN (VALUES {', '.join(f'({c})' for c in COUNTS)}) c(n) ON member < n GROUP BY 1, 2)",
        "SELECT series_id, CAST(n AS INTEGER) AS n_members, round(sm / om, 6) AS mean_ratio, round(sv / ov, 6) AS variance_ratio FROM cn JOIN ob USING (series_id)",
    )
)
def convergence(spark, sf_dir):
    s = region_month_series(spark, sf_dir)
    return rounded(validation.convergence(s, synthesis.generate(_model(spark, sf_dir), [BASELINE]), K, COUNTS), 6)


def _half_sql(half: int, n_members: int, n_years: int) -> str:
    """Scores of what is fitted to one half of each series against the other half."""
    whole = SERIES.strip().replace("s AS (SELECT k.series_id", "sw AS (SELECT k.series_id")
    halved = f"{whole},\nsh AS (SELECT *, CAST(row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 >= count(*) OVER (PARTITION BY series_id) // 2 AS INTEGER) AS half FROM sw),\ns AS (SELECT series_id, ts, t, month, value FROM sh WHERE half = {half})"
    ctes = ensemble_sql([Experiment(n_years, n_members, 0)], 12, TAIL.replace(SERIES.strip(), halved))
    ctes += f", ob AS (SELECT series_id, avg(value) AS om, var_pop(value) AS ov FROM sh WHERE half = {1 - half} GROUP BY 1), sy AS (SELECT series_id, avg(value) AS sm, var_pop(value) AS sv FROM en GROUP BY 1)"
    return with_(ctes, f"SELECT series_id, {half} AS fitted_half, round(sm / om, 6) AS mean_ratio, round(sv / ov, 6) AS variance_ratio FROM sy JOIN ob USING (series_id)")


@query(f"SELECT * FROM ({_half_sql(0, 5, 50)}) UNION ALL SELECT * FROM ({_half_sql(1, 5, 50)})")
def calibration_split(spark, sf_dir):
    return rounded(validation.calibration_split(region_month_series(spark, sf_dir), K), 6)


METRIC_PAIR = [BASELINE, Experiment.annual_enhanced(**SIZES)]
BOTH = "experiment, series_id"
METRICS = f"""{ensemble_sql(METRIC_PAIR)}, {renamed_welch("(SELECT * FROM en WHERE member = 0)", NPERSEG, BOTH, "m")}, {renamed_welch("s", NPERSEG, "series_id", "o")},
xm AS (SELECT {BOTH}, avg(value) AS m, var_pop(value) AS v FROM en GROUP BY 1, 2), xo AS (SELECT series_id, avg(value) AS m, var_pop(value) AS v FROM s GROUP BY 1),
bo AS (SELECT {BOTH}, value, 1 AS second FROM en UNION ALL SELECT experiment, series_id, value, 0 FROM s, ex), bc AS (SELECT {BOTH}, value, sum(1 - second) AS a, sum(second) AS b2 FROM bo GROUP BY 1, 2, 3),
bk AS (SELECT {BOTH}, max(abs(fa - fb)) AS ks FROM (SELECT {BOTH}, sum(a) OVER w / sum(a) OVER (PARTITION BY {BOTH}) AS fa, sum(b2) OVER w / sum(b2) OVER (PARTITION BY {BOTH}) AS fb FROM bc WINDOW w AS (PARTITION BY {BOTH} ORDER BY value)) GROUP BY 1, 2),
pr AS (SELECT {BOTH}, sqrt(avg(pow(log10(mwp.psd) - log10(owp.psd), 2))) AS rms FROM mwp JOIN owp USING (series_id, k) WHERE k > 0 GROUP BY 1, 2),
ac AS (SELECT {BOTH}, t, value - avg(value) OVER (PARTITION BY {BOTH}) AS x FROM (SELECT {BOTH}, t, value FROM en WHERE member = 0 UNION ALL SELECT 'observed', series_id, t, value FROM s)),
al AS (SELECT {BOTH}, lag, t + lag AS t, x FROM ac CROSS JOIN (VALUES (1), (12)) l(lag)),
aa AS (SELECT {BOTH}, lag, sum(al.x * ac.x) / any_value(v) AS acf FROM al JOIN ac USING (experiment, series_id, t) JOIN (SELECT {BOTH}, sum(x * x) AS v FROM ac GROUP BY 1, 2) q USING (experiment, series_id) GROUP BY 1, 2, 3),
ae AS (SELECT e.experiment, series_id, max(CASE WHEN lag = 1 THEN abs(e.acf - o.acf) END) AS e1, max(CASE WHEN lag = 12 THEN abs(e.acf - o.acf) END) AS e12 FROM aa e JOIN aa o USING (series_id, lag) WHERE o.experiment = 'observed' AND e.experiment != 'observed' GROUP BY 1, 2),
sm AS (SELECT {BOTH}, sqrt(avg(pow(e.v - o.v, 2))) AS rmse FROM (SELECT {BOTH}, month, avg(value) AS v FROM en GROUP BY 1, 2, 3) e JOIN (SELECT series_id, month, avg(value) AS v FROM s GROUP BY 1, 2) o USING (series_id, month) GROUP BY 1, 2)"""
SCORES = "round(xm.m / xo.m, 6) AS mean_ratio, round(xm.v / xo.v, 6) AS variance_ratio, round(ks, 6) AS ks_distance, round(rms, 6) AS psd_rms, round(e1, 6) AS acf_lag1_error, round(e12, 6) AS acf_lag12_error, round(rmse, 3) AS seasonal_rmse FROM xm JOIN xo USING (series_id) JOIN bk USING (experiment, series_id) JOIN pr USING (experiment, series_id) JOIN ae USING (experiment, series_id) JOIN sm USING (experiment, series_id)"


@query(with_(METRICS, f"SELECT experiment, series_id, {SCORES}"))
def ensemble_metrics(spark, sf_dir):
    return rounded(validation.suite_metrics(region_month_series(spark, sf_dir), K, METRIC_PAIR, NPERSEG), 6, seasonal_rmse=3)


@query(with_(METRICS, f"SELECT series_id, {SCORES} WHERE experiment = 'baseline'"))
def metrics_by_series(spark, sf_dir):
    return rounded(validation.metrics_table(validation.suite_metrics(region_month_series(spark, sf_dir), K, METRIC_PAIR, NPERSEG)), 6, seasonal_rmse=3)


# --- what figures show


def _with_members(spark, sf_dir):
    return region_month_series(spark, sf_dir), synthesis.generate(_model(spark, sf_dir), [BASELINE]).drop("experiment")


MADE = ensemble_sql([BASELINE])
SEGMENTS = spectral.segment_count(80, NPERSEG)


@query(
    with_(
        f"{MADE}, {renamed_welch('en', NPERSEG, 'series_id, member', 'm')}, {renamed_welch('s', NPERSEG, 'series_id', 'o')}, mp AS (SELECT series_id, k, avg(psd) AS p FROM mwp GROUP BY 1, 2), ch(n_segments, hi, lo) AS (VALUES {', '.join(f'({k}, {kernels.chi2_ppf(0.975, 2 * k)!r}e0, {kernels.chi2_ppf(0.025, 2 * k)!r}e0)' for k in range(1, SEGMENTS + 3))})",
        "SELECT series_id, k, round(freq, 6) AS freq, round(psd, 1) AS observed, round(psd * 2 * n_segments / hi, 1) AS ci_lower, round(psd * 2 * n_segments / lo, 1) AS ci_upper, round(p, 1) AS synthetic FROM owp JOIN mp USING (series_id, k) JOIN ch USING (n_segments) WHERE k > 0",
    )
)
def spectrum_panel(spark, sf_dir):
    return rounded(figures.spectrum_panel(*_with_members(spark, sf_dir), K, NPERSEG), 1, freq=6)


@query(
    with_(
        f"{MADE}, bo AS (SELECT series_id, value, 0 AS made FROM s UNION ALL SELECT series_id, value, 1 FROM en), sp AS (SELECT series_id, min(value) AS lo, max(value) - min(value) AS w, sum(1 - made) AS n0, sum(made) AS n1 FROM bo GROUP BY 1)",
        "SELECT series_id, CAST(least(floor((value - lo) / w * 45), 44) AS INTEGER) AS bin, round(any_value(lo) + CAST(least(floor((value - lo) / w * 45), 44) AS INTEGER) * any_value(w) / 45, 3) AS low, round(sum(1 - made) / any_value(n0 * w / 45), 8) AS observed, round(sum(made) / any_value(n1 * w / 45), 8) AS synthetic FROM bo JOIN sp USING (series_id) GROUP BY 1, 2",
    )
)
def density_panel(spark, sf_dir):
    return rounded(figures.density_panel(*_with_members(spark, sf_dir), K), 8, low=3)


@query(
    with_(
        f"{MADE}, ac AS (SELECT series_id, member, t, value - avg(value) OVER (PARTITION BY series_id, member) AS x FROM (SELECT series_id, member, t, value FROM en UNION ALL SELECT series_id, -1, t, value FROM s)), al AS MATERIALIZED (SELECT series_id, member, lag, t + lag AS t, x FROM ac CROSS JOIN range(0, 37) l(lag)), aa AS (SELECT series_id, member, lag, sum(al.x * ac.x) / any_value(v) AS acf FROM al JOIN ac USING (series_id, member, t) JOIN (SELECT series_id, member, sum(x * x) AS v FROM ac GROUP BY 1, 2) q USING (series_id, member) GROUP BY 1, 2, 3)",
        "SELECT series_id, CAST(lag AS INTEGER) AS lag, round(max(CASE WHEN member = -1 THEN acf END), 6) + 0e0 AS observed, round(avg(CASE WHEN member >= 0 THEN acf END), 6) + 0e0 AS synthetic FROM aa GROUP BY 1, 2",
    )
)
def autocorrelation_panel(spark, sf_dir):
    return rounded(figures.autocorrelation_panel(*_with_members(spark, sf_dir), K), 6)


@query(
    with_(
        f"{MADE}, mm AS (SELECT series_id, member, month, avg(value) AS v FROM en GROUP BY 1, 2, 3), mt AS (SELECT series_id, month, quantile_cont(v, 5e-2) AS low, quantile_cont(v, 95e-2) AS high FROM mm GROUP BY 1, 2), ma AS (SELECT series_id, month, avg(value) AS v FROM en GROUP BY 1, 2), mo AS (SELECT series_id, month, avg(value) AS v FROM s GROUP BY 1, 2)",
        "SELECT series_id, month, round(mo.v, 3) AS observed, round(ma.v, 3) AS synthetic, round(low, 3) AS low, round(high, 3) AS high FROM mo JOIN ma USING (series_id, month) JOIN mt USING (series_id, month)",
    )
)
def season_panel(spark, sf_dir):
    return rounded(figures.season_panel(*_with_members(spark, sf_dir), K), 3)


YEARS = 5
YEARLY = "ye AS (SELECT series_id, member, t // 12 AS year, avg(value) AS value FROM (SELECT series_id, member, t, value FROM en UNION ALL SELECT series_id, -1, t, value FROM s) GROUP BY 1, 2, 3 HAVING count(*) = 12)"


@query(
    with_(
        f"{MADE}, {YEARLY}, wi AS (SELECT series_id, avg(value) OVER w AS mean, stddev_pop(value) OVER w AS std, max(value) OVER w - min(value) OVER w AS range, count(*) OVER w AS n FROM ye WHERE member >= 0 WINDOW w AS (PARTITION BY series_id, member ORDER BY year ROWS BETWEEN CURRENT ROW AND {YEARS - 1} FOLLOWING)), wl AS (UNPIVOT (SELECT series_id, mean, std, range FROM wi WHERE n = {YEARS}) ON mean, std, range INTO NAME statistic VALUE v), ol AS (UNPIVOT (SELECT series_id, avg(value) AS mean, stddev_pop(value) AS std, max(value) - min(value) AS range FROM ye WHERE member = -1 GROUP BY 1) ON mean, std, range INTO NAME statistic VALUE o)",
        "SELECT series_id, statistic, round(any_value(o), 3) AS observed, round(quantile_cont(v, 5e-2), 3) AS p5, round(quantile_cont(v, 5e-1), 3) AS median, round(quantile_cont(v, 95e-2), 3) AS p95, round(100 * avg(CASE WHEN v < o THEN 1e0 ELSE 0e0 END), 6) AS percentile FROM wl JOIN ol USING (series_id, statistic) GROUP BY 1, 2",
    )
)
def window_panel(spark, sf_dir):
    return rounded(figures.window_panel(*_with_members(spark, sf_dir), K, YEARS), 3, percentile=6)


@query(with_(f"{MADE}, {YEARLY}, rk AS (SELECT *, row_number() OVER (PARTITION BY series_id, member ORDER BY value DESC, year) AS rank, count(*) OVER (PARTITION BY series_id, member) AS n FROM ye)", "SELECT series_id, CAST(member AS INTEGER) AS member, CAST(year AS INTEGER) AS year, round(value, 3) AS value, rank, round((n + 1) / rank, 6) AS return_period FROM rk"))
def return_panel(spark, sf_dir):
    return rounded(figures.return_panel(*_with_members(spark, sf_dir), K), 3, return_period=6)


@query(with_(f"{ensemble_sql(RATIO_PAIR)}, {renamed_welch('en', NPERSEG, 'experiment, series_id, member', 'm')}", f"SELECT experiment, series_id, k, round(any_value(freq), 6) AS freq, round(avg(psd), 1) AS psd, CASE WHEN any_value(freq) BETWEEN {1 / ANNUAL[1]!r}e0 AND {1 / ANNUAL[0]!r}e0 THEN 'annual' WHEN any_value(freq) BETWEEN {1 / DECADAL[1]!r}e0 AND {1 / DECADAL[0]!r}e0 THEN 'decadal' ELSE 'none' END AS band FROM mwp WHERE k > 0 GROUP BY 1, 2, 3"))
def band_panel(spark, sf_dir):
    return rounded(figures.band_panel(synthesis.generate(_model(spark, sf_dir), RATIO_PAIR), K, {"annual": ANNUAL, "decadal": DECADAL}, NPERSEG), 1, freq=6)


@query(with_(f"{ensemble_sql(RATIO_PAIR)}, xc AS (SELECT experiment, series_id, t, value - avg(value) OVER (PARTITION BY experiment, series_id) AS value FROM en WHERE member = 0)", "SELECT experiment, series_id, CAST(t AS INTEGER) AS t, round(value, 2) + 0e0 AS value FROM xc WHERE t < 240"))
def series_excerpts(spark, sf_dir):
    return rounded(figures.excerpts(synthesis.generate(_model(spark, sf_dir), RATIO_PAIR), K, 240), 2)


SUITE_GAMMAS, SUITE_SIZES = [0.5, 1.0, 3.0, 10.0, 30.0], {"n_years": 50, "n_members": 5}


def _suite_sql() -> str:
    kinds = {"annual": (ANNUAL, False), "seasonal": (ANNUAL, True), "decadal": (DECADAL, False)}
    plan = [Experiment(**SUITE_SIZES, name="base|1.0")] + [Experiment(**SUITE_SIZES, name=f"{kind}|{g!r}", band_scales=((*band, g),), seasonal_scale=g if seasonal else 1.0) for kind, (band, seasonal) in kinds.items() for g in SUITE_GAMMAS]
    rows = ", ".join(f"('{label}', '{kind}', '{group}', {'NULL::DOUBLE' if ratio is None else repr(ratio) + 'e0'})" for label, kind, group, ratio in suite.target_rows())
    return with_(
        f"""{ensemble_sql(plan)}, {band_power_sql(*ANNUAL, 'pa')}, {band_power_sql(*DECADAL, 'pd')},
cv AS (SELECT series_id, split_part(experiment, '|', 1) AS kind, CAST(split_part(experiment, '|', 2) AS DOUBLE) AS gamma, CASE WHEN experiment LIKE 'decadal%' THEN avg(pd.v) ELSE avg(pa.v) END AS delivered FROM pa JOIN pd USING (experiment, series_id, member) GROUP BY experiment, series_id),
pl(label, kind, "group", ratio) AS (VALUES {rows}), ta AS (SELECT label, pl.kind, "group", series_id, delivered * ratio AS target FROM pl, cv WHERE cv.kind = 'base'),
st AS (SELECT *, lead(delivered) OVER w AS d, lead(gamma) OVER w AS g FROM cv WHERE kind != 'base' WINDOW w AS (PARTITION BY kind, series_id ORDER BY delivered, gamma)), en2 AS (SELECT kind, series_id, min(delivered) AS lo, max(delivered) AS hi, arg_min(gamma, (delivered, gamma)) AS fl FROM cv GROUP BY 1, 2),
fo AS (SELECT label, ta.kind, "group", ta.series_id, target, CASE WHEN target IS NULL THEN {max(SUITE_GAMMAS)!r}e0 WHEN target <= any_value(lo) THEN any_value(fl) WHEN target >= any_value(hi) THEN NULL ELSE max(CASE WHEN target >= delivered AND target < d THEN gamma + (target - delivered) / (d - delivered) * (g - gamma) END) END AS gamma FROM ta JOIN en2 USING (kind, series_id) JOIN st USING (kind, series_id) GROUP BY 1, 2, 3, 4, 5)""",
        'SELECT label, kind, "group", series_id, round(target, 2) AS target, round(gamma, 6) AS gamma FROM fo',
    )


@query(_suite_sql())
def calibrated_suite(spark, sf_dir):
    return rounded(suite.calibrated_suite(_model(spark, sf_dir), SUITE_GAMMAS, **SUITE_SIZES), 6, target=2)


# --- helpers of older scripts


@query(with_(TAIL, "SELECT series_id, n, k, round(freq, 6) AS freq FROM (SELECT *, k * (12e0 / n) AS freq FROM (SELECT series_id, n, unnest(range(0, n // 2 + 1)) AS k FROM (SELECT series_id, count(*) AS n FROM r GROUP BY 1))) WHERE freq BETWEEN 1e0 / 15e-1 AND 1e0 / 5e-1"))
def bandpass_bins(spark, sf_dir):
    """The bins of the annual band in each series' spectrum."""
    lengths = region_month_series(spark, sf_dir).groupBy(*K).agg(F.count("*").alias("n"))
    return rounded(spectral.bandpass(spectral.frequency_grid(lengths, K), 0.5, 1.5), 6)


LINE = (10.0, 0.25)
UNSCALED = f"""{members_sql([BASELINE])}, me AS (SELECT series_id, avg(value) AS mean FROM s GROUP BY 1), of AS (SELECT series_id, psd FROM wp WHERE k = 0),
un AS (SELECT experiment, series_id, member, t, x + sqrt(psd * {BASELINE.n_months} * 6e0) / {BASELINE.n_months} + mean + {LINE[0]!r}e0 + {LINE[1]!r}e0 * t AS value FROM xs JOIN of USING (series_id) JOIN me USING (series_id))"""


@query(with_(UNSCALED, "SELECT experiment, series_id, CAST(member AS INTEGER) AS member, count(*) AS n, round(avg(value), 4) AS mean, round(var_pop(value), 4) AS variance, round(min(value), 4) AS low, round(max(value), 4) AS high FROM un GROUP BY 1, 2, 3"))
def reassembled_unscaled(spark, sf_dir):
    """Members with the spectrum's own variance, put together with the mean and a line."""
    model = _model(spark, sf_dir)
    members = synthesis.synthesize(model.psd, K, [BASELINE], unit=False).withColumnRenamed("g", "value").join(model.mean, K)
    out = synthesis.reassemble(members, F.col("mean"), (F.lit(LINE[0]), F.lit(LINE[1])))
    return rounded(out.groupBy("experiment", *K, "member").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("variance"), F.min("value").alias("low"), F.max("value").alias("high")))


@query(with_(welch("(SELECT series_id, t - min(t) OVER (PARTITION BY series_id) AS t, g AS value FROM g WHERE series_id = 'ASIA')", TAIL, NPERSEG), "SELECT 'orders' AS series_id, CAST(k AS INTEGER) AS k, round(freq, 6) AS freq, round(psd, 6) AS psd FROM wp"))
def generator_from_file(spark, sf_dir):
    """A region's series, written as a gridded file; the spectrum of the generator fitted from it."""
    path = f"{shared_dir(spark)}/series-{uuid.uuid4().hex}"
    series = region_month_series(spark, sf_dir).where("series_id = 'ASIA'")
    start = series.agg(F.min("ts")).first()[0]
    netcdf.write_grid(series.withColumn("rlat", F.lit(0)).withColumn("rlon", F.lit(0)), path, 1, 1, "orders", str(start)[:10])
    psd = synthesis.fit_from_path(spark, path, "orders", NPERSEG).psd
    return rounded(psd.select(*K, F.col("k").cast("int").alias("k"), "freq", "psd"), 6)
