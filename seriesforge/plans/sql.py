"""Shared parts of the oracle SQL: the series, its decomposition, its ranks."""

from __future__ import annotations

from seriesforge.functions.normal import norm_ppf_sql

SERIES = """
m AS (SELECT r_name AS series_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS ts,
        CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / 1000e0 AS v
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2),
b AS (SELECT min(ts) AS lo, max(ts) AS hi FROM m),
spine AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS ts FROM b),
s AS (SELECT k.series_id, p.ts, CAST((year(p.ts) - year(lo)) * 12 + month(p.ts) - month(lo) AS INTEGER) AS t, CAST(month(p.ts) AS INTEGER) AS month, coalesce(v, 0e0) AS value
      FROM (SELECT DISTINCT series_id FROM m) k CROSS JOIN spine p CROSS JOIN b LEFT JOIN m ON m.series_id = k.series_id AND m.ts = p.ts)
"""
FIELD = """
fm AS (SELECT c_nationkey AS cell_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS ts, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / 1000e0 AS v
      FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
fb AS (SELECT min(ts) AS lo, max(ts) AS hi FROM fm),
fspine AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS ts FROM fb),
f AS (SELECT k.cell_id, p.ts, CAST((year(p.ts) - year(lo)) * 12 + month(p.ts) - month(lo) AS INTEGER) AS t, CAST(month(p.ts) AS INTEGER) AS month, coalesce(v, 0e0) AS value
      FROM (SELECT DISTINCT cell_id FROM fm) k CROSS JOIN fspine p CROSS JOIN fb LEFT JOIN fm ON fm.cell_id = k.cell_id AND fm.ts = p.ts),
cells AS (SELECT n_nationkey AS cell_id, CAST(n_nationkey // 5 AS INTEGER) AS rlat, CAST(n_nationkey % 5 AS INTEGER) AS rlon, -80e0 + (n_nationkey // 5) * 25e-1 AS lat,
        168e0 + (n_nationkey % 5) * 6e0 AS lon, 100e0 + (n_nationkey % 7) * 10e0 AS area, n_name AS name, n_regionkey AS region_key FROM nation)
"""
DAY = "CAST(date_diff('day', DATE '1970-01-01', ts) AS DOUBLE)"
RESID = f"""{SERIES},
tr AS (SELECT series_id, regr_slope(value, {DAY}) AS slope, regr_intercept(value, {DAY}) AS intercept FROM s GROUP BY 1),
d AS (SELECT s.*, slope * {DAY} + intercept AS trend, value - (slope * {DAY} + intercept) AS dv FROM s JOIN tr USING (series_id)),
r AS (SELECT series_id, ts, t, month, dv - avg(dv) OVER (PARTITION BY series_id, month) AS value, avg(dv) OVER (PARTITION BY series_id, month) AS season FROM d)
"""
RANKED = f"""{RESID},
h AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY value, t) AS rank, count(*) OVER (PARTITION BY series_id) AS n FROM r),
hp AS (SELECT *, (rank - 5e-1) / n AS p FROM h),
g AS (SELECT *, {norm_ppf_sql('p')} AS g FROM hp)
"""


def with_(ctes: str, select: str) -> str:
    return f"WITH {ctes.strip()}\n{select}"


TWO_PI = "6.283185307179586e0"


def dft(points: str, by: str, n: str) -> str:
    """|DFT|^2 of points(by, j, x) as (by, k, n, power)."""
    return f"""(SELECT {by}, k, n, c * c + s * s AS power FROM (
      SELECT {by}, k, any_value(n) AS n, sum(x * cos({TWO_PI} * ((k * j) % n) / n)) AS c, sum(x * sin({TWO_PI} * ((k * j) % n) / n)) AS s
      FROM (SELECT *, {n} AS n, unnest(range(0, {n} // 2 + 1)) AS k FROM {points}) GROUP BY {by}, k))"""


PERIODOGRAM = f"""{RESID},
pc AS (SELECT series_id, CAST(t AS BIGINT) AS j, value - avg(value) OVER (PARTITION BY series_id) AS x, count(*) OVER (PARTITION BY series_id) AS len FROM r),
pg AS (SELECT series_id, k, k * 12e0 / n AS freq, CASE WHEN k = 0 OR k = n // 2 THEN 1e0 ELSE 2e0 END * power / (12e0 * n) AS psd FROM {dft('pc', 'series_id', 'len')})
"""


def welch(source: str, ctes: str, nperseg: int, by: str = "series_id") -> str:
    hop = nperseg - nperseg // 2
    return f"""{ctes},
wc AS (SELECT {by}, t, value, count(*) OVER (PARTITION BY {by}) AS len FROM {source}),
ws AS (SELECT {by}, segment, t - segment * {hop} AS j, value FROM (SELECT *, unnest(range(0, CAST((len - {nperseg}) // {hop} + 1 AS BIGINT))) AS segment FROM wc) WHERE t BETWEEN segment * {hop} AND segment * {hop} + {nperseg - 1}),
wt AS (SELECT {by}, segment, CAST(j AS BIGINT) AS j, (value - avg(value) OVER (PARTITION BY {by}, segment)) * (5e-1 - 5e-1 * cos({TWO_PI} * j / {nperseg})) AS x FROM ws),
we AS (SELECT sum((5e-1 - 5e-1 * cos({TWO_PI} * i / {nperseg})) * (5e-1 - 5e-1 * cos({TWO_PI} * i / {nperseg}))) AS energy FROM range(0, {nperseg}) x(i)),
wp AS (SELECT {by}, k, k * (12e0 / {nperseg}) AS freq, avg(power * CASE WHEN k = 0 OR 2 * k = {nperseg} THEN 1e0 ELSE 2e0 END) / (12e0 * any_value(energy)) AS psd, count(*) AS n_segments
       FROM {dft('wt', f'{by}, segment', str(nperseg))} CROSS JOIN we GROUP BY {by}, k)
"""
