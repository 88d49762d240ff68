"""Queries on gridded files, polygon files, map projection, unions of polygons and EOFs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from seriesforge.functions.normal import norm_ppf_sql
from seriesforge.operators import field, validation
from seriesforge.plans.experiments import Experiment
from seriesforge.plans.relational import query, rounded
from seriesforge.plans.spectra import FRESID, NPERSEG, TAIL, _field_residuals
from seriesforge.plans.sql import FIELD, RESID, welch, with_
from seriesforge.plans.synthetic import renamed_welch, residuals_sql
from seriesforge.sources import geometry, netcdf, shapefile
from seriesforge.sources.frames import nation_cells, nation_month_field, table
from seriesforge.sources.intermediate import shared_dir


@query(with_(FIELD, "SELECT t, ts, rlat, rlon, round(value, 6) AS value FROM f JOIN cells USING (cell_id)"))
def gridded_files(spark, sf_dir):
    """The nations' field, written as gridded files and read back by month and cell."""
    path = f"{shared_dir(spark)}/grid-{uuid.uuid4().hex}"
    placed = nation_month_field(spark, sf_dir).join(nation_cells(spark, sf_dir).select("cell_id", "rlat", "rlon"), "cell_id")
    start = placed.agg(F.min("ts")).first()[0]
    netcdf.write_grid(placed, path, 5, 5, "orders", str(start)[:10])
    return rounded(netcdf.read_grid(spark, path, "orders"), 6)


X, Y = geometry.polar_sql("lat", "lon")
LAT, LON = geometry.polar_inverse_sql("x", "y")


@query(with_(FIELD, f"SELECT cell_id, round(x, 3) AS x, round(y, 3) AS y, round({LAT}, 7) AS lat, round({LON}, 7) AS lon FROM (SELECT cell_id, {X} AS x, {Y} AS y FROM cells)"))
def polar_projection(spark, sf_dir):
    there = geometry.to_polar(nation_cells(spark, sf_dir)).select("cell_id", "x", "y")
    return rounded(geometry.from_polar(there), 3, lat=7, lon=7)


DIAMONDS = """di AS (SELECT r_name AS basin, s_suppkey AS p, s_suppkey % 37 + s_acctbal / 1e4 AS cx, s_acctbal / 1e3 AS cy, 15e-1 + s_nationkey % 3 AS w, 1e0 + (s_suppkey % 4) * 5e-1 AS h FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
ed AS (SELECT basin, p, 0 AS e, cx AS x1, cy - h AS y1, cx - w AS x2, cy AS y2 FROM di UNION ALL SELECT basin, p, 1, cx, cy - h, cx + w, cy FROM di UNION ALL SELECT basin, p, 2, cx - w, cy, cx, cy + h FROM di UNION ALL SELECT basin, p, 3, cx + w, cy, cx, cy + h FROM di),
sl AS (SELECT *, (x2 - x1) / (y2 - y1) AS m FROM ed),
cr AS (SELECT a.basin, (b.x1 - a.x1 + a.m * a.y1 - b.m * b.y1) / (a.m - b.m) AS y, greatest(a.y1, b.y1) AS lo, least(a.y2, b.y2) AS hi FROM sl a JOIN sl b ON a.basin = b.basin AND (a.p < b.p OR a.p = b.p AND a.e < b.e) WHERE a.m != b.m),
le AS (SELECT basin, y1 AS y FROM ed UNION SELECT basin, y2 FROM ed UNION SELECT basin, y FROM cr WHERE y > lo AND y < hi),
sb AS (SELECT basin, y AS a, lead(y) OVER (PARTITION BY basin ORDER BY y) AS b FROM le),
cu AS (SELECT sb.basin, sb.a, sb.b, p, x1 + m * (a - y1) AS lo, x1 + m * (b - y1) AS hi FROM sb JOIN sl ON sl.basin = sb.basin AND y1 <= sb.a AND y2 >= sb.b WHERE sb.b IS NOT NULL),
tu AS (SELECT *, 2 * (row_number() OVER (PARTITION BY basin, a, p ORDER BY lo + hi) % 2) - 1 AS step FROM cu),
op AS (SELECT *, sum(step) OVER w AS depth, lead(lo) OVER w AS lo2, lead(hi) OVER w AS hi2 FROM tu WINDOW w AS (PARTITION BY basin, a ORDER BY lo + hi, step DESC))"""


def _diamonds(spark, sf_dir):
    """(basin, s_suppkey, ring): a diamond for each supplier, closed, from its lowest corner."""
    names = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    d = table(spark, sf_dir, "supplier").join(names, F.col("s_nationkey") == F.col("n_nationkey"))
    cx, cy, w, h = F.col("s_suppkey") % 37 + F.col("s_acctbal") / 1e4, F.col("s_acctbal") / 1e3, F.lit(1.5) + F.col("s_nationkey") % 3, F.lit(1.0) + (F.col("s_suppkey") % 4) * 0.5
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ring = F.array(corner(cx, cy - h), corner(cx + w, cy), corner(cx, cy + h), corner(cx - w, cy), corner(cx, cy - h))
    return d.select(F.col("r_name").alias("basin"), "s_suppkey", ring.alias("ring"))


@query(with_(DIAMONDS, "SELECT basin, round(sum((b - a) * (lo2 - lo + hi2 - hi) / 2), 5) AS area FROM op WHERE depth > 0 GROUP BY 1"))
def union_areas(spark, sf_dir):
    """Area of the union of the suppliers' diamonds in each region."""
    polygons = _diamonds(spark, sf_dir).select("basin", F.col("s_suppkey").alias("ring_id"), F.posexplode("ring").alias("seq", "c")).select("basin", "ring_id", "seq", "c.x", "c.y")
    return rounded(geometry.union_area(geometry.dissolve(polygons)), 5)


@query(
    with_(
        DIAMONDS.split("ed AS")[0].rstrip().rstrip(","),
        "SELECT 's_' || p AS name, translate(basin, ' /', '_-') AS region, p AS s_suppkey, CAST(i AS INTEGER) AS seq, round(CASE i WHEN 1 THEN cx + w WHEN 3 THEN cx - w ELSE cx END, 6) + 0e0 AS x, round(CASE i WHEN 0 THEN cy - h WHEN 2 THEN cy + h WHEN 4 THEN cy - h ELSE cy END, 6) + 0e0 AS y FROM di, range(5) AS r(i)",
    )
)
def polygon_files(spark, sf_dir):
    """The suppliers' diamonds, written as polygon files and read back as sectors."""
    path = f"{shared_dir(spark)}/shapes-{uuid.uuid4().hex}"
    shapes = _diamonds(spark, sf_dir).select(F.concat(F.lit("s "), F.col("s_suppkey").cast("string")).alias("NAME"), F.col("basin").alias("REGION"), F.col("s_suppkey").cast("long").alias("s_suppkey"), F.array("ring").alias("rings"))
    shapefile.write_shapes(shapes, path)
    sectors = shapefile.load_sectors(spark, path)
    points = sectors.select("name", "region", "s_suppkey", F.posexplode(F.col("rings")[0]).alias("seq", "p"))
    return rounded(points.select("name", "region", "s_suppkey", "seq", "p.x", "p.y"), 6)


@query("SELECT translate(trim(n_name || ' / ' || n_nationkey), ' /', '_-') AS name, translate(trim(r_name), ' /', '_-') AS region, n_nationkey FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey != 2")
def sector_names(spark, sf_dir):
    regions = table(spark, sf_dir, "region").where("r_regionkey != 2")
    rows = table(spark, sf_dir, "nation").join(regions, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return geometry.sectors(rows.select(F.concat_ws(" / ", "n_name", "n_nationkey").alias("NAME"), F.col("r_name").alias("REGION"), "n_nationkey"))


@query("SELECT n_name AS name, s_suppkey, s_acctbal FROM nation LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS i FROM supplier WHERE s_nationkey % 4 != 1) ON s_nationkey = n_nationkey AND i = 1")
def dissolved_metadata(spark, sf_dir):
    """Each nation beside its first supplier, nations without one kept."""
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("name"))
    rows = table(spark, sf_dir, "supplier").where("s_nationkey % 4 != 1").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("name", "s_suppkey", "s_acctbal")
    return geometry.with_metadata(nations.select("name"), rows, "s_suppkey").select("name", "s_suppkey", "s_acctbal")


# --- EOFs


def eofs_sql(modes: int, squarings: int = 18) -> str:
    """CTEs ``ei`` (mode, lam, v), ``tl`` (total) and ``pj`` (mode, t, value): leading eigenvectors of the cells' Gram matrix by repeated squaring, one taken out after the other."""
    dot = "list_dot_product"
    ctes = [
        f"""{FRESID}, fx AS (SELECT cell_id, t, value * weight AS x FROM fw), ids AS (SELECT list(cell_id ORDER BY cell_id) AS ids FROM (SELECT DISTINCT cell_id FROM fx)),
gm AS (SELECT a.cell_id AS i, b.cell_id AS j, sum(a.x * b.x) AS v FROM fx a JOIN fx b USING (t) GROUP BY 1, 2), a0 AS MATERIALIZED (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(v ORDER BY j) AS r FROM gm GROUP BY i)),
tl AS (SELECT sum(v) AS total FROM gm WHERE i = j)"""
    ]
    for k in range(modes):
        was = f"a{k}"
        for s in range(squarings):
            now = f"q{k}_{s}"
            ctes.append(f"{now} AS MATERIALIZED (SELECT list_transform(p, lambda r: list_transform(r, lambda x: x / top)) AS m FROM (SELECT p, list_max(list_transform(p, lambda r: list_max(r))) AS top FROM (SELECT list_transform(m, lambda r: list_transform(m, lambda c: {dot}(r, c))) AS p FROM {was})))")
            was = now
        ctes.append(f"w{k} AS MATERIALIZED (SELECT list_transform(r, lambda x: x / sqrt({dot}(r, r))) AS u FROM (SELECT unnest(m) AS r FROM {was}) ORDER BY {dot}(r, r) DESC LIMIT 1)")
        ctes.append(f"v{k} AS MATERIALIZED (SELECT {k} AS mode, list_transform(u, lambda x: x * sign(list_filter(u, lambda y: abs(y) > 1e-12)[1])) AS v FROM w{k})")
        ctes.append(f"l{k} AS MATERIALIZED (SELECT mode, v, m, {dot}(v, list_transform(m, lambda r: {dot}(r, v))) AS lam FROM v{k}, a{k})")
        ctes.append(f"a{k + 1} AS MATERIALIZED (SELECT list_transform(range(1, len(v) + 1), lambda i: list_transform(range(1, len(v) + 1), lambda j: m[i][j] - lam * v[i] * v[j])) AS m FROM l{k})")
    ctes.append("ei AS (" + " UNION ALL ".join(f"SELECT mode, lam, v FROM l{k}" for k in range(modes)) + ")")
    ctes.append("lo AS (SELECT CAST(mode AS INTEGER) AS mode, unnest(ids) AS cell_id, unnest(v) AS loading FROM ei, ids)")
    ctes.append("pj AS (SELECT mode, t, sum(x * loading) AS value FROM fx JOIN lo USING (cell_id) GROUP BY 1, 2)")
    return ", ".join(ctes)


NORTH = ", nr AS (SELECT mode, lam, lam * sqrt(2e0 / n) AS error, least(coalesce(lag(lam) OVER w - lam, 1e300), coalesce(lam - lead(lam) OVER w, 1e300)) AS gap FROM ei, (SELECT count(DISTINCT t) AS n FROM fx) WINDOW w AS (ORDER BY mode))"


@query(with_(eofs_sql(4) + NORTH + ", pv AS (SELECT mode, var_pop(value) AS v FROM pj GROUP BY 1)", "SELECT CAST(nr.mode AS INTEGER) AS mode, round(sqrt(lam), 2) AS s, round(lam / total, 6) AS expvar, round(error, 0) AS error, round(gap, 0) AS gap, gap > error AS separable, round(v, 0) AS pc_variance FROM nr JOIN pv USING (mode), tl"))
def eof_fit(spark, sf_dir):
    eofs, pcs, spectrum = field.fit_eofs(_field_residuals(spark, sf_dir), nation_cells(spark, sf_dir), 4)
    n = pcs.agg(F.max("t")).first()[0] + 1
    return rounded(field.north_rule(spectrum, n).join(pcs.groupBy("mode").agg(F.var_pop("value").alias("pc_variance")), "mode"), 0, s=2, expvar=6)


@query(with_(eofs_sql(4), "SELECT mode + 1 AS mode, rlat, rlon, round(loading / weight, 6) + 0e0 AS loading FROM lo JOIN cw USING (cell_id) JOIN cells USING (cell_id)"))
def eof_patterns(spark, sf_dir):
    cells = nation_cells(spark, sf_dir)
    eofs, _, _ = field.fit_eofs(_field_residuals(spark, sf_dir), cells, 4)
    return rounded(field.eofs_as_field(eofs, cells), 6)


@query(with_(eofs_sql(4), "SELECT CAST(mode + 1 AS INTEGER) AS mode, round(100 * lam / total, 4) AS var_pct, round(100 * sum(lam) OVER (ORDER BY mode) / total, 4) AS cumulative_pct, round(sqrt(lam), 2) AS s FROM ei, tl"))
def eof_summary(spark, sf_dir):
    _, _, spectrum = field.fit_eofs(_field_residuals(spark, sf_dir), nation_cells(spark, sf_dir), 4)
    return rounded(field.eof_summary(spectrum), 4, s=2)


def _component_sql() -> str:
    ranked = f"{eofs_sql(4)}, hp AS (SELECT mode, t, (row_number() OVER (PARTITION BY mode ORDER BY value, t) - 5e-1) / count(*) OVER (PARTITION BY mode) AS p FROM pj), g AS (SELECT mode, t, {norm_ppf_sql('p')} AS value FROM hp)"
    fine = renamed_welch("g", 40, "mode", "o")
    return with_(
        f"""{welch("g", ranked, NPERSEG, "mode")}, {fine}, us AS (SELECT mode, k, least(k * {NPERSEG / 40!r}e0, {NPERSEG // 2}e0) AS pos FROM owp), ul AS (SELECT *, CAST(least(floor(pos), {NPERSEG // 2 - 1}) AS BIGINT) AS lo FROM us),
ui AS (SELECT ul.mode, ul.k, a.psd + (pos - lo) * (z.psd - a.psd) AS used FROM ul JOIN wp a ON a.mode = ul.mode AND a.k = lo JOIN wp z ON z.mode = ul.mode AND z.k = lo + 1),
rm AS (SELECT mode, sqrt(avg(pow(log10(psd) - log10(used), 2))) AS rms FROM owp JOIN ui USING (mode, k) WHERE k > 0 GROUP BY 1)""",
        "SELECT CAST(mode AS INTEGER) AS mode, round(lam / total, 6) AS expvar, round(sum(lam) OVER (ORDER BY mode) / total, 6) AS eof_cumvar, round(rms, 6) AS psd_rms FROM ei JOIN rm USING (mode), tl",
    )


@query(_component_sql())
def component_metrics(spark, sf_dir):
    return rounded(validation.component_metrics(_field_residuals(spark, sf_dir), nation_cells(spark, sf_dir), 4, NPERSEG), 6)


# --- synthetic fields


def fields_sql(experiments: list[Experiment], nperseg: int, n_modes: int = 4, source: str = FIELD) -> str:
    """CTEs up to ``fe`` (experiment, member, cell_id, t, value): members of the modes, put together again with seasons and means."""
    modes = eofs_sql(n_modes).replace(FIELD.strip(), source.strip())
    ranked = TAIL.replace(RESID.strip(), modes + ", r AS (SELECT CAST(mode AS VARCHAR) AS series_id, t, value FROM pj)")
    return f"""{residuals_sql(experiments, nperseg, ranked, by_mode=True)},
fs AS (SELECT cell_id, month, avg(dv) AS season FROM fd GROUP BY 1, 2), fm2 AS (SELECT cell_id, avg(value) AS mean FROM f GROUP BY 1),
fo AS (SELECT experiment, member, cell_id, t, month, sum(resid * loading) / any_value(weight) AS x FROM rs JOIN lo ON rs.series_id = CAST(lo.mode AS VARCHAR) JOIN cw USING (cell_id) GROUP BY 1, 2, 3, 4, 5),
fe AS (SELECT experiment, member, cell_id, t, x + amp * coalesce(season, 0e0) + mean AS value FROM fo JOIN ex USING (experiment) LEFT JOIN fs USING (cell_id, month) JOIN fm2 USING (cell_id))"""


FIELD_SUITE = [Experiment.baseline(n_years=50, n_members=10), Experiment.annual_enhanced(n_years=50, n_members=10)]


@query(with_(fields_sql(FIELD_SUITE, NPERSEG), "SELECT experiment, CAST(member AS INTEGER) AS member, cell_id, count(*) AS n, round(avg(value), 3) AS mean, round(var_pop(value), 1) AS variance FROM fe GROUP BY 1, 2, 3"))
def field_generate(spark, sf_dir):
    e = field.generate_fields(nation_month_field(spark, sf_dir), nation_cells(spark, sf_dir), FIELD_SUITE, 4, NPERSEG)
    return rounded(e.groupBy("experiment", "member", "cell_id").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("variance")), 3, variance=1)


def _field_half_sql(half: int) -> str:
    whole = FIELD.strip().replace("f AS (SELECT k.cell_id", "fa AS (SELECT k.cell_id", 1)
    halved = f"{whole}, fh AS (SELECT *, CAST(t >= (max(t) OVER () + 1) // 2 AS INTEGER) AS half FROM fa), f AS (SELECT cell_id, ts, CAST(t - min(t) OVER () AS INTEGER) AS t, month, value FROM fh WHERE half = {half})"
    ctes = fields_sql([Experiment(50, 10, 0)], 12, 4, halved)
    maps = "avg(value) AS m, var_pop(value) AS v"
    return with_(
        f"{ctes}, oo AS (SELECT cell_id, {maps} FROM fh WHERE half = {1 - half} GROUP BY 1), ss AS (SELECT cell_id, {maps} FROM fe GROUP BY 1)",
        f"SELECT {half} AS fitted_half, round(corr(oo.m, ss.m), 6) AS mean_corr, round(corr(oo.v, ss.v), 6) AS variance_corr, round(avg(ss.m) / avg(oo.m), 6) AS mean_ratio, round(avg(ss.v) / avg(oo.v), 6) AS variance_ratio, round(avg(ss.v / oo.v), 6) AS map_ratio FROM oo JOIN ss USING (cell_id)",
    )


@query(f"SELECT * FROM ({_field_half_sql(0)}) UNION ALL SELECT * FROM ({_field_half_sql(1)})")
def field_calibration_split(spark, sf_dir):
    return rounded(validation.field_calibration_split(nation_month_field(spark, sf_dir), nation_cells(spark, sf_dir)), 6)
