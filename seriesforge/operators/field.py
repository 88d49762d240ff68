"""Two-dimensional fields: EOFs from a Gram matrix, reconstruction, coherence.

Each task multiplies blocks of whole records into one partial matrix of scalar
products, and Spark adds these. The matrix is times x times, or cells x cells
where records are longer than there are cells; only that reaches the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesforge.operators import range_finder
from seriesforge.sources.intermediate import removed, written

MOST = 4000  # rows of the matrix, on the shorter side of a field


def with_weights(field: DataFrame, cells: DataFrame) -> DataFrame:
    """Weight: root of the cosine of the latitude, 1 where that is not above 0."""
    c = F.cos(F.radians(F.abs("lat")))
    return field.join(cells.select("cell_id", F.when(c > 0, F.sqrt(c)).otherwise(1.0).alias("weight")), "cell_id")


def _gram(points: DataFrame, row: str, column: str, size: int) -> DataFrame:
    """(a, b, dot), a <= b < size: sums over ``row`` of products of the values x at columns a and b.

    Pairs of columns that no row has together are left out.
    """
    rows = points.groupBy(row).agg(F.collect_list(column).alias("at"), F.collect_list("x").alias("x"))  # one record

    def run(batches):
        total, met = np.zeros((size, size)), np.zeros((size, size))
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.iloc[lo : lo + 256]
                block, there = np.zeros((len(part), size)), np.zeros((len(part), size))
                for i, (at, x) in enumerate(zip(part["at"], part["x"])):
                    block[i, at], there[i, at] = x, 1.0
                total += block.T @ block
                met += there.T @ there
        a, b = np.nonzero(np.triu(met))
        yield pd.DataFrame({"a": a.astype(np.int32), "b": b.astype(np.int32), "dot": total[a, b]})

    return rows.mapInPandas(run, "a int, b int, dot double").groupBy("a", "b").agg(F.sum("dot").alias("dot"))


def gram_matrix(field: DataFrame, cells: DataFrame) -> DataFrame:
    """(t1, t2, dot) of the weighted field, t1 <= t2."""
    w = with_weights(field, cells).where("value is not null").select("cell_id", "t", (F.col("value") * F.col("weight")).alias("x"))
    size = (field.agg(F.max("t")).first()[0] or 0) + 1
    return _gram(w, "cell_id", "t", size).select(F.col("a").alias("t1"), F.col("b").alias("t2"), "dot")


def _decomposed(gram: DataFrame, size: int, n_modes: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Largest eigenvalues with their vectors, and the sum of all."""
    matrix = np.zeros((size, size))
    for r in gram.toLocalIterator():
        matrix[r["a"], r["b"]] = matrix[r["b"], r["a"]] = r["dot"]
    values, vectors = np.linalg.eigh(matrix)
    order = np.argsort(-values)
    values, vectors = np.maximum(values[order], 0), vectors[:, order]
    modes = min(n_modes, int((values > values[0] * 1e-12).sum()))
    return values[:modes], vectors[:, :modes], float(values.sum())


def fit_eofs(field: DataFrame, cells: DataFrame, n_modes: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """eofs(mode, cell_id, loading), pcs(mode, t, value), spectrum(mode, s, expvar).

    A mode's sign makes its first loading (least cell) that is not 0 positive.
    Where the shorter side of the field, times or cells, has over MOST entries,
    the leading modes come from block power iteration on a random subspace.
    """
    spark = field.sparkSession
    n_times, n_cells = field.agg(F.max("t") + 1, F.countDistinct("cell_id")).first()
    w = with_weights(field, cells).where("value is not null").select("cell_id", "t", (F.col("value") * F.col("weight")).alias("x"))
    if min(n_times, n_cells) > MOST:
        return _signed(*_truncated(w, min(n_modes, n_times - 1), n_times))
    by_time = n_times <= MOST
    if by_time:
        values, vectors, total = _decomposed(_gram(w, "cell_id", "t", n_times), n_times, min(n_modes, n_times - 1))
    else:
        ids = [r[0] for r in w.select("cell_id").distinct().orderBy("cell_id").collect()]  # MOST at most
        numbers = F.broadcast(spark.createDataFrame(list(enumerate(ids)), f"_i int, cell_id {field.schema['cell_id'].dataType.simpleString()}"))
        values, vectors, total = _decomposed(_gram(w.join(numbers, "cell_id"), "t", "_i", n_cells), n_cells, n_modes)
    modes = range(len(values))
    spectrum = spark.createDataFrame([(m, float(np.sqrt(values[m])), float(values[m] / total)) for m in modes], "mode int, s double, expvar double")
    if by_time:
        scores = vectors * np.sqrt(values)
        pcs = spark.createDataFrame([(m, t, float(scores[t, m])) for m in modes for t in range(n_times)], "mode int, t int, value double")
        joined = w.join(F.broadcast(pcs.withColumnRenamed("value", "_pc")), "t").join(F.broadcast(spectrum), "mode")  # times x modes rows
        raw = joined.groupBy("mode", "cell_id").agg((F.sum(F.col("x") * F.col("_pc")) / F.max(F.col("s") * F.col("s"))).alias("loading"))
    else:
        raw = spark.createDataFrame([(m, c, float(vectors[i, m])) for m in modes for i, c in enumerate(ids)], f"mode int, cell_id {field.schema['cell_id'].dataType.simpleString()}, loading double")
        pcs = w.join(F.broadcast(raw), "cell_id").groupBy("mode", "t").agg(F.sum(F.col("x") * F.col("loading")).alias("value"))  # cells x modes rows
    return _signed(raw, pcs, spectrum)


def _truncated(points: DataFrame, n_modes: int, n_times: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Loadings, components and spectrum of the leading modes of (cell_id, t, x)."""
    found = range_finder.leading(points, n_modes)
    total, k = points.agg(F.sum(F.col("x") * F.col("x"))).first()[0], len(found.values)
    spectrum = points.sparkSession.createDataFrame([(m, float(np.sqrt(v)), float(v / total)) for m, v in enumerate(found.values)], "mode int, s double, expvar double")
    raw = range_finder.rows_of(found.cells, "cb", k).join(found.numbers.withColumnRenamed("ci", "place"), ["cb", "place"]).select("mode", "cell_id", F.col("value").alias("loading"))
    pcs = range_finder.rows_of(found.times, "tb", k).select("mode", (F.col("tb") * found.side + F.col("place")).cast("int").alias("t"), "value").where(F.col("t") < n_times)
    return raw, pcs, spectrum


def _signed(raw: DataFrame, pcs: DataFrame, spectrum: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    sign = raw.where("abs(loading) > 1e-12").groupBy("mode").agg(F.signum(F.min_by("loading", "cell_id")).alias("_sign"))
    eofs = raw.join(F.broadcast(sign), "mode").select("mode", "cell_id", (F.col("loading") * F.col("_sign")).alias("loading"))
    pcs = pcs.join(F.broadcast(sign), "mode").select("mode", "t", (F.col("value") * F.col("_sign")).alias("value"))
    return eofs, pcs, spectrum


def eofs_as_field(eofs: DataFrame, cells: DataFrame) -> DataFrame:
    """(mode, rlat, rlon, loading): patterns without their weights, modes from 1."""
    placed = with_weights(eofs, cells).join(cells.select("cell_id", "rlat", "rlon"), "cell_id")
    return placed.select((F.col("mode") + 1).alias("mode"), "rlat", "rlon", (F.col("loading") / F.col("weight")).alias("loading"))


def eof_summary(spectrum: DataFrame) -> DataFrame:
    """(mode, var_pct, cumulative_pct, s): modes from 1."""
    run = Window.orderBy("mode").rowsBetween(Window.unboundedPreceding, 0)  # a row per mode
    return spectrum.select((F.col("mode") + 1).alias("mode"), (100 * F.col("expvar")).alias("var_pct"), (100 * F.sum("expvar").over(run)).alias("cumulative_pct"), "s")


def project(field: DataFrame, cells: DataFrame, eofs: DataFrame) -> DataFrame:
    """(mode, t, value): the weighted field on the modes."""
    return with_weights(field, cells).join(eofs, "cell_id").groupBy("mode", "t").agg(F.sum(F.col("value") * F.col("weight") * F.col("loading")).alias("value"))


def reconstruct(pcs: DataFrame, eofs: DataFrame, cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, cell_id, t, value) from components; ``by`` may hold experiment and member."""
    by = by or []
    total = pcs.join(eofs, "mode").groupBy(*by, "cell_id", "t").agg(F.sum(F.col("value") * F.col("loading")).alias("_x"))
    return with_weights(total, cells).select(*by, "cell_id", "t", (F.col("_x") / F.col("weight")).alias("value"))


def modes_for(spectrum: DataFrame, threshold: float = 0.9) -> int:
    """Fewest leading modes that reach the share; all if none do."""
    w = Window.orderBy("mode").rowsBetween(Window.unboundedPreceding, 0)  # a row per mode
    run = spectrum.withColumn("c", F.sum("expvar").over(w))
    return run.agg(F.coalesce(F.min(F.when(F.col("c") >= threshold, F.col("mode") + 1)), F.max("mode") + 1)).first()[0]


def north_rule(spectrum: DataFrame, n_time: int, keys: list[str] | None = None) -> DataFrame:
    """A mode is separable if its eigenvalue is further from its neighbours than its error."""
    w = Window.partitionBy(*(keys or [F.lit(1)])).orderBy("mode")
    lam = F.col("s") * F.col("s")
    out = spectrum.withColumn("_l", lam).withColumn("error", lam * float(np.sqrt(2.0 / n_time)))
    gap = F.least(F.coalesce(F.lag("_l").over(w) - F.col("_l"), F.lit(float("inf"))), F.coalesce(F.col("_l") - F.lead("_l").over(w), F.lit(float("inf"))))
    return out.withColumn("gap", gap).withColumn("separable", F.col("gap") > F.col("error")).drop("_l")


def coherence(cell_variance: float, mean_variance: float, n: int) -> float:
    """Effective correlation between cells from the variance that their mean keeps."""
    return (n * mean_variance / cell_variance - 1) / (n - 1)


def coherence_table(field: DataFrame) -> DataFrame:
    """Variance of cells, of their mean, suppression and effective coherence."""
    n = field.agg(F.countDistinct("cell_id").alias("n_cells"))
    cell = field.groupBy("cell_id").agg(F.var_pop("value").alias("v")).agg(F.avg("v").alias("cell_variance"))
    mean = field.groupBy("t").agg(F.avg("value").alias("m")).agg(F.var_pop("m").alias("mean_variance"))
    one = n.crossJoin(cell).crossJoin(mean)  # a row each
    kept = F.try_divide("mean_variance", "cell_variance")
    return one.withColumn("suppression", kept).withColumn("coherence", F.try_divide(F.col("n_cells") * kept - 1, F.col("n_cells") - 1))


def generate_fields(field: DataFrame, cells: DataFrame, suite: list, n_modes: int = 4, nperseg: int = 30) -> DataFrame:
    """(experiment, member, cell_id, t, value) of all experiments in one job: each mode is a series of its own.

    Modes without variance (below 1e-10) are left out. The seed of a mode and
    member is ``seed + member + mode * (n_members + 1)``. Trend, seasons and modes
    are fitted once.
    """
    from seriesforge.operators import gaussian, preprocess, spectral
    from seriesforge.operators.synthesis import synthesize
    from seriesforge.plans.experiments import experiments_table

    keys = ["cell_id"]
    model = preprocess.fit(field, keys, preprocess.STEP, centre=True)
    resid = preprocess.transform(field, model).select("cell_id", "ts", "t", "month", "value")
    resid = written(resid, "residuals")
    eofs, pcs, _ = fit_eofs(resid, cells, n_modes)
    eofs, pcs = written(eofs, "eofs"), written(pcs, "components")
    removed(resid)
    alive = pcs.groupBy("mode").agg(F.var_pop("value").alias("v")).where("v >= 1e-10").select("mode")
    pcs = pcs.join(F.broadcast(alive), "mode", "left_semi")  # a row per mode
    scores = gaussian.gaussianize(pcs, ["mode"]).select("mode", "t", F.col("g").alias("value"))
    quantiles = gaussian.fit_quantiles(pcs, ["mode"])
    psd = spectral.welch(scores, ["mode"], nperseg)
    seed = F.col("seed") + F.col("member") + F.col("mode") * (F.col("n_members") + 1)
    members = synthesize(psd, ["mode"], suite, seed=seed)
    spread = pcs.groupBy("mode").agg(F.avg("value").alias("_m"))
    back = gaussian.inverse_gaussianize(members, quantiles, ["experiment", "mode", "member"]).join(F.broadcast(spread), "mode")
    out = reconstruct(back.select("experiment", "mode", "member", "t", "value"), eofs, cells, ["experiment", "member"])
    scale = F.broadcast(experiments_table(field.sparkSession, suite).select(F.col("name").alias("experiment"), F.sqrt("seasonal_scale").alias("_a")))  # a row per experiment
    dated = out.withColumn("ts", F.expr("add_months(date'1979-01-01', t)")).withColumn("month", F.month("ts")).join(scale, "experiment")
    return preprocess.inverse_transform(dated, model, season_scale=F.col("_a"), add_mean=True).select("experiment", "member", "cell_id", "t", "value")


def generate_field(field: DataFrame, cells: DataFrame, experiment, n_modes: int = 4, nperseg: int = 30) -> DataFrame:
    """``generate_fields`` of one experiment."""
    return generate_fields(field, cells, [experiment], n_modes, nperseg)
