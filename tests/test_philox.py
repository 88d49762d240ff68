"""Counter-based draws: published answers, and the same numbers from arrays, Spark and SQL."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesforge.functions import kernels, philox
from seriesforge.operators import synthesis
from seriesforge.plans.experiments import Experiment


@pytest.mark.parametrize("counter, key, words", [((0, 0), 0, (0xFF1DAE59, 0x6CD10DF2)), ((0xFFFFFFFF, 0xFFFFFFFF), 0xFFFFFFFF, (0x2C3F628B, 0xAB4FD7AD)), ((0x243F6A88, 0x85A308D3), 0x13198A2E, (0xDD7CE038, 0xF62A4C12))])
def test_published_answers(counter, key, words):
    assert tuple(map(int, philox.words(*counter, key))) == words


def test_all_engines_draw_the_same(spark):
    i = np.arange(2000)
    want = philox.uniform(i, i * 7 + 3, i * 1_000_003)
    rows = philox.with_uniform(spark.range(2000), "u", F.col("id"), F.col("id") * 7 + 3, F.col("id") * 1_000_003).orderBy("id")
    assert rows.columns == ["id", "u"] and np.array_equal([r["u"] for r in rows.collect()], want)
    sql = duckdb.sql("SELECT u FROM " + philox.uniform_sql("range(0, 2000) x(i)", "i", "u", "i", "i * 7 + 3", "i * 1000003") + " ORDER BY i").fetchnumpy()["u"]
    assert np.array_equal(sql, want) and 0 < want.min() and want.max() < 1
    key = f"SELECT {philox.key_sql(repr('ASIA'), 5, philox.SPARK)} AS k"
    assert spark.sql(key).first()["k"] == duckdb.sql(f"SELECT {philox.key_sql(repr('ASIA'), 5)} AS k").fetchall()[0][0]


def test_draws_are_uniform_and_apart():
    u = philox.uniform(*np.meshgrid(np.arange(300), np.arange(300)), 9).ravel()
    counts, _ = np.histogram(u, 50, (0, 1))
    assert abs(u.mean() - 0.5) < 0.005 and counts.min() > 1600 and len(np.unique(u)) == len(u)
    assert abs(np.corrcoef(u[:-1], u[1:])[0, 1]) < 0.01


def test_members_do_not_depend_on_how_many_there_are(spark):
    psd = spark.createDataFrame([("a", k, 0.2 * k, 1.0 / (1 + k)) for k in range(31)], "series_id string, k long, freq double, psd double")
    few, many = (synthesis.synthesize(psd, ["series_id"], [Experiment(5, n, 3)]).where("member = 1").orderBy("t").collect() for n in (2, 6))
    assert [r["g"] for r in few] == [r["g"] for r in many]
    old = synthesis.synthesize(psd, ["series_id"], [Experiment(5, 2, 3)], sequential=True).where("member = 1").orderBy("t").collect()
    amplitude = kernels.amplitudes(0.2 * np.arange(31), 1.0 / (1 + np.arange(31)), 60, 12.0, None)
    assert np.allclose([r["g"] for r in old], kernels.synthesize(amplitude, 60, kernels.sequential_phases(31, 3, 1)))
    assert np.allclose([r["g"] for r in few], kernels.synthesize(amplitude, 60, kernels.counter_phases(31, 3, 1)))
