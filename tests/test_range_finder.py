"""The truncated decomposition against the dense one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesforge.operators import field, range_finder


def made(spark, n_cells, n_times, names=None, holes=False, seed=0):
    rng = np.random.default_rng(seed)
    left, right = rng.normal(size=(n_times, 6)), rng.normal(size=(6, n_cells))
    x = left @ np.diag([9.0, 6.0, 4.0, 2.5, 1.5, 1.0]) @ right + 0.3 * rng.normal(size=(n_times, n_cells))
    rows = [(names[c] if names else c, t, float(x[t, c])) for c in range(n_cells) for t in range(n_times) if not (holes and (c * 7 + t * 3) % 11 == 0)]
    kind = "string" if names else "int"
    cells = spark.createDataFrame([(names[c] if names else c, -70.0 - 10.0 * c / n_cells) for c in range(n_cells)], f"cell_id {kind}, lat double")
    return spark.createDataFrame(rows, f"cell_id {kind}, t int, value double"), cells


@pytest.mark.parametrize("n_cells, n_times, holes", [(45, 37, False), (23, 60, True)])
def test_equals_the_gram_route(spark, monkeypatch, n_cells, n_times, holes):
    f, cells = made(spark, n_cells, n_times, names=[f"c{i:03d}" for i in range(n_cells)], holes=holes)
    want = [sorted(map(tuple, df.collect())) for df in field.fit_eofs(f, cells, 3)]
    monkeypatch.setattr(field, "MOST", 5)
    whole = range_finder.leading
    monkeypatch.setattr(range_finder, "leading", lambda points, n: whole(points, n, side=8))
    got = [sorted(map(tuple, df.collect())) for df in field.fit_eofs(f, cells, 3)]
    for a, b in zip(got, want):
        assert [r[:-1] if len(r) > 2 and not isinstance(r[1], float) else r[0] for r in a] == [r[:-1] if len(r) > 2 and not isinstance(r[1], float) else r[0] for r in b]
        numbers = lambda rows: np.array([[x for x in r if isinstance(x, float)] for r in rows])
        assert np.abs(numbers(a) - numbers(b)).max() < 1e-8 * max(1.0, np.abs(numbers(b)).max())


def test_fewer_directions_than_asked_for(spark):
    t, c = np.arange(30), np.arange(20)
    rows = [(int(j), int(i), float(np.sin(i) * (j + 1))) for i in t for j in c]
    found = range_finder.leading(spark.createDataFrame(rows, "cell_id int, t int, x double"), 4, side=16)
    assert len(found.values) == 1 and found.values[0] == pytest.approx((np.sin(t) ** 2).sum() * ((c + 1.0) ** 2).sum(), rel=1e-10)
    value = range_finder.rows_of(found.cells, "cb", 1).agg(F.sum(F.col("value") ** 2)).first()[0]
    assert value == pytest.approx(1, rel=1e-9)


def test_partial_products_are_added_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(range_finder, "FAN_IN", 2)
    parts = spark.createDataFrame([(k, s, np.array([1.0 * s, k]).tobytes()) for k in range(3) for s in range(9)], "tb long, slot long, vectors binary")
    out = {r["tb"]: np.frombuffer(r["vectors"]).tolist() for r in range_finder._summed(parts, "tb").collect()}
    assert out == {k: [36.0, 9.0 * k] for k in range(3)}
