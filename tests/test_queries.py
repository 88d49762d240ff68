"""Every registered query with SQL gives the SQL's rows."""

import duckdb
import pytest
from seriesforge.plans import long_records, synthetic
from seriesforge.plans.registry import ORACLE_SQL, QUERIES, flagship

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.fixture(scope="module", autouse=True)
def one_model():
    """The same fitted generator for all queries on it: each would fit it again."""
    fit, kept = synthetic._model, {}

    def model(spark, sf_dir):
        if sf_dir not in kept:
            kept[sf_dir] = fit(spark, sf_dir)
        return kept[sf_dir]

    with pytest.MonkeyPatch.context() as patch:
        for module in (synthetic, long_records):
            patch.setattr(module, "_model", model)
        yield


def test_registry_is_whole():
    assert set(ORACLE_SQL) <= set(QUERIES) and len(ORACLE_SQL) >= 140


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(map(str, r)) for r in df.select(*columns).collect())
    want = sorted(tuple(map(str, r)) for r in duck.sql(f"select {', '.join(f'"{c}"' for c in columns)} from ({ORACLE_SQL[name]})").fetchall())
    assert got == want


def test_flagship(spark, sf_dir):
    assert flagship(spark, sf_dir).count() == 5
