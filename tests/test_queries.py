"""Every registered query against its SQL on the smallest scale."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_module

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()
SLOW = {"train_select", "model_grid", "oof_predictions", "gbt_rmse", "gmm_columns"}  # covered by test_models

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def canonical(frame):
    frame = frame[sorted(frame.columns)]
    rows = [tuple(None if v is None or v != v else v for v in row) for row in frame.itertuples(index=False)]
    return sorted(rows, key=repr)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query(spark, database, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in ORACLES:
        assert len(got) > 0
        return
    want = database.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = canonical(got), canonical(want)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x == y


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
