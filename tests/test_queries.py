"""Every registered volume query with SQL against DuckDB on the smallest tables; the others must run."""

import glob
import os

import duckdb
import numpy as np
import pytest

from stratavox.queries import ORACLE_SQL, QUERIES, SMALL_SQL

SQL = ORACLE_SQL | SMALL_SQL

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.execute(SQL[name]).fetchdf()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols and len(got) == len(want)
    got, want = (f[cols].sort_values(cols).reset_index(drop=True) for f in (got, want))
    for c in cols:
        if got[c].dtype == float or want[c].dtype == float:  # a nullable integer column of few rows is a float here too
            assert np.allclose(got[c].astype(float), want[c].astype(float), rtol=0, atol=2e-6, equal_nan=True), c
        else:
            same = [(None if a != a or a is None else a) for a in got[c].astype(object)], [(None if b is None or str(b) == "<NA>" else b) for b in want[c].astype(object)]
            assert same[0] == same[1], c


#: Run on drawn volumes in test_volumes.py instead.
SLOW = {"l4_propagate_labels", "l2_candidate_mask_1", "i6_clean_volume", "k6_sparse_annotations"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - SLOW))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
