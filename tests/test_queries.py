"""Each query with SQL must agree with DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import numpy as np
import pytest

from rasterloom.plans.catalogue import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    return float(x) if isinstance(x, int | float | np.number | bool | np.bool_) else str(x)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, duck, name):
    ours, theirs = QUERIES[name](spark, DATA).toPandas(), duck.sql(ORACLE[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    rows = lambda df: sorted(map(repr, (tuple(map(plain, r)) for r in df[columns].itertuples(index=False))))
    assert rows(ours) == rows(theirs)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.queries().keys() >= QUERIES.keys() and __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()
    assert QUERIES["region_discovery_t25"](spark, DATA).count() == 500
