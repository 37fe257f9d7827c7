"""Queries against their SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from tidewatch.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(table):
    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return ""
        return f"{v:.6g}" if isinstance(v, float) else str(v)

    return sorted(tuple(plain(r[c]) for c in sorted(table.columns)) for r in table.to_dict("records"))


@pytest.mark.parametrize("name", sorted(set(ORACLES) - {"fuse_stream"}))
def test_query_equals_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, SF).toPandas().astype(object)) == rows(duck.execute(ORACLES[name]).df().astype(object))
