"""Every registered query against its SQL twin, and the shape of its plan."""

import glob
import math
import os

import duckdb
import pytest

from __spark_entry__ import entry
from workload.registry import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}



@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    return "nan" if isinstance(value, float) and math.isnan(value) else value


def _sorted(rows):
    return sorted((tuple(_plain(v) for v in row) for row in rows), key=lambda r: tuple(str(v) for v in r))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    frame = df.select(*[f"`{c}`" for c in columns])
    plan = frame._jdf.queryExecution().executedPlan().toString()
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert word not in plan
    result = duck.execute(ORACLES[name])
    described = {d[0]: str(d[1]) for d in result.description}
    positions = [list(described).index(c) for c in columns]
    expected = [tuple(row[i] for i in positions) for row in result.fetchall()]
    assert columns == sorted(described)
    assert {c: TYPES[df.schema[c].dataType.simpleString()] for c in columns} == described
    assert _sorted(frame.collect()) == _sorted(expected)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    df = entry(spark)
    assert df.columns[:2] == ["year", "quarter"]
    assert df.count() > 0
