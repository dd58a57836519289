"""One key with a third of the rows, and sides too large to broadcast."""

import os
import shutil

import duckdb
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries

SOURCE = "/root/testdata/sf0.1"
SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200k",
    "spark.sql.files.maxPartitionBytes": "400k",
    "spark.sql.files.openCostInBytes": "0",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture(scope="module")
def hot(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("hot"))
    for name in ("nation", "customer"):
        shutil.copy(f"{SOURCE}/{name}.parquet", folder)
    orders = spark.read.parquet(f"{SOURCE}/orders.parquet")
    key = F.when(F.col("o_orderkey") % 3 == 0, F.lit(7)).otherwise(F.col("o_custkey"))
    orders.withColumn("o_custkey", key.cast("long")).repartition(32).write.parquet(f"{folder}/orders.parquet")
    return folder


@pytest.fixture
def shuffled_joins(spark):
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize(
    "name, splits",
    [
        ("agg12_regroup_state_year_quarter", True),
        ("agg15_pincodes_by_volume", True),
        ("agg02_user_trend", False),
        ("top05_middle_pincodes", None),
        ("agg28_hierarchy", None),
    ],
)
def test_hot_customer(spark, hot, shuffled_joins, name, splits):
    """The hot partition is split, or (users) counted per customer before it can form."""
    con = duckdb.connect()
    for path in os.listdir(hot):
        scan = f"{hot}/{path}" + ("/*.parquet" if path.startswith("orders") else "")
        con.execute(f"CREATE VIEW {path[:-8]} AS SELECT * FROM '{scan}'")
    result = con.execute(oracle_sql()[name])
    columns = [d[0] for d in result.description]
    df = queries()[name](spark, hot).select(*columns)
    assert sorted(map(tuple, df.collect()), key=str) == sorted(result.fetchall(), key=str)
    plan = df._jdf.queryExecution().executedPlan().toString()
    if splits is not None:
        assert ("skew=true" in plan) == splits
