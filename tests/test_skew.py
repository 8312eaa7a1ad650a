"""One customer holds a third of all orders, so one project holds a third of all tests."""

import os

import duckdb
import pytest
from check_sql import TABLES, difference, open_views

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    folder = tmp_path_factory.mktemp("skewed")
    for name in TABLES:
        if name != "orders":
            os.symlink(f"{SF}/{name}.parquet", folder / f"{name}.parquet")
    duckdb.execute(
        "COPY (SELECT * REPLACE (CASE WHEN hash(o_orderkey) % 3 = 0 THEN 44 ELSE o_custkey END AS o_custkey)"
        f" FROM '{SF}/orders.parquet') TO '{folder}/orders.parquet' (FORMAT parquet)"
    )
    return str(folder)


@pytest.mark.parametrize("name", ["samples_first_assert", "samples_per_assert", "class_chain"])
def test_hot_project(spark, skewed, name):
    assert difference(spark, open_views(skewed), skewed, name) == ""


def test_hot_project_without_broadcast_and_with_split_joins(spark, skewed):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.0",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16KB",
    }
    before = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        assert difference(spark, open_views(skewed), skewed, "samples_first_assert") == ""
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
