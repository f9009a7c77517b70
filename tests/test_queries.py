"""Every registered query against its check SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_point
from check import TABLES, arrow_kinds, normal, same_rows
from stepchange.plans import catalog

FOLDER = os.environ.get("STUDY_TABLES", "/root/testdata/sf0.001")
# The corpus queries have tests of their own
QUERIES = {name: query for name, query in entry_point.queries().items() if name in catalog.QUERIES}
ORACLES = catalog.ORACLES
# The models' own tests check their numbers; here they only have to run
MODELS = [name for name in QUERIES if name not in ORACLES]


@pytest.fixture(scope="module")
def engine():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", ORACLES)
def test_query_matches_its_sql(spark, engine, name):
    frame = QUERIES[name](spark, FOLDER)
    if name in ("zone_change", "zone_names_join", "zone_map_table", "zone_spearman", "clean_trips"):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
        assert "CollectMetrics" not in plan
    found = frame.toArrow()
    expected = engine.sql(ORACLES[name]).to_arrow_table()
    assert arrow_kinds(found.schema) == arrow_kinds(expected.schema)
    assert same_rows(normal(found), normal(expected))


def test_every_check_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry_point.entry(spark).count() == 5


@pytest.mark.parametrize("name", ["did_poisson", "event_study"])
def test_rows_only_queries_run(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_trips_are_staged_without_a_shuffle_of_wide_rows(spark, monkeypatch):
    from stepchange.plans import driver_tables
    from stepchange.sources import files

    monkeypatch.setattr(files, "TASK_MB", 0.01)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
    try:
        joined = driver_tables.trips(spark, FOLDER)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        # More line items than the session's partitions should sort are dealt out wider, once
        sides = [line for line in plan.splitlines() if "l_extendedprice" in line and "FileScan" in line]
        dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(l_" in line]
        assert len(sides) == 1 and len(dealt) == 1 and "REPARTITION_BY_NUM" in dealt[0]
        assert "hashpartitioning(l_orderkey" in dealt[0] and "hashpartitioning(l_orderkey#" in plan
        assert int(dealt[0].split(", ")[1].rstrip(")")) > int(spark.conf.get("spark.sql.shuffle.partitions"))
        # Customers meet orders, not line items
        assert plan.index("l_extendedprice") < plan.index("c_custkey")
        above = plan[: plan.index("Exchange hashpartitioning(l_orderkey")]
        assert "c_custkey" not in above
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # The stage is written by the tasks that joined: no folder a month
    assert not any("file_month=" in name for name in catalog.stage(spark, FOLDER).inputFiles())


def test_a_zone_is_one_row_of_the_join_of_visited_zones(spark):
    plan = QUERIES["flag_cardinality"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [LocationID" in plan[plan.index("LeftSemi") :]
