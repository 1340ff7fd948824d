"""Every registered query against its SQL, and the shape of its plan."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
import check

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for t in check.TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return connection


def test_names():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert len(contract.oracle_sql()) >= 0.8 * len(contract.queries())


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert len(rows) > 12 and list(rows[0].asDict()) == ["month", "n_tags", "n_cases"]


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, con, name):
    verdict = check.compare(spark, con, name, SF)
    assert not verdict.startswith("FAIL"), verdict
    if name not in contract.oracle_sql():
        assert verdict != "rows only: 0"


def plan(spark, name):
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return contract.queries()[name](spark, SF)._jdf.queryExecution().explainString(mode)


@pytest.mark.parametrize("name", ["topic_monthly", "top_city_states", "dedup_exact", "sample_per_group", "class_report",
                                  "macro_join", "merge_tags", "chunk_windows", "month_state_names", "parity"])
def test_no_all_pairs_join(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scans_are_pruned_and_filtered(spark):
    text = plan(spark, "filter_subset")
    assert "GreaterThanOrEqual(o_orderdate,1997-01-01T00:00)" in text and "EqualTo(o_orderstatus,F)" in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_shipdate:timestamp_ntz>" in plan(spark, "topic_monthly")


@pytest.mark.parametrize("name", ["dedup_exact", "dedup_chunked", "sample_per_group", "assemble_context"])
def test_ranks_are_limited_before_the_shuffle(spark, name):
    limits = [line for line in plan(spark, name).splitlines() if line.lstrip(" +-:*").startswith("WindowGroupLimit")]
    assert len(limits) == 2
