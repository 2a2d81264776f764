"""The plans: one scan for all rules of a table, one merging pass without another exchange or sort, columns and filters pushed down."""

import os

import pytest
from pyspark.sql import functions as F

from tallywright.queries import problems, reference
from tallywright.session import table

SF_DIR = os.environ.get("TALLYWRIGHT_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def plan(df) -> str:
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("Initial Plan")[0]


def test_rules_share_one_scan(spark):
    text = plan(reference.audit_batch(spark, SF_DIR))
    assert text.count("FileScan") == 1 and "Exchange" not in text
    assert "o_custkey" not in text  # columns that no rule names aren't read


@pytest.mark.parametrize(("query", "exchanges"), [(problems.p1_found, 2), (problems.p6_found, 2)])
def test_merges_are_one_pass(spark, query, exchanges):
    text = plan(query(spark, SF_DIR))
    assert text.count("Exchange rangepartitioning") == 1 and text.count("Exchange hashpartitioning") == exchanges - 1
    window = text.split("Exchange rangepartitioning")[0]
    assert window.count("Window [") == 1 and window.count("Sort [") == 1


def test_history_has_one_exchange_by_key(spark):
    from tallywright.operators.history import history

    text = plan(history(table(spark, SF_DIR, "spriden").withColumn("day", F.date_format("spriden_activity_date", "yyyy-MM-dd")), "spriden_pidm", "day", ["spriden_id"], ["row_id"], F.lit("9999-12-31")))
    assert text.count("Exchange hashpartitioning") == 2  # newest row per key and start, then all of a key


def test_filters_reach_the_scan(spark):
    text = plan(table(spark, SF_DIR, "orders").where("o_orderkey > 100").select("o_orderkey"))
    assert "PushedFilters: [IsNotNull(o_orderkey), GreaterThan(o_orderkey,100)]" in text and "ReadSchema: struct<o_orderkey:bigint>" in text
