"""The registered queries: contract, SQL comparison and plans."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from check import compare, connect  # noqa: E402

from nodeflow.queries import load  # noqa: E402

QUERIES = {name: fn for name, fn in entry.queries().items() if name in load()[0]}
ORACLES = {name: text for name, text in entry.oracle_sql().items() if name in QUERIES}
# flows without SQL are tested against plain models in test_flows and test_iterative
SLOW = {"deferred_training", "process_batch", "fuse_report", "full_run", "stream_ingest", "micro_consolidate"}
ROWS_ONLY = set(QUERIES) - set(ORACLES)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 100
    assert ROWS_ONLY == SLOW


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["row_id", "node_id", "score", "sim", "threshold"] and df.count() == 500


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf, name):
    problem, n = compare(QUERIES[name](spark, sf), connect(sf), ORACLES[name])
    assert problem == ""
    assert n > 0 or name == "training_texts"  # too few texts per source at the smallest scale


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_no_cross_join(spark, sf, name):
    if name.startswith("stream_"):
        pytest.skip("built while the stream runs")
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scans_read_only_what_is_asked(spark, sf):
    def plan(name):
        return QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()

    threshold = plan("dynamic_threshold")
    assert "embedding" not in threshold.split("ReadSchema")[1]
    marks = plan("training_marks")
    assert "p_name" not in marks.split("ReadSchema")[1] and "p_retailprice" not in marks.split("ReadSchema")[1]
    failures = plan("quarantine_should_inc")
    assert "EqualTo(event_type,error)" in failures and "props" not in failures.split("ReadSchema")[1]
    assert "TakeOrderedAndProject" in plan("top_nodes")
    assert "WindowGroupLimit" in plan("training_texts")
