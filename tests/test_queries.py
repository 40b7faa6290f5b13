"""Every registered query against its SQL, and what its plan may not contain."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

import __spark_entry__ as contract  # noqa: E402
import check_queries  # noqa: E402
from columnwright.catalog import ORACLES, QUERIES  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return check_queries.connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_equal_those_of_the_sql(spark, con, name):
    outcome, _ = check_queries.compare(spark, con, name, SF)
    assert outcome.startswith("ok") and "TYPES" not in outcome, outcome


# Whole runs are looped over by the driver; their parts are checked above.
LOOPS = {"augment_round", "augment_run", "prune_staged", "cv_auc_gbt", "cv_auc_lr", "prune_staged_accuracy"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - LOOPS))
def test_plans_have_no_cross_join(spark, name):
    plan = contract.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "BatchEvalPython"):
        assert word not in plan, word


def test_flagship_query(spark):
    rows = contract.entry(spark).collect()
    assert [r["fold"] for r in rows] == [0, 1, 2, 3, 4]


def test_every_query_without_sql_is_a_loop():
    assert set(QUERIES) - set(ORACLES) == LOOPS
    assert set(QUERIES) <= set(contract.queries())
